"""Packing: concatenate and cut.

Pass 1 encodes every input partition where it is read and stores each document's
ids with its offset *within the partition*.  The totals of the partitions (one
number each) give every partition's global offset by a prefix sum; pass 2 adds it
and cuts documents at the multiples of the sequence length.  No text and no ids are
shuffled; only ``sequences`` moves the pieces of windows that cross a partition's
boundary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.shared import materialize
from strandloom.llm.tokens import default_tokenizer, encoder, in_blocks

SEQUENCE_LENGTH = 2048
END_ID = 1

_STORED = "part int, local_start long, doc_id long, n long, ids binary"
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, tail = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in in_blocks(batches):
            ids, lengths = encoder(tokenizer).encode(batch["text"])
            ends = np.cumsum(lengths)
            raw = ids.astype("<u4").tobytes()
            stored = [raw[4 * (e - n) : 4 * e] + tail for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            n = lengths + 1
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), pa.array(starts), batch["doc_id"], pa.array(n), pa.array(stored, pa.binary())],
                names=["part", "local_start", "doc_id", "n", "ids"],
            )

    return run


def _cut(offsets: dict[int, int], length: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, "ids"):
            part = batch["part"].to_pylist()
            begin = batch["local_start"].to_numpy() + np.array([offsets[p] for p in part], np.int64)
            n = batch["n"].to_numpy()
            first, last = begin // length, (begin + n - 1) // length
            pieces = last - first + 1
            row = np.repeat(np.arange(len(n)), pieces)
            sequence = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces) + first[row]
            start = np.maximum(begin[row], sequence * length)
            size = np.minimum(begin[row] + n[row], (sequence + 1) * length) - start
            inside = start - begin[row]
            whole = batch["ids"].to_pylist()
            own = [whole[r][4 * a : 4 * (a + s)] for r, a, s in zip(row.tolist(), inside.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(row)), pa.array(inside), pa.array(size), pa.array(np.fromiter(map(zlib.crc32, own), np.int64, len(own))),
                    pa.array(n[row]), pa.array(sequence), pa.array(start - sequence * length), pa.array(own if keep_ids else [None] * len(own), pa.binary()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
            )

    return run


def pack(docs: DataFrame, length: int = SEQUENCE_LENGTH, end_id: int = END_ID, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents, one row each, with their ids (little-endian unsigned 32 bit).

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null or
    empty text is a document of ``end_id`` alone.  Repeated rows (and null
    ``doc_id``) are packed once per row.  An empty table gives no pieces.  The
    order of documents is that of the input's partitions.
    """
    stored = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(tokenizer or default_tokenizer(), end_id), _STORED), "packing")
    offsets, at = {}, 0
    for part, total in stored.groupBy("part").agg(F.sum("n")).orderBy("part").collect():  # one row for each input partition
        offsets[part] = at
        at += total
    return stored.mapInArrow(_cut(offsets, length, keep_ids), _PIECE)


def sequences(pieces: DataFrame, pad_id: int = 0, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """``sequence_id``, ``ids`` (array, padded to ``length``) and ``n_tokens`` for each packed sequence.

    A sequence gathers at most ``length`` ids, so groups are bounded by construction.
    """
    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(b"".join(x["ids"] for x in p), "<u4").astype(np.int32) for p in batch["p"].to_pylist()]
            padded = [np.pad(r, (0, length - len(r)), constant_values=pad_id) for r in rows]
            yield pa.RecordBatch.from_arrays([batch["sequence_id"], pa.array(padded, pa.list_(pa.int32())), batch["n_tokens"]], names=["sequence_id", "ids", "n_tokens"])

    return joined.mapInArrow(build, "sequence_id long, ids array<int>, n_tokens long")


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document; see :func:`pack`."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_ids=False).drop("ids")
