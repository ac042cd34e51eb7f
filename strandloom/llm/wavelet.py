"""Token-id files: one wavelet matrix per shard.

A shard holds the ids of consecutive documents.  Bit planes run from the highest
bit down; on each plane the ids with a 0 come before those with a 1 on the next
one, in stable order.  A directory of the ones before every block of 512 bits (a
sixteenth of a plane) lets ``access``, ``rank`` (count) and ``select`` (occurrence
lookup) work on the planes without decoding; it is part of the file.

File layout: magic, length of a JSON header, the header, then the zstd frames of
each plane and its directory, the document lengths and the document ids.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.shared import materialize, partitions, shared_dir
from strandloom.llm.tokens import default_tokenizer, encoder, in_blocks

MAGIC = b"WVMX0002"
END_ID = 2
#: Ids in a shard; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 20
#: Parts that equal rows may be dealt to.
SPREAD = 64
#: Bits of a plane between two entries of its directory.
BLOCK_BITS = 512

_MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, local_start long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class Plane:
    """A row of bits with rank and select: ``words`` of 64 bits, and ``ones`` before every block of eight words."""

    def __init__(self, n: int, words: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.words, self.ones = n, words, ones

    @classmethod
    def build(cls, bits: np.ndarray) -> Plane:
        blocks = -(-len(bits) // BLOCK_BITS)
        packed = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
        packed[: -(-len(bits) // 8)] = np.packbits(bits, bitorder="little")
        words = packed.view("<u8")
        counts = np.bitwise_count(words).reshape(blocks, -1).sum(axis=1, dtype=np.uint32)
        return cls(len(bits), words, np.concatenate([[0], np.cumsum(counts)]).astype("<u4"))

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    @property
    def zeros(self) -> int:
        return self.n - int(self.ones[-1])

    def bit(self, i: int) -> int:
        return int(self.words[i >> 6]) >> (i & 63) & 1

    def rank(self, i: int) -> int:
        """Ones before position ``i``."""
        block, word = i // BLOCK_BITS, i >> 6
        before = int(self.ones[block]) + int(np.bitwise_count(self.words[block * 8 : word]).sum())
        return before + ((int(self.words[word]) & ((1 << (i & 63)) - 1)).bit_count() if i & 63 else 0)

    def _before(self, block: int, one: bool) -> int:
        return int(self.ones[block]) if one else block * BLOCK_BITS - int(self.ones[block])

    def select(self, one: bool, k: int) -> int:
        """Position of the k-th (from 0) one or zero: binary search over blocks, then inside one."""
        low, high = 0, len(self.ones) - 1  # the last block that has at most k before it
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._before(middle, one) <= k else (low, middle)
        k -= self._before(low, one)
        own = np.unpackbits(self.words[8 * low : 8 * low + 8].view(np.uint8), bitorder="little")
        return low * BLOCK_BITS + int(np.flatnonzero(own == one)[k])


class WaveletMatrix:
    """Succinct sequence of ``n`` unsigned integers, one plane for each bit from the highest down."""

    def __init__(self, n: int, planes: list[Plane]) -> None:
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes = []
        for bit in range(bits - 1, -1, -1):
            one = (now >> now.dtype.type(bit)).astype(np.uint8) & 1 > 0
            planes.append(Plane.build(one))
            now = np.concatenate([now[~one], now[one]])
        return cls(len(ids), planes)

    def decode(self) -> np.ndarray:
        """All ids: the partitions are undone from the last plane up."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for bit, plane in enumerate(reversed(self.planes)):
            one, zeros = plane.bits(), plane.zeros
            up = np.empty_like(now)
            up[~one] = now[:zeros]
            up[one] = now[zeros:] | now.dtype.type(1 << bit)
            now = up
        return now.astype(np.uint32)

    def access(self, i: int) -> int:
        value = 0
        for plane in self.planes:
            one, ones = plane.bit(i), plane.rank(i)
            i = plane.zeros + ones if one else i - ones
            value = value << 1 | one
        return value

    def rank(self, value: int, i: int | None = None) -> int:
        """How often ``value`` occurs before position ``i`` (default: at all)."""
        lo, hi = self._range(value, self.n if i is None else i)
        return hi - lo

    def _range(self, value: int, i: int) -> tuple[int, int]:
        if value >> len(self.planes):
            return 0, 0
        lo, hi = 0, i
        for level, plane in enumerate(self.planes):
            a, b = plane.rank(lo), plane.rank(hi)
            if value >> (len(self.planes) - 1 - level) & 1:
                lo, hi = plane.zeros + a, plane.zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``value``."""
        lo, hi = self._range(value, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(len(self.planes) - 1, -1, -1):
            one, plane = bool(value >> (len(self.planes) - 1 - level) & 1), self.planes[level]
            at = plane.select(one, at - plane.zeros if one else at)
        return at


def dump_shard(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """A shard's file: ids of consecutive documents, the length of each, and their doc_ids."""
    matrix, press = WaveletMatrix.build(ids), zstandard.ZstdCompressor(level=1).compress
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [press(x.tobytes()) for p in matrix.planes for x in (p.words, p.ones)]
    parts += [press(np.asarray(lengths, "<i8").tobytes()), press(np.array([d or 0 for d in doc_ids], "<i8").tobytes()), press(known.tobytes())]
    head = json.dumps({"n": len(ids), "planes": len(matrix.planes), "sizes": [len(p) for p in parts]}).encode()
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(parts)


def load_shard(data: bytes) -> tuple[WaveletMatrix, np.ndarray, list[int | None]]:
    """The reverse of :func:`dump_shard`: the matrix, lengths and doc_ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    size = int.from_bytes(data[8:12], "little")
    head, at, parts, unpress = json.loads(data[12 : 12 + size]), 12 + size, [], zstandard.ZstdDecompressor().decompress
    for n in head["sizes"]:
        parts.append(unpress(data[at : at + n]))
        at += n
    planes = [Plane(head["n"], np.frombuffer(parts[2 * k], "<u8"), np.frombuffer(parts[2 * k + 1], "<u4")) for k in range(head["planes"])]
    lengths, ids, known = np.frombuffer(parts[-3], "<i8"), np.frombuffer(parts[-2], "<i8").tolist(), parts[-1]
    return WaveletMatrix(head["n"], planes), lengths, [i if k else None for i, k in zip(ids, known, strict=True)]


def _write(out: str, tokenizer: str, end_id: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(out)
        store.create_dir(root, recursive=True)
        part, seq, start = TaskContext.get().partitionId(), 0, 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        doc_ids: list[int | None] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, start
            n, docs = np.concatenate(ids), len(doc_ids)
            name = f"{root}/part-{part:06d}-{seq:06d}.wvm"
            # an attempt writes under a name of its own, so that what others see is always whole
            own = f"{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as f:
                f.write(dump_shard(n, np.concatenate(lengths), doc_ids))
            store.move(own, name)
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "path": [f"{out}/{name.rpartition('/')[2]}"], "n_docs": [docs], "n_tokens": [len(n)], "local_start": [start]})
            seq, start = seq + 1, start + len(n)
            for x in (ids, lengths, doc_ids):
                x.clear()
            return row

        for batch in in_blocks(batches, max_bytes=1 << 20):
            flat, n = encoder(tokenizer).encode(batch["text"])
            ids.append(np.insert(flat, np.cumsum(n), end_id))
            lengths.append(n + 1)
            doc_ids += batch["doc_id"].to_pylist()
            if sum(map(len, ids)) >= shard_tokens:
                yield flush()
        if doc_ids:
            yield flush()

    return run


def write_shards(docs: DataFrame, out: str | None = None, end_id: int = END_ID, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` (``doc_id``, ``text``) in ascending ``doc_id`` order into shard files below ``out``.

    Returns the manifest, one row per file.  Null texts count as empty, null
    ``doc_id`` sort first, repeated rows are kept, an empty table writes no file.
    Range partitions keep the order without gathering rows anywhere: rows of one id are
    dealt by a hash of their text, and equal rows by ``SPREAD`` numbers.  A shard closes
    at the first block that brings it to ``shard_tokens``.
    """
    spark = docs.sparkSession
    out = out or shared_dir(spark, "token-shards")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).select("*", F.xxhash64("text").alias("print"), (F.monotonically_increasing_id() % SPREAD).alias("salt"))
    by = ["doc_id", "print", "salt"]
    ordered = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by)
    return materialize(ordered.select("doc_id", "text").mapInArrow(_write(out, tokenizer or default_tokenizer(), end_id, shard_tokens), _MANIFEST), "token-manifest")


def _open(path: str) -> bytes:
    store, name = pafs.FileSystem.from_uri(path)
    with store.open_input_stream(name) as f:
        return f.read()


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, global start, length and crc32 of every document, decoded from the files."""
    spark = manifest.sparkSession
    offsets, at = {}, 0
    for part, total in manifest.groupBy("part").agg(F.sum("n_tokens")).orderBy("part").collect():  # one row for each range partition
        offsets[part] = at
        at += total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix, lengths, doc_ids = load_shard(_open(row["path"]))
                raw, ends = matrix.decode().astype("<u4").tobytes(), np.cumsum(lengths)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(offsets[row["part"]] + row["local_start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(partitions(spark), "path").mapInArrow(run, _READ)


def count_tokens(manifest: DataFrame, ids: list[int]) -> DataFrame:
    """``id`` and its number of occurrences in all shards, by rank queries on the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                matrix = load_shard(_open(path))[0]
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array([matrix.rank(i) for i in ids], pa.int64())})

    return manifest.repartition(partitions(manifest.sparkSession), "path").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from its shard files."""
    return read_documents(write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet")))
