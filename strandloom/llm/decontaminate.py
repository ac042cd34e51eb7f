"""Benchmark decontamination: containment search with size-partitioned MinHash sketches.

An item is in a document if at least ``threshold`` of its distinct five-word shingles
are.  Items are partitioned by their number n of shingles, and an item's sketch is the
bottom k of a MinHash order of them, with k = n - ceil(threshold * n) + 1 for its size:
a document that holds the item must hold one of any k shingles, so no item is missed
however long the document is (signatures of fixed length would miss short items in
long documents).  Documents look their shingles up in the sketches, and what meets is
verified by exact containment, shingle by shingle.

Items are few and documents many, so tasks read the sketches from the shared folder, in
portions of bounded size; documents aren't shuffled.
"""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.resident import resident
from strandloom.llm.tokens import in_blocks
from strandloom.llm.words import Block, mix
from strandloom.sources.shared import materialize, read_bytes, shared_dir, write_bytes

SHINGLE = 5
THRESHOLD = 0.8
#: Bytes of item text in one portion; a larger benchmark takes several passes.
PORTION_BYTES = 32 << 20

#: Bytes that part words: ASCII other than letters and digits.
_PART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_FOUND = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def _lower(text: str | None) -> bytes | None:
    return None if text is None else text.lower().encode("utf-8", "surrogatepass")


class Sketches:
    """Sketches of a portion of items by size, and their shingles for verification."""

    def __init__(self, ids: list[int], texts: list[str | None], threshold: float) -> None:
        block = Block([_lower(t) for t in texts], _PART)
        runs, whole = block.runs(SHINGLE), block.whole(SHINGLE)
        by_size: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
        self.ids, self.threshold, self.shingles, self.hashes = ids, threshold, {}, {}
        for i in range(len(ids)):
            a = int(block.first[i])
            at = np.arange(a, min(a + int(block.count[i]), len(runs)))
            at = at[whole[at]]
            if len(at):
                self.hashes[i] = np.unique(runs[at])
                self.shingles[i] = {_words(block, p) for p in at.tolist()}
                by_size[len(self.shingles[i])].append((i, self.hashes[i]))
        entries: list[tuple[int, int]] = []
        for n, items in by_size.items():
            k = n - math.ceil(threshold * n - 1e-9) + 1
            for i, hashes in items:
                order = np.argsort(mix(hashes ^ np.uint64(0x5BF03635)), kind="stable")
                entries += [(int(h), i) for h in hashes[order[:k]]]
        entries.sort()
        self.key, self.item = np.array([h for h, _ in entries], np.uint64), np.array([i for _, i in entries], np.int64)

    def search(self, block: Block, rows: int) -> list[list[tuple[int, int, int]]]:
        """For each text of ``block``: (item number, its shingles, those found) of the items it contains."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
        runs, whole = block.runs(SHINGLE), block.whole(SHINGLE)
        if not len(runs) or not len(self.key):
            return out
        at = np.minimum(np.searchsorted(self.key, runs), len(self.key) - 1)
        hit = np.flatnonzero((self.key[at] == runs) & whole)
        pairs = set()
        for p in hit.tolist():
            lo, hi = np.searchsorted(self.key, runs[p]), np.searchsorted(self.key, runs[p], side="right")
            pairs.update((int(block.text[p]), i) for i in self.item[lo:hi].tolist())
        by_text: dict[int, list[int]] = defaultdict(list)
        for text, item in sorted(pairs):
            by_text[text].append(item)
        for text, items in by_text.items():
            a = int(block.first[text])
            own = np.arange(a, min(a + int(block.count[text]), len(runs)))
            own = own[whole[own]]
            wanted = np.unique(np.concatenate([self.hashes[i] for i in items]))
            near = own[np.isin(runs[own], wanted)]
            have = {_words(block, p) for p in near.tolist()}
            for i in items:
                n, shared = len(self.shingles[i]), len(self.shingles[i] & have)
                if shared >= self.threshold * n - 1e-9:
                    out[text].append((i, n, shared))
        return out


def _words(block: Block, p: int) -> bytes:
    return b" ".join(block.data[a:b] for a, b in zip(block.start[p : p + SHINGLE].tolist(), block.end[p : p + SHINGLE].tolist(), strict=True))


def portions(items: DataFrame, threshold: float = THRESHOLD, portion_bytes: int = PORTION_BYTES) -> list[str]:
    """Files in the shared folder with the sketches of all items, each of about ``portion_bytes`` of text.

    The driver holds one portion at a time, and so does a task.
    """
    items = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / portion_bytes))
    out, folder = [], shared_dir(items.sparkSession, "sketches")
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i) if n > 1 else items
        rows = part.toArrow()
        out.append(f"{folder}/portion-{i:06d}.bin")
        write_bytes(out[-1], pickle.dumps(Sketches(rows["item_id"].to_pylist(), rows["text"].to_pylist(), threshold)))
    return out


def _sketches(path: str) -> Sketches:
    return resident("table", ("sketches", path), lambda: pickle.loads(read_bytes(path)))


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """``doc_id``, ``item_id``, ``n_item``, ``n_shared``, ``containment`` for each item that a document contains.

    Words are runs of ASCII letters and digits and of all other non-ASCII signs, lower
    case.  Null or empty texts, and items of fewer than five words, match nothing;
    repeated documents and items come back once each; other columns play no part.
    """

    def matches(path: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _sketches(path)
            for batch in in_blocks(batches, max_bytes=1 << 20):
                found = own.search(Block([_lower(t) for t in batch["text"].to_pylist()], _PART), batch.num_rows)
                rows = [(r, *x) for r, hits in enumerate(found) for x in hits]
                n, shared = [x[2] for x in rows], [x[3] for x in rows]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array([x[0] for x in rows], pa.int64())), pa.array([own.ids[x[1]] for x in rows], pa.int64()), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array([s / k for s, k in zip(shared, n, strict=True)], pa.float64())],
                    names=["doc_id", "item_id", "n_item", "n_shared", "containment"],
                )

        return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FOUND)

    parts = [matches(path) for path in portions(items, threshold, portion_bytes)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """``docs`` without the rows that contain an item."""

    def keep(path: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _sketches(path)
            for batch in in_blocks(batches, max_bytes=1 << 20):
                found = own.search(Block([_lower(t) for t in batch["text"].to_pylist()], _PART), batch.num_rows)
                yield batch.filter(pa.array([not hits for hits in found]))

        return run

    *others, last = portions(items, threshold, portion_bytes)
    for path in others:
        docs = materialize(docs.mapInArrow(keep(path), docs.schema), "without-items")
    return docs.mapInArrow(keep(last), docs.schema)


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document; see :func:`find`."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The same by brute force: all shingles of all items and documents.
SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+') AS w FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 'i', item_id, -row_number() OVER (), regexp_extract_all(lower(text), '[^\x00-/:-@\[-`{-\x7f]+') FROM benchmark WHERE text IS NOT NULL),
shingles AS (
  SELECT DISTINCT kind, id, r, array_to_string(w[p:p+4], ' ') AS s
  FROM (SELECT kind, id, r, w, unnest(range(1, len(w) - 3)) AS p FROM words WHERE len(w) >= 5)),
sizes AS (SELECT r, count(*) AS n_item FROM shingles WHERE kind = 'i' GROUP BY r),
shared AS (
  SELECT d.id AS doc_id, d.r AS dr, i.id AS item_id, i.r AS ir, count(*) AS n_shared
  FROM shingles d JOIN shingles i ON d.s = i.s AND d.kind = 'd' AND i.kind = 'i' GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item::DOUBLE AS containment
FROM shared JOIN sizes ON shared.ir = sizes.r WHERE n_shared >= 0.8 * n_item - 1e-9
"""
