"""SimHash near-duplicates, found with BK-trees.

A shard key is a part of the fingerprint, so that only fingerprints which can be
near each other share a tree (a broadcast of every tree to every task would compare
all shards with all queries):

* ``pigeonhole``: for a radius r the bits are cut into r + 2 blocks; two
  fingerprints that differ in at most r bits agree on two whole blocks.  Exact.
* ``sampled``: for larger radii, tables of randomly chosen bits, as many as reach the
  stated recall within the radius.  What they bring together is only a candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.bktree import by_shard, merge, near_components, near_pairs
from strandloom.llm.resident import release
from strandloom.operators.components import connected_components
from strandloom.sources.shared import materialize, partitions

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def majority(digests: np.ndarray) -> bytes:
    """The bits that are set in more than half of the rows of an (n x bytes) array."""
    n, width = digests.shape
    counts = np.bincount((digests + (np.arange(width) << 8)).ravel(), minlength=width << 8).reshape(width, 256)
    return np.packbits(2 * (counts @ _BITS) > n).tobytes()


def shingles(text: bytes, size: int) -> list[bytes]:
    """Runs of ``size`` words joined by a space; a shorter text is one shingle; no words, none."""
    words = text.split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.diff(ends, prepend=0)).tolist()
    return [line[a:b] for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=False)]


def fingerprint64(text: bytes | None, size: int = 3, seed: int = 42) -> bytes:
    """64 bits over all shingles with repeats, XXH64, big-endian; zero without words."""
    found = shingles((text or b"").lower(), size)
    if not found:
        return bytes(8)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(s, seed) for s in found], ">u8").view(np.uint8).reshape(-1, 8))


def pigeonhole(radius: int, bits: int = 64):
    """Shard keys for 64-bit fingerprints: any two of radius + 2 blocks of nearly equal width.

    Two fingerprints within the radius agree on two blocks at least.  Two blocks make
    a long key (32 bits for a radius of 2), so that shards stay small at any number of
    fingerprints that one block would crowd.
    """
    cuts = [bits * i // (radius + 2) for i in range(radius + 3)]

    def keys(prints: np.ndarray) -> np.ndarray:
        block = [(prints[:, 0] >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
        pairs = combinations(range(radius + 2), 2)
        width = max(b - a for a, b in zip(cuts, cuts[1:], strict=False))
        out = [((block[a] << np.uint64(width)) | block[b]).astype(np.int64) | (i << 2 * width) for i, (a, b) in enumerate(pairs)]
        return np.stack(out, axis=1)

    return keys


def sampled(bits: int, tables: int, words: int, seed: int = 7):
    """Shard keys of ``tables`` tables of ``bits`` chosen bits each."""
    rng = np.random.default_rng(seed)
    chosen = [rng.choice(64 * words, bits, replace=False) for _ in range(tables)]

    def keys(prints: np.ndarray) -> np.ndarray:
        out = np.empty((len(prints), tables), np.int64)
        for t, own in enumerate(chosen):
            key = np.full(len(prints), t << 40, np.int64)
            for i, bit in enumerate(own):
                key |= ((prints[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(np.int64) << i
            out[:, t] = key
        return out

    return keys


def _prints(make):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([make(t.as_py()) for t in part["text"]], pa.binary())], names=["doc_id", "print"])

    return run


def components(docs: DataFrame, make, keys, words: int, radius: int) -> DataFrame:
    """``doc_id``, ``print``, ``component_id`` (smallest doc_id of the component) of each row of ``docs``.

    Null texts count as empty; texts without words all have fingerprint zero; repeated rows come
    back once each; other columns of ``docs`` play no part; an empty table gives none.
    """
    own = materialize(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_prints(make), "doc_id long, print binary"), "fingerprints")
    least = materialize(own.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "distinct-fingerprints")
    linked = materialize(near_components(least.select("print"), keys, words, radius), "components")
    named = least.join(linked.withColumnRenamed("node", "print"), "print", "left").withColumn("component", F.coalesce("component", "print"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    labels = materialize(named.join(smallest, "component").select("print", "component_id"), "labels")
    return own.join(labels, "print").select("doc_id", "print", "component_id")


#: Bits in which fingerprints of candidates for a similarity of 0.8 may differ.
STAGE_RADIUS = 32
#: Nodes and shingles in a part of a cluster, and shingles in one matrix product.
PART_NODES, PART_SHINGLES, SHINGLE_COLUMNS = 250, 250_000, 4096


def recall_at(similarity: float, bits: int, tables: int, radius: int = STAGE_RADIUS) -> float:
    """The chance that 128-bit fingerprints of two texts are within ``radius`` and share a table; bits differ by the angle of the sets."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    chance = lambda d: math.comb(128, d) * p**d * (1 - p) ** (128 - d)
    return sum(chance(d) * (1 - (1 - math.comb(128 - d, bits) / math.comb(128, bits)) ** tables) for d in range(radius + 1))


def stage_tables(n: int, wanted: tuple = ((0.8, 0.95), (0.9, 0.999))) -> tuple[int, int]:
    """(bits, tables) for n fingerprints: the fewest tables with the wanted recall at each similarity, radius counted."""
    bits, tables = max(16, math.ceil(math.log2(max(n, 1) / 16))), 1
    while any(recall_at(similarity, bits, tables) < recall for similarity, recall in wanted):
        tables += 1
    return bits, tables


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key and a fingerprint of each text's distinct five-word shingles, and their number."""
    release()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            keys, prints, sizes = [], [], []
            for text in part["text"]:
                found = sorted(map(xxhash.xxh3_128_digest, set(shingles((text.as_py() or b"").lower(), 5))))
                line = b"".join(found)
                keys.append(xxhash.xxh3_128_digest(line))
                prints.append(majority(np.frombuffer(line, np.uint8).reshape(-1, 16)) if found else bytes(16))
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["row"], pa.array(keys, pa.binary()), pa.array(prints, pa.binary()), pa.array(sizes, pa.int32())], names=["doc_id", "row", "set", "print", "size"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct five-word shingles of each text, as 64-bit hashes."""
    release()
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            own = [np.fromiter(map(digest, set(shingles((t.as_py() or b"").lower(), 5))), np.uint64).view(np.int64) for t in part["text"]]
            yield pa.RecordBatch.from_arrays([part["node"], pa.array(own, pa.list_(pa.int64()))], names=["node", "hashes"])


def _verify(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows (``shard``, ``node``, ``hashes``) of whole groups -> a link from each node to the first one of its verified component.

    The shingles that two texts of a group share are counted by products of 0/1
    matrices, a bounded number of shingles at a time.
    """
    table = table.combine_chunks()
    shard, node, lists = table["shard"].to_numpy(), table["node"].to_numpy(), table["hashes"].combine_chunks()
    sizes, flat = pc.list_value_length(lists).to_numpy().astype(np.int64), lists.flatten().to_numpy()
    ends, begin = np.concatenate([[0], np.cumsum(sizes)]), [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist()]
    from_, to = [node[:0]], [node[:0]]
    for i, j in zip(begin, [*begin[1:], len(shard)], strict=True):
        n = j - i
        own, row = flat[ends[i] : ends[j]], np.repeat(np.arange(n), sizes[i:j])
        _, number, times = np.unique(own, return_inverse=True, return_counts=True)
        common = times[number] > 1
        column = (np.cumsum(times > 1) - 1)[number[common]]
        order = np.argsort(column, kind="stable")
        row, column = row[common][order], column[order]
        shared = np.zeros((n, n), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, SHINGLE_COLUMNS):
            part = slice(*np.searchsorted(column, [low, low + SHINGLE_COLUMNS]))
            hot = np.zeros((n, min(SHINGLE_COLUMNS, int(column[-1]) + 1 - low)), np.float32)
            hot[row[part], column[part] - low] = 1
            shared += hot @ hot.T
        a, b = np.nonzero(np.triu(9 * shared >= 4 * (sizes[i:j, None] + sizes[None, i:j]), 1))
        label = np.arange(n)
        merge(label, a, b)
        moved = np.flatnonzero(label != np.arange(n))
        from_.append(node[i + moved])
        to.append(node[i + label[moved]])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(from_)), pa.array(np.concatenate(to))], names=["a", "b"])


def _linked(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``component`` of the nodes with a verified link.

    Candidate pairs (a smallest spanning forest of every shard, which keeps all that
    is connected together) make clusters; in a cluster every two texts are compared.
    A large cluster is cut into parts, each two of which meet in one bounded group, so
    the rows are nodes with their shingles, never pairs.
    """
    keys = sampled(*stage_tables(nodes.count()), 2)
    pairs = materialize(near_pairs(nodes.where("size > 0").select("node", "print", "size"), keys, 2, STAGE_RADIUS), "candidates")
    cluster = materialize(connected_components(pairs), "clusters")
    members = nodes.join(cluster, "node").select("node", "size", "component", F.col("first.doc_id").alias("__id"), F.col("first.row").alias("__row"))
    members = materialize(members, "members")
    texts = rows.join(members.select("node", "__id", "__row").hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("row").eqNullSafe(F.col("__row"))).select("node", "text")
    sets = materialize(texts.mapInArrow(_hashes, "node long, hashes array<long>").groupBy("node").agg(F.first("hashes").alias("hashes")), "shingles")
    parts = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / PART_NODES), F.ceil(F.sum("size") / PART_SHINGLES)).cast("int").alias("parts"))
    home, other = F.col("home"), F.col("other")
    dealt = members.join(parts, "component").select("node", "component", F.pmod(F.xxhash64("node"), F.col("parts")).alias("home"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    groups = dealt.select("node", F.xxhash64("component", F.least(home, other), F.greatest(home, other)).alias("shard")).join(sets, "node").select("shard", "node", "hashes")
    groups = groups.repartition(partitions(rows.sparkSession), "shard").sortWithinPartitions("shard", "node")
    return connected_components(groups.mapInArrow(by_shard(_verify, 2000), "a long, b long"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each group the row with the smallest doc_id stays.

    Texts are near if the Jaccard similarity of their distinct five-word shingles (lower
    case) is 0.8 or more; groups are the components of such links.  Candidates come from
    128-bit fingerprints, each is verified.  Rows are told apart by doc_id and text, so
    null and repeated ids of different texts are judged one by one; a row with a null
    doc_id stays only if its group has no other, and of rows of one doc_id and text one
    stays.
    """
    row = F.md5(F.col("text").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), F.col("text").cast("binary").alias("text"))
    own = materialize(rows.mapInArrow(_sets, "doc_id long, row string, set binary, print binary, size int"), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    nodes = own.groupBy("set").agg(F.min("print").alias("print"), F.min("size").alias("size"), F.min(place).alias("first"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "print", "size", "first"), "distinct-sets")
    named = nodes.join(_linked(rows, nodes), "node", "left").withColumn("component", F.coalesce("component", "node"))
    keep = materialize(named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.row").alias("__row")), "kept")
    repeated = own.groupBy("doc_id", "row").count().where("count > 1").limit(1).count() > 0
    # the list grows with the documents, so it is joined by row at every size
    left = docs.withColumn("__text", row).join(keep.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__text").eqNullSafe(F.col("__row")), "left_semi")
    return (left.dropDuplicates(["doc_id", "__text"]) if repeated else left).drop("__text")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component; see :func:`components`."""
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"), fingerprint64, pigeonhole(2), 1, 2)
    return found.select("doc_id", F.lower(F.hex("print")).alias("fingerprint"), "component_id")
