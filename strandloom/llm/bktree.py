"""BK-trees over bit fingerprints, many trees at once, and the links they find.

A node's children hang on edges labelled with their integer Hamming distance to it.
A search for what lies within a radius follows, from a node at distance d, only the
edges d - radius to d + radius.  Trees are built and searched level by level for all
shards and queries of a task together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.components import connected_components
from strandloom.sources.shared import materialize, partitions

#: Members of one shard tree.  A larger shard is cut into parts; each two parts meet in
#: one group, as tree and queries, so a group has about two times as many rows at most.
SHARD_ROWS = 1000
#: Hot shards whose list is broadcast at most; above, the list is joined by key.
BROADCAST_KEYS = 100_000


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


class BKForest:
    """One tree for each group; rows of ``prints`` (n x words, uint64) are its nodes."""

    def __init__(self, prints: np.ndarray, group: np.ndarray) -> None:
        self.prints, self.span = prints, 64 * prints.shape[1] + 1
        _, first, of = np.unique(group, return_index=True, return_inverse=True)
        self.root = dict(zip(group[first].tolist(), first.tolist(), strict=True))
        at, left = first[of], np.arange(len(prints))
        left = left[left != at]
        at = at[left] if len(left) else at[:0]
        keys, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(left):
            edge = at * self.span + hamming(prints[left], prints[at])
            key, first, of = np.unique(edge, return_index=True, return_inverse=True)
            child = left[first]
            keys.append(key)
            children.append(child)
            at = child[of]
            rest = left != at
            left, at = left[rest], at[rest]
        key, child = np.concatenate(keys), np.concatenate(children)
        order = np.argsort(key, kind="stable")
        self.key, self.child = key[order], child[order]

    def search(self, queries: np.ndarray, group: np.ndarray, radius: int, at_once: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query row, node) pairs within ``radius``, in portions."""
        roots = np.array([self.root.get(g, -1) for g in group.tolist()], np.int64)
        for lo in range(0, len(queries), at_once):
            query = np.arange(lo, min(lo + at_once, len(queries)))
            node = roots[query]
            query, node = query[node >= 0], node[node >= 0]
            while len(query):
                d = hamming(queries[query], self.prints[node])
                near = d <= radius
                if near.any():
                    yield query[near], node[near]
                a = np.searchsorted(self.key, node * self.span + np.maximum(d - radius, 0))
                b = np.searchsorted(self.key, node * self.span + np.minimum(d + radius, self.span - 1), side="right")
                n = b - a
                query = np.repeat(query, n)
                node = self.child[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(len(query))]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked rows one label (their smallest); label[i] <= i always."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low = np.minimum(x, y)
        np.minimum.at(label, np.maximum(x, y), low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def by_shard(work, block_rows: int = 20_000):
    """Rows sorted by shard -> what ``work`` makes of tables of whole shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < block_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            shard = table["shard"].to_numpy()
            cut = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
            if cut:
                yield from work(table.slice(0, cut))
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield from work(pa.Table.from_batches(held))

    return run


def _found(table: pa.Table, words: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Portions of (query row, member row) within ``radius`` in one shard."""
    prints = np.frombuffer(b"".join(table["print"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)
    shard, role = table["shard"].to_numpy(), table["role"].to_numpy()
    member, query = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    _, of, size = np.unique(shard, return_inverse=True, return_counts=True)
    member, query = member[size[of[member]] > 1], query[size[of[query]] > 1]
    if len(member) and len(query):
        forest = BKForest(prints[member], shard[member])
        for q, m in forest.search(prints[query], shard[query], radius):
            yield query[q], member[m]


def _linker(words: int, radius: int):
    """Rows sorted by shard -> a link from each row to its group's first row."""

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        label = np.arange(table.num_rows)
        for a, b in _found(table, words, radius):
            merge(label, a, b)
        moved = np.flatnonzero(label != np.arange(len(label)))
        raw = table["print"].combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array(raw.take(pa.array(at)).to_pylist(), pa.binary()) for at in (moved, label[moved])], names=["a", "b"])

    return by_shard(work)


def spanning(a: np.ndarray, b: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the edges of a smallest spanning forest of n nodes, ties by ends."""
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), d))
    label, left, chosen = np.arange(n), order, [order[:0]]
    while True:
        x, y = label[a[left]], label[b[left]]
        differ = x != y
        left, x, y = left[differ], x[differ], y[differ]
        if not len(left):
            return np.concatenate(chosen)
        best = np.full(n, len(left))
        np.minimum.at(best, x, np.arange(len(left)))
        np.minimum.at(best, y, np.arange(len(left)))
        own = left[np.unique(best[best < len(left)])]
        chosen.append(own)
        merge(label, a[own], b[own])


def _pairer(words: int, radius: int):
    """Rows sorted by shard -> pairs of nodes that connect what is near in the shard: a smallest spanning forest.

    Pairs whose sizes alone rule out a similarity of 0.8 are left out.
    """

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, size = table["node"].to_numpy(), table["size"].to_numpy()
        raw = np.frombuffer(b"".join(table["print"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)
        held, rows = [np.empty((2, 0), np.int64)], 0

        def forest(pairs: np.ndarray) -> np.ndarray:
            a, b = pairs
            return pairs[:, spanning(a, b, hamming(raw[a], raw[b]), len(node))]

        for a, b in _found(table, words, radius):
            fit = (node[a] != node[b]) & (10 * np.minimum(size[a], size[b]) >= 8 * np.maximum(size[a], size[b]))
            held.append(np.stack([a[fit], b[fit]]))
            rows += held[-1].shape[1]
            if rows > 500_000:
                held = [forest(np.concatenate(held, axis=1))]
                rows = held[0].shape[1]
        a, b = forest(np.concatenate(held, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[a], node[b])), pa.array(np.maximum(node[a], node[b]))], names=["a", "b"])

    return by_shard(work)


def _keyed(keys, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.slice(at, 4096)
                found = keys(np.frombuffer(b"".join(own["print"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, words))
                row = pa.array(np.repeat(np.arange(len(own)), found.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), *(c.take(row) for c in own.columns)], names=["key", *own.schema.names])

    return run


def _dealt(nodes: DataFrame, keys, words: int, shard_rows: int) -> DataFrame:
    """``nodes`` (``print`` and more) in their shards: ``shard``, ``role``, and the columns of ``nodes``."""
    spark = nodes.sparkSession
    schema = "key long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    hot = nodes.select("print").mapInArrow(_keyed(keys, words), "key long, print binary")
    hot = hot.groupBy("key").count().where(F.col("count") > shard_rows).select("key", F.ceil(F.col("count") / shard_rows).cast("int").alias("trees"))
    hot = materialize(hot, "hot-shards")
    n_hot = hot.count()
    keyed = nodes.mapInArrow(_keyed(keys, words), schema)
    if n_hot:
        keyed = keyed.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, "key", "left")
    else:
        keyed = keyed.withColumn("trees", F.lit(None).cast("int"))
    trees = F.coalesce("trees", F.lit(1))
    home, other = F.col("home"), F.col("other")
    rows = keyed.select("key", *nodes.columns, F.pmod(F.xxhash64("print"), trees).alias("home"), F.explode(F.sequence(F.lit(0), trees - 1)).alias("other")).select(
        F.xxhash64("key", F.least(home, other), F.greatest(home, other)).alias("shard"), F.when(home == other, 3).when(home < other, 1).otherwise(2).alias("role"), *nodes.columns
    )
    return rows.repartition(partitions(spark), "shard").sortWithinPartitions("shard", "print")


def near_components(prints: DataFrame, keys, words: int, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``node``, ``component`` of fingerprints linked within ``radius``.

    ``prints``: one column ``print`` of distinct big-endian fingerprints of ``words``
    64-bit words.  ``keys`` maps an (n x words) array to an (n x tables) array of
    shard keys; two fingerprints meet if they share a key.  In each shard, trees of
    about ``shard_rows`` members are searched by its fingerprints, part by part.  A shard's
    links come as one link to a representative per row, so a tight group of m gives m
    links, not m * m, and no connection is lost.
    """
    return connected_components(_dealt(prints, keys, words, shard_rows).mapInArrow(_linker(words, radius), "a binary, b binary"))


def near_pairs(nodes: DataFrame, keys, words: int, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct ``a`` < ``b``: pairs of nodes that connect what lies within ``radius``.

    ``nodes``: ``node`` long, ``print``, ``size`` (shingles of the set).
    """
    return _dealt(nodes, keys, words, shard_rows).mapInArrow(_pairer(words, radius), "a long, b long").distinct()
