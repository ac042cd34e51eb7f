"""Pairwise distances between samples, clusters and trees.

Sums over the keys that two samples share are products of 0/1 matrices, added up where
the keys lie; keys are never joined with themselves.  Constant keys (in every sample
with one code) match in all pairs, so they are only counted.  Two samples' mismatches
are their key counts less twice their shared keys.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.bases import UNKNOWN
from strandloom.operators import blocks as packed
from strandloom.operators.components import connected_components
from strandloom.operators.filters import key_stats, least_count
from strandloom.operators.index import Index
from strandloom.operators.samples import row_of, with_number
from strandloom.sources.shared import materialize

#: Samples in a tile of a task's matrices, and keys in one product.
TILE, BLOCK_KEYS = 1024, 4096
#: Cells at once of the matrices of plain keys, which stay in a core's cache, and of those of others.
PLAIN_CELLS, VAGUE_CELLS = 1 << 17, 1 << 18
#: The base of a plain mask, -1 of an ambiguous one.
_BASE = np.array([{1: 0, 2: 1, 4: 2, 8: 3}.get(m, -1) for m in range(16)])
_CONSTANT = "n_present = {n} and n_codes = 1"


def _pairs(index: Index, inner: DataFrame) -> DataFrame:
    """All pairs of samples in order, joined with sums over their shared keys."""
    order = _numbered(index)
    grid = order.select(F.col("i").alias("i1"), F.col("sample").alias("sample1")).join(order.select(F.col("i").alias("i2"), F.col("sample").alias("sample2")), F.col("i1") < F.col("i2"))
    return grid.join(inner, ["i1", "i2"], "left")


def _products(index: Index, keys: DataFrame | None, kind: str, least: int = 0, constants: bool = True) -> DataFrame:
    """``i1 <= i2``, ``shared``, ``matched``, ``differ`` of all pairs of samples that share a key.

    ``keys``: one row a key, with the list ``cells`` of its samples' numbers and masks; without it
    the index's blocks are read, less keys in fewer than ``least`` samples and, unless they are
    ``constants``, those in all with one code, whose number is ``shared`` of the pair (-1, -1).
    A task makes 0/1 matrices (keys x samples) of its keys and adds up their products, so
    that only sums for pairs of samples are shuffled.  Samples are dealt in tiles, which
    bounds the matrices at any number of samples.  ``kind``: ``plain`` (matched: both
    plain; differ: plain and unequal), ``chance`` (matched: codes that overlap; differ:
    less the chance of equal bases), ``code`` (differ: unequal codes).
    """
    n_samples = index.n_samples
    tiles = -(-n_samples // TILE)
    pairs = [(a, b) for a in range(tiles) for b in range(a, tiles)]
    chance = np.array([[bin(a & b).count("1") / max(bin(a).count("1") * bin(b).count("1"), 1) for b in range(16)] for a in range(16)])
    chance[UNKNOWN] = chance[:, UNKNOWN] = 0
    plain, number = [1, 2, 4, 8], np.float64 if kind == "chance" else np.float32  # sums of ones are exact in both

    def add_up(key: np.ndarray, i: np.ndarray, mask: np.ndarray, n: int, low: int, high: int) -> list[np.ndarray]:
        """The three sums of samples from ``low`` on against those from ``high`` on."""

        def hot(begin: int, value: np.ndarray) -> np.ndarray:
            own = (i >= begin) & (i < begin + TILE)
            out = np.zeros((n, min(TILE, n_samples - begin)), number)
            out[key[own], i[own] - begin] = value[own]
            return out

        def product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            return (hot(low, left).T @ hot(high, right)).astype(np.float64)

        shared = product(np.ones(len(mask)), np.ones(len(mask)))
        if kind == "chance":
            seen = [m for m in range(1, 16) if (mask == m).any()]
            same = sum(product(mask == m, chance[m, mask]) for m in seen)
            return [shared, sum(product(mask == m, chance[m, mask] > 0) for m in seen), shared - same]
        codes = plain if kind == "plain" else range(1, 16)
        single = np.isin(mask, plain)
        matched = product(single, single) if kind == "plain" else shared
        return [shared, matched, matched - sum(product(mask == m, mask == m) for m in codes if (mask == m).any())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}

        def told(pair: int) -> pa.RecordBatch:
            low, high = (TILE * t for t in pairs[pair])
            shared, matched, differ = sums.pop(pair)
            at = np.nonzero((shared > 0) & (np.arange(len(shared))[:, None] + low <= np.arange(shared.shape[1]) + high))
            return pa.RecordBatch.from_arrays(
                [pa.array((at[0] + low).astype(np.int32)), pa.array((at[1] + high).astype(np.int32)), pa.array(shared[at].astype(np.int64)), pa.array(matched[at].astype(np.int64)), pa.array(differ[at])],
                names=["i1", "i2", "shared", "matched", "differ"],
            )

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_KEYS):
                part = batch.slice(lo, BLOCK_KEYS)
                pair, cells = part["pair"].to_numpy(), part["cells"]
                key = np.repeat(np.arange(part.num_rows), pc.list_value_length(cells).to_numpy())
                flat = cells.flatten()
                i, mask = flat.field("i").to_numpy(), flat.field("mask").to_numpy().astype(np.int64)
                for own in np.unique(pair).tolist():
                    for done in [p for p in sums if p != own]:
                        yield told(done)
                    at = pair[key] == own
                    more = add_up(key[at], i[at], mask[at], part.num_rows, *(TILE * t for t in pairs[own]))
                    sums[own] = [a + b for a, b in zip(sums[own], more, strict=True)] if own in sums else more
        for own in list(sums):
            yield told(own)

    def add_plain(keys: packed.Keys) -> list[np.ndarray]:
        """:func:`add_up` of keys without an ambiguous code, where codes that overlap are equal: a matrix a base, each times itself."""
        hot = np.zeros((4, len(keys.hi), n_samples), np.float32)
        hot[_BASE[keys.mask], keys.key, keys.no] = 1
        every = hot[0] + hot[1] + hot[2] + hot[3]
        shared, equal = (every.T @ every).astype(np.float64), sum((x.T @ x).astype(np.float64) for x in hot)
        return [shared, equal if kind == "chance" else shared, shared - equal]

    def add_vague(held: list[packed.Keys]) -> list[np.ndarray]:
        """:func:`add_up` of any keys, all samples against themselves.

        The chance of equal bases is a sum over bases of products of shares; codes overlap by inclusion and exclusion of sets of bases.
        """
        n = np.array([len(k.hi) for k in held])
        key = np.concatenate([k.key + at for k, at in zip(held, (np.cumsum(n) - n).tolist(), strict=True)])
        no, mask = (np.concatenate([getattr(k, c) for k in held]).astype(np.int64) for c in ("no", "mask"))

        def times(own: np.ndarray, value: np.ndarray | int = 1, kind: type = np.float32) -> np.ndarray:
            hot = np.zeros((int(n.sum()), n_samples), kind)
            hot[key[own], no[own]] = value if np.isscalar(value) else value[own]
            return (hot.T @ hot).astype(np.float64)

        shared = times(mask > 0)
        if kind == "chance":
            known, share = mask != UNKNOWN, 1 / np.maximum(np.bitwise_count(mask), 1)
            same = sum(times(known & (mask & m > 0), share, np.float64) for m in plain)
            overlapping = np.zeros_like(shared)
            for m in range(1, UNKNOWN):
                own = known & (mask & m == m)
                if own.any():
                    overlapping += times(own) * (1 if m.bit_count() % 2 else -1)
            return [shared, overlapping, shared - same]
        codes = plain if kind == "plain" else range(1, 16)
        matched = times(np.isin(mask, plain)) if kind == "plain" else shared
        return [shared, matched, matched - sum(times(mask == m) for m in codes)]

    def run_blocks(groups: Iterator[packed.Keys]) -> Iterator[pa.RecordBatch]:
        alone, constant, sums, held = np.zeros(n_samples, np.int64), 0, [np.zeros((n_samples, n_samples)) for _ in range(3)], []
        few, step = (max(1, cells // max(n_samples, 1)) for cells in (PLAIN_CELLS // 4, VAGUE_CELLS))

        def add(more: list[np.ndarray]) -> None:
            for x, y in zip(sums, more, strict=True):
                x += y

        for every in groups:
            keys = packed.named(every)
            if not len(keys.hi):
                continue
            present = np.bincount(keys.key)
            kept = present >= least
            if not constants:
                same = kept & (present == n_samples) & (np.bitwise_count(np.bitwise_or.reduceat(np.left_shift(1, keys.mask), keys.starts)) == 1)
                constant, kept = constant + int(same.sum()), kept & ~same
            single = kept & (present == 1)  # a key of one sample is in no pair
            alone += np.bincount(keys.no[single[keys.key]], minlength=n_samples)
            vague = np.zeros(len(keys.hi), bool)
            vague[keys.key[_BASE[keys.mask] < 0]] = True
            kept &= present > 1
            some, rest = keys.keys(kept & ~vague), keys.keys(kept & vague)
            for a in range(0, len(some.hi), few):
                add(add_plain(some.part(a, a + few)))
            for a in range(0, len(rest.hi), step):
                held.append(rest.part(a, a + step))
                if sum(len(k.hi) for k in held) >= step:
                    add(add_vague(held))
                    held.clear()
        if held:
            add(add_vague(held))
        shared, matched, differ = sums
        shared = shared + np.diag(alone)
        at = np.nonzero(np.triu(shared > 0))
        told = [np.append(x[at], y) for x, y in ((shared, constant), (matched, 0), (differ, 0))]
        yield pa.RecordBatch.from_arrays([*(pa.array(np.append(i, -1).astype(np.int32)) for i in at), pa.array(told[0].astype(np.int64)), pa.array(told[1].astype(np.int64)), pa.array(told[2].astype(np.float64))], names=["i1", "i2", "shared", "matched", "differ"])

    if keys is None:
        found = index.blocks.map(run_blocks, "i1 int, i2 int, shared long, matched long, differ double", index.names)
        return found.groupBy("i1", "i2").agg(*[F.sum(c).alias(c) for c in ("shared", "matched", "differ")])
    rows = keys.select(F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("pair"), "cells")
    if tiles > 1:
        tile = F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in pairs])
        rows = rows.select("pair", F.filter("cells", lambda c: F.array_contains(F.element_at(tile, F.col("pair") + 1), F.floor(c["i"] / TILE).cast("int"))).alias("cells")).sortWithinPartitions("pair")
    found = rows.mapInArrow(run, "i1 int, i2 int, shared long, matched long, differ double")
    return found.groupBy("i1", "i2").agg(*[F.sum(c).alias(c) for c in ("shared", "matched", "differ")])


def _numbered(index: Index) -> DataFrame:
    """``i`` and ``sample`` of every sample in order."""
    return index.kmers.sparkSession.createDataFrame([(i, n) for i, n in enumerate(index.names)], "i int, sample string")


def _keys(index: Index) -> DataFrame:
    """Every key with its statistics and ``cells`` (a list of at most one entry a sample)."""
    return key_stats(index.with_kmers(with_number(index.kmers, index.names, "i")), F.collect_list(F.struct("i", "mask")).alias("cells"))


def distances(index: Index, allow_ambiguous: bool = False, min_freq: float = 0.0) -> DataFrame:
    """``sample1 sample2 distance mismatches match_count mismatch_count`` of all pairs.

    Keys in one of the samples only are mismatches.  Shared keys with plain bases are
    matches, and count 1 to the distance if the bases differ.  ``allow_ambiguous``:
    a shared key adds 1 less the chance of equal bases, and matches if there is any.
    ``mismatches`` is the share of mismatches (0 if there is neither).  Keys in fewer
    than ``min_freq`` of the samples are left out.
    """
    n = index.n_samples
    least = least_count(index, min_freq) if min_freq * n >= 1 else 0
    kind = "chance" if allow_ambiguous else "plain"
    if index.blocks is not None and n <= TILE:
        sums = materialize(_products(index, None, kind, least, constants=False), "pair-sums")
        constant = sums.where("i1 < 0").agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("constant"))
    else:
        constant = key_stats(index).where((F.col("n_present") >= least) & F.expr(_CONSTANT.format(n=n))).agg(F.count("*").alias("constant"))
        varying = _keys(index).where((F.col("n_present") >= least) & ~F.expr(_CONSTANT.format(n=n)))
        sums = materialize(_products(index, varying, kind), "pair-sums")
    each = sums.where("i1 = i2").select(F.col("i1").alias("i"), F.col("shared").alias("n"))
    inner = sums.withColumnRenamed("matched", "m").withColumnRenamed("differ", "d")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = _pairs(index, inner).join(each.toDF("i1", "n1"), "i1", "left").join(each.toDF("i2", "n2"), "i2", "left").join(F.broadcast(constant))
    rows = rows.withColumn("match_count", (zero("constant") + zero("m")).cast("long")).withColumn("mismatch_count", (zero("n1") + zero("n2") - 2 * zero("shared")).cast("long"))
    total = F.col("match_count") + F.col("mismatch_count")
    return rows.select("sample1", "sample2", F.coalesce("d", F.lit(0.0)).alias("distance"), F.when(total > 0, F.col("mismatch_count") / total).otherwise(0.0).alias("mismatches"), "match_count", "mismatch_count")


def distance_lines(found: DataFrame) -> DataFrame:
    """``sample1``, ``sample2`` and the printed ``line``: tab separated, 2 and 5 decimals."""
    return found.select("sample1", "sample2", F.format_string("%s\t%s\t%.2f\t%.5f\t%d\t%d", "sample1", "sample2", "distance", "mismatches", "match_count", "mismatch_count").alias("line"))


DISTANCE_HEADER = "Sample1\tSample2\tDistance\tMismatches (proportion)\tMatch count\tMismatch count"


def snp_matrix(index: Index) -> DataFrame:
    """``sample1``, ``sample2``, ``snps``: shared keys with different codes, for all ordered pairs and the diagonal."""
    inner = _products(index, None if index.blocks is not None and index.n_samples <= TILE else _keys(index), "code").select("i1", "i2", F.col("differ").cast("long").alias("snps"))
    upper = _pairs(index, inner).select("sample1", "sample2", F.coalesce("snps", F.lit(0)).alias("snps"))
    same = index.kmers.sparkSession.createDataFrame([(s, s, 0) for s in index.names], "sample1 string, sample2 string, snps long")
    return upper.unionByName(upper.select(F.col("sample2").alias("sample1"), F.col("sample1").alias("sample2"), "snps")).unionByName(same)


def single_linkage(found: DataFrame, names: tuple[str, ...], max_snps: float = 10, max_mismatches: float = 1.0) -> DataFrame:
    """``sample``, ``cluster`` (its first sample), ``size``: components of the pairs within both limits."""
    spark = found.sparkSession
    links = found.where((F.col("distance") <= max_snps) & (F.col("mismatches") <= max_mismatches)).select("sample1", "sample2")
    linked = connected_components(links)
    all_names = spark.createDataFrame([(n,) for n in names], "sample string")
    rows = all_names.join(linked.withColumnRenamed("node", "sample"), "sample", "left").select("sample", F.coalesce("component", "sample").alias("cluster"))
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"))
    return rows.join(sizes, "cluster").select("sample", "cluster", "size")


def phylip(found: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``sample`` and ``row``: the sample's distances to all samples in order, tab separated with 6 decimals."""
    both = found.select("sample1", "sample2", "distance").unionByName(found.select(F.col("sample2").alias("sample1"), F.col("sample1").alias("sample2"), "distance"))
    both = both.unionByName(found.sparkSession.createDataFrame([(n, n, 0.0) for n in names], "sample1 string, sample2 string, distance double"))
    wide = with_number(both.withColumnRenamed("sample2", "sample"), names).groupBy("sample1").agg(F.array_sort(F.collect_list(F.struct("no", "distance"))).alias("d"))
    cells = row_of(F.col("d"), lambda e: F.format_string("%.6f", e["distance"]), len(names), F.lit("null"))
    return wide.select(F.col("sample1").alias("sample"), F.array_join(cells, "\t").alias("row"))


def joined_edges(matrix: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges (node, node, length) of the neighbour-joining tree; leaves are numbered first.

    Ties go to the pair first in order; negative branches are 0.
    """
    d = np.array(matrix, float)
    node, edges, new = list(range(len(d))), [], len(d)
    while len(node) > 3:
        n, total = len(node), d.sum(axis=1)
        q = (n - 2) * d - total[:, None] - total[None, :]
        np.fill_diagonal(q, math.inf)
        i, j = divmod(int(q.argmin()), n)
        left = d[i, j] / 2 + (total[i] - total[j]) / (2 * (n - 2))
        edges += [(new, node[i], max(left, 0.0)), (new, node[j], max(d[i, j] - left, 0.0))]
        apart = (d[i] + d[j] - d[i, j]) / 2
        keep = [x for x in range(n) if x not in (i, j)]
        node, new = [node[x] for x in keep] + [new], new + 1
        d = np.block([[d[np.ix_(keep, keep)], apart[keep][:, None]], [apart[keep][None, :], np.zeros((1, 1))]])
    if len(node) == 2:
        return [*edges, (node[0], node[1], max(d[0, 1], 0.0))]
    for own, (x, y) in enumerate([(1, 2), (0, 2), (0, 1)][: len(node) if len(node) == 3 else 0]):
        edges.append((new, node[own], max((d[own, x] + d[own, y] - d[x, y]) / 2, 0.0)))
    return edges


def newick(edges: list[tuple[int, int, float]], names: list[str], rooted: bool = False) -> str:
    """The tree in Newick form: at its last joint, or ``rooted`` in the middle of its longest path.

    Of equally long paths the first in the order of leaves counts.
    """
    label, near = [n.replace(" ", "_") for n in names], {}
    for a, b, length in edges:
        near.setdefault(a, []).append((b, length))
        near.setdefault(b, []).append((a, length))
    if not edges:
        return f"({label[0]});" if label else "();"

    def from_(leaf: int) -> dict[int, tuple[float, int]]:
        """Distance of every node, and the node before it."""
        seen, todo = {leaf: (0.0, -1)}, [leaf]
        for at in todo:  # grows while it is read
            for to, length in near[at]:
                if to not in seen:
                    seen[to] = (seen[at][0] + length, at)
                    todo.append(to)
        return seen

    def told(at: int, before: int) -> str:
        parts = [f"{told(to, at)}:{length:.6f}" for to, length in near[at] if to != before]
        return f"({','.join(parts)})" if at >= len(label) else label[at]

    if len(label) == 2 and not rooted:
        return f"({label[0]}:{edges[0][2] / 2:.6f},{label[1]}:{edges[0][2] / 2:.6f});"
    if not rooted:
        return told(max(near), -1) + ";"
    far, first, last = max(((from_(a)[b][0], -a, -b) for a in range(len(label)) for b in range(a + 1, len(label))))
    seen, at = from_(-first), -last
    while seen[at][1] >= 0 and seen[seen[at][1]][0] > far / 2:
        at = seen[at][1]
    before = seen[at][1]
    up = seen[at][0] - far / 2
    down = far / 2 - seen[before][0]
    return f"({told(before, at)}:{down:.6f},{told(at, before)}:{up:.6f});"


def neighbour_joining(matrix: np.ndarray, names: list[str], rooted: bool = False) -> str:
    """A Newick tree of a distance matrix by neighbour joining.  Small by nature: one leaf a sample."""
    return newick(joined_edges(matrix) if len(names) > 1 else [], list(names), rooted)


def tree(found: DataFrame, names: tuple[str, ...], value: str = "distance", rooted: bool = False, shown: tuple[str, ...] | None = None) -> str:
    """The neighbour-joining tree of all pairs (one number for each pair of samples comes to the driver), its leaves named ``shown`` or else ``names``."""
    at = {n: i for i, n in enumerate(names)}
    matrix = np.zeros((len(names), len(names)))
    for a, b, v in found.select("sample1", "sample2", value).collect():
        matrix[at[a], at[b]] = matrix[at[b], at[a]] = v
    return neighbour_joining(matrix, list(shown or names), rooted)
