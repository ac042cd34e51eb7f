"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected to a few dimensions with Gaussian (2-stable) weights, so that
the squared projected distance over the squared true one follows a chi-square law.
The projections are indexed by a kd-tree in two levels: the upper one (from a bounded
sample) deals vectors to shards, the lower one divides a shard into small leaves.  A
query meets leaves by increasing projected distance, verifies by the true distance the
vectors near enough in projection, and stops as soon as a vector as near as its k-th so
far would have been met already with the stated probability (approximation factor 1;
no bound on the number verified).  The same test decides, after the query's own shard,
which other shards it must visit at all.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.sources.shared import materialize, partitions, read_bytes, shared_dir, write_bytes

K = 10
#: Even, for the closed form of the chi-square law.
DIMENSIONS = 16
#: Chance that a vector as near as the k-th found is met before the search stops.
CONFIDENCE = 0.93
SHARD_VECTORS, LEAF_VECTORS = 5000, 512
#: Vectors (an expected number) from which the upper tree is built.
SAMPLE_VECTORS = 20_000
QUERY_BLOCK = 1000
#: Pairs whose true distances are computed at once.
PAIRS = 1 << 15


def chi_square(x: float, m: int = DIMENSIONS) -> float:
    """Distribution function of the chi-square law with an even number ``m`` of degrees."""
    half = min(x / 2, 700.0)
    term = total = 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total


def stop_ratio(confidence: float, m: int = DIMENSIONS) -> float:
    """The ratio of squared projected to squared true distance that stays below with chance ``confidence``."""
    low, high = 0.0, 10.0 * m
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, m) < confidence else (low, middle)
    return high


def projection(width: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(width, DIMENSIONS))


class KdTree:
    """Leaves of nearly equal size: ``order`` lists points leaf by leaf, ``low`` and ``high`` are the leaves' boxes."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.cuts: list[tuple] = []  # (dimension, value, left, right) by node, or leaf number
        orders: list[np.ndarray] = []

        def grow(rows: np.ndarray) -> int:
            node = len(self.cuts)
            self.cuts.append(())
            own = points[rows]
            spread = np.ptp(own, axis=0) if len(rows) else np.zeros(points.shape[1])
            if len(rows) <= leaf or not spread.max() > 0:
                self.cuts[node] = (len(orders),)
                orders.append(rows)
                return node
            d = int(spread.argmax())
            value = float(np.median(own[:, d]))
            left = own[:, d] < value
            if not left.any():
                left = own[:, d] <= value
            self.cuts[node] = (d, value if (own[left, d] < value).all() else float(np.nextafter(value, np.inf)), grow(rows[left]), grow(rows[~left]))
            return node

        grow(np.arange(len(points)))
        self.order = np.concatenate(orders)
        self.bounds = np.concatenate([[0], np.cumsum([len(o) for o in orders])])
        self.low = np.array([points[o].min(axis=0) if len(o) else np.full(points.shape[1], np.inf) for o in orders])
        self.high = np.array([points[o].max(axis=0) if len(o) else np.full(points.shape[1], -np.inf) for o in orders])

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            cut = self.cuts[node]
            if len(cut) == 1:
                out[rows] = cut[0]
            else:
                left = points[rows, cut[0]] < cut[1]
                todo += [(cut[2], rows[left]), (cut[3], rows[~left])]
        return out


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances (points x boxes)."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d, None]
        out += np.maximum(np.maximum(low[None, :, d] - p, p - high[None, :, d]), 0) ** 2
    return out


def _rounding(projected: np.ndarray) -> np.ndarray:
    """What squared projected distances may differ by rounding: equal vectors count as met at distance 0."""
    return 1e-18 * (projected**2).sum(axis=1)


def _true_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs a[i], b[j], in bounded portions."""
    out = np.empty(len(i))
    for lo in range(0, len(i), PAIRS):
        own = slice(lo, lo + PAIRS)
        out[own] = ((a[i[own]] - b[j[own]]) ** 2).sum(axis=1)
    return out


def search_shard(ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, tree: KdTree, query_ids: np.ndarray, queries: np.ndarray, query_projected: np.ndarray, bound: np.ndarray, k: int, confidence: float = CONFIDENCE) -> tuple[np.ndarray, np.ndarray, int]:
    """The k nearest found in a shard for each query: vec ids (-1: none) and squared distances; and the number of verified pairs.

    Leaves come by projected distance.  A leaf's vectors are verified if their own
    projected distance passes the stopping test with the k-th distance so far, and a
    query ends at the first leaf whose box does not pass it.
    """
    n, ratio, verified, least = len(queries), stop_ratio(confidence, projected.shape[1]), 0, _rounding(query_projected)
    best_id, best = np.full((n, k), -1, np.int64), np.full((n, k), np.inf)
    far = box_distance(query_projected, tree.low, tree.high)
    order = np.argsort(far, axis=1, kind="stable")
    active = np.arange(n)
    for step in range(order.shape[1]):
        leaf = order[active, step]
        go = far[active, leaf] <= ratio * np.minimum(best[active, -1], bound[active]) + least[active]
        active, leaf = active[go], leaf[go]
        if not len(active):
            break
        for own in np.unique(leaf):  # the leaf's vectors against the queries that visit it now
            who = active[leaf == own]
            for lo in range(tree.bounds[own], tree.bounds[own + 1], LEAF_VECTORS):  # equal vectors make large leaves
                rows = tree.order[lo : min(lo + LEAF_VECTORS, tree.bounds[own + 1])]
                apart = ((query_projected[who][:, None, :] - projected[rows][None, :, :]) ** 2).sum(axis=2)
                i, j = np.nonzero((apart <= (ratio * np.minimum(best[who, -1], bound[who]) + least[who])[:, None]) & (query_ids[who][:, None] != ids[rows][None, :]))
                if not len(i):
                    continue
                verified += len(i)
                d = np.full(apart.shape, np.inf)
                d[i, j] = _true_distances(queries[who], vectors[rows], i, j)
                all_d = np.concatenate([best[who], d], axis=1)
                all_id = np.concatenate([best_id[who], np.broadcast_to(ids[rows], d.shape)], axis=1)
                top = np.lexsort((all_id, all_d), axis=1)[:, :k]
                best[who], best_id[who] = np.take_along_axis(all_d, top, axis=1), np.take_along_axis(all_id, top, axis=1)
    best_id[np.isinf(best)] = -1
    return best_id, best, verified


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``x`` (doubles) of the vectors that take part: of the most common length, finite, whole and not zero."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    fine = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))
    length = fine.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.where(F.size("x") == (length[0]["n"] if length else 0))


def _array(batch_column: pa.Array) -> np.ndarray:
    return batch_column.flatten().to_numpy().reshape(len(batch_column), -1)


def build_index(vectors: DataFrame, shard_vectors: int = SHARD_VECTORS) -> tuple[DataFrame, KdTree, np.ndarray]:
    """Shard files in the shared folder; returns their list (``shard``, ``path``, ``n``, box), the upper tree and the projection."""
    spark = vectors.sparkSession
    n = vectors.count()
    sample = vectors.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < min(1.0, SAMPLE_VECTORS / max(n, 1)) * (1 << 30)).select("x").toArrow()
    width = len(sample["x"][0]) if len(sample) else vectors.select(F.size("x")).first()[0]
    weights = projection(width)
    points = np.array(sample["x"].to_pylist()).reshape(-1, width) @ weights
    upper = KdTree(points if len(points) else np.zeros((1, DIMENSIONS)), max(1, math.ceil(max(len(points), 1) * shard_vectors / max(n, 1))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(upper.leaf_of(_array(batch["x"]) @ weights)), batch["vec_id"], batch["x"]], names=["shard", "vec_id", "x"])

    out = shared_dir(spark, "vector-shards")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(shard: int, part: int, table: pa.Table) -> pa.RecordBatch:
            ids, x = table["vec_id"].to_numpy(), _array(table["x"].combine_chunks())
            p, data, path = x @ weights, io.BytesIO(), f"{out}/shard-{shard:08d}-{part:04d}.npz"
            np.savez(data, ids=ids, x=x.astype(np.float32) if (x.astype(np.float32) == x).all() else x)
            write_bytes(path, data.getvalue())
            return pa.RecordBatch.from_pydict({"path": [path], "n": [len(ids)], "low": [p.min(axis=0).tolist()], "high": [p.max(axis=0).tolist()]})

        held: list[pa.RecordBatch] = []
        now, part, rows = None, 0, 0
        for batch in batches:
            shards = batch["shard"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and (shards[a] != now or rows >= 2 * shard_vectors):  # a shard of equal vectors is cut as well
                    yield flush(now, part, pa.Table.from_batches(held))
                    part = part + 1 if shards[a] == now else 0
                    held, rows = [], 0
                now = int(shards[a])
                held.append(batch.slice(a, b - a))
                rows += b - a
        if held:
            yield flush(now, part, pa.Table.from_batches(held))

    dealt = vectors.select("vec_id", "x").mapInArrow(deal, "shard long, vec_id long, x array<double>").repartition(partitions(spark), "shard").sortWithinPartitions("shard", "vec_id")
    listed = materialize(dealt.mapInArrow(store, "path string, n long, low array<double>, high array<double>"), "vector-index")
    return listed, upper, weights


def _write_boxes(listed: DataFrame) -> str:
    """The shards' paths and boxes (one small row each) as one file, which tasks read."""
    shards = listed.select("path", "low", "high").toArrow()
    data = io.BytesIO()
    np.savez(data, path=np.array(shards["path"].to_pylist()), low=np.array(shards["low"].to_pylist()), high=np.array(shards["high"].to_pylist()))
    path = shared_dir(listed.sparkSession, "vector-boxes") + "/boxes.npz"
    write_bytes(path, data.getvalue())
    return path


def _read_boxes(path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    stored = np.load(io.BytesIO(read_bytes(path)))
    return stored["path"].tolist(), stored["low"], stored["high"]


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K, shard_vectors: int = SHARD_VECTORS, confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance) of the k nearest candidates found.

    Both tables have ``vec_id`` and ``embedding``.  Vectors that are null, zero, not of
    the most common length, or hold null or non-finite numbers take no part, nor do
    rows without an id.  A query's own id is no candidate; a repeated query is searched
    once, a repeated candidate counts once each.  Ties go to the smaller id.
    """
    spark = candidates.sparkSession
    rows = materialize(usable(candidates), "vectors")
    asked = usable(queries).dropDuplicates(["vec_id"])
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if rows.isEmpty():
        return empty
    listed, _, weights = build_index(rows, shard_vectors)
    boxes = _write_boxes(listed)
    ratio = stop_ratio(confidence)
    asked = materialize(asked.where(F.size("x") == len(weights)), "queries")
    blocks = max(1, math.ceil(asked.count() / QUERY_BLOCK))

    def route(first: bool):
        """Rows (shard, query, bound) of the query's nearest shard, or of the others that may hold nearer vectors."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, low, high = _read_boxes(boxes)
            for batch in batches:
                for at in range(0, batch.num_rows, 100):
                    part = batch.slice(at, 100)
                    p = _array(part["x"]) @ weights
                    far = box_distance(p, low, high)
                    home = far.argmin(axis=1)
                    bound = np.full(part.num_rows, np.inf) if first else part["bound"].to_numpy()
                    own = np.arange(len(low))[None, :] == home[:, None]
                    q, s = np.nonzero(own if first else ~own & (far <= (ratio * bound + _rounding(p))[:, None]))
                    yield pa.RecordBatch.from_arrays([pa.array(s), part["vec_id"].take(pa.array(q)), part["x"].take(pa.array(q)), pa.array(bound[q])], names=["shard", "query_id", "x", "bound"])

        return run

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths = _read_boxes(boxes)[0]
        for batch in batches:
            for shard, asked_ids, asked_x, bound in zip(batch["shard"].to_pylist(), batch["ids"], batch["xs"], batch["bounds"], strict=True):
                stored = np.load(io.BytesIO(read_bytes(paths[shard])))
                ids, x = stored["ids"], stored["x"].astype(np.float64)
                p = x @ weights
                who, q = asked_ids.values.to_numpy(), _array(asked_x.values)
                best_id, best, _ = search_shard(ids, x, p, KdTree(p, LEAF_VECTORS), who, q, q @ weights, bound.values.to_numpy(), k, confidence)
                row, col = np.nonzero(best_id >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(who[row]), pa.array(best_id[row, col]), pa.array(np.sqrt(best[row, col]))], names=["query_id", "vec_id", "score"])

    def visit(routed: DataFrame, name: str) -> DataFrame:
        # a task gets at most about QUERY_BLOCK queries of one shard at once
        dealt = routed.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).repartition(partitions(spark), "shard", "block")
        grouped = dealt.groupBy("shard", "block").agg(F.collect_list(F.struct("query_id", "x", "bound")).alias("q"))
        packed = grouped.select("shard", F.col("q.query_id").alias("ids"), F.col("q.x").alias("xs"), F.col("q.bound").alias("bounds"))
        return materialize(packed.mapInArrow(search, "query_id long, vec_id long, score double"), name)

    routed = "shard long, query_id long, x array<double>, bound double"
    home = visit(asked.select("vec_id", "x").mapInArrow(route(True), routed), "home-neighbours")
    kth = home.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("far")).select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("far") ** 2).alias("bound"))
    bounded = asked.join(kth, "vec_id", "left").select("vec_id", "x", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    more = visit(bounded.mapInArrow(route(False), routed), "other-neighbours")
    ranked = home.unionByName(more).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one; see :func:`nearest`."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows.where(F.col("vec_id") % 100 == 0), rows)
