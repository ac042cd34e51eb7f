"""Whitening of embeddings by a tall-skinny QR.

Rows are integers, so sums and the centring are exact; each task factors its centred
rows into a triangle R, triangles are merged in a tree, and the singular values and
right vectors of the last one give the components without a covariance matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.sources.shared import materialize

COMPONENTS, STEP, SHIFT = 16, 64, 1_000_000
#: Triangles that one task merges, and rows that are factored at once.
FAN_IN, BLOCK_ROWS = 8, 4096
#: Whole numbers beyond this aren't whole as doubles; a vector with such an entry takes no part.
_LARGEST = 1 << 53


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries of list values end to end, and each list's length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), sizes


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return _lists(column)[0].reshape(-1, dims)


def quantized(embeddings: DataFrame) -> DataFrame:
    """``vec_id``, ``x`` (floor(64 c) + 1000000 of each entry) of the rows that take part.

    Rows whose vector is null, empty or holds null or non-finite entries, or one whose
    number can't be told exactly, are left out; so are those not of the most common
    length (ties: the longer), which no covariance with the others exists for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch["vec_id"], batch["embedding"]
            there = np.asarray(vectors.is_valid())
            ids, vectors = ids.filter(pa.array(there)), vectors.filter(pa.array(there))
            values, sizes = _lists(vectors.cast(pa.list_(pa.float64())))
            with np.errstate(invalid="ignore", over="ignore"):
                scaled = np.floor(values.astype(np.float64) * STEP)  # a null entry is NaN here
                fine = np.abs(scaled) < _LARGEST
            begins = np.cumsum(sizes) - sizes
            bad = np.concatenate([[0], np.cumsum(~fine)])
            own = (bad[begins + sizes] == bad[begins]) & (sizes > 0)
            keep = np.repeat(own, sizes)
            x = scaled[keep].astype(np.int64) + SHIFT
            offsets = np.concatenate([[0], np.cumsum(sizes[own])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(own)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], names=["vec_id", "x"])

    kind = embeddings.schema["vec_id"].dataType.simpleString()
    rows = materialize(embeddings.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, x array<bigint>"), "quantized")
    common = rows.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "dims")).alias("m")).select("m.dims").first()["dims"]
    return rows.where(F.size("x") == (common or 0))


def _sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of every dimension: one row a dimension comes to the driver."""
    rows = 1 << 9  # 2^9 entries under 2^54 add up below 2^63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for batch in batches:
            x = _matrix(batch["x"], dims)
            n += len(x)
            for lo in range(0, len(x), rows):
                total += x[lo : lo + rows].sum(axis=0).astype(object)
        dim = np.arange(-1, dims)
        yield pa.RecordBatch.from_arrays([pa.array(dim), pa.array([str(v) for v in [n, *total]])], names=["dim", "s"])

    parts = fit.select("x").mapInArrow(run, "dim bigint, s string")
    told = {r["dim"]: int(r["s"]) for r in parts.groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return told.get(-1, 0), [told.get(i, 0) for i in range(dims)]


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as 64-bit numbers where they fit, else as Python's."""
    s = np.array(sums, object)
    most = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if 2 * most < 1 << 63:
        return x * np.int64(n) - s.astype(np.int64)
    return x.astype(object) * n - s


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_scaled(x, n, sums) / n).astype(np.float64)


def _triangle(rows: np.ndarray, dims: int) -> np.ndarray:
    """The R of a QR of ``rows``, with as many rows as columns."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((dims - len(r), dims))]) if len(r) < dims else r


def triangle(fit: DataFrame, dims: int, n: int, sums: list[int], fan_in: int = FAN_IN) -> np.ndarray:
    """The R factor of all centred rows of ``fit``: each task's own, then a tree over ``fan_in`` at a time.

    A triangle is dims x dims, so a task of the tree holds fan_in of them, however many
    rows there are, and one comes to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r = np.zeros((0, dims))
        for batch in batches:
            x = _matrix(batch["x"], dims)
            for lo in range(0, len(x), BLOCK_ROWS):
                r = _triangle(np.vstack([r, _centred(x[lo : lo + BLOCK_ROWS], n, sums)]), dims)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([r.tobytes()])], names=["node", "r"])

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(r).reshape(dims, dims) for r in rows.sort_values("node")["r"]]
        return pd.DataFrame({"node": [rows["parent"].iloc[0]], "r": [_triangle(np.vstack(parts), dims).tobytes()]})

    level = materialize(fit.select("x").mapInArrow(run, "node bigint, r binary"), "triangles")
    while level.count() > 1:
        level = materialize(level.withColumn("parent", F.expr(f"node div {fan_in}")).groupBy("parent").applyInPandas(merge, "node bigint, r binary"), "triangles")
    last = level.first()
    return np.frombuffer(last["r"]).reshape(dims, dims) if last else np.zeros((dims, dims))


def components(r: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit vectors as columns, eigenvalues, share of the trace) of the first components.

    Directions without variance (to rounding) have no whitened value and are left out.
    The largest entry of a vector is positive, so that reruns agree in sign.
    """
    _, s, vt = np.linalg.svd(r)
    e = s * s / max(n, 1)
    keep = min(most, int((s > s.max(initial=0) * max(r.shape) * np.finfo(float).eps).sum())) if n else 0
    v = vt[:keep].T
    if keep:
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(keep)] < 0, -1, 1)
    return v, e[:keep], e[:keep] / (e.sum() or 1)


def _identity_error(fit: DataFrame, dims: int, n: int, sums: list[int], axes: np.ndarray) -> float:
    """The largest entry by which the covariance of the whitened ``fit`` differs from the identity.

    The centred rows have mean zero to rounding, so the mean is taken off at the end.
    """
    c = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(c), np.zeros((c, c))
        for batch in batches:
            w = _centred(_matrix(batch["x"], dims), n, sums) @ axes
            total, products = total + w.sum(axis=0), products + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(c * c + c)), pa.array(np.concatenate([products.ravel(), total]))], names=["at", "v"])

    rows = fit.select("x").mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    told = np.zeros(c * c + c)
    told[[r["at"] for r in rows]] = [r["v"] for r in rows]
    mean = told[c * c :] / n
    return float(np.abs(told[: c * c].reshape(c, c) / n - np.outer(mean, mean) - np.eye(c)).max())


def whiten(embeddings: DataFrame, most: int = COMPONENTS, fan_in: int = FAN_IN) -> DataFrame:
    """``vec_id component n deviation whitened explained identity_error`` of every row that takes part and every component.

    See :func:`quantized` for which rows do.  The fit list is each distinct vector
    once; repeated rows and null ids come back once each.  ``deviation`` is null if it
    exceeds a long.  Without rows, or with one distinct vector only, there is no component and
    no result; there are fewer than ``most`` if the vectors have fewer dimensions with
    any variance.
    """
    spark = embeddings.sparkSession
    rows = quantized(embeddings)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit = materialize(rows.select("x").distinct(), "fit-list")
    one = fit.limit(1).collect()
    if not one:
        return spark.createDataFrame([], schema)
    dims = len(one[0]["x"])
    n, sums = _sums(fit, dims)
    v, e, share = components(triangle(fit, dims, n, sums, fan_in), n, most)
    c = len(e)
    if not c:
        return spark.createDataFrame([], schema)
    axes = v / np.sqrt(e)
    error = _identity_error(fit, dims, n, sums, axes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scaled = _scaled(_matrix(batch["x"], dims), n, sums)
            if scaled.dtype == object or int(np.abs(scaled).max(initial=0)) ** 2 * dims >= 1 << 63:
                exact = [int(d) if d < 1 << 63 else None for d in (scaled.astype(object) ** 2).sum(axis=1)]
            else:
                exact = (scaled * scaled).sum(axis=1).tolist()
            w = (scaled / n).astype(np.float64) @ axes
            k = len(w)
            at = np.repeat(np.arange(k), c)
            columns = [batch["vec_id"].take(pa.array(at)), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), k)), pa.array(np.full(k * c, n)), pa.array(exact, pa.int64()).take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(share, k)), pa.array(np.full(k * c, error))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """The whitened ``embeddings``; see :func:`whiten`."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
