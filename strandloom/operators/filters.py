"""Filters on the merged index, and alignments of what passes."""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.bases import UNKNOWN, key_digits, mask_code
from strandloom.operators import blocks as packed
from strandloom.operators.index import KEY, Index
from strandloom.operators.samples import row_of, with_number
from strandloom.sources.shared import materialize, partitions

NO_FILTER, NO_CONST, NO_AMBIG, NO_AMBIG_OR_CONST = "no-filter", "no-const", "no-ambig", "no-ambig-or-const"


def key_stats(index: Index, *more: Column) -> DataFrame:
    """For each key: rows, unambiguous rows, distinct codes and distinct plain bases (and ``more``).

    Sets of codes are bit sets in one aggregation, so nothing is expanded for the
    distinct counts.
    """
    plain = F.bit_count(F.col("mask").cast("int")) == 1
    bit = F.expr("shiftleft(1, mask)")
    return index.kmers.groupBy(*KEY).agg(
        F.count("*").alias("n_present"), F.count(F.when(plain, 1)).alias("n_plain"),
        F.bit_count(F.bit_or(bit)).alias("n_codes"), F.bit_count(F.coalesce(F.bit_or(F.when(plain, bit)), F.lit(0))).alias("n_bases"), *more,
    )


def least_count(index: Index, min_freq: float, down: bool = False) -> int:
    if not 0 <= min_freq <= 1:
        raise ValueError("a frequency lies in [0, 1]")
    return (math.floor if down else math.ceil)(index.n_samples * min_freq)


def passes(kind: str, n_samples: int, least: int, ambig_missing: bool = False, ignore_const_gaps: bool = False) -> Column:
    """Whether a key with these statistics stays."""
    gap = F.when(F.col("n_present") < n_samples, 0 if ignore_const_gaps else 1).otherwise(0)
    tests = {NO_FILTER: F.lit(True), NO_CONST: F.col("n_codes") + gap > 1, NO_AMBIG: F.col("n_present") == F.col("n_plain"), NO_AMBIG_OR_CONST: F.col("n_bases") + gap > 1}
    if kind not in tests:
        raise ValueError(f"a filter is one of {sorted(tests)}")
    count = F.col("n_plain" if ambig_missing else "n_present")
    return tests[kind] & (count >= max(least, 1 if ambig_missing else 0))


def _step(kind: str, n_samples: int, least: int, ambig_missing: bool, ignore_const_gaps: bool, ambig_mask: bool):
    """:func:`passes`, and the mask of ambiguous bases, over whole keys in blocks."""

    def step(keys: packed.Keys) -> packed.Keys:
        real = keys.entries(keys.no > packed.WEEDED) if len(keys.no) and keys.no.min() <= packed.WEEDED else keys
        if not len(real.hi):
            return real
        starts, bit = real.starts, np.left_shift(1, real.mask)
        plain = np.bitwise_count(real.mask) == 1
        present, n_plain = np.bincount(real.key), np.bincount(real.key, plain).astype(np.int64)
        gap = np.where(present < n_samples, 0 if ignore_const_gaps else 1, 0)
        n_codes = lambda bits: np.bitwise_count(np.bitwise_or.reduceat(bits, starts)).astype(np.int64)
        if kind == NO_FILTER:
            kept = np.ones(len(present), bool)
        elif kind == NO_AMBIG:
            kept = present == n_plain
        else:
            kept = n_codes(bit if kind == NO_CONST else np.where(plain, bit, 0)) + gap > 1
        left = real.keys(kept & ((n_plain if ambig_missing else present) >= max(least, 1 if ambig_missing else 0)))
        return replace(left, mask=np.where(np.bitwise_count(left.mask) > 1, UNKNOWN, left.mask).astype(np.int32)) if ambig_mask else left

    return step


def apply_filters(index: Index, kind: str = NO_CONST, min_freq: float = 0.9, ambig_missing: bool = False, ambig_mask: bool = False, ignore_const_gaps: bool = False, floor: bool = False) -> Index:
    """The keys that pass; with ``ambig_mask`` their ambiguous bases as N.

    A filter that keeps constant sites keeps those with gaps too: a warning says so.
    """
    if ignore_const_gaps and kind in (NO_FILTER, NO_AMBIG):
        warnings.warn(f"gap-only sites can only be left out with a filter of constant sites, not with {kind}", stacklevel=2)
    least = least_count(index, min_freq, floor)
    keys = key_stats(index).where(passes(kind, index.n_samples, least, ambig_missing, ignore_const_gaps)).select(*KEY)
    blocks = None if index.blocks is None else index.blocks.then(_step(kind, index.n_samples, least, ambig_missing, ignore_const_gaps, ambig_mask))
    kept = index.kmers.join(keys, KEY, "left_semi")
    if ambig_mask:
        kept = kept.withColumn("mask", F.when(F.bit_count(F.col("mask").cast("int")) > 1, UNKNOWN).otherwise(F.col("mask")).cast("int"))
    return index.with_kmers(kept, blocks)


def _wide(index: Index) -> DataFrame:
    """The key and ``bases`` (one code for each sample in order, gaps as ``-``) of every key."""
    if index.blocks is not None:
        return packed.wide_rows(index.blocks, index.names, text=False)
    wide = with_number(index.kmers, index.names).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("no", "mask"))).alias("m"))
    codes = row_of(F.col("m"), lambda e: mask_code(e["mask"]), index.n_samples, F.lit("-"))
    return wide.select(*KEY, F.array_join(codes, "").alias("bases"))


def columns(index: Index) -> DataFrame:
    """``key`` and ``bases`` (one code for each sample in order, gaps as ``-``) of every key."""
    if index.blocks is not None:
        return packed.wide_rows(index.blocks, index.names)
    return _wide(index).select(key_digits(index.k).alias("key"), "bases")


def alignment(index: Index) -> DataFrame:
    """``sample``, ``seq``: each sample's bases over all keys in key order, gaps as ``-``.

    A sequence of the result holds one letter a key, as its format demands.  Columns are
    turned into pieces of rows where ranges of keys lie; only those are gathered by sample.
    The columns are written first, since finding the ranges reads them as well.
    """
    spark = index.kmers.sparkSession
    names = spark.createDataFrame([(i, n) for i, n in enumerate(index.names)], "i int, sample string")
    n = len(index.names)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(batches):
            if batch.num_rows:
                grid = np.frombuffer("".join(batch["bases"].to_pylist()).encode(), np.uint8).reshape(-1, n)
                pieces = [row.tobytes().decode() for row in np.ascontiguousarray(grid.T)]
                yield pa.RecordBatch.from_pydict({"i": pa.array(range(n), pa.int32()), "part": pa.array([part] * n, pa.int32()), "piece_no": pa.array([seq] * n, pa.int32()), "piece": pieces})

    ordered = materialize(_wide(index), "columns").repartitionByRange(partitions(spark), *KEY).sortWithinPartitions(*KEY).select("bases")
    rows = ordered.mapInArrow(turn, "i int, part int, piece_no int, piece string").groupBy("i")
    rows = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece_no", "piece"))), lambda c: c["piece"]), "").alias("seq"))
    return names.join(rows, "i", "left").select("sample", F.coalesce("seq", F.lit("")).alias("seq"))
