"""The index of gapped k-mers of many samples, and what changes it.

One row for each sample and key, with the mask of all middle bases seen:
``sample, key_hi, key_lo, mask``.  A missing key is an absent row, so joining sample
spaces is a union, adding to a sample is an aggregation, and no dense matrix exists.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.bases import check_k, key_digits, mask_code
from strandloom.functions.kmers import gapped_kmers
from strandloom.operators import blocks as packed
from strandloom.operators.blocks import Blocks
from strandloom.operators.samples import row_of, table, with_number
from strandloom.operators.strands import Strands, written
from strandloom.sources.shared import partitions, shared_dir

KEY = ["key_hi", "key_lo"]
VERSION = "1"


@dataclass(frozen=True)
class Index:
    """Gapped k-mers with their length, strandedness and sample names in order."""

    k: int
    rc: bool
    names: tuple[str, ...]
    kmers: DataFrame
    #: the same rows, packed, if nothing has been done to ``kmers`` that blocks don't know
    blocks: Blocks | None = None
    #: writes the sequences that hold just these k-mers, for the graph
    strands: Callable[[], Strands] | None = None

    @property
    def k_bits(self) -> int:
        return 64 if self.k <= 31 else 128

    @property
    def n_samples(self) -> int:
        return len(self.names)

    def with_kmers(self, kmers: DataFrame, blocks: Blocks | None = None) -> Index:
        return replace(self, kmers=kmers, blocks=blocks, strands=None)

    def rows(self, text: bool = False) -> DataFrame:
        """``sample``, the key (or, ``text``, its digits as ``key``) and ``mask`` of every entry, from the blocks if there are any."""
        if self.blocks is not None:
            return packed.long_rows(self.blocks, self.names, text)
        return self.kmers.select("sample", key_digits(self.k).alias("key"), F.col("mask").cast("int").alias("mask")) if text else self.kmers


def subsample(seqs: DataFrame, proportion: float | None) -> DataFrame:
    """Every round(1/p)-th record of each file, from its first (``rec_no`` 0)."""
    if proportion is None:
        return seqs
    if not 0 < proportion <= 1:
        raise ValueError("a proportion lies in (0, 1]")
    return seqs.where(F.col("rec_no") % int(1 / proportion + 0.5) == 0)


def build(seqs: DataFrame, k: int = 31, rc: bool = True, quality: str = "none", min_qual: int = 20, min_count: int = 1, proportion: float | None = None, names: list[str] | None = None) -> Index:
    """Index ``seqs`` (``sample``, ``seq`` and for reads ``qual``; ``rec_no`` to subsample).

    Reads count towards ``min_count`` by the whole k-mer, middle base included, after
    the quality filter; records without ``qual`` are neither filtered nor counted.
    Without ``names`` the samples come in alphabetical order.  Blocks of sequences give
    a key once; then all rows of a key are brought together, which serves this
    aggregation and any by key that follows without another shuffle.
    """
    seqs = subsample(seqs, proportion)
    reads = "qual" in seqs.columns
    if reads and min_count > 1:
        found = gapped_kmers(seqs, k, rc, quality, min_qual, ["sample", F.col("qual").isNotNull().alias("read")])
        whole = found.groupBy("sample", *KEY, "mask", "read").agg(F.count("*").alias("n"))
        found = whole.where((F.col("n") >= min_count) | ~F.col("read"))
    else:
        found = gapped_kmers(seqs, k, rc, quality, min_qual, ["sample"], joined=True).repartition(*KEY)
    kmers = found.groupBy("sample", *KEY).agg(F.bit_or("mask").alias("mask"))
    if names is None:
        names = [r[0] for r in seqs.select("sample").where("sample is not null").distinct().orderBy("sample").collect()]
    blocks = strands = None
    if not (reads and min_count > 1) and len(set(names)) == len(names):
        numbered = seqs.join(F.broadcast(table(seqs.sparkSession, tuple(names))), "sample", "left")
        blocks = Blocks(k, tuple(names), packed.cut(numbered, F.coalesce("no", F.lit(packed.NAMELESS)), k, rc, quality, min_qual), rc=rc)
        strands = lambda: written(numbered, len(names), k, quality, min_qual)
    return Index(check_k(k), rc, tuple(names), kmers, blocks, strands)


def _table(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Parquet files below ``path`` in ``n`` buckets by key, without an entry in the catalog.

    Spark reads buckets through a table only.  The entry is dropped once the table is
    resolved; files of an external table stay.
    """
    name = f"strandloom_{uuid.uuid4().hex}"
    place = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} (sample STRING, key_hi BIGINT, key_lo BIGINT, mask INT) USING parquet CLUSTERED BY (key_hi, key_lo) SORTED BY (key_hi, key_lo) INTO {n} BUCKETS LOCATION '{place}'")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def _write(index: Index, path: str) -> int:
    """Writes the rows into buckets by key; their number."""
    spark = index.kmers.sparkSession
    name, n = f"strandloom_{uuid.uuid4().hex}", partitions(spark)
    rows = index.rows().select(F.col("sample").cast("string").alias("sample"), *KEY, F.col("mask").cast("int").alias("mask"))
    rows.repartition(n, *KEY).write.bucketBy(n, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    return n


def stored(index: Index) -> Index:
    """The index written once, bucketed and sorted by key in the shared folder, for more than one use.

    What aggregates or joins by key afterwards needs no shuffle.
    """
    spark = index.kmers.sparkSession
    path = shared_dir(spark, "index")
    return index.with_kmers(_table(spark, path, _write(index, path)))


def _same_kind(indexes: list[Index]) -> None:
    if len({(i.k, i.rc) for i in indexes}) > 1:
        raise ValueError("indexes differ in k or in strandedness")


def merge(indexes: list[Index]) -> Index:
    """The samples of all indexes in one (sample spaces side by side)."""
    _same_kind(indexes)
    names = tuple(n for i in indexes for n in i.names)
    own = [i.blocks for i in indexes]
    both = packed.side_by_side(own) if all(b is not None and b.names == i.names for b, i in zip(own, indexes, strict=True)) else None
    return Index(indexes[0].k, indexes[0].rc, names, reduce(DataFrame.unionByName, (i.kmers for i in indexes)), both)


def add(indexes: list[Index]) -> Index:
    """Indexes over one sample space added up: the masks of a sample's key are joined."""
    _same_kind(indexes)
    names = tuple(dict.fromkeys(n for i in indexes for n in i.names))
    both = reduce(DataFrame.unionByName, (i.kmers for i in indexes))
    own = [i.blocks for i in indexes]
    blocks = packed.together(own) if all(b is not None and set(b.names) == set(i.names) for b, i in zip(own, indexes, strict=True)) else None
    return Index(indexes[0].k, indexes[0].rc, names, both.groupBy("sample", *KEY).agg(F.bit_or("mask").alias("mask")), blocks)


def delete(index: Index, samples: list[str]) -> Index:
    """The index without some samples; keys that only they had go with their rows."""
    gone = set(samples)
    if not gone or gone - set(index.names):
        raise ValueError(f"no such samples: {sorted(gone - set(index.names))}" if gone else "no samples to delete")
    names = tuple(n for n in index.names if n not in gone)
    if not names:
        raise ValueError("can't delete all samples")
    blocks = index.blocks
    if blocks is not None:
        to = np.array([n not in gone for n in blocks.names])
        blocks = blocks.then(lambda keys: keys.entries((keys.no <= packed.WEEDED) | (keys.no >= 0) & to[np.maximum(keys.no, 0)]))
    return replace(index, names=names, kmers=index.kmers.where(~F.col("sample").isin(sorted(gone))), blocks=blocks, strands=None)


def weed(index: Index, seqs: DataFrame, reverse: bool = False) -> Index:
    """Without the keys of ``seqs`` (or, reversed, with these only).

    The list's distinct keys are joined by key; Spark broadcasts them if they are small.
    """
    keys = gapped_kmers(seqs, index.k, index.rc, keep=[F.lit(1).alias("one")]).select(*KEY).distinct()
    blocks = None if index.blocks is None else packed.weeded(index.blocks, seqs, index.rc, reverse)
    return index.with_kmers(index.kmers.join(keys, KEY, "left_semi" if reverse else "left_anti"), blocks)


def sample_counts(index: Index) -> DataFrame:
    """``sample``, ``n_kmers``; samples without a key have 0."""
    spark = index.kmers.sparkSession
    names = spark.createDataFrame([(n,) for n in dict.fromkeys(index.names)], "sample string")
    return names.join(index.rows().groupBy("sample").agg(F.count("*").alias("n")), "sample", "left").select("sample", F.coalesce("n", F.lit(0)).cast("long").alias("n_kmers"))


def check_samples(index: Index) -> Index:
    """The index, if every sample has a k-mer; else an error that names those without."""
    none = [r["sample"] for r in sample_counts(index).where("n_kmers = 0").orderBy("sample").collect()]  # names of samples
    if none:
        raise ValueError(f"no valid k-mers in: {', '.join(none)}")
    return index


def summary(index: Index) -> DataFrame:
    """One row: ``k``, ``k_bits``, ``rc``, ``n_kmers`` (distinct keys), ``n_samples``."""
    if index.blocks is not None:
        n = packed.counted(index.blocks, index.names).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_kmers"))
    else:
        n = index.kmers.select(*KEY).distinct().agg(F.count("*").alias("n_kmers"))
    return n.select(
        F.lit(index.k).alias("k"), F.lit(index.k_bits).alias("k_bits"), F.lit(index.rc).alias("rc"), "n_kmers", F.lit(index.n_samples).cast("long").alias("n_samples")
    )


def full_info(index: Index) -> DataFrame:
    """``key`` (arms as digits) and ``bases`` (a code for each sample in order, comma-joined) of every key.

    The list of a key is bounded by the number of samples.
    """
    if index.blocks is not None:
        return packed.wide_rows(index.blocks, index.names, ",")
    wide = with_number(index.kmers, index.names).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("no", "mask"))).alias("m"))
    codes = row_of(F.col("m"), lambda e: mask_code(e["mask"]), index.n_samples, F.lit("-"))
    return wide.select(key_digits(index.k).alias("key"), F.array_join(codes, ",").alias("bases"))


def save(index: Index, path: str) -> None:
    """Parquet folders ``kmers`` (in buckets by key) and ``meta`` below ``path``; an error if there are any."""
    spark = index.kmers.sparkSession
    row = (index.k, index.rc, list(index.names), VERSION, index.k_bits, partitions(spark))
    meta = spark.createDataFrame([row], "k int, rc boolean, names array<string>, version string, k_bits int, buckets int")
    meta.coalesce(1).write.mode("errorifexists").parquet(f"{path}/meta")
    _write(index, f"{path}/kmers")


def load(spark: SparkSession, path: str) -> Index:
    """A saved index; filters, weeding, merging and distances over it need no shuffle by key.

    Indexes with the same number of buckets are joined and merged bucket by bucket.
    """
    meta = spark.read.parquet(f"{path}/meta").first()
    return Index(meta["k"], meta["rc"], tuple(meta["names"]), _table(spark, f"{path}/kmers", meta["buckets"]))
