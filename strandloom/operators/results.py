"""Results of mapping and aligning as JSON objects, a row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import distance, filters, refmap
from strandloom.operators.index import Index
from strandloom.operators.refmap import Reference
from strandloom.sources.sinks import json_result

#: A tree needs as many samples.
LEAST_SAMPLES = 3


def mapping(index: Index, ref: Reference) -> DataFrame:
    """``sample``, ``sequences`` (one for each contig in order), ``variants`` (reference middles that a k-mer of the sample maps to), ``coverage``.

    ``coverage`` is the share of the positions of all contigs that aren't gaps; null
    without positions.  Samples that map nowhere have gaps only.
    """
    found = refmap.hits(index, ref).select("sample", "chrom", "pos").distinct().groupBy("sample").agg(F.count("*").alias("variants"))
    own = refmap.by_contig(index, ref).groupBy("sample").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chrom", "seq"))), lambda x: x["seq"]).alias("sequences"),
        F.sum(F.length(F.translate("seq", "-", ""))).alias("covered"), F.sum(F.length("seq")).alias("total"),
    )
    coverage = F.when(F.col("total") > 0, F.col("covered") / F.col("total"))
    return own.join(found, "sample", "left").select("sample", "sequences", F.coalesce("variants", F.lit(0)).alias("variants"), coverage.alias("coverage"))


def mapping_json(index: Index, ref: Reference) -> DataFrame:
    """``sample``, ``json``: the mapped sequences, number of variants and coverage of every sample."""
    names = {"Mapped sequences": "sequences", "Number of variants": "variants", "Coverage": "coverage"}
    return mapping(index, ref).select("sample", json_result(**names).alias("json"))


def alignment_json(index: Index) -> DataFrame:
    """One row ``json``: tree, sample names and FASTA text of an index (already filtered).

    The tree joins neighbours by counts of differing codes at shared k-mers; blanks in its
    names are underscores.  One number for each pair of samples comes to the driver.  Fewer
    than three samples are an error.  The text is one value, as the format demands.
    """
    if index.n_samples < LEAST_SAMPLES:
        raise ValueError(f"not enough sequences: a tree needs {LEAST_SAMPLES} samples, there are {index.n_samples}")
    spark = index.kmers.sparkSession
    counts = distance.snp_matrix(index).where("sample1 < sample2")
    newick = distance.tree(counts, index.names, "snps", shown=tuple(n.replace(" ", "_") for n in index.names))
    order = spark.createDataFrame([(i, n) for i, n in enumerate(index.names)], "i int, sample string")
    rows = filters.alignment(index).join(order, "sample").agg(F.array_sort(F.collect_list(F.struct("i", "sample", "seq"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: F.concat(F.lit(">"), r["sample"], F.lit("\n"), r["seq"], F.lit("\n"))), "")
    return rows.select(json_result(newick=F.lit(newick), names=F.transform("rows", lambda r: r["sample"]), alignment=text).alias("json"))
