"""Text outputs: FASTA, VCF, distance tables, clusters, JSON.

``lines`` frames hold ``section`` and ``line``; Spark writes them as text in order.  What
is printed (:func:`show`) streams through the driver a partition at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators.distance import DISTANCE_HEADER, distance_lines


def fasta_lines(rows: DataFrame) -> DataFrame:
    """A record of two lines for each row of ``sample``, ``seq``."""
    return rows.select(F.lit(1).alias("section"), F.col("sample").alias("a"), F.lit("").alias("b"), F.concat(F.lit(">"), "sample", F.lit("\n"), "seq").alias("line"))


def reference_lines(contigs: DataFrame) -> DataFrame:
    """The sequences of ``chrom``, ``seq`` in order, a line each."""
    return contigs.select(F.lit(1).alias("section"), F.lpad(F.col("chrom").cast("string"), 20, "0").alias("a"), F.lit("").alias("b"), F.col("seq").alias("line"))


def json_lines(rows: DataFrame) -> DataFrame:
    """The ``json`` objects of rows by ``sample``, a line each."""
    return rows.select(F.lit(1).alias("section"), F.col("sample").alias("a"), F.lit("").alias("b"), F.col("json").alias("line"))


def _with_header(rows: DataFrame, header: Sequence[str]) -> DataFrame:
    top = rows.sparkSession.createDataFrame([(0, f"{i:04d}", "", h) for i, h in enumerate(header)], "section int, a string, b string, line string")
    return top.unionByName(rows)


def distance_table(found: DataFrame) -> DataFrame:
    rows = distance_lines(found).select(F.lit(1).alias("section"), F.col("sample1").alias("a"), F.col("sample2").alias("b"), "line")
    return _with_header(rows, [DISTANCE_HEADER])


def cluster_table(found: DataFrame) -> DataFrame:
    """CSV of ``sample``, ``cluster`` number; the largest cluster is 1."""
    order = found.select("cluster", "size").distinct().orderBy(F.desc("size"), "cluster").collect()  # one row a cluster, as many as samples at most
    number = F.create_map(*[x for i, r in enumerate(order) for x in (F.lit(r["cluster"]), F.lit(i + 1))]) if order else F.lit(None)
    rows = found.select(F.lit(1).alias("section"), "sample", number[F.col("cluster")].alias("n"))
    return _with_header(rows.select("section", F.col("sample").alias("a"), F.lit("").alias("b"), F.concat_ws(",", "sample", F.col("n").cast("string")).alias("line")), ["id,Cluster"])


def dot_graph(found: DataFrame, max_snps: float) -> DataFrame:
    """An undirected graph of the pairs within ``max_snps``."""
    edge = F.format_string('  "%s" -- "%s" [label=%.2f];', "sample1", "sample2", "distance")
    rows = found.where(F.col("distance") <= max_snps).select(F.lit(1).alias("section"), F.col("sample1").alias("a"), F.col("sample2").alias("b"), edge.alias("line"))
    end = found.sparkSession.createDataFrame([(2, "", "", "}")], "section int, a string, b string, line string")
    return _with_header(rows.unionByName(end), ["graph distances {"])


def phylip_lines(rows: DataFrame, n: int) -> DataFrame:
    """PHYLIP of :func:`strandloom.operators.distance.phylip` rows."""
    return _with_header(rows.select(F.lit(1).alias("section"), F.col("sample").alias("a"), F.lit("").alias("b"), F.concat_ws("\t", "sample", "row").alias("line")), [str(n)])


def vcf_lines(sites: DataFrame, names: Sequence[str], contig: F.Column | None = None) -> DataFrame:
    """A haploid VCF of ``chrom pos ref alt gt`` rows; ``contig`` is the printed name (default: the number)."""
    chrom = (contig if contig is not None else F.col("chrom")).cast("string")
    line = F.concat_ws("\t", chrom, F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), "gt")
    rows = sites.select(F.lit(1).alias("section"), F.lpad(F.col("chrom").cast("string"), 12, "0").alias("a"), F.lpad(F.col("pos").cast("string"), 12, "0").alias("b"), line.alias("line"))
    head = "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])
    return _with_header(rows, ["##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', head])


def one_line(spark: SparkSession, line: str) -> DataFrame:
    """A text of one line, such as a tree."""
    return spark.createDataFrame([(1, "", "", line)], "section int, a string, b string, line string")


def json_result(**columns: F.Column | str) -> F.Column:
    """One JSON object of named columns."""
    return F.to_json(F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()]))


def write(lines: DataFrame, path: str) -> None:
    """Text files below ``path`` whose order is the lines' order."""
    lines.orderBy("section", "a", "b").select("line").write.text(path)


def show(lines: DataFrame) -> None:
    for row in lines.orderBy("section", "a", "b").select("line").toLocalIterator():
        print(row[0])
