"""Sequence files: lists of files, and FASTA or FASTQ records.

A compressed file can't be split, so it is read by one task, record by record; many
files are read by many tasks, and a long plain FASTA file by many (:mod:`ranges`).  The format follows from the first record's sign and
compression from the first two bytes, never from the name.
"""

from __future__ import annotations

import gzip
import io
import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.bases import sample_name
from strandloom.sources import ranges

_RECORDS = "sample string, file_no int, rec_no long, contig string, seq string, qual string"


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """``sample``, ``path1``, ``path2`` from lines of two (FASTA) or three (paired FASTQ) words; others are an error."""
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "").select(words.alias("w"))
    checked = lines.select("w", F.when(F.size("w").isin(2, 3), True).otherwise(F.raise_error(F.concat(F.lit("a line has 2 or 3 fields: "), F.array_join("w", " ")))).alias("fine")).where("fine")
    return checked.select(F.col("w")[0].alias("sample"), F.col("w")[1].alias("path1"), F.try_element_at("w", F.lit(3)).alias("path2"))


def name_list(spark: SparkSession, path: str) -> list[str]:
    """Sample names, one a line (what is to be deleted is few by nature)."""
    return [r[0] for r in spark.read.text(path).select(F.trim("value")).collect() if r[0]]


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The file list of single files, named after them."""
    rows = spark.createDataFrame([(p,) for p in paths], "path1 string")
    return rows.select(sample_name(F.col("path1")).alias("sample"), "path1", F.lit(None).cast("string").alias("path2"))


def is_paired() -> F.Column:
    """Whether a row of a file list is read files (has a second one)."""
    return F.col("path2").isNotNull()


def pair_reads(paths: list[str]) -> list[tuple[str, str, str | None]]:
    """(sample, path1, path2): files whose names differ in one sign, 0, 1 or 2, are pairs."""
    left, out = sorted(paths), []
    while left:
        one = left.pop(0)
        mate = next((p for p in left if len(p) == len(one) and [(a, b) for a, b in zip(one, p, strict=True) if a != b] in ([("1", "2")], [("0", "1")])), None)
        if mate:
            left.remove(mate)
        base = os.path.basename(one)
        for end in (".gz", ".fastq", ".fasta", ".fq", ".fa"):
            base = base.removesuffix(end)
        out.append((base, one, mate))
    return out


def paired_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The file list of single files and of pairs of read files, found by their names."""
    rows = spark.createDataFrame(pair_reads(paths), "name string, path1 string, path2 string")
    return rows.select(F.when(F.col("path2").isNull(), sample_name(F.col("path1"))).otherwise(F.col("name")).alias("sample"), "path1", "path2")


def _open(path: str) -> io.BufferedIOBase:
    store, name = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    raw = io.BufferedReader(store.open_input_file(name), 1 << 20)
    return gzip.open(raw) if raw.peek(2)[:2] == b"\x1f\x8b" else raw


def records(lines: Iterator[bytes]) -> Iterator[tuple[str, str, str | None]]:
    """(name, sequence, quality or None) of each record; a FASTQ record has four lines."""
    first = next((x for x in (line.strip() for line in lines) if x), None)
    if first is None:
        return
    if first[:1] == b"@":
        while first:
            seq, _, qual = (next(lines, b"").strip().decode() for _ in range(3))
            yield (first[1:].split() or [b""])[0].decode(), seq, qual
            first = next((x for x in (line.strip() for line in lines) if x), None)
    elif first[:1] == b">":
        name, parts = first, []
        for line in lines:
            line = line.strip()
            if line[:1] == b">":
                yield (name[1:].split() or [b""])[0].decode(), b"".join(parts).decode(), None
                name, parts = line, []
            else:
                parts.append(line)
        yield (name[1:].split() or [b""])[0].decode(), b"".join(parts).decode(), None
    else:
        raise ValueError("neither FASTA nor FASTQ")


def _each(listed: DataFrame) -> DataFrame:
    return listed.select("sample", F.posexplode(F.filter(F.array("path1", "path2"), lambda p: p.isNotNull())).alias("file_no", "path"))


def read_for_index(listed: DataFrame, k: int) -> DataFrame:
    """:func:`read`, but long plain FASTA files in overlapping pieces of contigs that hold every k-mer."""
    each = ranges.with_length(_each(listed).repartition("path"))
    long = F.coalesce(F.col("length") > ranges.RANGE, F.lit(False))
    return _whole(each.where(~long).drop("length")).unionByName(ranges.pieces(each.where(long), k))


def read(listed: DataFrame) -> DataFrame:
    """``sample file_no rec_no contig seq qual`` of a file list; ``rec_no`` starts at 0 in each file."""
    return _whole(_each(listed))


def _whole(each: DataFrame) -> DataFrame:
    n = max(1, min(each.count(), 10_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sample, file_no, path in zip(*(batch[c].to_pylist() for c in ("sample", "file_no", "path")), strict=True):
                held, size = [], 0

                def flush(held: list) -> pa.RecordBatch:
                    cols = list(zip(*held, strict=True))
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["sample", "file_no", "rec_no", "contig", "seq", "qual"])

                with _open(path) as f:
                    for i, (name, seq, qual) in enumerate(records(iter(f))):
                        held.append((sample, file_no, i, name, seq, qual))
                        size += len(seq)
                        if size > 4 << 20:
                            yield flush(held)
                            held, size = [], 0
                if held:
                    yield flush(held)

    return each.repartition(n, "path").mapInArrow(run, _RECORDS)


def reference_contigs(spark: SparkSession, path: str) -> DataFrame:
    """``chrom`` (in order), ``name``, ``seq`` of a FASTA file; reads are an error."""
    rows = read(files(spark, [path]))
    return rows.select(F.col("rec_no").cast("int").alias("chrom"), F.col("contig").alias("name"), F.when(F.col("qual").isNull(), F.col("seq")).otherwise(F.raise_error(F.lit("a reference is FASTA"))).alias("seq"))
