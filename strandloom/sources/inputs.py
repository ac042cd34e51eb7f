"""What a command reads: one saved index, or sequence files that an index is built from."""

from __future__ import annotations

from pyspark.sql import SparkSession

from strandloom.operators import index
from strandloom.sources import sequences


def open_index(spark: SparkSession, paths: list[str], file_list: str | None = None) -> index.Index:
    """The saved index of a single path, else one built with the defaults from ``file_list`` or the files at ``paths``."""
    if len(paths) == 1 and not file_list:
        return index.load(spark, paths[0])
    listed = sequences.file_list(spark, file_list) if file_list else sequences.files(spark, paths)
    return index.build(sequences.read_for_index(listed, 31), quality="strict", min_count=5)
