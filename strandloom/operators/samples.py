"""Samples as numbers: names are a table that is joined, never literals of an expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, names: tuple[str, ...], no: str = "no", sample: str = "sample") -> DataFrame:
    """Number and name of every sample in order."""
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"{no} int, {sample} string")


def with_number(rows: DataFrame, names: tuple[str, ...], no: str = "no") -> DataFrame:
    """``rows`` with the number of their ``sample`` in place of its name.

    The names are a list on the driver, so what is broadcast is no larger than that.
    """
    return rows.join(F.broadcast(table(rows.sparkSession, names, no)), "sample").drop("sample")


def row_of(entries: Column, value, n_samples: int, gap: Column) -> Column:
    """One value for each sample: ``value`` of the entries and ``gap`` between them.

    ``entries`` is a column of structs sorted by ``no``, not an expression: it is read once an entry.  Gaps are filled in from one entry to the next, so a row costs its own length, and
    the expression is the same for any number of samples.
    """
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(entries, i - 1)["no"])
    filled = F.flatten(F.transform(entries, lambda e, i: F.array_append(F.array_repeat(gap, e["no"] - before(i) - 1), value(e))))
    last = F.coalesce(F.try_element_at(entries, F.lit(-1))["no"], F.lit(-1))
    return F.concat(filled, F.array_repeat(gap, F.lit(n_samples - 1) - last))
