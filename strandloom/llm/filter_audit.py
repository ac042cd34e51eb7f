"""What each filter of a chain removes, in every order of the filters.

A document is judged once: its failures are the bits of a mask.  Masks are counted by
part; a subset-zeta transform turns the counts of a part into the survivors of every
subset of the filters, and a step of an order is the difference of two neighbouring
subsets.  So the number of orders never meets the number of documents.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.words import word_array
from strandloom.sources.shared import materialize

FILTERS = "ABCDE"
#: Orders grow as the factorial, masks as the power of two.
MAX_FILTERS = 7
_COUNTS = ["n", "good", "toxic"]


def own_failures(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 1, 2, 4 and 8; a null text is empty.

    A: under 50 words.  B: fewer than 65 distinct words in a hundred.  C: more than
    five letters A-Z in a hundred code points.  D: a sign of ``#$%&*|``.
    """
    text = F.coalesce(text, F.lit(""))
    words, capitals = word_array(text), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((F.when(f, F.lit(1 << i)).otherwise(0) for i, f in enumerate(fails[1:], 1)), F.when(fails[0], F.lit(1)).otherwise(0))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part``, ``mask``, ``n``, ``good``, ``toxic``: the documents of a part by the set of filters they fail.

    Texts are the same if their SHA-256 is.  Filter E (bit 16) is failed by a document
    with a smaller doc_id's text; a null doc_id is smaller or greater than none.  Rows
    with one doc_id, source and text count each.  A null source is the part ``""``, as
    an empty one.  A document is good (toxic) if any row of ``labels`` with its doc_id
    has quality (toxic) = 1; null ids have no label.  No step is keyed by what a group of
    copies, a source or an id has in common before its rows are added up.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("text_id"), own_failures(F.col("text")).alias("own"))
    judged = materialize(rows.groupBy("text_id", "doc_id", "part", "own").agg(F.count("*").alias("n")), "judged")
    first = judged.where("doc_id is not null").groupBy("text_id").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    late = F.col("doc_id").isNotNull() & F.col("first").isNull()
    each = judged.join(first, ["text_id", "doc_id"], "left").select("doc_id", "part", (F.col("own") + F.when(late, 16).otherwise(0)).alias("mask"), "n")
    each = each.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    told = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("long").alias(c)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(told("quality"), told("toxic"))
    both = each.join(marks, "doc_id", "left")
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.col("n") * F.col("quality")), F.lit(0)).alias("good"), F.coalesce(F.sum(F.col("n") * F.col("toxic")), F.lit(0)).alias("toxic"))


def _count_of(counts: str):
    return lambda mask: F.coalesce(F.try_element_at(counts, mask), F.lit(0))


def _with_fewer(sums: str, bit: int):
    """A mask's sum, and the one of the mask without ``bit`` if it has that."""
    return lambda x, mask: x + F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.get(sums, mask.bitwiseXOR(F.lit(bit)))).otherwise(0)


def survivors(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part`` and, as arrays ``n``, ``good`` and ``toxic``, what is left of it after each subset of the filters.

    Element S (from 0) of an array is the number of documents that fail none of the
    filters whose bits are set in S: the zeta transform of the mask counts, read at the
    subset's complement.
    """
    if not 0 < len(filters) <= MAX_FILTERS:
        raise ValueError(f"one to {MAX_FILTERS} filters")
    size = 1 << len(filters)
    out = masks.groupBy("part").agg(*[F.map_from_entries(F.collect_list(F.struct("mask", c))).alias(c) for c in _COUNTS])  # at most `size` masks a part
    out = out.select("part", *[F.transform(F.sequence(F.lit(0), F.lit(size - 1)), _count_of(c)).alias(c) for c in _COUNTS])
    for i in range(len(filters)):
        out = out.withColumns({c: F.transform(c, _with_fewer(c, 1 << i)) for c in _COUNTS})
    return out.select("part", *[F.reverse(c).alias(c) for c in _COUNTS])


def _steps(filters: str) -> Column:
    """All steps of all orders, a literal array (its length depends on the number of filters only)."""
    steps = []
    for order in permutations(filters):
        bits = [1 << filters.index(f) for f in order]
        steps += [{"filter_order": "".join(order), "step": i + 1, "before": sum(bits[:i]), "after": sum(bits[: i + 1]), "bit": bits[i]} for i in range(len(bits))]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,before:int,after:int,bit:int>>")


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley`` of every step of every order.

    ``masks`` is what :func:`mask_counts` returns; without rows there are none here.
    ``shapley`` weighs the gain of a filter after each subset of the others by the
    number of orders in which exactly these come before it.
    """
    n = len(filters)
    rows = survivors(masks, filters).withColumn("s", F.explode(_steps(filters))).select("part", *_COUNTS, "s.*")
    left = lambda c, subset: F.get(c, subset)
    lost = lambda c: left(c, F.col("before")) - left(c, F.col("after"))
    none, full, bit = F.lit(0), F.lit((1 << n) - 1), F.col("bit")
    orders = F.array(*[F.lit(math.factorial(k) * math.factorial(n - 1 - k)).cast("long") for k in range(n)])
    others = F.filter(F.sequence(none, full), lambda s: s.bitwiseAND(bit) == 0)
    shapley = F.aggregate(others, F.lit(0).cast("long"), lambda sum_, s: sum_ + F.get(orders, F.bit_count(s)) * (F.get("n", s) - F.get("n", s.bitwiseOR(bit))))
    return rows.select(
        "part", "filter_order", "step", left("n", F.col("after")).alias("kept"), lost("n").alias("removed"), (left("n", none) - left("n", bit) - lost("n")).alias("redundant"),
        (left("n", full.bitwiseXOR(bit)) - left("n", full)).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The audit of filters A to E over ``documents``; see :func:`mask_counts` and :func:`audit`."""
    return audit(mask_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")))


#: The same from the definitions: every order is applied to the documents of each mask.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), bad AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
d AS (SELECT part, doc_id IN (SELECT doc_id FROM good WHERE doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM bad WHERE doc_id IS NOT NULL) AS toxic,
  (len(words) < 50)::INTEGER + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INTEGER + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INTEGER
  + 8 * regexp_matches(text, '[#$%&*|]')::INTEGER + 16 * coalesce(doc_id > first, false)::INTEGER AS mask FROM w),
m AS MATERIALIZED (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM d GROUP BY ALL),
f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.l || q.l || r.l || s.l || u.l AS filter_order, [p.b, q.b, r.b, s.b, u.b] AS bits FROM f p, f q, f r, f s, f u WHERE p.b | q.b | r.b | s.b | u.b = 31),
k AS (SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS gone FROM o, unnest(range(1, 6)) AS r(step)),
a AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (mask & (gone | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & gone = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & gone <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(g) FILTER (mask & gone = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (mask & gone = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost FROM m, k GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM a
"""
