"""Mixing sources to target weights: blocks apportioned by highest quotients.

A source's words are laid out in shards and cut into blocks of equal length.  The
blocks of the whole mix are dealt to sources, and a source's to its shards, by
Sainte-Laguë quotients (weight over 1, 3, 5, ...), so that quotas are integers with
the right sum.  Each shard then takes its blocks by a seeded permutation.  Everything
is DataFrame operations; a group of equal rows is one row with a count until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.llm.words import word_array
from strandloom.sources.shared import materialize, partitions

#: Words of a block, times a source may be repeated, weights of the sources in order, seed.
BLOCK_WORDS, MAX_REPEATS, WEIGHTS, SEED = 32, 3, (1, 2, 3), "mix"
#: Rows (documents of one id, source and size) of a shard, in the mean.
SHARD_ROWS = 20_000
#: Copies of one row that one task spells out.
COPIES = 1000
#: Odd primes above any number of blocks in a shard: steps of the permutations.
_STRIDES = (2147483659, 2654435789, 3221225533, 4294967291)


def _hash(*parts: str) -> Column:
    """A number under 2^32 from the texts of columns (null: empty)."""
    return F.conv(F.substr(F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])), F.lit(1), F.lit(8)), 16, 10).cast("long")


def _nulls_last(c: str) -> list[Column]:
    return [F.col(c).isNull(), F.col(c)]


def sized(docs: DataFrame) -> DataFrame:
    """``source``, ``doc_id``, ``size`` (words; a null text has none) and ``n``, the number of such rows."""
    return docs.select("source", "doc_id", F.size(word_array(F.coalesce("text", F.lit("")))).cast("long").alias("size")).groupBy("source", "doc_id", "size").agg(F.count("*").alias("n"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``sources`` (``source``, ``words``) with ``place`` (from 0) and ``target``.

    Sources come by code point, null last; the weights repeat.  All words are shared by
    weight.  A share stops at ``max_repeats`` times the source's words and the excess
    goes to the others by weight: with sources ordered by cap over weight, the capped
    ones come first, and the level (target over weight) of the rest follows from sums of
    those before.  One row a source: a summary, which one task puts in order.
    """
    place = F.row_number().over(W.orderBy(*_nulls_last("source"))) - 1
    ordered = sources.withColumn("place", place).withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int")).cast("long"))
    ordered = ordered.withColumn("cap", max_repeats * F.col("words"))
    by = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before, every = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("words").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    shares = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ordered.withColumn("level", left / shares).withColumn("open", F.col("cap") / F.col("weight") >= F.col("level"))
    level = level.withColumn("level", F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("cap") / F.col("weight"))).over(every))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double")))
    return level.select("source", "words", "place", target.alias("target"))


def apportion(parties: DataFrame, within: list[str], order: str, seats: Column) -> DataFrame:
    """``parties`` with ``quota``: ``seats`` dealt by highest quotients ``weight`` / (2k + 1), at most ``most`` to a party.

    Equal quotients go to the smaller ``order``.  ``parties`` has ``weight`` (which add
    up to about the seats) and ``most``; groups are the columns ``within``.  Quotas lie
    near the weights, so only quotients near that place become rows: the divisor that
    gives the right sum differs from 1 by no more than parties over seats.
    """
    group = W.partitionBy(*within) if within else W.partitionBy(F.lit(0))
    told = parties.withColumn("seats_", seats).withColumn("parties_", F.count("*").over(group))
    reach = F.ceil(F.col("parties_") * F.col("weight") / F.greatest(F.col("seats_"), F.lit(1))) + 2
    base = F.least(F.greatest(F.floor(F.col("weight")) - reach, F.lit(0)), F.col("most"))
    told = told.withColumn("base_", base).withColumn("last_", F.least(F.floor(F.col("weight")) + reach, F.col("most") - 1))
    told = told.withColumn("open_", F.col("seats_") - F.sum("base_").over(group))
    near = told.where("last_ >= base_").withColumn("k", F.explode(F.sequence("base_", "last_")))
    by = group.orderBy(F.desc(F.col("weight") / (2 * F.col("k") + 1)), order)
    won = near.withColumn("r", F.row_number().over(by)).where("r <= open_").groupBy(*within, order).agg(F.count("*").alias("won_"))
    return told.join(won, [*within, order], "left").select(*parties.columns, (F.col("base_") + F.coalesce("won_", F.lit(0))).alias("quota"))


def quotas(rows: DataFrame, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """(shards, rows with ``shard``): ``place shard source_size target blocks quota`` for every shard with words.

    ``rows`` is :func:`sized`.  A source has one shard for every ``shard_rows`` rows; rows go
    there by a seeded hash of id and size.  A source's weight is its target in blocks.
    """
    counted = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.count("*").alias("rows_"))
    told = materialize(targets(counted.select("source", "words")).join(counted.select(F.col("source").alias("s_"), F.ceil(F.col("rows_") / shard_rows).alias("shards")), F.col("source").eqNullSafe(F.col("s_"))).drop("s_"), "mix-sources")
    placed = rows.join(told.select(F.col("source").alias("s_"), "place", "shards"), F.col("source").eqNullSafe(F.col("s_"))).drop("s_")
    placed = materialize(placed.withColumn("shard", F.pmod(_hash("doc_id", "size"), F.col("shards"))).drop("shards"), "mix-rows")
    shards = placed.groupBy("place", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("shard_words")).where("shard_words > 0")
    shards = materialize(shards.withColumn("blocks", F.ceil(F.col("shard_words") / block_words)), "mix-shards")
    blocks = shards.groupBy("place").agg(F.sum("blocks").alias("blocks"))
    weighed = told.join(blocks, "place").select("place", "words", "target", "blocks", (F.col("target") * F.col("blocks") / F.col("words")).alias("weight"), (MAX_REPEATS * F.col("blocks")).alias("most"))
    every = F.round(F.sum(F.col("weight").cast("decimal(38,6)")).over(W.partitionBy(F.lit(0)))).cast("long")
    dealt = materialize(apportion(weighed, [], "place", every), "mix-quotas")
    own = shards.join(dealt.select("place", F.col("words").alias("source_size"), "target", F.col("blocks").alias("all"), F.col("quota").alias("seats")), "place")
    own = own.select("place", "shard", "source_size", "target", "blocks", "seats", (F.col("seats") * F.col("blocks") / F.col("all")).alias("weight"), (MAX_REPEATS * F.col("blocks")).alias("most"))
    dealt = apportion(own, ["place"], "shard", F.col("seats"))
    return materialize(dealt.select("place", "shard", "source_size", "target", "blocks", "quota"), "mix-shard-quotas"), placed


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id source size source_size target taken pieces`` of every row of ``docs``.

    ``pieces`` are the word ranges (``first``, ``words``, ``times``) of the document that
    the mix takes, at most ``block_words`` long each; ``taken`` adds them up.  In a shard the
    documents lie end to end by a seeded hash; of its blocks each is taken quota div
    blocks times, and those that a seeded permutation of block numbers puts first once
    more.  Rows with equal doc_id, source and size are told apart by number only.  Null
    ids and null or empty texts are rows like others (without words nothing is taken);
    a null source is a source, the last one; the result depends on the rows only, not
    on their order or partitions.
    """
    shards, placed = quotas(materialize(sized(docs), "mix-sizes"), block_words, shard_rows)
    order = W.partitionBy("place", "shard").orderBy(_hash("size", "doc_id"), *_nulls_last("doc_id"), "size")
    words = F.col("size") * F.col("n")
    laid = placed.withColumn("at", F.sum(words).over(order.rowsBetween(W.unboundedPreceding, 0)) - words)
    # a shard without words has no quota, and its documents take nothing
    laid = laid.join(shards.select("place", "shard", "blocks", "quota"), ["place", "shard"], "left")
    per_source = shards.select("place", "source_size", "target").distinct()
    laid = materialize(laid.join(per_source, "place", "left").fillna(0, ["source_size", "target", "blocks", "quota"]), "mix-layout")
    few = laid.where(F.col("n") <= COPIES).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    many = laid.where(F.col("n") > COPIES).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    many = many.repartition(partitions(docs.sparkSession), "source", "doc_id", "size", "lot").withColumn("copy", F.explode(F.sequence("lot", F.least(F.col("lot") + COPIES, F.col("n")) - 1))).drop("lot")
    each = few.unionByName(many).withColumn("begin", F.col("at") + F.col("copy") * F.col("size")).withColumn("end", F.col("begin") + F.col("size"))
    stride = F.get(F.array(*[F.lit(p) for p in _STRIDES]), (_hash("place", "shard") % len(_STRIDES)).cast("int"))
    each = each.withColumns({"stride": stride, "turn": _hash("shard", "place"), "whole": F.expr("quota div greatest(blocks, 1)"), "extra": F.col("quota") % F.greatest("blocks", F.lit(1))})
    b, first, end = F.lit(block_words).cast("long"), F.expr(f"begin div {block_words}"), F.expr(f"(end - 1) div {block_words}")

    def piece(i: Column) -> Column:
        lo, hi = F.greatest(i * b, F.col("begin")), F.least((i + 1) * b, F.col("end"))
        more = F.when((i * F.col("stride") + F.col("turn")) % F.col("blocks") < F.col("extra"), 1).otherwise(0)
        return F.struct((lo - F.col("begin")).alias("first"), (hi - lo).alias("words"), (F.col("whole") + more).alias("times"))

    own = F.when(F.col("size") > 0, F.filter(F.transform(F.sequence(first, end), piece), lambda p: p["times"] > 0)).otherwise(F.array().cast("array<struct<first:bigint,words:bigint,times:bigint>>"))
    each = each.withColumn("pieces", own)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["words"] * p["times"])
    return each.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "pieces")


def op13_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every row of ``documents``; see :func:`mix`."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "pieces")


def _sql_hash(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{SEED}', {', '.join(f'''coalesce({p}::VARCHAR, '')''' for p in parts)})), 1, 8))::BIGINT"


#: The same from the definitions: shares are filled source by source, and all quotients are listed and ranked.
SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
g AS MATERIALIZED (SELECT source, doc_id, size, count(*) AS n FROM d GROUP BY ALL),
s AS MATERIALIZED (SELECT source, sum(size * n)::BIGINT AS words, ceil(count(*) / {SHARD_ROWS}.0)::BIGINT AS shards, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place,
  CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END AS weight FROM g GROUP BY source),
fill(step, level) AS (SELECT 0, (SELECT sum(words)::BIGINT::DOUBLE / sum(weight)::BIGINT FROM s) UNION ALL
  SELECT step + 1, (SELECT ((SELECT sum(words) FROM s) - coalesce(sum({MAX_REPEATS} * words) FILTER ({MAX_REPEATS} * words < weight * level), 0))::BIGINT::DOUBLE / nullif(sum(weight) FILTER ({MAX_REPEATS} * words >= weight * level), 0)::BIGINT FROM s)
  FROM fill WHERE step < (SELECT count(*) FROM s)),
target AS MATERIALIZED (SELECT s.*, least({MAX_REPEATS} * words, weight * (SELECT max(level) FROM fill))::DOUBLE AS target FROM s),
p AS MATERIALIZED (SELECT g.*, place, words, target, {_sql_hash('doc_id', 'size')} % shards AS shard FROM g JOIN target t ON g.source IS NOT DISTINCT FROM t.source),
sh AS MATERIALIZED (SELECT place, shard, ceil(sum(size * n) / {BLOCK_WORDS}.0)::BIGINT AS blocks FROM p GROUP BY ALL HAVING sum(size * n) > 0),
w AS (SELECT t.place, sum(blocks)::BIGINT AS blocks, any_value(target) * sum(blocks)::BIGINT / any_value(words) AS weight FROM target t JOIN sh ON sh.place = t.place GROUP BY t.place),
q AS (SELECT place, weight / (2 * unnest(range(0, {MAX_REPEATS} * blocks)) + 1) AS quotient FROM w),
r AS (SELECT place, row_number() OVER (ORDER BY quotient DESC, place) AS r FROM q),
seats AS MATERIALIZED (SELECT w.place, any_value(blocks) AS blocks, count(r) FILTER (r <= (SELECT round(sum(weight::DECIMAL(38, 6))) FROM w)) AS seats FROM w LEFT JOIN r ON r.place = w.place GROUP BY w.place),
q2 AS (SELECT place, shard, sh.blocks, seats, seats * sh.blocks / seats.blocks / (2 * unnest(range(0, {MAX_REPEATS} * sh.blocks)) + 1) AS quotient FROM sh JOIN seats USING (place)),
r2 AS (SELECT place, shard, blocks, seats, row_number() OVER (PARTITION BY place ORDER BY quotient DESC, shard) AS r FROM q2),
quota AS MATERIALIZED (SELECT place, shard, blocks, count(*) FILTER (r <= seats) AS quota, {_sql_hash('shard', 'place')} AS turn,
  [{', '.join(map(str, _STRIDES))}][{_sql_hash('place', 'shard')} % {len(_STRIDES)} + 1] AS stride FROM r2 GROUP BY ALL),
l AS (SELECT *, sum(size * n) OVER (PARTITION BY place, shard ORDER BY {_sql_hash('size', 'doc_id')}, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size * n AS pos FROM p),
c AS MATERIALIZED (SELECT *, row_number() OVER () AS rn, (pos + copy * size)::BIGINT AS lo FROM (SELECT *, unnest(range(0, n)) AS copy FROM l)),
b AS (SELECT rn, lo, size, place, shard, unnest(range(lo // {BLOCK_WORDS}, (lo + size - 1) // {BLOCK_WORDS} + 1)) AS i FROM c WHERE size > 0),
k AS (SELECT rn, sum((least((i + 1) * {BLOCK_WORDS}, lo + size) - greatest(i * {BLOCK_WORDS}, lo)) * (quota // blocks + ((i * stride + turn) % blocks < quota % blocks)::INTEGER))::BIGINT AS taken FROM b JOIN quota USING (place, shard) GROUP BY rn)
SELECT doc_id, size, words AS source_size, target, coalesce(taken, 0) AS taken FROM c LEFT JOIN k USING (rn)
"""
