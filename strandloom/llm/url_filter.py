"""URL filters: a rule list, and association rules mined by FP-growth.

The rule list is compared inside expressions.  Association rules (sets of URL tokens
that go with unwanted pages) are matched by an inverted index: the distinct URLs'
tokens are joined with the rules' tokens, and a rule fits a URL that has a token of
each of its items.  Everything runs as DataFrame operations.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.sources.shared import materialize

#: (verdict, host, path prefix)
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: A rule list is part of the query's expressions, so its length is bounded.
MAX_RULES = 10_000
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.6
#: Unwanted pages that a token set needs at least; in small tables this is the higher bound.
MIN_PAGES = 5
#: Rows of the index that are broadcast at most; a larger one is joined by key.
BROADCAST_ROWS = 100_000
#: Parts that the rows of one url are dealt to.
SPREAD = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_UNWANTED = "label=unwanted"


def host_of(url: Column) -> Column:
    """After the first ``://`` to the first of ``/ ? #``, ASCII lower case; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host to the first of ``? #``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict), or null.

    Equal lengths: the rule later in the alphabet.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"a rule list has at most {MAX_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    by_host: dict[str, list] = {}
    for verdict, own, prefix in rules:
        by_host.setdefault(own, []).append(F.struct(F.lit(len(own + prefix)).alias("size"), F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(prefix).alias("prefix")))
    table = F.create_map(*[x for own, group in by_host.items() for x in (F.lit(own), F.array(*group))])
    parts = F.split(host, r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fits = F.filter(F.flatten(F.filter(F.transform(ends, lambda e: F.try_element_at(table, e)), lambda g: g.isNotNull())), lambda r: F.startswith(path, r["prefix"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(best["size"].alias("size"), best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def url_tokens(url: Column) -> Column:
    """Distinct lower-case words of a URL: runs of letters, digits and hyphens."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(url, F.lit(""))), r"[^\p{L}\p{N}-]+"), lambda t: t != ""))


def _baskets(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``basket``, ``items`` (URL tokens) and ``unwanted`` of every labelled page."""
    marks = labels.select(F.col("doc_id").alias("page_id"), "toxic").where("page_id is not null and toxic is not null").groupBy("page_id").agg(F.max("toxic").alias("toxic"))
    rows = pages.select("page_id", url_tokens(F.col("url")).alias("items")).join(marks, "page_id")
    return rows.select(F.monotonically_increasing_id().alias("basket"), "items", (F.col("toxic") == 1).alias("unwanted"))


def _tokens_by_item(baskets: DataFrame, least: int) -> DataFrame:
    """``token``, ``item``, ``pages``, ``bad`` of the tokens on ``least`` unwanted pages or more.

    Tokens that stand in exactly the same baskets (told by their number and two sums of
    hashes) are one item: any set of them has the same counts, so mining them apart
    would only multiply equal rules.
    """
    mark = lambda seed: F.sum(F.xxhash64(F.lit(seed), "basket").cast("decimal(38,0)"))
    each = baskets.select("basket", "unwanted", F.explode("items").alias("token")).groupBy("token")
    counted = each.agg(F.count("*").alias("pages"), F.count_if("unwanted").alias("bad"), mark(1).alias("m1"), mark(2).alias("m2")).where(F.col("bad") >= least)
    counted = materialize(counted, "url-tokens")
    same = ["pages", "bad", "m1", "m2"]
    return counted.join(counted.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item", "pages", "bad")


def _broadcast_if_small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _pairs(pages: DataFrame, least: int, min_confidence: float) -> tuple[DataFrame, DataFrame]:
    """Sets of two items: (rules, pairs worth growing).

    ``pages`` has ``basket``, ``unwanted`` and ``found`` (sorted items, two or more).  A
    pair on as many of the wanted ones as one of its items isn't worth growing: a larger
    set with it has the same wanted pages, and no fewer unwanted ones, without the other.
    """
    tails = F.transform("found", lambda a, i: F.struct(a.alias("a"), F.slice("found", i + 2, F.size("found")).alias("tail")))
    each = pages.select("unwanted", F.explode(tails).alias("x")).select("unwanted", "x.a", F.explode("x.tail").alias("b"))
    counted = materialize(each.groupBy("a", "b").agg(F.count("*").alias("pages"), F.count_if("unwanted").alias("bad")).where(F.col("bad") >= least), "item-pairs")
    rules = counted.where(F.col("bad") / F.col("pages") >= min_confidence)
    items = materialize(pages.where(~F.col("unwanted")).select(F.explode("found").alias("item")).groupBy("item").agg(F.count("*").alias("good")), "wanted-items")
    own = lambda side: _broadcast_if_small(items.select(F.col("item").alias(side), F.col("good").alias(f"good_{side}")))
    rest = counted.where(F.col("bad") / F.col("pages") < min_confidence).join(own("a"), "a").join(own("b"), "b").where("pages - bad < least(good_a, good_b)")
    return rules, materialize(rest.select("a", "b"), "open-pairs")


def _longer(pages: DataFrame, pairs: DataFrame, least: int, min_confidence: float) -> DataFrame:
    """``items``, ``pages``, ``bad`` of rules of three items or more, by FP-growth.

    Every page gives a basket for each of its items, of the later items that pair with
    it; an element is named by both, so that one run mines each item's baskets apart
    and no set with a settled pair is grown.
    """
    tails = F.transform("found", lambda a, i: F.struct(a.alias("a"), F.slice("found", i + 2, F.size("found")).alias("tail")))
    each = pages.select("basket", "unwanted", F.explode(tails).alias("x")).select("basket", "unwanted", "x.a", F.explode("x.tail").alias("b"))
    kept = each.join(_broadcast_if_small(pairs), ["a", "b"]).groupBy("basket", "a").agg(F.first("unwanted").alias("unwanted"), F.collect_set(F.concat_ws(" ", "a", "b")).alias("found")).where("size(found) > 1")
    label = F.when(F.col("unwanted"), F.array(F.lit(_UNWANTED))).otherwise(F.array().cast("array<string>"))
    rows = materialize(kept.select(F.concat("found", label).alias("items")), "item-baskets")
    n = rows.count()
    if not n:
        return pages.sparkSession.createDataFrame([], "items array<string>, pages long, bad long")
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n)).fit(rows).freqItemsets
    plain = F.array_sort(F.filter("items", lambda i: i != _UNWANTED))
    counts = sets.select(plain.alias("found"), "freq", F.array_contains("items", _UNWANTED).alias("label")).where("size(found) > 1").groupBy("found").agg(F.max(F.when(~F.col("label"), F.col("freq"))).alias("pages"), F.max(F.when(F.col("label"), F.col("freq"))).alias("bad"))
    parts = F.transform("found", lambda i: F.split(i, " "))
    return counts.where(F.col("bad") / F.col("pages") >= min_confidence).select(F.concat(F.array(parts[0][0]), F.transform(parts, lambda x: x[1])).alias("items"), "pages", "bad")


def mine_rules(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """Sets of URL tokens that go with unwanted pages: (rules, tokens).

    Rules: ``rule_id``, ``items``, ``confidence``, ``support``.  Tokens: ``token``,
    ``item``; a rule fits a URL that has a token of each of its items.  A page is
    unwanted if a row of ``labels`` with its id (``doc_id``) has toxic = 1; all
    labelled pages count.  A rule needs ``min_support`` of these and ``min_pages``.
    Where a rule fits, so do the rules among its parts, so sets that hold a rule of one
    item or two aren't grown, and neither is a set with an item that excludes no wanted
    page; both leave what some rule fits as it is.  A rule is dropped if it is one
    without one of its items as well.  Without labelled pages there are no rules.
    """
    baskets = materialize(_baskets(pages, labels), "baskets")
    n, wanted = baskets.agg(F.count("*"), F.count_if(~F.col("unwanted"))).first()
    least = max(1, min_pages, math.ceil(min_support * n - 1e-9))
    tokens = materialize(_tokens_by_item(baskets, least), "url-items")
    single = tokens.groupBy("item").agg(F.first("pages").alias("pages"), F.first("bad").alias("bad"))
    confident = F.col("bad") / F.col("pages") >= min_confidence
    found = single.where(confident).select(F.array("item").alias("items"), "pages", "bad")
    open_ = materialize(single.where(~confident & (F.col("pages") - F.col("bad") < wanted)).select("item"), "open-items")
    if open_.limit(1).count():
        names = _broadcast_if_small(materialize(tokens.select("token", "item").join(open_, "item"), "open-tokens"))
        items = baskets.select("basket", "unwanted", F.explode("items").alias("token")).join(names, "token").groupBy("basket", "unwanted").agg(F.array_sort(F.collect_set("item")).alias("found"))
        rows = materialize(items.where("size(found) > 1"), "open-baskets")
        two, grown = _pairs(rows, least, min_confidence)
        found = found.unionByName(two.select(F.array("a", "b").alias("items"), "pages", "bad"))
        if grown.limit(1).count():
            found = found.unionByName(_longer(rows, grown, least, min_confidence))
    rules = materialize(found.select(F.xxhash64("items").alias("rule_id"), "items", (F.col("bad") / F.col("pages")).alias("confidence"), (F.col("bad") / F.lit(n)).alias("support")), "association-rules")
    return _without_redundant(rules), tokens.select("token", "item")


def _index(rules: DataFrame) -> DataFrame:
    return rules.select("rule_id", F.size("items").alias("needed"), "confidence", F.explode("items").alias("item"))


def _without_redundant(rules: DataFrame) -> DataFrame:
    """Rules that are no rule any more without any one of their items (each part is looked up by its own key)."""
    parts = rules.where("size(items) > 1").select("rule_id", F.explode(F.transform("items", lambda _, i: F.filter("items", lambda _, j: i != j))).alias("part"))
    held = parts.join(rules.select(F.col("items").alias("part")), "part").select("rule_id").distinct()
    return rules.join(held, "rule_id", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """``url`` and ``confidence`` (the best rule's) of the distinct urls that a rule fits."""
    index = materialize(_index(rules).join(items, "item"), "rule-index")
    small = index.count() <= BROADCAST_ROWS
    tokens = urls.select("url").where("url is not null").distinct().select("url", F.explode(url_tokens(F.col("url"))).alias("token"))
    hits = tokens.join(F.broadcast(index) if small else index, "token").groupBy("url", "rule_id").agg(F.size(F.collect_set("item")).alias("n"), F.first("needed").alias("needed"), F.first("confidence").alias("confidence"))
    return materialize(hits.where("n = needed").groupBy("url").agg(F.max("confidence").alias("confidence")), "matched-urls")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every row of ``pages``.

    The longest list rule that fits decides; without one, a page that an association
    rule fits is blocked and any other is allowed.  Null urls and urls without ``://``
    have empty host and path and are allowed unless a rule says otherwise; repeated
    rows come back once each; other columns play no part.
    """
    mined, items = mine_rules(pages, labels, min_support, min_confidence, min_pages)
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("best", rule_for(F.col("host"), F.col("path"), rules))
    if mined.limit(1).count():
        spread = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt")  # a frequent url meets its match in several tasks
        rows = rows.withColumn("salt", (F.monotonically_increasing_id() % SPREAD).cast("int")).join(match_rules(pages, mined, items).select("*", spread), ["url", "salt"], "left")
    else:
        rows = rows.withColumn("confidence", F.lit(None).cast("double"))
    verdict = F.when(F.col("best").isNotNull(), F.col("best.verdict")).when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every page; see :func:`judge`."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _sql_rules() -> str:
    return ", ".join(f"('{verdict}', '{host}', '{prefix}')" for verdict, host, prefix in RULES)


#: The same by brute force: all sets of tokens of all labelled URLs are counted.
SQL = rf"""
WITH rule(verdict, own, prefix) AS (VALUES {_sql_rules()}),
p AS MATERIALIZED (SELECT row_number() OVER () AS r, page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
  list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(url, '')), '[^\p{{L}}\p{{N}}-]+'), lambda t: t <> ''))) AS tokens FROM pages),
fit AS (SELECT r, max(struct_pack(size := length(own || prefix), rule := own || prefix, verdict := verdict)) AS best FROM p, rule WHERE (host = own OR ends_with(host, '.' || own)) AND starts_with(path, prefix) GROUP BY r),
mark AS (SELECT doc_id, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
part AS MATERIALIZED (SELECT r, page_id, array_to_string(list_filter(tokens, lambda t, i: (m >> (i - 1)::INTEGER) & 1 = 1), ' ') AS k FROM (SELECT *, unnest(range(1, 1 << len(tokens)::INTEGER)) AS m FROM p)),
n AS (SELECT count(*) AS n FROM p JOIN mark ON page_id = doc_id),
mined AS (SELECT k FROM part JOIN mark ON page_id = doc_id, n GROUP BY k, n
  HAVING count(*) FILTER (toxic = 1) >= greatest({MIN_PAGES}, ceil({MIN_SUPPORT} * n - 1e-9)) AND count(*) FILTER (toxic = 1) / count(*)::DOUBLE >= {MIN_CONFIDENCE}),
hit AS (SELECT DISTINCT r FROM part JOIN mined USING (k))
SELECT page_id, host, path, best.rule AS rule, CASE WHEN best IS NOT NULL THEN best.verdict WHEN hit.r IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict FROM p LEFT JOIN fit USING (r) LEFT JOIN hit USING (r)
"""
