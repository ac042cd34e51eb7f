"""Many samples: names are data, so plans don't grow with them."""

from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.operators import filters, index, refmap
from strandloom.sources.shared import materialize
from tests.test_engine import BASE, put, seqs


def of(spark, n):
    """``n`` samples of 40 bases; every seventh has another base in the middle."""
    rows = [(f"s{i:05d}", put(BASE[:40], 20, "A" if BASE[20] != "A" else "C") if i % 7 == 0 else BASE[:40]) for i in range(n)]
    return index.build(seqs(spark, rows), 15)


def plan(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_plans_of_many_samples(spark):
    few, many = of(spark, 5), of(spark, 5000)
    ref = refmap.reference(spark.createDataFrame([("c", BASE[:60])], "chrom string, seq string"), 15)
    for f in (filters.columns, index.full_info, lambda i: refmap.vcf(i, ref)):
        assert abs(plan(f(many)) - plan(f(few))) < 200
    stored = many.with_kmers(materialize(many.kmers, "many"))
    told = {r.bases for r in filters.columns(stored).collect()}
    assert {len(b) for b in told} == {5000} and any(b.count("-") == 0 and len(set(b)) == 2 for b in told) and any(b.count("-") > 4000 for b in told)
    assert {r.bases.count(",") for r in index.full_info(stored).collect()} == {4999}
    (site,) = refmap.vcf(stored, ref).where("alt <> '.'").collect()
    assert site.pos == 21 and site.gt.split("\t") == ["1" if i % 7 == 0 else "0" for i in range(5000)]


def test_saved_buckets_need_no_shuffle(spark, tmp_path):
    one = of(spark, 4)
    other = index.build(seqs(spark, [("x", BASE[10:80]), ("y", BASE[:50])]), 15)
    for i, name in ((one, "one"), (other, "two")):
        index.save(i, f"{tmp_path}/{name}")
    tables = spark.catalog.listTables()
    a, b = index.load(spark, f"{tmp_path}/one"), index.load(spark, f"{tmp_path}/two")
    assert not any(t.name.startswith("strandloom") for t in tables + spark.catalog.listTables())
    assert (a.names, b.names) == (one.names, other.names)
    same = lambda x, y: sorted(map(tuple, x.collect())) == sorted(map(tuple, y.collect()))
    assert same(a.kmers.select("sample", *index.KEY, "mask"), one.kmers.select("sample", *index.KEY, "mask"))
    filtered = filters.apply_filters(a, filters.NO_FILTER, 0.5)
    assert "Exchange hashpartitioning" not in filtered.kmers._jdf.queryExecution().executedPlan().toString()
    assert same(filters.columns(filtered), filters.columns(filters.apply_filters(one, filters.NO_FILTER, 0.5)))
    both = a.kmers.join(b.kmers.select(*index.KEY, F.col("mask").alias("m")), index.KEY).hint("merge")
    assert "Exchange hashpartitioning" not in both._jdf.queryExecution().executedPlan().toString()
    assert same(filters.columns(index.merge([a, b])), filters.columns(index.merge([one, other])))
    weeded = spark.createDataFrame([("w", BASE[:30])], "chrom string, seq string")
    assert same(index.weed(a, weeded).kmers.select("sample", *index.KEY), index.weed(one, weeded).kmers.select("sample", *index.KEY))
    assert bases.check_k(a.k) == 15
