"""Sequences dealt by their nodes tell the same of the graph as all coloured k-mers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.functions.kmers import sliced
from strandloom.operators import blocks, graph, index, planes, strands
from tests.test_engine import rc, seqs

RNG = random.Random(11)
BASE = "".join(RNG.choice("ACGT") for _ in range(500))


def mutated(n, low=0, high=500):
    own = list(BASE[low:high])
    for _ in range(n):
        own[RNG.randrange(len(own))] = RNG.choice("ACGTN")
    return "".join(own)


def samples(spark, n=6):
    rows = [(f"s{i % n:03d}", mutated(RNG.choice((0, 1, 4)), RNG.randrange(200), 300 + RNG.randrange(200))) for i in range(n + 9)]
    return seqs(spark, [*rows, ("s000", rc(BASE)), ("s001", "ACGT" * 9 + "ACGTACGT"), ("s002", "AT" * 20 + "A"), (None, mutated(30))]).repartition(3)


def told(df):
    return sorted(map(str, df.collect()))


def node_sets(spark, one):
    return graph.edges(graph.coloured_kmers(one), one.k)


@pytest.mark.parametrize(("k", "n", "both"), [(5, 3, True), (15, 6, False), (31, 6, True), (31, 70, True), (63, 6, True)])
def test_strands_tell_what_coloured_kmers_tell(spark, k, n, both, monkeypatch):
    monkeypatch.setattr(strands, "STRETCH", 50)
    monkeypatch.setattr(strands, "AT_ONCE", 30)
    one = index.build(samples(spark, n).localCheckpoint(), k, both)
    own, edges, h = one.strands(), node_sets(spark, one).localCheckpoint(), (k - 1) // 2
    assert told(own.entry_nodes()) == told(graph.entry_nodes(graph.nodes(edges, k)).select("hi", "lo"))
    sets = [c for c in edges.columns if c[0] == "s" and c[1:].isdigit()]
    text = edges.select(planes.size(sets).alias("n"), graph.node_text(h, "src_hi", "src_lo").alias("src"), graph.node_text(h, "dst_hi", "dst_lo").alias("dst"))
    want = text.groupBy("n").agg(F.count("*").alias("n_edges"), F.count_distinct("src").alias("n_src"), F.min("src").alias("src"), F.max("dst").alias("dst"))
    got = own.edge_counts().select("n_samples", "n_edges", "n_src", graph.node_text(h, "src_hi", "src_lo").alias("src"), graph.node_text(h, "dst_hi", "dst_lo").alias("dst"))
    assert sorted(map(tuple, got.groupBy("n_samples").agg(F.sum("n_edges"), F.sum("n_src"), F.min("src"), F.max("dst")).collect())) == sorted(map(tuple, want.collect()))
    colours = graph.coloured_kmers(one).localCheckpoint()
    full = F.concat(bases.arm_bases(F.col("key_hi"), h), F.substr(F.lit(bases.DIGITS), F.col("b") + 1, F.lit(1)), bases.arm_bases(F.col("key_lo"), h))
    asked = colours.where(F.pmod(F.xxhash64("key_hi", "key_lo", "b"), F.lit(3)) == 0)
    palindrome = asked.select("key_hi", "key_lo").distinct()  # both bases of palindromic arms are one k-mer
    want = told(asked.select("key_hi", "key_lo", "b", *sets))
    got = own.of(asked.select(full.alias("t")).unionByName(spark.createDataFrame([("A" * k,)], "t string")))
    both_ways = bases.with_revcomp(palindrome, h, r_hi="key_lo", r_lo="key_hi").where("key_hi = r_hi and key_lo = r_lo").select("key_hi", "key_lo")
    plain = got.join(both_ways, ["key_hi", "key_lo"], "left_anti").select("key_hi", "key_lo", "b", *sets)
    assert set(told(plain)) == set(told(asked.join(both_ways, ["key_hi", "key_lo"], "left_anti").select("key_hi", "key_lo", "b", *sets))) and set(want) <= set(told(got.select("key_hi", "key_lo", "b", *sets)))


@pytest.mark.parametrize(("k", "n"), [(11, 4), (31, 6)])
def test_paths_of_strands(spark, k, n, monkeypatch):
    monkeypatch.setattr(strands, "STRETCH", 40)
    one = index.build(samples(spark, n).localCheckpoint(), k)
    a, b = (graph.paths(i, 3).select("entry", "exit", "seq", "n_nodes", F.array_sort("marks").alias("m")) for i in (one, one.with_kmers(one.kmers)))
    a = told(a)
    assert a == told(b) and a


def test_graph_of_sequences_needs_one_shuffle_of_texts(spark):
    own = index.build(samples(spark), 31).strands()
    plan = own.entry_nodes()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(bucket" in plan


def test_stretches_are_the_runs_of_kmers():
    rng, k = random.Random(3), 9
    for own in ("", "ACGTACGT", "ACGTACGTA", "ACGTACGTAC", *("".join(rng.choice("ACGTACGTACGTACGTACGTN") for _ in range(n)) for n in (50, 200, 333))):
        want = {w["start"][i] for w in sliced([own.encode()], None, k, True, "none", 20, 1 << 20) for i in range(len(w["start"]))}
        for size in (1000, 40):
            got, at = set(), 0
            for text in blocks.Text(0, own.encode(), None).parts(size, k):
                kept = blocks.starts([text], k, "none", 20)[1]
                got |= {at + int(i) - text.skip for i in kept.nonzero()[0]}
                at += size
            assert got == want
    for n in range(9):
        digits = np.array([rng.randrange(4) for _ in range(n)], np.uint8)
        assert strands._unpacked(strands._packed(digits))[:n].tolist() == digits.tolist() and len(strands._packed(digits)) == -(-n // 4)
