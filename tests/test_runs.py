"""Mapping by runs against a grid of every sample and position."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions.bases import CODES
from strandloom.operators import index, refmap

COMPLEMENT = str.maketrans("ACGT", "TGCA")
MASKS = {"A": 1, "C": 2, "G": 4, "T": 8}


def keys(seq, k):
    """(middle's place, key, mask, reversed) of each window; windows at a sequence's lone end give none."""
    h = k // 2
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k]
        if "N" in w or (i == len(seq) - k and (i == 0 or seq[i - 1] == "N")):
            continue
        order = lambda s: ["ACTG".index(c) for c in s[:h] + s[h + 1 :]]
        r = w[::-1].translate(COMPLEMENT)
        flip = order(w) > order(r)
        own = r if flip else w
        same = order(w) == order(r)
        mask = (9 if w[h] in "AT" else 6) if same else MASKS[own[h]]
        yield i + h, own[:h] + "." + own[h + 1 :], mask, flip


def complement(mask):
    return int(f"{mask:04b}"[::-1], 2)


def grid(samples, contigs, k, ambig_mask, repeat_mask):
    """{sample: {chrom: letters}} by the definition."""
    h, told, count, masked = k // 2, {}, {}, set()
    for chrom, seq in contigs:
        for pos, key, _, flip in keys(seq, k):
            count.setdefault(key, []).append((chrom, pos))
    for places in count.values():
        if len(places) > 1:
            masked |= {(c, p + d) for c, p in places for d in range(-h, h + 1)}
    for sample, seqs in samples.items():
        own = {}
        for seq in seqs:
            for _, key, mask, _ in keys(seq, k):
                own[key] = own.get(key, 0) | mask
        told[sample] = {}
        for chrom, seq in contigs:
            letters, covered = {}, set()
            for pos, key, _, flip in keys(seq, k):
                if key in own:
                    covered |= set(range(pos - h, pos + h + 1))
                    mask = complement(own[key]) if flip else own[key]
                    letters[pos] = "N" if ambig_mask and mask.bit_count() > 1 else CODES[mask]
            told[sample][chrom] = "".join(("N" if repeat_mask and (chrom, p) in masked else letters.get(p, seq[p])) if p in covered else "-" for p in range(len(seq)))
    return told


def sites(told, contigs, names):
    plain = lambda c: c if c in "ACGT" else "N"
    for chrom, seq in contigs:
        for p, base in enumerate(seq):
            column = [told[n][chrom][p] for n in names]
            if all(c == base for c in column):
                continue
            alts = []
            for c in column:
                if c != "-" and plain(c) != plain(base) and plain(c) not in alts:
                    alts.append(plain(c))
            gt = ["." if c == "-" else "0" if plain(c) == plain(base) else str(1 + alts.index(plain(c))) for c in column]
            yield chrom, p + 1, plain(base), ",".join(alts) or ".", "\t".join(gt)


def case(seed):
    """Contigs with repeats, unknown bases and palindromes; samples with changes, gaps, several bases a key, and one that maps nowhere."""
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    one = text(70)
    palindrome = "ACGGT" + "A" + "ACCGT"
    contigs = [(0, one + palindrome + text(30)), (1, ""), (2, text(20) + "N" + one[10:32] + text(25)), (3, "ACG")]
    changed = lambda s, n: "".join(rnd.choice("ACGT") if rnd.random() < n else c for c in s)
    samples = {
        "all": [s for _, s in contigs], "far": ["T" * 60],
        "few": [changed(s, 0.04) for _, s in contigs], "two": [s for _, s in contigs] + [changed(s, 0.06) for _, s in contigs],
        "cut": [contigs[0][1][5:40], contigs[2][1][30:60]],
    }
    return samples, contigs


@pytest.mark.parametrize(("seed", "k", "size"), [(1, 11, 16), (2, 7, 1 << 12), (4, 5, 8)])
def test_runs_by_brute_force(spark, monkeypatch, seed, k, size):
    monkeypatch.setattr(refmap, "SLICE", size)
    samples, contigs = case(seed)
    rows = [(n, i, s) for n, seqs in samples.items() for i, s in enumerate(seqs)]
    one = index.build(spark.createDataFrame(rows, "sample string, rec_no long, seq string"), k)
    ref = refmap.reference(spark.createDataFrame(contigs, "chrom int, seq string"), k)
    for ambig, repeats in ((False, False), (True, True), (False, True)):
        told = grid(samples, contigs, k, ambig, repeats)
        got = {(r.sample, r.chrom): r.seq for r in refmap.by_contig(one, ref, ambig, repeats).collect()}
        assert got == {(n, c): s for n, own in told.items() for c, s in own.items()}
        found = sorted(tuple(r) for r in refmap.vcf(one, ref, ambig, repeats).collect())
        assert found == sorted(sites(told, contigs, one.names))
    share = {r.sample: r.covered for r in refmap.map_coverage(one, ref).collect()}
    assert share == {n: sum(len(s) - s.count("-") for s in own.values()) for n, own in grid(samples, contigs, k, False, False).items()}


def test_rows_are_runs_and_differences(spark):
    """A sample that has all of a contig of 20,000 letters but three is a row a slice, with three differences."""
    rnd = random.Random(5)
    seq = "".join(rnd.choice("ACGT") for _ in range(20_000))
    other = list(seq)
    for p in (100, 5000, 19_000):
        other[p] = seq[p].translate(COMPLEMENT)
    one = index.build(spark.createDataFrame([("a", 0, seq), ("b", 0, "".join(other))], "sample string, rec_no long, seq string"), 31)
    ref = refmap.reference(spark.createDataFrame([(0, seq)], "chrom int, seq string"), 31)
    rows = refmap.runs(one, ref).select("sample", F.size("diffs").alias("n")).collect()
    assert len(rows) == 10 and sum(r.n for r in rows if r.sample == "b") == 3 and sum(r.n for r in rows if r.sample == "a") == 0
    assert [(r.pos, r.gt) for r in refmap.vcf(one, ref).orderBy("pos").collect()] == [(101, "0\t1"), (5001, "0\t1"), (19_001, "0\t1")]


def test_no_hits_and_lower_case(spark):
    rows = spark.createDataFrame([("a", 0, "ACGTTGCAACGGTCA"), ("b", 0, None)], "sample string, rec_no long, seq string")
    one = index.build(rows, 7, names=["a", "b"])
    ref = refmap.reference(spark.createDataFrame([(0, "ttttttttttttttttt"), (1, "acgttgcaacggtca")], "chrom int, seq string"), 7)
    got = {(r.sample, r.chrom): r.seq for r in refmap.by_contig(one, ref).collect()}
    assert got["b", 1] == "-" * 15 and got["a", 0] == "-" * 17 and got["a", 1].upper() == "ACGTTGCAACGGTCA"
    empty = refmap.reference(spark.createDataFrame([], "chrom int, seq string"), 7)
    assert refmap.vcf(one, empty).count() == 0 and refmap.by_contig(one, empty).count() == 0


def test_long_references_are_not_broadcast(spark, monkeypatch):
    samples, contigs = case(1)
    one = index.build(spark.createDataFrame([(n, i, s) for n, seqs in samples.items() for i, s in enumerate(seqs)], "sample string, rec_no long, seq string"), 11)
    ref = refmap.reference(spark.createDataFrame(contigs, "chrom int, seq string"), 11)
    small = sorted(map(tuple, refmap.hits(one, ref).collect()))
    monkeypatch.setattr(refmap, "BROADCAST_BASES", 0)
    rows = refmap.hits(one, ref)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan and sorted(map(tuple, rows.collect())) == small
