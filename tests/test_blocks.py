"""Blocks of packed k-mers tell the same as the index's rows, after one shuffle."""

import random
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.functions.kmers import sliced
from strandloom.functions.md5 import leading_bits
from strandloom.operators import blocks, distance, filters, graph, index
from tests.test_engine import seqs

RNG = random.Random(5)
BASE = "".join(RNG.choice("ACGT") for _ in range(400))


def mutated(n):
    own = list(BASE)
    for _ in range(n):
        own[RNG.randrange(len(own))] = RNG.choice("ACGTN")
    return "".join(own)


def samples(spark):
    rows = [(name, mutated(n)) for name, n in (("a", 3), ("a", 30), ("b", 8), ("c", 1), ("d", 60), ("d", 2))]
    return seqs(spark, [*rows, (None, mutated(5))]).repartition(3)


def told(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("k", [5, 15, 17, 31, 33, 63])
def test_rows_of_blocks(spark, k, monkeypatch):
    monkeypatch.setattr(blocks, "AT_ONCE", 50)
    one = index.build(samples(spark), k)
    assert told(one.rows().select("sample", *index.KEY, "mask")) == told(one.kmers.select("sample", *index.KEY, "mask"))
    assert told(one.rows(text=True)) == told(one.kmers.select("sample", bases.key_digits(k).alias("key"), "mask"))


@pytest.mark.parametrize("k", [15, 31])
def test_blocks_tell_what_rows_tell(spark, k):
    one, other = index.build(samples(spark).where("sample <> 'd'"), k), index.build(samples(spark).where("sample = 'd'"), k)
    listed = seqs(spark, [("w", BASE[50:120])])
    plain = lambda i: i.with_kmers(i.kmers)
    both = index.merge([one, other])
    made = {"weeded": index.weed(both, listed), "only": index.weed(index.delete(both, ["a"]), listed, reverse=True), "added": index.add([one, one])}
    for name, i in made.items():
        assert i.blocks is not None, name
        assert told(i.rows().select("sample", *index.KEY, "mask")) == told(i.kmers.select("sample", *index.KEY, "mask")), name
        for kind, options in ((filters.NO_CONST, {"ignore_const_gaps": True}), (filters.NO_AMBIG_OR_CONST, {"ambig_missing": True, "ambig_mask": True})):
            assert told(filters.columns(filters.apply_filters(i, kind, 0.3, **options))) == told(filters.columns(filters.apply_filters(plain(i), kind, 0.3, **options))), (name, kind)
        assert told(index.full_info(i)) == told(index.full_info(plain(i))), name
        assert told(graph.coloured_kmers(i)) == told(graph.coloured_kmers(plain(i))), name
    for f in (distance.snp_matrix, lambda i: distance.distances(i, min_freq=0.5), lambda i: distance.distances(i, allow_ambiguous=True).withColumn("distance", F.round("distance", 9))):
        assert told(f(both)) == told(f(plain(both)))


def test_columns_need_one_compact_shuffle(spark):
    plan = filters.columns(filters.apply_filters(index.build(samples(spark), 15), filters.NO_CONST, 0.5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(bucket" in plan


def test_letters_of_texts(spark):
    texts = ["", None, "Quiz-Größe, É é z!", "q" * 5, "日本 abc", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(bases.text_bases(F.col("t")).alias("b"), bases.text_quality(F.col("t")).alias("q")).collect()
    plain = [None if t is None else "".join(c for c in t if c.isascii() and c.isalpha()).lower() for t in texts]
    for name, to in (("b", "ACGTACGTACGTACGTNCGTACGTAC"), ("q", bases.LETTER_QUALITIES)):
        assert [r[name] for r in got] == [None if t is None else "".join(to[ord(c) - 97] for c in t) for t in plain]


def test_leading_bits_of_many_texts():
    rng = np.random.default_rng(4)
    for wide, n in ((0, 3), (14, 5000), (30, 4097), (55, 10), (56, 10), (62, 100), (64, 10), (130, 10)):
        texts = rng.integers(48, 52, (n, wide)).astype(np.uint8)
        assert leading_bits(texts).tolist() == [int(md5(t.tobytes()).hexdigest()[:9], 16) for t in texts]
    assert leading_bits(np.empty((0, 30), np.uint8)).tolist() == []


@pytest.mark.parametrize("k", [5, 7, 9, 15, 17, 31])
@pytest.mark.parametrize("rc", [True, False])
def test_texts_are_cut_in_steps_and_parts(k, rc, monkeypatch):
    monkeypatch.setattr(blocks, "STEP", 40)
    rng, h = random.Random(k), (k - 1) // 2
    seqs_ = ["".join(rng.choice("ACGTacgtN" if i % 3 else "ACGT") for _ in range(n)).encode() for i, n in enumerate([0, k - 1, k, k, k + 1, 90, 200, 300, 35, 400])]
    quals = [None if i % 4 == 0 else bytes(rng.choice(b"!5?I") for _ in s) for i, s in enumerate(seqs_)]
    for quality in ("none", "middle", "strict"):
        want = {}
        for w in sliced(seqs_, quals, k, rc, quality, 20, 1 << 20):
            for i, hi, lo, mask in zip(*(w[c].tolist() for c in ("seq", "key_hi", "key_lo", "mask")), strict=True):
                want[i % 3, hi, lo] = want.get((i % 3, hi, lo), 0) | mask
        texts = [blocks.Text(i % 3, s, q) for i, (s, q) in enumerate(zip(seqs_, quals, strict=True))]
        for parts in (texts, [p for t in texts for p in t.parts(60, k)]):
            (bucket, runs, words) = next(blocks._block(parts, k, rc, quality, 20))
            own = np.repeat(runs[:, 0], runs[:, 1])
            keys = blocks._keys(words, own, h)
            assert {(n, keys.hi[j], keys.lo[j]): m for j, n, m in zip(keys.key, keys.no, keys.mask, strict=True)} == want
            assert len(words) == len(want) and (np.diff(bucket) >= 0).all()
            shift = max(4 * h + 4 - blocks.BUCKET_BITS, 4)
            assert (words >> words.dtype.type(shift) == np.repeat(bucket, runs[:, 1])).all()


def test_sums_of_plain_and_ambiguous_keys_of_many_samples(spark):
    one = index.build(seqs(spark, [(f"s{i:02}", mutated(3 + i % 9)) for i in range(70)] + [("s00", mutated(40)), ("s07", mutated(40))]).repartition(3), 9)
    rows = one.with_kmers(one.kmers)
    for f in (distance.snp_matrix, distance.distances, lambda i: distance.distances(i, allow_ambiguous=True).withColumn("distance", F.round("distance", 9))):
        assert told(f(one)) == told(f(rows))


def test_added_indexes_of_different_samples_stay_blocks(spark):
    """Samples of one name are one, wherever they stand in each index's list."""
    every, half = samples(spark), []
    for own in (["a", "b"], ["b", "c", "d"]):
        half.append(index.build(every.where(F.col("sample").isin(own)), 15))
    both = index.add([half[1], half[0]])
    assert both.names == ("b", "c", "d", "a") and both.blocks is not None
    row = lambda i: told(i.rows().select("sample", *index.KEY, "mask"))
    assert row(both) == told(both.kmers.select("sample", *index.KEY, "mask"))
    more = index.add([both, index.build(seqs(spark, [("e", BASE)]), 15)])
    assert row(more) == told(more.kmers.select("sample", *index.KEY, "mask"))


@pytest.mark.parametrize("rc", [True, False])
@pytest.mark.parametrize("k", [33, 63])
def test_texts_in_place_of_long_kmers(k, rc):
    """Every key of both ways of cutting once, all its entries in one bucket, and a text that comes again only once."""
    h, rng = (k - 1) // 2, random.Random(k)
    long = "".join(rng.choice("ACGT") for _ in range(3000))
    turned = long[::-1].translate(str.maketrans("ACGT", "TGCA"))
    half = long[:h]
    palindrome = half + "A" + half[::-1].translate(str.maketrans("ACGT", "TGCA"))
    own = [(0, long), (1, turned), (0, long), (2, put_n(long, 500)), (1, "AC" * 60), (2, palindrome + "CA"), (0, ""), (3, long[:k]), (3, "N" + long[:k])]
    texts = [blocks.Text(no, s.encode(), None) for no, s in own]
    want, got, where, size = {}, {}, {}, 0
    for w in sliced([t.seq for t in texts], None, k, rc, "none", 20, 1 << 20):
        for i, hi, lo, mask in zip(*(w[c].tolist() for c in ("seq", "key_hi", "key_lo", "mask")), strict=True):
            want[own[i][0], hi, lo] = want.get((own[i][0], hi, lo), 0) | mask
    for bucket, runs, raw, places in blocks._wide_block(texts, k, rc, "none", 20):
        size += len(raw) + runs.nbytes
        keys = blocks._keys(blocks._wide_words(runs, raw, k, rc), runs[:, 0].astype(np.int64), h, runs[:, 1])
        for key, no, mask in zip(keys.key.tolist(), keys.no.tolist(), keys.mask.tolist(), strict=True):
            got[no, int(keys.hi[key]), int(keys.lo[key])] = mask
        for b, (no, n), a, z in zip(bucket.tolist(), runs, places[:-1], places[1:], strict=True):
            words = blocks._wide_words(np.array([[no, n]]), raw[a:z], k, rc)
            for hi, lo in (words >> np.uint64(2)).tolist():
                assert where.setdefault((hi, lo), b) == b
    assert got == want
    assert size < 16 * len(want) / 2


def put_n(text, at):
    return text[:at] + "N" + text[at + 1 :]
