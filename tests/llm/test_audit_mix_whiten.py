"""Whitening, the filter audit and the mix against brute force, on tables with the awkward cases."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import filter_audit, mixing, whitening
from strandloom.sources.shared import materialize


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(n, seed, vocabulary=200):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


TEXTS = [
    (0, prose(80, 1), "a"), (1, None, "a"), (2, "", "b"), (3, " \n\t\x0b\x0c\r ", "b"), (4, prose(80, 1), "b"), (5, prose(80, 1), "a"), (4, prose(80, 1), "b"), (None, prose(80, 1), "a"), (6, prose(3000, 2, 9000), None),
    (7, "UP " + prose(60, 3), ""), (8, "SHOUT " * 60, "c"), (9, prose(60, 4) + " 5 % off", "c"), (10, "日本語 é \x1c x", "c"), (11, "a " * 70, "c"), (None, None, None), (12, prose(49, 5), "a"), (13, prose(50, 5), "a"), (5, prose(80, 6), "a"),
]
COLUMNS = "doc_id long, text string, source string, mask int, n long, part string, size long, place int, shard int, quality string"


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame([(i, t, s, 1, 2, "p", 3, 4, 5, "q") for i, t, s in TEXTS], COLUMNS).repartition(3), "docs")


@pytest.fixture(scope="module")
def labels(spark):
    told = [(0, 1, 0), (4, 1, 1), (4, 0, 0), (5, None, 1), (8, 0, 1), (11, 1, None), (None, 1, 1), (99, 1, 1), (2, 1, 0)]
    return spark.createDataFrame([(*t, "m") for t in told], "doc_id long, quality int, toxic int, mask string")


# 12


def fails(at):
    i, t, _ = TEXTS[at]
    t = t or ""
    own = words(t)
    out = {"A": len(own) < 50, "B": 100 * len(set(own)) < 65 * len(own), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t))}
    out["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in TEXTS)
    return {f for f, bad in out.items() if bad}


def audit_by_hand(good, toxic):
    want = []
    for part in {s or "" for _, _, s in TEXTS}:
        own = [(fails(k), TEXTS[k][0]) for k in range(len(TEXTS)) if (TEXTS[k][2] or "") == part]
        lost, lines = dict.fromkeys("ABCDE", 0), []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone, left, before = [d for d in left if f in d[0]], [d for d in left if f not in d[0]], left
                lost[f] += len(gone)
                lines.append((part, "".join(order), step, len(left), len(gone), sum(f in d[0] for d in own) - sum(f in d[0] for d in before), sum(d[0] == {f} for d in own), sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone)))
        want += [(*line, lost[line[1][line[2] - 1]]) for line in lines]
    return sorted(want, key=repr)


def test_filter_audit(docs, labels, tmp_path, spark):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = filter_audit.op12_filter_audit(spark, str(tmp_path))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert rows(got) == audit_by_hand({0, 4, 11, 2}, {4, 5, 8})
    assert filter_audit.audit(filter_audit.mask_counts(docs.where("false"), labels)).count() == 0
    none = filter_audit.audit(filter_audit.mask_counts(docs, labels.where("false")))
    assert none.agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_audit_of_other_filters(spark):
    masks = spark.createDataFrame([("x", 3, 5, 1, 0), ("x", 1, 2, 0, 0), ("x", 0, 4, 4, 0)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in filter_audit.audit(masks, "PQ").collect()}
    assert got == {("PQ", 1): (4, 7, 0, 2, 1, 9), ("PQ", 2): (4, 0, 5, 0, 0, 5), ("QP", 1): (6, 5, 0, 0, 1, 5), ("QP", 2): (4, 2, 5, 2, 0, 9)}
    with pytest.raises(ValueError, match="filters"):
        filter_audit.survivors(masks, "ABCDEFGH")


# 13


def highest_quotients(weights, most, seats):
    quota = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i in range(len(weights)) if quota[i] < most[i]]
        if not open_:
            break
        quota[max(open_, key=lambda i: (weights[i] / (2 * quota[i] + 1), -i))] += 1
    return quota


def test_apportionment(spark):
    rng, parties, want = random.Random(3), [], {}
    for g in range(60):
        n, seats = rng.randint(1, 9), rng.choice([0, 1, 5, 40, 400])
        raw = [rng.choice([1, 1, 2, 3, rng.random() * 50]) for _ in range(n)]
        weights = [w * seats / sum(raw) for w in raw]
        most = [max(1, int(w * rng.choice([1.3, 3, 9])) + 1) for w in weights]
        want |= {(g, i): q for i, q in enumerate(highest_quotients(weights, most, seats))}
        parties += [(g, i, w, m, seats) for i, (w, m) in enumerate(zip(weights, most, strict=True))]
    told = spark.createDataFrame(parties, "g int, i int, weight double, most long, seats long")
    got = {(r.g, r.i): r.quota for r in mixing.apportion(told, ["g"], "i", F.col("seats")).collect()}
    assert got == want


def level_by_hand(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight, left, shares = {s: i % 3 + 1 for i, s in enumerate(order)}, sum(sizes.values()), {}
    while True:
        level = left / max(1, sum(w for s, w in weight.items() if s not in shares))
        over = [s for s in order if s not in shares and weight[s] * level > 3 * sizes[s]]
        if not over:
            return {s: shares.get(s, weight[s] * level) for s in order}
        for s in over:
            shares[s] = 3.0 * sizes[s]
            left -= 3 * sizes[s]


def mixed(spark, docs, path):
    docs.write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return rows(mixing.op13_mixing(spark, path).select("doc_id", "size", "source_size", F.round("target", 6), "taken"))


@pytest.mark.parametrize("shard_rows", [20_000, 3])
def test_mix(spark, docs, tmp_path, monkeypatch, shard_rows):
    monkeypatch.setattr(mixing, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(mixing, "COPIES", 4)
    monkeypatch.setattr(mixing.quotas, "__defaults__", (mixing.BLOCK_WORDS, shard_rows))
    monkeypatch.setattr(mixing.mix, "__defaults__", (mixing.BLOCK_WORDS, shard_rows))
    same = spark.createDataFrame([(70, prose(45, 9), "d")] * 23 + [(71 + i, prose(30 + i, i), "d") for i in range(40)] + [(200, "", "e"), (201, None, "e")], "doc_id long, text string, source string")
    docs = docs.select("doc_id", "text", "source").unionByName(same)
    got = mixed(spark, docs, str(tmp_path))
    all_rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert sorted(r[:2] for r in got if r[0] is not None) == sorted((i, len(words(t))) for i, t, _ in all_rows if i is not None) and len(got) == len(all_rows)
    sizes = {s: sum(len(words(t)) for _, t, x in all_rows if x == s) for s in {s for _, _, s in all_rows}}
    goal, source = level_by_hand(sizes), {}
    for i, t, s in all_rows:
        source.setdefault((i, len(words(t))), set()).add(s)
    told = {}
    for r in mixing.mix(docs).collect():
        told.setdefault(r.source, []).append(r)
        assert r.taken == sum(p.words * p.times for p in r.pieces) <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - goal[r.source]) < 1e-6
        assert all(0 <= p.first and p.first + p.words <= r.size and p.words <= mixing.BLOCK_WORDS and 1 <= p.times <= 3 for p in r.pieces)
    for s, own in told.items():
        assert abs(sum(r.taken for r in own) - goal[s]) <= 3 * mixing.BLOCK_WORDS * (1 if shard_rows > 100 else 8), s
    assert got == mixed(spark, docs.repartition(5), str(tmp_path)) == mixed(spark, docs.coalesce(1), str(tmp_path))
    if shard_rows > 100:  # the SQL has the production parameters
        view = duckdb.connect()
        view.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = view.sql(f"SELECT doc_id, size, source_size, round(target, 6) AS target, taken FROM ({mixing.SQL})").fetchall()
        assert sorted(want, key=repr) == got
    assert mixing.mix(docs.where("false")).count() == 0


# 11


def embeddings(spark, n=700, dims=20, seed=0, rank=None):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, rank or dims)) @ rng.normal(size=(rank or dims, dims)) if rank else rng.normal(size=(n, dims)) * np.linspace(0.2, 3, dims)
    base[: n // 3] = base[0]  # a third of all rows is one vector
    own = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    odd = [(None, own[5][1]), (5, own[5][1]), (9001, None), (9002, []), (9003, [1.0] * (dims + 1)), (9004, [float("nan")] + [1.0] * (dims - 1)), (9005, [float("-inf")] + [1.0] * (dims - 1)), (9006, [None] + [1.0] * (dims - 1)), (9007, [1e30] + [1.0] * (dims - 1))]
    return base, spark.createDataFrame([(*r, 1, "x") for r in own + odd], "vec_id long, embedding array<double>, n int, x string").repartition(7)


@pytest.mark.parametrize("fan_in", [2, 8])
def test_whitening(spark, fan_in):
    base, table = embeddings(spark)
    got = whitening.whiten(table, fan_in=fan_in).toPandas()
    x = np.floor(64 * base).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = (fit * n - s) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1][:16], v[:, ::-1][:, :16]
    share = e / np.trace(centred.T @ centred / n)
    want = {i: (x[i] - s / n) @ v / np.sqrt(e) for i in range(len(x))}
    assert sorted(got.vec_id.dropna().astype(int).unique()) == list(range(len(x))) and len(got) == 16 * (len(x) + 2)
    assert (got.groupby("vec_id").size() == 16).sum() == len(x) - 1 and (got.vec_id == 5).sum() == 32 and got.vec_id.isna().sum() == 16
    flips = None
    for i in (0, 5, 300, 699):
        own = got[got.vec_id == i].drop_duplicates("component").sort_values("component")
        assert (own.n == n).all() and (own.deviation == int(((n * x[i] - s) ** 2).sum())).all()
        assert np.allclose(own.explained, share, rtol=1e-9) and np.allclose(np.abs(own.whitened), np.abs(want[i]), atol=1e-9)
        signs = np.sign(own.whitened.to_numpy() * want[i])
        assert flips is None or (signs == flips).all()
        flips = signs
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening_of_few_directions(spark):
    _, table = embeddings(spark, dims=20, rank=3)
    assert whitening.whiten(table).agg(F.max("component")).first()[0] == 16  # floors aren't of low rank
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    told = whitening.whiten(flat).collect()
    assert {r.component for r in told} == {1} and all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in told)
    assert whitening.whiten(table.where("false")).count() == 0
    assert whitening.whiten(table.where("vec_id = 3")).count() == 0  # one distinct vector
    assert whitening.whiten(table.where("vec_id > 9000 and vec_id <> 9003")).count() == 0


def test_whitening_beyond_a_long(spark):
    table = spark.createDataFrame([(i, [1e10 * i, float(i % 3)]) for i in range(300)], "vec_id long, embedding array<double>")
    got = whitening.whiten(table).toPandas()
    x = [(int(64e10) * i + 1_000_000, 64 * (i % 3) + 1_000_000) for i in range(300)]
    s = [sum(c) for c in zip(*x, strict=True)]
    exact = {i: sum((300 * a - b) ** 2 for a, b in zip(x[i], s, strict=True)) for i in range(300)}
    assert all((d != d or d is None) if exact[i] >= 1 << 63 else int(d) == exact[i] for i, d in zip(got.vec_id, got.deviation, strict=True))
    assert set(got.component) == {1, 2} and got.identity_error.iloc[0] < 1e-4
