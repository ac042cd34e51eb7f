"""Each operator against brute force on small tables that hold the awkward cases:
nulls, empty and long texts, ties, repeated rows, extra columns with clashing names,
and empty tables."""

import hashlib
import itertools
import random
import re
import time
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strandloom.llm import bktree, decontaminate, language, neighbours, packing, pii, simhash, substring, token_counts, tokens, url_filter, wavelet
from strandloom.sources.shared import materialize

random.seed(4)
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
VOCABULARY = "the of and river stone Ünder café naïve 42 it's don't well-known end. x y über".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", ",", "er", "ing"]) for _ in range(n))


SHARED = prose(60, 99)
TEXTS = [
    (0, prose(30, 1)), (1, None), (2, ""), (3, "   \n\t "), (4, prose(3000, 2)), (5, prose(40, 3) + " " + SHARED), (6, SHARED + "\n" + prose(25, 4)), (7, prose(40, 3) + " " + SHARED),
    (8, "日本語 ﬁne Σίσυφος <|endoftext|> e\u0301 \x1c z"), (9, "a a a a a a a a a a a a a a a a a a a a a a a a"), (10, "one two"), (11, SHARED.upper()), (7, prose(40, 3) + " " + SHARED), (None, prose(30, 5)),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, start long, score double, print string, row string, key long, component_id long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i is None or i % 2 else None, "s", len(t or ""), 1, 0.5, "p", "r", 9, 8) for i, t in TEXTS]
    return materialize(spark.createDataFrame(rows, COLUMNS).repartition(3), "docs")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# token ids


SIGNS = [
    "IT'S", "don't", "WE'LL", "\u2014", "\u201cgo\u201d", "\u0130", "e\u0301", "E\u0301", "J\u030c", "T\u0308", "\u00df", "\u0391\u03a3", "\u4e2d", "\ud55c", "\u0301", "1", "23", "\u0663", "a", "B", "'S", "'re", "'", "..", "_",
    "\ufb01", "\u01c4", "\u212a", "K", "<", "|", "\u200d", "\ufeff", "\x00", "\x7f", "\x7f ", " ", "\t", "\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", "\u2003", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "endoftext|>",
]


@pytest.mark.parametrize(("block", "max_words"), [(20000, 250_000), (700, 400), (60, 40)])
def test_ids_are_the_tokenizers(block, max_words):
    rng, encoder = random.Random(block), tokens.Encoder(tokens.default_tokenizer(), max_words)
    texts = ["".join(rng.choice(SIGNS) + rng.choice(["", " ", ""]) for _ in range(rng.randint(0, 8))) for _ in range(35_000)]
    for lo in range(0, len(texts), block):
        own = texts[lo : lo + block]
        ids, n = encoder.encode(pa.array([*own, None]))
        wanted = [e.ids for e in TOKENIZER.encode_batch(own, add_special_tokens=False)]
        assert n.tolist() == [*map(len, wanted), 0]
        assert ids.tolist() == [i for x in wanted for i in x]
        assert len(encoder.table.number) <= max_words + 8 * block  # the table stays bounded


# 1


def greedy(word, vocabulary):
    rest, n = (*word.encode(), token_counts.END), 0
    while rest:
        size = next((k for k in range(len(rest), 0, -1) if rest[:k] in vocabulary), 1)
        n += rest[:size] != (token_counts.END,)
        rest = rest[size:]
    return n


def test_token_counts(docs, empty):
    vocabulary = set(token_counts.vocabulary(tokens.default_tokenizer()))
    pieces = [token_counts._PIECES.findall((t or "").lower()) for _, t in TEXTS]
    want = sorted(((i, len(p), sum(greedy(x, vocabulary) for x in p)) for (i, _), p in zip(TEXTS, pieces)), key=repr)
    assert rows(token_counts.count_tokens(docs)) == want
    assert token_counts.count_tokens(empty).count() == 0


def test_longest_match_automaton():
    rng = random.Random(0)
    vocabulary = [(97,), (98,), (97, 98), (97, 98, 97, 98, 98), (98, 97, token_counts.END), (98, token_counts.END), (98, 98, 98)]
    match = token_counts.LongestMatch(vocabulary)
    for _ in range(500):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        assert match.count(word.encode()) == greedy(word, set(vocabulary)), word
    assert match.count(b"abc") is None


# 2


def test_packing(docs, empty):
    got = packing.pack(docs, length=64).collect()
    want = sorted((len(ids_of(t)) + 1 for _, t in TEXTS))
    by_sequence = sorted((r.sequence_id, r.offset, r.length) for r in got)
    at = 0
    for s, o, n in by_sequence:
        assert s * 64 + o == at and o + n <= 64
        at += n
    assert at == sum(want)
    texts = {i: t for i, t in TEXTS}
    for r in got:
        own = (ids_of(texts[r.doc_id]) + [1])[r.start : r.start + r.length]
        assert r.ids_crc32 == crc(own) and list(np.frombuffer(r.ids, "<u4")) == own and r.doc_tokens == len(ids_of(texts[r.doc_id])) + 1
    whole = packing.sequences(packing.pack(docs, length=64), length=64).collect()
    assert len(whole) == -(-at // 64) and all(len(r.ids) == 64 for r in whole) and sum(r.n_tokens for r in whole) == at
    assert packing.pack(empty).count() == 0


# 3


def test_decontamination(spark, docs, empty):
    item = prose(40, 50).split()
    items = spark.createDataFrame([(1, " ".join(item), "x"), (2, None, "x"), (3, "too short", "x"), (4, prose(35, 51), "x"), (4, prose(35, 51), "x")], "item_id long, text string, doc_id string")
    changed = item[:20] + ["changed"] + item[21:]
    more = spark.createDataFrame([(100, prose(500, 6) + " " + " ".join(item) + " " + prose(500, 7)), (101, "; ".join(item).upper()), (102, " ".join(changed)), (103, " ".join(item[:25])), (104, prose(35, 51))], "doc_id long, text string")
    table = docs.unionByName(more, allowMissingColumns=True)

    def sets(text):
        w = re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = []
    for d, t in [(r.doc_id, r.text) for r in table.collect()]:
        for i, x in [(r.item_id, r.text) for r in items.collect()]:
            n, m = len(sets(x)), len(sets(x) & sets(t))
            if n and m >= 0.8 * n - 1e-9:
                want.append((d, i, n, m, m / n))
    assert rows(decontaminate.find(table, items)) == sorted(want, key=repr) and {w[0] for w in want} == {100, 101, 102, 104}
    parts = decontaminate.portions(items, portion_bytes=150)
    assert len(parts) > 1 and rows(decontaminate.find(table, items, portion_bytes=150)) == sorted(want, key=repr)
    assert rows(decontaminate.drop_contaminated(table, items, portion_bytes=150)) == rows(decontaminate.drop_contaminated(table, items))
    kept = decontaminate.drop_contaminated(table, items)
    assert kept.columns == table.columns and kept.count() == table.count() - 4
    assert decontaminate.find(empty, items).count() == 0 and decontaminate.find(docs, items.where("false")).count() == 0


# 4


def test_base_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])

    def want(t):
        out = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        out += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        out += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(digits(m)) <= 15]
        return sorted(out)

    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("ab.@-+12 (9.0") for _ in range(rng.randint(0, 30)))
        assert pii.base_spans(t) == want(t), t
    assert len(pii.base_spans("4242 4242 4242 4242, a@b.c 1.2.3.4 +1 (017) 555-7713")) == 4
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_tagger(docs, empty):
    tagger = pii.trained()
    x, y = pii.labelled_windows(300, seed=77)
    hit = tagger.decode(x) == y
    assert hit.mean() > 0.97 and hit[y > 0].mean() > 0.9
    text = prose(200, 8) + " call 017 555-7713 or mail an.12@mail.example.com now " + prose(200, 9) + " 10.2.33.4"
    (base, own), (none, nothing) = pii.find_spans([text, prose(300, 10)], tagger)
    assert set(base) <= set(own) and {k for _, k, _ in base} == {0, 1} and none == []
    assert "example.com" not in pii.redact_text(text, own) and "[EMAIL]" in pii.redact_text(text, own)
    far = " ".join(["word"] * 5000) + " +1 (017) 555-7713"
    assert pii.find_spans([far], tagger)[0][0] == [(25000, 3, 25017)]
    got = {r.doc_id: r for r in pii.detect(docs, tagger).collect()}
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest() and len(got) == len({i for i, _ in TEXTS})
    assert pii.redact(docs, tagger).schema == docs.schema and pii.redact(docs, tagger).count() == docs.count()
    assert pii.detect(empty, tagger).count() == 0


def test_added_spans_by_brute_force(spark):
    """Every window decoded, and spans kept apart by comparing all with all, give what ``detect`` returns."""
    tagger, rng = pii.trained(), random.Random(12)
    bits = ["017 555-7713", "+1 (017) 555-7713", "an.12@mail.example.com", "a @ b.de", "9807915762804490", "10.2.33.4", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "in 2024, 3.5%", prose(30, 1), prose(9, 2), "v1.2", "1,234"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    want = []
    for text in texts:
        parts = []
        for offset in range(0, max(1, len(text)), pii.STRIDE):
            tags = tagger.decode(pii.symbols([text[offset : offset + pii.WIDTH]], pii.WIDTH))[0].tolist()
            for at, tag in enumerate(tags):
                if tag % 2 == 1:
                    end = at + 1
                    while end < pii.WIDTH and tags[end] == tag + 1:
                        end += 1
                    parts.append((offset + at, tag // 2, min(offset + end, len(text)), at == 0 and offset > 0, end == pii.WIDTH and offset + end < len(text)))
        base = pii.base_spans(text)
        kept = []
        for s in sorted({s for s in pii.joined(parts) if pii._plausible(s[1], text[s[0] : s[2]])}, key=lambda s: (s[0] - s[2], s)):
            if all(s[2] <= o[0] or o[2] <= s[0] for o in kept):
                kept.append(s)
        out = [s for s in kept if all(s[2] <= o[0] or o[2] <= s[0] for o in base)]
        want.append(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base + out)))
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: r for r in pii.detect(table, tagger).collect()}
    assert [got[i].spans for i in range(60)] == want and all(got[i].n_spans == len(want[i].split(",")) * bool(want[i]) for i in range(60))
    assert sum(r.n_secret for r in got.values()) > 0


def test_counts_are_of_base_spans(spark):
    """Spans that only the tagger adds are in ``spans`` and ``n_spans``, not in the counts of the base patterns."""
    texts = ["call 017 555-7713 or 9807915762804490 now", "mail a @ b.de or an.12@mail.example.com, 10.2.33.4", "4242 4242 4242 4242 and +1 (017) 555-7713"]
    got = {r.doc_id: r for r in pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        kinds = [k for _, k, _ in pii.base_spans(t)]
        assert [got[i][f"n_{name}"] for name in ("email", "ip", "card", "phone")] == [kinds.count(k) for k in range(4)]
    assert got[0].n_spans > 0 and got[0].n_card == got[0].n_phone == 0


def test_spans_that_windows_cut():
    assert pii.joined([(10, 0, 96, False, True), (48, 0, 120, True, False)]) == [(10, 0, 120)]
    assert pii.joined([(10, 4, 96, False, True), (48, 4, 144, True, True), (96, 4, 150, True, False), (5, 1, 9, False, False)]) == [(5, 1, 9), (10, 4, 150)]
    assert pii.joined([(10, 0, 96, False, True), (48, 1, 120, True, False), (0, 2, 3, True, False)]) == []
    rng = random.Random(3)
    for _ in range(300):
        spans, taken = ([(a := rng.randint(0, 60), rng.randint(0, 4), a + rng.randint(1, 9)) for _ in range(rng.randint(0, 12))] for _ in range(2))
        want = []
        for s in sorted(set(spans), key=lambda s: (s[0] - s[2], s)):
            if all(s[2] <= o[0] or o[2] <= s[0] for o in (*taken, *want)):
                want.append(s)
        assert pii._apart(spans, taken) == sorted(want)
    assert len(pii._apart([(3 * i, 0, 3 * i + 2) for i in range(20_000)], [])) == 20_000


# 5

LANGUAGES = {"en": "the and of that with this have from they what", "de": "der und die nicht mit auch eine werden über für", "ru": "и не что он на как это по но"}


def test_language(spark):
    rng, rows_ = random.Random(5), []
    for i in range(240):
        lang = ["en", "de", "ru"][i % 3]
        rows_.append((i, " ".join(rng.choice(LANGUAGES[lang].split()) for _ in range(40)), lang))
    mixed = " ".join(["the and of that"] * 10) + " " + " ".join(["и не что"] * 4)
    rows_ += [(1000, mixed, None), (1001, None, "en"), (1002, "12 34 !!", "de"), (1003, "", None), (None, "der und die nicht", None)]
    table = spark.createDataFrame([(*r, 0.1, "x") for r in rows_], "doc_id long, text string, lang string, score double, lang_pred string").repartition(3)
    model = language.fit_on(table)
    got = {r.doc_id: r for r in language.predict(table.select("doc_id", "text"), model).collect()}
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].lang_pred == rows_[i][2] for i in held]) > 0.95
    assert got[1000].lang_pred == "en" and 0.5 < got[1000].score < 1 and got[None].lang_pred == "de"
    assert {got[i].lang_pred for i in (1001, 1002, 1003)} == {"und"} and got[1001].score == 0
    found = [(r.start, r.end, r.lang) for r in language.spans(table.where("doc_id = 1000"), model).orderBy("start").collect()]
    assert [x[2] for x in found] == ["en", "ru"] and found[1][0] == mixed.index("и")
    kept = language.keep_known(table)
    assert kept.columns == table.columns and kept.count() == table.count() - 3 and kept.where("lang is null").count() == 0
    assert language.predict(table.where("false").select("doc_id", "text"), None).count() == 0
    assert {r.lang_pred for r in language.predict(table.limit(3), None).collect()} == {"und"}


def test_language_by_brute_force(spark, tmp_path):
    """``lang_pred``, ``score`` and ``held_out`` of the query from their definitions, a letter and a word at a time."""
    from collections import Counter
    from math import log

    rng, texts = random.Random(15), {}
    for i in range(150):
        own = ["en", "de", "ru"][i % 3]
        words_ = [rng.choice(LANGUAGES[own].split()) for _ in range(rng.randint(1, 60))]
        if i % 5 == 0:
            words_ += [rng.choice(LANGUAGES[rng.choice(["en", "de", "ru"])].split()) for _ in range(rng.randint(1, 40))]
        texts[i] = (rng.choice([" ", ", ", " 12 ", "-"]).join(words_).capitalize(), own if i % 11 else None)
    texts |= {200: (None, "en"), 201: ("", "de"), 202: ("12 \u0301 !!", "ru"), 203: ("\u65e5\u672c\u8a9e", None), 204: ("the \u0438 and", None), 205: ("x" * 5000 + " " + "der " * 3000, "de")}
    spark.createDataFrame([(i, t, lang, "s", 0.5) for i, (t, lang) in texts.items()], "doc_id long, text string, lang string, source string, score double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    def words_of(text):
        low, out, at = (text or "").lower(), [], 0
        kinds = [unicodedata.category(c)[0] for c in low]
        while at < len(low):
            end = at
            while end < len(low) and kinds[end] in "LM":
                end += 1
            if "L" in kinds[at:end]:
                out.append(low[at:end])
            at = max(end, at + 1)
        return out

    script = lambda c: next(name for first, name in reversed(language.SCRIPTS) if ord(c) >= first)

    def features(word):
        codes = [0, *map(ord, word), 0]
        code = [(a * 0x9E3779B1 + b * 0x85EBCA77C2B2AE63 + c * 0xC2B2AE3D27D4EB4F) % 2**64 for a, b, c in zip(codes, codes[1:], codes[2:])]
        return (language.mix(np.array(code, np.uint64)) & np.uint64(language.FEATURES - 1)).tolist()

    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    names = sorted({lang for i, (t, lang) in texts.items() if lang and t is not None and not held[i]})
    grams, letters = {x: Counter() for x in names}, {x: Counter() for x in names}
    for i, (t, lang) in texts.items():
        if lang and t is not None and not held[i]:
            for w in words_of(t):
                grams[lang].update(features(w))
                letters[lang][script(w[0])] += len(w)
    chance = lambda x, f: log((grams[x][f] + 0.5) / (grams[x].total() + 0.5 * language.FEATURES))
    allowed = {x: {s for s, n in letters[x].items() if n >= language.SCRIPT_SHARE * letters[x].total()} for x in names}

    def predict(text):
        found = words_of(text)
        if not found:
            return "und", 0.0
        best, back = dict.fromkeys(names, 0.0), []
        for n, w in enumerate(found):
            fits = [x for x in names if script(w[0]) in allowed[x]] or names
            own = {x: sum(chance(x, f) for f in features(w)) if x in fits else -1e6 for x in names}
            top = max(names, key=lambda x: (best[x], -names.index(x)))
            stay = {x: not n or best[x] >= best[top] - language.SWITCH_PENALTY for x in names}
            back.append({x: x if stay[x] else top for x in names})
            best = {x: own[x] - max(own.values()) + (best[x] if stay[x] else best[top] - language.SWITCH_PENALTY) for x in names}
        at, share = max(names, key=lambda x: (best[x], -names.index(x))), Counter()
        for w, before in zip(reversed(found), reversed(back)):
            share[at] += len(w)
            at = before[at]
        top = max(names, key=lambda x: (share[x], -names.index(x)))
        return top, share[top] / share.total()

    got = {r.doc_id: r for r in language.op5_language_id(spark, str(tmp_path)).collect()}
    assert set(got) == set(texts) and {i: r.held_out for i, r in got.items()} == held
    for i, (t, _) in texts.items():
        name, score = predict(t)
        assert (got[i].lang_pred, got[i].score) == (name, pytest.approx(score)), i
    assert len({r.score for r in got.values()}) > 5


def test_marks_alone_are_no_language():
    model = language.Model(["a", "b"], np.zeros((language.FEATURES, 2), np.float32), np.ones((len(language.SCRIPT_NAMES), 2), bool))
    texts = ["\u0301", "\u0301\u0302 \u0301", "e\u0301", None, "\U0003ffff", "\u0301 x", "", "\U000323ae", "12 \u0301 !"]
    assert language.label_texts(texts, model)[0] == ["und", "und", "a", "und", "und", "a", "und", "a" if unicodedata.category("\U000323ae") == "Lo" else "und", "und"]
    alone, with_mark = language.Words(["x y"]), language.Words(["x \u0301 y"])
    assert alone.letters.tolist() == with_mark.letters.tolist() == [1, 1] and alone.feature.tolist() == with_mark.feature.tolist()


def test_viterbi_matches_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(50):
        count = rng.integers(0, 5, 4)
        first = np.cumsum(count) - count
        s = rng.normal(0, 2, (int(count.sum()), 3)).astype(np.float32)
        got = language.viterbi(s, first, count, 1.5)
        value = lambda own, path: sum(own[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))
        for a, n in zip(first, count):
            own = s[a : a + n]
            assert value(own, got[a : a + n]) >= max(value(own, p) for p in product(range(3), repeat=int(n))) - 1e-4


# 6


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[5] = x[6]
    rows_ = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows_ += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [1.0], 1), (None, x[0].tolist(), 1), (1004, [None] * 16, 1)]
    table = spark.createDataFrame(rows_, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in neighbours.nearest(table.where("vec_id % 100 = 0"), table).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        top = np.lexsort((np.arange(900), d))[:10]
        assert len(got[q]) == 10 and [s for _, s in got[q]] == sorted(s for _, s in got[q])
        assert all(abs(s - d[i]) < 1e-12 for i, s in got[q])
        hits += len({i for i, _ in got[q]} & set(top.tolist()))
    assert set(got) == set(range(0, 900, 100)) and hits >= 0.9 * 90
    few = neighbours.nearest(table.where("vec_id = 5"), table.where("vec_id in (5, 6, 7)"))
    assert [(r.rank, r.vec_id, r.score == 0) for r in few.orderBy("rank").collect()] == [(1, 6, True), (2, 7, False)]
    assert neighbours.nearest(table, table.where("false")).count() == 0
    assert abs(neighbours.chi_square(7.344, 8) - 0.5) < 1e-3 and abs(neighbours.stop_ratio(0.95, 16) - 26.296) < 1e-3


def test_neighbours_over_shards(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 24)) + 3 * rng.normal(size=(40, 24))[rng.integers(0, 40, 4000)]
    x[1000:3500] = x[1000]  # many more than a shard and a leaf hold
    rows_ = [(i, v.tolist(), 1, "p", 0, 0.5) for i, v in enumerate(x)]
    table = spark.createDataFrame(rows_, "vec_id long, embedding array<double>, shard int, path string, block int, bound double").repartition(5)
    got = {}
    for r in neighbours.nearest(table.where("vec_id % 50 = 0"), table, shard_vectors=150).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 4000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        top = np.lexsort((np.arange(4000), d))[:10].tolist()
        assert all(abs(s - d[i]) < 1e-12 for i, s in got[q])
        if 1000 <= q < 3500:
            assert [i for i, _ in got[q]] == top  # equal vectors: the smallest ids
        else:
            hits += len({i for i, _ in got[q]} & set(top))
    assert hits >= 0.9 * 10 * 30


def test_the_search_stops_early():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = neighbours.projection(64)
    ids, asked = np.arange(6000), np.arange(0, 6000, 100)
    best_id, best, verified = neighbours.search_shard(ids, x, x @ w, neighbours.KdTree(x @ w, neighbours.LEAF_VECTORS), asked, x[asked], x[asked] @ w, np.full(60, np.inf), 10)
    d = ((x[asked][:, None] - x[None]) ** 2).sum(2)
    d[np.arange(60), asked] = np.inf
    top = np.argsort(d, axis=1)[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best_id.tolist(), top.tolist())]) >= 0.9
    assert verified < 0.7 * 60 * 6000  # evenly spread directions are the worst case


# 7


def test_token_files(docs, empty):
    manifest = wavelet.write_shards(docs, shard_tokens=200)
    got = [tuple(r) for r in wavelet.read_documents(manifest).collect()]
    at, want = 0, []
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = ids_of(t) + [2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want and manifest.count() > 1
    (counted,) = wavelet.count_tokens(manifest, [2]).collect()
    assert counted.n == len(TEXTS)
    assert wavelet.read_documents(wavelet.write_shards(empty)).count() == 0


def test_token_files_of_one_frequent_id(spark):
    """Rows of one id, equal texts included, are dealt to several files and keep the order of ids."""
    texts = [(None, prose(20, 50 + i % 40)) for i in range(300)] + [(5, "same text")] * 300 + [(i, prose(3, i)) for i in range(6, 30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    manifest = wavelet.write_shards(docs, shard_tokens=300)
    got = sorted(wavelet.read_documents(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in texts]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    want = lambda key: sorted((crc(ids_of(t) + [2]) for i, t in texts if i == key))
    assert all(sorted(r.ids_crc32 for r in got if r.doc_id == key) == want(key) for key in (None, 5, 7))
    assert manifest.groupBy("part").sum("n_tokens").count() == wavelet.partitions(spark) > 1


@pytest.mark.parametrize("n", [1, 63, 511, 512, 513, 1024, 5000])
def test_wavelet_ranks(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, 3, rng.integers(0, 49408, n)).astype(np.uint32)
    data = wavelet.dump_shard(ids, np.array([n]), [1])
    matrix = wavelet.load_shard(data)[0]
    assert sum(p.ones.nbytes for p in matrix.planes) <= sum(p.words.nbytes for p in matrix.planes) / 16 + 4 * len(matrix.planes)
    for v in {3, int(ids[0]), int(ids[-1]), 49407}:
        at = np.flatnonzero(ids == v)
        assert [matrix.rank(v, i) for i in range(0, n + 1, 61)] == [int((at < i).sum()) for i in range(0, n + 1, 61)]
        assert [matrix.select(v, k) for k in range(0, len(at), 17)] == at[::17].tolist()
    assert [matrix.access(i) for i in range(0, n, 97)] == ids[::97].tolist()


def test_wavelet_matrix():
    ids = np.random.default_rng(0).integers(0, 300, 1000).astype(np.uint32)
    matrix, lengths, docs_ = wavelet.load_shard(wavelet.dump_shard(ids, np.array([400, 600]), [7, None]))
    assert np.array_equal(matrix.decode(), ids) and list(lengths) == [400, 600] and docs_ == [7, None]
    assert [matrix.access(i) for i in range(0, 1000, 37)] == ids[::37].tolist()
    for v in (0, 5, 299, 300, 70_000):
        at = np.flatnonzero(ids == v)
        assert matrix.rank(v) == len(at) and matrix.rank(v, 500) == (at < 500).sum()
        assert [matrix.select(v, k) for k in range(len(at))] == at.tolist()
    with pytest.raises(IndexError):
        matrix.select(300, 0)
    with pytest.raises(ValueError):
        wavelet.load_shard(b"something else")


# 8


def brute_dedup(texts, window=20):
    first = {}
    for i, t in texts:
        w = words(t)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (1 << 70, 0)), (-(1 << 63) if i is None else i, s))
    out = []
    for i, t in texts:
        w, gone = words(t), set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (-(1 << 63) if i is None else i, s):
                gone.update(range(s, s + window))
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, " ".join(kept), len(w), len(gone)))
    return sorted(out, key=repr)


def test_substring_dedup(spark, docs, empty, monkeypatch):
    assert rows(substring.dedup(docs)) == brute_dedup(TEXTS)
    rng = random.Random(9)
    parts = [" ".join(rng.choice("abcdefgh") for _ in range(30)) for _ in range(6)]
    many = [(i, " ".join(rng.choice(parts) if rng.random() < 0.5 else prose(12, i * 10 + j) for j in range(5))) for i in range(60)]
    table = spark.createDataFrame(many, "doc_id long, text string").repartition(4)
    want = brute_dedup(many)
    assert rows(substring.dedup(table)) == want
    monkeypatch.setattr(substring, "HOT_ROWS", 3)  # the way of hot anchors gives the same
    assert rows(substring.dedup(table)) == want
    for r in substring.spans(table).collect():
        if r.source_id is not None:
            w = dict(many)
            assert words(w[r.doc_id])[r.start : r.start + r.length] == words(w[r.source_id])[r.source_start : r.source_start + r.length]
    assert substring.dedup(empty).count() == 0


def test_greedy_factors():
    word = np.array([1, 2, 3, 4, 9, 8, 2, 3, 5, 6, 8, 2, 3, 5, 1, 2, 3, 4, 9])
    row = np.array([0, 0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 3])
    first = {w: word.tolist().index(w) for w in word.tolist()}
    earliest = np.array([first[w] if first[w] < i else -1 for i, w in enumerate(word.tolist())])
    source, starts = substring.parse(word, row, earliest)
    assert source.tolist() == [-1, -1, -1, -1, -1, -1, 1, 2, -1, -1, 5, 6, 7, 8, 0, 1, 2, 3, 4]
    assert np.flatnonzero(starts).tolist() == [6, 10, 14]  # row 2 goes on in row 1, though its second window stands earlier
    assert substring.factors([(3, 2, 7, 1), (5, 4, 7, 3), (9, 1, 8, 0)], 20) == [(3, 25, 7, 1), (9, 20, 8, 0)]
    assert [len(x) for x in substring.parse(word[:0], row[:0], earliest[:0])] == [0, 0]


def test_substring_digests(spark, tmp_path):
    part = " ".join(f"w{i}" for i in range(40))
    texts = [(0, f"a {part}"), (1, f"{part} b"), (2, None), (3, ""), (4, f"a {part}"), (5, "x\u00a0y  z\x1c"), (6, " ".join(["r"] * 90)), (None, f"{part} c"), (None, f"d {part}"), (7, f"{part} {part}")]
    spark.createDataFrame([(i, t, "en", t, 1) for i, t in texts], "doc_id long, text string, lang string, found string, copy long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(substring.op8_substring_dedup(spark, str(tmp_path)))
    assert got == sorted([(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, kept, n, gone in brute_dedup(texts)], key=repr)


# 9


def test_simhash(spark, docs, empty):
    def fingerprint(t):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        if not w:
            return 0
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [(i, fingerprint(t)) for i, t in TEXTS]
    label = list(range(len(prints)))
    for _ in label:
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                    label[a] = label[b] = min(label[a], label[b])
    smallest = {k: min((p[0] for p, x in zip(prints, label) if x == k and p[0] is not None), default=None) for k in set(label)}
    want = sorted(((i, p.to_bytes(8, "big"), smallest[k]) for (i, p), k in zip(prints, label)), key=repr)
    got = simhash.components(docs, simhash.fingerprint64, simhash.pigeonhole(2), 1, 2)
    assert sorted(((r[0], bytes(r[1]), r[2]) for r in got.collect()), key=repr) == want
    assert simhash.components(empty, simhash.fingerprint64, simhash.pigeonhole(2), 1, 2).count() == 0


@pytest.mark.parametrize("shard_rows", [1000, 20])
def test_bk_trees_lose_no_link(spark, shard_rows):
    rng = np.random.default_rng(shard_rows)
    base = rng.integers(0, 1 << 63, 30, np.uint64)
    near = np.concatenate([base, *(base ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 63, (12, 2)))])
    near = np.unique(near)
    table = spark.createDataFrame([(int(x).to_bytes(8, "big"),) for x in near], "print binary").repartition(3)
    got = {int.from_bytes(r.node, "big"): r.component for r in bktree.near_components(table, simhash.pigeonhole(2), 1, 2, shard_rows).collect()}
    parent = {int(x): int(x) for x in near}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(near):
        for b in near[i + 1 :][np.bitwise_count(near[i + 1 :] ^ a) <= 2]:
            parent[root(int(b))] = root(int(a))
    one = lambda own, key: {frozenset(x for x in own if key(x) == k) for k in {key(x) for x in own}}
    values = [int(x) for x in near]
    assert one(values, lambda x: bytes(got.get(x, x.to_bytes(8, "big")))) == one(values, root)


def test_hot_shards_have_bounded_groups(spark):
    table = spark.range(2000).select(F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("print"))
    dealt = bktree._dealt(table, lambda p: np.zeros((len(p), 1), np.int64), 1, 100)
    sizes = [r["count"] for r in dealt.groupBy("shard").count().collect()]
    assert len(sizes) == 20 * 21 // 2 and sum(sizes) == 2000 * 20 and max(sizes) < 300


def test_settle_cuts_at_salts():
    import pyarrow as pa

    n = 60
    batches = [pa.RecordBatch.from_pydict({"ord": pa.array(range(i, i + 10), pa.int64()), "t1": pa.array([1] * 10, pa.int64()), "anchor": pa.array([5] * 10, pa.int64()), "salt": pa.array([i // 10] * 10, pa.int64()), "salts": pa.array([n // 10] * 10, pa.int32()), "start": pa.array([0] * 10, pa.int32()), "hashes": pa.array([[7]] * 10, pa.list_(pa.int64()))}) for i in range(0, n, 10)]
    out = list(substring._settle(block_rows=15)(iter(batches)))
    assert len(out) > 1 and sum(len(s) for b in out for s in b["starts"].to_pylist()) == n - n // 10


def test_bk_forest_search():
    rng = np.random.default_rng(2)
    prints, group = rng.integers(0, 1 << 12, (400, 1), np.uint64), rng.integers(0, 3, 400)
    pairs = {(int(q), int(n)) for a, b in bktree.BKForest(prints, group).search(prints, group, 3) for q, n in zip(a, b)}
    assert pairs == {(i, j) for i in range(400) for j in range(400) if group[i] == group[j] and int(prints[i, 0] ^ prints[j, 0]).bit_count() <= 3}


def test_near_dedup_stage(spark, docs):
    body = prose(400, 21).split()
    edited = body[:200] + ["edit"] + body[201:]
    rows_ = [(1, " ".join(body)), (2, " ".join(edited)), (3, " ".join(body)), (4, prose(400, 22)), (4, prose(400, 22)), (5, None)]
    table = spark.createDataFrame(rows_, "doc_id long, text string")
    assert [r.doc_id for r in simhash.near_dedup(table).orderBy("doc_id").collect()] == [1, 4, 5]
    assert simhash.near_dedup(docs).columns == docs.columns


def test_near_dedup_by_brute_force(spark):
    """Pairs at, above and below 0.8, short and long; links that only a weaker pair of a shard gives."""
    rng = random.Random(41)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    texts, number = {}, 0
    for size in (12, 40, 300):
        for share in (0.03, 0.1, 0.15, 0.19, 0.24, 0.3, 0.4):
            for _ in range(12):
                own = [word() for _ in range(size)]
                cut = max(1, round((size - 4) * share))
                for t in (own, own[:-cut], own[cut // 2 :]):
                    texts[number], number = " ".join(t), number + 1
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    sets = {i: {tuple(t.split()[p : p + 5]) for p in range(max(1, len(t.split()) - 4))} for i, t in texts.items()}
    label = {i: i for i in texts}
    for i in range(0, number, 3):
        for _ in range(3):
            for a, b in ((i, i + 1), (i, i + 2), (i + 1, i + 2)):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                    label[a] = label[b] = min(label[a], label[b])
    want = {i for i in texts if label[i] == i}
    got = {r.doc_id for r in simhash.near_dedup(table).collect()}
    assert want <= got  # nothing under the threshold goes
    print("kept twice:", len(got - want), "of", len(texts) - len(want))
    assert len(got - want) <= 0.05 * (len(texts) - len(want))


def test_stage_recall_counts_the_radius():
    bits, tables = simhash.stage_tables(1000)
    assert simhash.recall_at(0.8, bits, tables) >= 0.95 and simhash.recall_at(0.9, bits, tables) >= 0.999
    assert simhash.recall_at(0.8, 16, 39, 25) < 0.85


def test_spanning_forest_is_smallest():
    rng = np.random.default_rng(8)
    a, b, d = rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.integers(0, 9, 150)
    parent, want, links = list(range(40)), 0, 0
    for i in np.argsort(d, kind="stable"):
        x, y = parent[a[i]], parent[b[i]]
        if x != y:
            parent, want, links = [x if p == y else p for p in parent], want + d[i], links + 1
    got = bktree.spanning(a, b, d, 40)
    assert len(got) == links and d[got].sum() == want


def test_near_dedup_judges_rows(spark):
    """Null and repeated ids of different texts."""
    text = [prose(80, 60 + i) for i in range(4)]
    rows_ = [(None, text[0]), (None, text[1]), (None, text[0]), (7, text[2]), (7, text[3]), (7, text[3]), (8, text[2]), (9, text[1])]
    table = spark.createDataFrame(rows_, "doc_id long, text string")
    want = sorted([(None, text[0]), (7, text[2]), (7, text[3]), (9, text[1])], key=repr)
    assert rows(simhash.near_dedup(table)) == want
    assert rows(simhash.near_dedup(spark.createDataFrame([(None, t) for t in text], "doc_id long, text string"))) == sorted([(None, t) for t in text], key=repr)


# 10


def test_url_rules(spark):
    urls = ["HTTP://A.Example.COM/en/71?x#y", "ftp://x", None, "abc", "http://com/en/", "http://xcom/en/", "http://net/de/?q", "http://a.example.net/de/8", "x://h#a/b", "http://example.com/EN/", "u://a.org/es/\n?", "http:///p", "http://a://b/en/"]
    hosts = ["a.example.com", "x", "", "", "com", "xcom", "net", "a.example.net", "h", "example.com", "a.org", "", "a:"]
    paths = ["/en/71", "", "", "", "/en/", "/en/", "/de/", "/de/8", "", "/EN/", "/es/\n", "/p", "//b/en/"]
    fits = ["example.com/en/7", None, None, None, "com/en/", None, "net/de/", "example.net/de/8", None, None, "org/es/", None, None]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)] + [(0, urls[0], None, None)], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = rows(url_filter.judge(pages, labels))
    verdict = {"com/en/": "block", "example.net/de/8": "block", "org/es/": "block"}
    want = [(i, h, p, r, verdict.get(r, "allow")) for i, (h, p, r) in enumerate(zip(hosts, paths, fits))]
    assert got == sorted([*want, want[0]], key=repr)
    assert url_filter.judge(pages.where("false"), labels).count() == 0


def test_association_rules(spark):
    rng = random.Random(1)
    urls = [(i, f"http://{'bad' if i % 4 == 0 else 'fine'}.site{i % 7}.test/{'spam' if i % 4 == 0 else rng.choice(['news', 'spam'])}/{i}") for i in range(200)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, 1 if i % 4 == 0 else 0) for i in range(0, 120)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rules, items = url_filter.mine_rules(pages, labels, 0.05, 0.9)
    assert [r["items"] for r in rules.collect()] == [["bad"]] and {r.token for r in items.where("item = 'bad'").collect()} == {"bad"}
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, [], 0.05, 0.9).collect()}
    assert got == {i: "block" if i % 4 == 0 else "allow" for i in range(200)}


def test_association_rules_by_brute_force(spark):
    from itertools import combinations

    rng = random.Random(6)
    urls = {i: "x://" + "/".join(sorted(t for t in "abcdefg" if rng.random() < 0.5) + (["u", "v"] if i % 9 == 0 else [])) for i in range(160)}
    toxic = {i: int(("a" in u and "b" in u or "u" in u or "d" in u and "e" in u and "f" in u) and rng.random() < 0.9) for i, u in urls.items() if i < 130}
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in urls.items()], "page_id long, url string, best string, rule string")
    labels = spark.createDataFrame([(i, t) for i, t in toxic.items()], "doc_id long, toxic int")
    sets = {i: frozenset(u.split("/")[2:]) - {""} | {"x"} for i, u in urls.items()}
    subsets = lambda own: (frozenset(c) for k in range(1, len(own) + 1) for c in combinations(sorted(own), k))

    def fits(own):
        for s in subsets(own):
            with_it = [toxic[i] for i in toxic if s <= sets[i]]
            if sum(with_it) >= 8 and sum(with_it) >= 0.8 * len(with_it):
                return True
        return False

    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, [], 0.0, 0.8, 8).collect()}
    assert got == {i: "block" if fits(sets[i]) else "allow" for i in urls} and set(got.values()) == {"block", "allow"}


def test_long_repeated_urls_are_mined_at_once(spark):
    long = "x://" + "/".join(f"token{i}" for i in range(60))
    pages = spark.createDataFrame([(i, long) for i in range(10)] + [(7, long), (50, long + "/more"), (51, "x://token5"), (52, "x://other"), (53, None)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)] + [(52, 0)], "doc_id long, toxic int")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, labels, []).collect()}
    assert got == dict.fromkeys([*range(10), 50, 51], "block") | {52: "block", 53: "allow"}  # 11 of 12 pages with x are unwanted


@pytest.mark.parametrize("bad", [lambda i: True, lambda i: i % 2 == 0, lambda i: i % 5 < 2])
def test_nearly_equal_tokens_are_mined_soon(spark, bad):
    """Each of 100 pages lacks one of 20 tokens; the sets of frequent tokens are nearly all sets."""
    names = [f"token{j:02}" for j in range(20)]
    urls = {i: frozenset(t for j, t in enumerate(names) if j != i % 20) for i in range(100)} | {i: frozenset([names[i % 20]]) for i in range(100, 160)}
    toxic = {i: int(i < 100 and bad(i)) for i in urls}
    pages = spark.createDataFrame([(i, "/".join(sorted(u))) for i, u in urls.items()], "page_id long, url string")
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    began = time.time()
    rules, items = url_filter.mine_rules(pages, labels)
    found = [frozenset(r["items"]) for r in rules.collect()]
    took = time.time() - began
    tokens = {}
    for r in items.collect():
        tokens.setdefault(r["item"], []).append(r.token)
    assert all(len(t) == 1 for t in tokens.values())  # no two tokens stand in the same pages

    def counts(s):
        on = [toxic[i] for i, u in urls.items() if s <= u]
        return sum(on), len(on)

    for s in random.Random(8).sample(found, min(50, len(found))):
        hits, all_ = counts(s)
        assert hits >= 5 and hits >= 0.6 * all_
    # the sets of three or fewer of which none smaller is a rule are all there
    small = [frozenset(c) for k in (1, 2, 3) for c in itertools.combinations(names, k)]
    for s in small:
        hits, all_ = counts(s)
        if hits >= 5 and hits >= 0.6 * all_:
            assert any(f <= s for f in found)
    assert took < 60


# the pipeline


def test_pipeline(spark, docs, tmp_path):
    body = prose(120, 31)
    item = prose(40, 32)
    rows_ = [(20, body + " a", "en", "s", 9), (21, body + " a", "en", "s", 9), (22, prose(100, 33) + " " + item, "en", "s", 9), (23, prose(100, 34) + " an.12@mail.example.com", None, "s", 9), (24, "!!! 12", "en", "s", 9), (25, None, None, None, None), (26, prose(90, 35), "en", "s", 9)]
    own = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    own.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        at = materialize(stage(spark, at, str(tmp_path)), name)
        kept.append(sorted({r.doc_id for r in at.select("doc_id").collect()}))
        if name != "packing":
            assert at.columns == own.columns
        if name == "pii":
            assert "[EMAIL]" in at.where("doc_id = 23").first().text
    assert kept == [[20, 21, 22, 23, 26], [20, 22, 23, 26], [20, 23, 26], [20, 23, 26], [20, 23, 26]]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


def test_pipeline_by_brute_force(spark, tmp_path):
    """Every stage's decision from its definition on the stage's own input, and the packed ids of what is left."""
    rng = random.Random(77)
    texts = {}
    for i in range(60):
        texts[i] = prose(rng.randint(1, 150), 1000 + i)
    for i in range(60, 80):
        texts[i] = texts[i - 60] + rng.choice(["", " x"])  # copies, and near-copies of the longer ones
    items = [prose(30, 3000 + i) for i in range(4)]
    for i in range(80, 90):
        texts[i] = prose(60, 4000 + i) + " " + items[i % 4] + " " + prose(5, 5000 + i)
    texts |= {90: None, 91: "", 92: "12 !!", 93: "\u0301", 94: prose(50, 6) + " an.12@mail.example.com 10.2.33.4 " + prose(20, 7), 95: "\u65e5\u672c\u8a9e"}
    spark.createDataFrame([(i, t, rng.choice(["en", "de", None]), "s", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = {i: t for i, t in texts.items() if t and any(unicodedata.category(c)[0] == "L" for c in t)}

    def sets(t, split=str.split):
        w = split(t.lower())
        return {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))}

    label = {i: i for i in left}
    pairs = [(a, b) for a in left for b in left if a < b and len(sets(left[a]) & sets(left[b])) >= 0.8 * len(sets(left[a]) | sets(left[b])) - 1e-9]
    for _ in range(5):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    left = {i: t for i, t in left.items() if label[i] == i}
    parts = lambda s: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", s)
    holds = lambda t, item: len(sets(item, parts) & sets(t, parts)) >= 0.8 * len(sets(item, parts))
    left = {i: t for i, t in left.items() if not any(holds(t, x) for x in items)}
    found = pii.find_spans(list(left.values()), pii.trained())
    left = {i: pii.redact_text(t, own) for (i, t), (_, own) in zip(left.items(), found)}
    assert len(left) < 70 and "[EMAIL]" in left[94] and "[IP]" in left[94]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == len(ids.setdefault(r.doc_id, []))
        ids[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert ids == {i: ids_of(t) + [1] for i, t in left.items()}
    places = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
    assert [2048 * s + o for s, o, _ in places] == np.cumsum([0] + [n for *_, n in places])[:-1].tolist()
