"""Language ID of mixed-language text.

A word's script (a range of code points) narrows its candidate languages to those
whose training text uses the script.  Candidates are scored by hashed letter
trigrams, and a Viterbi pass over the words with a penalty for every switch labels
each word; a document's language is the one with the most letters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.resident import release, resident
from strandloom.llm.tokens import in_blocks
from strandloom.llm.words import mix

#: First code point of each range and its script; letters before the next range
#: belong to it.  Fixed values of the Unicode block list.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Indic"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0x10000, "Other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})

FEATURES = 1 << 16
#: Documents of each language that the model is fitted on, as an expected number: a
#: language with more gives the share of its documents that comes to this.
TRAIN_DOCS = 2000
#: A language is a candidate in scripts that hold at least this share of its letters.
SCRIPT_SHARE = 0.01
#: Log-likelihood that a change of language costs.
SWITCH_PENALTY = 12.0
UNKNOWN = "und"
#: Bytes of text whose letters are held as arrays at once.
BLOCK_BYTES = 1 << 20


def _letter_table() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 0 where it is neither letter nor mark, else 1 + the number of its script; and which are letters."""
    kind = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    out = np.zeros(0x110000, np.uint8)
    ends = [a for a, _ in SCRIPTS[1:]] + [0x110000]
    for (a, name), b in zip(SCRIPTS, ends, strict=True):
        out[a:b] = 1 + SCRIPT_NAMES.index(name)
    out[(kind != "L") & (kind != "M")] = 0
    return out, kind == "L"


def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """See :func:`_letter_table`.  Marks stand in words, so that they don't cut them, but make none."""
    return resident("letters", 0, _letter_table)


class Words:
    """The words of many texts: text number, letters, script, and hashed trigrams."""

    def __init__(self, texts: list[str | None]) -> None:
        data = "\n".join((t or "").lower() for t in texts)
        points = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter((len((t or "").lower()) + 1 for t in texts), np.int64, len(texts))
        scripts, letters = letter_table()
        script = scripts[points]
        edge = np.flatnonzero(np.diff((script > 0).view(np.int8), prepend=0, append=0))
        # a run of marks alone is no word
        sums = np.concatenate([[0], np.cumsum(letters[points])])
        alone = np.flatnonzero(sums[edge[1::2]] == sums[edge[::2]])
        if len(alone):
            drop = np.zeros(len(script) + 1, np.int8)
            drop[edge[2 * alone]], drop[edge[2 * alone + 1]] = 1, -1
            script[np.cumsum(drop[:-1]) > 0] = 0
        real = np.ones(len(edge), bool)
        real[2 * alone] = real[2 * alone + 1] = False
        edge = edge[real]
        self.start, self.end = edge[::2], edge[1::2]
        self.begins = np.cumsum(sizes) - sizes
        self.text = np.searchsorted(self.begins, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, self.begins)
        self.count = np.diff(self.first, append=len(self.start))
        self.letters = self.end - self.start
        self.script = script[self.start].astype(np.int64) - 1 if len(self.start) else np.empty(0, np.int64)
        # neighbours outside the word count as 0, so trigrams know the word's ends
        inside = np.where(script > 0, points, 0).astype(np.uint64)
        padded = np.concatenate([[0], inside, [0]]).astype(np.uint64)
        with np.errstate(over="ignore"):
            code = padded[:-2] * np.uint64(0x9E3779B1) + padded[1:-1] * np.uint64(0x85EBCA77C2B2AE63) + padded[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
        self.feature = (mix(code[script > 0]) & np.uint64(FEATURES - 1)).astype(np.int64)
        self.feature_word = np.cumsum(self.letters) - self.letters  # each word's first trigram


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # FEATURES x languages, log probabilities
    allowed: np.ndarray  # scripts x languages


def _counts(languages: list[str]):
    """Trigram (feature >= 0) and script (-1 - script) counts of a partition's texts, for each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = np.zeros((len(languages), FEATURES), np.int64), np.zeros((len(languages), len(SCRIPT_NAMES)), np.int64)
        number = {name: i for i, name in enumerate(languages)}
        for batch in in_blocks(batches, max_bytes=BLOCK_BYTES):
            lang = np.array([number[x] for x in batch["lang"].to_pylist()])
            words = Words(batch["text"].to_pylist())
            of = lang[words.text]
            np.add.at(scripts, (of, words.script), words.letters)
            np.add.at(grams, (np.repeat(of, words.letters), words.feature), 1)
        for table, sign in ((grams, 1), (scripts, -1)):
            at = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(at[0].astype(np.int32)), pa.array((at[1] if sign > 0 else -1 - at[1]).astype(np.int32)), pa.array(table[at])], names=["lang", "feature", "n"])

    return run


def fit(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """A model from ``doc_id``, ``text``, ``lang``; None without a labelled text.

    Rows with null text or lang are left out.  What reaches the driver is one number
    for each language and trigram hash.
    """
    rows = labelled.where("text is not null and lang is not null").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map(*[x for name in languages for x in (F.lit(name), F.lit(min(1.0, train_docs / sizes[name])))])
    chance = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.where(chance < share[F.col("lang")]).select("text", "lang")
    found = sample.mapInArrow(_counts(languages), "lang int, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toArrow()
    lang, feature, n = (found[c].to_numpy() for c in ("lang", "feature", "n"))
    grams, scripts = np.zeros((FEATURES, len(languages))), np.zeros((len(SCRIPT_NAMES), len(languages)))
    own = feature >= 0
    grams[feature[own], lang[own]] = n[own]
    scripts[-1 - feature[~own], lang[~own]] = n[~own]
    scores = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * FEATURES))
    return Model(languages, scores.astype(np.float32), scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1))


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The best label of every row of ``scores`` (words x labels), text by text.

    Texts advance together, the longest first, one word at a time; ties go to staying
    and to the smaller label.
    """
    best = np.array(scores, np.float32)
    order = np.argsort(-count, kind="stable")
    begin, size = first[order], count[order]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # texts with more than t words
    for t in range(1, longest):
        at = begin[: alive[t]] + t
        before = best[at - 1]
        best[at] += np.maximum(before, before.max(axis=1, keepdims=True) - penalty)
    label = np.empty(len(scores), np.int64)
    for t in range(longest - 1, -1, -1):
        n = int(alive[t])
        at = begin[:n] + t
        top = best[at].argmax(axis=1)
        more = int(alive[t + 1]) if t + 1 < longest else 0
        after = label[at[:more] + 1]
        here = best[at[:more]]
        stay = here[np.arange(more), after] >= here.max(axis=1) - penalty
        top[:more] = np.where(stay, after, top[:more])
        label[at] = top
    return label


def label_words(words: Words, model: Model) -> np.ndarray:
    """A language number for every word."""
    if not len(words.start):
        return np.empty(0, np.int64)
    scores = np.add.reduceat(model.scores[words.feature], words.feature_word, axis=0)
    allowed = model.allowed[words.script]
    narrowed = np.where(allowed | ~allowed.any(axis=1, keepdims=True), scores, -1e6)
    return viterbi(narrowed - narrowed.max(axis=1, keepdims=True), words.first, words.count)


def label_texts(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    words = Words(texts)
    pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if model and len(words.start):
        letters = np.zeros((len(texts), len(model.languages)), np.int64)
        np.add.at(letters, (words.text, label_words(words, model)), words.letters)
        top, total = letters.argmax(axis=1), letters.sum(axis=1)
        score = letters.max(axis=1) / np.maximum(total, 1)
        pred = [model.languages[k] if n else UNKNOWN for k, n in zip(top.tolist(), total.tolist(), strict=True)]
    return pred, score


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``lang_pred`` and ``score`` beside the columns of ``docs`` other than ``text`` and ``lang``.

    ``score`` is the share of the letters labelled with the predicted language.  A text
    that is null or has no letter, and every text without a model, is ``und`` with
    score 0.  Ties go to the language first in the alphabet.
    """
    rest = [f for f in docs.schema.fields if f.name not in ("text", "lang", "lang_pred", "score")]
    names = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, max_bytes=BLOCK_BYTES):
            pred, score = label_texts(batch["text"].to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch[n] for n in names] + [pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    out = T.StructType([*rest, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*names, F.col("text").cast("string").alias("text")).mapInArrow(run, out)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``start``, ``end`` (code points of the lower-cased text), ``lang`` of each run of words in one language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, max_bytes=BLOCK_BYTES):
            words = Words(batch["text"].to_pylist())
            label = label_words(words, model)
            new = np.flatnonzero((np.diff(words.text, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
            last = np.append(new[1:], len(label)) - 1 if len(new) else new
            base = words.begins[words.text[new]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(words.text[new])), pa.array(words.start[new] - base), pa.array(words.end[last] - base), pa.array([model.languages[k] for k in label[new].tolist()], pa.string())], names=["doc_id", "start", "end", "lang"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, end long, lang string")


def _held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def fit_on(docs: DataFrame) -> Model | None:
    """The model of the documents that are not held out (crc32 of the id modulo 4 is not 2)."""
    return fit(docs.where(~_held_out() & F.col("doc_id").isNotNull()))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows whose text is in some language; a null ``lang`` gets the predicted one."""
    model = fit_on(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in in_blocks(batches, max_bytes=BLOCK_BYTES):
            pred, _ = label_texts(batch["text"].to_pylist(), model)
            pred = pa.array([None if p == UNKNOWN else p for p in pred], pa.string())
            columns = [pc.coalesce(batch[n], pred.cast(batch[n].type)) if n == "lang" else batch[n] for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pred.is_valid())

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document; see :func:`predict`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs.select(F.col("doc_id").cast("long"), _held_out().alias("held_out"), F.col("text").cast("string")), fit_on(docs))
