"""Repeated passages, by relative Lempel-Ziv parsing.

Every document is factored against blocks of reference text: a factor is a run of
words that goes on in one earlier place, taken as long as that place goes on, and a
run of at least ``window`` words is a duplicate span.  The reference is the corpus
itself, so its blocks are chosen such that text which occurs once (most of it) is in
none:

1. Anchors.  In each window of words the six-word run with the least hash is its
   anchor.  Equal windows have equal anchors, so only windows whose anchor occurs
   twice in the corpus can have an earlier equal.  The windows around one anchor are
   a reference block; it is indexed by the windows' hashes, in order of place.
2. A document's windows are parsed greedily against every block they belong to: a
   factor starts at the earliest place of its first window and goes on while the next
   window is the next one of that place.  At a factor's boundary the next window is
   looked up in the index again, so that windows which reach over the boundary are
   found as well.  Factors of neighbouring blocks that lie in one line are joined.

A window's identity is its anchor's and its own 64-bit hash (128 bits in all).  Hot
anchors are dealt over several blocks first; what finds nothing there is dealt by
window.  A copy of a whole earlier text is one factor and needs no index.  Texts
travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.tokens import in_blocks
from strandloom.llm.words import Block, sliding
from strandloom.sources.shared import materialize, partitions

WINDOW = 20
ANCHOR = 6
#: Order of a null doc_id: before all others.
_NULL_ORDER = -(1 << 63)
_KEY = ["ord", "t1", "t2"]
#: Bytes of text whose words are held as arrays at once.
BLOCK_BYTES = 1 << 20
#: Occurrences of an anchor in a task; an anchor with more is dealt over several.
HOT_ROWS = 1000
#: Hot anchors whose list is broadcast at most; above, the list is joined by key.
BROADCAST_KEYS = 100_000


def _minima(block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the anchor-sized runs, the least one of each window, and which windows lie in one text."""
    runs = block.runs(ANCHOR)
    span = window - ANCHOR + 1
    whole = block.whole(window)
    least = sliding(runs, span, least=True) if len(runs) >= span else np.empty(0, np.uint64)
    return runs, least, whole


def _anchors(window: int):
    span = window - ANCHOR + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, max_bytes=BLOCK_BYTES):
            block = Block(batch["text"].to_pylist())
            runs, least, whole = _minima(block, window)
            least = np.where(whole, least, 0)
            padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
            # a run is an anchor if it is the least of a window that covers it
            at = np.flatnonzero(runs == sliding(padded, span, least=False)) if len(least) else np.empty(0, np.int64)
            text = block.text[at]
            ends = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(runs[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch[k] for k in _KEY] + [found], names=[*_KEY, "anchors"])

    return run


def _windows(window: int):
    """For each run of shared windows with one anchor: the anchor, the document, the first start, and the windows' hashes."""
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpressed(batches):
            texts = batch["text"].to_pylist()
            block = Block(texts)
            _, least, _ = _minima(block, window)
            row, first_start, anchor, hashes, sizes = [], [], [], [], []
            for i, anchors in enumerate(batch["anchors"]):
                first, n = int(block.first[i]), int(block.count[i])
                if n < window:
                    continue
                shared = np.sort(anchors.values.to_numpy())
                own = least[first : first + n - window + 1].view(np.int64)
                found = np.flatnonzero(shared[np.minimum(np.searchsorted(shared, own), len(shared) - 1)] == own)
                if not len(found):
                    continue
                words = texts[i].split()
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
                begins = np.concatenate([[0], ends[:-1]])
                hashes.append(np.array([digest(line[a:b]) for a, b in zip(begins[found].tolist(), (ends[found + window - 1] - 1).tolist(), strict=True)], np.uint64).view(np.int64))
                new = np.flatnonzero((np.diff(found, prepend=-2) != 1) | (np.diff(own[found], prepend=own[found[0]]) != 0))
                new[0] = 0
                sizes.append(np.diff(new, append=len(found)))
                first_start.append(found[new])
                anchor.append(own[found[new]])
                row.append(np.full(len(new), i))
            if row:
                of, ends = pa.array(np.concatenate(row)), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(anchor)), batch["ord"].take(of), batch["t1"].take(of), pa.array(np.concatenate(first_start).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(hashes)))],
                    names=["anchor", "ord", "t1", "start", "hashes"],
                )

    return run


def parse(word: np.ndarray, row: np.ndarray, earliest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors of all rows of windows at once: each window's source (-1: none) and whether a factor starts there.

    ``word``: window hashes, ``row``: their rows (ascending), ``earliest``: the number
    of each window's earliest equal if that is before it, else -1.
    """
    sizes = np.bincount(row) if len(row) else np.empty(0, np.int64)
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    alive = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")  # rows with more than k windows
    source, starts = np.full(len(word), -1), np.zeros(len(word), bool)
    now = np.full(len(order), -1)
    last = len(word) - 1
    for k, n in enumerate(alive.tolist()):
        at, after = first[order[:n]] + k, np.minimum(now[:n] + 1, last)
        goes_on = (now[:n] >= 0) & (row[after] == row[now[:n]]) & (after != now[:n]) & (word[after] == word[at])
        now = np.where(goes_on, after, earliest[at])
        source[at], starts[at] = now, ~goes_on & (now >= 0)
    return source, starts


_FACTORS = ["starts", "counts", "sources", "source_starts"]
_SETTLED = "ord long, t1 long, starts array<int>, counts array<int>, sources array<long>, source_starts array<int>, anchor long, left array<struct<hash:bigint,start:int>>"


def _settle(block_rows: int = 50_000):
    """Rows sorted by anchor and salt -> their factors in these blocks, and the windows of salted rows without one."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        sizes = pc.list_value_length(table["hashes"]).to_numpy().astype(np.int64)
        row = np.repeat(np.arange(table.num_rows), sizes)
        start = table["start"].to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        word = table["hashes"].combine_chunks().flatten().to_numpy()
        anchor, place = table["anchor"].to_numpy()[row], table["ord"].to_numpy()[row]
        salt, salted = table["salt"].to_numpy()[row], table["salts"].to_numpy()[row] > 1
        order = np.lexsort((start, place, word, salt, anchor))
        same = np.zeros(len(order), bool)
        if len(order) > 1:
            a, b = order[1:], order[:-1]
            same[1:] = (word[a] == word[b]) & (anchor[a] == anchor[b]) & (salt[a] == salt[b])
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = (place[order] > place[head]) | (start[order] > start[head])
        earliest = np.full(len(order), -1)
        earliest[order[later]] = head[later]
        source, begins = parse(word, row, earliest)
        left = salted & (source < 0)
        used = np.flatnonzero(np.bincount(row[begins | left], minlength=table.num_rows))

        def lists(mask: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[mask], minlength=table.num_rows)[used])]).astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends), c if isinstance(c, pa.Array) else pa.array(c)) for c in columns]

        at = np.flatnonzero(begins)
        counts = np.bincount(np.searchsorted(at, np.flatnonzero(source >= 0), side="right") - 1, minlength=len(at)) if len(at) else at
        src = source[at]
        rest = pa.StructArray.from_arrays([pa.array(word[left]), pa.array(start[left].astype(np.int32))], names=["hash", "start"])
        found = lists(begins, start[at].astype(np.int32), counts.astype(np.int32), place[src], start[src].astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(table["ord"].to_numpy()[used]), pa.array(table["t1"].to_numpy()[used]), *found, pa.array(table["anchor"].to_numpy()[used]), *lists(left, rest)],
            names=["ord", "t1", *_FACTORS, "anchor", "left"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < block_rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            anchor, salt = table["anchor"].to_numpy(), table["salt"].to_numpy()
            cut = int(np.argmax((anchor == anchor[-1]) & (salt == salt[-1])))  # the last anchor and salt may go on
            if cut:
                yield settle(table.slice(0, cut).combine_chunks())
            held, rows = table.slice(cut).to_batches(), table.num_rows - cut
        if rows:
            yield settle(pa.Table.from_batches(held).combine_chunks())

    return run


def factors(found: list[tuple[int, int, int, int]], window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, source, source start) of a document's factors, from (start, windows, source, source start) of its blocks.

    Factors of several blocks are one if the next starts where the last one's windows end, in the source as well.
    """
    out: list[list[int]] = []
    for start, count, source, place in sorted(found):
        last = out[-1] if out else None
        if last and start == last[0] + last[1] and source == last[2] and place - last[3] == start - last[0]:
            last[1] += count
        else:
            out.append([start, count, source, place])
    return [(start, count + window - 1, source, place) for start, count, source, place in out]


def _source_rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ORDER)).alias("ord"),
        F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.col("text").cast("binary").alias("text"),
    )


def _pressed(rows: DataFrame) -> DataFrame:
    """The rows with compressed texts, to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for batch in in_blocks(batches, max_bytes=BLOCK_BYTES):
            pressed = pa.array([None if t is None else press(t) for t in batch["text"].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pressed if n == "text" else batch[n] for n in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _unpressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor().decompress

    def whole() -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches, max_bytes=BLOCK_BYTES // 4):
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = pa.array([None if t is None else unpress(t) for t in part["text"].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([texts if n == "text" else part[n] for n in part.schema.names], names=part.schema.names)

    return in_blocks(whole(), max_bytes=BLOCK_BYTES)


def _settled(groups: DataFrame, hot: DataFrame, n_hot: int) -> DataFrame:
    """The factors of ``groups`` in their blocks."""
    p = partitions(groups.sparkSession)
    if n_hot:
        groups = groups.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, "anchor", "left")
    else:
        groups = groups.withColumn("salts", F.lit(None).cast("int"))
    salted = groups.withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("ord"), F.col("salts")))
    dealt = lambda rows: rows.repartition(p, "anchor", "salt").sortWithinPartitions("anchor", "salt").mapInArrow(_settle(), _SETTLED)
    first = materialize(dealt(salted), "settled")
    found = first.where(F.size("starts") > 0).select("ord", "t1", *_FACTORS)
    if not n_hot:
        return found
    # what is left of hot anchors: one row for each window, dealt by the window
    rest = first.where(F.size("left") > 0).select("anchor", "ord", "t1", F.explode("left").alias("w")).select(
        "anchor", "ord", "t1", F.col("w.start").alias("start"), F.array("w.hash").alias("hashes"), F.lit(1).alias("salts"), F.col("w.hash").alias("salt")
    )
    return found.unionByName(dealt(rest).select("ord", "t1", *_FACTORS))


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each text with repeated words: its key, whether it is a whole copy, and its factors.

    Columns ``ord t1 copy found``; ``found`` holds (starts, counts, sources, source_starts) arrays, one entry a factor.
    """
    rows = _source_rows(docs)
    anchors = materialize(rows.drop("doc_id").mapInArrow(_anchors(window), "ord long, t1 long, t2 long, anchors array<long>"), "anchors")
    firsts = materialize(anchors.groupBy("t1", "t2").agg(F.min("ord").alias("ord"), F.count("*").alias("n")), "first-copies")
    copied = firsts.where("n > 1").select("t1", "t2", F.col("ord").alias("first"))
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_KEYS else copied
    copies = materialize(anchors.select(*_KEY).join(copied, ["t1", "t2"]).where("ord > first").select(*_KEY).distinct(), "copies")
    single = anchors.select("ord", "t1", F.explode("anchors").alias("anchor"))
    if copies.limit(1).count():
        single = anchors.join(copies, _KEY, "left_anti").select("ord", "t1", F.explode("anchors").alias("anchor"))
    shared = materialize(single.groupBy("anchor").count().where("count > 1"), "shared-anchors")
    hot = materialize(shared.where(F.col("count") > HOT_ROWS).select("anchor", F.ceil(F.col("count") / HOT_ROWS).cast("int").alias("salts")), "hot-anchors")
    per_text = single.join(shared.select("anchor"), "anchor", "left_semi").groupBy("ord", "t1").agg(F.collect_set("anchor").alias("anchors"))
    groups = _pressed(rows.select("ord", "t1", "text")).join(per_text, ["ord", "t1"]).mapInArrow(_windows(window), "anchor long, ord long, t1 long, start int, hashes array<long>")
    found = _settled(groups, hot, hot.count())
    parts = found.groupBy("ord", "t1").agg(F.collect_list(F.struct(*_FACTORS)).alias("found"))
    whole = copies.select("ord", "t1", F.lit(True).alias("copy")).distinct()
    return parts.join(whole, ["ord", "t1"], "full_outer").select("ord", "t1", F.coalesce("copy", F.lit(False)).alias("copy"), "found")


def _with_repeats(docs: DataFrame, window: int) -> DataFrame:
    told = materialize(repeats(docs, window), "repeats")
    return _pressed(_source_rows(docs).drop("t2")).join(told, ["ord", "t1"], "left").select("doc_id", "text", "copy", "found")


def _kept(text: bytes | None, copy: bool | None, found: tuple[np.ndarray, np.ndarray] | None, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and the words that stay."""
    words = (text or b"").split()
    if copy:
        return len(words), [] if len(words) >= window else words
    if found is None:
        return len(words), words
    starts, counts = found
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + counts + window - 1, -1)
    stay = np.cumsum(depth)[:-1] == 0
    return len(words), [words[i] for i in np.flatnonzero(stay).tolist()]


def _each(batch: pa.RecordBatch, window: int) -> Iterator[tuple[int, list[bytes]]]:
    for text, copy, found in zip(batch["text"].to_pylist(), batch["copy"].to_pylist(), batch["found"], strict=True):
        own = found.values if found.is_valid else None
        yield _kept(text, copy, None if own is None else (own.field("starts").flatten().to_numpy(), own.field("counts").flatten().to_numpy()), window)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``text`` (the words that stay, joined by one space), ``n_words`` and ``n_removed`` of every row of ``docs``.

    A word goes if a window of ``window`` words that covers it also starts earlier: in
    a smaller doc_id or earlier in the same document, judged on the input.  Null and
    short texts lose nothing (null: no words, empty text); a null doc_id is before all
    others; rows that share a doc_id and place are not earlier than each other;
    other columns play no part; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpressed(batches):
            out = list(_each(batch, window))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([b" ".join(k).decode("utf-8", "replace") for _, k in out], pa.string()), pa.array([n for n, _ in out], pa.int64()), pa.array([n - len(k) for n, k in out], pa.int64())], names=["doc_id", "text", "n_words", "n_removed"])

    return _with_repeats(docs, window).mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")


def spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The factors of every document: ``doc_id``, ``start``, ``length`` (words), ``source_id``, ``source_start``.

    Whole copies give one factor over the text, with null source columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpressed(batches):
            out = []
            for doc, text, copy, found in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["copy"].to_pylist(), batch["found"].to_pylist(), strict=True):
                if copy and len((text or b"").split()) >= window:
                    out.append((doc, 0, len(text.split()), None, None))
                elif found:
                    out += [(doc, *f) for f in factors([t for x in found for t in zip(*(x[c] for c in _FACTORS), strict=True)], window)]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "source_id", "source_start"])

    return _with_repeats(docs, window).mapInArrow(run, "doc_id long, start long, length long, source_id long, source_start long")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every document, as counts and a digest; see :func:`dedup`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpressed(batches):
            out = [(n, n - len(k), hashlib.sha256(b" ".join(k)).hexdigest()) for n, k in _each(batch, WINDOW)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c) for c in zip(*out, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _with_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), WINDOW).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: The same by brute force: all windows of all documents, each compared with its first place.
SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT doc_id, r, s, array_to_string(w[s:s+19], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
first AS (SELECT k, min(doc_id::HUGEINT * 10000000 + s) AS place FROM win GROUP BY k),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, s + unnest(range(0, 20)) AS p FROM win JOIN first USING (k) WHERE doc_id::HUGEINT * 10000000 + s > place)),
word AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT r, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS text FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
