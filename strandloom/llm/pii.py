"""Personal data: base patterns, and a character tagger that adds what they miss.

The tagger (:mod:`strandloom.llm.tagger`) is trained on labelled spans that a seeded
generator writes into invented text: the base formats and others, such as phone
numbers without a plus sign or card numbers with a wrong check digit, and secrets (keys
and tokens after their names), next to numbers that are no personal data.  Each kind
holds a digit or an ``@``, so windows without either are tagged "outside" by definition
and need no decoding.  Windows overlap by half; parts of a span that windows cut are
joined where they meet, a part whose other end no window saw is dropped, and all spans
are reconciled over the whole text, the longer span first.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.resident import release
from strandloom.llm.tagger import KINDS, TAGS, Tagger, symbols
from strandloom.llm.tokens import in_blocks

WIDTH, STRIDE = 96, 48
#: Labelled windows and training rounds of the tagger.
TRAIN_WINDOWS, TRAIN_ROUNDS = 5000, 480
#: Share of the training windows that end early, as short texts and the last windows of long ones do.
SHORT = 0.4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
#: Numbers of the kinds that have a base pattern.
BASE_KINDS = range(4)

Span = tuple[int, int, int]  # start, number of the kind, end


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each ``@``: linear in the text."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = at = match.end()
        else:
            at += 1
            done = max(done, at)


def base_spans(text: str) -> list[Span]:
    """The spans of the base patterns, by start and then kind."""
    if not _TRIGGER.search(text):
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


# ---- labelled spans for training


def _generator(rng: np.random.Generator):
    pick = lambda options: options[int(rng.integers(len(options)))]
    num = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    syllables = ["an", "er", "the", "ing", "ou", "st", "ver", "ein", "que", "la", "ción", "eau", "ñ", "ü", "tion", "re", "sch", "or", "no", "mi"]
    word = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
    case = lambda w: pick([w, w, w, w.capitalize(), w.upper()])
    plain = lambda: re.sub("[^a-z]", "x", word())

    def email() -> str:
        return pick([f"{plain()}.{num(2)}", f"{plain()}.{plain()}", plain(), f"{plain()}_{plain()}", f"{plain()}+{num(1)}", f"{plain()}{num(3)}"]) + pick(["@", "@", " @ ", " @ "]) + pick([f"mail{num(1)}.", "", f"{plain()}-"]) + plain() + pick([".com", ".org", ".co.uk", ".de"])

    def ip() -> str:
        return ".".join(str(int(rng.integers(0, 256))) for _ in range(4))

    def card() -> str:
        n = num(int(pick([14, 15, 16, 16, 16, 16, 19])))
        sep = pick(["", "", " ", "-", "."])
        return sep.join(n[i : i + 4] for i in range(0, len(n), 4))

    def phone() -> str:
        area = pick([f"({num(3)}) ", f"{num(3)}-", f"{num(3)} ", f"{num(3)}.", f"({num(3)})"])
        return pick([f"+{num(1)} ", f"+{num(2)} ", f"+{num(2)}-", "", "", f"{num(1)}-"]) + area + num(3) + pick(["-", " ", ".", "-"]) + num(4)

    def secret() -> tuple[str, str]:
        n = int(pick([16, 20, 24, 32, 40, 40, 40, 64]))
        letters = pick(["0123456789abcdef"] * 4 + ["0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"])
        value = "".join(letters[i] for i in rng.integers(0, len(letters), n))
        name = pick(["token", "token", "token", "secret", "key", "api_key", "password", "access_token", "client_secret", "auth"])
        name, quote = pick([name, name, name, name.upper(), name.capitalize()]), pick(['"', '"', '"', "'", ""])
        return f"{name}{pick([' = ', ' = ', '=', ': ', ':'])}{quote}", value + quote

    def harmless() -> str:
        year, day = f"{pick(['19', '20'])}{num(2)}", f"{num(2)}"
        return pick([
            year, num(int(rng.integers(1, 7))), f"{num(1)}.{num(1)}.", f"{num(1)}.{num(1)}", f"{num(1)}.{num(2)}.{num(1)}", f"{day}:{num(2)}", f"{year}-{day}-{num(2)}", f"{day}/{num(2)}/{year}",
            f"{num(2)}%", f"${num(3)}.{num(2)}", hashlib.sha1(num(9).encode()).hexdigest(), f'"{hashlib.sha1(num(9).encode()).hexdigest()}"', f"v{num(1)}.{num(1)}", f"@{plain()}", f"{word()}{num(2)}",
            f"{pick(['order', 'ref', 'invoice', 'no.', 'id', 'case'])}{pick([' ', ' ', ': ', ' #'])}{num(int(rng.integers(8, 16)))}", f"ISBN {pick(['978', '979'])}-{num(1)}-{num(3)}-{num(5)}-{num(1)}", f"{year}-{day}-{num(2)}T{num(2)}:{num(2)}:{num(2)}",
            f"{num(3)} {num(3)}", f"{num(2)}, {num(2)} {word()} {num(3)}", f"{num(9)}", f"{num(1)},{num(3)},{num(3)}", f"{num(2)}-{num(2)}", f"({num(1)})", f"[{num(2)}]",
        ])

    makers = [email, ip, card, phone, secret]

    def window() -> tuple[str, list[Span]]:
        text, spans, mark = "", [], pick(["", "", "", "!!", "%%%", "###", "$$$", "&&&", "***"])
        while len(text) < WIDTH + 40:
            kind = int(rng.integers(0, len(makers))) if rng.random() < 0.17 else -1
            if kind >= 0:
                own = makers[kind]()
                before, own = own if isinstance(own, tuple) else ("", own)
                text += before
                spans.append((len(text), kind, len(text) + len(own.rstrip("\"'"))))
                text += own
            else:
                text += harmless() if rng.random() < 0.12 else case(word())
            text += mark + pick([" ", " ", " ", " ", ", ", ". ", ".\n", "; ", ": ", " | "])
        cut = int(rng.integers(0, 40))
        return text[cut : cut + WIDTH], [(a - cut, k, b - cut) for a, k, b in spans]

    return window


def _cut(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """A short text or the end of one: what lies around one span, often nothing behind it."""
    whole = [s for s in spans if s[0] >= 0 and s[2] <= WIDTH]
    if not whole:
        end = int(rng.integers(1, WIDTH))
        return text[:end], [(a, k, min(b, end)) for a, k, b in spans if a < end]
    a, _, b = whole[int(rng.integers(0, len(whole)))]
    begin = 0 if rng.random() < 0.5 else max(0, a - int(rng.integers(0, 40)))
    quote = b < WIDTH and text[b : b + 1] in "\"'"
    end = min(WIDTH, b + quote + (0 if rng.random() < 0.5 else int(rng.integers(0, 30))))
    return text[begin:end], [(x - begin, k, min(y, end) - begin) for x, k, y in spans if y > begin and x < end]


def labelled_windows(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of ``n`` invented windows."""
    make = _generator(np.random.default_rng(seed))
    rng, texts, tags = np.random.default_rng(seed + 1), [], np.zeros((n, WIDTH), np.int64)
    for i in range(n):
        text, spans = make()
        if rng.random() < SHORT:
            text, spans = _cut(text, spans, rng)
        texts.append(text)
        for a, kind, b in spans:
            if b > 0 and a < WIDTH:
                tags[i, max(a, 0) : min(b, WIDTH)] = 2 + 2 * kind
                tags[i, max(a, 0)] = 1 + 2 * kind
    return symbols(texts, WIDTH), tags


@lru_cache(maxsize=2)
def trained(windows: int = TRAIN_WINDOWS, rounds: int = TRAIN_ROUNDS) -> Tagger:
    """The tagger; training is seeded and takes some seconds, once for each process."""
    tagger = Tagger()
    tagger.train(*labelled_windows(windows), rounds)
    tagger.p = {k: v.astype(np.float32) for k, v in tagger.p.items()}
    return tagger


# ---- tagging whole texts

#: Least and greatest number of digits of a span that the tagger may add.
_BOUNDS = {0: (0, 99), 1: (4, 12), 2: (13, 19), 3: (9, 15), 4: (1, 500)}


def _plausible(kind: int, text: str) -> bool:
    low, high = _BOUNDS[kind]
    if not low <= len(_digits(text)) <= high or text != text.strip():
        return False
    return {0: text.count("@") == 1 and "." in text.partition("@")[2], 1: text.count(".") == 3, 2: not set(text) - set("0123456789 .-"), 3: not set(text) - set("0123456789 +().-"), 4: len(text) >= 12 and text.isascii() and not set(text) & set(" \t\n\"'")}[kind]


def tagged_spans(texts: list[str], tagger: Tagger, at_once: int = 1024) -> list[list[Span]]:
    """What the tagger finds in each text, reconciled over its windows, without overlaps."""
    parts = [(i, k) for i, text in enumerate(texts) for k in sorted({w for m in _TRIGGER.finditer(text) for w in (m.start() // STRIDE - 1, m.start() // STRIDE) if w >= 0 or len(text) <= WIDTH and w == 0})]
    found: list[list[tuple[int, int, int, bool, bool]]] = [[] for _ in texts]  # start, kind, end, and which ends a window cut
    for lo in range(0, len(parts), at_once):
        own = parts[lo : lo + at_once]
        tags = tagger.decode(symbols([texts[i][k * STRIDE : k * STRIDE + WIDTH] for i, k in own], WIDTH))
        kind = np.where(tags > 0, (tags - 1) // 2 + 1, 0)
        begin = (tags > 0) & (tags % 2 == 1)
        for row, at in zip(*map(np.ndarray.tolist, np.nonzero(begin)), strict=True):
            i, k = own[row]
            end, tag = at + 1, tags[row, at] + 1
            while end < WIDTH and tags[row, end] == tag:
                end += 1
            offset, text = k * STRIDE, texts[i]
            found[i].append((offset + at, int(kind[row, at]) - 1, min(offset + end, len(text)), bool(at == 0 and offset), end == WIDTH and offset + WIDTH < len(text)))
    out = []
    for text, own in zip(texts, found, strict=True):
        whole = [s for s in joined(own) if _plausible(s[1], text[s[0] : s[2]])]
        out.append(_apart(whole, []))
    return out


def joined(parts: list[tuple[int, int, int, bool, bool]]) -> list[Span]:
    """Whole spans from the windows' spans (start, kind, end, cut at its start, cut at its end).

    A part that is cut at its end goes on in a part of the same kind that is cut at
    its start, if the two overlap; what stays cut is dropped.
    """
    whole = [(a, kind, b) for a, kind, b, left, right in parts if not left and not right]
    open_: dict[int, tuple[int, int]] = {}  # by kind: where the last span that goes on began, and how far it is seen
    for a, kind, b, left, right in sorted(x for x in parts if x[3] or x[4]):
        if not left:
            open_[kind] = (a, b)
        elif kind in open_ and a <= open_[kind][1]:
            begin = open_[kind][0]
            if right:
                open_[kind] = (begin, max(b, open_[kind][1]))
            else:
                whole.append((begin, kind, b))
                del open_[kind]
    return whole


def _apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Spans that overlap neither ``taken`` nor each other; longer ones first, then earlier ones."""
    starts, ends = [], []  # of what is taken, as disjoint intervals in order
    for a, _, b in sorted(taken):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    out: list[Span] = []
    for s in sorted(set(spans), key=lambda s: (s[0] - s[2], s)):
        at = bisect_right(starts, s[0])
        if (at == 0 or ends[at - 1] <= s[0]) and (at == len(starts) or s[2] <= starts[at]):
            starts.insert(at, s[0])
            ends.insert(at, s[2])
            out.append(s)
    return sorted(out)


def find_spans(texts: list[str], tagger: Tagger) -> list[tuple[list[Span], list[Span]]]:
    """For each text the base spans, and these with the tagger's additions."""
    base = [base_spans(t) for t in texts]
    return [(b, sorted(b + _apart(more, b))) for b, more in zip(base, tagged_spans(texts, tagger), strict=True)]


def _told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def detect(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``doc_id``, counts by kind, ``base_sha256``, ``spans`` and ``n_spans`` (of all kinds) of every row of ``docs``.

    Spans are ``kind:start:end`` in code points, by start and then kind.  ``n_email`` to
    ``n_phone`` count the base patterns' spans, as ``base_sha256`` does; ``n_secret`` has no
    pattern and counts the tagger's, and ``n_spans`` counts all of ``spans``.  Null and
    empty texts have none; repeated rows come back once each; other columns play no
    part; an empty table gives no rows.
    """
    tagger = tagger or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_blocks(batches):
            found = find_spans([t or "" for t in batch["text"].to_pylist()], tagger)
            counts = np.array([np.bincount([k for _, k, _ in base] + [k for _, k, _ in own if k not in BASE_KINDS], minlength=len(KINDS)) for base, own in found], np.int64).reshape(-1, len(KINDS))
            columns = [pa.array(counts[:, k].copy()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *columns, pa.array([hashlib.sha256(_told(b).encode()).hexdigest() for b, _ in found]), pa.array([_told(own) for _, own in found]), pa.array([len(own) for _, own in found], pa.int64())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string, n_spans long")


def redact_text(text: str, spans: list[Span]) -> str:
    """``text`` with every span (overlapping ones as one) replaced by its kind in brackets."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_chars`` (if there) told anew for changed texts.

    All rows stay; texts without personal data (and null ones) are unchanged.
    """
    tagger = tagger or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in in_blocks(batches):
            texts = batch["text"].to_pylist()
            found = find_spans([t or "" for t in texts], tagger)
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array([t if t is None or not own else redact_text(t, own) for t, (_, own) in zip(texts, found, strict=True)], pa.string()), pa.array([bool(own) for _, own in found])], names=["row", "text", "changed"])

    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*rest).alias("row"), F.col("text").cast("string").alias("text"))
    told = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, text string, changed boolean")
    n_chars = F.when(F.col("changed"), F.length("text").cast("long")).otherwise(F.col("row.n_chars").cast("long")) if "n_chars" in rest else None
    return told.select(*[F.col("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns])


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of every document; see :func:`detect`."""
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))


assert TAGS == 1 + 2 * len(KINDS)
