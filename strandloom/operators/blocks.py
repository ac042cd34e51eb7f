"""Index rows in blocks: a task's k-mers by bucket of their keys, sorted and packed.

A block is one row: ``bucket``, ``base``, ``runs`` (sample number and number of k-mers,
int32 pairs) and ``keys`` (packed k-mers; 4 or 8 bytes each, mask included; with arms beyond 15
bases a run is a text, and its bases are packed).  All
blocks of a bucket go to one task, which has every entry of a key at once: what is told
of keys (filters, columns, sums for pairs, sample sets) needs this one shuffle, and rows
are made of what is told only.  A key has a bucket by its hash; the number of buckets is
fixed, so that blocks of several indexes lie side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.bases import CODES, check_k
from strandloom.functions.kmers import PALINDROME_MASKS, arms, pack_arms, pack_bases, unpack_bases, within

#: Buckets as bits, and length of the m-mers that deal keys with arms beyond 15 bases.
BUCKET_BITS, DEAL = 12, 11
#: K-mers that a task takes at once, if a bucket has fewer; bytes of a sequence's block; cells of letters at once.
AT_ONCE, BLOCK_BYTES, CELLS = 1 << 16, 2 << 20, 1 << 24
#: Bases and samples that a task cuts at once, where a sample's k-mer is kept once (words of 4 and of 8 bytes), and places in a step.
NARROW_BYTES, SAMPLES, STEP = (8 << 20, 6 << 20), 256, 1 << 15
#: Numbers below 0: a sample without a name, and (from here down) lists to weed by.
NAMELESS, WEEDED = -1, -2
_ODD = 0x9E3779B97F4A7C15
_SCHEMA = "bucket int, base int, runs binary, keys binary"
_LETTERS = np.frombuffer(CODES.encode(), np.uint8)


def _unmixed(mixed: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """Both arms of a key that was multiplied by an odd number; the product's upper bits are the bucket."""
    with np.errstate(over="ignore"):
        key = mixed * np.uint64(pow(_ODD, -1, 1 << 64)) & np.uint64((1 << 4 * h) - 1)
    return (key >> np.uint64(2 * h)).astype(np.int64), (key & np.uint64((1 << 2 * h) - 1)).astype(np.int64)


def _kind(h: int) -> type:
    return np.uint32 if h <= 7 else np.uint64


def _words(raw: np.ndarray, kept: np.ndarray, h: int, rc: bool) -> np.ndarray:
    """The packed k-mers that begin at the ``kept`` places of ``raw``, in steps that stay in a core's cache."""
    kind = _kind(h)
    odd, full = kind(_ODD & np.iinfo(kind).max), kind((1 << 4 * h) - 1)
    out, at = np.empty(int(np.count_nonzero(kept)), kind), 0
    for a in range(0, len(kept), STEP):
        own = kept[a : a + STEP]
        n, digits = len(own), raw[a : a + len(own) + 2 * h] >> 1 & 3
        forward, back = pack_arms(digits.astype(np.uint32), h)
        key, middle = forward[:n].astype(kind) << kind(2 * h) | forward[h + 1 : h + 1 + n], digits[h : h + n]
        if rc:
            other = back[h + 1 : h + 1 + n].astype(kind) << kind(2 * h) | back[:n]
            middle = middle ^ (key > other).view(np.uint8) << 1
        mask = np.uint8(1) << (middle ^ middle >> 1)
        if rc:
            same = np.flatnonzero(key == other)
            mask[same] = PALINDROME_MASKS[middle[same]]
            key = np.minimum(key, other)
        key *= odd
        key &= full
        key <<= kind(4)
        key |= mask
        key = key[own]
        out[at : at + len(key)] = key
        at += len(key)
    return out


def _begins(good: np.ndarray, k: int) -> np.ndarray:
    """At each place, whether ``k`` good bases begin there."""
    n = max(0, len(good) - k + 1)
    out = np.empty(n, bool)
    for a in range(0, n, STEP):
        x, wide = good[a : a + STEP + k - 1], 1
        while wide < k:
            step = min(wide, k - wide)
            x, wide = x[: len(x) - step] & x[step:], wide + step
        out[a : a + STEP] = x
    return out


@dataclass
class Text:
    """A sequence, or the part of a long one whose k-mers begin from ``skip`` on, ``most`` places at most."""

    no: int
    seq: bytes
    qual: bytes | None
    skip: int = 0
    most: int | None = None

    def parts(self, size: int, k: int) -> Iterator[Text]:
        """As it is, or in parts of ``size`` places with a base more on both sides, so that what lies at a part's end isn't taken for the sequence's."""
        if len(self.seq) <= size:
            yield self
            return
        qual = self.qual if self.qual is not None and len(self.qual) == len(self.seq) else None
        for lo in range(0, len(self.seq), size):
            own = slice(max(lo - 1, 0), lo + size + k)
            yield Text(self.no, self.seq[own], qual and qual[own], lo - own.start, size)


def starts(texts: list[Text], k: int, quality: str, min_qual: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``texts`` laid end to end, at each place whether a k-mer begins there, and where each text begins."""
    sizes = np.array([len(t.seq) for t in texts], np.int64)
    raw = np.frombuffer(b"N".join([*(t.seq for t in texts), b""]), np.uint8)  # the sign between sequences is no base
    good = middle = raw & 15 != 14
    if quality != "none":
        q = np.frombuffer(b"!".join([*(t.qual if t.qual is not None and len(t.qual) == len(t.seq) else b"\xff" * len(t.seq) for t in texts), b""]), np.uint8)
        middle = q.astype(np.int16) - 33 > min_qual
        good = good & middle if quality == "strict" else good
    kept = _begins(good, k)
    if quality != "none":
        kept &= middle[(k - 1) // 2 :][: len(kept)]
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    last = (ends - k)[sizes >= k]  # a run of exactly k bases that reaches the sequence's end gives none
    kept[last[(last == 0) | ~good[np.maximum(last - 1, 0)]]] = False
    for t, begin, end in zip(texts, begins.tolist(), ends.tolist(), strict=True):
        if t.most is not None:
            kept[begin : begin + t.skip] = False
            kept[begin + t.skip + t.most : end] = False
    return raw, kept, begins


def _block(texts: list[Text], k: int, rc: bool, quality: str, min_qual: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket of each run, its number and size, and the packed k-mers of ``texts``, by bucket, number and key, each once; arms of up to 15 bases."""
    h = (k - 1) // 2
    texts = sorted(texts, key=lambda t: t.no)
    numbers = np.array([t.no for t in texts], np.int32)
    raw, kept, begins = starts(texts, k, quality, min_qual)
    words = _words(raw, kept, h, rc)
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    places = np.append(begins[first], len(kept)).tolist()
    at, own = 0, []
    bits = 4 * h + 4
    bounds = np.arange(1, 1 << min(BUCKET_BITS, 4 * h), dtype=np.uint64) << np.uint64(max(bits - BUCKET_BITS, 4))
    edges = np.zeros((len(first), len(bounds) + 2), np.int64)
    for i in range(len(first)):
        n = int(np.count_nonzero(kept[places[i] : places[i + 1]]))
        w = words[at : at + n]
        at += n
        w.sort()
        w = w[np.concatenate([[True], w[1:] != w[:-1]])] if n else w
        new = np.concatenate([[True], w[1:] >> w.dtype.type(4) != w[:-1] >> w.dtype.type(4)]) if n else np.empty(0, bool)
        more = np.flatnonzero(~new)
        if len(more):  # keys with several masks
            once = np.flatnonzero(new)
            np.bitwise_or.at(w, once[np.searchsorted(once, more) - 1], w[more])
            w = w[once]
        own.append(w)
        edges[i, 1:-1], edges[i, -1] = np.searchsorted(w, bounds.astype(w.dtype)), len(w)
    sizes = np.diff(edges, axis=1)
    to = np.cumsum(sizes.T.ravel()).reshape(sizes.shape[::-1]).T - sizes
    out = np.empty(int(sizes.sum()), words.dtype)
    for w, size, begin, place in zip(own, sizes, edges, to, strict=True):
        out[np.repeat(place - begin[:-1], size) + np.arange(len(w))] = w
    bucket, i = np.nonzero(sizes.T)
    yield bucket.astype(np.int32), np.stack([numbers[first][i], sizes[i, bucket]], axis=1).astype(np.int32), out


def _dealt(digits: np.ndarray, at: np.ndarray, h: int) -> np.ndarray:
    """The bucket of the key at each of some places: by the least canonical m-mer of its arms, which neighbours mostly share."""
    forward, back = arms(digits, DEAL)
    with np.errstate(over="ignore"):
        x = np.minimum(forward, back).astype(np.uint64) * np.uint64(_ODD)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        left, wide = h - DEAL + 1, 1  # the least of an arm
        while wide < left:
            step = min(wide, left - wide)
            x, wide = np.minimum(x[: len(x) - step], x[step:]), wide + step
        x = np.minimum(x[at], x[at + h + 1])
        return ((x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _again(digits: np.ndarray, new: np.ndarray, long: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Whether a text (``long`` digits from ``new`` on) of the same ``own`` number came before."""
    hashed = np.zeros(len(new), np.uint64)
    with np.errstate(over="ignore"):
        place = within(long).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        own_digits = digits[np.repeat(new, long) + within(long)]
        x = (own_digits + np.uint64(1)) * (place * np.uint64(_ODD) ^ place << np.uint64(40))
        hashed = np.add.reduceat(x ^ x >> np.uint64(31), np.cumsum(long) - long)
    order = np.lexsort((hashed, long, own))
    same = np.flatnonzero((hashed[order[1:]] == hashed[order[:-1]]) & (long[order[1:]] == long[order[:-1]]) & (own[order[1:]] == own[order[:-1]]))
    out = np.zeros(len(new), bool)
    if len(same):
        one, other, n = order[same + 1], order[same], long[order[same]]
        equal = digits[np.repeat(new[one], n) + within(n)] == digits[np.repeat(new[other], n) + within(n)]
        out[one] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
    return out


def _wide_block(texts: list[Text], k: int, rc: bool, quality: str, min_qual: int) -> Iterator[tuple[np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """Bucket of each run, its number and size, all texts of adjacent k-mers, and where each one's bytes begin; arms beyond 15 bases.

    A k-mer of these takes 16 bytes, a text of several little more.
    """
    h = (k - 1) // 2
    raw, kept, begins = starts(texts, k, quality, min_qual)
    at = np.flatnonzero(kept)
    if not len(at):
        return
    digits = (raw >> 1 & 3).astype(np.uint8)
    bucket = _dealt(digits, at, h)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (bucket[1:] != bucket[:-1])]))
    n = np.diff(np.append(new, len(at)))
    own = np.array([t.no for t in texts], np.int32)[np.searchsorted(begins, at[new], "right") - 1]
    fresh = ~_again(digits, at[new], n + k - 1, own)
    new, n, own = new[fresh], n[fresh], own[fresh]
    order = np.lexsort((own, bucket[new]))
    new, n, own = new[order], n[order], own[order]
    long = n + k - 1
    padded = -(-long // 4) * 4
    ends = np.cumsum(padded)
    text = np.zeros(int(ends[-1]), np.uint8)
    inside = within(long)
    text[np.repeat(ends - padded, long) + inside] = digits[np.repeat(at[new], long) + inside]
    yield bucket[new], np.stack([own, n], axis=1).astype(np.int32), pack_bases(text), np.append(ends - padded, ends[-1]) // 4


def _wide_words(runs: np.ndarray, texts: bytes, k: int, rc: bool) -> np.ndarray:
    """The packed k-mers (2 words a row) of the ``texts`` of some runs, in order."""
    h, n = (k - 1) // 2, runs[:, 1].astype(np.int64)
    digits = unpack_bases(texts)
    padded = -(-(n + k - 1) // 4) * 4
    at = np.repeat(np.cumsum(padded) - padded, n) + within(n)
    forward, back = arms(digits, h)
    hi, lo, middle = forward[at], forward[at + h + 1], digits[at + h]
    mask = np.uint8(1) << (middle ^ middle >> 1)
    if rc:
        r_hi, r_lo = back[at + h + 1], back[at]
        flip = (hi > r_hi) | ((hi == r_hi) & (lo > r_lo))
        same = (hi == r_hi) & (lo == r_lo)
        other = middle ^ 2
        mask = np.where(same, PALINDROME_MASKS[middle], np.where(flip, np.uint8(1) << (other ^ other >> 1), mask))
        hi, lo = np.where(flip, r_hi, hi), np.where(flip, r_lo, lo)
    hi, lo, mask = hi.astype(np.uint64), lo.astype(np.uint64), mask.astype(np.uint64)
    return np.stack([hi << np.uint64(2) | mask >> np.uint64(2), lo << np.uint64(2) | mask & np.uint64(3)], axis=1)


def cut(seqs: DataFrame, number: Column, k: int, rc: bool, quality: str = "none", min_qual: int = 20) -> DataFrame:
    """The blocks of all gapped k-mers of ``seqs`` (``seq``, for reads ``qual``); ``number`` is the sample's."""
    h, reads = (check_k(k) - 1) // 2, "qual" in seqs.columns and quality != "none"
    quality = quality if reads else "none"
    rows = seqs.select(number.cast("int").alias("no"), F.col("seq").cast("binary").alias("seq"), *([F.col("qual").cast("binary").alias("qual")] if reads else [])).where("seq is not null")
    tell, size = (_block, NARROW_BYTES[h > 7]) if h <= 15 else (_wide_block, BLOCK_BYTES)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Text]]:
        held, n, numbers = [], 0, set()
        for batch in batches:
            for i in range(batch.num_rows):
                whole = Text(batch["no"][i].as_py(), batch["seq"][i].as_py(), batch["qual"][i].as_py() if reads else None)
                for text in whole.parts(size, k):
                    numbers.add(text.no)
                    if held and (n + len(text.seq) > size or len(numbers) > SAMPLES):
                        yield held
                        held, n, numbers = [], 0, {text.no}
                    held.append(text)
                    n += len(text.seq)
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in texts(batches):
            for bucket, runs, words, *places in tell(own, k, rc, quality, min_qual):
                if not len(bucket):
                    continue
                first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                runs_at = np.append(first, len(bucket))
                keys_at = (places[0] if places else np.append(0, np.cumsum(runs[:, 1], dtype=np.int64)) * words.dtype.itemsize)[runs_at]
                told = [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(o.astype(np.int32)), pa.py_buffer(x)]) for o, x in ((runs_at * 8, np.ascontiguousarray(runs)), (keys_at, words))]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(np.zeros(len(first), np.int32)), *told], names=["bucket", "base", "runs", "keys"])

    return rows.mapInArrow(run, _SCHEMA)


@dataclass
class Keys:
    """Whole keys with all their entries: entry ``i`` is of key ``key[i]``, number ``no[i]`` and has ``mask[i]``; entries lie by key, then number."""

    hi: np.ndarray
    lo: np.ndarray
    key: np.ndarray
    no: np.ndarray
    mask: np.ndarray

    def keys(self, kept: np.ndarray) -> Keys:
        """These keys only."""
        own, new = kept[self.key], np.cumsum(kept) - 1
        return Keys(self.hi[kept], self.lo[kept], new[self.key[own]], self.no[own], self.mask[own])

    def entries(self, kept: np.ndarray) -> Keys:
        """These entries only, and the keys that have any."""
        left = Keys(self.hi, self.lo, self.key[kept], self.no[kept], self.mask[kept])
        there = np.zeros(len(self.hi), bool)
        there[left.key] = True
        return left if there.all() else left.keys(there)

    @property
    def starts(self) -> np.ndarray:
        return np.flatnonzero(np.concatenate([[True], self.key[1:] != self.key[:-1]])) if len(self.key) else np.empty(0, np.int64)

    def part(self, a: int, b: int) -> Keys:
        lo, hi = np.searchsorted(self.key, [a, b])
        return Keys(self.hi[a:b], self.lo[a:b], self.key[lo:hi] - a, self.no[lo:hi], self.mask[lo:hi])


def _keys(words: np.ndarray, no: np.ndarray, h: int, n: np.ndarray | None = None) -> Keys:
    """Packed k-mers in any order, equal ones joined; ``no`` is of each, or of runs of ``n``."""
    low = int(no.min()) if len(no) else 0
    own = (no - low).astype(np.uint64)
    bits = max(1, int(own.max()).bit_length() if len(own) else 1)
    each = lambda x: x if n is None else np.repeat(x, n)
    if h <= 15 and 4 * h + 4 + bits <= 64:  # key, number and mask are one number
        x = words.astype(np.uint64)
        mask = x & np.uint64(15)
        x >>= np.uint64(4)
        x <<= np.uint64(bits + 4)
        x |= mask
        x |= each(own << np.uint64(4))
        x.sort()
        pair = x >> np.uint64(4)
        new = np.ones(len(x), bool)
        np.not_equal(pair[1:], pair[:-1], out=new[1:])
        mask = (x & np.uint64(15)).astype(np.int32)
        if not new.all():
            more, starts = np.flatnonzero(~new), np.flatnonzero(new)
            np.bitwise_or.at(mask, starts[np.searchsorted(starts, more) - 1], mask[more])
            pair, mask = pair[starts], mask[starts]
        mixed, no = pair >> np.uint64(bits), (pair & np.uint64((1 << bits) - 1)).astype(np.int64) + low
        begin = np.ones(len(mixed), bool)
        np.not_equal(mixed[1:], mixed[:-1], out=begin[1:])
        hi, lo = _unmixed(mixed[begin], h)
        return Keys(hi, lo, np.cumsum(begin) - 1, no, mask)
    own = each(own)
    if h <= 15:
        words = words.astype(np.uint64)
        mask, value = (words & np.uint64(15)).astype(np.int32), [words >> np.uint64(4)]
    else:
        mask, value = ((words[:, 0] & np.uint64(3)) << np.uint64(2) | words[:, 1] & np.uint64(3)).astype(np.int32), [words[:, 0] >> np.uint64(2), words[:, 1] >> np.uint64(2)]
    order = np.lexsort((own, *reversed(value)))
    mask, own, value = mask[order], own[order], [v[order] for v in value]
    first = np.concatenate([[True], np.logical_or.reduce([v[1:] != v[:-1] for v in value])]) if len(own) else np.empty(0, bool)
    new = np.flatnonzero(first | np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    mask = np.bitwise_or.reduceat(mask, new) if len(new) else mask
    begin = first[new]
    at = new[begin]
    hi, lo = _unmixed(value[0][at], h) if h <= 15 else (value[0][at].astype(np.int64), value[1][at].astype(np.int64))
    return Keys(hi, lo, np.cumsum(begin) - 1, own[new].astype(np.int64) + low, mask)


Step = Callable[[Keys], Keys]


@dataclass(frozen=True)
class Blocks:
    """The blocks of an index, the names that its numbers stand for, and what is done to its keys, in order."""

    k: int
    names: tuple[str, ...]
    rows: DataFrame
    steps: tuple[Step, ...] = ()
    #: how many lists it is weeded by
    lists: int = 0
    #: whether a key is that of both strands; texts of k-mers are read so
    rc: bool = True
    #: the place in ``names`` of each number in ``rows``, if they differ
    numbers: tuple[int, ...] = ()

    def then(self, step: Step) -> Blocks:
        return replace(self, steps=(*self.steps, step))

    def map(self, tell: Callable[[Iterator[Keys]], Iterator[pa.RecordBatch]], schema: str, names: tuple[str, ...]) -> DataFrame:
        """``tell`` over the keys of every task, with numbers as places in ``names``; entries of other samples are left out."""
        h, steps, place = (self.k - 1) // 2, self.steps, {n: i for i, n in enumerate(names)}
        to = np.array([place.get(n, -1) for n in self.names] or [0], np.int64)
        same = bool((to == np.arange(len(to))).all())
        k, rc, wide, numbers = self.k, self.rc, h > 15, np.array(self.numbers, np.int64)

        def told(held: list[tuple[bytes, bytes, int]]) -> Keys:
            runs = np.frombuffer(b"".join(r for r, _, _ in held), np.int32).reshape(-1, 2)
            base = np.repeat([b for _, _, b in held], [len(r) // 8 for r, _, _ in held])
            own = np.where(runs[:, 0] >= 0, runs[:, 0] + base, runs[:, 0])
            if len(numbers):
                own = np.where(own >= 0, numbers[np.maximum(own, 0)], own)
            words = b"".join(x for _, x, _ in held)
            keys = _keys(_wide_words(runs, words, k, rc) if wide else np.frombuffer(words, _kind(h)), own, h, runs[:, 1])
            for step in steps:
                keys = step(keys)
            if not same:
                moved = np.where(keys.no >= 0, to[np.maximum(keys.no, 0)], NAMELESS)
                keys = replace(keys, no=moved)
                order = np.lexsort((keys.no, keys.key))
                keys = replace(keys, no=keys.no[order], mask=keys.mask[order])
            return keys

        def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Keys]:
            held, n, last = [], 0, -1
            for batch in batches:
                for bucket, base, runs, keys in zip(*(batch[c].to_pylist() for c in ("bucket", "base", "runs", "keys")), strict=True):
                    if bucket != last and n >= AT_ONCE:
                        yield told(held)
                        held, n = [], 0
                    last = bucket
                    held.append((runs, keys, base))
                    n += len(keys) * 4 - len(runs) // 8 * (k - 1) if wide else len(keys) // np.dtype(_kind(h)).itemsize
            if held:
                yield told(held)

        return self.rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: tell(groups(batches)), schema)


def together(all_: list[Blocks]) -> Blocks | None:
    """The blocks of several indexes, with the samples of the same name as one; none if something was done to them yet."""
    if any(b.steps or b.lists for b in all_):
        return None
    stored = [tuple(b.names[i] for i in b.numbers) if b.numbers else b.names for b in all_]
    names = tuple(dict.fromkeys(n for own in stored for n in own))
    place, rows, base = {n: i for i, n in enumerate(names)}, None, 0
    for b, own in zip(all_, stored, strict=True):
        moved = b.rows.withColumn("base", F.col("base") + F.lit(base).cast("int"))
        rows, base = moved if rows is None else rows.unionByName(moved), base + len(own)
    return replace(all_[0], names=names, rows=rows, numbers=tuple(place[n] for own in stored for n in own))


def side_by_side(all_: list[Blocks]) -> Blocks | None:
    """The blocks of several indexes with samples of their own; none if something was done to them yet, or names are the same."""
    names = [n for b in all_ for n in b.names]
    return together(all_) if len(set(names)) == len(names) else None


def weeded(blocks: Blocks, seqs: DataFrame, rc: bool, reverse: bool) -> Blocks:
    """Without the keys of ``seqs``, or with these only."""
    mark = WEEDED - blocks.lists

    def step(keys: Keys) -> Keys:
        listed = np.zeros(len(keys.hi), bool)
        listed[keys.key[keys.no == mark]] = True
        left = keys.keys(listed if reverse else ~listed)
        return left.entries(left.no != mark)

    rows = blocks.rows.unionByName(cut(seqs, F.lit(mark), blocks.k, rc))
    return replace(blocks, rows=rows, steps=(*blocks.steps, step), lists=blocks.lists + 1)


def key_text(keys: Keys, h: int) -> pa.Array:
    """The digits of both arms."""
    n = len(keys.hi)
    out = np.empty((n, 2 * h), np.uint8)
    for j in range(h):
        out[:, j] = keys.hi >> 2 * (h - 1 - j) & 3
        out[:, h + j] = keys.lo >> 2 * (h - 1 - j) & 3
    out += 48
    return _strings(out)


def _strings(letters: np.ndarray) -> pa.Array:
    """A string a row."""
    n, wide = letters.shape
    return pa.StringArray.from_buffers(n, pa.py_buffer((np.arange(n + 1) * wide).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(letters)))


def bounded(keys: Keys, wide: int) -> Iterator[Keys]:
    """``keys`` in parts of at most so many that ``wide`` cells each are held at once."""
    step = max(1, CELLS // wide)
    for a in range(0, len(keys.hi), step):
        yield keys.part(a, a + step) if len(keys.hi) > step else keys


def letters(keys: Keys, n_samples: int, between: str = "") -> pa.Array:
    """One code for each sample, gaps as ``-``."""
    every = 1 + len(between)
    out = np.full((len(keys.hi), max(n_samples * every - len(between), 0)), ord("-"), np.uint8)
    if between:
        out[:, 1::2] = ord(between)
    out[keys.key, keys.no * every] = _LETTERS[keys.mask]
    return _strings(out)


def named(keys: Keys) -> Keys:
    """Entries of samples with a name."""
    return keys.entries(keys.no >= 0) if len(keys.no) and keys.no.min() < 0 else keys


def long_rows(blocks: Blocks, names: tuple[str, ...], text: bool = False) -> DataFrame:
    """``sample``, the key (``key_hi`` and ``key_lo``, or ``text``: its digits as ``key``) and ``mask`` of every entry."""
    h = (blocks.k - 1) // 2

    def tell(groups: Iterator[Keys]) -> Iterator[pa.RecordBatch]:
        name = pa.array([*names, None], pa.string())
        for every in groups:
            for keys in bounded(every, 8 * h):
                sample, mask = name.take(pa.array(np.where(keys.no < 0, len(names), keys.no))), pa.array(keys.mask)
                if text:
                    yield pa.RecordBatch.from_arrays([sample, key_text(keys, h).take(pa.array(keys.key)), mask], names=["sample", "key", "mask"])
                else:
                    yield pa.RecordBatch.from_arrays([sample, pa.array(keys.hi[keys.key]), pa.array(keys.lo[keys.key]), mask], names=["sample", "key_hi", "key_lo", "mask"])

    return blocks.map(tell, f"sample string, {'key string' if text else 'key_hi long, key_lo long'}, mask int", names)


def wide_rows(blocks: Blocks, names: tuple[str, ...], between: str = "", text: bool = True) -> DataFrame:
    """The key (its digits as ``key``, or ``key_hi`` and ``key_lo``) and ``bases``, a code for each sample in order."""
    h, n = (blocks.k - 1) // 2, len(names)

    def tell(groups: Iterator[Keys]) -> Iterator[pa.RecordBatch]:
        for every in groups:
            for keys in bounded(named(every), n * (1 + len(between)) + 2 * h):
                own = {"key": key_text(keys, h)} if text else {"key_hi": pa.array(keys.hi), "key_lo": pa.array(keys.lo)}
                yield pa.RecordBatch.from_pydict(own | {"bases": letters(keys, n, between)})

    return blocks.map(tell, f"{'key string' if text else 'key_hi long, key_lo long'}, bases string", names)


def counted(blocks: Blocks, names: tuple[str, ...]) -> DataFrame:
    """``n``: the number of keys of each part of the table."""

    def tell(groups: Iterator[Keys]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(k.hi) for k in groups)], pa.int64())})

    return blocks.map(tell, "n long", names)


def coloured(blocks: Blocks, names: tuple[str, ...], words: list[str]) -> DataFrame:
    """``key_hi key_lo b`` and the sample set (``words``) of every k-mer."""

    def tell(groups: Iterator[Keys]) -> Iterator[pa.RecordBatch]:
        for every in groups:
            keys = named(every)
            if not len(keys.hi):
                continue
            starts, bit = keys.starts, np.int64(1) << (keys.no & 63)
            for b, m in enumerate((1, 2, 8, 4)):
                own = np.where(keys.mask & m != 0, bit, 0)
                sets = [np.bitwise_or.reduceat(np.where(keys.no >> 6 == i, own, 0), starts) for i in range(len(words))]
                there = np.flatnonzero(np.bitwise_or.reduce(sets))
                yield pa.RecordBatch.from_arrays([pa.array(keys.hi[there]), pa.array(keys.lo[there]), pa.array(np.full(len(there), b, np.int32)), *(pa.array(s[there]) for s in sets)], names=["key_hi", "key_lo", "b", *words])

    return blocks.map(tell, f"key_hi long, key_lo long, b int, {', '.join(f'{w} long' for w in words)}", names)
