"""Gapped k-mers of sequences.

The windows of a sequence are packed with numpy over whole Arrow batches (sequences
laid end to end), since a rolling two-bit code is not a column expression; the stage
is narrow and everything after it is built-in operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.bases import DIGIT_MASKS, check_k

_COLUMNS = "start int, pos int, key_hi long, key_lo long, mask int, is_rc boolean, palindrome boolean, letter int"
_MASK = np.array(DIGIT_MASKS, np.int32)
_FOUR = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8).view(np.uint32).ravel()
PALINDROME_MASKS = np.array([9, 6, 9, 6], np.int32)  # A or T: W; C or G: S


def pack_arms(digits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each window of ``size`` digits as a number, and its reverse complement, of the type of ``digits``."""
    n = max(0, len(digits) - size + 1)
    twice, wide = (digits, digits ^ 2), 1  # windows of 1, 2, 4, ... digits, of which those in ``size`` are put together
    forward, back, done = digits[:0], digits[:0], 0
    while True:
        if size & wide:
            m = max(0, len(digits) - done - wide + 1)
            if done:
                forward, back = forward[:m] << 2 * wide | twice[0][done : done + m], twice[1][done : done + m] << 2 * done | back[:m]
            else:
                forward, back = twice
            done += wide
        if done == size:
            return forward[:n], back[:n]
        m = max(0, len(twice[0]) - wide)
        twice = twice[0][:m] << 2 * wide | twice[0][wide : wide + m], twice[1][wide : wide + m] << 2 * wide | twice[1][:m]
        wide *= 2


def pack_bases(digits: np.ndarray) -> bytes:
    """Digits of bases, four a byte."""
    four = np.frombuffer(digits.tobytes() + bytes(-len(digits) % 4), "<u4")
    return (four | four >> 6 | four >> 12 | four >> 18).astype(np.uint8).tobytes()


def unpack_bases(raw: bytes) -> np.ndarray:
    return _FOUR[np.frombuffer(raw, np.uint8)].view(np.uint8)


def arms(digits: np.ndarray, h: int, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Each window of ``h`` digits as a number, and its reverse complement; in steps that stay in a core's cache."""
    n = max(0, len(digits) - h + 1)
    forward, back = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(0, n, step):
        forward[a : a + step], back[a : a + step] = pack_arms(digits[a : a + step + h - 1].astype(np.int64), h)
    return forward, back


def within(n: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each of ``n``."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def windows(seqs: list[bytes], quals: list[bytes | None] | None, k: int, rc: bool, quality: str, min_qual: int, places: bool = False) -> dict[str, np.ndarray]:
    """All gapped k-mers of ``seqs``: sequence number, start, packed key, middle mask and strand; or, ``places``, the first two only."""
    h = (k - 1) // 2
    sizes = np.fromiter((len(s) + 1 for s in seqs), np.int64, len(seqs))
    raw = np.frombuffer(b"".join(s + b"N" for s in seqs), np.uint8)  # the sign between sequences is no base
    good = raw & 15 != 14
    good_middle = np.ones(len(raw), bool)
    if quals is not None and quality != "none":
        q = np.frombuffer(b"".join((x if x is not None and len(x) == len(s) else b"\xff" * len(s)) + b"!" for s, x in zip(seqs, quals, strict=True)), np.uint8)
        fine = q.astype(np.int64) - 33 > min_qual
        if quality == "strict":
            good = good & fine
        good_middle = fine
    begins = np.cumsum(sizes) - sizes
    ends = begins + sizes - 1
    n = max(0, len(raw) - k + 1)
    bad = np.concatenate([[0], np.cumsum(~good)])
    at = np.flatnonzero(bad[k:] == bad[:n]) if n else np.empty(0, np.int64)
    seq = np.repeat(np.arange(len(seqs)), sizes)[at]
    # a run of exactly k bases that reaches the sequence's end gives none
    alone = (at + k == ends[seq]) & ((at == begins[seq]) | ~good[np.maximum(at - 1, 0)])
    at, seq = at[~alone & good_middle[at + h]], seq[~alone & good_middle[at + h]]
    if places:
        return {"seq": seq, "start": (at - begins[seq]).astype(np.int32)}
    digits = (raw >> 1 & 3).astype(np.int64)
    forward, back = pack_arms(digits, h)
    up, low, rc_up, rc_low = forward[at], forward[at + h + 1], back[at + h + 1], back[at]
    middle = digits[at + h]
    if rc:
        same = (up == rc_up) & (low == rc_low)
        flip = (up > rc_up) | ((up == rc_up) & (low > rc_low))
        up, low, middle = np.where(flip, rc_up, up), np.where(flip, rc_low, low), np.where(flip, middle ^ 2, middle)
        mask = np.where(same, PALINDROME_MASKS[middle], _MASK[middle])
    else:
        same = flip = np.zeros(len(at), bool)
        mask = _MASK[middle]
    start = (at - begins[seq]).astype(np.int32)
    return {"seq": seq, "start": start, "pos": start + np.int32(h), "key_hi": up, "key_lo": low, "mask": mask, "is_rc": flip, "palindrome": same, "letter": raw[at + h].astype(np.int32)}


def sliced(seqs: list[bytes], quals: list[bytes | None] | None, k: int, rc: bool, quality: str, min_qual: int, size: int, places: bool = False) -> Iterator[dict[str, np.ndarray]]:
    """:func:`windows` of several sequences, or of one in slices of ``size`` windows, so that a chromosome's arrays stay small.

    A slice has a base more on both sides, so that what lies at a slice's end isn't taken for a sequence's end.
    """
    if len(seqs) != 1 or len(seqs[0]) <= size:
        yield windows(seqs, quals, k, rc, quality, min_qual, places)
        return
    (seq,), qual = seqs, quals[0] if quals is not None else None
    if qual is not None and len(qual) != len(seq):
        qual = None
    for lo in range(0, len(seq), size):
        begin, end = max(lo - 1, 0), lo + size + k
        w = windows([seq[begin:end]], None if quals is None else [None if qual is None else qual[begin:end]], k, rc, quality, min_qual, places)
        own = (w["start"] + begin >= lo) & (w["start"] + begin < lo + size)
        w = {name: values[own] for name, values in w.items()}
        w |= {name: w[name] + np.int32(begin) for name in ("start", "pos") if name in w}
        yield w


def _joined(w: dict[str, np.ndarray], row: np.ndarray) -> dict[str, np.ndarray]:
    """The k-mers of ``w`` once for each key and ``row`` number, with their masks joined; ``seq`` is a sequence that has it.

    Equal ones are adjacent in the order of a hash, and are compared.
    """
    own = row[w["seq"]]
    with np.errstate(over="ignore"):
        mixed = (w["key_hi"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w["key_lo"].view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) + own.astype(np.uint64)
    order = np.argsort(mixed ^ (mixed >> np.uint64(31)))
    hi, lo, own = w["key_hi"][order], w["key_lo"][order], own[order]
    new = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]) | (own[1:] != own[:-1])])) if len(order) else order
    mask = np.bitwise_or.reduceat(w["mask"][order], new) if len(new) else w["mask"]
    return {"seq": w["seq"][order[new]], "key_hi": hi[new], "key_lo": lo[new], "mask": mask.astype(np.int32)}


def gapped_kmers(
    seqs: DataFrame, k: int, rc: bool = True, quality: str = "none", min_qual: int = 20, keep: list[str | Column] | None = None, max_bytes: int = 2 << 20, joined: bool = False, letter: bool = False
) -> DataFrame:
    """Every gapped k-mer of every sequence, with the ``keep`` columns of its row.

    ``seqs`` has ``seq`` and, for reads, ``qual``.  Columns: ``start`` and ``pos`` (0-based
    start and middle), ``key_hi``, ``key_lo``, ``mask`` (middle base; a palindromic key
    takes W or S), ``is_rc`` and ``palindrome``.  ``quality``: ``strict`` breaks at a base
    of quality ``min_qual`` or less, ``middle`` asks it of the middle base only, ``none``
    of none.  Null and short sequences give no rows.  ``joined``: a block of sequences
    gives a key once for each value of ``keep``, with its masks joined, and the columns
    after ``mask`` and places are left out; a hot key is then a row a block.  ``letter``
    adds the middle as it is written, a character's number.
    """
    check_k(k)
    if quality not in ("none", "middle", "strict"):
        raise ValueError("quality is none, middle or strict")
    reads = "qual" in seqs.columns and quality != "none"
    names = ["key_hi", "key_lo", "mask"] if joined else ["start", "pos", "key_hi", "key_lo", "mask", "is_rc", "palindrome"] + ["letter"] * letter
    rows = seqs.select(F.struct(*(keep or ["sample"])).alias("row"), F.col("seq").cast("binary").alias("seq"), *([F.col("qual").cast("binary").alias("qual")] if reads else [])).where("seq is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch["seq"]).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + max_bytes, side="right")))
                part = batch.slice(at, to - at)
                at = to
                number: dict[str, int] = {}
                row = np.array([number.setdefault(repr(r), len(number)) for r in part["row"].to_pylist()]) if joined else None
                for w in sliced(part["seq"].to_pylist(), part["qual"].to_pylist() if reads else None, k, rc, quality, min_qual, max_bytes):
                    w = _joined(w, row) if joined else w
                    yield pa.RecordBatch.from_arrays([part["row"].take(pa.array(w["seq"]))] + [pa.array(w[n]) for n in names], names=["row", *names])

    kinds = ", ".join(c for c in _COLUMNS.split(", ") if c.split()[0] in names)
    told = rows.mapInArrow(run, f"row struct<{rows.schema['row'].dataType.simpleString()[7:-1]}>, {kinds}")
    return told.select("row.*", *names)


def plain_kmers(seqs: DataFrame, size: int, keep: list[str | Column], max_bytes: int = 2 << 20) -> DataFrame:
    """Every window of ``size`` bases (even) that are all A, C, G or T: the ``keep`` columns, ``start``, ``hi`` and ``lo``.

    Both halves of a window are packed arms.  A long ``seq`` is taken in slices.
    """
    h = size // 2
    rows = seqs.select(F.struct(*keep).alias("row"), F.col("seq").cast("binary").alias("seq")).where("seq is not null")
    letters = np.zeros(256, bool)
    letters[[65, 67, 71, 84]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                whole = batch["seq"][i].as_buffer()
                for begin in range(0, max(len(whole) - size + 1, 0), max_bytes):
                    raw = np.frombuffer(whole, np.uint8)[begin : begin + max_bytes + size - 1]
                    n = len(raw) - size + 1
                    bad = np.concatenate([[0], np.cumsum(~letters[raw])])
                    at = np.flatnonzero(bad[size:] == bad[:n])
                    packed = pack_arms((raw >> 1 & 3).astype(np.int64), h)[0]
                    yield pa.RecordBatch.from_arrays([batch["row"].take(pa.array(np.full(len(at), i))), pa.array(at + begin), pa.array(packed[at]), pa.array(packed[at + h])], names=["row", "start", "hi", "lo"])

    told = rows.mapInArrow(run, f"row struct<{rows.schema['row'].dataType.simpleString()[7:-1]}>, start bigint, hi bigint, lo bigint")
    return told.select("row.*", "start", "hi", "lo")
