"""Bases, ambiguity masks and k-mer keys as column expressions.

A base set is a 4-bit mask, A=1 C=2 G=4 T=8 (0: gap), so joining ambiguity codes is a
bitwise OR.  A base is the digit A=0 C=1 T=2 G=3; the digit's complement is
``digit ^ 2``.  A gapped k-mer's key is its two arms of (k-1)/2 bases, each one BIGINT
with two bits a base, for k up to 63.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the IUPAC code of every mask from 0 (gap) to 15.
CODES = "-ACMGRSVTWYHKDBN"
DIGITS = "ACTG"
#: The masks of the digits 0 to 3.
DIGIT_MASKS = [1, 2, 8, 4]
UNKNOWN, GAP = 15, 0


def check_k(k: int) -> int:
    """k-mer lengths are odd, from 5 to 63."""
    if k < 5 or k > 63 or k % 2 == 0:
        raise ValueError("k must be an odd number from 5 to 63")
    return k


def mask_code(mask: Column) -> Column:
    """The IUPAC letter of a mask."""
    return F.substr(F.lit(CODES), F.coalesce(mask, F.lit(0)).cast("int") + 1, F.lit(1))


def code_mask(code: Column) -> Column:
    """The mask of an IUPAC letter of either case (U as T; gap and others 0)."""
    return F.greatest(F.position(F.upper(F.translate(code, "Uu", "TT")), F.lit(CODES)) - 1, F.lit(0)).cast("int")


def complement_mask(mask: Column) -> Column:
    """The four bits in reverse order: A with T, C with G."""
    return (F.shiftright(mask, 3).bitwiseAND(1) + F.shiftright(mask, 1).bitwiseAND(2) + F.shiftleft(mask, 1).bitwiseAND(4) + F.shiftleft(mask, 3).bitwiseAND(8)).cast("int")


def is_ambiguous(mask: Column) -> Column:
    return F.bit_count(mask.cast("int")) > 1


def overlap(a: Column, b: Column) -> Column:
    """The chance that a base drawn from each mask is the same; an unknown base (15) has none."""
    a, b = a.cast("int"), b.cast("int")
    share = F.bit_count(a.bitwiseAND(b)) / (F.bit_count(a) * F.bit_count(b))
    return F.when((a == UNKNOWN) | (b == UNKNOWN) | (a == 0) | (b == 0), F.lit(0.0)).otherwise(share)


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def arm_digits(arm: Column, h: int) -> Column:
    """The ``h`` base-4 digits of a packed arm."""
    return F.concat(*[F.shiftright(arm, 2 * (h - 1 - i)).bitwiseAND(3).cast("string") for i in range(h)])


def arm_bases(arm: Column, h: int) -> Column:
    return F.translate(arm_digits(arm, h), "0123", DIGITS)


def key_digits(k: int, hi: str = "key_hi", lo: str = "key_lo") -> Column:
    """The key as base-4 digits; equal-length digit strings sort as the keys do."""
    h = (k - 1) // 2
    return F.concat(arm_digits(F.col(hi), h), arm_digits(F.col(lo), h))


def _letters(to: str, text: Column) -> Column:
    """The letters a to z of a text, of either case, as the signs of ``to``; all else is left out."""
    table = np.zeros(256, np.uint8)
    for first in b"aA":
        table[first : first + 26] = np.frombuffer(to.encode(), np.uint8)

    def run(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        signs = table[np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        kept = signs > 0
        before = np.concatenate([[0], np.cumsum(kept)])[ends - ends[0]].astype(np.int64)
        out = pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(before), pa.py_buffer(signs[kept]))
        return pc.if_else(pc.is_null(texts), pa.scalar(None, pa.large_string()), out).cast(pa.string())

    return F.arrow_udf(run, "string")(text)


def text_bases(text: Column) -> Column:
    """A stand-in for sequences: the letters of a text as bases, q as unknown."""
    return _letters("ACGTACGTACGTACGTNCGTACGTAC", text)


#: Fixed value: stand-in qualities of the letters a to z (Phred+33).
LETTER_QUALITIES = "IIIIIIIII#+IIIIIIIIII56!I$"


def text_quality(text: Column) -> Column:
    """Qualities that go with :func:`text_bases`, one for each letter."""
    return _letters(LETTER_QUALITIES, text)


def sample_name(path: Column) -> Column:
    """A file's name without folder and ``.fa``, ``.fasta``, ``.fastq`` or ``.fastq.gz``; any other name whole."""
    short = F.regexp_extract(path, r"(?i)([^/]+)\.(?:fa|fasta|fastq|fastq\.gz)$", 1)
    return F.when(short != "", short).otherwise(path)


#: Bit groups that change places, from pairs up to halves of a long.
_SWAPS = [(2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F), (8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF)]


def with_revcomp(df: DataFrame, h: int, **arms: str) -> DataFrame:
    """``df`` with new columns: the reverse complements of packed arms of ``h`` bases.

    Digits are reversed by swapping ever larger groups of bits, each swap a projection of
    its own, so that no expression is written out twice; the complement flips each digit's upper bit.
    """
    df = df.withColumns({new: F.col(old) for new, old in arms.items()})
    for shift, mask in _SWAPS:
        df = df.withColumns({c: F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(mask)).bitwiseOR(F.shiftleft(F.col(c).bitwiseAND(F.lit(mask)), shift)) for c in arms})
    df = df.withColumns({c: F.shiftrightunsigned(c, 32).bitwiseOR(F.shiftleft(c, 32)) for c in arms})
    return df.withColumns({c: F.shiftrightunsigned(c, 64 - 2 * h).bitwiseXOR(F.lit(int("10" * h, 2))) for c in arms})


def pack(text: Column) -> Column:
    """At most 31 bases ACGT as a packed arm."""
    return F.conv(F.translate(text, DIGITS, "0123"), 4, 10).cast("long")


def canonical_key(full: Column, k: int) -> tuple[Column, Column, Column]:
    """(key_hi, key_lo, base digit) of a k-mer in text, on the strand with the smaller key."""
    h = (k - 1) // 2
    back = revcomp(full)
    own, other = [(pack(F.left(s, F.lit(h))), pack(F.right(s, F.lit(h)))) for s in (full, back)]
    flip = (own[0] > other[0]) | ((own[0] == other[0]) & (own[1] > other[1]))
    middle = F.when(flip, F.substr(back, F.lit(h + 1), F.lit(1))).otherwise(F.substr(full, F.lit(h + 1), F.lit(1)))
    return F.when(flip, other[0]).otherwise(own[0]), F.when(flip, other[1]).otherwise(own[1]), (F.position(middle, F.lit(DIGITS)) - 1).cast("int")
