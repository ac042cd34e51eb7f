"""Samples mapped to a reference: hits, pseudoalignments, VCF.

The reference's k-mers meet the index by key.  A position is covered in a sample if a
mapped middle lies within h = (k-1)/2 of it on its contig; there the sample has the
mapped base, or the reference's where the position itself isn't mapped.

What a sample has is kept as runs of covered positions and the positions in them where
it differs from the reference; letters that are the reference's are never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandloom.functions.bases import complement_mask, is_ambiguous, mask_code
from strandloom.functions.kmers import gapped_kmers
from strandloom.operators.index import KEY, Index
from strandloom.operators.samples import row_of, with_number
from strandloom.sources.shared import materialize

#: Positions in a slice of a contig; what is gathered of a contig is gathered by slice.
SLICE = 1 << 12
#: Bases of a reference whose keys may be broadcast; longer ones are joined by sort and merge.
BROADCAST_BASES = 1 << 20


@dataclass(frozen=True)
class Reference:
    """Contigs (``chrom`` in order, ``name``, ``seq``) and their k-mers."""

    k: int
    rc: bool
    contigs: DataFrame
    kmers: DataFrame  # chrom, pos, key_hi, key_lo, mask, is_rc, letter

    @property
    def h(self) -> int:
        return (self.k - 1) // 2


def reference(contigs: DataFrame, k: int, rc: bool = True) -> Reference:
    """The k-mers of ``contigs`` (``chrom``, ``seq``), with repeats."""
    rows = gapped_kmers(contigs, k, rc, keep=["chrom"], letter=True).select("chrom", "pos", *KEY, "mask", "is_rc", "letter")
    return Reference(k, rc, contigs, rows)


def check(index: Index, ref: Reference) -> None:
    """An error if the reference has no k-mers, or none of the samples' k-mers is in it."""
    if ref.kmers.isEmpty():
        raise ValueError("the reference has no valid k-mers")
    if hits(index, ref).isEmpty():
        raise ValueError("no k-mers of the samples map to the reference")


def repeats(ref: Reference) -> DataFrame:
    """Keys that occur more than once over all contigs, and how often."""
    return ref.kmers.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1")


def _slice_of(pos: Column) -> Column:
    return F.floor(pos / SLICE).cast("int")


def _near(middles: DataFrame, h: int) -> DataFrame:
    """``middles`` with every ``slice`` that a position within ``h`` lies in: one, or two at a border."""
    return middles.withColumn("slice", F.explode(F.sequence(_slice_of(F.col("pos") - h), _slice_of(F.col("pos") + h))))


def _islands(near: DataFrame, by: list[str], h: int, *more: Column) -> DataFrame:
    """Runs ``lo`` to ``hi`` (inclusive) of positions within ``h`` of a ``pos``, for each of ``by`` and ``slice``.

    Runs of a slice are disjoint and end at its borders.  A middle's whole window lies on
    its contig, so no run leaves it.
    """
    part = W.partitionBy(*by, "slice").orderBy("pos")
    first = F.coalesce(F.col("pos") - F.lag("pos").over(part) > 2 * h + 1, F.lit(True))
    numbered = near.withColumn("first", first.cast("int")).withColumn("run", F.sum("first").over(part))
    lo, hi = F.greatest(F.min("pos") - h, F.col("slice") * SLICE), F.least(F.max("pos") + h, (F.col("slice") + 1) * SLICE - 1)
    return numbered.groupBy(*by, "slice", "run").agg(lo.alias("lo"), hi.alias("hi"), *more).drop("run")


def _repeat_runs(ref: Reference) -> DataFrame:
    middles = ref.kmers.join(repeats(ref).select(*KEY), KEY, "left_semi").select("chrom", "pos")
    return _islands(_near(middles, ref.h), ["chrom"], ref.h)


def repeat_positions(ref: Reference) -> DataFrame:
    """Distinct ``chrom``, ``pos`` within h of a repeated key's middle."""
    return _repeat_runs(ref).select("chrom", F.explode(F.sequence("lo", "hi")).alias("pos"))


def _met(index: Index, ref: Reference) -> DataFrame:
    """``sample chrom pos mask letter``: the samples' bases and the reference's letters.

    The index is first cut to the reference's keys: Spark moves that semi-join below a build's aggregation
    and shuffle, so that k-mers which aren't in the reference go no further than the task that cut them.
    """
    if (index.k, index.rc) != (ref.k, ref.rc):
        raise ValueError("index and reference differ in k or in strandedness")
    # the size of cut k-mers is unknown to Spark, which would go by the size of the reference's file
    size = ref.contigs.agg(F.sum(F.length("seq"))).first()[0] or 0
    own = ref.kmers if size <= BROADCAST_BASES else ref.kmers.hint("merge")
    joined = own.select("chrom", "pos", *KEY, "is_rc", "letter").join(index.kmers.join(own.select(*KEY), KEY, "left_semi"), KEY)
    return joined.select("sample", "chrom", "pos", F.when(F.col("is_rc"), complement_mask(F.col("mask"))).otherwise(F.col("mask")).cast("int").alias("mask"), "letter")


def hits(index: Index, ref: Reference) -> DataFrame:
    """``sample chrom pos mask``: the index's bases at the reference's middles, on the reference's strand.

    A palindromic key's mask is the same on both strands.
    """
    return _met(index, ref).drop("letter")


def runs(index: Index, ref: Reference, ambig_mask: bool = False) -> DataFrame:
    """``sample chrom slice lo hi diffs``: covered runs, with ``pos`` and ``code`` where the code isn't the reference's letter.

    One shuffle brings the hits of a sample's slice together.  Hits of one position (only
    if a name stands for several samples) join their masks.
    """
    near = _near(_met(index, ref), ref.h).repartition("sample", "chrom", "slice")
    found = near.groupBy("sample", "chrom", "slice", "pos").agg(F.bit_or("mask").alias("mask"), F.min("letter").alias("letter"))
    code = mask_code(F.col("mask"))
    if ambig_mask:
        code = F.when(is_ambiguous(F.col("mask")), "N").otherwise(code)
    found = found.withColumn("code", code)
    differs = (_slice_of(F.col("pos")) == F.col("slice")) & (F.col("code") != F.char("letter"))
    return _islands(found, ["sample", "chrom"], ref.h, F.array_sort(F.collect_list(F.when(differs, F.struct("pos", "code")))).alias("diffs"))


def _overlaid(text: str, lo: Column, hi: Column, patches: str) -> Column:
    """Letters ``lo`` to ``hi`` of the slice's ``text`` (bytes), with the sorted ``patches`` (``pos``, ``code``) in their places."""
    letters = lambda a, b: F.substr(text, a - F.col("slice") * SLICE + 1, b - a).cast("string")
    end = lambda x: x["pos"] + F.length(x["code"])
    begin = lambda i: F.when(i == 0, lo).otherwise(end(F.get(patches, i - 1)))
    told = F.transform(patches, lambda x, i: F.concat(letters(begin(i), x["pos"]), x["code"]))
    return F.concat(F.array_join(told, ""), letters(F.coalesce(end(F.try_element_at(patches, F.lit(-1))), lo), hi + 1))


def slices(ref: Reference, repeat_mask: bool = False) -> DataFrame:
    """``chrom slice text shown masked``: the reference cut into slices, as bytes, and the same with repeats as N.

    ``masked`` are the repeats' stretches, ``pos`` and ``code`` (as many N).
    """
    cut = ref.contigs.where("length(seq) > 0").select("chrom", F.col("seq").cast("binary").alias("seq")).select("chrom", "seq", F.explode(F.sequence(F.lit(0), _slice_of(F.length("seq") - 1))).alias("slice"))
    cut = cut.select("chrom", "slice", F.substr("seq", F.col("slice") * SLICE + 1, F.lit(SLICE)).alias("text"))
    none = F.array().cast("array<struct<pos:int,code:string>>")
    if not repeat_mask:
        return cut.select("chrom", "slice", "text", F.col("text").alias("shown"), none.alias("masked"))
    stretch = F.struct(F.col("lo").alias("pos"), F.repeat(F.lit("N"), F.col("hi") - F.col("lo") + 1).alias("code"))
    masked = _repeat_runs(ref).groupBy("chrom", "slice").agg(F.array_sort(F.collect_list(stretch)).alias("masked"))
    cut = cut.join(masked, ["chrom", "slice"], "left").withColumn("masked", F.coalesce("masked", none))
    last = F.col("slice") * SLICE + F.length("text") - 1
    return cut.select("chrom", "slice", "text", _overlaid("text", F.col("slice") * SLICE, last, "masked").cast("binary").alias("shown"), "masked")


def _told(index: Index, ref: Reference, cut: DataFrame, ambig_mask: bool, repeat_mask: bool) -> DataFrame:
    """:func:`runs` with the slices' columns; what differs at masked positions is left out (a hit's letter is never N itself)."""
    rows = runs(index, ref, ambig_mask).join(cut, ["chrom", "slice"])
    if repeat_mask:
        shown = lambda x: F.substr("shown", x["pos"] - F.col("slice") * SLICE + 1, F.lit(1)).cast("string")
        rows = rows.withColumn("diffs", F.filter("diffs", lambda x: shown(x) != "N"))
    return rows


def _line(rows: DataFrame, by: list[str]) -> DataFrame:
    """Covered stretches of each group joined to a sequence of the contig's length, gaps as ``-``.

    Each stretch brings the gap before it, so the letters are joined once.
    """
    gathered = rows.groupBy(*by, "length").agg(F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("c"))
    end = lambda x: x["pos"] + F.length(x["code"])
    before = lambda i: F.when(i == 0, 0).otherwise(end(F.get("c", i - 1)))
    pieces = F.transform("c", lambda x, i: F.concat(F.repeat(F.lit("-"), (x["pos"] - before(i)).cast("int")), x["code"]))
    last = F.element_at("c", -1)
    return gathered.select(*by, F.concat(F.array_join(pieces, ""), F.repeat(F.lit("-"), (F.col("length") - end(last)).cast("int"))).alias("seq"))


def by_contig(index: Index, ref: Reference, ambig_mask: bool = False, repeat_mask: bool = False) -> DataFrame:
    """``sample``, ``chrom``, ``seq``: each sample over each contig, gaps as ``-``."""
    rows = _told(index, ref, slices(ref, repeat_mask), ambig_mask, repeat_mask)
    pieces = rows.select("sample", "chrom", F.col("lo").alias("pos"), _overlaid("shown", F.col("lo"), F.col("hi"), "diffs").alias("code"))
    lengths = ref.contigs.select("chrom", F.length("seq").cast("int").alias("length"))
    mapped = _line(pieces.join(lengths, "chrom"), ["sample", "chrom"])
    names = index.kmers.sparkSession.createDataFrame([(n,) for n in index.names], "sample string")
    return names.crossJoin(lengths).join(mapped, ["sample", "chrom"], "left").select("sample", "chrom", F.coalesce("seq", F.repeat(F.lit("-"), F.col("length"))).alias("seq"))


def pseudoalignment(index: Index, ref: Reference, ambig_mask: bool = False, repeat_mask: bool = False) -> DataFrame:
    """``sample``, ``seq``: each sample over all contigs in order, gaps as ``-``."""
    grid = by_contig(index, ref, ambig_mask, repeat_mask)
    return grid.groupBy("sample").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chrom", "seq"))), lambda x: x["seq"]), "").alias("seq"))


def map_coverage(index: Index, ref: Reference) -> DataFrame:
    """``sample``, ``covered`` (positions), ``coverage`` (their share of the reference)."""
    spark = index.kmers.sparkSession
    total = ref.contigs.agg(F.sum(F.length("seq")).alias("total"))
    n = runs(index, ref).groupBy("sample").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias("covered"))
    names = spark.createDataFrame([(x,) for x in index.names], "sample string")
    return names.join(n, "sample", "left").join(F.broadcast(total)).select("sample", F.coalesce("covered", F.lit(0)).alias("covered"), (F.coalesce("covered", F.lit(0)) / F.col("total")).alias("coverage"))


def _plain(base: Column) -> Column:
    """A VCF base: A, C, G or T; anything else is N."""
    return F.when(base.isin("A", "C", "G", "T"), base).otherwise("N")


def _segments(own: DataFrame, cut: DataFrame, n: int) -> DataFrame:
    """``chrom slice at end masked``: stretches (``end`` exclusive) whose every position is a site, with the same samples covered.

    Runs, differences and masked stretches begin and end segments; a sweep over a slice's
    edges counts the samples.  A difference is a segment by itself.
    """
    edge = lambda at, cover, mask, differs: F.struct(at.cast("int").alias("at"), F.lit(cover).alias("cover"), F.lit(mask).alias("mask"), F.lit(differs).alias("differs"))
    of_runs = F.concat(
        F.array(edge(F.col("lo"), 1, 0, 0), edge(F.col("hi") + 1, -1, 0, 0)),
        F.transform("diffs", lambda x: edge(x["pos"], 0, 0, 1)), F.transform("diffs", lambda x: edge(x["pos"] + 1, 0, 0, 0)),
    )
    begin = F.col("slice") * SLICE
    of_slices = F.concat(
        F.array(edge(begin, 0, 0, 0), edge(begin + F.length("text"), 0, 0, 0)),
        F.transform("masked", lambda x: edge(x["pos"], 0, 1, 0)), F.transform("masked", lambda x: edge(x["pos"] + F.length(x["code"]), 0, -1, 0)),
    )
    edges = own.select("chrom", "slice", F.inline(of_runs)).unionByName(cut.select("chrom", "slice", F.inline(of_slices)))
    edges = edges.groupBy("chrom", "slice", "at").agg(F.sum("cover").alias("cover"), F.sum("mask").alias("mask"), F.max("differs").alias("differs"))
    part = W.partitionBy("chrom", "slice").orderBy("at")
    swept = edges.select("chrom", "slice", "at", F.lead("at").over(part).alias("end"), F.sum("cover").over(part).alias("covered"), (F.sum("mask").over(part) > 0).alias("masked"), "differs")
    return swept.where("end is not null").where((F.col("covered") < n) | (F.col("differs") == 1) | (F.col("masked") & (F.col("covered") > 0))).select("chrom", "slice", "at", "end", "masked")


def vcf(index: Index, ref: Reference, ambig_mask: bool = False, repeat_mask: bool = False) -> DataFrame:
    """``chrom pos ref alt gt``: sites where a sample differs from the reference or is a gap.

    ``pos`` is 1-based; ``alt`` are the other bases in the order of the samples that show
    them; ``gt`` has a number for each sample in order (0 reference, ``.`` gap).  Samples
    are gathered once for a segment, whose positions share them; a segment lists at most
    one entry a sample, as its rows do.  Runs are written first, since they are read twice.
    """
    n = index.n_samples
    cut = slices(ref, repeat_mask)
    own = materialize(with_number(_told(index, ref, cut, ambig_mask, repeat_mask), index.names).select("no", "chrom", "slice", "lo", "hi", "diffs"), "runs")
    segments = _segments(own, cut, n)
    starts = segments.groupBy("chrom", "slice").agg(F.collect_list("at").alias("starts"))
    inside = F.filter("starts", lambda a: (a >= F.col("lo")) & (a <= F.col("hi")))
    as_ref = F.transform(F.array_except(inside, F.transform("diffs", lambda x: x["pos"])), lambda a: F.struct(a.alias("at"), F.lit(None).cast("string").alias("code")))
    entries = own.join(starts, ["chrom", "slice"]).select("no", "chrom", "slice", F.inline(F.concat(as_ref, F.transform("diffs", lambda x: F.struct(x["pos"].alias("at"), x["code"].alias("code"))))))
    site = entries.groupBy("chrom", "slice", "at").agg(F.array_sort(F.collect_list(F.struct("no", "code"))).alias("codes"))
    sites = segments.join(site, ["chrom", "slice", "at"], "left").join(cut.select("chrom", "slice", "text"), ["chrom", "slice"])
    none = F.array().cast("array<struct<no:int,code:string>>")
    sites = sites.select("chrom", "slice", "text", "masked", F.coalesce("codes", none).alias("codes"), F.explode(F.sequence(F.col("at"), F.col("end") - 1)).alias("pos"))
    base = F.substr("text", F.col("pos") - F.col("slice") * SLICE + 1, F.lit(1)).cast("string")
    sites = sites.select("chrom", "pos", "codes", _plain(base).alias("base"), F.when(F.col("masked"), "N").otherwise(_plain(base)).alias("usual"))
    own_codes = row_of(F.col("codes"), lambda e: F.when(e["code"].isNull(), F.col("usual")).otherwise(_plain(e["code"])), n, F.lit(None).cast("string"))
    sites = sites.withColumn("shown", own_codes)
    sites = sites.withColumn("alts", F.array_except(F.array_distinct(F.filter("shown", lambda x: x.isNotNull())), F.array("base")))
    gt = F.transform("shown", lambda x: F.when(x.isNull(), ".").when(x == F.col("base"), "0").otherwise(F.array_position("alts", x).cast("string")))
    alt = F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise(".")
    return sites.select("chrom", (F.col("pos") + 1).alias("pos"), F.col("base").alias("ref"), alt.alias("alt"), F.array_join(gt, "\t").alias("gt"))
