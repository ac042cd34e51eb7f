"""Command line: python -m strandloom COMMAND ..."""

from __future__ import annotations

import argparse
import sys

import strandloom
from strandloom.functions.bases import check_k


def _k(text: str) -> int:
    try:
        return check_k(int(text))
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def _share(text: str) -> float:
    value = float(text)
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("a number from 0 to 1")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, inputs: bool = True, out: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        if inputs:
            p.add_argument("inputs", nargs="*", help="one saved index, or sequence files")
            p.add_argument("-f", "--file-list")
        if out:
            p.add_argument("-o", "--output")
        return p

    def filtered(p: argparse.ArgumentParser) -> None:
        p.add_argument("-m", "--min-freq", type=_share, default=0.9)
        p.add_argument("--filter", choices=["no-filter", "no-const", "no-ambig", "no-ambig-or-const"], default="no-const")
        p.add_argument("--ambig-mask", action="store_true")
        p.add_argument("--no-gap-only-sites", action="store_true")
        p.add_argument("--filter-ambig-as-missing", action="store_true")

    build = command("build", "index samples")
    build.add_argument("-k", type=_k, default=31)
    build.add_argument("--pair-reads", action="store_true", help="files whose names differ in 1 and 2 are one sample's reads")
    build.add_argument("--single-strand", action="store_true")
    build.add_argument("--min-count", default=None, help="a number or auto")
    build.add_argument("--min-qual", type=int, default=20)
    build.add_argument("--qual-filter", choices=["no-filter", "middle", "strict"], default="strict")
    build.add_argument("--proportion-reads", type=_share)
    align = command("align", "variable columns as FASTA")
    align.add_argument("--format", choices=["fasta", "json"], default="fasta", help="json: tree, names and alignment")
    filtered(align)
    mapped = command("map", "map samples to a reference")
    mapped.add_argument("--reference", required=True)
    mapped.add_argument("--format", choices=["aln", "vcf", "json", "ref"], default="aln", help="json: an object for each sample; ref: the reference as it is read")
    mapped.add_argument("--ambig-mask", action="store_true")
    mapped.add_argument("--repeat-mask", action="store_true")
    dist = command("distance", "pairwise distances")
    dist.add_argument("-m", "--min-freq", type=_share, default=0.0)
    dist.add_argument("--allow-ambiguous", action="store_true")
    dist.add_argument("--clusters", help="write single-linkage clusters as CSV")
    dist.add_argument("--max-snps", type=float, default=10)
    dist.add_argument("--max-mismatches", type=float, default=1.0)
    dist.add_argument("--dot", help="write the pairs within --max-snps as a graph")
    dist.add_argument("--phylip", help="write the matrix of distances")
    dist.add_argument("--tree", help="write a midpoint-rooted neighbour-joining tree")
    command("merge", "join indexes")
    delete = command("delete", "drop samples")
    delete.add_argument("-n", "--names", nargs="*", default=[])
    weed = command("weed", "drop (or keep) listed k-mers")
    weed.add_argument("--weed-file")
    weed.add_argument("--reverse", action="store_true")
    filtered(weed)
    nk = command("nk", "describe an index")
    nk.add_argument("--full-info", action="store_true")
    cov = command("cov", "fit the coverage of reads")
    cov.add_argument("-k", type=_k, default=31)
    cov.add_argument("--single-strand", action="store_true")
    lo = command("lo", "variants left out by the alignment")
    lo.add_argument("-r", "--reference")
    lo.add_argument("-m", "--missing", type=_share, default=0.1)
    lo.add_argument("-d", "--depth", type=int, default=4)
    lo.add_argument("-n", "--indel-kmers", type=int, default=2)
    return top


def main(args: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from strandloom.operators import coverage, distance, filters, index, refmap, results
    from strandloom.sources import inputs, sequences, sinks
    from strandloom.sources.shared import materialize

    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    strandloom.ship(spark)
    emit = lambda lines: sinks.write(lines, a.output) if a.output else sinks.show(lines)
    files = sequences.paired_files if getattr(a, "pair_reads", False) else sequences.files
    listed = sequences.file_list(spark, a.file_list) if a.file_list and a.command != "delete" else files(spark, a.inputs)

    def one() -> index.Index:
        return inputs.open_index(spark, a.inputs, a.file_list if a.command != "delete" else None)

    if a.command == "build":
        reads = sequences.read_for_index(listed, a.k)
        paired = [r[0] for r in listed.where(sequences.is_paired()).select("sample").collect()]
        least = coverage.choose_min_count(a.min_count, reads, paired, a.k, not a.single_strand)
        names = [r[0] for r in listed.select("sample").collect()]
        own = index.build(reads, a.k, not a.single_strand, {"no-filter": "none"}.get(a.qual_filter, a.qual_filter), a.min_qual, least, a.proportion_reads, names)
        index.save(index.check_samples(index.stored(own)), a.output)
    elif a.command == "merge":
        index.save(index.merge([index.load(spark, p) for p in a.inputs]), a.output)
    elif a.command == "delete":
        index.save(index.delete(one(), a.names + (sequences.name_list(spark, a.file_list) if a.file_list else [])), a.output)
    elif a.command in ("align", "weed"):
        own = one()
        if a.command == "weed" and a.weed_file:
            own = index.weed(own, sequences.read_for_index(sequences.files(spark, [a.weed_file]), own.k), a.reverse)
        kept = filters.apply_filters(own, a.filter, a.min_freq, a.filter_ambig_as_missing, a.ambig_mask, a.no_gap_only_sites, floor=a.command == "weed")
        if a.command == "weed":
            index.save(kept, a.output)
        elif a.format == "json":
            emit(sinks.json_lines(results.alignment_json(index.stored(kept)).select(F.lit("").alias("sample"), "json")))
        else:
            emit(sinks.fasta_lines(filters.alignment(kept)))
    elif a.command == "map":
        own = one()
        ref = refmap.reference(sequences.reference_contigs(spark, a.reference), own.k, own.rc)
        refmap.check(own, ref)
        if a.format == "aln":
            emit(sinks.fasta_lines(refmap.pseudoalignment(own, ref, a.ambig_mask, a.repeat_mask)))
        elif a.format == "json":
            emit(sinks.json_lines(results.mapping_json(own, ref)))
        elif a.format == "ref":
            emit(sinks.reference_lines(ref.contigs))
        else:
            sites = refmap.vcf(own, ref, a.ambig_mask, a.repeat_mask).join(ref.contigs.select("chrom", "name"), "chrom")
            emit(sinks.vcf_lines(sites, own.names, F.col("name")))
    elif a.command == "distance":
        own = one()
        found = materialize(distance.distances(own, a.allow_ambiguous, a.min_freq), "distances")
        emit(sinks.distance_table(found))
        if a.clusters:
            sinks.write(sinks.cluster_table(distance.single_linkage(found, own.names, a.max_snps, a.max_mismatches)), a.clusters)
        if a.dot:
            sinks.write(sinks.dot_graph(found, a.max_snps), a.dot)
        if a.phylip:
            sinks.write(sinks.phylip_lines(distance.phylip(found, own.names), own.n_samples), a.phylip)
        if a.tree:
            sinks.write(sinks.one_line(spark, distance.tree(found, own.names, rooted=True)), a.tree)
    elif a.command == "nk":
        own = one()
        index.summary(own).show(truncate=False)
        index.sample_counts(own).show(len(own.names), truncate=False)
        if a.full_info:  # one line a key: written where an output is given, else shown from an iterator
            emit(index.full_info(own).select(F.lit(1).alias("section"), F.col("key").alias("a"), F.lit("").alias("b"), F.concat_ws("\t", "key", "bases").alias("line")))
    elif a.command == "cov":
        bins = coverage.histogram(coverage.kmer_counts(sequences.read(listed), a.k, not a.single_strand))
        coverage.table(bins, coverage.fit([r["n_kmers"] for r in bins.orderBy("count").collect()])).orderBy("count").show(coverage.MAX_COUNT, truncate=False)
    elif a.command == "lo":
        from strandloom.operators import graph

        graph.report(one(), a.output or "lo", sequences.reference_contigs(spark, a.reference) if a.reference else None, a.missing, a.depth, a.indel_kmers)
    return 0


if __name__ == "__main__":
    sys.exit(main())
