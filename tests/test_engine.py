"""Small sequences with results known from the definitions, and brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.functions import bases
from strandloom.functions.kmers import sliced, windows
from strandloom.operators import coverage, distance, filters, graph, index, refmap, results
from strandloom.operators.components import connected_components
from strandloom.sources import sequences, sinks

random.seed(1)
BASE = "".join(random.choice("ACGT") for _ in range(300))


def put(s, p, b):
    return s[:p] + b + s[p + 1 :]


def other(b):
    return {"A": "C", "C": "A", "G": "T", "T": "G"}[b]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def seqs(spark, rows):
    return spark.createDataFrame([(n, i, s) for i, (n, s) in enumerate(rows)], "sample string, rec_no long, seq string")


def brute_kmers(seq, k, both):
    """(key digits, mask) of each window, by the definition."""
    h, digit = k // 2, {"A": "0", "C": "1", "T": "2", "G": "3"}
    out = []
    for i in range(len(seq) - k + 1):
        w = seq[i : i + k]
        if "N" in w or (i == len(seq) - k and (i == 0 or seq[i - 1] == "N")):
            continue
        enc = lambda x: "".join(digit[c] for c in x[:h] + x[h + 1 :])
        f, r, m = enc(w), enc(rc(w)), w[h]
        same = f == r
        if both and f > r:
            f, m = r, rc(m)
        mask = {"A": 1, "C": 2, "G": 4, "T": 8}[m]
        if both and same:
            mask = 9 if m in "AT" else 6
        out.append((f, mask))
    return out


@pytest.mark.parametrize("k", [5, 9, 31, 33, 63])
@pytest.mark.parametrize("both", [True, False])
def test_windows_match_the_definition(k, both):
    texts = [BASE, BASE[:70] + "N" + BASE[70:140], "ACGT", BASE[:k], "N" + BASE[:k] + "N", "N" + BASE[:k], "AATT" * 30, ""]
    w = windows([t.encode() for t in texts], None, k, both, "none", 20)
    h = k // 2
    got = [("".join(str(int(v) >> 2 * (h - 1 - i) & 3) for v in (a, b) for i in range(h)), int(m)) for a, b, m in zip(w["key_hi"], w["key_lo"], w["mask"])]
    assert got == [x for t in texts for x in brute_kmers(t, k, both)]


def test_k_is_checked():
    for k in (4, 6, 65, 3):
        with pytest.raises(ValueError):
            bases.check_k(k)


def test_index_filters_and_orientation(spark):
    a, b = BASE[:62], put(BASE[:62], 30, other(BASE[30]))
    one = index.build(seqs(spark, [("a", a), ("b", b)]), 15)
    cols = filters.columns(filters.apply_filters(one, min_freq=1)).collect()
    assert len(cols) == 1 and set(cols[0].bases) in ({BASE[30], other(BASE[30])}, {rc(BASE[30]), rc(other(BASE[30]))})
    turned = index.build(seqs(spark, [("a", rc(a)), ("b", b)]), 15)
    assert sorted(map(tuple, turned.kmers.collect())) == sorted(map(tuple, one.kmers.collect()))
    assert {r.sample: r.n_kmers for r in index.sample_counts(one).collect()} == {"a": 48, "b": 48}
    assert index.summary(one).first().n_kmers == 48 + 14
    back = index.delete(index.merge([one, index.build(seqs(spark, [("c", BASE)]), 15)]), ["c"])
    assert sorted(map(tuple, back.kmers.collect())) == sorted(map(tuple, one.kmers.collect()))
    with pytest.raises(ValueError):
        index.delete(one, ["nobody"])
    with pytest.raises(ValueError):
        index.delete(one, ["a", "b"])
    with pytest.raises(ValueError):
        index.merge([one, index.build(seqs(spark, [("c", BASE)]), 17)])
    assert {len(r.seq) for r in filters.alignment(filters.apply_filters(one, "no-filter", 0)).collect()} == {62}
    weeded = index.weed(one, seqs(spark, [("w", a)]))
    assert weeded.kmers.where("sample = 'a'").count() == 0 and weeded.kmers.count() == 14
    assert index.weed(one, seqs(spark, [("w", a)]), reverse=True).kmers.count() == 48 * 2 - 14


def test_reads_quality_and_counts(spark):
    good = "I" * 40
    low = good[:20] + "5" + good[21:]  # quality 20 is not above 20
    rows = [("r", i, BASE[:40], good) for i in range(2)] + [("r", 2, BASE[:40], low)]
    reads = spark.createDataFrame(rows, "sample string, rec_no long, seq string, qual string")
    n = lambda **o: index.build(reads, 15, **o).kmers.count()
    assert n() == 26 and n(quality="strict", min_count=3) == 26 - 15 and n(quality="middle", min_count=3) == 25
    assert n(quality="strict", min_count=2) == 26 and n(min_count=4) == 0
    assert index.subsample(reads, 0.5).count() == 2
    perfect = index.build(reads.where("rec_no < 2"), 15, quality="strict", min_count=2)
    assert sorted(map(tuple, perfect.kmers.collect())) == sorted(map(tuple, index.build(seqs(spark, [("r", BASE[:40])]), 15).kmers.collect()))


def test_masks(spark):
    rows = spark.createDataFrame([(c,) for c in "ACGTRYSWKMBDHVN-"], "c string")
    got = {r.c: (r.m, r.back, r.rc) for r in rows.select("c", bases.code_mask(F.col("c")).alias("m")).select("c", "m", bases.mask_code(F.col("m")).alias("back"), bases.complement_mask(F.col("m")).alias("rc")).collect()}
    assert all(c == back for c, (_, back, _) in got.items())
    assert got["R"][2] == got["Y"][0] and got["W"][2] == got["W"][0] and got["B"][2] == got["V"][0]


def test_distances(spark):
    a, b = BASE[:100], put(BASE[:100], 50, other(BASE[50]))
    one = index.build(seqs(spark, [("a", a), ("b", b), ("c", BASE[150:250])]), 15)
    rows = {(r.sample1, r.sample2): r for r in distance.distances(one).collect()}
    assert rows["a", "b"].distance == 1 and rows["a", "b"].mismatch_count == 28 and rows["a", "b"].match_count == 86 - 14
    assert rows["a", "c"].match_count == 0 and rows["a", "c"].mismatches == 1.0
    clusters = {r.sample: r.cluster for r in distance.single_linkage(distance.distances(one), one.names, 10, 0.9).collect()}
    assert clusters == {"a": "a", "b": "a", "c": "c"}
    tree = distance.tree(distance.distances(one), one.names)
    assert tree.endswith(";") and all(n in tree for n in "abc")
    lines = [r.line for r in sinks.distance_table(distance.distances(one)).orderBy("section", "a", "b").collect()]
    assert lines[0].startswith("Sample1") and len(lines) == 4


def depths(tree):
    """The distance of every leaf from the root of a Newick tree."""
    out, stack, own = {}, [], []
    for part in re.findall(r"\(|\)|,|:[-0-9.]+|[^(),:;]+", tree):
        if part == "(":
            stack.append(own)
            own = []
        elif part == ")":
            done, own = own, stack.pop()
            own.append({leaf: v for child in done for leaf, v in child.items()})
        elif part.startswith(":"):
            own[-1] = {leaf: v + float(part[1:]) for leaf, v in own[-1].items()}
        elif part != ",":
            own.append({part: 0.0})
    return own[0]


@pytest.mark.parametrize("size", [1, 7, 16, 50, 83])
def test_slices_of_a_long_sequence(size):
    rng = random.Random(size)
    for n in (12, 13, 60, 84, 101):
        seq = "".join(rng.choice("ACGTACGTACGTACGTN") for _ in range(n)).encode()
        qual = bytes(rng.choice([40, 60, 70]) for _ in range(n))
        for quals in (None, [qual], [None], [qual[:-1]]):
            for rule in ("strict", "middle", "none"):
                whole = windows([seq], quals, 11, True, rule, 20)
                parts = list(sliced([seq], quals, 11, True, rule, 20, size))
                for name, values in whole.items():
                    assert np.concatenate([p[name] for p in parts]).tolist() == values.tolist(), (n, rule, name)


def test_trees_of_few_samples():
    assert distance.neighbour_joining(np.zeros((1, 1)), ["x"]) == "(x);"
    assert distance.neighbour_joining(np.array([[0, 4.0], [4, 0]]), ["x", "y z"]) == "(x:2.000000,y_z:2.000000);"
    assert set(depths(distance.neighbour_joining(np.array([[0, 4.0], [4, 0]]), ["x", "y"], rooted=True)).values()) == {2.0}
    three = np.array([[0, 3, 9], [3, 0, 8], [9, 8, 0.0]])
    assert distance.neighbour_joining(three, ["x", "y", "z"]) == "(x:2.000000,y:1.000000,z:7.000000);"
    got = depths(distance.neighbour_joining(three, ["x", "y", "z"], rooted=True))
    assert got == {"x": 4.5, "y": 3.5, "z": 4.5}
    assert distance.neighbour_joining(np.zeros((4, 4)), list("abcd"), rooted=True).count(":") == 6


def test_distances_by_tiles(spark, monkeypatch):
    rows = [(f"s{i}", put(BASE[: 200 - i], 50, "ACGTN"[i % 5])) for i in range(7)]
    one = index.build(seqs(spark, rows), 15)
    want = [distance.distances(one, allow_ambiguous=a).orderBy("sample1", "sample2").collect() for a in (False, True)] + [distance.snp_matrix(one).orderBy("sample1", "sample2").collect()]
    monkeypatch.setattr(distance, "TILE", 3)
    monkeypatch.setattr(distance, "BLOCK_KEYS", 16)
    assert [distance.distances(one, allow_ambiguous=a).orderBy("sample1", "sample2").collect() for a in (False, True)] + [distance.snp_matrix(one).orderBy("sample1", "sample2").collect()] == want


def test_guards(spark):
    one = index.build(seqs(spark, [("a", BASE), ("b", "ACGT")]), 15)
    with pytest.raises(ValueError, match="no valid k-mers in: b"):
        index.check_samples(one)
    contig = lambda s: spark.createDataFrame([(0, s)], "chrom int, seq string")
    refmap.check(one, refmap.reference(contig(BASE[:60]), 15))
    with pytest.raises(ValueError, match="reference has no valid"):
        refmap.check(one, refmap.reference(contig("ACGT"), 15))
    with pytest.raises(ValueError, match="map to the reference"):
        refmap.check(one, refmap.reference(contig("AC" * 40), 15))
    with pytest.raises(ValueError, match="single record"):
        graph.check_genome(spark.createDataFrame([(0, BASE), (1, BASE)], "chrom int, seq string"))
    two = seqs(spark, [("r", BASE)] * 4).withColumn("file_no", F.lit(1))
    with pytest.raises(ValueError):  # second files don't count
        coverage.choose_min_count("auto", two, ["r", "q"], 15)


#: A published k-mer histogram (counts 1 to 77) whose cutoff is 9.
HISTOGRAM = [
    44633459, 950672, 104410, 44137, 24170, 21232, 21699, 24145, 30696, 39210, 49878, 63683, 77690, 95147, 112416, 130307, 146531, 160932, 175130, 185113, 193149, 197468,
    199189, 198235, 192150, 185565, 176362, 165455, 152487, 139495, 127036, 112803, 103080, 90425, 80637, 70960, 62698, 54949, 46744, 41240, 35591, 30025, 25856, 22105, 19405,
    16668, 14780, 12620, 11074, 9807, 8517, 7731, 7112, 6846, 6126, 5696, 5233, 4779, 4288, 3873, 3519, 3406, 2994, 2859, 2650, 2394, 2376, 2260, 2233, 2050, 1859, 1863, 1792, 1777, 1773, 1738, 1648,
]


def test_known_histogram():
    assert coverage.fit(HISTOGRAM).cutoff == 9


def brute_paths(rows, k_graph, max_depth):
    """Entry, exit, sequence and number of nodes of every path, by walking node by node."""
    succ, colours, into = {}, {}, {}
    for full, samples in rows:
        a, b = full[:-1], full[1:]
        succ.setdefault(a, set()).add(b)
        into.setdefault(b, set()).add(a)
        colours.setdefault(a, set()).add(tuple(samples))
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    entry = {a for a, b in succ.items() if len(b) > 1 and len(colours[a]) > 1}
    exits = {rc(a) for a in entry}
    inner = {a for a in succ if len(succ[a]) == 1 and len(into.get(a, ())) == 1 and a not in entry | exits}
    out = set()

    def stretch(node):
        seen = [node]
        while node in inner:
            (node,) = succ[node]
            if node in seen:
                return None
            seen.append(node)
        return seen

    def walk(start, at, seq, visited, depth, n):
        ahead = [s for s in map(stretch, sorted(succ.get(at, ()))) if s and s[-1] not in visited]
        now = depth + (1 if len(ahead) > 1 or depth < 0 else 0)
        for s in ahead:
            longer = seq + "".join(x[-1] for x in s)
            if s[-1] in exits:
                out.add((start, s[-1], longer, n + len(s)))
            if now <= max_depth:
                walk(start, s[-1], longer, visited | {s[-1]}, now, n + len(s))

    for a in entry:
        walk(a, a, a, {a}, -1, 1)
    return out


def coloured_text(one):
    """(k-mer, samples) on both strands, from the index by the definition."""
    found = {}
    for r in one.kmers.collect():
        text = lambda a, h=one.k // 2: "".join("ACTG"[a >> 2 * (h - 1 - i) & 3] for i in range(h))
        for bit, b in ((1, "A"), (2, "C"), (4, "G"), (8, "T")):
            if r.mask & bit:
                full = text(r.key_hi) + b + text(r.key_lo)
                for f in (full, rc(full)):
                    found.setdefault(f, set()).add(r.sample)
    return [(f, tuple(sorted(s))) for f, s in found.items()]


@pytest.mark.parametrize("max_depth", [1, 4])
def test_paths_by_brute_force(spark, max_depth):
    rng = np.random.default_rng(max_depth)
    samples = []
    for i in range(5):
        s = BASE[:160]
        for p in rng.choice(np.arange(20, 140), 4, replace=False).tolist():
            s = put(s, p, "ACGT"[int(rng.integers(4))])
        samples.append((f"s{i}", s[:90] + s[90 + 3 * (i % 2) :]))
    one = index.build(seqs(spark, samples), 11)
    want = brute_paths(coloured_text(one), 10, max_depth)
    got = graph.paths(one, max_depth).select("entry", "exit", "seq", "n_nodes").collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == want and len(want) > 10


def test_neighbour_joining_recovers_an_additive_tree():
    #   a:1 b:2 | x:1 | c:3 d:4
    d = np.array([[0, 3, 5, 6], [3, 0, 6, 7], [5, 6, 0, 7], [6, 7, 7, 0]], float)
    tree = distance.neighbour_joining(d, ["a", "b", "c", "d"])
    rooted = distance.neighbour_joining(d, ["a", "b", "c", "d"], rooted=True)
    assert rooted.count(":") == 6 and abs(max(depths(rooted).values()) - d.max() / 2) < 1e-6
    assert "a:1.000000" in tree and "b:2.000000" in tree and "c:3.000000" in tree and "d:4.000000" in tree


def test_map(spark):
    b = put(BASE[:100], 50, other(BASE[50]))
    one = index.build(seqs(spark, [("a", BASE[:100]), ("b", b[20:90])]), 15)
    contigs = spark.createDataFrame([(0, BASE[:100]), (1, BASE[200:240])], "chrom int, seq string")
    ref = refmap.reference(contigs, 15)
    got = {r.sample: r.seq for r in refmap.pseudoalignment(one, ref).collect()}
    assert got["a"] == BASE[:100] + "-" * 40
    assert got["b"] == "-" * 20 + b[20:90] + "-" * 50
    sites = {(r.chrom, r.pos): (r.ref, r.alt, r.gt) for r in refmap.vcf(one, ref).collect()}
    assert sites[0, 51] == (BASE[50], other(BASE[50]), "0\t1")
    assert sites[0, 1] == (BASE[0], ".", "0\t.") and sites[1, 5][2] == ".\t." and (0, 41) not in sites
    assert {r.sample: r.covered for r in refmap.map_coverage(one, ref).collect()} == {"a": 100, "b": 70}
    twice = refmap.reference(spark.createDataFrame([(0, BASE[:30] + "N" + BASE[:30])], "chrom int, seq string"), 15)
    assert {r.n for r in refmap.repeats(twice).collect()} == {2} and refmap.repeat_positions(twice).count() == 60
    with pytest.raises(ValueError):
        refmap.hits(one, refmap.reference(contigs, 17))


def test_coverage(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.poisson(1, 50_000), rng.poisson(30, 20_000)])
    counts = np.bincount(x[x > 0], minlength=60)[1:60]
    found = coverage.fit(counts)
    assert abs(found.coverage - 30) < 1 and 4 <= found.cutoff <= 12
    with pytest.raises(ValueError):
        coverage.fit([0, 0])
    reads = seqs(spark, [("r", BASE[:40])] * 3 + [("r", BASE[100:120])])
    bins = {r["count"]: r.n_kmers for r in coverage.histogram(coverage.kmer_counts(reads, 15), 1).collect()}
    assert bins == {1: 6, 2: 0, 3: 26}
    assert coverage.choose_min_count(None, reads, [], 15) == 5 and coverage.choose_min_count("auto", reads, ["r"], 15) == 5
    with pytest.raises(ValueError):
        coverage.choose_min_count(-1, reads, [], 15)


def test_coverage_without_bins(spark):
    """Every k-mer occurs more than 1000 times, or there are none: the fit stays at its start and nothing is cut."""
    deep = seqs(spark, [("r", BASE[:60])]).crossJoin(spark.range(1001)).select("sample", "seq")
    for reads in (deep, deep.limit(0)):
        assert coverage.min_count(reads, 9) == coverage.Fit(0.8, 20.0, 1)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "x string, y string")).count() == 0


def test_left_out_variants(spark):
    b = put(put(BASE, 100, other(BASE[100])), 105, other(BASE[105]))
    c = BASE[:200] + BASE[204:]
    one = index.build(seqs(spark, [("s1", BASE), ("s2", BASE), ("s3", b), ("s4", c)]), 17)
    called, calls, found = graph.left_out(one, max_missing=0.5)
    assert called.count() == 2
    genome = spark.createDataFrame([(0, BASE)], "chrom int, seq string")
    placed = {r.genome_pos: r.column for r in graph.place(called, found, genome, 16).collect()}
    assert placed == {p: BASE[p] * 2 + other(BASE[p]) + BASE[p] for p in (100, 105)}
    (indel,) = calls.collect()
    assert len(indel.ref) - len(indel.alt.replace("-", "")) == 4 and indel.gt == "0\t0\t0\t1"


def test_files(spark, tmp_path):
    import gzip

    (tmp_path / "one.fa").write_text(f">c1 x\n{BASE[:60]}\n{BASE[60:90]}\n>c2\nACGT\n")
    with gzip.open(tmp_path / "two.fastq.gz", "wt") as f:
        f.write(f"@r1 a\n{BASE[:30]}\n+\n{'I' * 30}\n@r2\nACGT\n+\n@III\n")
    (tmp_path / "list").write_text(f"one {tmp_path}/one.fa\ntwo {tmp_path}/two.fastq.gz {tmp_path}/two.fastq.gz\n")
    rows = sequences.read(sequences.file_list(spark, f"{tmp_path}/list")).orderBy("sample", "file_no", "rec_no").collect()
    assert [(r.sample, r.file_no, r.rec_no, r.contig, r.qual is None) for r in rows] == [("one", 0, 0, "c1", True), ("one", 0, 1, "c2", True), ("two", 0, 0, "r1", False), ("two", 0, 1, "r2", False), ("two", 1, 0, "r1", False), ("two", 1, 1, "r2", False)]
    assert rows[0].seq == BASE[:90] and rows[3].qual == "@III"
    (tmp_path / "bad").write_text("only\n")
    with pytest.raises(Exception, match="2 or 3 fields"):
        sequences.file_list(spark, f"{tmp_path}/bad").collect()
    assert sequences.pair_reads(["x_1.fastq", "x_2.fastq", "y.fa"]) == [("x_1", "x_1.fastq", "x_2.fastq"), ("y", "y.fa", None)]
    one = index.build(seqs(spark, [("a", BASE)]), 15)
    index.save(one, f"{tmp_path}/saved")
    again = index.load(spark, f"{tmp_path}/saved")
    assert (again.k, again.rc, again.names) == (15, True, ("a",)) and again.kmers.count() == one.kmers.count()


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_graph_queries_walk_to_the_default_depth(monkeypatch):
    import inspect

    from strandloom.operators import graph as own
    from strandloom.plans import queries as plans

    asked, signature = [], inspect.signature(own.left_out)

    def left_out(*args, **options):
        call = signature.bind(*args, **options)
        call.apply_defaults()
        asked.append(call.arguments["max_depth"])
        raise LookupError

    monkeypatch.setattr(plans.graph, "left_out", left_out)
    monkeypatch.setattr(plans, "built", lambda *a, **k: None)
    for name in ("graph_groups", "indel_calls", "left_out_snps", "kmer_placement"):
        try:
            plans.QUERIES[name](None, "")
        except LookupError:
            pass
    assert asked == [4] * 4


def test_json_results(spark):
    import json

    one = index.build(seqs(spark, [("a b", BASE), ("c", put(BASE, 150, other(BASE[150]))), ("d", "ACGT" * 3)]), 15)
    ref = refmap.reference(spark.createDataFrame([(0, BASE[:200]), (1, BASE[200:]), (2, "")], "chrom int, seq string"), 15)
    got = {r.sample: json.loads(r.json) for r in results.mapping_json(one, ref).collect()}
    whole = {r.sample: r.seq for r in refmap.pseudoalignment(one, ref).collect()}
    share = {r.sample: r.coverage for r in refmap.map_coverage(one, ref).collect()}
    for name in one.names:
        assert [len(x) for x in got[name]["Mapped sequences"]] == [200, 100, 0] and "".join(got[name]["Mapped sequences"]) == whole[name]
        assert got[name]["Coverage"] == pytest.approx(share[name])
    # a changed base is a variant of its own; 14 windows around it have other arms
    keys = ref.kmers.count()
    assert (got["a b"]["Number of variants"], got["c"]["Number of variants"], got["d"]["Number of variants"]) == (keys, keys - 14, 0)
    (row,) = results.alignment_json(one).collect()
    told = json.loads(row.json)
    rows = {r.sample: r.seq for r in filters.alignment(one).collect()}
    assert told["names"] == list(one.names) and told["alignment"] == "".join(f">{n}\n{rows[n]}\n" for n in one.names)
    assert re.sub(r":[0-9.eE+-]+", "", told["newick"]).count(",") == 2 and "a_b" in told["newick"] and told["newick"].endswith(";")
    with pytest.raises(ValueError, match="not enough sequences"):
        results.alignment_json(index.build(seqs(spark, [("a", BASE), ("b", BASE)]), 15))


def test_warning_of_gaps_that_stay(spark):
    import warnings

    one = index.build(seqs(spark, [("a", BASE), ("b", BASE)]), 15)
    for kind in (filters.NO_FILTER, filters.NO_AMBIG):
        with pytest.warns(UserWarning, match="gap-only"):
            filters.apply_filters(one, kind, ignore_const_gaps=True)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        filters.apply_filters(one, filters.NO_CONST, ignore_const_gaps=True)
        filters.apply_filters(one, filters.NO_FILTER)


def test_command_line(spark, tmp_path, capsys):
    import json

    from strandloom.__main__ import main

    texts = {"a": BASE, "b": put(BASE, 150, other(BASE[150])), "c": put(put(BASE, 150, other(BASE[150])), 40, other(BASE[40]))}
    for name, text in texts.items():
        (tmp_path / f"{name}.fa").write_text(f">x\n{text}\n")
    (tmp_path / "ref.fa").write_text(f">one\n{BASE[:180]}\n>two\n{BASE[180:]}\n")
    (tmp_path / "drop.fa").write_text(f">x\n{BASE[:100]}\n")
    at = lambda name: f"{tmp_path}/{name}"
    text = lambda name: spark.read.text(at(name)).orderBy(F.input_file_name(), F.monotonically_increasing_id()).toPandas()["value"].tolist()
    run = lambda *args: (main([*args]), capsys.readouterr().out)
    assert run("build", "-k", "15", "-o", at("abc"), at("a.fa"), at("b.fa"), at("c.fa"))[0] == 0
    run("build", "-k", "15", "-o", at("ab"), at("a.fa"), at("b.fa"))
    run("build", "-k", "15", "-o", at("only"), at("c.fa"))
    run("merge", at("ab"), at("only"), "-o", at("joined"))
    both = [index.load(spark, at(x)) for x in ("abc", "joined")]
    assert [sorted(x.names) for x in both] == [["a", "b", "c"]] * 2 and len({frozenset(map(tuple, x.kmers.select("sample", "key_hi", "key_lo", "mask").collect())) for x in both}) == 1
    run("delete", at("abc"), "-n", "c", "-o", at("less"))
    assert index.load(spark, at("less")).names == ("a", "b")
    run("weed", at("abc"), "--weed-file", at("drop.fa"), "--filter", "no-filter", "-m", "0", "-o", at("weeded"))
    assert 0 < index.load(spark, at("weeded")).kmers.count() < both[0].kmers.count()
    out = run("align", at("abc"), "-m", "0.6")[1].split()
    assert out[::2] == [">a", ">b", ">c"] and len({len(x) for x in out[1::2]}) == 1 and len(out[1]) > 0
    told = json.loads(run("align", at("abc"), "-m", "0.6", "--format", "json")[1])
    assert told["alignment"].split() == out and told["names"] == ["a", "b", "c"]
    run("map", at("abc"), "--reference", at("ref.fa"), "-o", at("aln"))
    mapped = text("aln")
    assert mapped[0] == ">a" and mapped[1] == BASE
    objects = [json.loads(x) for x in run("map", at("abc"), "--reference", at("ref.fa"), "--format", "json")[1].splitlines()]
    assert objects[0]["Mapped sequences"] == [BASE[:180], BASE[180:]] and objects[0]["Coverage"] == 1
    assert run("map", at("abc"), "--reference", at("ref.fa"), "--format", "ref")[1].split() == [BASE[:180], BASE[180:]]
    sites = [x.split("\t") for x in run("map", at("abc"), "--reference", at("ref.fa"), "--format", "vcf")[1].splitlines() if not x.startswith("#")]
    assert [(x[0], x[1], x[3], x[4], x[9:]) for x in sites] == [("one", "41", BASE[40], other(BASE[40]), ["0", "0", "1"]), ("one", "151", BASE[150], other(BASE[150]), ["0", "1", "1"])]
    out = run("distance", at("abc"), "--clusters", at("clusters"), "--dot", at("dot"), "--phylip", at("phylip"), "--tree", at("tree"), "--max-snps", "1.5")[1].splitlines()
    assert [x.split("\t")[:3] for x in out[1:]] == [["a", "b", "1.00"], ["a", "c", "2.00"], ["b", "c", "1.00"]]
    assert text("clusters") == ["id,Cluster", "a,1", "b,1", "c,1"]
    assert text("dot") == ["graph distances {", '  "a" -- "b" [label=1.00];', '  "b" -- "c" [label=1.00];', "}"]
    assert [x.split("\t")[:2] for x in text("phylip")] == [["3"], ["a", "0.000000"], ["b", "1.000000"], ["c", "2.000000"]]
    assert text("tree")[0].endswith(";")
    shown = run("nk", at("abc"), "--full-info")[1]
    assert sum(len(x.split("\t")) == 2 for x in shown.splitlines()) == both[0].kmers.select("key_hi", "key_lo").distinct().count()
    with pytest.raises(ValueError, match="single record"):
        main(["lo", at("abc"), "-o", at("out"), "-r", at("ref.fa")])
    run("lo", at("abc"), "-m", "0.7", "-o", at("out"), "-r", at("a.fa"))
    assert {p.name for p in tmp_path.iterdir() if p.name.startswith("out")} >= {"out_snps", "out_indels", "out_snps_vcf", "out_genomes"}
    with pytest.raises(SystemExit):
        main(["build", "-k", "14", "-o", at("x"), at("a.fa")])
