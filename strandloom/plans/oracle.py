"""The same results as SQL, written from the definitions, on digit strings instead of packed keys."""

from __future__ import annotations

from strandloom.functions.bases import CODES, LETTER_QUALITIES

_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0132013201320132N132013201"  # the digits of ACGTACGT..., q unknown
_BASES = "ACGTACGTACGTACGTNCGTACGTAC"
_K = 15


def _text(column: str, to: str) -> str:
    return f"translate(lower(regexp_replace({column}, '[^A-Za-z]', '', 'g')), '{_LETTERS}', '{to}')"


def _documents(where: str = "true") -> str:
    return f"SELECT source AS sample, doc_id AS contig, {_text('text', _DIGITS)} AS s, NULL::VARCHAR AS q FROM documents WHERE text IS NOT NULL AND {where}"


def _reads(quality: str = "none") -> str:
    """Turns as reads; bases of low quality are unknown if asked for (they break runs)."""
    to = "".join("N" if quality == "strict" and ord(q) - 33 <= 20 else d for d, q in zip(_DIGITS, LETTER_QUALITIES, strict=True))
    return f"SELECT role AS sample, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, text) - 1 AS contig, {_text('text', to)} AS s, {_text('text', LETTER_QUALITIES)} AS q FROM conversations WHERE text IS NOT NULL"


_REFERENCE = f"SELECT item_id AS sample, item_id AS contig, {_text('text', _DIGITS)} AS s, NULL::VARCHAR AS q FROM benchmark"


def _kmers(source: str, k: int, rc: bool = True, middle: bool = False) -> str:
    """All gapped k-mers of a source: sample, contig, start, key, mask, is_rc, palindrome."""
    h, size = (k - 1) // 2, 256
    low = f"AND ascii(substr(quals, o + {h}, 1)) - 33 > 20" if middle else ""
    # sequences are cut into pieces with a base before (N at the start), since a place in a long string is found by counting
    pieces = f"""SELECT sample, contig, n, c, CASE WHEN c > 1 THEN substr(s, c - 1, {size + k}) ELSE 'N' || substr(s, 1, {size + k - 1}) END AS piece, substr(q, c, {size + k - 1}) AS quals
      FROM (SELECT *, length(s) AS n, unnest(range(1, length(s) - {k} + 2, {size})) AS c FROM ({source}) WHERE length(s) >= {k})"""
    windows = f"""SELECT sample, contig, (c + o - 2)::INTEGER AS start, substr(piece, o + 1, {h}) || substr(piece, o + {h + 2}, {h}) AS f, substr(piece, o + 1 + {h}, 1) AS m
      FROM (SELECT *, unnest(range(1, least({size}, n - {k} + 2 - c) + 1)) AS o FROM ({pieces}))
      WHERE NOT contains(substr(piece, o + 1, {k}), 'N') {low} AND NOT (c + o - 2 = n - {k} AND substr(piece, o, 1) = 'N')"""
    both = f"SELECT *, translate(reverse(f), '0123', '2301') AS r FROM ({windows})"
    flip = "f > r" if rc else "false"
    same = "f = r" if rc else "false"
    return f"""SELECT sample, contig, start, start + {h} AS pos, CASE WHEN {flip} THEN r ELSE f END AS key,
      CASE WHEN {same} THEN (CASE WHEN m IN ('0', '2') THEN 9 ELSE 6 END)
           ELSE CASE (CASE WHEN {flip} THEN translate(m, '0123', '2301') ELSE m END) WHEN '0' THEN 1 WHEN '1' THEN 2 WHEN '2' THEN 8 ELSE 4 END END::INTEGER AS mask,
      {flip} AS is_rc, {same} AS palindrome FROM ({both})"""


def _index(source: str, k: int = _K, rc: bool = True, middle: bool = False) -> str:
    return f"SELECT sample, key, bit_or(mask)::INTEGER AS mask FROM ({_kmers(source, k, rc, middle)}) GROUP BY sample, key"


def _code(mask: str) -> str:
    return f"substr('{CODES}', {mask} + 1, 1)"


_DIGEST = "SELECT sample, count(*) AS n_keys, sum(mask)::BIGINT AS sum_mask, min(key) AS first_key, max(key) AS last_key, sum(('0x' || substr(md5(key), 1, 9))::BIGINT * mask)::BIGINT AS hashes FROM ({rows}) GROUP BY sample"
_PLAIN = "bit_count(mask) = 1"


def _stats(rows: str) -> str:
    return f"""SELECT key, count(*) AS n_present, count(*) FILTER ({_PLAIN}) AS n_plain, count(DISTINCT mask) AS n_codes, count(DISTINCT mask) FILTER ({_PLAIN}) AS n_bases FROM ({rows}) GROUP BY key"""


def _filtered(test: str, least: str, rows: str | None = None, missing: bool = False, mask: bool = False) -> str:
    """CTEs i (index), n (samples), kept (rows of the keys that pass)."""
    count = "n_plain" if missing else "n_present"
    shown = "CASE WHEN bit_count(mask) > 1 THEN 15 ELSE mask END" if mask else "mask"
    return f"""WITH i AS MATERIALIZED ({rows or _index(_documents())}), n AS (SELECT sample FROM i GROUP BY sample), c AS (SELECT count(*) AS n FROM n),
      pass AS (SELECT key FROM ({_stats('SELECT * FROM i')}), c WHERE {test} AND {count} >= {least} {'AND n_plain > 0' if missing else ''}),
      kept AS (SELECT sample, key, {shown}::INTEGER AS mask FROM i WHERE key IN (SELECT key FROM pass))"""


def _columns(sep: str = "") -> str:
    return f"""SELECT g.key, string_agg({_code('coalesce(mask, 0)')}, '{sep}' ORDER BY g.sample) AS bases FROM (SELECT DISTINCT key, n.sample FROM kept, n) g LEFT JOIN kept ON kept.key = g.key AND kept.sample = g.sample GROUP BY g.key"""


_GAP = "(n_present < n)::INTEGER"
_CONST = f"n_codes + {_GAP} > 1"
_TENTH = "ceil(n * 0.1)"


def _distances(ambiguous: bool = False, least: str = "0") -> str:
    same = "CASE WHEN a.mask = 15 OR b.mask = 15 THEN 0 ELSE bit_count(a.mask & b.mask) / (bit_count(a.mask) * bit_count(b.mask))::DOUBLE END"
    plain = "bit_count(a.mask) = 1 AND bit_count(b.mask) = 1"
    m, d = (f"count(*) FILTER ({same} > 0)", f"sum(1 - {same})") if ambiguous else (f"count(*) FILTER ({plain})", f"count(*) FILTER ({plain} AND a.mask <> b.mask)::DOUBLE")
    return f"""WITH i AS MATERIALIZED ({_index(_documents())}), n AS (SELECT sample FROM i GROUP BY sample), c AS (SELECT count(*) AS n FROM n),
      st AS MATERIALIZED (SELECT *, n_present = n AND n_codes = 1 AS constant FROM ({_stats('SELECT * FROM i')}), c WHERE n_present >= {least}),
      v AS MATERIALIZED (SELECT * FROM i WHERE key IN (SELECT key FROM st WHERE NOT constant)),
      e AS (SELECT sample, count(*) AS n FROM v GROUP BY sample),
      sh AS (SELECT a.sample AS s1, b.sample AS s2, count(*) AS shared, {m} AS m, {d} AS d FROM v a JOIN v b ON a.key = b.key AND a.sample < b.sample GROUP BY ALL),
      dist AS (SELECT x.sample AS sample1, y.sample AS sample2, coalesce(d, 0) AS distance, (SELECT count(*) FROM st WHERE constant) + coalesce(m, 0) AS match_count,
        coalesce(e1.n, 0) + coalesce(e2.n, 0) - 2 * coalesce(shared, 0) AS mismatch_count
        FROM n x JOIN n y ON x.sample < y.sample LEFT JOIN sh ON s1 = x.sample AND s2 = y.sample LEFT JOIN e e1 ON e1.sample = x.sample LEFT JOIN e e2 ON e2.sample = y.sample),
      told AS (SELECT *, CASE WHEN match_count + mismatch_count > 0 THEN mismatch_count / (match_count + mismatch_count)::DOUBLE ELSE 0 END AS mismatches FROM dist)"""


_DISTANCE = "SELECT sample1, sample2, round(distance, 6) AS distance, round(mismatches, 6) AS mismatches, match_count, mismatch_count FROM told"


def _mapped(mask: bool = False, repeats: bool = False) -> str:
    """CTEs up to cell: the code of every covered position of every sample."""
    code = f"CASE WHEN m.mask IS NULL THEN b.base {'WHEN bit_count(m.mask) > 1 THEN chr(78)' if mask else ''} ELSE {_code('m.mask')} END"
    if repeats:
        code = f"CASE WHEN (b.chrom, b.pos) IN (SELECT (chrom, pos) FROM rep) THEN 'N' ELSE {code} END"
    h = (_K - 1) // 2
    rc = "((mask >> 3) & 1) + ((mask >> 1) & 2) + ((mask << 1) & 4) + ((mask << 3) & 8)"
    return f"""WITH i AS MATERIALIZED ({_index(_documents())}), n AS (SELECT sample FROM i GROUP BY sample), r AS MATERIALIZED ({_kmers(_REFERENCE, _K)}),
      seqs AS (SELECT item_id AS chrom, {_text('text', _BASES)} AS seq FROM benchmark),
      base AS MATERIALIZED (SELECT chrom, (p - 1)::INTEGER AS pos, substr(seq, p, 1) AS base FROM (SELECT *, unnest(range(1, length(seq) + 1)) AS p FROM seqs)),
      rep AS MATERIALIZED (SELECT DISTINCT contig AS chrom, pos + unnest(range(-{h}, {h + 1})) AS pos FROM r WHERE key IN (SELECT key FROM r GROUP BY key HAVING count(*) > 1)),
      hit AS MATERIALIZED (SELECT i.sample, contig AS chrom, pos, (CASE WHEN is_rc THEN {rc.replace('mask', 'i.mask')} ELSE i.mask END)::INTEGER AS mask FROM r JOIN i ON r.key = i.key),
      cov AS (SELECT DISTINCT sample, chrom, pos + unnest(range(-{h}, {h + 1})) AS pos FROM hit),
      cell AS MATERIALIZED (SELECT c.sample, b.chrom, b.pos, b.base, {code} AS code FROM cov c JOIN base b ON b.chrom = c.chrom AND b.pos = c.pos LEFT JOIN hit m ON m.sample = c.sample AND m.chrom = c.chrom AND m.pos = c.pos)"""


def _pseudo(**options: bool) -> str:
    return _mapped(**options) + """ SELECT n.sample, string_agg(coalesce(code, '-'), '' ORDER BY base.chrom, base.pos) AS seq FROM n CROSS JOIN base LEFT JOIN cell ON cell.sample = n.sample AND cell.chrom = base.chrom AND cell.pos = base.pos GROUP BY n.sample"""


def _vcf(columns: str, **options: bool) -> str:
    def plain(x: str) -> str:
        return f"CASE WHEN {x} IN ('A','C','G','T') THEN {x} ELSE 'N' END"

    return _mapped(**options) + f""", grid AS (SELECT base.chrom, base.pos, base.base, n.sample, code FROM base CROSS JOIN n LEFT JOIN cell ON cell.sample = n.sample AND cell.chrom = base.chrom AND cell.pos = base.pos),
      site AS MATERIALIZED (SELECT *, {plain('base')} AS ref, CASE WHEN code IS NOT NULL THEN {plain('code')} END AS shown FROM grid
        WHERE (chrom, pos) IN (SELECT (chrom, pos) FROM grid WHERE code IS NULL OR code <> base)),
      alt AS (SELECT chrom, pos, shown, row_number() OVER (PARTITION BY chrom, pos ORDER BY first) AS k FROM (SELECT chrom, pos, shown, min(sample) AS first FROM site WHERE shown <> ref GROUP BY ALL)),
      alts AS (SELECT chrom, pos, string_agg(shown, ',' ORDER BY k) AS alt FROM alt GROUP BY ALL),
      gts AS (SELECT site.chrom, site.pos, site.ref, string_agg(CASE WHEN site.shown IS NULL THEN '.' WHEN site.shown = ref THEN '0' ELSE k::VARCHAR END, chr(9) ORDER BY sample) AS gt
        FROM site LEFT JOIN alt ON alt.chrom = site.chrom AND alt.pos = site.pos AND alt.shown = site.shown GROUP BY ALL)
      SELECT {columns} FROM (SELECT gts.chrom, gts.pos + 1 AS pos, ref, coalesce(alt, '.') AS alt, gt FROM gts LEFT JOIN alts ON alts.chrom = gts.chrom AND alts.pos = gts.pos)"""


_WEEDED = f"SELECT * FROM ({_index(_documents())}) WHERE key NOT IN (SELECT key FROM ({_kmers(_REFERENCE, _K)}))"
_BINS = f"SELECT n AS count, count(*) AS n_kmers FROM (SELECT key, count(*) AS n FROM ({_kmers(_documents(), 9)}) GROUP BY key) WHERE n <= 1000 GROUP BY n"
_HISTOGRAM = f"WITH b AS ({_BINS}) SELECT g.count, coalesce(n_kmers, 0) AS n_kmers FROM (SELECT unnest(range(1, (SELECT max(count) FROM b WHERE n_kmers >= 50) + 1)) AS count) g LEFT JOIN b ON b.count = g.count"
_WHOLE = f"SELECT chrom, start, pos, key, mask, is_rc, palindrome FROM (SELECT contig AS chrom, * FROM ({{rows}}))"

_COLOURS = f"""WITH i AS ({_index(_documents(), 31)}), f AS (SELECT sample, translate(substr(key, 1, 15) || d || substr(key, 16), '0123', 'ACTG') AS w FROM i, (VALUES (1, '0'), (2, '1'), (8, '2'), (4, '3')) b(m, d) WHERE mask & m <> 0),
  c AS MATERIALIZED (SELECT w, string_agg(DISTINCT sample, ',' ORDER BY sample) AS samples, count(DISTINCT sample) AS n FROM (SELECT * FROM f UNION ALL SELECT sample, translate(reverse(w), 'ACGT', 'TGCA') FROM f) GROUP BY w),
  e AS (SELECT substr(w, 1, 30) AS src, substr(w, 2) AS dst, samples, n FROM c)"""

SQL = {
    "build_contigs": f"SELECT source AS sample, doc_id AS contig, {_text('text', _BASES)} AS seq, length({_text('text', _BASES)}) AS length FROM documents WHERE text IS NOT NULL",
    "revcomp_contigs": f"SELECT item_id AS chrom, translate(reverse({_text('text', _BASES)}), 'ACGT', 'TGCA') AS seq FROM benchmark",
    "sample_names": "SELECT page_id, CASE page_id % 7 WHEN 4 THEN 'dir/sub/' || page_id || '.fa.gz' WHEN 5 THEN 'dir/sub/' || page_id || '.fq' WHEN 6 THEN 'dir/sub/' || page_id ELSE page_id::VARCHAR END AS name FROM pages",
    "iupac_merge": f"""WITH o AS (SELECT unnest(range(1, 16))::INTEGER AS a) SELECT x.a, y.a AS b, {_code('x.a')} AS code, {_code('(x.a | y.a)')} AS union_code,
      (((x.a >> 3) & 1) + ((x.a >> 1) & 2) + ((x.a << 1) & 4) + ((x.a << 3) & 8))::INTEGER AS complement, bit_count(x.a) > 1 AS ambiguous,
      round(CASE WHEN x.a = 15 OR y.a = 15 THEN 0 ELSE bit_count(x.a & y.a) / (bit_count(x.a) * bit_count(y.a))::DOUBLE END, 9) AS overlap FROM o x, o y""",
    "kmer_windows": _WHOLE.format(rows=_kmers(_REFERENCE, _K, rc=False)),
    "canonical_kmers": _WHOLE.format(rows=_kmers(_REFERENCE, _K)),
    "palindrome_keys": _WHOLE.format(rows=_kmers(_REFERENCE, 5)) + " WHERE palindrome",
    "build_index": _index(_documents()),
    "build_index_ss": _DIGEST.format(rows=_index(_documents(), rc=False)),
    "build_index_k31": _DIGEST.format(rows=_index(_documents(), 31)),
    "build_index_k63": _DIGEST.format(rows=_index(_documents(), 63)),
    "sample_kmer_counts": f"SELECT s.sample, count(i.key) AS n_kmers FROM (SELECT DISTINCT source AS sample FROM documents WHERE text IS NOT NULL) s LEFT JOIN ({_index(_documents())}) i ON i.sample = s.sample GROUP BY s.sample",
    "nk_summary": f"SELECT {_K} AS k, 64 AS k_bits, true AS rc, count(DISTINCT key) AS n_kmers, count(DISTINCT sample) AS n_samples FROM ({_index(_documents())})",
    "nk_full_info": _filtered("true", "0") + _columns(","),
    "align_no_filter": _filtered("true", _TENTH) + _columns(),
    "align_no_const": _filtered(_CONST, _TENTH) + _columns(),
    "align_no_ambig": _filtered("n_present = n_plain", _TENTH) + _columns(),
    "align_no_ambig_or_const": _filtered(f"n_bases + {_GAP} > 1", _TENTH) + _columns(),
    "align_gap_ignore": _filtered("n_codes > 1", _TENTH) + _columns(),
    "align_ambig_missing": _filtered(_CONST, _TENTH, missing=True) + _columns(),
    "align_ambig_mask": _filtered(_CONST, _TENTH, mask=True) + _columns(),
    "align_min_freq": _filtered(_CONST, "ceil(n * 0.9)") + _columns(),
    "align_fasta": _filtered(_CONST, "ceil(n * 0.25)") + f" SELECT g.sample, string_agg({_code('coalesce(mask, 0)')}, '' ORDER BY g.key) AS seq FROM (SELECT DISTINCT key, n.sample FROM kept, n) g LEFT JOIN kept ON kept.key = g.key AND kept.sample = g.sample GROUP BY g.sample",
    "weed": _DIGEST.format(rows=_WEEDED),
    "weed_reverse": f"SELECT * FROM ({_index(_documents())}) WHERE key IN (SELECT key FROM ({_kmers(_REFERENCE, _K)}))",
    "weed_min_freq_floor": _filtered("true", "floor(n * 0.13)", rows=_WEEDED) + _columns(),
    "delete_samples": _DIGEST.format(rows=_index(_documents("source NOT IN ('src0', 'src3')"))),
    "merge_indexes": _DIGEST.format(rows=_index(_documents())),
    "extend_indexes": _filtered(_CONST, "ceil(n * 0.2)", rows=f"SELECT * FROM ({_index(_documents())}) UNION ALL SELECT * FROM ({_index(_reads())})") + _columns(),
    "read_subsample": _index(f"SELECT * FROM ({_reads()}) WHERE contig % 3 = 0"),
    "quality_strict": _index(_reads("strict")),
    "quality_middle": _index(_reads(), middle=True),
    "quality_none": _index(_reads()),
    "read_min_count": f"SELECT sample, key, bit_or(mask)::INTEGER AS mask FROM (SELECT sample, key, mask FROM ({_kmers(_reads('strict'), _K)}) GROUP BY ALL HAVING count(*) >= 3) GROUP BY sample, key",
    "distance_default": _distances() + _DISTANCE,
    "distance_ambig": _distances(ambiguous=True) + _DISTANCE,
    "distance_min_freq": _distances(least="ceil(n * 0.2)") + _DISTANCE,
    "snp_matrix_exact": f"""WITH i AS MATERIALIZED ({_index(_documents())}), n AS (SELECT sample FROM i GROUP BY sample), d AS (SELECT a.sample AS s1, b.sample AS s2, count(*) FILTER (a.mask <> b.mask) AS snps FROM i a JOIN i b ON a.key = b.key GROUP BY ALL)
      SELECT x.sample AS sample1, y.sample AS sample2, coalesce(snps, 0) AS snps FROM n x CROSS JOIN n y LEFT JOIN d ON s1 = x.sample AND s2 = y.sample""",
    "phylip_matrix": _distances() + """, f AS (SELECT sample1, sample2, distance FROM told UNION ALL SELECT sample2, sample1, distance FROM told UNION ALL SELECT sample, sample, 0 FROM n)
      SELECT sample1 AS sample, string_agg(printf('%.6f', distance), chr(9) ORDER BY sample2) AS row FROM f GROUP BY sample1""",
    "distance_lines": _distances() + r" SELECT sample1, sample2, printf('%s\t%s\t%.2f\t%.5f\t%d\t%d', sample1, sample2, distance, mismatches, match_count, mismatch_count) AS line FROM told".replace(r"\t", "\t"),
    "single_linkage": _distances().replace("WITH i", "WITH RECURSIVE i", 1) + """, l AS (SELECT sample1 AS a, sample2 AS b FROM told WHERE distance <= 12 AND mismatches <= 0.995), both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
      reach AS (SELECT sample, sample AS seen FROM n UNION SELECT sample, b FROM reach JOIN both_ways ON a = seen),
      own AS (SELECT sample, min(seen) AS cluster FROM reach GROUP BY sample) SELECT sample, cluster, count(*) OVER (PARTITION BY cluster) AS size FROM own""",
    "ref_index": f"SELECT contig AS chrom, pos, key, mask, is_rc FROM ({_kmers(_REFERENCE, _K)})",
    "ref_repeats": f"SELECT key, count(*) AS n FROM ({_kmers(_REFERENCE, 9)}) GROUP BY key HAVING count(*) > 1",
    "ref_repeat_mask": f"WITH r AS MATERIALIZED ({_kmers(_REFERENCE, 9)}) SELECT DISTINCT contig AS chrom, (pos + unnest(range(-4, 5)))::INTEGER AS pos FROM r WHERE key IN (SELECT key FROM r GROUP BY key HAVING count(*) > 1)",
    "map_hits": _mapped() + " SELECT * FROM hit",
    "pseudoalign": _pseudo(),
    "pseudoalign_ambig_mask": _pseudo(mask=True, repeats=True),
    "map_results": _mapped() + """, told AS (SELECT n.sample, base.chrom, string_agg(coalesce(code, '-'), '' ORDER BY base.pos) AS seq FROM n CROSS JOIN base LEFT JOIN cell ON cell.sample = n.sample AND cell.chrom = base.chrom AND cell.pos = base.pos GROUP BY n.sample, base.chrom),
      full_ AS (SELECT n.sample, seqs.chrom, coalesce(told.seq, '') AS seq FROM n CROSS JOIN seqs LEFT JOIN told ON told.sample = n.sample AND told.chrom = seqs.chrom)
      SELECT f.sample, string_agg(seq, '|' ORDER BY chrom) AS sequences, (SELECT count(*) FROM (SELECT DISTINCT chrom, pos FROM hit WHERE hit.sample = f.sample)) AS variants, round(sum(length(replace(seq, '-', ''))) / sum(length(seq))::DOUBLE, 9) AS coverage FROM full_ f GROUP BY f.sample""",
    "map_coverage": _mapped() + " SELECT n.sample, count(cell.pos) AS covered, round(count(cell.pos) / (SELECT count(*) FROM base)::DOUBLE, 9) AS coverage FROM n LEFT JOIN cell ON cell.sample = n.sample GROUP BY n.sample",
    "vcf_sites": _vcf("chrom, pos, ref, alt"),
    "vcf_genotypes": _vcf("*", repeats=True),
    "cov_counts": f"SELECT key, count(*) AS n FROM ({_kmers(_reads(), _K)}) GROUP BY key",
    "cov_histogram": _HISTOGRAM,
    "cov_density": f"""SELECT count, n_kmers, round(exp(a) + exp(b), 9) AS density, CASE WHEN a < b THEN 'Coverage' ELSE 'Error' END AS component FROM
      (SELECT *, ln(0.8) - lgamma(count + 1) - 1 AS a, ln(0.2) + count * ln(20) - lgamma(count + 1) - 20 AS b FROM ({_HISTOGRAM}))""",
    "graph_edges": _COLOURS + " SELECT n::INTEGER AS n_samples, count(*) AS n_edges, count(DISTINCT src) AS n_src, min(src) AS first_src, max(dst) AS last_dst FROM e GROUP BY n",
    "graph_colours": _COLOURS + " SELECT samples, count(*) AS n_kmers FROM c GROUP BY samples",
    "graph_entry_nodes": _COLOURS + " SELECT src AS node FROM e GROUP BY src HAVING count(*) > 1 AND count(DISTINCT samples) > 1",
}
