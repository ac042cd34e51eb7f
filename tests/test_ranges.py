"""FASTA by byte ranges against the same file read whole."""

import gzip
import random

from strandloom.functions.kmers import windows
from strandloom.operators import index
from strandloom.sources import ranges, sequences


def fasta(seed, n, width, end="\n"):
    """Records of all lengths, with unknown bases, empty records, signs inside headers, blank lines and lines of many widths."""
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        seq = "".join(rnd.choice("ACGTACGTACGTN") for _ in range(rnd.choice([0, 1, 4, 5, 6, 11, 60, 300])))
        out.append(f">c{i} a > b{'x' * rnd.randrange(30)}{end}")
        w = rnd.choice([width, 7, 1000])
        out += [seq[j : j + w] + end for j in range(0, len(seq), w)] + [end] * (rnd.random() < 0.1)
    text = "".join(out)
    return text.rstrip() if rnd.random() < 0.5 else text


def found(records, k):
    """K-mers by record."""
    told = set()
    for no, name, seq in records:
        w = windows([seq.encode()], None, k, True, "none", 20)
        told |= {(no, name, int(a), int(b), int(m)) for a, b, m in zip(w["key_hi"], w["key_lo"], w["mask"], strict=True)}
    return told


def test_every_cut_gives_the_same_kmers(tmp_path):
    for seed in range(60):
        k, size = random.Random(seed).choice([(5, 3), (5, 17), (7, 40), (11, 64), (11, 1)])
        text = fasta(seed, 12, 10 + seed % 20, "\r\n" if seed % 3 == 0 else "\n").encode()
        path = str(tmp_path / f"{seed}.fa")
        (tmp_path / f"{seed}.fa").write_bytes(text)
        got, before, in_header, name = [], 0, False, None
        for begin in range(0, len(text), size):
            end = min(begin + size, len(text))
            got += list(ranges._bases(k)(path=path, begin=begin, end=end, before=before, in_header=in_header, name=name))
            ((n, last, own),) = ranges._scan(path=path, begin=begin, end=end)
            before, in_header, name = before + n, in_header if last is None else last, own or name
        whole = [(i, name, seq) for i, (name, seq, _) in enumerate(sequences.records(iter(text.splitlines(True))))]
        assert before == len(whole) and found(got, k) == found(whole, k), seed


def test_read_for_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "RANGE", 500)
    (tmp_path / "long.fa").write_text(fasta(1, 40, 60))
    (tmp_path / "short.fa").write_text(">a\nACGTTGCATGCA\n")
    (tmp_path / "none.fa").write_text("")
    with gzip.open(tmp_path / "packed.fa.gz", "wt") as f:
        f.write(fasta(2, 20, 60))
    (tmp_path / "reads.fastq").write_text("".join(f"@r{i}\nACGTTGCATGCATTGACC\n+\n{'I' * 18}\n" for i in range(30)))
    listed = sequences.files(spark, [str(tmp_path / n) for n in ("long.fa", "short.fa", "none.fa", "packed.fa.gz", "reads.fastq")])
    rows = sequences.read_for_index(listed, 11)
    longest = max(len(r.seq) for r in rows.where("sample = 'long'").collect())
    assert rows.where("sample = 'long'").count() > 5 and longest <= 500 + 12 and rows.where("sample = 'reads'").count() == 30
    whole = index.build(sequences.read(listed), 11, quality="strict", min_count=3, names=["long"])
    cut = index.build(rows, 11, quality="strict", min_count=3, names=["long"])
    assert sorted(map(tuple, cut.kmers.collect())) == sorted(map(tuple, whole.kmers.collect()))
    assert sequences.read_for_index(sequences.files(spark, [str(tmp_path / "short.fa")]), 11).count() == 1
