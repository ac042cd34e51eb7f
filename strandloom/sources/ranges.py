"""Plain FASTA files in byte ranges, so that many tasks read one file, or one contig.

A first pass counts the headers of every range, a window over a file's ranges turns the
counts into record numbers, and a second pass reads the bases.  A range reads on for a
few bases of its last contig, so that every k-mer lies whole in some piece.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a range; shorter files are read whole.
RANGE = 8 << 20
_AHEAD = 1 << 16
_BLANKS = b" \t\r\n"


def _file(path: str) -> pa.NativeFile:
    store, name = pafs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))
    return store.open_input_file(name)


def _rows(frame: DataFrame, schema: str, one: Callable[..., Iterator[tuple]]) -> DataFrame:
    """``frame`` with the columns of ``schema`` that ``one`` gives for each row, any number of times."""
    own = frame.columns
    new = [c.split()[0] for c in schema.split(", ")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                for told in one(**row):
                    yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *(pa.array([v], types[c]) for c, v in zip(new, told, strict=True))], names=[*own, *new])

    types = {c.split()[0]: {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[c.split()[1]] for c in schema.split(", ")}
    return frame.mapInArrow(run, f"{kinds}, {schema}")


def with_length(each: DataFrame) -> DataFrame:
    """Files (``path``) with ``length``: their bytes if they are plain FASTA, else null."""

    def one(path: str, **_: object) -> Iterator[tuple]:
        with _file(path) as f:
            yield (f.size() if f.read(_AHEAD).lstrip()[:1] == b">" else None,)

    return _rows(each, "length long", one)


def _lines(raw: np.ndarray, at_start: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the lines that begin in ``raw``, and which of them are headers."""
    starts = np.flatnonzero(raw == 10) + 1
    starts = np.concatenate([[0] if at_start else [], starts[starts < len(raw)]]).astype(np.int64)
    return starts, raw[starts] == ord(">")


def _block(f: pa.NativeFile, begin: int, end: int) -> tuple[bytes, bool]:
    """The bytes of a range, and whether it begins a line."""
    f.seek(max(begin - 1, 0))
    data = f.read(end - max(begin - 1, 0))
    return (data, True) if begin == 0 else (data[1:], data[:1] == b"\n")


def _name(f: pa.NativeFile, at: int) -> str:
    """The first word of the header that begins at a place of the file."""
    f.seek(at + 1)
    line = b""
    while b"\n" not in line and (more := f.read(_AHEAD)):
        line += more
    return (line.split(b"\n", 1)[0].split() or [b""])[0].decode()


def _following(f: pa.NativeFile, at: int, line_start: bool, n: int) -> bytes:
    """The next ``n`` bases of the same contig from a place of the file on, or as many as there are."""
    f.seek(at)
    found = b""
    while len(found) < n and (data := f.read(_AHEAD)):
        raw = np.frombuffer(data, np.uint8)
        starts, headers = _lines(raw, line_start)
        stop = starts[headers]
        found += data[: stop[0] if len(stop) else None].translate(None, _BLANKS)
        if len(stop):
            break
        line_start = data[-1:] == b"\n"
    return found[:n]


def _scan(path: str, begin: int, end: int, **_: object) -> Iterator[tuple]:
    """Number of headers, whether the last line that begins here is one (null without any), and the last one's name."""
    with _file(path) as f:
        data, at_start = _block(f, begin, end)
        starts, headers = _lines(np.frombuffer(data, np.uint8), at_start)
        last = starts[headers][-1:]
        yield len(starts[headers]), bool(headers[-1]) if len(starts) else None, _name(f, begin + int(last[0])) if len(last) else None


def _bases(k: int) -> Callable[..., Iterator[tuple]]:
    def one(path: str, begin: int, end: int, before: int, in_header: bool, name: str | None, **_: object) -> Iterator[tuple]:
        """Record number, contig and bases of every contig of a range; the last with ``k + 1`` bases that follow."""
        with _file(path) as f:
            data, at_start = _block(f, begin, end)
            raw = np.frombuffer(data, np.uint8)
            starts, headers = _lines(raw, at_start)
            first = int(starts[0]) if in_header and len(starts) else len(raw) if in_header else 0
            cuts = starts[headers]
            for i in range(len(cuts) + 1):
                lo, hi = int(cuts[i - 1]) if i else first, int(cuts[i]) if i < len(cuts) else len(data)
                if i:
                    name = _name(f, begin + lo)
                    lo = data.find(b"\n", lo, hi) + 1 or hi  # the header's own line
                seq = data[lo:hi].translate(None, _BLANKS)
                if seq and i == len(cuts):
                    seq += _following(f, end, data[-1:] == b"\n", k + 1)
                if seq:
                    yield before + i - 1, name, seq.decode()

    return one


def pieces(each: DataFrame, k: int) -> DataFrame:
    """``sample file_no rec_no contig seq qual`` of plain FASTA files (``sample file_no path length``), cut into ranges.

    A contig's pieces overlap, so that each of its k-mers lies whole in a piece, with the base before
    or after it where a window alone at a contig's end is judged.  A k-mer at a border
    may be in two pieces: for indexes, not for counts.  A header's sign begins its line.
    Blanks are no bases.  Records without bases give no piece.
    """
    size = RANGE
    cut = each.select("sample", "file_no", "path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))).alias("begin"))
    cut = cut.select("sample", "file_no", "path", "begin", F.least(F.col("begin") + size, F.col("length")).alias("end"))
    n = max(1, min(cut.count(), 10_000))
    scanned = _rows(cut.repartition(n, "path", "begin"), "n_headers long, last_is_header boolean, last_name string", _scan)
    earlier = W.partitionBy("sample", "file_no", "path").orderBy("begin").rowsBetween(W.unboundedPreceding, -1)
    state = scanned.select(
        "sample", "file_no", "path", "begin", "end", F.coalesce(F.sum("n_headers").over(earlier), F.lit(0)).alias("before"),
        F.coalesce(F.last("last_is_header", True).over(earlier), F.lit(False)).alias("in_header"), F.last("last_name", True).over(earlier).alias("name"),
    )
    rows = _rows(state.repartition(n, "path", "begin"), "rec_no long, contig string, seq string", _bases(k))
    return rows.select("sample", "file_no", "rec_no", "contig", "seq", F.lit(None).cast("string").alias("qual"))
