"""Nodes of the graph where all their neighbours are, without a row a k-mer.

Sequences are written once as stretches (runs of k-mers, two bits a base).  Adjacent nodes
with the same bucket, by the least canonical m-mer of each, travel as one piece of text with a base
more on both sides; both strands of a node, and all k-mers that touch it, are so in one task.
It tells of entries and exits, and where stretches are to be cut: at nodes with a choice
and at nodes where any stretch begins or ends.  What lies between two cuts is the same in each
stretch that has it, so pieces of the graph are rows, and their texts are places in a stretch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.bases import DIGITS
from strandloom.functions.kmers import arms as _arms
from strandloom.functions.kmers import pack_bases as _packed
from strandloom.functions.kmers import unpack_bases as _unpacked
from strandloom.functions.kmers import within as _within
from strandloom.operators.blocks import Text, starts
from strandloom.sources.shared import materialize

#: Length of the m-mers that deal nodes, buckets as bits, k-mers in a stretch, bases and nodes that a task takes at once.
DEAL, BUCKET_BITS, STRETCH, BASES, AT_ONCE = 12, 14, 1 << 16, 2 << 20, 1 << 17
#: The number of texts that are asked for, in place of a sample's.
ASKED = -1
#: Bits of what a node is.
INNER, ENTRY, EXIT = 1, 2, 4
_META = np.dtype([("rid", "<i8"), ("at", "<i4"), ("n", "<i4"), ("own", "<i4")])
_LETTERS = np.frombuffer(DIGITS.encode(), np.uint8)


def _parts(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``batches`` in parts of ``BASES`` or so."""
    for batch in batches:
        total, at = np.cumsum(size(batch)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + BASES, side="right")))
            yield batch.slice(at, to - at)
            at = to


def stretches(seqs: DataFrame, k: int, quality: str = "none", min_qual: int = 20) -> DataFrame:
    """``no size seq``: runs of k-mers of ``seqs`` (``no``, ``seq`` and for reads ``qual``) with their bases, packed."""
    reads = "qual" in seqs.columns and quality != "none"
    rows = seqs.where("seq is not null and no is not null").select("no", F.col("seq").cast("binary").alias("seq"), *([F.col("qual").cast("binary").alias("qual")] if reads else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, lambda b: pc.binary_length(b["seq"]).to_numpy(zero_copy_only=False).astype(np.int64)):
            texts = [Text(*own) for own in zip(part["no"].to_pylist(), part["seq"].to_pylist(), part["qual"].to_pylist() if reads else [None] * part.num_rows, strict=True)]
            for some in [texts] if len(texts) > 1 else ([t] for t in texts[0].parts(BASES, k)):
                raw, kept, begins = starts(some, k, quality if reads else "none", min_qual)
                turns = np.flatnonzero(np.diff(kept, prepend=False, append=False))
                new, n = turns[::2], turns[1::2] - turns[::2]
                if not len(new):
                    continue
                parts = -(-n // STRETCH)
                step = _within(parts) * STRETCH
                first, n = np.repeat(new, parts) + step, np.minimum(np.repeat(n, parts) - step, STRETCH)
                numbers, digits = np.array([t.no for t in some], np.int32)[np.searchsorted(begins, first, "right") - 1], raw >> 1 & 3
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array((n + k - 1).astype(np.int32)), pa.array([_packed(digits[a : a + m]) for a, m in zip(first.tolist(), (n + k - 1).tolist(), strict=True)], pa.binary())], names=["no", "size", "seq"])

    return rows.mapInArrow(run, "no int, size int, seq binary")


def _buckets(digits: np.ndarray, g: int) -> np.ndarray:
    """The bucket of the node at each place."""
    m = min(DEAL, g)
    forward, back = _arms(digits, m)
    with np.errstate(over="ignore"):
        x = np.minimum(forward, back).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        left, wide = g - m + 1, 1  # the least of ``wide`` at each place
        while wide < left:
            step = min(wide, left - wide)
            x, wide = np.minimum(x[: len(x) - step], x[step:]), wide + step
        return ((x ^ x >> np.uint64(31)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)


def _dealt(stretch: DataFrame, g: int) -> DataFrame:
    """``bucket meta bases``: the runs of adjacent nodes of a bucket, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, lambda b: b["size"].to_numpy().astype(np.int64)):
            size = part["size"].to_numpy().astype(np.int64)
            digits = _unpacked(b"".join(part["seq"].to_pylist()))
            wide = -(-size // 4) * 4
            begins, n_nodes = np.cumsum(wide) - wide, size - g + 1
            own = np.repeat(np.arange(len(size)), n_nodes)
            at = _within(n_nodes)
            place = begins[own] + at
            bucket = _buckets(digits, g)[place]
            new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (bucket[1:] != bucket[:-1])]))
            n = np.diff(np.append(new, len(own)))
            order = np.argsort(bucket[new], kind="stable")
            new, n = new[order], n[order]
            s = own[new]
            before, after = at[new] > 0, at[new] + n < n_nodes[s]
            long = n + g - 1 + before + after
            padded = -(-long // 4) * 4
            ends = np.cumsum(padded)
            text = np.zeros(int(ends[-1]), np.uint8)
            inside = _within(long)
            text[np.repeat(ends - padded, long) + inside] = digits[np.repeat(place[new] - before, long) + inside]
            meta = np.empty(len(new), _META)
            meta["rid"], meta["at"], meta["n"], meta["own"] = part["rid"].to_numpy()[s], at[new], n, part["no"].to_numpy()[s].astype(np.int64) * 4 + before + 2 * after
            first = np.flatnonzero(np.concatenate([[True], bucket[new][1:] != bucket[new][:-1]]))
            metas, bases = np.append(first, len(new)) * _META.itemsize, np.append((ends - padded)[first], ends[-1]) // 4
            told = [pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(o.astype(np.int32)), pa.py_buffer(x)]) for o, x in ((metas, meta.tobytes()), (bases, _packed(text)))]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[new][first].astype(np.int32)), *told], names=["bucket", "meta", "bases"])

    return stretch.select("rid", "no", "size", "seq").mapInArrow(run, "bucket int, meta binary, bases binary").repartition("bucket").sortWithinPartitions("bucket")


@dataclass
class Nodes:
    """Nodes (smaller strand), their successors (``out``: four bits a strand), and where they occur."""

    hi: np.ndarray
    lo: np.ndarray
    r_hi: np.ndarray
    r_lo: np.ndarray
    out: np.ndarray
    #: words of a sample set
    words: int
    #: of each occurrence: node, sample, its successors' bits, whether on the node's other strand, stretch, place, whether a stretch begins or ends there
    node: np.ndarray
    no: np.ndarray
    bits: np.ndarray
    minus: np.ndarray
    rid: np.ndarray
    at: np.ndarray
    edge: np.ndarray

    @property
    def same(self) -> np.ndarray:
        """Palindromes: their strands are one, and the second is left empty where edges are listed."""
        return (self.hi == self.r_hi) & (self.lo == self.r_lo)

    def sets(self, some: np.ndarray) -> np.ndarray:
        """The sample sets of the successors of ``some`` nodes: word, node, strand, base."""
        place = np.cumsum(some) - 1
        own = np.flatnonzero(some[self.node] & (self.no >= 0))
        node, no, bits = place[self.node[own]], self.no[own].astype(np.int64), self.bits[own]
        sets = np.zeros((self.words, int(some.sum()) * 8), np.int64)
        for j in range(8):
            seen = bits >> j & 1 == 1
            for w in range(self.words):
                mine = seen & (no >> 6 == w) if self.words > 1 else seen
                np.bitwise_or.at(sets[w], node[mine] * 8 + j, np.int64(1) << (no[mine] & 63))
        return sets.reshape(self.words, -1, 2, 4)

    def entry(self) -> np.ndarray:
        """Of each node and strand: whether two successors have different samples."""
        found, big, same = np.zeros((len(self.hi), 2), bool), np.iinfo(np.int64), self.same
        n = np.stack([np.bitwise_count(self.out & 15), np.bitwise_count(self.out >> 4)], axis=1)
        some = (n > 1).any(axis=1)
        sets = self.sets(some)
        there = (sets != 0).any(axis=0)
        low, high = np.where(there, sets, big.max).min(axis=3), np.where(there, sets, big.min).max(axis=3)
        found[some] = (n[some] > 1) & (low != high).any(axis=0)
        found[same, 1] = found[same, 0]
        return found

    def inner(self, entry: np.ndarray) -> np.ndarray:
        """One way in and out, and neither an entry nor an exit."""
        minus = np.where(self.same, self.out & 15, self.out >> 4)
        return (np.bitwise_count(self.out & 15) == 1) & (np.bitwise_count(minus) == 1) & ~entry.any(axis=1)


def _nodes(held: list[tuple[bytes, bytes]], g: int, words: int) -> Nodes:
    h, meta, digits = g // 2, np.frombuffer(b"".join(m for m, _ in held), _META), _unpacked(b"".join(b for _, b in held))
    n = meta["n"].astype(np.int64)
    before, after, own = meta["own"] & 1, meta["own"] >> 1 & 1, meta["own"] >> 2
    padded = -(-(n + g - 1 + before + after) // 4) * 4
    run, i = np.repeat(np.arange(len(n)), n), _within(n)
    place = np.repeat(np.cumsum(padded) - padded + before, n) + i
    forward, back = _arms(digits, h)
    hi, lo, r_hi, r_lo = forward[place], forward[place + h], back[place + h], back[place]
    minus = (hi > r_hi) | ((hi == r_hi) & (lo > r_lo))
    order = np.argsort(np.where(minus, r_hi << 2 * h | r_lo, hi << 2 * h | lo)) if h <= 15 else np.lexsort((np.where(minus, r_lo, lo), np.where(minus, r_hi, hi)))
    turned = minus[order]
    hi, lo, r_hi, r_lo = hi[order], lo[order], r_hi[order], r_lo[order]
    hi, lo, r_hi, r_lo = np.where(turned, r_hi, hi), np.where(turned, r_lo, lo), np.where(turned, hi, r_hi), np.where(turned, lo, r_lo)
    new = np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(new) - 1
    kept = np.flatnonzero(new)
    there, here = (i > 0) | (before == 1)[run], (i < n[run] - 1) | (after == 1)[run]
    one, strand = np.uint8(1), minus.astype(np.uint8) << 2
    ahead, behind = digits[np.minimum(place + g, len(digits) - 1)], digits[np.maximum(place - 1, 0)] ^ 2
    same = ((hi == r_hi) & (lo == r_lo))[kept][node]
    bits = np.where(here, one << (strand | ahead), 0).astype(np.uint8) | np.where(there, one << (np.where(same, 0, strand ^ 4).astype(np.uint8) | behind), 0).astype(np.uint8)
    mine = own[run]
    seen = np.where(mine >= 0, bits, 0).astype(np.uint8)
    out = np.bitwise_or.reduceat(seen[order], kept)
    return Nodes(hi[kept], lo[kept], r_hi[kept], r_lo[kept], out, words, node, mine, bits, minus, meta["rid"][run], meta["at"][run] + i, ~(there & here))


def _strand(nodes: Nodes, node: np.ndarray, strand: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.where(strand == 1, nodes.r_hi[node], nodes.hi[node]), np.where(strand == 1, nodes.r_lo[node], nodes.lo[node])


def _listed(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, strand and base of every bit."""
    at = np.flatnonzero(np.unpackbits(bits, bitorder="little").view(bool))
    return at >> 3, at >> 2 & 1, at & 3


@dataclass(frozen=True)
class Strands:
    """The stretches of an index's sequences (``rid no size seq``), written once."""

    k: int
    n_samples: int
    rows: DataFrame

    @property
    def words(self) -> int:
        return max(1, -(-self.n_samples // 64))

    def map(self, tell: Callable[[Nodes], Iterator[pa.RecordBatch]], schema: str, more: DataFrame | None = None) -> DataFrame:
        """``tell`` over all nodes, many at a time, each with all its occurrences."""
        g, words = self.k - 1, self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n, last = [], 0, -1
            for batch in batches:
                for bucket, meta, bases in zip(*(batch[c].to_pylist() for c in ("bucket", "meta", "bases")), strict=True):
                    if bucket != last and n >= AT_ONCE:
                        yield from tell(_nodes(held, g, words))
                        held, n = [], 0
                    last = bucket
                    held.append((meta, bases))
                    n += len(bases) * 4 - len(meta) // _META.itemsize * (g + 1)
            if held:
                yield from tell(_nodes(held, g, words))

        return _dealt(self.rows if more is None else self.rows.unionByName(more), g).mapInArrow(run, schema)

    def of(self, text: DataFrame) -> DataFrame:
        """``key_hi key_lo b`` and the sample set of the k-mers in text (one column) that any sample has."""
        k, h, words = self.k, (self.k - 1) // 2, self.words
        # two strands of a k-mer are told at two nodes; the one with the smaller arms tells, and a palindrome's both
        asked = stretches(text.toDF("t").distinct().select(F.lit(ASKED).alias("no"), F.concat("t", F.lit("N")).alias("seq")), k).withColumn("rid", F.lit(-1).cast("long"))

        def tell(nodes: Nodes) -> Iterator[pa.RecordBatch]:
            by, asked = np.flatnonzero(nodes.no < 0), np.zeros(len(nodes.hi), np.uint8)
            np.bitwise_or.at(asked, nodes.node[by], nodes.bits[by])
            asked &= nodes.out
            some = np.flatnonzero(asked)
            place, strand, base = _listed(asked[some])
            node = some[place]
            hi, lo = _strand(nodes, node, strand)
            low = (lo << 2 & np.int64((1 << 2 * h) - 1)) | base
            turned = [np.zeros(len(hi), np.int64) for _ in range(2)]
            for j in range(h):
                for out, arm in zip(turned, (low, hi), strict=True):
                    out |= (arm >> 2 * j & 3 ^ 2) << 2 * (h - 1 - j)
            own = (hi < turned[0]) | ((hi == turned[0]) & (low <= turned[1]))
            sets = nodes.sets(asked > 0)[:, place, strand, base][:, own]
            yield pa.RecordBatch.from_arrays([pa.array(hi[own]), pa.array(low[own]), pa.array((lo[own] >> 2 * (h - 1)).astype(np.int32)), *(pa.array(s) for s in sets)], names=["key_hi", "key_lo", "b", *(f"s{w}" for w in range(words))])

        return self.map(tell, f"key_hi long, key_lo long, b int, {', '.join(f's{w} long' for w in range(words))}", asked)

    def entry_nodes(self) -> DataFrame:
        """``hi lo``: nodes, on every strand, whose successors have different samples."""

        def tell(nodes: Nodes) -> Iterator[pa.RecordBatch]:
            entry = nodes.entry()
            entry[:, 1] &= ~nodes.same
            a, b = np.flatnonzero(entry[:, 0]), np.flatnonzero(entry[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.append(nodes.hi[a], nodes.r_hi[b])), pa.array(np.append(nodes.lo[a], nodes.r_lo[b]))], names=["hi", "lo"])

        return self.map(tell, "hi long, lo long")

    def edge_counts(self) -> DataFrame:
        """``n_samples n_edges n_src src_hi src_lo dst_hi dst_lo``: of each part of the edges, by number of samples, how many there are, and the first source and the last end by alphabet."""
        h, schema = (self.k - 1) // 2, "n_samples int, n_edges long, n_src long, src_hi long, src_lo long, dst_hi long, dst_lo long"
        full = np.int64((1 << 2 * h) - 1)
        rank = lambda x: x ^ (x >> 1 & np.int64(0x5555555555555555))  # noqa: E731  T and G change places: the alphabet's order

        def tell(nodes: Nodes) -> Iterator[pa.RecordBatch]:
            node, strand, base = _listed(nodes.out)
            n, often = np.ones(len(node), np.int64), np.bincount(nodes.node, minlength=len(nodes.hi)) > 1
            at, place = often[node], np.cumsum(often) - 1
            n[at] = np.bitwise_count(nodes.sets(often).view(np.uint64)).sum(axis=0, dtype=np.int64)[place[node[at]], strand[at], base[at]]
            hi, lo = _strand(nodes, node, strand)
            next_hi, next_lo = (hi << 2 & full) | lo >> 2 * (h - 1), (lo << 2 & full) | base
            told = []
            for m in np.unique(n).tolist():
                own = np.flatnonzero(n == m)
                a, c = rank(hi[own]), rank(next_hi[own])
                first, last = own[a == a.min()], own[c == c.max()]
                first, last = first[rank(lo[first]).argmin()], last[rank(next_lo[last]).argmax()]
                source = node[own] * 2 + strand[own]
                told.append((m, len(own), int((source[1:] != source[:-1]).sum()) + 1, hi[first], lo[first], next_hi[last], next_lo[last]))
            if told:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c), t) for c, t in zip(zip(*told, strict=True), [pa.int32()] + [pa.int64()] * 6, strict=True)], names=[c.split()[0] for c in schema.split(", ")])

        return self.map(tell, schema)

    def cuts(self) -> DataFrame:
        """``rid at kind``: where stretches are cut, and what the node is there."""

        def tell(nodes: Nodes) -> Iterator[pa.RecordBatch]:
            entry = nodes.entry()
            inner = nodes.inner(entry)
            cut = ~inner
            cut[nodes.node[nodes.edge]] = True
            at = np.flatnonzero(cut[nodes.node])
            node, strand = nodes.node[at], nodes.minus[at].astype(np.int64)
            kind = INNER * inner[node] + ENTRY * entry[node, strand] + EXIT * entry[node, 1 - strand]
            yield pa.RecordBatch.from_arrays([pa.array(nodes.rid[at]), pa.array(nodes.at[at].astype(np.int32)), pa.array(kind.astype(np.int32))], names=["rid", "at", "kind"])

        return self.map(tell, "rid long, at int, kind int")

    def pieces(self) -> DataFrame:
        """``sid src_hi src_lo src_kind dst_hi dst_lo dst_kind length rid place back``: what lies between two cuts, on both strands, once, and a place that has it."""
        g, h = self.k - 1, (self.k - 1) // 2
        cut = self.cuts().groupBy("rid").agg(F.collect_list(F.struct("at", "kind")).alias("cuts"))  # at most STRETCH + 1
        rows = self.rows.select("rid", "size", "seq").join(cut, "rid")
        names = ["src_hi", "src_lo", "base", "src_kind", "dst_hi", "dst_lo", "dst_kind", "length", "rid", "place", "back"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in _parts(batches, lambda b: b["size"].to_numpy().astype(np.int64)):
                wide = -(-part["size"].to_numpy().astype(np.int64) // 4) * 4
                digits, begins = _unpacked(b"".join(part["seq"].to_pylist())), np.cumsum(wide) - wide
                own = np.repeat(np.arange(part.num_rows), pc.list_value_length(part["cuts"]).to_numpy())
                flat = part["cuts"].flatten()
                at, kind = flat.field("at").to_numpy().astype(np.int64), flat.field("kind").to_numpy()
                order = np.lexsort((at, own))
                own, at, kind = own[order], at[order], kind[order]
                p = np.flatnonzero(own[1:] == own[:-1])
                a, b = (begins[own[i]] + at[i] for i in (p, p + 1))
                forward, back = _arms(digits, h)
                turned = (kind & INNER) | (kind & ENTRY) << 1 | (kind & EXIT) >> 1
                rid, length = part["rid"].to_numpy()[own[p]], at[p + 1] - at[p]
                plus = [forward[a], forward[a + h], digits[a + g], kind[p], forward[b], forward[b + h], kind[p + 1], length, rid, at[p], np.zeros(len(p), np.int32)]
                minus = [back[b + h], back[b], digits[b - 1] ^ 2, turned[p + 1], back[a + h], back[a], turned[p], length, rid, at[p], np.ones(len(p), np.int32)]
                kinds = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int32, np.int64, np.int64, np.int64, np.int32]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x, y]).astype(t)) for x, y, t in zip(plus, minus, kinds, strict=True)], names=names)

        found = rows.mapInArrow(run, "src_hi long, src_lo long, base int, src_kind int, dst_hi long, dst_lo long, dst_kind int, length long, rid long, place long, back int")
        return materialize(found.dropDuplicates(["src_hi", "src_lo", "base"]).drop("base").withColumn("sid", F.monotonically_increasing_id()), "pieces")

    def spelled(self, places: DataFrame) -> DataFrame:
        """``places`` (``rid place length back`` and others) with ``bases``: the last bases of the nodes after the first."""
        g, kept = self.k - 1, [c for c in places.columns if c not in ("rid", "place", "length", "back")]
        rows = places.join(self.rows.select("rid", "seq"), "rid").select(F.struct(*kept).alias("row"), "place", "length", "back", "seq")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for seq, a, n, back in zip(*(batch[c].to_pylist() for c in ("seq", "place", "length", "back")), strict=True):
                    low = a if back else a + g
                    own = _unpacked(seq[low // 4 : (low + n + 3) // 4])[low % 4 : low % 4 + n]
                    out.append(_LETTERS[own[::-1] ^ 2 if back else own].tobytes().decode())
                yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, pa.string())], names=["row", "bases"])

        return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, bases string").select("row.*", "bases")


def written(seqs: DataFrame, n_samples: int, k: int, quality: str = "none", min_qual: int = 20) -> Strands:
    rows = stretches(seqs, k, quality, min_qual).withColumn("rid", F.monotonically_increasing_id())
    return Strands(k, n_samples, materialize(rows, "stretches"))
