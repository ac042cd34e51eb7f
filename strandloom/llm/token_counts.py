"""Token counts without building pieces: linear longest-match over a vocabulary trie.

Greedy word-piece takes, again and again, the longest vocabulary entry that the rest
of the word starts with.  The automaton does so in one pass over the bytes: where the
trie has no edge for the next byte, a node's failure link leads to the node for what
is left after the longest pieces have been cut off, and the number of pieces cut off
on the way is stored with the link.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.resident import resident
from strandloom.llm.tokens import MAX_WORDS, WordTable, default_tokenizer, in_blocks

#: Fixed value: the pre-tokenizer pattern of the vocabulary file.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Stands for the end of a word, which many vocabulary entries include.
END = 256
_WIDTH = 257


def byte_alphabet() -> dict[str, int]:
    """The printable characters by which vocabulary files of this kind write bytes.

    Printable Latin-1 bytes stand for themselves; the others follow from 256 on.
    """
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def vocabulary(path: str) -> list[tuple[int, ...]]:
    """The entries of a tokenizer file as byte sequences, with ``END`` where one ends a word."""
    spec = json.load(open(path, encoding="utf-8"))
    end, special, of = spec["model"]["end_of_word_suffix"], {t["content"] for t in spec["added_tokens"]}, byte_alphabet()
    out = []
    for entry in spec["model"]["vocab"]:
        if entry not in special:
            last = entry.endswith(end)
            out.append((*(of[c] for c in (entry[: -len(end)] if last else entry)), *((END,) if last else ())))
    return out


class LongestMatch:
    """The automaton over sequences of small integers.

    A word end that is left over alone, after a piece that could not include it, is
    cut off like a piece but not counted.
    """

    def __init__(self, entries: list[tuple[int, ...]]) -> None:
        entries = [*entries, (END,)]
        edge: dict[int, int] = {}
        depth_first: list[tuple[int, int, int]] = []  # node, parent, symbol
        whole = set()
        for entry in entries:
            node = 0
            for symbol in entry:
                key = node * _WIDTH + symbol
                if key not in edge:
                    edge[key] = len(depth_first) + 1
                    depth_first.append((edge[key], node, symbol))
                node = edge[key]
            if node:
                whole.add(node)
        n = len(depth_first) + 1
        level = [0] * n
        for node, parent, _ in depth_first:  # a parent comes before its children
            level[node] = level[parent] + 1
        fail, popped = [-1] * n, [0] * n
        for node, parent, symbol in sorted(depth_first, key=lambda x: level[x[0]]):
            if node in whole:
                fail[node], popped[node] = 0, int(node != edge[END])
                continue
            at, cut = fail[parent], popped[parent]
            while at >= 0 and at * _WIDTH + symbol not in edge:
                at, cut = fail[at], cut + popped[at]
            if at >= 0:
                fail[node], popped[node] = edge[at * _WIDTH + symbol], cut
        self.edge, self.fail, self.popped = edge, fail, popped

    def count(self, word: bytes) -> int | None:
        """Pieces of ``word`` with its end, or None if the vocabulary can't spell it."""
        edge, fail, popped, node, pieces = self.edge, self.fail, self.popped, 0, 0
        for symbol in (*word, END):
            while (to := edge.get(node * _WIDTH + symbol)) is None:
                if fail[node] < 0:
                    return None
                pieces += popped[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return None
            pieces += popped[node]
            node = fail[node]
        return pieces


class Counter:
    """Counts of texts in a worker process, with a bounded table of the words that recur."""

    def __init__(self, path: str, max_words: int = MAX_WORDS) -> None:
        self.match, self.table = LongestMatch(vocabulary(path)), WordTable(self._learn, max_words)

    def _tokens(self, piece: str) -> int:
        n = self.match.count(piece.encode())
        return 1 if n is None else n  # an unknown word is one token

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = [_PIECES.findall(w.lower()) for w in words]
        both = np.array([(len(p), sum(map(self._tokens, p))) for p in split], np.uint32)
        return both.ravel(), np.full(len(words), 2)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Words and tokens of each text."""
        both, lengths = self.table.look_up(texts)
        sums = np.concatenate([np.zeros((1, 2), np.int64), np.cumsum(both.reshape(-1, 2), axis=0, dtype=np.int64)])
        return np.diff(sums[np.concatenate([[0], np.cumsum(lengths) // 2])], axis=0)


def count_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens`` of every row of ``docs``.

    The text is lower-cased and cut into words as the vocabulary's own tokenizer cuts
    it (letters, single digits, runs of other signs).  A null or empty text has none;
    repeated rows come back once each; other columns play no part.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = resident("table", ("counter", path), lambda: Counter(path))
        for batch in in_blocks(batches):
            n = counter.count(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n[:, 0]), pa.array(n[:, 1])], names=["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    """Words and tokens of every document; see :func:`count_tokens`."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
