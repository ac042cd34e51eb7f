"""Token ids of whole texts with a public tokenizer, fast enough for a corpus.

The tokenizer drops white space and never joins text across it, so the ids of a
text are the ids of its white-space separated words in order.  Words recur, so a
worker keeps a bounded table of those it has seen and asks the tokenizer only for
new ones.  The tokenizer gets words as they are: normalising, lower-casing and
cutting are its own business.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandloom.llm.resident import resident

#: Words that a worker's table keeps from block to block.
MAX_WORDS = 680_000
#: Between words that are encoded in one call: a control sign, one id where it stands alone.
_MARK = "\x7f"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Lists:
    """Number sequences by entry, in one growing array."""

    def __init__(self) -> None:
        self.flat = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 12, np.int64)
        self.entries = 0

    def extend(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        used, n = int(self.ends[self.entries]), len(lengths)
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.entries + n + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.empty_like(self.ends)])
        self.flat[used : used + len(ids)] = ids
        self.ends[self.entries + 1 : self.entries + 1 + n] = used + np.cumsum(lengths)
        self.entries += n

    def take(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the given entries one after the other, and how many each has."""
        first = self.ends[entry]
        lengths = self.ends[entry + 1] - first
        at = np.repeat(first - (np.cumsum(lengths) - lengths), lengths)
        at += np.arange(len(at))
        return self.flat[at], lengths


class WordTable:
    """What ``learn`` makes of words, kept for the words that recur.

    ``learn`` gets a list of words and returns all their numbers and how many each
    word has.  Between calls at most ``max_words`` words are held: beyond, the half
    that was met most often stays.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], max_words: int = MAX_WORDS) -> None:
        self.learn, self.max_words = learn, max_words
        self.number: dict[str, int] = {}
        self.lists, self.hits = Lists(), np.empty(0, np.int64)

    def _shrink(self) -> None:
        words, stay = list(self.number), np.sort(np.argsort(-self.hits, kind="stable")[: self.max_words // 2])
        flat, lengths = self.lists.take(stay)
        self.number = {words[k]: i for i, k in enumerate(stay.tolist())}
        self.lists, self.hits = Lists(), self.hits[stay] // 2
        self.lists.extend(flat, lengths)

    def look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words of all texts in order, and how many each text has (null: none)."""
        if len(self.number) > self.max_words:
            self._shrink()
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = words.flatten().dictionary_encode()
        number = self.number
        found = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [w for w in found if w not in number]
        number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
        if new:
            self.lists.extend(*self.learn(new))
            self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        own = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        at = coded.indices.to_numpy()
        self.hits[own] += np.bincount(at, minlength=len(own))
        flat, lengths = self.lists.take(own[at])
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(pc.list_value_length(words).to_numpy())])]
        return flat, np.diff(ends)


class Encoder:
    """Encodes arrays of texts with a tokenizer file."""

    def __init__(self, path: str, max_words: int = MAX_WORDS) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        alone = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark_id = alone[0] if len(alone) == 1 else -1
        self.table = WordTable(self._learn, max_words)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order and the number of ids of each text (null: none)."""
        return self.table.look_up(texts)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode_batch_fast([f" {_MARK} ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(ids == self.mark_id)
        if len(cut) == len(words) - 1:
            return np.delete(ids, cut), np.diff(cut, prepend=-1, append=len(ids)) - 1
        # a word holds the mark, or it has no id of its own
        each = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each])


def encoder(path: str) -> Encoder:
    """The worker process's encoder for this file; it lasts from task to task."""
    return resident("table", ("encoder", path), lambda: Encoder(path))


def in_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``max_bytes`` at most (a longer value comes alone)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + max_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
