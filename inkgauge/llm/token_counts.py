"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens lie one after another in a flat array of symbol ids, with the number of their
sequence beside each symbol. In a round every sequence finds its lowest-ranked adjacent
pair and merges all its occurrences at once; sequences without a mergeable pair leave.
What is left of each sequence when it leaves is its token count.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, read_table, tokenizer_path

#: Distinct words whose counts a worker keeps; beyond, it starts anew.
TABLE_ENTRIES = 400_000
#: Symbols merged together in one array at most (one sequence at least).
MERGE_SYMBOLS = 2_000_000
_NONE = np.iinfo(np.int32).max
#: Separators that str.split cuts at, though they are no white space to the tokenizer.
_NOT_SPACE = "\x1c\x1d\x1e\x1f"


class RankMerger:
    """The merge table of a byte-level BPE vocabulary in arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: Sequence, word_end: str):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocabulary[a] << 32 | vocabulary[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int64)
        self.vocabulary, self.word_end = vocabulary, word_end

    def symbols(self, word: str) -> list[int]:
        ids = [self.vocabulary[c] for c in word[:-1]]
        return [*ids, self.vocabulary[word[-1] + self.word_end]]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def counts(self, sequences: Sequence[Sequence[int]]) -> np.ndarray:
        """How many symbols survive in each sequence."""
        lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
        symbol = np.fromiter((s for q in sequences for s in q), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(sequences)), lengths)
        result = lengths.copy()
        while len(symbol) > 1:
            same = owner[1:] == owner[:-1]
            rank = np.where(same, self._rank(symbol[:-1], symbol[1:]), _NONE)
            starts = np.flatnonzero(np.r_[True, ~same])
            lowest = np.minimum.reduceat(np.r_[rank, _NONE], starts)
            size = np.diff(np.r_[starts, len(symbol)])
            here = np.repeat(lowest, size)[:-1]
            chosen = (rank == here) & (rank != _NONE)
            if not chosen.any():
                break
            # In a row of equal symbols, pairs overlap: every second one from the left merges.
            place = np.arange(len(chosen))
            first = np.maximum.accumulate(np.where(chosen & ~np.r_[False, chosen[:-1]], place, -1))
            chosen &= (place - first) % 2 == 0
            at = np.flatnonzero(chosen)
            symbol[at] = self.made[rank[at]]
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            # Sequences that merged nothing are finished; they leave the arrays.
            keep &= np.repeat(lowest != _NONE, size)
            np.subtract.at(result, owner[at], 1)
            symbol, owner = symbol[keep], owner[keep]
        return result


class TokenCounter:
    """Counts tokens as the library's tokenizer file would give them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merger = RankMerger(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}

    def _learn(self, chunks: set[str]) -> None:
        """Counts for chunks that the table lacks: pre-tokenized by the library, merged here."""
        if len(self.known) + len(chunks) > TABLE_ENTRIES:
            self.known.clear()
            self.words.clear()
        split: dict[str, list[str]] = {}
        for chunk in chunks:
            plain = chunk.lower() if chunk.isascii() else self.library.normalizer.normalize_str(chunk)
            split[chunk] = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
        new = [w for w in {w for ws in split.values() for w in ws} if w not in self.words]
        at = 0
        while at < len(new):
            end, size = at, 0
            while end < len(new) and (end == at or size + len(new[end]) <= MERGE_SYMBOLS):
                size += len(new[end])
                end += 1
            made = self.merger.counts([self.merger.symbols(w) for w in new[at:end]])
            self.words.update(zip(new[at:end], made.tolist(), strict=True))
            at = end
        for chunk, ws in split.items():
            self.known[chunk] = sum(self.words[w] for w in ws)

    def _parts(self, text: str) -> tuple[int, list[str]]:
        """The special tokens in a text, and the texts between them."""
        parts, specials = [text], 0
        for s in self.special:
            if s in text:
                parts = [y for x in parts for y in x.split(s)]
        specials = len(parts) - 1
        return specials, parts

    def count(self, texts: Sequence[str]) -> list[int]:
        cut: list[tuple[int, list[str]] | None] = []
        for text in texts:
            if any(c in text for c in _NOT_SPACE):
                cut.append(None)
                continue
            n, parts = self._parts(text)
            cut.append((n, [c for p in parts for c in p.split()]))
        new = {c for x in cut if x for c in x[1]} - self.known.keys()
        if len(new) > TABLE_ENTRIES // 2:  # a slice with very many distinct words: a text at a time
            if len(texts) > 1:
                return [n for t in texts for n in self.count([t])]
        if new:
            held = len(self.known)
            self._learn(new)
            if len(self.known) < held + len(new):  # the table was started anew
                self._learn({c for x in cut if x for c in x[1]} - self.known.keys())
        get = self.known.__getitem__
        out = []
        for text, x in zip(texts, cut, strict=True):
            if x is None:
                out.append(len(self.library.encode(text, add_special_tokens=False).ids))
            else:
                out.append(x[0] + sum(map(get, x[1])))
        return out


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    limit: int = 2048,
    key: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit): a row per input row.

    Null and empty texts count 0 bytes and 0 tokens. Repeated rows and null keys stay as they
    are; other columns are not read. Narrow: no shuffle.
    """

    def compute(texts: list[str]) -> dict[str, list]:
        n = counter(tokenizer_path(tokenizer)).count(texts)
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    out = T.StructType(
        [
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )
    return map_texts(docs, [key], text_col, out, compute)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
