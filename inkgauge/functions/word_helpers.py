"""Small helpers on Arrow columns, in place of patterns and lambdas. Languages that are not measured count as English."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The letters that syllables are counted of.
LETTERS = {"en": "a-z", "es": "a-záéíóúüñàèìòùç", "pt": "a-zàáâãéêíóôõúüç", "fr": "a-zàâäéèêëîïôöùûüÿœæç"}
_OTHER = {c: re.compile(f"[^{letters}]") for c, letters in LETTERS.items()}
_V, _STRONG = "aeiouáéíóúüàèìòù", "aeoáéóàè"
_BEATS = {
    "en": re.compile("[aeiouy]+"),
    "es": re.compile(f"(?<![{_V}])[{_V}]|(?<=[{_STRONG}])[{_STRONG}]|(?<=[{_V}])[íú]|(?<=[íú])[{_V}]"),
    "pt": re.compile("[aeiouáéíóúâêîôûãõàèìòù]+"),
    "fr": re.compile("[aeiouyàâäéèêëîïôöùûüœæ]+"),
}
_SILENT = re.compile("(?:[^laeiouy]es|ed|[^laeiouy]e)$")


@lru_cache(1 << 16)
def syllables_of(word: str, code: str) -> int:
    """Syllables of a word in lower case; a worker remembers the words that it met last."""
    word = _OTHER[code].sub("", word)
    if not word:
        return 0
    if code == "en":
        if len(word) <= 3:
            return 1
        word = re.sub("^y", "", _SILENT.sub("", word))
    elif code == "fr":
        word = re.sub("e$", "", re.sub("es$", "", re.sub("(?<!m)ent$", "", word)))
    return max(1, len(_BEATS[code].findall(word)))


def _syllables(words: pa.Array, code: pa.Array) -> pa.Array:
    sums = []
    for text, c in zip(words, code.to_pylist(), strict=True):
        text = text.as_py()
        c = c if c in LETTERS else "en"
        sums.append(None if text is None else sum([syllables_of(w, c) for w in text.split(" ") if w]))
    return pa.array(sums, pa.int32())


def syllables(words: Column, code: Column) -> Column:
    """The sum over words in lower case that spaces part; null for null."""
    return F.arrow_udf(_syllables, "int")(words, code)


def _helper(make, kind: pa.DataType, ddl: str, *columns: Column) -> Column:
    """A function of the values of one or two columns of a row, null where it gives None."""

    def one(a: pa.Array) -> pa.Array:
        return pa.array([make(x) for x in a.to_pylist()], kind)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([make(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    return F.arrow_udf(one if len(columns) == 1 else two, ddl)(*columns)


def told(sents: Column) -> Column:
    """The words of a document's sentences: a line for each sentence, spaces between words."""
    return F.array_join(F.transform(sents, lambda x: F.array_join(x["tok"], " ")), "\n")


def markers(low: Column, code: Column, kinds: dict[str, dict[str, list[str]]]) -> Column:
    """A struct of kinds: those of the language's markers that a text holds, in their order; null for no text."""

    def held(text: str | None, c: str | None) -> dict | None:
        if text is None:
            return None
        return {k: [m for m in lists[c if c in lists else "en"] if m in text] for k, lists in kinds.items()}

    kind = pa.struct([(k, pa.list_(pa.string())) for k in kinds])
    return _helper(held, kind, f"struct<{','.join(f'{k}: array<string>' for k in kinds)}>", low, code)


def counts(text: Column, patterns: dict[str, str]) -> Column:
    """A struct of how often patterns without anchors and looks around them occur in a text; null for no text."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pc.count_substring_regex(texts, p).cast(pa.int64()) for p in patterns.values()], list(patterns))

    return F.arrow_udf(run, f"struct<{','.join(f'`{k}`: long' for k in patterns)}>")(text)


def fits(text: Column, code: Column, patterns: dict[str, str]) -> Column:
    """Whether the language's pattern, which does not look around, fits somewhere in a text; null for no text."""

    def run(texts: pa.Array, codes: pa.Array) -> pa.Array:
        codes = codes.to_numpy(zero_copy_only=False)
        made, told_ = np.zeros(len(texts), bool), np.zeros(len(texts), bool)
        for c, pattern in patterns.items():
            rows = np.flatnonzero((codes == c) if c != "en" else ~np.isin(codes.astype(str), [x for x in patterns if x != "en"]))
            found = pc.match_substring_regex(texts.take(pa.array(rows)), pattern)
            made[rows], told_[rows] = found.fill_null(False).to_numpy(zero_copy_only=False), found.is_valid().to_numpy(zero_copy_only=False)
        return pa.array(made, mask=~told_)

    return F.arrow_udf(run, "boolean")(text, code)


def in_lists(words: Column, lists: dict[str, list[str]]) -> Column:
    """A struct of how many of the words that spaces part are in each list."""
    owners: dict[str, list[str]] = {}
    for k, listed in lists.items():
        for w in set(listed):
            owners.setdefault(w, []).append(k)

    def count(line: str) -> dict[str, int]:
        found = dict.fromkeys(lists, 0)
        for w, n in Counter(line.split(" ")).items():
            for k in owners.get(w, ()):
                found[k] += n
        return found

    return _helper(count, pa.struct([(k, pa.int64()) for k in lists]), f"struct<{','.join(f'`{k}`: long' for k in lists)}>", words)


def broadcast_bits(bits: DataFrame):
    """A table of (code, word, bits) that fits a broadcast, as {code: {word: bits}} in one; of repeated words the most bits count."""
    found: dict[str, dict[str, float]] = {}
    for code, word, n in bits.groupBy("code", "word").agg(F.max("bits")).toLocalIterator():
        found.setdefault(code, {})[word] = n
    return bits.sparkSession.sparkContext.broadcast(found)


def mean_bits(words: Column, code: Column, known, guessed: list[float]) -> Column:
    """The mean bits of words that spaces part: those of ``broadcast_bits``, of others by their length, the last for all that are longer."""

    def mean(line: str, c: str) -> float:
        own, found = known.value.get(c, {}), line.split(" ")
        last = len(guessed) - 1
        return sum([b if (b := own.get(w)) is not None else guessed[min(len(w), last)] for w in found]) / len(found)

    return _helper(mean, pa.float64(), "double", words, code)


def word_sums(text: Column, code: Column, lists: dict[str, dict[str, set[str]]], known, slope_ranks: int) -> Column:
    """Sums over a document's words (``told``): how many, distinct, squares, in lists and outside ``broadcast_bits``; spread is the entropy of lengths up to 16.

    points, sx, sxx, sy, sxy are those of the line through logarithms of rank and frequency, up to so many ranks.
    """
    names = ["words", "types", "once", "squares", *lists, "oov", "points"]
    logs = [math.log(r) for r in range(1, slope_ranks + 1)]
    one, two = ([*accumulate(terms, initial=0.0)] for terms in (logs, [x * x for x in logs]))

    def sums(told_: str, c: str) -> dict:
        n = Counter(told_.split())
        own, sizes = known.value.get(c, {}), [0] * 16
        for w, f in n.items():
            sizes[min(len(w), 16) - 1] += f
        out = {k: sum([n[w] for w in words[c] if w in n]) for k, words in lists.items()}
        total = n.total()
        out |= {"words": total, "types": len(n), "oov": total - sum([f for w, f in n.items() if w in own])}
        spread = -sum([f / total * math.log2(f / total) for f in sizes if f])
        same = Counter(n.values())
        out |= {"once": same[1], "squares": sum([f * f * k for f, k in same.items()])}
        a = points = 0
        sx = sxx = sy = sxy = 0.0
        for f in sorted(same, reverse=True):
            b, y = min(a + same[f], slope_ranks), math.log(f)
            points, sx, sxx, sy, sxy = points + b - a, sx + one[b] - one[a], sxx + two[b] - two[a], sy + (b - a) * y, sxy + (one[b] - one[a]) * y
            a = b
        return out | {"spread": spread, "points": points, "sx": sx, "sxx": sxx, "sy": sy, "sxy": sxy}

    floats = ["spread", "sx", "sxx", "sy", "sxy"]
    kind = pa.struct([(k, pa.int64()) for k in names] + [(k, pa.float64()) for k in floats])
    ddl = [f"{k}: long" for k in names] + [f"{k}: double" for k in floats]
    return _helper(sums, kind, f"struct<{','.join(ddl)}>", text, code)


def _runs(told_: str, size: int) -> Counter:
    """Runs of so many words within sentences, in the order of their first places."""
    n: Counter = Counter()
    for line in told_.split("\n"):
        words = line.split(" ")
        n.update(zip(*[words[i:] for i in range(size)], strict=False))
    return n


def repeated_share(text: Column, size: int = 5) -> Column:
    """The share of runs of words (``told``) that occur more than once; null without any."""

    def share(told_: str) -> float | None:
        n = _runs(told_, size)
        return sum([c for c in n.values() if c > 1]) / n.total() if n else None

    return _helper(share, pa.float64(), "double", text)


def repeated_runs(text: Column, size: int = 5, most: int = 8) -> Column:
    """An array of gram, c: the commonest runs of words that occur more than once, ties by first place."""

    def top(told_: str) -> list[dict]:
        found = sorted([x for x in _runs(told_, size).items() if x[1] > 1], key=lambda x: -x[1])
        return [{"gram": " ".join(words), "c": c} for words, c in found[:most]]

    return _helper(top, pa.list_(pa.struct([("gram", pa.string()), ("c", pa.int64())])), "array<struct<gram: string, c: long>>", text)


def moving_ratio(text: Column, window: int, sample: tuple[int, int] | None = None) -> Column:
    """The share of distinct words in windows that slide over all of a document's words (``told``).

    A word opens those windows in which it is the first of its kind: a number that follows from its own place and the last one's.
    With a ``sample`` (sentences, words) every few sentences count of documents of over so many, as long as no more than so many
    words lie before them.
    """

    def ratio(told_: str) -> float | None:
        lines, words = told_.split("\n"), []
        for line in lines[:: max(1, len(lines) // sample[0]) if sample else 1]:
            if sample and len(words) > sample[1]:
                break
            words += line.split(" ")
        n = len(words)
        if n < window:
            return len(set(words)) / n
        opened, last = 0, {}
        for p, w in enumerate(words):
            opened += max(0, min(p, n - window) - max(p - window + 1, last.get(w, -1) + 1, 0) + 1)
            last[w] = p
        return opened / window / (n - window + 1)

    return _helper(ratio, pa.float64(), "double", text)
