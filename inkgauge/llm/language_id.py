"""Language identification of mixed texts: scripts narrow the candidates, Viterbi labels the spans.

A word is a run of letters. Its script, told by code point ranges, leaves those languages
whose sampled words use that script; where none does, all stay. Each candidate gets a score, the
mean over the orders of its character n-grams' log probabilities (of one to four characters with the
word's edges, and of the word as a whole), against the best language's. Viterbi finds the labels of
a text's words with the largest sum of scores, less a penalty for each change of language between
neighbours; runs of one label are spans. All texts of a slice take their next word together, so
a step is one array operation. A text's language is the one that most letters are labelled with.

The n-grams are counted in Spark over a bounded sample of labelled documents, one of each set of
copies; to the driver comes the table of hashed n-grams by language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SharedFolder, map_texts, read_table

#: Documents that the table is counted on at most: different texts whose hashes are smallest.
SAMPLE_ROWS = 8_000
#: A language is learned when so large a share of the sampled documents has it; a language uses a
#: script when so large a share of its sampled words does.
LEAST_SHARE, SCRIPT_SHARE = 0.001, 0.01
#: Hashed n-grams, the largest order, what each n-gram counts besides its occurrences.
BUCKETS, ORDER, EXTRA = 1 << 16, 4, 0.5
#: The cost of a change of language, and the most that a word speaks against one.
SWITCH, WORST = 14.0, 12.0
#: Words whose scores a worker keeps; values that the labels of a part of a slice take at most.
TABLE_ENTRIES, PART_VALUES = 400_000, 8_000_000
#: The label of texts without a letter.
NONE = "und"

#: Code point ranges of scripts, first and last; letters elsewhere are of no script here.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}
_EDGES = np.array(sorted((a, b, i) for i, r in enumerate(SCRIPTS.values()) for a, b in r))
_WORD = re.compile(r"[^\W\d_]+")


def script_of(codes: np.ndarray) -> np.ndarray:
    """For each code point the number of its script, or that of none."""
    at = np.maximum(np.searchsorted(_EDGES[:, 0], codes, "right") - 1, 0)
    return np.where((codes >= _EDGES[at, 0]) & (codes <= _EDGES[at, 1]), _EDGES[at, 2], len(SCRIPTS))


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    low = text.lower()
    if len(low) != len(text) and not text.isascii():  # some letters become two, of which one is a mark
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(low)


def ngrams(many: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, and for whole words, which word an n-gram is of (in order) and its bucket."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in many).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in many], np.int64)
    owner = np.repeat(np.arange(len(many)), sizes)
    prime = np.uint64(0x9E3779B97F4A7C15)
    bucket = lambda h: ((h ^ (h >> np.uint64(29))) * prime >> np.uint64(40)).astype(np.int64) % BUCKETS
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, ORDER + 1):
        h = h[: len(codes) - n + 1] * prime + codes[n - 1 :]
        inside = owner[: len(h)] == owner[n - 1 :]
        inside &= (codes[: len(h)] > 3) if n == 1 else True
        yield owner[: len(h)][inside], bucket(h[inside] + np.uint64(n))
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(begins, sizes)
    power = np.cumprod(np.full(int(sizes.max()) if len(sizes) else 1, prime | np.uint64(1), np.uint64))
    yield np.arange(len(many)), bucket(np.add.reduceat(codes * power[place], begins) if len(many) else h[:0])


@dataclass
class LanguageModel:
    """Languages in order of their documents; log probabilities by bucket; which scripts each uses."""

    langs: list[str] = field(default_factory=list)
    table: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    uses: np.ndarray = field(default_factory=lambda: np.zeros((len(SCRIPTS) + 1, 0), bool))

    @classmethod
    def of_counts(cls, langs: Sequence[str], lang: np.ndarray, bucket: np.ndarray, count: np.ndarray) -> LanguageModel:
        """From counts by language (its number) and bucket; below 0 are words by script, -1 the first."""
        seen = np.zeros((BUCKETS, len(langs)))
        gram = bucket >= 0
        seen[bucket[gram], lang[gram]] = count[gram]
        table = np.log(seen + EXTRA) - np.log(seen.sum(axis=0) + EXTRA * BUCKETS)
        scripts = np.zeros((len(SCRIPTS) + 1, len(langs)))
        scripts[-1 - bucket[~gram], lang[~gram]] = count[~gram]
        uses = (scripts >= SCRIPT_SHARE * scripts.sum(axis=0)) & (scripts > 0)
        uses[:, :] |= ~uses.any(axis=1)[:, None]  # where none uses a script, all stay
        return cls(list(langs), table.astype(np.float32), uses)


class Scorer:
    """Scores of words by language; a worker keeps those of many words."""

    def __init__(self, model: LanguageModel):
        self.model, self.known = model, {}
        self.scores, self.letters = np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int64)

    def rows(self, many: list[str]) -> np.ndarray:
        """Where the scores and letters of these words lie."""
        fresh = set(many) - self.known.keys()
        if len(self.known) + len(fresh) > TABLE_ENTRIES and self.known:
            self.known.clear()
            self.scores, self.letters, fresh = self.scores[:0], self.letters[:0], set(many)
        if fresh:
            new = sorted(fresh)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.scores = np.concatenate([self.scores, self.of(new)])
            self.letters = np.concatenate([self.letters, [sum(map(str.isalpha, w)) for w in new]])
        return np.fromiter(map(self.known.__getitem__, many), np.int64, len(many))

    def of(self, many: list[str]) -> np.ndarray:
        """Scores of distinct words: 0 for the best language, less for others."""
        out, parts = np.zeros((len(many), len(self.model.langs)), np.float32), 0
        if not out.size:
            return out
        for owner, bucket in ngrams(many):
            step = max(1, PART_VALUES // out.shape[1])
            for a in range(0, len(owner), step):
                own, part = owner[a : a + step], self.model.table[bucket[a : a + step]]
                begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                out[own[begins]] += np.add.reduceat(part, begins, axis=0)
            parts += 1
        out /= parts
        firsts = np.array([ord(w[0]) for w in many])
        out = np.where(self.model.uses[script_of(firsts)], out, -np.inf)
        return np.maximum(out - out.max(axis=1, keepdims=True), np.where(np.isfinite(out), -WORST, -1000.0)).astype(np.float32)


def viterbi(score: np.ndarray, sizes: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each row of ``score``; the texts' rows follow each other, ``sizes`` tells how many each has.

    Ties keep the label, and else go to the first language.
    """
    n, k = score.shape
    order = np.argsort(-sizes, kind="stable")
    begins, lengths = (np.cumsum(sizes) - sizes)[order], sizes[order]
    stays, best = np.ones((n, k), bool), np.zeros(n, np.int32)
    longest = int(lengths[0]) if len(lengths) else 0
    live = np.searchsorted(-lengths, -np.arange(longest), "left")  # texts with more than so many words
    value = np.zeros((len(lengths), k))
    for t in range(longest):
        m = live[t]
        at, v = begins[:m] + t, value[:m]
        if t:
            top = v.argmax(axis=1)
            moved = v[np.arange(m), top] - switch
            stays[at], best[at] = v >= moved[:, None], top
            v = np.maximum(v, moved[:, None])
        value[:m] = v + score[at]
    out = np.zeros(n, np.int32)
    label = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        m = live[t]
        at = begins[:m] + t
        out[at] = label[:m]
        if t:
            label[:m] = np.where(stays[at, label[:m]], label[:m], best[at])
    return out


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
LABELS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))])


def labelled(texts: list[str], scorer: Scorer, switch: float = SWITCH) -> dict[str, list]:
    """Columns lang_pred, score and spans of some texts."""
    langs, out = scorer.model.langs, {"lang_pred": [], "score": [], "spans": []}
    part: list[list[str]] = []

    def flush() -> None:
        sizes = np.array([len(w) for w in part], np.int64)
        rows = scorer.rows([w for ws in part for w in ws])
        letters = scorer.letters[rows]
        label = viterbi(scorer.scores[rows], sizes, switch) if langs else np.zeros(0, np.int32)
        begin = 0
        for ws, size in zip(part, sizes.tolist(), strict=True):
            a, b = begin, begin + size
            begin = b
            text = texts[len(out["score"])]
            held = np.bincount(label[a:b], weights=letters[a:b], minlength=max(1, len(langs))) if langs else np.zeros(1)
            total, top = held.sum(), int(held.argmax())
            if not total:
                out["lang_pred"].append(NONE)
                out["score"].append(0.0)
                out["spans"].append([])
                continue
            out["lang_pred"].append(langs[top])
            out["score"].append(round(float(held[top] / total), 6))
            cuts = np.flatnonzero(np.r_[True, label[a + 1 : b] != label[a : b - 1]])
            if len(cuts) == 1:
                places = [(_WORD.search(text).start(), len(text) - _WORD.search(text[::-1]).start())]
            else:
                found = [m.span() for m in _WORD.finditer(text)]
                places = [(found[x][0], found[y - 1][1]) for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), size], strict=True)]
            out["spans"].append([{"start": x, "end": y, "lang": langs[int(label[a + c])]} for c, (x, y) in zip(cuts.tolist(), places, strict=True)])
        part.clear()

    n, most = 0, PART_VALUES // max(1, len(langs))
    for text in texts:
        ws = words(text)
        if part and n + len(ws) > most:
            flush()
            n = 0
        part.append(ws)
        n += len(ws)
    flush()
    return out


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Counts n-grams by language in at most ``rows`` documents with a language.

    One of each set of equal texts with one language counts. Without any there is no language.
    """
    folder = SharedFolder(docs.sparkSession, "language-id")
    known = docs.select(docs[key].alias("key"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("key IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    known = known.withColumn("h", F.xxhash64("text"))
    chosen = known.groupBy("h", "lang").agg(F.min("key").alias("key")).orderBy("h", "lang").limit(rows)
    sample = folder.save(known.join(F.broadcast(chosen), ["h", "lang", "key"]).select("h", "lang", "text"), "sample")  # chosen: at most ``rows`` rows
    sizes = sample.groupBy("lang").agg(F.count_distinct("h").alias("n")).collect()  # at most ``rows``
    total = sum(r["n"] for r in sizes)
    langs = [r["lang"] for r in sorted(sizes, key=lambda r: (-r["n"], r["lang"])) if r["n"] >= LEAST_SHARE * total]
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
    arrow, wanted = to_arrow_schema(schema), frozenset(langs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if lang in wanted:
                    held.setdefault(lang, []).extend(words(text.as_py()))
            for lang, ws in held.items():
                for a in range(0, len(ws), 1 << 18):
                    part = ws[a : a + (1 << 18)]
                    buckets = [b for _, b in ngrams(part)] + [-1 - script_of(np.array([ord(w[0]) for w in part]))]
                    bucket, n = np.unique(np.concatenate(buckets), return_counts=True)
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip((pa.array([lang] * len(n)), pa.array(bucket), pa.array(n)), arrow, strict=True)], schema=arrow)

    counts = sample.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # BUCKETS rows a language at most
    folder.drop()
    number = {x: i for i, x in enumerate(langs)}
    lang = np.array([number[x] for x in got["lang"].to_pylist()], np.int64)
    return LanguageModel.of_counts(langs, lang, got["bucket"].to_numpy().astype(np.int64), got["n"].to_numpy())


def label_languages(docs: DataFrame, model: LanguageModel, keys: Sequence[str] = ("doc_id",), text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """keys, lang_pred, score, spans (start, end: code points; lang): a row per input row, narrow.

    lang_pred is the language of most letters, ties to the one with more sampled documents; score is their
    share. Null and empty texts, and such without a letter, are ``und`` with score 0 and no spans, as
    all texts are for a model without languages. Repeated rows, null keys stay; other columns are not read.
    Very long texts are labelled whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows
    held: list[Scorer] = []

    def compute(texts: list[str]) -> dict[str, list]:
        if not held:
            held.append(Scorer(shared.value))
        return labelled(texts, held[0], switch)

    return map_texts(docs, list(keys), text_col, LABELS, compute)


def held_out(key: Column) -> Column:
    """Whether the CRC-32 of a key as text leaves the remainder 1 by 3; false for null keys."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = label_languages(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
