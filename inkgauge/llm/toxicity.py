"""Toxicity by cumulative-link ordinal regression over sparse word features.

Labels only say toxic or not. Severity has three ordered grades: 0 for documents labelled not
toxic; toxic ones are split, at the median, by how many of their features *tell*, that is
occur in toxic documents almost alone, into grade 1 and grade 2. The sample is dealt into two
halves, and what tells in one half grades the documents of the other, so no document's grade
comes from words that were counted in itself. The model is P(grade <= j) = logistic(t_j - w.x): one
weight per word, shared by all thresholds t_0 < t_1. It is fitted on a bounded sample of labelled
documents: features are counted and chosen by aggregation, and the fit sees the numbers of
the chosen ones only. Every document is scored whole, and its expected severity is the sum over
j of P(grade > j).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import SharedFolder, map_texts, read_table

#: Labelled documents that the model is fitted on at most: those whose hashed ids are smallest.
SAMPLE_ROWS = 20_000
#: Words in fewer sampled documents, or whose share among toxic and other documents differs by
#: fewer standard errors, are no features.
LEAST_DOCUMENTS, LEAST_Z = 5, 4.0
#: Telling words are toxic documents' in this share of the documents that hold them.
TELLING_SHARE = 0.9
GRADES = 3
#: Words whose features a worker keeps, and features that a task counts before it hands them on;
#: beyond, it starts anew.
TABLE_ENTRIES, COUNTED = 60_000, 50_000
#: Rows that are looked at and handed on together.
KEPT_ROWS = 256
#: Documents of this expected severity or more count as toxic.
THRESHOLD = 0.5
#: Weights of the squares and of the sizes of the word weights in what is minimised; words
#: whose weight stays below the least one are left out.
SQUARES, SIZES, LEAST_WEIGHT = 0.01, 0.1, 0.05
#: Beginnings of words of these lengths are features beside the words.
PREFIXES = range(4, 8)

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    """Distinct runs of letters, in lower case."""
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) >= k)]


def features_in(text: str) -> set[str]:
    return {f for w in words(text) for f in features_of(w)}


def copy_key(text: str) -> str:
    """The same for texts whose longer words have the same three smallest hashes.

    A text that was copied often would else make its every word a sign of its grade.
    """
    import xxhash

    found = words(text)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in found if len(w) >= 6], np.uint64)
    if not len(hashes):
        return " ".join(sorted(found))
    return " ".join(str(int((hashes * np.uint64(m)).min())) for m in (1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def graded(toxic: np.ndarray, half: np.ndarray, told: np.ndarray) -> np.ndarray:
    """0 for clean rows; toxic ones are 2 above the median count of their half, and 1 else."""
    grade = toxic.astype(np.int64)
    for h in (0, 1):
        mine = toxic & (half == h)
        if mine.any():
            grade[mine & (told > np.median(told[mine]))] = 2
    return grade


def objective(p: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, k: int) -> tuple[float, np.ndarray]:
    """The penalised negative log likelihood of the grades y, and its gradient.

    p holds k weights, the first threshold, and the logarithms of the gaps to the next ones;
    document rows[i] has feature cols[i].
    """
    score = np.bincount(rows, weights=p[cols], minlength=len(y))
    t = np.concatenate([p[k : k + 1], p[k] + np.cumsum(np.exp(p[k + 1 :]))])
    below = np.concatenate([np.zeros((len(y), 1)), _logistic(t[None, :] - score[:, None]), np.ones((len(y), 1))], axis=1)
    at = np.arange(len(y))
    high, low = below[at, y + 1], below[at, y]
    prob = np.maximum(high - low, 1e-12)
    d_high, d_low = high * (1 - high) / prob, low * (1 - low) / prob
    size = np.sqrt(p[:k] ** 2 + 1e-4)
    value = -np.log(prob).sum() + SQUARES / 2 * (p[:k] ** 2).sum() + SIZES * size.sum()
    g = np.zeros_like(p)
    g[:k] = np.bincount(cols, weights=(d_high - d_low)[rows], minlength=k) + SQUARES * p[:k] + SIZES * p[:k] / size
    g_t = np.array([-d_high[y == j].sum() + d_low[y == j + 1].sum() for j in range(len(t))])
    g[k] = g_t.sum()
    for j in range(1, len(t)):
        g[k + j] = g_t[j:].sum() * np.exp(p[k + j])
    return float(value), g


@dataclass
class OrdinalModel:
    """Weights by feature (a word, or a beginning with ``*``) and the ordered thresholds."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (20.0, 21.0)
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    @classmethod
    def fit(cls, names: Sequence[str], rows: np.ndarray, cols: np.ndarray, y: np.ndarray, steps: int = 600) -> OrdinalModel:
        """Penalised maximum likelihood by Adam; without toxic or without clean rows, the constant model."""
        if not (y > 0).any() or not (y == 0).any():
            return cls(thresholds=(20.0, 21.0) if not (y > 0).any() else (-21.0, 20.0))
        k = len(names)
        # Thresholds are t_0 and t_0 + exp(gaps), so they stay in order.
        share = np.clip([(y > j).mean() for j in range(GRADES - 1)], 1e-4, 1 - 1e-4)
        cut = np.log((1 - share) / share)
        p = np.concatenate([np.zeros(k), cut[:1], np.log(np.maximum(np.diff(cut), 1e-3))])
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, steps + 1):
            g = objective(p, rows, cols, y, k)[1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p = p - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            p[:k] = np.maximum(p[:k], 0)  # words only add severity
        t = np.concatenate([p[k : k + 1], p[k] + np.cumsum(np.exp(p[k + 1 :]))])
        return cls({w: float(x) for w, x in zip(names, p, strict=False) if abs(x) >= LEAST_WEIGHT}, tuple(map(float, t)))

    def above(self, text: str) -> list[float]:
        """P(grade > j) for each threshold."""
        found: set[str] = set()
        for w in words(text):
            x = self._known.get(w)
            if x is None:
                x = tuple(f for f in features_of(w) if f in self.weights)
                if len(self._known) >= TABLE_ENTRIES:
                    self._known.clear()
                self._known[w] = x
            if x:
                found.update(x)
        score = sum(self.weights[f] for f in sorted(found))  # in an order that no worker changes
        return [float(1 - _logistic(np.array(t - score))) for t in self.thresholds]

    def severity(self, text: str) -> float:
        """The expected grade, to six places."""
        return round(sum(self.above(text)), 6)


def toxic_labels(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and toxic (0 or 1) of the labelled documents; several labels of one document count by the worst."""
    known = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull())
    return known.groupBy(key).agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def sampled(docs: DataFrame, labels: DataFrame, rows: int, key: str, text_col: str) -> DataFrame:
    """key, half (0 or 1), toxic, text of at most ``rows`` labelled documents, one of each set of copies."""
    folder = SharedFolder(docs.sparkSession, "toxicity")
    chosen = toxic_labels(labels, key).orderBy(F.xxhash64(key), key).limit(rows)
    known = docs.select(docs[key].alias("key"), docs[text_col].alias("text"))
    joined = known.join(F.broadcast(chosen.withColumnRenamed(key, "key")), "key")  # at most ``rows`` rows
    texts = folder.save(joined, "texts")
    out = T.StructType([T.StructField("copy", T.StringType())])
    keyed = map_texts(texts, ["key", "toxic"], "text", out, lambda ts: {"copy": [copy_key(t) for t in ts]})
    # Rows that share a key can be more than ``rows``; they are one document here.
    one = keyed.groupBy("copy", "toxic").agg(F.min("key").alias("key")).groupBy("key").agg(F.max("toxic").alias("toxic"))
    first = texts.groupBy("key").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    half = F.pmod(F.xxhash64(F.lit("half"), "key"), F.lit(2)).cast("int")
    return folder.save(first.join(F.broadcast(one), "key").select("key", half.alias("half"), "toxic", "text"), "sample")


def feature_counts(sample: DataFrame) -> DataFrame:
    """feature and in how many documents it occurs, by half and label: clean0, toxic0, clean1, toxic1."""
    names = ["clean0", "toxic0", "clean1", "toxic1"]
    schema = T.StructType([T.StructField("feature", T.StringType()), *[T.StructField(n, T.LongType()) for n in names]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def told() -> pa.RecordBatch:
            columns = [pa.array(list(seen), pa.string()), *(pa.array(c, pa.int64()) for c in zip(*seen.values(), strict=True))]
            seen.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for half, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for f in features_in(text.as_py()):
                    seen.setdefault(f, [0, 0, 0, 0])[2 * half + toxic] += 1
                if len(seen) > COUNTED:
                    yield told()
        if seen:
            yield told()

    partial = sample.select("half", "toxic", "text").mapInArrow(run, schema)
    return partial.groupBy("feature").agg(*[F.sum(n).alias(n) for n in names])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits the model on at most ``rows`` labelled documents.

    To the driver come the features that pass the test of their counts (few beside the sample's
    words), and for each sampled document the numbers of those that it holds.
    """
    sample = sampled(docs, labels, rows, key, text_col)
    sizes = {(r["half"], r["toxic"]): r["count"] for r in sample.groupBy("half", "toxic").count().collect()}
    n1, n0 = (sum(n for (_, x), n in sizes.items() if x == toxic) for toxic in (1, 0))
    if not n1 or not n0:
        return OrdinalModel.fit([], np.zeros(0, np.int64), np.zeros(0, np.int64), np.array([1] * min(n1, 1) + [0] * min(n0, 1)))
    a, b = F.col("toxic0") + F.col("toxic1"), F.col("clean0") + F.col("clean1")
    p = (a + b) / float(n1 + n0)
    error = F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    kept = feature_counts(sample).where((a + b >= LEAST_DOCUMENTS) & ((a / float(n1) - b / float(n0)) / error >= LEAST_Z))
    chosen = sorted(kept.collect(), key=lambda r: r["feature"])
    names = [r["feature"] for r in chosen]
    telling = np.array([[r[f"toxic{h}"] > 0 and r[f"toxic{h}"] >= TELLING_SHARE * (r[f"toxic{h}"] + r[f"clean{h}"]) for h in (0, 1)] for r in chosen], bool).reshape(-1, 2)
    number = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def compute(texts: list[str]) -> dict[str, list]:
        held = [features_in(t) for t in texts]
        return {"at": [sorted(number.value[f] for f in h & number.value.keys()) for h in held]}

    out = T.StructType([T.StructField("at", T.ArrayType(T.IntegerType()))])
    found = sorted(map(tuple, map_texts(sample, ["key", "half", "toxic"], "text", out, compute).collect()), key=lambda r: r[0])
    half, toxic = np.array([r[1] for r in found]), np.array([r[2] for r in found], bool)
    at = np.repeat(np.arange(len(found)), [len(r[3]) for r in found])
    cols = np.array([i for r in found for i in r[3]], np.int64)
    # What tells in the other half grades a document.
    told = np.bincount(at, weights=telling[cols, 1 - half[at]].astype(float), minlength=len(found))
    return OrdinalModel.fit(names, at, cols, graded(toxic, half, told))


SCORES = T.StructType(
    [
        T.StructField("severity", T.DoubleType()),
        T.StructField("grade", T.IntegerType()),
        T.StructField("toxic", T.BooleanType()),
    ]
)


def score_toxicity(
    docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD, keys: Sequence[str] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """keys, severity (expected grade), grade (the likeliest), toxic (severity >= threshold).

    A row per input row. Null and empty texts have no words and the model's base severity.
    Repeated rows and null keys stay; other columns are not read. Narrow: no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample's words

    def compute(texts: list[str]) -> dict[str, list]:
        m = shared.value
        severity, grade = [], []
        for t in texts:
            over = m.above(t)
            p = [a - b for a, b in zip([1.0, *over], [*over, 0.0], strict=True)]
            severity.append(round(sum(over), 6))
            grade.append(max(range(len(p)), key=lambda j: (p[j], -j)))
        return {"severity": severity, "grade": grade, "toxic": [s >= threshold for s in severity]}

    return map_texts(docs, list(keys), text_col, SCORES, compute)


def drop_toxic(docs: DataFrame, model: OrdinalModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that do not count as toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, arrow = docs.columns.index(text_col), to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for begin in range(0, whole.num_rows, KEPT_ROWS):  # so that no second copy of a batch is made
                batch = whole.slice(begin, KEPT_ROWS)
                keep = [m.severity(t.as_py() or "") < threshold for t in batch.column(at)]
                kept = batch.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(kept.columns, arrow, strict=True)], schema=arrow)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, read_table(spark, sf_dir, "labels")))
