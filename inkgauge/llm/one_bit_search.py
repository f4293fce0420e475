"""Nearest neighbours by randomly rotated one-bit codes, with error bounds and reranking.

Vectors are gathered in blocks. A block's vectors lose the block's mean, are rotated by a
random orthogonal matrix, and keep one sign bit a dimension, packed, with scalars: the
residual's length, and the inner product of the unit residual with its code. The rotated query's
inner product with a unit residual is estimated by that with the signs that a code holds,
unpacked for a slice of a block and multiplied with all queries at once, divided by that scalar;
the estimate's error is bounded with a confidence that the parameter ``sigmas`` sets. Vectors
whose upper bound reaches the twentieth exact score found so far are reranked in double
precision: by a product of the queries with those that some query wants, and those that come
near the twentieth score exactly, component by component.

Every row is indexed. Query blocks meet vector blocks in a join on block numbers; what
travels is blocks, not pairs, and a task keeps the best ``k`` of each query of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table

#: Rows of a vector block and of a query block at most, and values in a block at most.
BLOCK_ROWS, QUERY_ROWS, BLOCK_VALUES = 4096, 2048, 1 << 18
SEED = 7


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def valid(embedding: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & ~bad & F.exists(embedding, lambda x: x != 0)


class CodeBlock:
    """The codes of a block of vectors (rows of ``x``, doubles)."""

    def __init__(self, x: np.ndarray, turn: np.ndarray):
        self.dim = x.shape[1]
        self.mean = x.mean(axis=0)
        rest = (x - self.mean) @ turn
        self.length = np.linalg.norm(rest, axis=1)
        unit = rest / np.maximum(self.length, 1e-300)[:, None]
        bits = unit > 0
        words = -(-self.dim // 64)
        packed = np.packbits(np.pad(bits, ((0, 0), (0, words * 64 - self.dim))), axis=1, bitorder="little")
        self.codes = packed.view(np.uint64)  # rows x words
        self.ones = bits.sum(axis=1)
        self.match = np.maximum(np.abs(unit).sum(axis=1) / np.sqrt(self.dim), 1e-9)  # <code, unit residual>

    def signs(self, at: slice) -> np.ndarray:
        """The codes of some vectors, a column each, as signs divided by the root of the dimension."""
        bits = np.unpackbits(self.codes[at].view(np.uint8), axis=1, bitorder="little")[:, : self.dim]
        return ((bits.astype(np.float32) * 2 - 1) / np.float32(np.sqrt(self.dim))).T

    def estimates(self, q: np.ndarray, turn: np.ndarray, sigmas: float, at: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of some vectors with queries (rows of ``q``) and the bound of their errors."""
        turned = q @ turn
        scale = (self.length[at] / self.match[at]).astype(np.float32)
        estimate = turned.astype(np.float32) @ self.signs(at)
        estimate *= scale
        estimate += (q @ self.mean).astype(np.float32)[:, None]
        size = np.linalg.norm(turned, axis=1).astype(np.float32)[:, None]
        spread = np.sqrt(np.maximum(1 - self.match[at] ** 2, 0)) / self.match[at] / np.sqrt(max(self.dim - 1, 1))
        # Single precision adds what its rounding can, at most, to the bound.
        rounding = 4e-7 * self.dim * (self.length[at] / self.match[at] + np.linalg.norm(self.mean)) + 1e-9
        return estimate, size * (sigmas * spread * self.length[at] + rounding).astype(np.float32)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from the first component to the last."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class Best:
    """The best k candidates of each query of a block so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """A vec_id counts once, with its best score."""
        if not len(query):
            return
        rows = np.unique(query)
        q = np.concatenate([query, np.repeat(rows, self.k)])
        i = np.concatenate([ids, self.id[rows].ravel()])
        s = np.concatenate([score, self.score[rows].ravel()])
        order = np.lexsort((-s, i, q))
        q, i, s = q[order], i[order], s[order]
        fresh = np.r_[True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])]
        q, i, s = q[fresh], i[fresh], s[fresh]
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.k
        self.score[rows], self.id[rows] = -np.inf, np.iinfo(np.int64).max
        self.score[q[keep], place[keep]], self.id[q[keep], place[keep]] = s[keep], i[keep]


def search_block(block: CodeBlock, x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, best: Best, turn: np.ndarray, sigmas: float) -> None:
    """Brings the vectors of one block into the best lists of the queries."""
    step = max(1, (1 << 21) // max(1, len(x)))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        estimate, error = block.estimates(q[part], turn, sigmas)
        by_id = np.argsort(ids, kind="stable")
        low, high = np.searchsorted(ids[by_id], q_ids[part], "left"), np.searchsorted(ids[by_id], q_ids[part], "right")
        for i in np.flatnonzero(high > low).tolist():  # a query is no candidate of its own
            estimate[i, by_id[low[i] : high[i]]] = -np.inf
        if not np.isfinite(best.score[part, -1]).all():
            # The first block of a query: the best by estimate give it a score to reach.
            first = min(best.k, len(x))
            top = np.argpartition(-estimate, first - 1, axis=1)[:, :first]
            rows, cols = np.repeat(np.arange(len(top)), first), top.ravel()
            ok = np.isfinite(estimate[rows, cols])
            best.add(at + rows[ok], ids[cols[ok]], exact_scores(q[at + rows[ok]], x[cols[ok]]))
        estimate += error
        wanted = estimate >= (best.score[part, -1] - 1e-6 * np.abs(best.score[part, -1]))[:, None].astype(np.float32)
        wanted &= np.isfinite(estimate)
        some = np.flatnonzero(wanted.any(axis=0))
        for cut in range(0, len(some), 1 << 12):
            cols = some[cut : cut + (1 << 12)]
            score = q[part] @ x[cols].T
            slack = 1e-9 * (np.abs(score) + np.abs(best.score[part, -1])[:, None] + 1)
            r, c = np.nonzero(wanted[:, cols] & ~(score + slack < best.score[part, -1][:, None]))
            for few in range(0, len(r), 1 << 18):
                i, j = at + r[few : few + (1 << 18)], cols[c[few : few + (1 << 18)]]
                best.add(i, ids[j], exact_scores(q[i], x[j]))


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """Rows (id, x) gathered in blocks as they come: a number, dim, ids and vectors as bytes.

    A block's number is made of its partition's and its place there, so a task that runs again
    makes the same blocks. Vectors keep the precision of their column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("at", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())])
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            begins = np.r_[0, np.cumsum(sizes)[:-1]]
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for dim in np.unique(sizes).tolist():
                which = np.flatnonzero(sizes == dim)
                most = max(1, min(rows, BLOCK_VALUES // dim))
                for begin in range(0, len(which), most):
                    part = which[begin : begin + most]
                    x = flat[begins[part][:, None] + np.arange(dim)]
                    columns = [pa.array([v], f.type) for v, f in zip((at, dim, ids[part].tobytes(), x.tobytes()), schema, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)
                    at += 1

    return df.select("id", "x").mapInArrow(run, "at long, dim int, ids binary, x binary")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    sigmas: float = 4.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest rows found, by inner product.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without
    an id, take no part; vectors meet those of their own length only. A query excludes rows of
    its own id. Repeated rows count once; repeated ids with different vectors are ranked by
    their best score. Ties go to the smaller id. Fewer candidates than k give fewer rows. Other
    columns are not read. A task holds a batch of blocks, and the lists of 32 query blocks.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("x"), is_query.alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & valid(F.col("x")))
    kind = np.float32 if vectors.schema[vector_col].dataType.elementType.typeName() == "float" else np.float64
    counted = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).first()
    # So few tasks gather the queries that their blocks are full, and so many slices meet them
    # that a slice has about one block of vectors, as far as there are partitions.
    few = max(1, -(-counted["asking"] // QUERY_ROWS))
    slices = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted["n"] // BLOCK_ROWS)))
    queries = _blocks(rows.where("asks").repartition(few), QUERY_ROWS)
    left = _blocks(rows, BLOCK_ROWS).select(
        F.col("at").alias("v_at"), "dim", F.pmod(F.xxhash64("at"), F.lit(slices)).cast("int").alias("slice"),
        F.col("ids").alias("v_ids"), F.col("x").alias("v_x"),
    )
    right = queries.select(
        F.col("at").alias("q_at"), "dim", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        F.col("ids").alias("q_ids"), F.col("x").alias("q_x"),
    )
    met = left.join(right, ["dim", "slice"]).select("q_at", "v_at", "dim", "q_ids", "q_x", "v_ids", "v_x")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn, coded, held = None, (None, None), {}

        def told(at: int) -> pd.DataFrame:
            q_ids, best = held.pop(at)
            full = best.id != np.iinfo(np.int64).max
            return pd.DataFrame({"query_id": np.repeat(q_ids, k).reshape(-1, k)[full], "vec_id": best.id[full], "score": best.score[full]})

        for frame in frames:
            for r in frame.itertuples(index=False):
                if turn is None or turn.shape[0] != r.dim:
                    turn = rotation(r.dim)
                x = np.frombuffer(r.v_x, kind).reshape(-1, r.dim).astype(np.float64)
                if coded[0] != r.v_at:
                    coded = (r.v_at, CodeBlock(x, turn))
                q, q_ids = np.frombuffer(r.q_x, kind).reshape(-1, r.dim).astype(np.float64), np.frombuffer(r.q_ids, np.int64)
                if r.q_at not in held:
                    if len(held) >= 32:
                        yield told(next(iter(held)))
                    held[r.q_at] = (q_ids, Best(len(q), k))
                search_block(coded[1], x, np.frombuffer(r.v_ids, np.int64), q, q_ids, held[r.q_at][1], turn, sigmas)
        for at in list(held):
            yield told(at)

    found = met.mapInPandas(run, "query_id long, vec_id long, score double")
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


OP8_SQL = """
WITH ok AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, max(list_inner_product(q.v, c.v)) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
