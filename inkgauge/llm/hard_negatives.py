"""Hard negatives by a pivot table: exact inner-product windows without scoring every pair.

Vectors become integers, floor(scale * x). A row x with a largest square length M is augmented by
sqrt(M - |x|^2), an anchor q by 0; then |q' - x'|^2 = |q|^2 + M - 2 q.x, so the inner product
falls with the Euclidean distance. The pivot table holds each row's distances to a few pivots, rows
of a bounded sample that lie far from each other. For an anchor the triangle inequality
over these brackets every row's score: blocks of rows, gathered by their nearest pivot, and
then rows, whose bracket cannot reach what is wanted are left out, and survivors are
checked exactly in whole numbers.

Two searches use the table: each anchor's nearest rows of its label, and, between a lower and an upper
share of each of their scores, the nearest rows of other labels. Anchor blocks meet row
blocks in a join on numbers of slices; a task keeps the best lists of its anchors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import SharedFolder, read_table

#: Rows of a block, of a block of anchors, and values in either at most.
BLOCK_ROWS, ANCHOR_ROWS, BLOCK_VALUES = 4096, 512, 1 << 18
#: Pivots, and rows of the sample that they are taken from (those of the smallest hashed ids).
PIVOTS, SAMPLE_ROWS = 16, 2048
#: Whole components beyond this take their row out, so that scores stay whole numbers of 64 bits.
MOST = 1 << 27
#: What rounding can do to brackets, as a share of the largest square length.
SLACK = 1e-4
#: Anchor blocks whose lists a task holds.
HELD = 32
NONE = np.iinfo(np.int64).min


class Pivots:
    """Pivots of the vectors of one length: rows of ``points``; ``square``: the largest square length of all rows."""

    def __init__(self, sample: np.ndarray, square: float, n: int = PIVOTS):
        self.square = max(float(square), 1.0)
        x = np.unique(sample, axis=0).astype(np.float64)
        chosen, least = [0] if len(x) else [], np.full(len(x), np.inf)
        while 0 < len(chosen) < min(n, len(x)):
            last = x[chosen[-1]]
            gap = 2 * self.square - 2 * (x @ last + self._rest(x) * self._rest(last[None])[0])
            least = np.minimum(least, gap)
            chosen.append(int(least.argmax()))
        self.points = x[chosen]

    def _rest(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        x = x.astype(np.float64)
        return np.sqrt(np.maximum(2 * self.square - 2 * (x @ self.points.T + self._rest(x)[:, None] * self._rest(self.points)), 0)).astype(np.float32)

    def of_anchors(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """|q|^2 + M, and distances of anchors to the pivots."""
        q = q.astype(np.float64)
        size = (q * q).sum(axis=1) + self.square
        return size, np.sqrt(np.maximum(size[:, None] - 2 * q @ self.points.T, 0)).astype(np.float32)

    def brackets(self, size: np.ndarray, far: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For anchors (``size``, ``far``) and rows at distances ``low`` to ``high`` of the pivots, the least and the largest score."""
        near, most = np.zeros((len(far), len(low)), np.float32), np.full((len(far), len(low)), np.inf, np.float32)
        for i in range(len(self.points)):
            np.maximum(near, far[:, i, None] - high[None, :, i], out=near)
            np.maximum(near, low[None, :, i] - far[:, i, None], out=near)
            np.minimum(most, far[:, i, None] + high[None, :, i], out=most)
        slack = SLACK * (self.square + size)[:, None]
        return (size[:, None] - most.astype(np.float64) ** 2) / 2 - slack, (size[:, None] - near.astype(np.float64) ** 2) / 2 + slack


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers."""
    if not len(q) or not len(x):
        return np.zeros((len(q), len(x)), np.int64)
    if np.abs(q).max() * np.abs(x).max() * q.shape[1] < 1 << 52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


class Lists:
    """For each of n searches the best k (score, id) so far: the largest scores, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of the searches ``rows`` with the ids of a block, in the order of ids; NONE is not wanted. An id counts once."""
        if not score.size:
            return
        begins = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        if len(begins) < len(ids):
            score, ids = np.maximum.reduceat(score, begins, axis=1), ids[begins]
        k = min(self.k, score.shape[1])
        least = np.maximum(np.partition(score, -k, axis=1)[:, -k], NONE + 1)[:, None]
        tie = score == least
        i, c = np.nonzero((score > least) | (tie & (np.cumsum(tie, axis=1) <= k)))
        better = score[i, c] >= self.score[rows[i], -1]
        i, c = i[better], c[better]
        if not len(i):
            return
        some = np.unique(i)
        at = np.concatenate([rows[i], np.repeat(rows[some], self.k)])
        s = np.concatenate([score[i, c], self.score[rows[some]].ravel()])
        d = np.concatenate([ids[c], self.id[rows[some]].ravel()])
        order = np.lexsort((~s, d, at))  # ~s falls as s grows, without overflow
        at, s, d = at[order], s[order], d[order]
        first = np.r_[True, (at[1:] != at[:-1]) | (d[1:] != d[:-1])]
        at, s, d = at[first], s[first], d[first]
        order = np.lexsort((d, ~s, at))
        at, s, d = at[order], s[order], d[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.k
        self.score[rows[some]], self.id[rows[some]] = NONE, np.iinfo(np.int64).max
        self.score[at[kept], place[kept]], self.id[at[kept], place[kept]] = s[kept], d[kept]


class Block:
    """Rows of a block with what the pivot table says of them."""

    def __init__(self, r, pivots: Pivots):
        self.ids, self.labels = np.frombuffer(r.ids, np.int64), np.asarray(list(r.labels))
        self.x = np.frombuffer(r.x, np.int32).reshape(-1, r.dim).astype(np.int64)
        self.far = np.frombuffer(r.far, np.float32).reshape(len(self.ids), -1)
        self.low, self.high = self.far.min(axis=0, keepdims=True), self.far.max(axis=0, keepdims=True)


def survivors(block: Block, pivots: Pivots, q: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors, rows and their exact scores (NONE where the bracket shuts the row out), for scores from ``least`` to ``most``."""
    size, far = pivots.of_anchors(q)
    low, high = pivots.brackets(size, far, block.low, block.high)
    asks = np.flatnonzero((high[:, 0] >= least) & (low[:, 0] <= most))
    step = max(1, (1 << 20) // max(1, len(block.ids)))
    for at in range(0, len(asks), step):
        a = asks[at : at + step]
        low, high = pivots.brackets(size[a], far[a], block.far, block.far)
        wanted = (high >= least[a, None]) & (low <= most[a, None])
        rows = np.flatnonzero(wanted.any(axis=0))
        if len(rows):
            yield a, rows, np.where(wanted[:, rows], products(q[a], block.x[rows]), NONE)


def whole(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda v: F.floor(v.cast("double") * scale))


def usable(vector: Column, scale: int) -> Column:
    """Whether a vector takes part: not null or empty, all components finite and none beyond ``MOST``."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * scale) > MOST - 1)
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, bad)


class PivotTable:
    """Rows (id, label, x) with the distances to their pivots, in written blocks by nearest pivot."""

    def __init__(self, rows: DataFrame, folder: SharedFolder):
        square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
        largest = rows.groupBy(F.size("x").alias("dim")).agg(F.max(square).alias("square")).collect()  # one for each length
        sample: dict[int, list] = {}
        # Ids alone are put in order, as each task sends as many to the driver.
        ids = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).distinct()
        for r in rows.join(F.broadcast(ids), "id", "left_semi").select("x").limit(SAMPLE_ROWS).collect():
            sample.setdefault(len(r["x"]), []).append(r["x"])
        self.pivots = {r["dim"]: Pivots(np.array(sample.get(r["dim"], []), np.int64).reshape(-1, r["dim"]), r["square"]) for r in largest}
        shared = rows.sparkSession.sparkContext.broadcast(self.pivots)
        named = T.StructType([*rows.select("id", "label").schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("cell", T.IntegerType()), T.StructField("own", T.FloatType()), T.StructField("bytes", T.BinaryType()), T.StructField("far", T.BinaryType())])
        arrow = to_arrow_schema(named)

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(2)
                sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
                begins = np.r_[0, np.cumsum(sizes)[:-1]]
                for dim in np.unique(sizes).tolist():
                    which = np.flatnonzero(sizes == dim)
                    for cut in range(0, len(which), BLOCK_ROWS):
                        at = which[cut : cut + BLOCK_ROWS]
                        x = flat[begins[at][:, None] + np.arange(dim)]
                        far = shared.value[dim].of_rows(x)
                        cell = far.argmin(axis=1) if far.shape[1] else np.zeros(len(at), np.int64)
                        own = far[np.arange(len(at)), cell] if far.shape[1] else np.zeros(len(at))
                        kept = batch.take(pa.array(at))
                        columns = [kept.column(0), kept.column(1), pa.array(np.full(len(at), dim)), pa.array(cell), pa.array(own), pa.array([v.tobytes() for v in x.astype(np.int32)], pa.binary()), pa.array([v.tobytes() for v in far], pa.binary())]
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        far = folder.save(rows.select("id", "label", "x").mapInArrow(measured, named), "distances")
        self.rows = far.count()
        # Ranges of (nearest pivot, distance, id) are of like size, however many rows a pivot has.
        parts = max(1, -(-self.rows // (4 * BLOCK_ROWS)))
        order = ["dim", "cell", "own", "id"]
        self.blocks = folder.save(_gathered(far.repartitionByRange(parts, *order).sortWithinPartitions(*order), BLOCK_ROWS), "blocks")
        self.far = far


def _gathered(rows: DataFrame, most: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of rows as they come, of one length each: dim, ids, labels, x, far and the ``extra`` columns of binaries; in a block by id."""
    label = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("dim", T.IntegerType()), T.StructField("ids", T.BinaryType()), T.StructField("labels", T.ArrayType(label)), *[T.StructField(c, T.BinaryType()) for c in ("x", "far", *extra)]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def told() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().sort_by("id")
            held.clear()
            columns = [pa.array([t["dim"][0].as_py()]), pa.array([t["id"].to_numpy().tobytes()], pa.binary()), pa.array([t["label"].to_pylist()])]
            columns += [pa.array([b"".join(t[c].to_pylist())], pa.binary()) for c in ("bytes", "far", *extra)]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        n, dim = 0, -1
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cuts = np.r_[0, np.flatnonzero(dims[1:] != dims[:-1]) + 1, len(dims)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if n and dims[a] != dim:
                    yield told()
                    n = 0
                dim = int(dims[a]) if b > a else dim
                while a < b:
                    take = min(b - a, max(1, min(most, BLOCK_VALUES // dim)) - n)
                    held.append(batch.slice(a, take))
                    n, a = n + take, a + take
                    if n >= max(1, min(most, BLOCK_VALUES // dim)):
                        yield told()
                        n = 0
        if n:
            yield told()

    return rows.select("id", "label", "dim", "bytes", "far", *extra).mapInArrow(run, schema)


def _met(table: PivotTable, anchors: DataFrame, extra: tuple[str, ...], work: Callable, schema: str) -> DataFrame:
    """Anchor blocks beside row blocks, handed to ``work`` by task.

    Each slice of the rows gets all anchors, which a broadcast would gather in the driver as often. In a task an anchor block
    meets the row blocks of a slice one after the other.
    """
    spark = anchors.sparkSession
    slices = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.rows // BLOCK_ROWS)))
    asked = _gathered(anchors, ANCHOR_ROWS, extra).select("dim", *[F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "x", *extra)])
    asked = asked.select("*", F.xxhash64("q_ids", *[f"q_{c}" for c in extra]).alias("q_at"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    blocks = table.blocks.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
    by = ["dim", "slice"]
    return asked.repartition(slices, *by).join(blocks.repartition(slices, *by).hint("merge"), by).mapInPandas(work, schema)


def _few(n: int) -> int:
    return max(1, -(-n // ANCHOR_ROWS))


def nearest_of_label(table: PivotTable, anchors: DataFrame, n_anchors: int, k: int) -> DataFrame:
    """anchor_id, positive_id, positive_score: each anchor's k best other rows of its label."""
    shared = anchors.sparkSession.sparkContext.broadcast(table.pivots)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def told(at) -> pd.DataFrame:
            ids, lists = held.pop(at)
            i, j = np.nonzero(lists.score != NONE)
            return pd.DataFrame({"anchor_id": ids[i], "positive_id": lists.id[i, j], "positive_score": lists.score[i, j]})

        for frame in frames:
            for r in frame.itertuples(index=False):
                pivots = shared.value[r.dim]
                block, q_ids, q_labels = Block(r, pivots), np.frombuffer(r.q_ids, np.int64), np.asarray(list(r.q_labels))
                q = np.frombuffer(r.q_x, np.int32).reshape(-1, r.dim).astype(np.int64)
                key = (r.q_at, r.q_ids)
                if key not in held:
                    if len(held) >= HELD:
                        yield told(next(iter(held)))
                    held[key] = (q_ids, Lists(len(q), k))
                lists = held[key][1]
                for a, rows, score in survivors(block, pivots, q, lists.score[:, -1].astype(np.float64), np.full(len(q), np.inf)):
                    fits = (block.labels[rows][None, :] == q_labels[a][:, None]) & (block.ids[rows][None, :] != q_ids[a][:, None])
                    lists.add(a, np.where(fits, score, NONE), block.ids[rows])
        for at in list(held):
            yield told(at)

    met = _met(table, anchors.repartition(_few(n_anchors)), (), run, "anchor_id long, positive_id long, positive_score long")
    best = met.groupBy("anchor_id", "positive_id").agg(F.max("positive_score").alias("positive_score"))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def nearest_in_windows(table: PivotTable, anchors: DataFrame, n_anchors: int, positives: DataFrame, low: int, high: int, k: int) -> DataFrame:
    """anchor_id, positive_id, positive_score, rank, negative_id, negative_score."""
    shared = anchors.sparkSession.sparkContext.broadcast(table.pivots)
    # Of each anchor a handful of positives; in binaries (id and score by turns), as blocks hold them.
    windows = positives.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct(F.col("positive_score").alias("s"), F.col("positive_id").alias("i")))).alias("w"))
    most = positives.groupBy("anchor_id").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
    filled = F.concat("w", F.array_repeat(F.struct(F.lit(NONE).alias("s"), F.lit(0).cast("long").alias("i")), F.lit(most) - F.size("w")))
    asked = anchors.join(windows.select(F.col("anchor_id").alias("id"), filled.alias("w")).hint("merge"), "id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column(batch.num_columns - 1).flatten()
            both = np.stack([w.field(0).to_numpy(), w.field(1).to_numpy()], axis=1).reshape(batch.num_rows, most, 2) if batch.num_rows else np.zeros((0, most, 2), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([v.tobytes() for v in both], pa.binary())], names=batch.schema.names)

    schema = T.StructType([*asked.drop("w").schema.fields, T.StructField("w", T.BinaryType())])
    asked = asked.repartition(_few(n_anchors)).mapInArrow(packed, schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def told(at) -> pd.DataFrame:
            ids, w, lists = held.pop(at)
            i, j = np.nonzero(lists.score != NONE)
            return pd.DataFrame({"anchor_id": ids[i // most], "positive_id": w[i // most, i % most, 1], "positive_score": w[i // most, i % most, 0], "negative_id": lists.id[i, j], "negative_score": lists.score[i, j]})

        for frame in frames:
            for r in frame.itertuples(index=False):
                pivots = shared.value[r.dim]
                block, q_ids, q_labels = Block(r, pivots), np.frombuffer(r.q_ids, np.int64), np.asarray(list(r.q_labels))
                q, w = np.frombuffer(r.q_x, np.int32).reshape(-1, r.dim).astype(np.int64), np.frombuffer(r.q_w, np.int64).reshape(-1, most, 2)
                key = (r.q_at, r.q_ids)
                if key not in held:
                    if len(held) >= HELD:
                        yield told(next(iter(held)))
                    held[key] = (q_ids, w, Lists(len(q) * most, k))
                lists = held[key][2]
                # From ceil(low * score / 100) to floor(high * score / 100); empty below a score of 0.
                p = np.where(w[:, :, 0] == NONE, -1, w[:, :, 0])
                least, last = np.where(p < 0, np.iinfo(np.int64).max, -((-low * p) // 100)), np.where(p < 0, NONE, (high * p) // 100)
                need = np.maximum(least, lists.score[:, -1].reshape(-1, most))
                for a, rows, score in survivors(block, pivots, q, need.min(axis=1).astype(np.float64), last.max(axis=1).astype(np.float64)):
                    fits = (block.labels[rows][None, :] != q_labels[a][:, None]) & (block.ids[rows][None, :] != q_ids[a][:, None])
                    for j in range(most):
                        inside = fits & (score >= least[a, j, None]) & (score <= last[a, j, None])
                        some = np.flatnonzero(inside.any(axis=1))
                        lists.add(a[some] * most + j, np.where(inside[some], score[some], NONE), block.ids[rows])
        for at in list(held):
            yield told(at)

    columns = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    pair = ["anchor_id", "positive_id", "positive_score"]
    best = _met(table, asked, ("w",), run, columns).groupBy(*pair, "negative_id").agg(F.max("negative_score").alias("negative_score"))
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its ``positives`` best other rows of the same label, by the inner product of
    floor(scale * x), ties to the smaller id; for each, the first ``negatives`` rows of other labels whose score
    lies between ``low`` and ``high`` percent of the positive's. A positive whose score is negative has none.
    Rows whose id, label or vector is null, whose vector is empty or holds null or non-finite
    components, or such beyond 2^27 when scaled, take no part; vectors meet those of their own
    length. Repeated rows count once. Rows that share an id but no vector or label are one candidate, of its
    best fitting score, and one anchor, and none of an anchor's own id is its candidate. Empty
    tables give no rows. Other columns are not read.
    """
    folder = SharedFolder(vectors.sparkSession, "hard-negatives")
    v = F.col(vector_col)
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(v, scale))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), whole(v, scale).alias("x"), is_anchor.alias("asks"))
    table = PivotTable(rows, folder)
    anchors = table.far.join(rows.where("asks").select("id").distinct(), "id", "left_semi")
    anchors = folder.save(anchors.select("id", "label", "dim", "bytes", "far"), "anchors")
    n = anchors.count()
    found = folder.save(nearest_of_label(table, anchors, n, positives), "positives")
    out = SharedFolder(vectors.sparkSession, "hard-negatives").save(nearest_in_windows(table, anchors, n, found, low, high, negatives), "mined")
    folder.drop()
    return out


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.x, c.x)::BIGINT AS s
  FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.x) = len(c.x) WHERE a.vec_id % 50 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, s AS positive_score FROM (SELECT anchor_id, vec_id, max(s) AS s FROM pairs WHERE same GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, vec_id) <= 5),
neg AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, max(s) AS negative_score FROM pos JOIN pairs USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * s AND 100 * s <= 95 * positive_score GROUP BY ALL)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id)::INTEGER AS rank,
  negative_id, positive_score, negative_score FROM neg QUALIFY rank <= 3
"""
