"""Ranked lexical search over a tiered index: high-impact postings first.

Documents are indexed in blocks. A posting (term, document) has a share of its term's weight,
told by its count and the document's length; weight times share is its impact. The postings of a
block lie in columns by tier: those of the highest impact in the first, so that a search that ends
there never reads the others. For each term and tier the index knows the largest impact that is
left below, the residual bound.

A search adds up the postings of the first tier. An item's ``k``-th sum is a score that its ``k``-th
document reaches at least; an item is proved when documents of which nothing was seen cannot reach
it. Then only documents whose sum and residual bounds together reach it are completed from the
lower tiers of their blocks, and the best are exact. Items lacking that proof fall through, and
are searched with the next tier, too; the last one leaves nothing out, so there all are proved.

Items are the stated set of queries: groups of them, of so many characters, lie in all tasks at
once, and the index holds the postings of their terms. Documents stay where they are: nothing
but term counts, sums for items and candidates is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import SharedFolder, read_table

#: Documents and characters of a block (one document at least), and items whose sums a task holds at once.
BLOCK_DOCS, BLOCK_CHARS, ITEM_ROWS = 2048, 4_000_000, 256
#: Characters of the items that are searched together.
GROUP_CHARS = 16_000_000
#: Shares of all postings that the tiers hold, from the first tier to each one.
TIERS = (1 / 16, 1 / 4, 1.0)
#: Longer texts are read in pieces of about so many bytes.
PIECE = 1 << 22

_TERM, _GAP = re.compile(rb"[0-9a-z\x80-\xff]+"), re.compile(rb"[^0-9a-z\x80-\xff]")


def pieces(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time; only A-Z are lower-cased. Null has none."""
    raw, at = (text or "").encode().lower(), 0
    while at < len(raw):
        gap = _GAP.search(raw, at + PIECE)
        end = gap.start() if gap else len(raw)
        yield _TERM.findall(raw, at, end)
        at = end


@dataclass
class Asked:
    """A group of items: for each term its number and the items that hold it, with how often."""

    numbers: dict[bytes, int]
    holders: list[tuple[np.ndarray, np.ndarray]]
    n: int

    @classmethod
    def of(cls, texts: Sequence[str | None]) -> Asked:
        numbers: dict[bytes, int] = {}
        rows: list[list[tuple[int, int]]] = []
        for i, text in enumerate(texts):
            held: Counter[bytes] = Counter()
            for found in pieces(text):
                held.update(found)
            for term, c in held.items():
                at = numbers.setdefault(term, len(numbers))
                if at == len(rows):
                    rows.append([])
                rows[at].append((i, c))
        holders = [(np.array([i for i, _ in r], np.int64), np.array([c for _, c in r], np.int64)) for r in rows]
        return cls(numbers, holders, len(texts))

    def only(self, items: np.ndarray) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """For each term the places among ``items`` (sorted) that hold it; None where none does."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for i, c in self.holders:
            at = np.searchsorted(items, i)
            ok = (at < len(items)) & (items[np.minimum(at, len(items) - 1)] == i)
            out.append((at[ok], c[ok]) if ok.any() else None)
        return out

    def bound(self, residual: np.ndarray) -> np.ndarray:
        """For each item what a document of which nothing was seen can score at most."""
        out = np.zeros(self.n, np.int64)
        for t, (i, c) in enumerate(self.holders):
            out[i] += c * residual[t]
        return out


def _ints(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


def _values(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy().astype(np.int64)


def counted(docs: DataFrame, asked: Asked, key: str, text_col: str) -> DataFrame:
    """A row per block: how many documents have terms, how many terms these have, and the documents that hold
    terms of the items (ids, n) with the counts (term, doc: its place among ids, tf), by term."""
    known = docs.sparkSession.sparkContext.broadcast(asked.numbers)
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [T.StructField(c, T.LongType()) for c in ("block", "with_terms", "terms")]
        + [T.StructField("ids", T.ArrayType(docs.schema[key].dataType)), *[T.StructField(c, ints) for c in ("n", "term", "doc", "tf")]]
    )
    arrow = to_arrow_schema(schema)

    def block(at: int, ids: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
        get, rows = known.value.get, len(texts)
        n, keys = np.zeros(rows, np.int64), []
        for i, text in enumerate(texts):
            for found in pieces(text):
                n[i] += len(found)
                held = np.array([x for x in map(get, found) if x is not None], np.int64)
                keys.append(held * rows + i)
        key, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
        term, doc = key // rows, key % rows
        kept, doc = np.unique(doc, return_inverse=True)
        held = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), ids.take(pa.array(kept)).cast(arrow.field("ids").type.value_type))
        numbers = [pa.array([x], pa.int64()) for x in (at, int((n > 0).sum()), int(n.sum()))]
        columns = [*numbers, held, *map(_ints, (n[kept], term, doc, tf))]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts, begin = batch.column(1), 0
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            while begin < len(texts):
                end, chars = begin, 0
                while end < len(texts) and (end == begin or end - begin < BLOCK_DOCS and chars + sizes[end] <= BLOCK_CHARS):
                    chars += sizes[end]
                    end += 1
                yield block(at, batch.column(0).slice(begin, end - begin), texts.slice(begin, end - begin).to_pylist())
                begin, at = end, at + 1

    return docs.select(docs[key], docs[text_col].cast("string")).mapInArrow(run, schema)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


class TieredIndex:
    """The written index of the items' terms over all documents: blocks, weights and residual bounds."""

    def __init__(self, docs: DataFrame, asked: Asked, folder: SharedFolder, key: str = "doc_id", text_col: str = "text", tiers: Sequence[float] = TIERS):
        self.key_type = docs.schema[key].dataType
        self.tiers, self.spark, terms = len(tiers), docs.sparkSession, len(asked.numbers)
        raw = folder.save(counted(docs, asked, key, text_col), "counts")
        total = raw.agg(F.coalesce(F.sum("with_terms"), F.lit(0)).alias("n"), F.coalesce(F.sum("terms"), F.lit(0)).alias("l")).first()
        n, length = total["n"], total["l"]
        self.weights = np.zeros(terms, np.int64)
        for r in raw.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # the items' terms at most
            self.weights[r["term"]] = weight(n, r["count"])
        weights, shared = self.weights, self.spark.sparkContext.broadcast(self.weights)

        def shares(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """term, doc, share of a block's postings."""
            term, doc, tf = (_values(batch, c, row) for c in ("term", "doc", "tf"))
            m = 75 + (25 * _values(batch, "n", row) * n) // max(length, 1)
            return term, doc, (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])

        def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(256, np.int64)
            for batch in batches:
                for row in range(batch.num_rows):
                    term, _, share = shares(batch, row)
                    impact = shared.value[term] * share
                    seen += np.bincount((4 * np.log2(impact[impact > 0])).astype(np.int64), minlength=256)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(seen)], names=["bucket", "c"])

        sizes = np.zeros(256, np.int64)
        for r in raw.select("n", "term", "doc", "tf").mapInArrow(measured, "bucket long, c long").groupBy("bucket").agg(F.sum("c").alias("c")).collect():  # 256
            sizes[r["bucket"]] = r["c"]
        above = np.cumsum(sizes[::-1])[::-1]  # postings in a bucket and those above
        cuts = [max(1, math.ceil(2 ** (int(np.flatnonzero(above >= share * above[0])[-1]) / 4))) if above[0] else 1 for share in tiers[:-1]] + [1]
        names = [f"{c}{j}" for j in range(self.tiers) for c in ("term", "doc", "share")]
        ints = T.ArrayType(T.IntegerType())
        schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(self.key_type)), *[T.StructField(c, ints) for c in names]])
        arrow = to_arrow_schema(schema)

        def tiered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    term, doc, share = shares(batch, row)
                    impact, columns = shared.value[term] * share, []
                    tier = np.array([(impact < c) for c in cuts]).sum(axis=0)
                    for j in range(len(cuts)):  # impacts of nothing are in none
                        columns += [_ints(x[tier == j]) for x in (term, doc, share)]
                    columns = [batch.column("block").slice(row, 1), batch.column("ids").slice(row, 1), *columns]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        self.blocks = folder.save(raw.where(F.size("ids") > 0).select("block", "ids", "n", "term", "doc", "tf").mapInArrow(tiered, schema), "index")
        folder.drop("counts")
        #: How many items a search has proved in each tier.
        self.proved: list[int] = []
        #: For each tier and term the largest impact that is left below it.
        self.residual = np.zeros((self.tiers, terms), np.int64)
        for j in range(1, self.tiers):
            rows = self.blocks.select(F.explode(F.arrays_zip(f"term{j}", f"share{j}")).alias("x")).groupBy(F.col(f"x.term{j}").alias("term")).agg(F.max(f"x.share{j}").alias("share"))
            for r in rows.collect():  # the items' terms at most
                below = weights[r["term"]] * r["share"]
                self.residual[:j, r["term"]] = np.maximum(self.residual[:j, r["term"]], below)

    def columns(self, first: int, last: int) -> list[str]:
        return [f"{c}{j}" for j in range(first, last + 1) for c in ("term", "doc", "share")]


def add_up(batch: pa.RecordBatch, row: int, tiers: Sequence[int], held: list, weights: np.ndarray, residual: np.ndarray, items: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of impacts by item and document of a block, and of the residuals of the terms that were seen."""
    score, seen = np.zeros((items, docs), np.int64), np.zeros((items, docs), np.int64)
    for j in tiers:
        term, doc, share = (_values(batch, f"{c}{j}", row) for c in ("term", "doc", "share"))
        begins = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(term)], strict=False):
            t = int(term[a])
            if held[t] is not None:
                i, c = held[t]
                at = (i[:, None], doc[a:b][None, :])
                score[at] += c[:, None] * (share[a:b] * weights[t])[None, :]
                if residual[t]:
                    seen[at] += (c * residual[t])[:, None]
    return score, seen


def _parts(items: np.ndarray) -> list[np.ndarray]:
    return [items[a : a + ITEM_ROWS] for a in range(0, len(items), ITEM_ROWS)]


def search(index: TieredIndex, asked: Asked, folder: SharedFolder, k: int) -> DataFrame:
    """item (its number), key, score: of each item the documents that may be among its k best, with exact scores."""
    context, found = index.spark.sparkContext, None
    open_items = np.arange(asked.n)
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("block", T.LongType()), T.StructField("doc", T.LongType()), T.StructField("key", index.key_type), T.StructField("score", T.LongType())])
    arrow = to_arrow_schema(schema)
    for tier in range(index.tiers):
        if not len(open_items):
            break
        residual = index.residual[tier]
        shared = context.broadcast((_parts(open_items), [asked.only(p) for p in _parts(open_items)], index.weights, residual))
        tiers = list(range(tier + 1))
        seen = index.blocks.select("block", "ids", *index.columns(0, tier))

        def best(batches: Iterator[pa.RecordBatch], shared=shared, tiers=tiers) -> Iterator[pa.RecordBatch]:
            parts, helds, weights, residual = shared.value
            top = [np.zeros((len(p), k), np.int64) for p in parts]
            for batch in batches:
                for row in range(batch.num_rows):
                    docs = len(batch.column("ids")[row].values)
                    for x, (items, held) in enumerate(zip(parts, helds, strict=True)):
                        score, _ = add_up(batch, row, tiers, held, weights, residual, len(items), docs)
                        top[x] = np.partition(np.concatenate([top[x], score], axis=1), -k, axis=1)[:, -k:]
            for items, t in zip(parts, top, strict=True):
                at, _ = np.nonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array(items[at]), pa.array(t[t > 0])], names=["item", "score"])

        order = Window.partitionBy("item").orderBy(F.desc("score"))
        reached = seen.mapInArrow(best, "item long, score long").withColumn("r", F.row_number().over(order)).where(F.col("r") == k)
        least = np.ones(asked.n, np.int64)
        for r in reached.collect():  # an item each at most
            least[r["item"]] = r["score"]
        proved = open_items[asked.bound(residual)[open_items] < least[open_items]]
        open_items = np.setdiff1d(open_items, proved)
        index.proved.append(len(proved))
        if not len(proved):
            continue
        limits = [least[p] for p in _parts(proved)]
        bounds = [asked.bound(residual)[p] for p in _parts(proved)]
        chosen = context.broadcast((_parts(proved), [asked.only(p) for p in _parts(proved)], index.weights, residual, limits, bounds))

        def candidates(batches: Iterator[pa.RecordBatch], chosen=chosen, tiers=tiers) -> Iterator[pa.RecordBatch]:
            parts, helds, weights, residual, limits, bounds = chosen.value
            for batch in batches:
                for row in range(batch.num_rows):
                    ids = batch.column("ids")[row].values
                    for items, held, limit, bound in zip(parts, helds, limits, bounds, strict=True):
                        score, seen = add_up(batch, row, tiers, held, weights, residual, len(items), len(ids))
                        i, d = np.nonzero(score + (bound[:, None] - seen) >= limit[:, None])
                        columns = [items[i], np.repeat(batch.column("block")[row].as_py(), len(i)), d]
                        columns = [*map(pa.array, columns), ids.take(pa.array(d)), pa.array(score[i, d])]
                        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        rows = folder.save(seen.mapInArrow(candidates, schema), f"candidates{tier}")
        if tier + 1 < index.tiers:
            rows = _completed(index, rows, asked, tier, schema)
        rows = rows.select("item", "key", "score")
        found = rows if found is None else found.unionByName(rows)
    return found


def _completed(index: TieredIndex, rows: DataFrame, asked: Asked, tier: int, schema: T.StructType) -> DataFrame:
    """Candidates with the scores that the lower tiers of their blocks add."""
    shared = index.spark.sparkContext.broadcast((asked, index.weights))
    arrow, lower = to_arrow_schema(schema), list(range(tier + 1, index.tiers))
    # Of one block, at most its documents for each item.
    grouped = rows.groupBy("block").agg(F.collect_list(F.struct("item", "doc", "score")).alias("asks"))
    met = index.blocks.select("block", "ids", *index.columns(tier + 1, index.tiers - 1)).join(grouped, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weights = shared.value
        none = np.zeros(len(weights), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                asks, ids = batch.column("asks")[row].values, batch.column("ids")[row].values
                item, doc, score = (asks.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                for items in _parts(np.unique(item)):
                    more, _ = add_up(batch, row, lower, asked.only(items), weights, none, len(items), len(ids))
                    mine = np.isin(item, items)
                    i, d = item[mine], doc[mine]
                    columns = [pa.array(i), pa.array(np.repeat(batch.column("block")[row].as_py(), len(i))), pa.array(d), ids.take(pa.array(d))]
                    columns.append(pa.array(score[mine] + more[np.searchsorted(items, i), d]))
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return met.mapInArrow(run, schema)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text_col: str = "text", item_key: str = "item_id", item_text: str = "text", tiers: Sequence[float] = TIERS
) -> DataFrame:
    """item key, rank (from 1), key, score: each item's k documents of the highest scores above 0, all if fewer.

    Equal scores go by ascending key, null keys last. Null and empty texts have no terms: such
    documents are not counted, such items get no rows. Rows of ``docs`` are documents of their own, even if
    repeated; repeated items (key and text) are one, items of one key and different texts are ranked each by
    itself. Empty tables give no rows. Other columns are not read. Very long texts are read in pieces.
    """
    spark = docs.sparkSession
    folder = SharedFolder(spark, "ranked-search")
    rows = folder.save(items.select(items[item_key].alias("k"), items[item_text].cast("string").alias("t")).distinct(), "items")
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    groups, out = max(1, -(-chars // GROUP_CHARS)), None
    for g in range(groups):
        mine = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(groups)) == g).collect()  # about GROUP_CHARS characters
        asked, part = Asked.of([r["t"] for r in mine]), SharedFolder(spark, "ranked-search-group")
        named = spark.createDataFrame([(i, r["k"]) for i, r in enumerate(mine)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_key", rows.schema["k"].dataType)]))
        found = search(TieredIndex(docs, asked, part, key, text_col, tiers), asked, part, k)
        if found is None:
            continue
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("key"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best = best.join(named, "item").select(F.col("item_key").alias(item_key), "rank", F.col("key").alias(key), "score")
        best = folder.save(best, f"ranked{g}")
        part.drop()
        out = best if out is None else out.unionByName(best)
    if out is None:
        fields = [T.StructField(item_key, rows.schema["k"].dataType), T.StructField("rank", T.IntegerType()), T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.LongType())]
        out = spark.createDataFrame([], T.StructType(fields))
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW.format("text")}, '{_PATTERN}') AS ts FROM documents),
k AS (SELECT r, doc_id, ts, len(ts) AS n FROM d WHERE len(ts) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM k),
tf AS (SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM k) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, total GROUP BY term),
q AS (SELECT item_id, text, term, count(*)::BIGINT AS c FROM (SELECT item_id, text, unnest(regexp_extract_all({_LOW.format("text")}, '{_PATTERN}')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
s AS (SELECT item_id, text, r, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""
