"""Hard negatives: the pivot table against brute force and SQL, brackets, and the odd tables."""

import math
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from inkgauge.llm import hard_negatives as H

VECTORS = "vec_id long, embedding array<float>, label int, rank int"


def brute(rows, positives=5, negatives=3):
    kept = [(i, label, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x, label in rows if None not in (i, x, label) and x and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for a in sorted({i for i, _, _ in kept if i % 50 == 0}):
        same, other = defaultdict(lambda: -(10**18)), []
        for i, label, q in kept:
            if i == a:
                for j, lb, x in kept:
                    if j != a and len(x) == len(q):
                        s = sum(u * v for u, v in zip(q, x))
                        if lb == label:
                            same[j] = max(same[j], s)
                        else:
                            other.append((s, j))
        for p, s in sorted(same.items(), key=lambda r: (-r[1], r[0]))[:positives]:
            best = defaultdict(lambda: -(10**18))
            for t, j in other:
                if 50 * s <= 100 * t <= 95 * s:
                    best[j] = max(best[j], t)
            out += [(a, p, r, j, s, t) for r, (j, t) in enumerate(sorted(best.items(), key=lambda r: (-r[1], r[0]))[:negatives], 1)]
    return sorted(out)


def test_mining_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 64)
    monkeypatch.setattr(H, "ANCHOR_ROWS", 2)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.4 * rng.normal(size=8)).tolist(), int(rng.integers(0, 3))) for i in range(400)]
    rows += [(500 + i, rows[50][1], i % 3) for i in range(60)]  # copies, ties
    rows += [(50, rows[7][1], 2), (9, rows[50][1], 1), (9, rows[50][1], 1)]  # ids that repeat
    rows += [(None, rows[0][1], 1), (1000, None, 1), (1050, [], 1), (1100, [1.0, None], 1), (1150, [math.nan] * 8, 1), (1200, rows[0][1], None), (1250, [0.0] * 8, 1), (1300, [math.inf] * 8, 1)]
    rows += [(2000, [1.0, 2.0], 1), (2001, [1.0, 1.0], 1), (2002, [0.5, 0.75], 0)]  # of another length
    df = spark.createDataFrame([(*r, 1) for r in rows], VECTORS).repartition(4)
    want = brute(rows)
    assert want and sorted(map(tuple, H.mine(df, F.col("vec_id") % 50 == 0).collect())) == want
    con = duckdb.connect()
    con.register("embeddings", df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 9) % 10).otherwise(F.col("label"))).toArrow())
    assert sorted(con.sql(H.OP13_SQL).fetchall()) == want


def test_mining_odd_tables_and_text_labels(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [0.7, 0.1], "b"), (3, [1.0, 0.0], "b")], "key long, x array<double>, kind string")
    got = H.mine(df, F.col("key") == 50, id_col="key", vector_col="x", label_col="kind")
    assert list(map(tuple, got.collect())) == [(50, 1, 1, 2, 65536, 45824)]
    empty = spark.createDataFrame([], VECTORS)
    assert H.mine(empty, F.col("vec_id") % 50 == 0).count() == 0
    assert H.mine(df, F.lit(False), id_col="key", vector_col="x", label_col="kind").count() == 0


def test_brackets_hold_and_shut_rows_out():
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (8, 16))
    x = centres[rng.integers(0, 8, 600)] + rng.integers(-15, 15, (600, 16))
    q = x[:40]
    pivots = H.Pivots(x[:200], (x * x).sum(axis=1).max())
    size, far = pivots.of_anchors(q)
    rows = pivots.of_rows(x)
    low, high = pivots.brackets(size, far, rows, rows)
    exact = H.products(q, x)
    assert (low <= exact).all() and (exact <= high).all()
    fifth = np.sort(exact, axis=1)[:, -5]
    assert (high < fifth[:, None]).mean() > 0.5


def test_lists_keep_the_best_ids_once():
    lists = H.Lists(1, 3)
    lists.add(np.array([0]), np.array([[10, 9, 8, 7, H.NONE]]), np.array([1, 1, 1, 2, 3]))
    lists.add(np.array([0]), np.array([[7, 7, 12, 7]]), np.array([0, 4, 5, 6]))
    assert list(zip(lists.score[0].tolist(), lists.id[0].tolist())) == [(12, 5), (10, 1), (7, 0)]


def test_large_components_stay_whole():
    big = np.array([[1 << 26, 3]]), np.array([[1 << 26, 5], [-(1 << 26), 1]])
    assert H.products(*big).tolist() == [[(1 << 52) + 15, -(1 << 52) + 3]]


def test_anchors_of_all_slices_are_not_gathered_in_the_driver(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(H, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist(), i % 3, 1) for i in range(600)], VECTORS)
    rows = df.select(F.col("vec_id").alias("id"), "label", H.whole(F.col("embedding"), 256).alias("x"))
    folder = H.SharedFolder(spark, "test")
    table = H.PivotTable(rows, folder)
    anchors = folder.save(table.far.where("id % 50 = 0"), "anchors")
    plan = H.nearest_of_label(table, anchors, 12, 5)._jdf.queryExecution().executedPlan().toString()
    folder.drop()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and all(len(p.points) == H.PIVOTS for p in table.pivots.values())
