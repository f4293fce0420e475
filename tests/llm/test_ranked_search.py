"""Ranked search: the tiered index against brute force, and the odd tables."""

import math
import random
import re
from collections import Counter

import duckdb

from inkgauge.llm import ranked_search as R
from inkgauge.llm.common import SharedFolder

DOCS = "doc_id long, text string, score string, rank int"


def brute(docs, items, k):
    """(item, rank, doc, score) by going through everything."""
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low(t))
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 75 + (25 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def test_search_equals_brute_force_in_every_tier(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}é" if i % 5 == 0 else f"W{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 120))) for _ in range(300)]
    texts[7] = texts[8] = texts[9]
    texts += [None, "", " .,! ", "w3 w3 É é"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, "w1 w2 w3"), (5, texts[9])]
    items = [(i, " ".join(rng.choices(vocabulary, weights, k=12))) for i in range(20)] + [(i, texts[i]) for i in range(30, 50)] + [(90, None), (91, "unknown"), (None, "w2 w9"), (92, "")]
    frame = spark.createDataFrame([(*d, "s", 1) for d in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(*i, 1) for i in items + items[:3]], "item_id long, text string, doc_id long")
    got = sorted(map(tuple, R.rank_documents(frame, asked, k=4).collect()), key=repr)
    assert got == brute(docs, items, 4)
    # Both ways to end: items that are proved in the first tier, and such that fall through.
    known = R.Asked.of([t for _, t in items])
    folder = SharedFolder(spark, "test")
    index = R.TieredIndex(frame, known, folder)
    R.search(index, known, folder, 4)
    assert sum(index.proved) == len(items) and sum(x > 0 for x in index.proved) > 1
    assert (index.residual[-1] == 0).all() and (index.residual[0] >= index.residual[1]).all()


def test_search_in_groups_of_items_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "GROUP_CHARS", 20)
    docs = [(i, f"common x{i % 7} y{i % 3}") for i in range(40)]
    items = [(1, "x1 y1 common"), (2, "x2 x2 y0"), (3, "nothing"), (1, "y2")]
    frame, asked = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = R.rank_documents(frame, asked, k=20)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, [(str(i), t) for i, t in items], 20)


def test_search_in_odd_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string"), spark.createDataFrame([(1, "b a")], "item_id long, text string")
    assert R.rank_documents(docs.limit(0), items).count() == R.rank_documents(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in R.rank_documents(docs, items).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 2)]


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = "Long-word, é1 Çx " * 50
    whole = [t for p in R.pieces(text) for t in p]
    monkeypatch.setattr(R, "PIECE", 7)
    assert [t for p in R.pieces(text) for t in p] == whole == [w.encode() for w in ["long", "word", "é1", "Çx"] * 50]


def test_search_sql_on_a_fixture(spark):
    con = duckdb.connect()
    docs = spark.createDataFrame([(1, "Ab ab É x", 1), (2, "ab\tÉ", 1), (3, None, 1), (4, "É y-y x", 1), (5, "x", 1)], "doc_id long, text string, n int")
    items = spark.createDataFrame([(1, "É ab x"), (2, None), (1, "É ab x"), (3, "y y É")], "item_id long, text string")
    con.register("documents", docs.toPandas())
    con.register("benchmark", items.toPandas())
    got = sorted(map(tuple, R.rank_documents(docs, items).collect()))
    assert got and got == sorted(con.sql(R.OP11_SQL).fetchall())
