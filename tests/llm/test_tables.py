"""Operators over whole tables: packing, toxicity, line dedup, search, URL filters, and the pipeline's contract."""

import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgauge.llm import line_dedup as L
from inkgauge.llm import one_bit_search as N
from inkgauge.llm import packing as P
from inkgauge.llm import toxicity as X
from inkgauge.llm import url_filters as U
from inkgauge.llm.common import tokenizer_path


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def duck(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.sql(sql)


# ---- packing ---------------------------------------------------------------------------------


def test_packing_places_every_token_once(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [None, "", " x ", "two  gaps", "é漢🎈 \t y", "w " * 700, "w " * 700, "tail "] + ["ab " * rng.randrange(1, 90) for _ in range(80)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "no key", 1), (3, "two  gaps", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    got = P.pack_documents(docs, capacity=256).collect()
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)] if len(ids) > 256 else [0, len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((key, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= -(-sum(r["length"] for r in got) // 256) + 1
    assert P.pack_documents(docs.limit(0)).count() == 0


def test_packing_search_never_loses_documents():
    rng = random.Random(9)
    for _ in range(20):
        histogram = {rng.randrange(1, 101): rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))}
        plan = P.PackingPlan(histogram, 100)
        held = defaultdict(int)
        for pattern, n in plan.bins.items():
            assert sum(pattern) <= 100
            for size in pattern:
                held[size] += n
        assert dict(held) == histogram and plan.bound <= len(plan) <= plan.first


def test_packing_search_ends_where_no_exchange_gains():
    # Lengths that lie alone with little room, and sequences of three that exchanges can fill.
    rng = random.Random(1)
    for _ in range(4):
        histogram = {n: 1 for n in range(900, 960)} | {rng.randrange(250, 420): rng.randrange(1, 4) for _ in range(40)}
        plan = P.PackingPlan(histogram, 1024)
        under = [p for p in plan.bins if sum(p) < 1024]
        if len(plan) > plan.bound:
            for a in under:
                for b in under:
                    if sum(b) <= sum(a) and plan.bins[a] >= 1 + (a == b):
                        assert P.PackingPlan._exchange(a, b, 1024 - sum(a)) is None


# ---- toxicity --------------------------------------------------------------------------------


def test_toxicity_learns_held_out_grades(spark):
    rng = random.Random(4)
    plain, bad = [f"plain{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(10)], [f"nasty{chr(97 + i)}" for i in range(15)]

    def text(toxic):
        return " ".join(rng.choices(plain, k=40) + rng.choices(bad, k=rng.choice([2, 8]) if toxic else 0))

    rows = [(i, text(i % 5 == 0), "m") for i in range(600)] + [(600, None, "m"), (601, "", "m"), (None, "plain", "m"), (3, text(False), "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (7, None), (10, 1)], "doc_id long, toxic int")
    model = X.train(docs, labels)
    scored = X.score_toxicity(docs, model)
    got = {r["doc_id"]: r for r in scored.collect()}
    assert scored.count() == len(rows)
    held_out = [got[i]["toxic"] == (i % 5 == 0) for i in range(300, 600)]
    assert sum(held_out) / len(held_out) > 0.97
    assert not got[600]["toxic"] and not got[601]["toxic"]
    kept = X.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.where("NOT toxic").count()
    constant = X.train(docs, labels.limit(0))
    assert X.score_toxicity(docs, constant).where("toxic").count() == 0
    assert X.score_toxicity(docs.limit(0), constant).count() == 0


def test_toxicity_gradient_equals_differences():
    rng = np.random.default_rng(1)
    rows, cols = rng.integers(0, 30, 80), rng.integers(0, 4, 80)
    rows, cols = (np.array(x) for x in zip(*sorted(set(zip(rows.tolist(), cols.tolist())))))
    y, p = rng.integers(0, 3, 30), np.array([0.3, 0.1, 0.7, 0.2, 0.5, -0.3])
    value, gradient = X.objective(p, rows, cols, y, 4)
    held = [[c for r, c in zip(rows, cols) if r == i] for i in range(30)]
    likelihood = 0.0
    for i in range(30):
        over = [1 / (1 + np.exp(t - sum(p[c] for c in held[i]))) for t in (0.5, 0.5 + np.exp(-0.3))]
        likelihood += np.log([1 - over[0], over[0] - over[1], over[1]][y[i]])
    penalty = X.SQUARES / 2 * (p[:4] ** 2).sum() + X.SIZES * np.sqrt(p[:4] ** 2 + 1e-4).sum()
    assert value == pytest.approx(penalty - likelihood)
    for i in range(6):
        d = np.zeros(6)
        d[i] = 1e-6
        slope = (X.objective(p + d, rows, cols, y, 4)[0] - X.objective(p - d, rows, cols, y, 4)[0]) / 2e-6
        assert gradient[i] == pytest.approx(slope, rel=1e-4, abs=1e-4)


def test_toxicity_counts_features_once_a_document(spark):
    rows = [(1, 0, 1, "nasty words, nasty"), (2, 1, 0, "words"), (3, 0, 0, ""), (4, 1, 1, "Nasty")]
    sample = spark.createDataFrame(rows, "key long, half int, toxic int, text string")
    found = {r["feature"]: tuple(r)[1:] for r in X.feature_counts(sample).collect()}
    assert found["nasty"] == found["nast*"] == (0, 1, 0, 1) and found["words"] == (0, 1, 1, 0)
    same = "copies of a text, however often they occur"
    docs = spark.createDataFrame([(i, same + (" x" if i % 2 else "")) for i in range(9)] + [(9, None), (3, "other words with that key")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(10)] + [(None, 1), (1, 0)], "doc_id long, toxic int")
    got = X.sampled(docs, labels, 100, "doc_id", "text").collect()
    assert sorted(r["key"] for r in got) == [0, 3, 9]  # one of the copies, the key with another text, the empty one


# ---- line dedup ------------------------------------------------------------------------------


def line_docs():
    rng = random.Random(6)
    lines = [" ".join(f"w{rng.randrange(1000)}" for _ in range(rng.choice([3, 9, 20, 60]))) for _ in range(25)]
    rows = [(0, None, 1), (1, "", 1), (2, "\n\n", 1), (3, "short", 1), (4, "short", 1)]
    for i in range(5, 60):
        picked = rng.choices(lines, k=rng.randrange(1, 9)) + [f"own line {i} {rng.random()}"]
        start = rng.randrange(len(lines) - 8)
        rows.append((i, "\n".join(picked + lines[start : start + rng.randrange(3, 8)]), 1))
    return rows


def test_line_dedup_equals_its_sql(spark):
    rows = line_docs()
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    got = L.dedup_lines(docs, removed="n_removed")
    assert got.columns == ["doc_id", "text", "k", "n_removed"]
    want = duck(L.OP5_SQL, documents=docs.toPandas()).fetchall()
    found = sorted(tuple(r) for r in got.select("doc_id", "n_removed", "text").collect())
    assert found == sorted(want) and any(r[1] for r in found)
    # Repeated rows are one document; null keys stay.
    twice = docs.unionByName(docs.where("doc_id = 5"))
    again = L.dedup_lines(twice).where("doc_id = 5").collect()
    assert len(again) == 2 and again[0] == again[1]
    none = docs.withColumn("doc_id", F.lit(None).cast("long"))
    assert L.dedup_lines(none).count() == len(rows)
    assert L.dedup_lines(docs.limit(0)).count() == 0


def lines_by_hand(rows, least=50):
    """doc_id to the lines that stay, of rows with distinct keys, by all windows of lines."""
    first, gone, held = {}, defaultdict(set), {}
    for key, text in sorted(rows):
        held[key] = lines = text.split("\n")
        units = [(i, len(x.split())) for i, x in enumerate(lines) if x.split()]
        spans = set()
        for a in range(len(units)):
            for step, edge in ((1, len(units)), (-1, -1)):
                n, b = 0, a
                while b != edge and n < least:
                    n, b = n + units[b][1], b + step
                if n >= least:
                    spans.add(tuple(sorted((units[a][0], units[b - step][0]))))
        for low, high in sorted(spans):
            body = tuple(x for x in lines[low : high + 1] if x.split())
            at = first.setdefault(body, (key, low, high))
            if at[:2] != (key, low):
                gone[key].update(range(max(low, at[2] + 1) if at[0] == key else low, high + 1))
    return {k: "\n".join(x for i, x in enumerate(v) if i not in gone[k]) for k, v in held.items()}


def test_a_text_that_repeats_itself_keeps_the_first_copy(spark):
    rng = random.Random(3)
    period = lambda n, words: [" ".join(f"{n}w{rng.randrange(10**6)}" for _ in range(words)) for _ in range(n)]
    rows = [(1, "\n".join(["alpha beta"] * 60)), (2, "\n".join(period(5, 5) * 6)), (3, "\n\n".join(period(3, 7) * 9 + ["an end"]))]
    block = period(9, 8)
    rows += [(4, "\n".join(["one", *block, "two", *block[:8], "three", *block])), (5, "\n".join(block)), (6, "\n".join(["alpha beta"] * 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()}
    assert got == lines_by_hand(rows)
    assert [len(got[k].split()) for k in (1, 2)] == [50, 50] and got[5] == ""
    assert dict(duck(L.OP5_SQL, documents=docs.toPandas()).project("doc_id, text").fetchall()) == got


def passages_by_hand(rows):
    """doc_id to the words that stay, of rows with distinct keys."""
    first, gone = {}, defaultdict(set)
    for key, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        for i in range(len(words) - 49):
            at = first.setdefault(tuple(words[i : i + 50]), (key, i))
            if at != (key, i):  # what the first position covers stays
                gone[key].update(range(max(i, at[1] + 50) if at[0] == key else i, i + 50))
    return {k: [w for i, w in enumerate((t or "").encode().split()) if i not in gone[k]] for k, t in rows}


def test_passages_equal_brute_force(spark):
    rng = random.Random(12)
    own = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    passages = [own(n) for n in (20, 49, 50, 51, 70, 160)]
    rows = [(0, None), (1, ""), (2, "\n \n"), (3, "short"), (4, "w " * 200), (5, "a b c\n" * 40), (6, " ".join(f"p{i % 30}" for i in range(170)))]
    for i in range(7, 80):
        words = own(rng.randrange(4))
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(passages)
            a = rng.randrange(12)
            words += p[a if rng.random() < 0.4 else 0 :] + own(rng.choice([0, 1, 5, 60]))
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "  ", "\n", "\t\n"]) for w in words)))
    docs = spark.createDataFrame([(k, t, "m") for k, t in rows], "doc_id long, text string, runs string")
    got = L.dedup_passages(docs, removed="n")
    assert got.columns == ["doc_id", "text", "runs", "n"]
    want, found = passages_by_hand(rows), {r["doc_id"]: r for r in got.collect()}
    for key, text in rows:
        assert (found[key]["text"] or "").encode().split() == want[key], key
        assert found[key]["n"] == len((text or "").split()) - len(want[key])
    assert found[0]["text"] is None and found[2]["text"] == rows[2][1]
    twice = L.dedup_passages(docs.unionByName(docs.where("doc_id IN (6, 7)"))).collect()
    assert sorted(r["text"] for r in twice if r["doc_id"] == 7) == [found[7]["text"]] * 2
    assert L.dedup_passages(docs.limit(0)).count() == 0


def test_pipeline_deletes_spliced_passages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"one start {passage} one end"), (2, f"two\nlines {passage.replace('p30 ', 'p30' + chr(10))} last\nline"), (3, f"a\n{passage}\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(map(tuple, pipeline.without_repeated_lines(spark, docs, "").collect()))
    assert got == {1: rows[0][1], 2: "two\nlines last\nline", 3: "a\nb"}


# ---- nearest neighbours ----------------------------------------------------------------------


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((600, 48)).astype(np.float32)
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist(), 0.5) for i, v in enumerate(x)]
    rows += [(700, None, 0.5), (720, [0.0] * 48, 0.5), (740, [float("nan")] * 48, 0.5), (760, [None] + [1.0] * 47, 0.5), (None, [1.0] * 48, 0.5), (780, [1.0, 2.0], 0.5), (800, [], 0.5), (5, x[5].tolist(), 0.5)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = N.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got.collect()}
    d = x.astype(np.float64)
    hits = total = 0
    for q in range(0, 600, 20):
        exact = N.exact_scores(np.repeat(d[q : q + 1], 600, axis=0), d)
        order = [i for i in np.lexsort((np.arange(600), -exact)) if i != q][:20]
        total += 20
        hits += len({found[q, r][0] for r in range(1, 21)} & set(order))
        for r in range(1, 21):
            assert found[q, r][1] == exact[found[q, r][0]]
    assert hits / total >= 0.98
    assert {q for q, _ in found} == set(range(0, 600, 20))  # 780 meets nothing of its length
    assert N.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_search_counts_an_id_once(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    # An id that is near to every query, with 60 vectors.
    rows += [(77, (x[0] * (5 + j / 10)).astype(np.float32).tolist()) for j in range(60)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = N.nearest(vectors, F.col("vec_id") == 0, k=20).collect()
    want = {}
    for i, v in rows[1:]:
        score = float(N.exact_scores(x[:1].astype(np.float64), np.array([v], np.float32).astype(np.float64))[0])
        want[i] = max(score, want.get(i, -np.inf))
    want = sorted(want.items(), key=lambda p: (-p[1], p[0]))[:20]
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == want


# ---- URL filters -----------------------------------------------------------------------------


def judged_by_hand(url, rules, listed):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut].translate(str.maketrans(U.UPPER, U.LOWER)), rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    path = tail[:end]
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    rule = max((r for r in rules if fits(r[0], r[1])), key=lambda r: len(r[0] + r[1]), default=None)
    if rule:
        return host, path, rule[0] + rule[1], rule[2]
    return host, path, None, "block" if any(fits(h, p) for h, p in listed) else "allow"


def test_urls_are_judged_as_by_hand(spark):
    rng = random.Random(1)
    hosts = ["example.net", "a.Example.NET", "net", "xnet", "example.com", "w.example.com", "org", "b.org", "spam-farm.example.org", "x.spam-farm.example.org", ""]
    paths = ["", "/", "/en/", "/en", "/de/x?y", "/fr/#z", "?q=/en/", "#/", "/EN/"]
    urls = [None, "", "no scheme", "://", "a://b://c/d"] + [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[9], "h"), (9, urls[9], "h")], "page_id long, url string, host string")
    got = U.judge_urls(pages, U.entry_table(spark, U.RULES, U.LISTED))
    want = [(i, *judged_by_hand(u, U.RULES, U.LISTED)) for i, u in enumerate(urls)]
    want += [(None, *want[9][1:]), want[9]]
    assert rows_of(got) == sorted(want, key=repr)
    assert U.judge_urls(pages.limit(0), U.entry_table(spark, U.RULES, U.LISTED)).count() == 0
    nothing = U.entry_table(spark, U.RULES, U.LISTED).limit(0)
    assert {r["verdict"] for r in U.judge_urls(pages, nothing).collect()} == {"allow"}


def test_urls_with_a_long_list(spark, monkeypatch):
    hosts = ["example.net", "a.b.example.net", "casino-win.example.com", "x.spam-farm.example.org", "free.org", ""]
    urls = [None, "no scheme"] + [f"https://{h}{p}" for h in hosts for p in ("", "/", "/en/x", "/fr/", "/de/")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(2, urls[2]), (None, urls[5])], "page_id long, url string")
    want = [(i, *judged_by_hand(u, U.RULES, U.LISTED)) for i, u in enumerate(urls)]
    want += [want[2], (None, *want[5][1:])]
    monkeypatch.setattr(U, "BROADCAST_ENTRIES", 0)
    got = U.judge_urls(pages, U.entry_table(spark, U.RULES, U.LISTED))
    assert "Broadcast" not in got._jdf.queryExecution().optimizedPlan().toString() and "salt" in got._jdf.queryExecution().analyzed().toString()
    assert rows_of(got) == sorted(want, key=repr)


# ---- pipeline --------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "secret_scans", "best_fit_packing"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns
