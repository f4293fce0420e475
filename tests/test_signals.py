import math

from pyspark.sql import functions as F

from inkgauge.operators import signals as G
from inkgauge.operators import style as S
from inkgauge.sources import staging


def test_spec_has_41_signals_for_each_language(spark):
    rows = G.spec(spark).groupBy("code").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 6).alias("w")).collect()
    assert {(r["code"], r["n"], r["w"]) for r in rows} == {(c, 41, 29.8) for c in S.LANGUAGES}
    assert len(G.signal_names()) == 41


def test_surprisal_of_ranks_and_unknown_words(spark):
    df = spark.createDataFrame([(1, "x"), (100, "x"), (None, "four"), (None, "ab")], "rank int, word string")
    got = [r[0] for r in df.select(G.surprisal(F.col("rank"), F.col("word"))).collect()]
    assert [round(x, 4) for x in got] == [4.7754, 9.9058, 13.7040, 13.1640]


def test_syllables(spark):
    for code, cases in {"en": {"the": 1, "making": 2, "banana": 3, "": 0}, "es": {"casa": 2, "país": 2, "leer": 2, "baúl": 2, "causa": 2, "bueno": 2, "aérea": 4}}.items():
        df = spark.createDataFrame([(w,) for w in cases], "w string")
        assert {r[0]: r[1] for r in df.select("w", G.syllables(F.col("w"), code)).collect()} == cases


def test_moving_ratio_equals_brute_force(spark):
    rows = [(1, " ".join(f"w{'abcdefg'[i * i % 7]}{'xyz'[i % 3]}" for i in range(130)) + "."), (2, "one two one."), (3, None), (None, "no key here.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["mattr"] for r in G.mattr(docs).collect()}
    words = rows[0][1].rstrip(".").split()
    want = sum(len(set(words[i : i + 50])) / 50 for i in range(len(words) - 49)) / (len(words) - 49)
    assert math.isclose(got[1], want) and math.isclose(got[2], 2 / 3) and 3 not in got


def test_scores_stay_in_range_and_held_signals_weigh_nothing(spark):
    text = "We walked to the shop and it was closed. However, the owner was seen outside! Don't ask me why, I can't say. " * 6
    rows = [(1, text, 1), (2, None, 1), (3, "", 1), (4, "Короткий русский текст " * 20, 1), (5, "A word.", 1), (None, text, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int")
    lexicon = spark.createDataFrame([("en", "the", 1), ("en", "and", 2), ("en", "it", 3)], "code string, word string, rank int")
    wide = G.document_signals(docs, lexicon)
    rows = G.signals_long(wide).cache()
    assert rows.groupBy("doc_id").count().where("count <> 41").count() == 0
    assert rows.where("held AND (weight <> 0 OR evidence <> 0)").count() == 0 and rows.where("abs(evidence) > 2.5 OR value IS NULL").count() == 0
    scores = {r["doc_id"]: r for r in G.index_scores(wide, rows).collect()}
    assert set(scores) == {1, 5} and all(0 < r["index"] < 1 for r in scores.values())
    w = {r["signal"]: r["value"] for r in rows.where("doc_id = 1").collect()}
    assert w["contraction"] > 0 and w["discourse"] > 0 and math.isclose(w["exclaimQ"], 1 / 3) and math.isclose(w["passive"], 2 / 3)  # "was closed" and "was seen"


def test_words_of_a_prepared_corpus_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(i, f"The word {'abc'[i % 3]} comes twice, and twice it comes. One more sentence is here.") for i in range(30)], "doc_id long, text string")
    corpus = G.corpus(docs)
    lexicon = spark.createDataFrame([("en", "the", 1)], "code string, word string, rank int")
    for made in (G.rep5(corpus), G.mattr(corpus), G._word_signals(corpus, lexicon)):
        made.count()
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and made.count() == 30
    table = staging.table_of(f"{corpus.folder.root}/texts")
    assert spark.catalog.tableExists(table)
    corpus.drop()
    assert not spark.catalog.tableExists(table)


def test_markers_and_trims_equal_plain_ones(spark):
    rows = [("however, in addition to that enthusiasm",), ("",), (None,), ("moreover it is important to note that thus",)]
    kinds = {"dms": S.V.DISCOURSE, "hgs": S.V.HEDGES}
    got = spark.createDataFrame(rows, "low string").select("low", S.markers_in(F.col("low"), F.lit("en"), kinds).alias("m")).collect()
    for r in got:
        for k, lists in kinds.items():
            assert (r["m"] and r["m"][k]) == (None if r["low"] is None else [m for m in S._listed(lists["en"]) if m in r["low"]])
    assert spark.range(1).select(S.trimmed(F.lit(" \n a b \t　")).alias("x")).first()[0] == "a b"


def test_syllables_of_texts_in_several_languages(spark):
    rows = [("the making banana", "en", 6), ("causa  bueno", "es", 4), ("maisons parlent", "fr", 3), ("", "pt", 0), (None, "en", None), ("1 2", "en", 0), ("making", "de", 2), ("making", None, 2)]
    df = spark.createDataFrame(rows, "w string, code string, want int")
    assert all(r["got"] == r["want"] for r in df.select("want", G.syllables(F.col("w"), F.col("code")).alias("got")).collect())


def test_listed_words_and_guarded_patterns(spark):
    lists = {(r["code"], r["word"]): r for r in G._listed_words(spark).collect()}
    for k, words in G.LISTS.items():
        for c in S.LANGUAGES:
            assert {w for (code, w), r in lists.items() if code == c and r[k]} == set(S._listed(words[c]))
    texts = ["It WAS ſeen by me.", "İs done", "The ı and we", "nothing here", "was", "He was quickly shown it. Us."]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for p in (G.G.PASSIVE["en"], G.G.FIRST_PERSON_IN["en"]):
        got = df.select(F.regexp_like("x", G._pattern(p, G._begins(p))).alias("a"), F.regexp_like("x", G._pattern(p)).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in got) and any(r["a"] for r in got)


def test_languages_are_told_once_for_each_text(spark):
    docs = spark.createDataFrame([(i, "The plan is however known to all of us and it was seen by them. " * 3) for i in range(4)], "doc_id long, text string")
    d = S.detected(S.unique(docs)).withColumn("low", F.lower("text"))
    d = d.withColumn("m", S.markers_in(F.col("low"), F.col("measured"), G.KINDS))
    # Behind a helper the ranking of languages was worked out anew for each mention.
    assert d._jdf.queryExecution().optimizedPlan().toString().count("sort_array") == 1 and d.where("size(m.dms) > 0").count() == 4


def test_marks_and_words_are_counted_in_one_pass(spark):
    text = "# Head\n- one item,two\n\n  2) Next.Now . Well?? the the ONe **bold x** end.  It is so “odd” — that's 'it'.​\n#\n# x\n\x0b a) b\n"
    docs = spark.createDataFrame([(1, text), (2, "\n \n"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r.asDict() for r in S.typography(docs).collect()}
    assert got[1] == {"doc_id": 1, "dashes": 1, "curly": 2, "straight": 3, "wide_gaps": 1, "gaps": 2, "odd_spaces": 1, "heads": 3, "lines": 6, "items": 3}
    assert all(v == 0 for k in (2, 3) for c, v in got[k].items() if c != "doc_id")
    words = "we saw that old red house and then we saw that old red house again. it is late. " * 3
    docs = spark.createDataFrame([(1, words), (2, "one two three.")], "doc_id long, text string")
    corpus = G.corpus(docs)
    few = spark.createDataFrame([("en", "we", 1), ("en", "saw", 2)], "code string, word string, rank int")
    made = G._text_signals(corpus, few)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and not any(x in plan for x in ("Join", "Window", "Aggregate"))
    # The same sums where the lexicon is joined.
    joined = {r["doc_id"]: r for r in G._joined_word_signals(corpus, few).collect()}
    for r in made.collect():
        assert all(math.isclose(r[c], joined[r["doc_id"]][c], abs_tol=1e-12) for c in joined[r["doc_id"]].asDict())
    lines = [x.split() for x in ("we saw that old red house and then we saw that old red house again\nit is late\n" * 3).splitlines()]
    runs = [" ".join(x[i : i + 5]) for x in lines for i in range(len(x) - 4)]
    top = sorted(dict.fromkeys(runs), key=lambda g: -runs.count(g))[:8]
    assert [(r["gram"], r["c"]) for r in G.top_grams(corpus).where("doc_id = 1").orderBy("rank").collect()] == [(g, runs.count(g)) for g in top]


def test_sentences_are_looked_at_by_simple_patterns(spark):
    texts = ["It WAS ſeen by me.", "İs done", "The ı and we", "nothing here", "He was quickly shown it. Us.", "Se dice que", "je l'ai vu", "nós fomos vistos", "était très vite pris", None]
    df = spark.createDataFrame([(x, c) for x in texts for c in (*S.LANGUAGES, "de")], "x string, c string")
    for patterns in (G.G.PASSIVE, G.G.FIRST_PERSON_IN):
        plain = S.by_language(F.col("c"), {c: F.regexp_like("x", G._pattern(p)) for c, p in patterns.items()})
        rows = df.select("x", "c", plain.alias("a"), G.H.fits(F.col("x"), F.col("c"), {c: G._simple(p) for c, p in patterns.items()}).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows), [r for r in rows if r["a"] != r["b"]]


def test_moving_ratio_looks_at_all_words_of_long_documents(spark):
    # 900 sentences of 30 words, which every second sentence and the first 20,000 words do not tell.
    sents = [" ".join(f"{'abc'[i % 3]}{'xyzuvw'[(i * j) % 6]}{'klmn'[j % 4] if i % 2 else 'o'}" for j in range(30)) for i in range(900)]
    docs = spark.createDataFrame([(1, ". ".join(x.capitalize() for x in sents) + ".", "en")], "doc_id long, text string, lang string")
    words = " ".join(sents).split()
    mean = lambda ws: sum(len(set(ws[i : i + 50])) / 50 for i in range(len(ws) - 49)) / (len(ws) - 49)
    corpus, want = G.corpus(docs, "lang"), mean(words)
    lexicon = spark.createDataFrame([("en", "ax", 1)], "code string, word string, rank int")
    wide = G.document_signals(corpus, lexicon).first()
    assert wide["sentences"] == 900 and math.isclose(wide["mattr"], want) and math.isclose(G.mattr(corpus).first()["mattr"], want)
    few = G.mattr(corpus, sample=G.SAMPLE).first()["mattr"]
    assert math.isclose(few, mean(" ".join(sents[::2]).split())) and abs(few - want) > 0.01
