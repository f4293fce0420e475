"""The scoring API, prepared tables, report texts and what else is said of documents, against SQL and by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from inkgauge.operators import reports as R
from inkgauge.operators import scoring as T
from inkgauge.operators import signals as G
from inkgauge.operators import style as S
from inkgauge.plans import oracles
from inkgauge.plans import prepared as P

ENGLISH = "However, it is important to note that the plan may work. We don't know — “perhaps” it can. It was seen by all of us! " * 9
SPANISH = "de la que el en y a los se del las un por con no una su para es al. Es importante destacar que podría ser; en el mundo actual me gusta. " * 3
PORTUGUESE = "No entanto, é importante notar que o plano pode não ser o que você tem em mãos, mas eu já vi isso.  Foi feito por ela com muito cuidado, e nós temos uma ideia. " * 4
GERMAN = "der Hund und die Katze sind nicht in dem Haus und sie haben auch ein Buch für den Mann das ist so " * 3
LIST = "\n".join(f"- point {x} of the list" for x in "abcdefghijkl") + "\n\n* the last of them is here"
ROWS = [(1, ENGLISH, None), (2, SPANISH, "xx"), (3, PORTUGUESE, None), (4, GERMAN, None), (5, GERMAN, "en"), (6, LIST, None), (7, "Короткий русский текст " * 20, None), (8, "A word.", None), (9, None, None),
        (10, "qzx wvk jjq " * 20, None), (1, ENGLISH, None), (6, "zzz the smaller text counts", None), (None, ENGLISH, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "s", 1) for r in ROWS], "doc_id long, text string, lang string, source string, index int").repartition(3)


@pytest.fixture(scope="module")
def con(docs):
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    return c


@pytest.fixture(scope="module")
def held(docs):
    return P.Prepared(docs)


def same(con, df, name):
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    want = sorted(repr(tuple(r)) for r in con.sql(oracles.SQL[name]).select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:2]
    return len(got)


def test_what_is_said_equals_sql(held, con, docs):
    assert same(con, S.detect_language(S.unique(docs)), "language_detect") == 10
    assert same(con, T.outcomes(held.corpus.languages, held.scores), "score_all") == 10
    assert same(con, G.sentence_offsets(held.corpus), "sentence_offsets") > 40
    assert same(con, R.ladder_detail(held.rows), "ladder_detail") == 41 * held.scores.count()
    assert same(con, R.sentence_readout(held.features), "sentence_readout")
    assert same(con, R.trace_ticks(G.trace_buckets(held.features)), "trace_ticks")
    assert same(con, R.register_totals(G.register_hits(held.corpus)), "register_totals")
    assert same(con, R.family_counts(held.rows), "family_counts") and same(con, R.held_signals(held.rows), "held_signals")
    assert same(con, T.languages(held.corpus, held.lexicon), "languages") == 4
    assert same(con, R.corpus_rollup(held.scores, docs), "corpus_rollup")
    lines = R.report_lines(held.wide, held.rows, G.register_hits(held.corpus), G.top_grams(held.corpus), held.corpus.languages)
    assert same(con, R.report_texts(lines), "report_text") == held.scores.count()


def test_signals_that_the_tables_keep_constant_move_here(held):
    values = {(r["doc_id"], r["signal"]): r["value"] for r in held.rows.collect()}
    for signal in ("emDash", "curly", "doubleSpace", "unicode", "listRate", "contraction", "regMark"):
        assert len({v for (_, s), v in values.items() if s == signal}) > 1, signal
    assert {r["code"] for r in held.scores.collect()} == {"en", "es", "pt"}


def test_sentences_lie_where_they_are_told_to(held):
    at = G.sentence_offsets(held.corpus).join(G.sentence_rows(held.corpus), ["doc_id", "sent_idx"]).join(held.corpus.docs.select("doc_id", "text"), "doc_id")
    assert at.where(F.col("sentence") != F.substring(F.col("text"), F.col("begin") + 1, F.col("length"))).count() == 0 < at.count()


def test_pinned_languages_and_refusals(docs):
    lexicon = docs.sparkSession.createDataFrame([("en", "the", 1), ("en", "and", 2)], "code string, word string, rank int")
    other = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("body"), "lang", F.col("source").alias("text"))
    got = {r["key"]: r for r in T.score(other, "body", "lang", "key", lexicon).collect()}
    assert set(got) == set(range(1, 11))
    assert got[5]["status"] == "pinned" and got[5]["code"] == "en" and got[5]["index"] and not got[5]["detected"] and got[5]["confidence"] is None
    assert got[2]["status"] == "ok" and 0 < got[2]["confidence"] <= 1
    assert got[4]["status"] == "unsupported" and "written in German" in got[4]["message"] and got[4]["index"] is None
    assert "Cyrillic" in got[7]["message"] and got[10]["status"] == "unknown" and got[8]["status"] == got[9]["status"] == "too_little"
    assert T.score(other.limit(0), "body", "lang", "key", lexicon).count() == 0


def test_report_of_a_list(held, tmp_path):
    lines = R.report_lines(held.wide, held.rows, G.register_hits(held.corpus), G.top_grams(held.corpus), held.corpus.languages, F.concat(F.lit("file "), F.col("doc_id").cast("string")), F.lit("2026-01-01T00:00:00Z"))
    texts = R.report_texts(lines).join(held.scores.select("doc_id", "code"), "doc_id")
    got = {r["doc_id"]: r["report"] for r in texts.collect()}
    assert "specimen: file 6\ngenerated: 2026" in got[6] and "DOCUMENT SHAPE WARNING" in got[6] and "100% of lines are bulleted" in got[6]
    assert "REGISTER MARKERS FOUND\n  9× \"it is important to note\"" in got[1] and got[1].endswith("alone.") and "Kandel" not in got[1]
    assert sum(line.startswith("  ") for line in got[2].split("| deviation\n")[1].split("REGISTER")[0].split("\n")) == 41
    R.write_reports(texts, str(tmp_path / "reports"))
    back = R.read_reports(held.docs.sparkSession, str(tmp_path / "reports"))
    assert {(r["code"], r["report"]) for r in back.collect()} == {(r["code"], r["report"]) for r in texts.collect()}


def test_numbers_as_reports_show_them(spark):
    df = spark.createDataFrame([(x,) for x in (123.456, 99.96, 12.345, -1.005, 0.0005, -0.0004, 0.0)], "x double")
    assert [r[0] for r in df.select(R.fmt(F.col("x"))).collect()] == ["123", "100.0", "12.3", "-1.01", "0.001", "-0.000", "0.000"]
    assert [r[0] for r in df.select(R.signed(F.col("x"), 1)).collect()] == ["+123.5", "+100.0", "+12.3", "-1.0", "+0.0", "-0.0", "+0.0"]


def test_prepared_tables_serve_while_files_stay(spark, docs, tmp_path):
    where = str(tmp_path)
    docs.where("doc_id < 4").write.parquet(f"{where}/documents.parquet")
    first = P.prepared(spark, where)
    scores = first.scores.count()
    assert P.prepared(spark, where) is first and scores == 3
    docs.where("doc_id = 8").write.mode("append").parquet(f"{where}/documents.parquet")
    second = P.prepared(spark, where)
    assert second is not first and second.scores.count() == 4
    folders = second.folders
    second.drop()
    assert folders and not any(P.staging.there(spark, f) for f in folders)


def test_progress_is_counted_on_the_way(docs):
    lexicon = docs.sparkSession.createDataFrame([("en", "the", 1)], "code string, word string, rank int")
    seen = []
    scores = T.score(docs.drop("index"), lexicon=lexicon, progress=lambda phase, counts: seen.append((phase, counts)))
    assert [p for p, _ in seen] == ["Segmenting", "Measuring", "Done"]
    assert seen[0][1]["documents"] == scores.count() == 10 and seen[0][1]["measured"] == 6
    assert seen[1][1]["sentences"] > 30 and seen[1][1]["words"] > seen[1][1]["sentences"]
