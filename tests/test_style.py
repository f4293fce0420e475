from pyspark.sql import functions as F

from inkgauge.operators import style as S
from inkgauge.sources import staging


def test_sentences(spark):
    rows = [
        (1, "Dr. Smith came. He left e.g. early! Was it 3.5 percent? \"Yes.\" Done"),
        (2, None),
        (3, "So do I. Then we wait... and go. Version 2. 5 apples. Fine."),
    ]
    found: dict = {}
    for r in S.sentences(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", "sent_idx").collect():
        found.setdefault(r["doc_id"], []).append(r["sentence"])
    assert found[1] == ["Dr. Smith came.", "He left e.g. early!", "Was it 3.5 percent?", '"Yes."', "Done"]
    assert found[3] == ["So do I. Then we wait... and go.", "Version 2. 5 apples.", "Fine."]
    assert 2 not in found


def test_language(spark):
    english = "the cat and the dog were in the house and they have been there for a long time with all of us " * 2
    german = "der Hund und die Katze sind nicht in dem Haus und sie haben auch ein Buch für den Mann das ist so " * 2
    rows = [(1, english), (2, german), (3, "too short"), (4, None), (5, "Привет это русский текст " * 10)]
    got = {r["doc_id"]: (r["status"], r["code"]) for r in S.detect_language(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("ok", "en"), 2: ("unsupported", None), 3: ("too_short", None), 4: ("too_short", None), 5: ("unsupported", None)}


def test_texts_of_one_row_group_are_dealt(spark, tmp_path):
    # The file has many splits, all of them empty but one.
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(400)), lambda i: F.sha2(F.concat(F.col("doc_id"), F.lit("-"), i), 256)))
    spark.range(2000).withColumnRenamed("id", "doc_id").withColumn("text", text).coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(str(tmp_path / "documents.parquet"))
    docs = staging.read(spark, str(tmp_path))
    assert docs.rdd.getNumPartitions() >= 8
    assert staging.tasks(docs) == -(-2000 * (400 * 65 - 1) // staging.TASK_BYTES)
    assert S.unique(docs).groupBy(F.spark_partition_id()).count().count() == staging.tasks(docs)
    words = S.word_freq(docs)
    assert words._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1 and words.agg(F.sum("n")).first()[0] > 0
