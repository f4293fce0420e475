"""What a report says of documents, from their signals and scores: sentences, ladders, shapes, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values
from ..functions import signal_values as V
from . import signals as G
from . import style as S

# What is said of a score (below so many percent) and of a sample.
VERDICTS = (
    (28, "This reads like a person wrote it."),
    (45, "This leans human, with some passages that read machine-like."),
    (58, "This could go either way. The bench genuinely cannot tell."),
    (75, "This leans machine-written, probably with human editing on top."),
    (101, "This reads like a machine wrote it."),
)
TRUST = {
    "insufficient": ("Insufficient sample", "The sample is far too short to mean anything. Treat it as noise."),
    "low": ("Low confidence", "The sample is short, so the number could easily be 20 points either way."),
    "moderate": ("Moderate confidence", "Enough text for a direction, not a verdict."),
    "high": ("Best available confidence", "The sample is long enough for the measurements to settle."),
}
# Why a signal is held, by the signals; and by language, where it is held in all its texts.
HOLDS = (
    (("zipfDev",), "needs 600+ words to fit a rank–frequency slope"),
    (("rep5",), "needs 300+ words before repetition means anything"),
    (("gradeSd",), "needs 3+ paragraphs of 25 words or more"),
    (("paraCv", "paraSentCv"), "needs 3+ paragraphs"),
    (("doubleSpace",), "needs 20+ sentence-ending periods"),
    (("sentKurt", "sentSkew"), "needs 12+ sentences"),
    (("flatRun",), "needs 8+ sentences"),
    (("hapax", "yulesK"), "needs 200+ words"),
    (("listRate",), "needs 6+ lines"),
)
NO_CONTRACTIONS = {
    "es": "Spanish has no optional contractions to count",
    "pt": "Portuguese contractions are grammatically mandatory",
    "fr": "French elision is mandatory, not a style choice",
}
# What a report says beside its numbers.
NOT_PROSE = (
    "!! DOCUMENT SHAPE WARNING: this is a list or outline, not flowing prose",
    "Text shaped like this scores human",
    "   almost automatically, whoever wrote it. The score above is not usable.",
)
CAVEAT = (
    "CAVEAT: this instrument measures style, not origin. It is not Turnitin, ZeroGPT or",
    "QuillBot and does not reproduce any proprietary classifier. Non-native writers,",
    "edited text, legal boilerplate, translations and short samples all read as more",
    "synthetic than they are. Do not take a decision affecting a person on this output",
    "alone.",
)
#: Bands of the two channels of a trace, the share that is added above and below, what parts written reports.
CHANNELS, PAD, REPORT_END = {"surp": (9.5, 11.7), "n": (11.0, 27.0)}, 0.12, "\f\n"
#: Sentences of a page.
PAGE = 260


def _chosen(choices: list[tuple[Column, str]]) -> Column:
    made = F.lit(None).cast("string")
    for fits, text in reversed(choices):
        made = F.when(fits, F.lit(text)).otherwise(made)
    return made


def plain_reading(scores: DataFrame) -> DataFrame:
    """doc_id, percent, human_percent, low, high, verdict, trust, confidence, from index_scores."""
    edge = lambda c: F.floor(c * 100 + 0.5).cast("int")
    verdict = _chosen([(F.col("percent") < n, text) for n, text in VERDICTS])
    named = lambda i: _chosen([(F.col("reliability") == k, v[i]) for k, v in TRUST.items()])
    return scores.select(
        "doc_id", "percent", (100 - F.col("percent")).alias("human_percent"), edge(F.greatest(F.lit(0.0), F.col("index") - F.col("half"))).alias("low"),
        edge(F.least(F.lit(1.0), F.col("index") + F.col("half"))).alias("high"), verdict.alias("verdict"), named(1).alias("trust"), named(0).alias("confidence"),
    )


def held_reason() -> Column:
    """Why a signal of the row's language is held."""
    short = _chosen([(F.col("signal").isin(*names), text) for names, text in HOLDS])
    return F.coalesce(short, F.when(F.col("signal") == "contraction", S.chosen(F.col("code"), NO_CONTRACTIONS)))


def held_signals(rows: DataFrame) -> DataFrame:
    """doc_id, signal, reason of the signals that are measured but do not count, from signals_long."""
    return rows.where("held").select("doc_id", "signal", held_reason().alias("reason"))


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals; halves go away from 0."""
    size = F.format_string(f"%.{places}f", F.round(F.abs(x) + 1e-10, places))
    return F.concat(F.when(x < 0, "-").otherwise(""), size)


def signed(x: Column, places: int) -> Column:
    return F.concat(F.when(x >= 0, "+").otherwise(""), fixed(x, places))


def fmt(x: Column) -> Column:
    """A number with decimals by its size."""
    a = F.abs(x)
    return F.when(a >= 100, fixed(x, 0)).when(a >= 10, fixed(x, 1)).when(a >= 1, fixed(x, 2)).otherwise(fixed(x, 3))


def _named(rows: DataFrame) -> DataFrame:
    """Adds label, unit, center and spread of signals to rows of signals_long; the reading ease keeps its English name."""
    labels = [[x.strip() for x in line.split(";")] for line in V.LABELS.strip().splitlines()]
    table = F.array(*[F.struct(F.lit(a).alias("signal"), F.lit(b).alias("label"), F.lit(c).alias("unit")) for a, b, c in labels])
    named = rows.sparkSession.range(1).select(F.explode(table).alias("x")).select("x.*")
    bands = G.spec(rows.sparkSession).select("code", "signal", "center", "spread")
    return rows.join(F.broadcast(named), "signal").join(F.broadcast(bands), ["code", "signal"])  # 41 and 164 rows


def _six(name: str) -> Column:
    return F.round(F.col(name) + 1e-10, 6)


def ladder_detail(rows: DataFrame) -> DataFrame:
    """doc_id, signal, label, observed, band, deviation, weight, reason: a ladder's rung in words, from signals_long.

    The reading ease has the name that it has in the language. Held signals have a reason in place of deviation and weight.
    """
    d = _named(rows).withColumns({"value": _six("value"), "dev": _six("dev")})
    ease = S.chosen(F.col("code"), {c: x[3] for c, x in fixed_values.LANGUAGE_NAMES.items()})
    unit = F.when(F.col("unit") != "", F.concat(F.lit(" "), F.col("unit"))).otherwise("")
    live = ~F.col("held")
    toward = F.concat(fixed(F.abs("dev"), 2), F.lit("σ toward "), F.when(F.col("dev") >= 0, "machine").otherwise("human"))
    return d.select(
        "doc_id", "signal", F.when(F.col("signal") == "flesch", ease).otherwise(F.col("label")).alias("label"), F.concat(fmt(F.col("value")), unit).alias("observed"),
        _band().alias("band"), F.when(live, toward).alias("deviation"), F.when(live, fixed(F.col("weight"), 1)).alias("weight"), F.when(~live, held_reason()).alias("reason"),
    )


def _band() -> Column:
    center, spread = F.round("center", 6), F.round("spread", 6)
    return F.concat(fmt(F.round(center - spread, 6)), F.lit("–"), fmt(F.round(center + spread, 6)))


def sentence_readout(features: DataFrame) -> DataFrame:
    """doc_id, sent_idx, readout, tint (toward), alpha: what is shown of a sentence, from sentence_features."""
    scores = G.sentence_scores(features)
    mean = F.avg("surp").over(Window.partitionBy("doc_id"))
    d = features.select("doc_id", "sent_idx", "dm", "rm", "passive", (F.col("surp") - mean).alias("delta")).join(scores, ["doc_id", "sent_idx"])
    many = lambda c, what: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {what} marker"), F.when(F.col(c) > 1, "s").otherwise("")))
    parts = F.array(
        F.concat(F.lit("sentence "), (F.col("sent_idx") + 1).cast("string")), F.concat(F.col("n").cast("string"), F.lit(" words")), F.concat(F.lit("surprisal "), fixed(F.col("surp"), 2), F.lit(" bits")),
        F.concat(F.lit("Δ "), signed(F.round(F.col("delta") + 1e-10, 6), 2)), many("dm", "discourse"), many("rm", "register"), F.when(F.col("passive") == 1, "passive"), F.concat(F.lit("stain "), fixed(F.col("score"), 2)),
    )
    away = F.round(F.abs(F.col("score") - 0.5), 6)
    return d.select(
        "doc_id", "sent_idx", F.array_join(parts, " · ").alias("readout"), F.when(F.col("score") >= 0.5, "machine").otherwise("human").alias("tint"),
        F.round(F.least(F.lit(0.26), away * 0.55) + 1e-10, 3).alias("alpha"),
    )


def trace_ticks(buckets: DataFrame) -> DataFrame:
    """doc_id, channel, low, high, mean, first_tick, last_tick: the axis of a trace, from trace_buckets."""
    out = None
    for name, (a, b) in CHANNELS.items():
        low, high = F.least(F.lit(a), F.min(name)), F.greatest(F.lit(b), F.max(name))
        d = buckets.groupBy("doc_id").agg(low.alias("a"), high.alias("b"), F.avg(name).alias("mean"))
        d = d.select("doc_id", F.lit(name).alias("channel"), (F.col("a") - (F.col("b") - F.col("a")) * PAD).alias("low"), (F.col("b") + (F.col("b") - F.col("a")) * PAD).alias("high"), "mean")
        step = (F.col("high") - F.col("low")) * PAD
        six = lambda c: F.round(c + 1e-10, 6)
        d = d.select("doc_id", "channel", six(F.col("low")).alias("low"), six(F.col("high")).alias("high"), six(F.col("mean")).alias("mean"), six(F.col("low") + step).alias("first_tick"), six(F.col("high") - step).alias("last_tick"))
        out = d if out is None else out.unionByName(d)
    return out


def register_totals(hits: DataFrame) -> DataFrame:
    """doc_id, markers, hits: the sums over the markers that register_hits keeps."""
    return hits.groupBy("doc_id").agg(F.count("*").alias("markers"), F.sum("c").alias("hits"))


def family_counts(rows: DataFrame) -> DataFrame:
    """doc_id, family, signals, live: how many signals a family has and how many of them count, from signals_long."""
    return rows.groupBy("doc_id", "family").agg(F.count("*").alias("signals"), F.count_if(~F.col("held")).alias("live"))


def report_lines(wide: DataFrame, rows: DataFrame, hits: DataFrame, grams: DataFrame, languages: DataFrame | None = None, specimen: Column | None = None, generated: Column | None = None) -> DataFrame:
    """doc_id, section, place, line: a report's lines in order, from document_signals, signals_long, register_hits and top_grams.

    ``languages`` (doc_id, status) tells pinned languages, ``specimen`` what a report is called (its doc_id, else) and
    ``generated`` when it was made. Numbers are those of the other queries, to six places, cut to what a report shows.
    """
    scores = G.index_scores(wide, rows)
    stats = wide.select("doc_id", "types", "sentences", "paras", *[_six(c).alias(c) for c in ("sentMean", "surpMean", "surpSd", "zipfSlope", "flesch")])
    reasons = shape_reasons(wide).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "reason"))), lambda x: x["reason"]), ", ").alias("reasons"))
    d = plain_reading(scores).select("doc_id", "human_percent", "low", "high").join(scores, "doc_id").join(stats, "doc_id").join(reasons, "doc_id", "left")
    if languages is not None:
        d = d.join(languages.select("doc_id", "status"), "doc_id")
    manual = F.col("status") == "pinned" if languages is not None else F.lit(False)
    name = lambda i: S.chosen(F.col("code"), {c: x[i] for c, x in fixed_values.LANGUAGE_NAMES.items()})
    text = lambda c: F.col(c).cast("string")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    shape = lambda line: F.when(~F.col("prose"), line)
    made = [
        F.lit("STYLOMETRIC REPORT"), say("specimen: ", specimen if specimen is not None else text("doc_id")), *([say("generated: ", generated)] if generated is not None else []), F.lit(""),
        say("PLAIN READING: ", text("human_percent"), "% human / ", text("percent"), "% AI — ", F.lower("band")),
        shape(F.lit("")), shape(F.lit(NOT_PROSE[0])), shape(say("   (", F.coalesce("reasons", F.lit("")), "). ", NOT_PROSE[1])), shape(F.lit(NOT_PROSE[2])), F.lit(""),
        say("MACHINE-STYLE SCORE: ", text("percent"), "%   (95% CI ", text("low"), "%–", text("high"), "%)"), say("reading: ", F.col("band")), say("sample reliability: ", F.col("reliability")),
        say("language: ", name(0), " (", name(1), "), ", F.when(manual, "set manually").otherwise("auto-detected"), F.when(name(2) == "secondary", ", reference bands less calibrated than English").otherwise("")),
        say("underlying index: ", fixed(F.col("index"), 3), " on 0–1"), F.lit(""),
        say("words ", text("words"), " · types ", text("types"), " · sentences ", text("sentences"), " · paragraphs ", text("paras")),
        say("mean sentence ", fixed(F.col("sentMean"), 1), "w · surprisal ", fixed(F.col("surpMean"), 2), "±", fixed(F.col("surpSd"), 2), " bits · Zipf slope ", fixed(F.col("zipfSlope"), 3), " · ", name(3), " ", fixed(F.col("flesch"), 1)),
        F.lit(""), F.lit("FAMILY SCORES  (−1 human … +1 machine)"),
    ]
    head = d.select("doc_id", F.lit(0).alias("section"), F.posexplode(F.array(*made)).alias("place", "line")).where("line IS NOT NULL")
    first = rows.groupBy("doc_id", "family").agg(F.min("place").alias("place"))
    families = G.family_scores(rows).join(first, ["doc_id", "family"]).select("doc_id", F.lit(1).alias("section"), "place", say("  ", F.rpad("family", 16, " "), " ", signed(F.col("score"), 2)).alias("line"))
    dev = say(signed(F.col("dev"), 2), "σ", F.when(F.col("dev") > 1, "  << machine").when(F.col("dev") < -1, "  << human").otherwise(""))
    rung = say("  ", F.rpad("label", 30, " "), " ", F.lpad(fmt(F.col("value")), 9, " "), " | ", _band(), " | ", F.when(F.col("held"), say("held neutral (", held_reason(), ")")).otherwise(dev))
    named = _named(rows).withColumns({"value": _six("value"), "dev": _six("dev")}).select("doc_id", F.lit(3).alias("section"), "place", rung.alias("line"))
    counted = lambda df, section, what: df.select("doc_id", F.lit(section).alias("section"), F.col("rank").alias("place"), say("  ", text("c"), "× \"", F.col(what), "\"").alias("line"))

    def titles(df: DataFrame, section: int, *lines: str) -> DataFrame:
        return df.select("doc_id").distinct().select("doc_id", F.lit(section).alias("section"), F.posexplode(F.array(*map(F.lit, lines))).alias("place", "line"))

    ends = d.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("section"), F.lit(i).alias("place"), F.lit(t).alias("line")) for k, lines in (
        (2, ("", "PARAMETERS  observed | human reference band | deviation")), (8, ("", *CAVEAT))) for i, t in enumerate(lines)])).alias("x")).select("doc_id", "x.*")
    out = head
    for part in (families, ends, named, titles(hits, 4, "", "REGISTER MARKERS FOUND"), counted(hits, 5, "marker"), titles(grams, 6, "", "REPEATED 5-GRAMS"), counted(grams, 7, "gram")):
        out = out.unionByName(part.withColumn("place", F.col("place").cast("int")))
    return out


def report_texts(lines: DataFrame) -> DataFrame:
    """doc_id, report: the lines of each document as one text; a report has some 100 lines at most."""
    rows = F.array_sort(F.collect_list(F.struct("section", "place", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("report"))


def write_reports(reports: DataFrame, path: str, by: str = "code") -> None:
    """Writes reports (``by``, report) as files of text, a folder for each value of ``by``; ``REPORT_END`` parts them."""
    reports.select(by, "report").write.mode("overwrite").partitionBy(by).option("lineSep", REPORT_END).text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The reports of ``write_reports``: report and the column that they were parted by."""
    return spark.read.option("lineSep", REPORT_END).text(path).withColumnRenamed("value", "report")


def ladder(rows: DataFrame) -> DataFrame:
    """doc_id, signal, position (0 to 100), strong, low, high (the human band), toward, from signals_long."""
    bands = F.broadcast(G.spec(rows.sparkSession).select("code", "signal", "center", "spread"))  # 164 rows
    place = (F.col("evidence") + 2.5) / 5 * 100
    return rows.join(bands, ["code", "signal"]).select(
        "doc_id", "signal", F.round(place + 1e-10, 6).alias("position"), (F.abs("evidence") > 1).alias("strong"), F.round(F.col("center") - F.col("spread"), 6).alias("low"),
        F.round(F.col("center") + F.col("spread"), 6).alias("high"), F.when(F.col("held"), "held").when(F.col("dev") >= 0, "machine").otherwise("human").alias("toward"),
    )


def document_stats(wide: DataFrame) -> DataFrame:
    """doc_id, code and the totals of a document, from document_signals."""
    six = lambda c: F.round(F.col(c) + 1e-10, 6).alias(c)
    long = lambda c: F.col(c).cast("long").alias(c)
    return wide.select("doc_id", "code", long("chars"), long("words"), long("types"), long("sentences"), long("paras"), long("syll"), *map(six, ("flesch", "zipfSlope", "surpMean", "surpSd", "sentMean")))


def shape_reasons(wide: DataFrame) -> DataFrame:
    """doc_id, place, reason: what speaks against flowing prose, from document_signals."""
    per = F.col("words") / F.greatest(F.col("para_lens"), F.lit(1))
    percent = lambda c: F.floor(F.col(c) * 100 + 0.5).cast("int").cast("string")
    told = F.array(
        F.when(F.col("listRate") > 0.3, F.concat(percent("listRate"), F.lit("% of lines are bulleted or numbered"))),
        F.when((per < 12) & (F.col("paras") > 8), F.concat(F.lit("paragraphs average only "), F.floor(per + 0.5).cast("int").cast("string"), F.lit(" words"))),
        F.when(F.col("tiny") > 0.42, F.concat(percent("tiny"), F.lit("% of sentences are under six words"))),
        F.when(F.col("open_ended") > 0.5, F.concat(percent("open_ended"), F.lit("% of lines end without punctuation"))),
    )
    return wide.select("doc_id", F.posexplode(told).alias("place", "reason")).where("reason IS NOT NULL")


def paragraph_rows(docs: DataFrame) -> DataFrame:
    """doc_id, para_idx, words, para: the paragraphs of every document that is measured; narrow after detection."""
    rows = G.corpus(docs).docs.select("doc_id", F.posexplode(G.paragraphs(F.col("text"))).alias("para_idx", "para"))
    return rows.select("doc_id", "para_idx", F.size(S.words(F.col("para"))).alias("words"), "para")


def plate_pages(docs: DataFrame) -> DataFrame:
    """doc_id, page, block, sentences: pages of ``PAGE`` sentences; a blank line before a sentence begins a block."""
    doc = Window.partitionBy("doc_id").orderBy("sent_idx")
    paged = G.sentence_rows(docs).select("doc_id", "sent_idx", F.floor(F.col("sent_idx") / PAGE).alias("page"), "nl")
    page = Window.partitionBy("doc_id", "page").orderBy("sent_idx")
    fresh = (F.col("nl") >= 2) & (F.row_number().over(page) > 1)
    told = paged.withColumn("fresh", fresh.cast("int")).withColumn("block", F.sum("fresh").over(page))
    return told.groupBy("doc_id", "page", "block").agg(F.count("*").alias("sentences"))


def corpus_rollup(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """level, code, source, documents, words, index: means of each language and source (level 0), language (1) and of all (3)."""
    sources = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("source").alias("source"))
    rows = scores.join(sources, "doc_id")
    level = F.grouping_id().cast("int").alias("level")
    return rows.rollup("code", "source").agg(level, F.count("*").alias("documents"), F.sum("words").alias("words"), F.round(F.avg("index") + 1e-10, 6).alias("index"))
