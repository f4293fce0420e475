"""The 41 signals of a document, their standardised evidence and the index.

``corpus`` detects languages and splits sentences and words once, into a written table; what is
measured reads the columns that it needs from there. Sentences, word frequencies and paragraphs
are each aggregated to a row per document before they meet, so joins carry documents'
measurements and never their texts. The ranked lexicon of surprisal is a parameter (code, word,
rank); ``corpus_lexicon`` makes one from the corpus, ``read_lexicon`` reads one.

Operators that take documents keep to rows with a doc_id, one each (``style.unique``): repeated
rows count once. Documents of refused languages and without sentences give no rows. Null and
empty texts have no sentences. Other columns of the documents are not read.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed_values as V
from ..functions import signal_values as G
from ..functions import word_helpers as H
from . import style as S
from ..sources.staging import Staging, tasks

#: Words of each language in a lexicon made from the corpus.
LEXICON_WORDS = 600
#: The slope of frequencies is fitted to so many ranks at most.
ZIPF = 600
#: Where the moving ratio is asked of a sample: so many sentences, and words before the last of them.
SAMPLE = (400, 20_000)
#: A lexicon of so many rows at most is broadcast.
BROADCAST_ROWS = 200_000

# The rank-frequency law, with its constant over 60,000 ranks.
SHIFT, SLOPE, RANKS = 2.7, 1.07, 60_000
SCALE = 0.97 / sum((r + SHIFT) ** -SLOPE for r in range(1, RANKS + 1))

_SPACE = S.SPACE
# Without regard to case, as classes that look at both cases take several times as long.
_EDGE = r"(?-iu:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


@lru_cache(1)
def _cases() -> dict[str, set[str]]:
    """Characters by what they begin with in either case."""
    found: dict[str, set[str]] = {}
    for x in map(chr, range(1, 0xD800)):
        for b in {x, x.lower()[:1]}:
            found.setdefault(b, set()).add(x)
        found.setdefault("up " + x.upper()[:1], set()).add(x)
    return found


def _pattern(text: str, begin: str = "") -> Column:
    """A pattern with ASCII word edges, in either case; it fits only where one of the characters of ``begin`` stands, if there are any."""
    # All that has a case in common with those characters, told before edges are looked at.
    near = "".join(sorted({x for b in begin for x in _cases().get(b, set()) | _cases().get("up " + b.upper(), set())}))
    return F.lit((f"(?=[{near}])" if near else "") + "(?iu)" + text.replace(r"\b", _EDGE).replace(r"\s", _SPACE))


def _simple(text: str) -> str:
    """The same pattern for helpers: classes keep to their case, and letters that have an i as their other case are told."""
    return "(?i)" + re.sub("[iI]", "[iİı]", text).replace(r"\s", f"[{S.SPACES}]").replace(r"\w", r"(?-i:\w)")


def _begins(words: str) -> str:
    """The first characters of the words of a pattern's first group."""
    return "".join(sorted({w[0] for w in words[words.index("(") + 1 : words.index(")")].split("|")}))


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def spec(spark) -> DataFrame:
    """code, signal, place, family, center, spread, dir, weight: 41 rows for each language."""
    own = {}
    for line in G.BANDS.strip().splitlines():
        name, *bands = (x.strip() for x in line.split("|"))
        own |= {(c, name): b.split("/") for c, b in zip(S.LANGUAGES[1:], bands, strict=True) if b != "-"}
    rows = []
    for place, line in enumerate(G.SIGNALS.strip().splitlines()):
        name, family, center, spread, direction, weight = (x.strip() for x in line.split("|"))
        for code in S.LANGUAGES:
            a, b = own.get((code, name), (center, spread))
            rows.append((code, name, place, family, float(a), float(b), int(direction), float(weight)))
    values = F.array(*[F.struct(*map(F.lit, r)) for r in rows])
    return spark.range(1).select(F.explode(values).alias("x")).select("x.*").toDF("code", "signal", "place", "family", "center", "spread", "dir", "weight")


class Corpus:
    """Documents whose texts are prepared once, in a written table.

    docs: doc_id, code, text, sents (sentence, nl, tok: words in lower case),
    dms, rms, hgs (the markers of each kind that the text holds) of the documents that are measured;
    languages: doc_id, status, code, top, confidence, margin, name, enough (whether a text is long enough to be examined) of all.
    """

    def __init__(self, prepared: DataFrame, name: str = "texts", folder: Staging | None = None, buckets: int | None = None):
        self.docs = prepared.where("measured IS NOT NULL").select("doc_id", F.col("measured").alias("code"), "text", "sents", *KINDS)
        self.languages = prepared.select("doc_id", "status", "code", "top", "confidence", "margin", "name", "measured", "enough")
        self.name, self.folder, self.buckets = name, folder, buckets

    def drop(self) -> None:
        """Deletes the written table."""
        if self.folder is not None:
            self.folder.drop(self.name)


# Kinds of markers.
KINDS = {"dms": V.DISCOURSE, "rms": V.REGISTER, "hgs": V.HEDGES}


def _segmented(docs: DataFrame, lang_col: str | None = None, buckets: int | None = None) -> DataFrame:
    """The columns of ``S.detected`` and seg: a text's segments, null for refused documents. Nothing is written."""
    d = S.once(S.detected(S.unique(docs, *([lang_col] if lang_col else []), tasks=buckets), lang_col))
    return d.select("*", F.when(F.col("measured").isNotNull(), S.segments(F.col("text"), F.col("measured"))).alias("seg"))


def _lowered(segment: Column) -> Column:
    return F.transform(S.words(segment), F.lower)


def corpus(docs: DataFrame | Corpus, lang_col: str | None = None, watch: Observation | None = None) -> Corpus:
    """Detects, splits and saves documents; a corpus stays as it is. ``watch`` gets how many documents there are and are measured."""
    if isinstance(docs, Corpus):
        return docs
    buckets = tasks(docs)
    # Refused documents keep their row, without a text.
    d, kept = _segmented(docs, lang_col, buckets), F.col("measured").isNotNull()
    d = d.select("*", F.when(kept, F.lower("text")).alias("low"))

    def sentence(x: Column) -> Column:
        feeds = F.regexp_count(F.regexp_extract(x, f"^({_SPACE}*)", 1), F.lit("\n"))
        return F.struct(S.trimmed(x).alias("sentence"), feeds.alias("nl"), _lowered(x).alias("tok"))

    # A marker that no text of a document holds is in none of its sentences.
    d = d.withColumn("marks", S.markers_in(F.col("low"), F.col("measured"), KINDS))
    made = d.select("doc_id", "status", "code", "top", "confidence", "margin", "name", "measured", F.when(kept, F.col("text")).alias("text"), F.transform("seg", sentence).alias("sents"), *[F.col(f"marks.{k}").alias(k) for k in KINDS], S.enough(F.col("text")).alias("enough"))
    if watch is not None:
        made = made.observe(watch, F.count(F.lit(1)).alias("documents"), F.count("measured").alias("measured"))
    folder = Staging(docs.sparkSession, "corpus")
    return Corpus(folder.save(made, "texts", by="doc_id", buckets=buckets, dealt=True), "texts", folder, buckets)


def sentence_rows(docs: DataFrame | Corpus, *others: str) -> DataFrame:
    """doc_id, code, sent_idx, sentence, nl, tok, and columns of the documents."""
    return corpus(docs).docs.select("doc_id", "code", *others, F.posexplode("sents").alias("sent_idx", "x")).select("doc_id", "code", *others, "sent_idx", "x.*")


def corpus_lexicon(docs: DataFrame | Corpus, size: int = LEXICON_WORDS, lang_col: str | None = None) -> DataFrame:
    """code, word, rank: the most frequent words of each language, ties in the order of letters. Of documents no text is written."""
    if isinstance(docs, Corpus):
        tokens = _tokens(docs)
    else:
        tokens = _segmented(docs, lang_col).select(F.col("measured").alias("code"), F.explode("seg").alias("seg")).select("code", _lowered(F.col("seg")).alias("tok"))
    n = tokens.select("code", F.explode("tok").alias("word")).groupBy("code", "word").count()
    # Only the first ranks are wanted, so each task keeps no more than those.
    order = Window.partitionBy("code").orderBy(F.desc("count"), "word")
    ranked = n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("code", "word", "rank")
    return Staging(n.sparkSession, "lexicon").save(ranked, "ranks")


def read_lexicon(spark, path: str) -> DataFrame:
    """code, word, rank from a text file: ``code<tab>word`` lines, a language's most frequent words first.

    A word's rank is its place among the lines of its language; of repeated words the first counts.
    """
    lines = spark.read.option("wholetext", True).text(path).select(F.posexplode(F.split("value", "\n")).alias("at", "line"))
    rows = lines.select("at", F.split("line", "\t").alias("x")).where(F.size("x") == 2).select("at", F.col("x")[0].alias("code"), F.lower(S.trimmed(F.col("x")[1])).alias("word"))
    placed = rows.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy("at")))
    return placed.groupBy("code", "word").agg(F.min("rank").alias("rank"))


def surprisal(rank: Column, word: Column) -> Column:
    """Bits of a word; without a rank, one is guessed from its length."""
    n = F.least(F.greatest(F.length(word), F.lit(3)), F.lit(22))
    guessed = F.floor(1200 * F.pow(F.lit(1.42), n - 4) + 0.5)
    p = SCALE / F.pow(F.coalesce(rank, guessed) + SHIFT, F.lit(SLOPE))
    return -F.log2(F.greatest(p, F.lit(1e-12)))


def is_small(lexicon: DataFrame) -> bool:
    """Whether a lexicon fits a broadcast."""
    return lexicon.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _known(lexicon: DataFrame):
    """The bits of a small lexicon's words, for all tasks."""
    return H.broadcast_bits(lexicon.where("rank IS NOT NULL").select("code", "word", surprisal(F.col("rank"), F.col("word")).alias("bits")))


def _guessed(spark) -> list[float]:
    """Bits of words outside the lexicon by their length, up to that from which on they are the same."""
    rows = spark.range(23).select("id", surprisal(F.lit(None).cast("int"), F.expr("repeat('x', cast(id AS int))")).alias("bits")).collect()
    return [r["bits"] for r in sorted(rows)]


def with_ranks(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds rank, null for words outside the lexicon; its size decides how it is joined."""
    small = lexicon.select(F.col("code").alias("x_code"), F.col("word").alias("x_word"), "rank")
    if is_small(lexicon):
        small = F.broadcast(small)
    return words.join(small, (F.col("code") == F.col("x_code")) & (F.col("word") == F.col("x_word")), "left").drop("x_code", "x_word")


def sentence_features(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, code, sent_idx, n, surp and the marks of every sentence.

    Of the markers only those are looked for that the document's text holds.
    """
    s = sentence_rows(docs, *KINDS).select("*", F.lower("sentence").alias("low"), F.regexp_extract("sentence", S.WORD, 0).alias("begin"))

    held = lambda kind: F.size(F.filter(kind, lambda m: F.contains(F.col("low"), m)))
    first = F.col("tok")[0]

    def opener(code: str) -> Column:
        det, pron, conj = (x.split() for x in G.OPENERS[code])
        adverbs = sorted({m.split(" ")[0] for m in S._listed(V.DISCOURSE[code])})
        return (
            F.when(first.isin(det), 0).when(first.isin(pron), 1).when(first.isin(conj), 2)
            .when(first.isin(adverbs) | first.endswith(G.ADVERB_END[code]), 3).when(F.regexp_like("begin", F.lit(r"^\p{Lu}")), 4).otherwise(5)
        )

    like = lambda patterns: H.fits(F.col("sentence"), F.col("code"), {c: _simple(p) for c, p in patterns.items()}).cast("int")

    marks = s.select(
        "doc_id", "code", "sent_idx", F.size("tok").alias("n"), first.alias("first"), S.by_language(F.col("code"), {c: opener(c) for c in S.LANGUAGES}).alias("opener"),
        held("dms").alias("dm"), held("rms").alias("rm"), held("hgs").alias("hg"), like(G.PASSIVE).alias("passive"), like(G.FIRST_PERSON_IN).alias("human"),
        F.regexp_like("low", _pattern(r"[’']\s?(s|t|re|ve|ll|d|m)(?![A-Za-z0-9_])")).cast("int").alias("contracted"),
        F.regexp_like("sentence", F.lit("[!?][\")'’”]*$")).cast("int").alias("exclaims"),
        F.regexp_like("sentence", F.lit("[.!?…][\")'’”]*$")).cast("int").alias("ended"),
        "tok",
    )
    if is_small(lexicon):
        bits = H.mean_bits(F.array_join("tok", " "), F.col("code"), _known(lexicon), _guessed(lexicon.sparkSession))
        return marks.select(*[c for c in marks.columns if c != "tok"], bits.alias("surp"))
    # Marks are keys beside doc_id, so that no join brings them back.
    bits = with_ranks(marks.withColumn("word", F.explode_outer("tok")).drop("tok"), lexicon)
    return bits.groupBy(*[c for c in marks.columns if c != "tok"]).agg(F.avg(surprisal(F.col("rank"), F.col("word"))).alias("surp"))


def _entropy(counts: list[Column]) -> Column:
    total = sum(counts[1:], counts[0])
    return -sum((F.when(c > 0, c / total * F.log2(c / total)).otherwise(0.0) for c in counts), F.lit(0.0))


def _sentence_signals(rows: DataFrame) -> DataFrame:
    """Rhythm, surprisal and register of each document, from its sentences' features."""
    doc = Window.partitionBy("doc_id")
    order = doc.orderBy("sent_idx")
    placed = rows.withColumns({"mu": F.avg("surp").over(doc), "sigma": _zero(F.stddev_samp("surp").over(doc)), "step": F.abs(F.col("surp") - F.lag("surp").over(order))})
    placed = placed.withColumn("run", F.sum((F.coalesce(F.col("step"), F.lit(1.0)) >= 0.4).cast("int")).over(order))
    runs = placed.withColumn("flat", F.count("*").over(Window.partitionBy("doc_id", "run")))
    n, k = F.col("n"), F.count("*")
    share = lambda c: F.avg(c.cast("double"))
    made = runs.groupBy("doc_id").agg(
        F.first("code").alias("code"), k.alias("sentences"), F.avg("n").alias("sentMean"), _zero(F.stddev_samp("n")).alias("sentSd"),
        F.kurtosis("n").alias("kurt"), F.skewness("n").alias("skew"), share(n < 8).alias("shortRate"), share(n > 35).alias("longRate"), share(n.between(15, 28)).alias("bandRate"),
        share(n < 6).alias("tiny"), share(F.col("ended") == 0).alias("open_ended"),
        F.first("mu").alias("surpMean"), F.first("sigma").alias("surpSd"), share(F.col("surp") > F.col("mu") + F.col("sigma")).alias("spikeRate"), F.max("flat").alias("flatRun"),
        *[F.sum(c).alias(c) for c in ("dm", "rm", "hg", "contracted")], share(F.col("passive")).alias("passive"), share(F.col("exclaims")).alias("exclaimQ"),
        _entropy([F.count_if(F.col("opener") == i) for i in range(6)]).alias("openerH"),
    )
    firsts = rows.groupBy("doc_id", "first").agg(F.count("*").alias("c"))
    top = firsts.groupBy("doc_id").agg(F.slice(F.sort_array(F.collect_list("c"), asc=False), 1, 3).alias("top"))
    top = top.select("doc_id", F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x).alias("top3"))
    count, varied = F.col("sentences"), F.col("sentSd") > 0
    return made.join(top, "doc_id").select(
        "*", (F.col("sentSd") / F.col("sentMean")).alias("burstiness"), (F.col("top3") / count).alias("openerRep"),
        F.when((count >= 4) & varied, (F.col("kurt") + 3) * F.pow((count - 1) / count, F.lit(2))).otherwise(3.0).alias("sentKurt"),
        F.when((count >= 3) & varied, F.col("skew") * F.pow((count - 1) / count, F.lit(1.5))).otherwise(0.0).alias("sentSkew"),
    ).drop("kurt", "skew", "top3")


def _tokens(docs: DataFrame) -> DataFrame:
    return sentence_rows(docs).select("doc_id", "code", "sent_idx", "tok")


# Lists of words that are counted.
LISTS = {"func": V.FUNCTION_WORDS, "first": V.FIRST_PERSON, "strong": V.INTENSIFIERS}


def _listed_words(spark) -> DataFrame:
    """code, word and which of ``LISTS`` hold it: some hundred rows for each language."""
    lines = []
    for c in S.LANGUAGES:
        lists = [dict.fromkeys(S._listed(x[c])) for x in LISTS.values()]
        lines += ["\t".join([c, w, *[str(w in x).lower() for x in lists]]) for w in dict.fromkeys(w for x in lists for w in x)]
    d = spark.range(1).select(F.explode(F.split(F.lit("\n".join(lines)), "\n")).alias("line")).select(F.split("line", "\t").alias("x"))
    return d.select(F.col("x")[0].alias("code"), F.col("x")[1].alias("word"), *[F.col("x")[i + 2].cast("boolean").alias(k) for i, k in enumerate(LISTS)])


def _word_signals(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Lexicon signals of each document, from its word frequencies; a lexicon that fits no broadcast is joined."""
    if not is_small(lexicon):
        return _joined_word_signals(docs, lexicon)
    return _told(docs).select("doc_id", _word_sums(lexicon).alias("x")).select("doc_id", *_of_words("x"))


def _told(docs: DataFrame | Corpus, *others: str) -> DataFrame:
    """doc_id, code, told (the words of all sentences) of the documents with sentences, and other columns of theirs."""
    return corpus(docs).docs.where(F.size("sents") > 0).select("doc_id", "code", *others, H.told(F.col("sents")).alias("told"))


def _word_sums(lexicon: DataFrame) -> Column:
    lists = {k: {c: set(S._listed(x[c])) for c in S.LANGUAGES} for k, x in LISTS.items()}
    return H.word_sums(F.col("told"), F.col("code"), lists, _known(lexicon), ZIPF)


def _of_words(x: str) -> list[Column]:
    """The signals that follow from the sums of ``H.word_sums``."""
    of = lambda k: F.col(f"{x}.{k}")
    total, k = of("words"), of("points")
    slope = F.when(k > 20, -(k * of("sxy") - of("sx") * of("sy")) / (k * of("sxx") - of("sx") * of("sx"))).otherwise(1.07)
    return [
        total.alias("words"), of("types").alias("types"), (of("once") / of("types")).alias("hapax"),
        F.when(total > 1, 10000.0 * (of("squares") - total) / (total * total)).otherwise(0.0).alias("yulesK"), of("spread").alias("wordLenH"),
        (of("func") / total).alias("funcRate"), (1000.0 * of("first") / total).alias("firstPerson"), (1000.0 * of("strong") / total).alias("intens"), (of("oov") / total).alias("oovRate"),
        slope.alias("zipfSlope"), F.abs(slope - 1.07).alias("zipfDev"),
    ]


def _joined_word_signals(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    freq = _tokens(docs).select("doc_id", "code", F.explode_outer("tok").alias("word")).groupBy("doc_id", "code", "word").agg(F.count("*").alias("f"))
    ranked = with_ranks(freq, lexicon).join(F.broadcast(_listed_words(freq.sparkSession)), ["code", "word"], "left")
    f, n = F.col("f"), F.col("n")

    # Words of one frequency and length are one row, then those of one frequency: so many of them, and the sums over them.
    found = {k: F.sum(F.when(F.col(k), f).otherwise(0)) for k in LISTS} | {"oov": F.sum(F.when(F.col("rank").isNull(), f).otherwise(0))}
    ranked = ranked.groupBy("doc_id", "f", F.least(F.length("word"), F.lit(16)).alias("size")).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in found.items()])
    sizes = {f"size{i}": F.sum(F.when(F.col("size") == i, f * n).otherwise(0)) for i in range(1, 17)}
    rows = ranked.groupBy("doc_id", "f").agg(F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in found], *[c.alias(k) for k, c in sizes.items()])
    # Ranks a + 1 to b go to the words of one frequency, which comes into the slope up to rank ZIPF.
    last = F.sum("n").over(Window.partitionBy("doc_id").orderBy(F.desc("f")))
    rows = rows.withColumn("last", last).withColumns({"a": F.least(F.col("last") - n, F.lit(ZIPF)).cast("int"), "b": F.least("last", F.lit(ZIPF)).cast("int")})
    logs = [math.log(r) for r in range(1, ZIPF + 1)]
    # One literal, as an array of so many takes seconds to plan.
    upto = lambda terms: F.split(F.lit(" ".join(map(repr, accumulate(terms, initial=0.0)))), " ").cast("array<double>")
    between = lambda terms: F.get(upto(terms), F.col("b")) - F.get(upto(terms), F.col("a"))
    y, points = F.log("f"), F.col("b") - F.col("a")
    total, squares = F.sum(f * n), F.sum(f * f * n)
    sum_of = lambda k: F.sum(k)
    made = rows.groupBy("doc_id").agg(
        total.alias("words"), F.sum("n").alias("types"), (F.sum(F.when(f == 1, n).otherwise(0)) / F.sum("n")).alias("hapax"),
        F.when(total > 1, 10000.0 * (squares - total) / (total * total)).otherwise(0.0).alias("yulesK"),
        _entropy([sum_of(k) for k in sizes]).alias("wordLenH"),
        (sum_of("func") / total).alias("funcRate"), (1000.0 * sum_of("first") / total).alias("firstPerson"), (1000.0 * sum_of("strong") / total).alias("intens"),
        (sum_of("oov") / total).alias("oovRate"),
        F.sum(points).alias("points"), F.sum(between(logs)).alias("sx"), F.sum(between([x * x for x in logs])).alias("sxx"),
        F.sum(points * y).alias("sy"), F.sum(between(logs) * y).alias("sxy"),
    )
    k = F.col("points")
    slope = (k * F.col("sxy") - F.col("sx") * F.col("sy")) / (k * F.col("sxx") - F.col("sx") * F.col("sx"))
    made = made.withColumn("zipfSlope", F.when(k > 20, -slope).otherwise(1.07)).drop("points", "sx", "sxx", "sy", "sxy")
    return made.withColumn("zipfDev", F.abs(F.col("zipfSlope") - 1.07))


def share_of(c: Column) -> Column:
    return F.avg(c.cast("double"))


def rep5(docs: DataFrame | Corpus) -> DataFrame:
    """doc_id, rep5: the share of five-word runs that occur more than once."""
    return _told(docs).select("doc_id", H.repeated_share(F.col("told")).alias("rep5")).where("rep5 IS NOT NULL")


def mattr(docs: DataFrame | Corpus, window: int = 50, sample: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, mattr: distinct words in sliding windows over all sentences, or over a ``sample`` of them (``SAMPLE``)."""
    return _told(docs).select("doc_id", H.moving_ratio(F.col("told"), window, sample).alias("mattr"))


def syllables(words: Column, code: str | Column) -> Column:
    """Syllables of words in lower case, which spaces part."""
    return H.syllables(words, F.lit(code) if isinstance(code, str) else code)


def paragraphs(text: Column) -> Column:
    """Blocks parted by blank lines, or by single line feeds where there are fewer than three."""
    trimmed = lambda p: F.filter(F.transform(F.split(text, p), S.trimmed), lambda x: x != "")
    blocks = trimmed(r"\n[ \t]*\n+")
    return F.when((F.size(blocks) < 3) & F.contains(text, F.lit("\n")), trimmed(r"\n+")).otherwise(blocks)


def _paragraph_signals(docs: DataFrame) -> DataFrame:
    rows = corpus(docs).docs.select("doc_id", "code", F.explode_outer(paragraphs(F.col("text"))).alias("para")).where("para IS NOT NULL")
    rows = rows.select("doc_id", "code", S.words(F.col("para")).alias("w"), F.greatest(F.lit(1), F.size(S.split_sentences(F.col("para"), F.col("code")))).alias("s"))
    rows = rows.select("doc_id", F.size("w").alias("n"), "s", syllables(F.lower(F.array_join("w", " ")), F.col("code")).alias("syl"))
    grade = F.when(F.col("n") >= 25, 0.39 * F.col("n") / F.col("s") + 11.8 * F.col("syl") / F.col("n") - 15.59)
    kept = F.when(F.col("n") > 0, F.col("n"))
    ratio = lambda c: _zero(F.stddev_samp(c)) / F.avg(c)
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("paras"), F.count(kept).alias("para_lens"), _zero(ratio(kept)).alias("paraCv"), _zero(ratio(F.col("s"))).alias("paraSentCv"),
        F.count(grade).alias("grades"), F.when(F.count(grade) > 2, F.stddev_samp(grade)).otherwise(2.4).alias("gradeSd"), F.sum("syl").alias("syll"),
    )


#: Slips that patterns without anchors and looks around them tell, with their weights.
SLIPS = {"commas": r"\p{Ll},\p{L}", "stops": r"\p{Ll}\.\p{Lu}", "runs": r"[!?]{2,}|\.{4,}", "spaced": f"[{S.SPACES}][,.;:]"}


def slips(text: Column, code: Column) -> Column:
    """The weighted number of slips in a text, without those of ``SLIPS``."""
    count = lambda p: F.regexp_count(text, F.lit(p.replace(r"\b", _EDGE).replace(r"\s", _SPACE)))
    alone = F.when(code == "en", count("i(?<![A-Za-z0-9_]i)(?![A-Za-z0-9_])") * 0.35).otherwise(0.0)
    return count(r"(?iu)\b(\p{L}{3,}+)\s++\1\b") + alone + count(r"(?=\p{Lu}\p{Lu})\b\p{Lu}{2,}\p{Ll}+") * 0.5


def _text_signals(docs: DataFrame | Corpus, lexicon: DataFrame, sample: tuple[int, int] | None = None) -> DataFrame:
    """What a document's text and words tell without a shuffle; one of each for documents with sentences."""
    if not is_small(lexicon):
        words = _joined_word_signals(docs, lexicon).join(rep5(docs), "doc_id", "left").join(mattr(docs, sample=sample), "doc_id")
        return words.join(_marks(corpus(docs).docs.withColumn("told", F.lit(""))), "doc_id")
    return _marks(_told(docs, "text"), _word_sums(lexicon).alias("x"), H.repeated_share(F.col("told")).alias("rep5"), H.moving_ratio(F.col("told"), 50, sample).alias("mattr"))


def _marks(texts: DataFrame, *others: Column) -> DataFrame:
    """doc_id, slips, chars, the counts of ``S.MARKS`` and what the other columns tell."""
    rows = texts.select("doc_id", "code", "text", H.counts(F.concat(F.lit("\n"), "text"), S.MARKS).alias("m"), H.counts(F.col("text"), SLIPS).alias("s"), *others)
    told = sum((F.col(f"s.{k}") for k in SLIPS), slips(F.col("text"), F.col("code")))
    words = [F.col("rep5"), F.col("mattr"), *_of_words("x")] if others else []
    return rows.select("doc_id", told.alias("slips"), F.length("text").alias("chars"), "m.*", *words)


def saved_features(docs: DataFrame | Corpus, lexicon: DataFrame, watch: Observation | None = None, folder: Staging | None = None) -> DataFrame:
    """sentence_features, written once, to a ``folder`` that is given or one of its own. ``watch`` gets how many sentences and words there are."""
    docs = corpus(docs)
    made = sentence_features(docs, lexicon)
    if watch is not None:
        made = made.observe(watch, F.count(F.lit(1)).alias("sentences"), F.coalesce(F.sum("n"), F.lit(0)).alias("words"))
    return (folder or Staging(lexicon.sparkSession, "features")).save(made, "sentences", by="doc_id", buckets=docs.buckets)


def document_signals(docs: DataFrame | Corpus, lexicon: DataFrame, features: DataFrame | None = None, sample: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, code, the 41 raw values and what holds depend on, for documents with sentences; written once. ``sample``: see ``mattr``."""
    docs = corpus(docs)
    if features is None:
        features = saved_features(docs, lexicon)
    d = _sentence_signals(features).join(_text_signals(docs, lexicon, sample), "doc_id").join(_paragraph_signals(docs), "doc_id")
    per = lambda c: 1000.0 * F.col(c) / F.col("words")
    quotes = F.col("curly") + F.col("straight")

    def ease(code: str) -> Column:
        a, b, c = G.READING_EASE[code]
        return a - b * F.col("words") / F.col("sentences") - c * F.col("syll") / F.col("words")

    made = d.withColumns(
        {
            "rep5": _zero(F.col("rep5")), "discourse": per("dm"), "regMark": per("rm"), "hedge": per("hg"), "contraction": per("contracted"),
            "flesch": S.by_language(F.col("code"), {c: ease(c) for c in S.LANGUAGES}), "listRate": _zero(F.when(F.col("lines") > 0, F.col("items") / F.col("lines"))),
            "headRate": per("heads"), "emDash": per("dashes"), "doubleSpace": F.col("wide_gaps") / F.greatest(F.lit(1), F.col("gaps")), "typo": per("slips"), "unicode": per("odd_spaces"),
            "curly": F.when(quotes > 0, F.abs(F.col("curly") - F.col("straight")) / quotes).otherwise(0.5),
        }
    )
    return Staging(made.sparkSession, "signals").save(made, "wide")


def signal_names() -> list[str]:
    return [line.split("|")[0].strip() for line in G.SIGNALS.strip().splitlines()]


def signals_long(wide: DataFrame) -> DataFrame:
    """doc_id, code, signal, family, place, value, dev, evidence, weight, held: 41 rows a document."""
    least = {
        "zipfDev": ("words", 600), "rep5": ("words", 300), "gradeSd": ("grades", 3), "paraCv": ("para_lens", 3), "paraSentCv": ("para_lens", 3), "doubleSpace": ("gaps", 20),
        "sentKurt": ("sentences", 12), "sentSkew": ("sentences", 12), "flatRun": ("sentences", 8), "hapax": ("words", 200), "yulesK": ("words", 200), "listRate": ("lines", 6),
    }

    def one(name: str) -> Column:
        held = F.col(least[name][0]) < least[name][1] if name in least else F.lit(False)
        if name == "contraction":
            held = F.col("code") != "en"
        return F.struct(F.lit(name).alias("signal"), F.col(name).cast("double").alias("value"), held.alias("held"))

    rows = wide.select("doc_id", "code", F.explode(F.array(*[one(s) for s in signal_names()])).alias("x")).select("doc_id", "code", "x.*")
    rows = rows.join(F.broadcast(spec(wide.sparkSession)), ["code", "signal"])  # 164 rows
    dev = F.when(F.col("held"), 0.0).otherwise(F.col("dir") * (F.col("value") - F.col("center")) / F.col("spread"))
    return rows.select(
        "doc_id", "code", "signal", "family", "place", "value", dev.alias("dev"), F.least(F.lit(2.5), F.greatest(F.lit(-2.5), dev)).alias("evidence"),
        F.when(F.col("held"), 0.0).otherwise(F.col("weight")).alias("weight"), "held",
    )


def _weighted() -> Column:
    w = F.sum("weight")
    return F.when(w > 0, F.sum(F.col("weight") * F.col("evidence")) / w).otherwise(0.0)


def family_scores(rows: DataFrame) -> DataFrame:
    """doc_id, family, score: the weighted mean of evidence."""
    return rows.groupBy("doc_id", "family").agg(F.round(_weighted(), 6).alias("score"))


def findings(rows: DataFrame, n: int = 4) -> DataFrame:
    """doc_id, side, rank, signal, dev: what speaks most for a machine and most for a person."""
    live = rows.where("NOT held")
    out = None
    for side, by in (("machine", F.desc("dev")), ("human", F.asc("dev"))):
        ranked = live.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(by, "place"))).where(F.col("rank") <= n)
        part = ranked.select("doc_id", F.lit(side).alias("side"), "rank", "signal", F.round(F.col("dev") + 1e-10, 6).alias("dev"))
        out = part if out is None else out.unionByName(part)
    return out


def index_scores(wide: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, code, words, logit, index, percent, half, band, reliability, prose."""
    d = rows.groupBy("doc_id").agg(_weighted().alias("logit")).join(wide.select("doc_id", "code", "words", "listRate", "paras", "para_lens", "tiny", "open_ended"), "doc_id")
    i, words = F.col("index"), F.col("words")
    per = words / F.greatest(F.col("para_lens"), F.lit(1))  # of the paragraphs with words
    reasons = sum(c.cast("int") for c in ((F.col("listRate") > 0.3), (per < 12) & (F.col("paras") > 8), F.col("tiny") > 0.42, F.col("open_ended") > 0.5))
    over = (F.col("listRate") > 0.6) | ((per < 8) & (F.col("paras") > 12))
    half = F.least(F.lit(0.5), F.greatest(F.lit(0.035), 0.52 / F.sqrt(1 + words / 220.0) + 0.035))
    band = (
        F.when(i < 0.28, "Consistent with human authorship").when(i < 0.45, "Leans human").when(i < 0.58, "Indeterminate")
        .when(i < 0.75, "Leans machine-assisted").otherwise("Consistent with machine generation")
    )
    trust = F.when(words < 120, "insufficient").when(words < 350, "low").when(words < 1200, "moderate").otherwise("high")
    d = d.withColumn("index", 1 / (1 + F.exp(-1.55 * F.col("logit"))))
    return d.select(
        "doc_id", "code", "words", F.round("logit", 6).alias("logit"), F.round("index", 6).alias("index"), F.floor(i * 100 + 0.5).cast("int").alias("percent"),
        F.round(half, 6).alias("half"), band.alias("band"), trust.alias("reliability"), (~((reasons >= 2) | over)).alias("prose"),
    )


def sentence_scores(rows: DataFrame) -> DataFrame:
    """doc_id, sent_idx, n, surp, score in [0.02, 0.98], from sentence_features."""
    doc = Window.partitionBy("doc_id")
    mu, sigma = F.avg("surp").over(doc), F.coalesce(F.stddev_samp("surp").over(doc), F.lit(0.0))
    d = rows.withColumns({"mu": mu, "sigma": sigma})
    clamp = lambda x, a, b: F.least(F.lit(b), F.greatest(F.lit(a), x))
    zs = F.when(F.col("sigma") > 0, -(F.col("surp") - F.col("mu")) / F.col("sigma")).otherwise(0.0)
    zl = 1 - F.abs(F.col("n") - 21) / 16
    s = (
        0.42 * clamp(zs, -2.0, 2.0) / 2 + 0.18 * clamp(zl, -1.0, 1.0) + 0.20 * clamp(0.9 * F.col("dm"), 0.0, 1.0)
        + 0.28 * clamp(1.1 * F.col("rm"), 0.0, 1.0) + 0.08 * F.col("passive") - 0.22 * F.col("human")
    )
    return d.select("doc_id", "sent_idx", "n", F.round("surp", 6).alias("surp"), F.round(clamp(0.5 + 0.75 * s, 0.02, 0.98), 6).alias("score"))


def top_grams(docs: DataFrame | Corpus, n: int = 8) -> DataFrame:
    """doc_id, rank, gram, c: five-word runs that occur more than once, the commonest first, ties by first place."""
    rows = _told(docs).select("doc_id", F.posexplode(H.repeated_runs(F.col("told"), 5, n)).alias("p", "x"))
    return rows.select("doc_id", (F.col("p") + 1).alias("rank"), "x.gram", "x.c")


def register_hits(docs: DataFrame | Corpus, n: int = 14) -> DataFrame:
    """doc_id, rank, marker, c: register markers by how often they occur, ties in their natural order."""
    s = corpus(docs).docs.where(F.size("rms") > 0).select("doc_id", "rms", F.lower("text").alias("low"))
    times = lambda m: ((F.length("low") - F.length(F.replace("low", m, F.lit("")))) / F.length(m)).cast("int")
    counted = F.transform("rms", lambda m, i: F.struct((-times(m)).alias("minus"), i.alias("place"), m.alias("marker")))
    rows = s.select("doc_id", F.posexplode(F.slice(F.sort_array(counted), 1, n)).alias("p", "x"))
    return rows.select("doc_id", (F.col("p") + 1).alias("rank"), "x.marker", (-F.col("x.minus")).alias("c"))


def marker_rates(docs: DataFrame | Corpus) -> DataFrame:
    """doc_id, code, words and rates per thousand words of discourse and register markers and hedges,
    and function words' share."""
    s = sentence_rows(docs, *KINDS).withColumn("low", F.lower("sentence"))

    def hits(lists: dict[str, str]) -> Column:
        return F.size(F.filter("tok", lambda t: S.by_language(F.col("code"), {c: t.isin(S._listed(lists[c])) for c in S.LANGUAGES})))

    held = lambda kind: F.size(F.filter(kind, lambda m: F.contains(F.col("low"), m)))
    kinds = {"discourse": held("dms"), "regMark": held("rms"), "hedge": held("hgs"), "firstPerson": hits(V.FIRST_PERSON), "intens": hits(V.INTENSIFIERS)}
    n = F.sum(F.size("tok"))
    return s.groupBy("doc_id").agg(
        n.alias("words"), *[F.round(1000.0 * F.sum(c) / n, 6).alias(k) for k, c in kinds.items()], F.round(F.sum(hits(V.FUNCTION_WORDS)) / n, 6).alias("funcRate")
    )


def rhythm(docs: DataFrame | Corpus) -> DataFrame:
    """doc_id, sentences and the measurements of sentence lengths in words."""
    return S.rhythm_of(sentence_rows(docs).select("doc_id", F.size("tok").alias("n")))


def sentence_offsets(docs: DataFrame | Corpus) -> DataFrame:
    """doc_id, sent_idx, offset, begin, length, nl: where sentences lie in the text with line feeds only.

    offset is the end of what lies before, begin the sentence's first character (both from 0), nl the line feeds between
    them. Segments without a letter are no sentences, but take their place. Only lengths are shuffled.
    """
    segs = F.split(S.marked(F.col("text"), F.col("code")), "\u0001")
    rows = corpus(docs).docs.select("doc_id", F.posexplode(segs).alias("pos", "seg"))
    lead = F.regexp_extract("seg", f"^({_SPACE}*)", 1)
    rows = rows.select(
        "doc_id", "pos", F.length("seg").alias("size"), F.length(lead).alias("lead"), F.regexp_count(lead, F.lit("\n")).alias("nl"),
        F.length(S.trimmed(F.col("seg"))).alias("length"), F.regexp_like("seg", F.lit(r"\p{L}")).cast("int").alias("kept"),
    )
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sums = {c: F.coalesce(F.sum(x).over(before), F.lit(0)) for c, x in (("offset", "size"), ("sent_idx", "kept"))}
    rows = rows.withColumns(sums).where("kept = 1")
    return rows.select("doc_id", F.col("sent_idx").cast("int").alias("sent_idx"), "offset", (F.col("offset") + F.col("lead")).alias("begin"), "length", "nl")


def trace_buckets(rows: DataFrame, points: int = 520) -> DataFrame:
    """doc_id, bucket, surp, n: means over runs of sentences, so many at most a document."""
    doc = Window.partitionBy("doc_id")
    d = rows.withColumns({"k": F.ceil(F.count("*").over(doc) / points), "i": F.row_number().over(doc.orderBy("sent_idx")) - 1})
    return d.groupBy("doc_id", F.floor(F.col("i") / F.col("k")).alias("bucket")).agg(F.round(F.avg("surp"), 6).alias("surp"), F.round(F.avg("n"), 6).alias("n"))
