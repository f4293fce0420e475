"""Style measurements of documents as DataFrame operators keyed by doc_id.

Everything that a single text tells is an expression over it, without a shuffle; what counts
words or word sequences is exploded and aggregated by doc_id.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import word_helpers as H
from ..sources import staging

LANGUAGES = ("en", "es", "pt", "fr")
WORD = r"\p{L}[\p{L}'’]*"
#: White space, of Unicode too, which the shorthand of patterns leaves out.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The characters of ``SPACE``.
SPACES = " \t\n\x0b\f\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


#: So many repeated ids at most are broadcast (8 bytes each, if they are numbers).
BROADCAST_IDS = 1_000_000


def unique(docs: DataFrame, *others: str, tasks: int | None = None) -> DataFrame:
    """doc_id, text and the other columns named: a row for each doc_id that is not null.

    Repeated rows are one document; of several texts with one doc_id the smallest is measured, with the
    smallest values of the other columns beside it. Ids are counted first, by themselves. Texts are dealt by
    doc_id over ``tasks`` (``staging.tasks``, unless it is told): what counts by doc_id behind needs no other shuffle.
    """
    tasks = tasks or staging.tasks(docs)
    known = docs.where("doc_id IS NOT NULL").select("doc_id", "text", *others)
    ids = known.groupBy("doc_id").count().where("count > 1").select("doc_id")
    n = ids.limit(BROADCAST_IDS + 1).count()
    if not n:
        return known.repartition(tasks, "doc_id")
    if n <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    one = known.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("x")).select("doc_id", "x.*")
    return known.join(ids, "doc_id", "left_anti").unionByName(one).repartition(tasks, "doc_id")


def trimmed(text: Column) -> Column:
    """The text without the white space at its ends, which alone are looked at."""
    return F.trim(text, F.lit(SPACES))


#: A document has so many characters besides white space at least.
LEAST_CHARS = 40


def enough(text: Column) -> Column:
    """Whether a text has enough characters besides white space to be measured; null has none."""
    return F.regexp_like(F.coalesce(text, F.lit("")), F.lit(f"^(?:{SPACE}*+[^{SPACE[1:-1]}]){{{LEAST_CHARS}}}"))


def normalised(docs: DataFrame) -> DataFrame:
    """doc_id, text with line feeds only; null texts are empty."""
    return docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n").alias("text"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def by_language(lang: Column, choices: dict[str, Column]) -> Column:
    """The choice of the row's language, English where it has none."""
    made = choices["en"]
    for code in LANGUAGES[1:]:
        made = F.when(lang == code, choices[code]).otherwise(made)
    return made


def _listed(text: str) -> list[str]:
    parts = text.split("|") if "|" in text else text.split()
    return list(dict.fromkeys(p.strip().lower() for p in parts if p.strip()))


# Weights of spelling cues, per thousand characters. What a cue ends with is never in front of a cue's word, so none needs to look behind.
CUES = {
    "es": (r"[ñ¿¡]", 0.02),
    "pt": (r"[ãõçâ]", 0.02),
    "fr": (r"[çœêèùûîï]|(?:^|[^A-Za-z0-9_])[ldjnmts]['’]", 0.015),
    "it": (r"\b(?:gli|degli|nell|dell|sull)\b", 0.02),
    "de": (r"[äöüß]", 0.015),
}
SCRIPTS = {
    "latin": "A-Za-zÀ-ɏ",
    "cyrillic": "Ѐ-ӿ",
    "greek": "Ͱ-Ͽ",
    "arabic": "؀-ۿ",
    "hebrew": "֐-׿",
    "cjk": "぀-ヿ一-鿿가-힯",
    "devanagari": "ऀ-ॿ",
    "thai": "฀-๿",
}


# Names of languages and scripts that are recognised but not measured, and of those that are.
UNMEASURED = {"it": "Italian", "de": "German", "nl": "Dutch", "ca": "Catalan", "pl": "Polish", "ru": "Russian", "tr": "Turkish", "sv": "Swedish"}
SCRIPT_NAMES = {
    "cyrillic": "a Cyrillic script (Russian, Ukrainian, Bulgarian or similar)",
    "greek": "Greek",
    "arabic": "an Arabic script",
    "hebrew": "Hebrew",
    "cjk": "Chinese, Japanese or Korean",
    "devanagari": "a Devanagari script (Hindi, Marathi or similar)",
    "thai": "Thai",
}
#: Below this vote no language is told; at this vote the confidence is 1.
LEAST_VOTE, FULL_VOTE = 0.035, 0.25


def once(d: DataFrame) -> DataFrame:
    """The same rows, dealt as before; what is worked out up to here is not worked out again for each mention behind."""
    return d.select("doc_id", F.explode(F.array(F.struct(*[c for c in d.columns if c != "doc_id"]))).alias("x")).select("doc_id", "x.*")


def detected(docs: DataFrame, lang_col: str | None = None) -> DataFrame:
    """doc_id, text, status, code, top, confidence, margin, name, detected: narrow, no shuffle.

    status: ok, pinned, too_short, unsupported, unknown. ``lang_col`` pins a document's language where it
    names one that is measured; its text is voted on all the same. name is that of the language or script.
    """
    d = docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n").alias("text"), (F.col(lang_col) if lang_col else F.lit(None).cast("string")).alias("pinned"))
    foreign = "".join(v for k, v in SCRIPTS.items() if k != "latin")
    # Letters are told apart only where some are foreign, all of which lie behind the first of them.
    begin = F.substring("text", 1, 4000)
    letters = F.when(F.regexp_like(begin, F.lit(f"[{min(foreign)}-\uffff&&[{foreign}]]")), F.regexp_replace(begin, f"[^{SCRIPTS['latin']}{foreign}]+", ""))
    tokens = F.slice(words(F.lower(F.substring("text", 1, 60000))), 1, 6000)
    d = d.select("doc_id", "text", "pinned", F.substring("text", 1, 20000).alias("s"), letters.alias("letters"), tokens.alias("tok"))
    d = d.select(
        "*", F.regexp_replace("letters", f"[{SCRIPTS['latin']}]+", "").alias("far"),
        H.in_lists(F.array_join("tok", " "), {c: _listed(w) for c, w in V.VOTES.items()}).alias("hits"), H.counts(F.col("s"), {c: p for c, (p, _) in CUES.items()}).alias("cues"),
    )
    counts = [F.regexp_count("far", F.lit(f"[{v}]")) for k, v in SCRIPTS.items() if k != "latin"]
    n, total = F.size("tok"), F.length("letters")

    def score(code: str) -> Column:
        s = F.col(f"hits.{code}") / F.greatest(n, F.lit(1))
        if code in CUES:
            weight = CUES[code][1]
            s = s + F.col(f"cues.{code}") * 1000.0 / F.greatest(F.lit(1), F.length("s")) * weight
        return s

    # Ties go to the language, and the script, that is listed first.
    ranked = F.sort_array(F.array(*[F.struct(F.round(score(c), 9).alias("s"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(V.VOTES)]), asc=False)
    script = F.when(F.length("far") > 0, F.array_max(F.array(*[F.struct(c.alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, c) in enumerate(zip(SCRIPT_NAMES, counts, strict=True))])))
    d = d.select("doc_id", "text", "pinned", n.alias("n"), total.alias("total"), (total - F.length("far")).alias("latin"), script.alias("script"), F.slice(ranked, 1, 2).alias("best"))
    d = once(d)
    top, second, code = F.col("best")[0]["s"], F.col("best")[1]["s"], F.col("best")[0]["c"]
    strange = F.coalesce((F.col("script.n") > F.col("latin")) & (F.col("script.n") > 0.35 * F.col("total")), F.lit(False))
    pinned = F.when(F.col("pinned").isin(*LANGUAGES), F.col("pinned"))
    status = (
        F.when(pinned.isNotNull(), "pinned").when(strange, "unsupported").when(F.col("n") < 20, "too_short").when(top < LEAST_VOTE, "unknown")
        .when(code.isin(*LANGUAGES), "ok").otherwise("unsupported")
    )
    d = d.select("doc_id", "text", status.alias("status"), pinned.alias("pinned"), strange.alias("strange"), F.col("script.k").alias("script"), code.alias("c"), top.alias("top"), second.alias("second"))
    ok = F.col("status") == "ok"
    told = F.when(ok, F.col("c")).otherwise(F.col("pinned"))
    names = {c: V.LANGUAGE_NAMES[c][0] for c in LANGUAGES} | UNMEASURED
    return d.select(
        "doc_id", "text", "status", told.alias("code"), F.when(F.col("status").isin("ok", "unknown"), F.round("top", 6)).alias("top"),
        F.when(ok, F.round(F.least(F.lit(1.0), F.col("top") / FULL_VOTE), 6)).alias("confidence"), F.when(ok, F.round(F.col("top") - F.col("second"), 6)).alias("margin"),
        F.when(F.col("status") == "unsupported", F.when(F.col("strange"), chosen(F.col("script"), SCRIPT_NAMES)).otherwise(chosen(F.col("c"), names))).otherwise(chosen(told, names)).alias("name"),
        F.when(F.col("status").isin("ok", "too_short", "pinned"), F.coalesce(told, F.lit("en"))).alias("measured"),
    )


def chosen(key: Column, choices: dict[str, str]) -> Column:
    """The text of a key; null where there is none."""
    made = F.lit(None).cast("string")
    for k, text in choices.items():
        made = F.when(key == k, F.lit(text)).otherwise(made)
    return made


def detect_language(docs: DataFrame, lang_col: str | None = None) -> DataFrame:
    """doc_id, status, code, top (the vote), confidence, margin to the next language, name."""
    return detected(docs, lang_col).drop("text", "measured")


def scored(docs: DataFrame, lang_col: str | None = None) -> DataFrame:
    """doc_id, text, code of the documents that are measured: short ones count as English, refused ones are left out."""
    # A filter on status would be pushed below and work the detection out again for each mention of it.
    kept = F.when(F.col("measured").isNotNull(), F.array(F.struct("text", F.col("measured").alias("code"))))
    return detected(docs, lang_col).select("doc_id", F.explode_outer(kept).alias("x")).where("x IS NOT NULL").select("doc_id", "x.text", "x.code")


def word_freq(docs: DataFrame) -> DataFrame:
    """doc_id, word, n: a row for each word of a document; see ``unique`` for rows that repeat. Null and empty texts have none."""
    d = normalised(unique(docs))
    return d.select("doc_id", F.explode(words(F.lower("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def word_stats(docs: DataFrame) -> DataFrame:
    """doc_id, words, types, hapax, yules_k, for documents with words; see ``word_freq``."""
    n, f2 = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    return word_freq(docs).groupBy("doc_id").agg(
        n.alias("words"), F.count("*").alias("types"),
        F.round(F.avg((F.col("n") == 1).cast("double")), 6).alias("hapax"),
        F.round(F.when(n > 1, 10000.0 * (f2 - n) / (n * n)).otherwise(0.0), 6).alias("yules_k"),
    )


_BLANK = f"[{SPACES.replace(chr(10), '')}]"
#: Marks that are counted in a text that a line feed precedes: patterns without anchors and looks around them.
MARKS = {
    "dashes": "[—–]", "curly": "[“”‘’]", "straight": "[\"']", "wide_gaps": rf"\.[{SPACES}]{{2,}}", "gaps": rf"\.[{SPACES}]",
    "odd_spaces": "[ ​-‍  ﻿⁠]", "heads": rf"\n#{{1,6}}[{SPACES}]|\*\*[^*\n]{{2,}}\*\*",
    # Lines with something on them, and those of which a mark and something behind it begin.
    "lines": rf"\n{_BLANK}*[^{SPACES}]", "items": rf"\n{_BLANK}*(?:[-*•‣▪]|[0-9]{{1,2}}[.)]|[A-Za-z][.)]){_BLANK}+[^{SPACES}]",
}


def typography(docs: DataFrame) -> DataFrame:
    """doc_id and counts of marks: dashes, curly and straight quotes, wide gaps, odd spaces, list lines, heads."""
    return normalised(docs).select("doc_id", H.counts(F.concat(F.lit("\n"), "text"), MARKS).alias("x")).select("doc_id", "x.*")


def _boundary(code: str) -> str:
    """A terminator run with its closing marks, where a sentence ends."""
    # Dots are taken out of the text's word but not of the list, so entries with dots never match.
    short = "|".join(r"\.?".join(a) for a in _listed(V.ABBREVIATIONS[code]) if a.isalpha())
    tail = r"[.!?…]*+[\"'”’)\]}»]*+(?=[ \t\n]|\z)"
    low = r"(?![ \t]{0,2}[\p{Ll},;:])"
    # The abbreviations come last, where all else fits.
    known = rf"(?<!(?<![\p{{L}}.'’])\.{{0,9}}(?iu:{short})\.)"
    return rf"(?=[.!?…])(?<![.!?…])(?:[!?…]{tail}|\.(?:(?<!\d\.)(?={tail}{low})|(?<=\d\.)(?={tail}(?!{SPACE}*\d){low})){known}{tail})"


def marked(text: Column, code: Column) -> Column:
    """The text with a mark behind each sentence. Languages not scored split as English."""
    return by_language(code, {c: F.regexp_replace(text, F.lit(_boundary(c)), F.lit("$0\u0001")) for c in LANGUAGES})


def segments(text: Column, code: Column) -> Column:
    """The text's segments with a letter, with the white space before them."""
    return F.filter(F.split(marked(text, code), "\u0001"), lambda x: F.regexp_like(x, F.lit(r"\p{L}")))


def split_sentences(text: Column, code: Column) -> Column:
    """The text's sentences as an array."""
    return F.transform(segments(text, code), trimmed)


def sentences(docs: DataFrame) -> DataFrame:
    """doc_id, code, sent_idx, sentence of the documents that are measured; narrow."""
    return scored(docs).select("doc_id", "code", F.posexplode_outer(split_sentences(F.col("text"), F.col("code"))).alias("sent_idx", "sentence")).where("sent_idx IS NOT NULL")


def rhythm_of(rows: DataFrame) -> DataFrame:
    """The measurements of sentence lengths (doc_id, n)."""
    s = rows.groupBy("doc_id").agg(
        F.count("*").alias("sentences"), F.avg("n").alias("mean"), F.coalesce(F.stddev_samp("n"), F.lit(0.0)).alias("sd"),
        F.kurtosis("n").alias("kurt"), F.skewness("n").alias("skew"), *[F.avg(c.cast("double")).alias(a) for a, c in (
            ("short", F.col("n") < 8), ("long", F.col("n") > 35), ("band", F.col("n").between(15, 28)))],
    )
    k, varied = F.col("sentences"), F.col("sd") > 0
    return s.select(
        "doc_id", "sentences", F.round(F.col("sd") / F.col("mean"), 6).alias("burstiness"), F.round("sd", 6).alias("sentSd"), F.round("mean", 6).alias("sentMean"),
        F.round(F.when((k >= 4) & varied, (F.col("kurt") + 3) * F.pow((k - 1) / k, F.lit(2))).otherwise(3.0), 6).alias("sentKurt"),
        F.round(F.when((k >= 3) & varied, F.col("skew") * F.pow((k - 1) / k, F.lit(1.5))).otherwise(0.0), 6).alias("sentSkew"),
        F.round("short", 6).alias("shortRate"), F.round("long", 6).alias("longRate"), F.round("band", 6).alias("bandRate"),
    )


def markers_in(low: Column, code: Column, kinds: dict[str, dict[str, str]]) -> Column:
    """A struct of kinds: those of the language's markers that a text in lower case holds, in their natural order; null for no text."""
    return H.markers(low, code, {k: {c: _listed(lists[c]) for c in LANGUAGES} for k, lists in kinds.items()})
