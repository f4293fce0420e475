"""Line deduplication by winnowing over line hashes. Native: DataFrame functions only.

Lines with words count; blank ones never match, and go only where a deleted run spans them. From every line runs the shortest
*window* of lines that holds ``min_words`` words, and to every line the shortest one that
ends there. A window's fingerprint is the smallest line hash in it, so two places that share
``min_words`` words of lines share a window and its fingerprint: that is the guarantee.
Fingerprints that were selected at one position only are dropped. The windows of the others
are joined by fingerprint and content, each with its first position in the corpus. Windows
that begin later in a repeated run extend its match forward, those that end earlier extend it
backward, so the windows together cover a repeated run wholly. Lines that lie in a window
whose content was seen at an earlier position (smaller key, or earlier line) are deleted, but
for those that the earlier position itself covers, where a text repeats itself at once.

Positions are aggregated per fingerprint before they are joined, and the joins are salted:
no line, however common, gathers its positions in one task or meets itself in pairs.

``dedup_passages`` does the same over words, whatever lines they stand in, so it also deletes
passages that are spliced into other lines. Every window of ``PASSAGE`` words has as its
fingerprint the smallest hash of ``PRINT`` words in it. Neighbouring windows with the same
fingerprint are a run; equal runs are found whole, and only where one fingerprint has runs that
differ are their windows compared, by the hash of all their words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SharedFolder, read_table

WORD = r"[^\x20\x09-\x0D]+"
#: A repeated run has so many words at least.
MIN_WORDS = 50
SALTS = 16
#: A table of so many rows at most is broadcast to find the documents that lose lines.
BROADCAST_ROWS = 500_000
#: Words of a window of a passage, and of the hashes that its fingerprint is the smallest of.
PASSAGE, PRINT = 50, 16
SPACE = r"[\x20\x09-\x0D]"


def _unit_lines(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """k, t (hash of the text), at (line number from 0), line (two hashes), n (words), one row a line."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = docs.select(
        F.col(key).alias("k"), F.xxhash64(F.col(text_col)).alias("t"), F.posexplode(lines).alias("at", "text")
    )
    counted = rows.select("k", "t", "at", F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")).alias("line"), F.regexp_count("text", F.lit(WORD)).alias("n"))
    # Repeated rows are one document.
    return counted.where("n > 0").repartition("k", "t").groupBy("k", "t", "at").agg(F.first("line").alias("line"), F.first("n").alias("n"))


def _windows(lines: DataFrame, min_words: int) -> DataFrame:
    """k, t, low, high (line numbers), print (fingerprint), place (its line), body (content hashes)."""
    doc = Window.partitionBy("k", "t")
    placed = lines.withColumn("to", F.sum("n").over(doc.orderBy("at"))).withColumn("from", F.col("to") - F.col("n"))
    after = doc.orderBy("from").rangeBetween(Window.currentRow, min_words - 1)
    before = doc.orderBy("to").rangeBetween(1 - min_words, Window.currentRow)

    def window(frame, low: Column, high: Column) -> Column:
        least = F.min(F.struct("line", "at")).over(frame)
        content = F.collect_list("line").over(frame)
        return F.struct(
            F.sum("n").over(frame).alias("words"), low.alias("low"), high.alias("high"),
            least["line"].alias("print"), least["at"].alias("place"),
            F.struct(F.xxhash64(content).alias("a"), F.xxhash64(F.lit(1), content).alias("b")).alias("body"),
        )

    forward = placed.withColumn("f", window(after, F.col("at"), F.max("at").over(after)))
    both = forward.withColumn("b", window(before, F.min("at").over(before), F.col("at")))
    each = both.select("k", "t", F.explode(F.array("f", "b")).alias("w")).select("k", "t", "w.*")
    return each.where(F.col("words") >= min_words).drop("words")


def _salted(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Joins rows with keys, which are unique, spreading a common key over SALTS tasks."""
    salt = F.pmod(F.xxhash64("k", "t", "low"), F.lit(SALTS))
    spread = keys.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("salt", salt).join(spread, [*on, "salt"]).drop("salt")


def _uncovered(high: Column) -> Column:
    """The places of a later window, from low on, beyond those that its first position covers."""
    itself = F.col("first")["k"].eqNullSafe(F.col("k")) & (F.col("first")["t"] == F.col("t"))
    low = F.when(itself, F.greatest(F.col("low"), F.col("covered") + 1)).otherwise(F.col("low"))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, t, lines: the numbers of lines to delete, a row for each document that has some."""
    folder = SharedFolder(docs.sparkSession, "line-dedup")
    windows = folder.save(_windows(_unit_lines(docs, key, text_col), min_words), "windows")
    position = F.struct("k", "t", "place")
    prints = windows.groupBy("print").agg(F.min(position).alias("x"), F.max(position).alias("y"))
    again = prints.where(~F.col("x").eqNullSafe(F.col("y"))).select("print")
    matched = _salted(windows, again, ["print"])
    here = F.struct("k", "t", "low")
    # A window that starts and one that ends somewhere can be the same lines: positions tell.
    bodies = matched.groupBy("print", "body").agg(F.min(here).alias("first"), F.max(here).alias("last"), F.min(F.struct("k", "t", "low", "high")).alias("x"))
    bodies = bodies.withColumn("covered", F.col("x.high"))
    firsts = bodies.where(~F.col("first").eqNullSafe(F.col("last"))).select("print", "body", "first", "covered")
    later = _salted(matched, firsts, ["print", "body"]).where(~F.col("first").eqNullSafe(here))
    lost = later.select("k", "t", F.explode(_uncovered(F.col("high"))).alias("at")).groupBy("k", "t").agg(F.collect_set("at").alias("lines"))
    made = folder.save(lost, "lost")
    folder.drop("windows")
    return made


def dedup_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, key: str = "doc_id", text_col: str = "text", removed: str | None = None
) -> DataFrame:
    """The rows and columns of ``docs``, with repeated runs of ``min_words`` words deleted from texts.

    The first position of a run, by key (nulls first) and line, keeps it whole; later ones, in the
    same document too, lose their lines, but for lines that the first position covers. With ``removed``, a column of that name counts them.
    Null texts stay null; a document can become empty. Repeated rows with the same key and
    text are one document and stay equal; same keys with different texts are told apart.
    Extra columns pass through, whatever they are called.
    """
    lost = repeated_lines(docs, min_words, key, text_col)
    names = docs.columns
    # All columns travel in one, so their names cannot clash with those used here.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(key).alias("k"), F.xxhash64(F.col(text_col)).alias("t"))
    lost = lost.withColumnRenamed("k", "lk").withColumnRenamed("t", "lt")
    if lost.count() <= BROADCAST_ROWS:
        lost = F.broadcast(lost)
    joined = whole.join(lost, F.col("k").eqNullSafe(F.col("lk")) & (F.col("t") == F.col("lt")), "left")
    text = F.col("row")[text_col]
    lines = F.split(text, "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("lines", s["i"]))
    made = F.when(F.col("lines").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n"))
    out = [(made if c == text_col else F.col("row")[c]).alias(c) for c in names]
    if removed:
        out.append(F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias(removed))
    return joined.select(*out)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _over(values: Column, shifts: Sequence[int], made: Callable[..., Column]) -> Column:
    """``made`` of the values at each place and at ``shifts`` after it, as far as all are there."""
    count = F.size(values) - max(shifts)
    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: made(*[F.get(values, i + s) for s in shifts]))


def _with_windows(docs: DataFrame) -> DataFrame:
    """Adds prints and bodies, of the PASSAGE words from each word on: fingerprints and hashes."""

    def windows(of_print: Column) -> Column:
        fours = _over(of_print, (0, 1, 2, 3), F.least)
        least = _let(fours, lambda x: _over(x, (0, 4, 8, 12), F.least))
        return F.struct(
            _let(least, lambda x: _over(x, (0, 16, PASSAGE - 2 * PRINT + 1), F.least)).alias("prints"),
            _over(of_print, (0, PRINT, 2 * PRINT, PASSAGE - PRINT), F.xxhash64).alias("bodies"),
        )

    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    fours = _let(hashes, lambda x: _over(x, (0, 1, 2, 3), F.xxhash64))
    prints = _let(fours, lambda x: _over(x, (0, 4, 8, 12), F.xxhash64))
    # Generated rows are computed once, however often they are used.
    return docs.select("*", F.inline(F.array(_let(prints, windows))))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k, t, ranges: the words to delete, numbers from low to below high, a row for each document that has some."""
    folder = SharedFolder(docs.sparkSession, "passages")
    texts = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text_col)).alias("t"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    def runs(prints: Column) -> Column:
        """Runs of windows with one fingerprint: print, low (its first window), to (the next run), body."""
        begun = F.filter(F.sequence(F.lit(0), F.size(prints) - 1), lambda i: (i == 0) | (F.get(prints, i) != F.get(prints, i - 1)))

        def run(begun: Column, i: Column, n: Column) -> Column:
            to = F.coalesce(F.get(begun, n + 1), F.size(prints))
            return F.struct(F.get(prints, i).alias("print"), i.alias("low"), to.alias("to"), F.xxhash64(F.slice("bodies", i + 1, to - i)).alias("body"))

        return _let(begun, lambda b: F.transform(b, lambda i, n: run(b, i, n)))

    # Where a document repeats itself, all its windows are compared.
    itself = F.size(F.array_distinct("bodies")) < F.size("bodies")
    made = _with_windows(texts).where(F.size("prints") > 0).select("k", "t", itself.alias("itself"), F.inline(runs(F.col("prints"))))
    found = folder.save(made, "runs")
    # Whole runs first: of equal ones only the first has windows that are not repeated.
    here = F.struct("k", "t", "low")
    equal = found.groupBy("print", "body").agg(F.min(F.struct("k", "t", "low", "to")).alias("x"), F.max(here).alias("last"), F.bool_or("itself").alias("itself"))
    equal = folder.save(equal.select("print", "body", "x.*", F.struct("x.k", "x.t", "x.low").alias("first"), "last", "itself"), "equal")
    firsts = equal.where(~F.col("first").eqNullSafe(F.col("last"))).select("print", "body", "first")
    # What the first position covers stays, where a text repeats itself at once.
    same = F.col("first")["k"].eqNullSafe(F.col("k")) & (F.col("first")["t"] == F.col("t"))
    begin = F.when(same, F.greatest(F.col("low"), F.col("first")["low"] + PASSAGE)).otherwise(F.col("low"))
    later = _salted(found, firsts, ["print", "body"]).where(~F.col("first").eqNullSafe(here))
    lost = folder.save(later.select("k", "t", begin.alias("low"), (F.col("to") - 1 + PASSAGE).alias("high")).where("low < high"), "whole")
    folder.drop("runs")

    # Then the windows of first runs whose fingerprint other runs have, too.
    mixed = equal.groupBy("print").agg(F.count("*").alias("n"), F.bool_or("itself").alias("itself")).where("n > 1 OR itself").select("print")
    wanted = _salted(equal.drop("itself"), mixed, ["print"]).groupBy("k", "t").agg(F.collect_list(F.struct("low", "to")).alias("runs"))
    wanted = wanted.withColumnsRenamed({"k": "mk", "t": "mt"})
    whole = texts.join(wanted, F.col("k").eqNullSafe(F.col("mk")) & (F.col("t") == F.col("mt")))
    windows = F.flatten(
        F.transform("runs", lambda r: F.transform(F.sequence(r["low"], r["to"] - 1), lambda i: F.struct(i.alias("low"), F.get("bodies", i).alias("body"))))
    )
    windows = folder.save(_with_windows(whole).select("k", "t", F.inline(windows)), "windows")
    bodies = windows.groupBy("body").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    firsts = bodies.where(~F.col("first").eqNullSafe(F.col("last"))).select("body", "first")
    later = _salted(windows, firsts, ["body"]).where(~F.col("first").eqNullSafe(here))
    lost = lost.unionByName(later.select("k", "t", begin.alias("low"), (F.col("low") + PASSAGE).alias("high")).where("low < high"))
    doc = Window.partitionBy("k", "t").orderBy("low")
    apart = F.coalesce(F.col("low") > F.max("high").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    parts = lost.withColumn("apart", apart.cast("int")).withColumn("part", F.sum("apart").over(doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranges = parts.groupBy("k", "t", "part").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    made = folder.save(ranges.groupBy("k", "t").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("ranges")), "lost")
    for name in ("equal", "whole", "windows"):
        folder.drop(name)
    return made


def _without(text: Column, ranges: Column) -> Column:
    """The text without those words. Of the white space around a deleted range one side stays: that
    before it if it has a line end, else that after it; none where nothing is left on one side."""

    def cut(words: Column) -> Column:
        def part(i: Column) -> Column:
            begin = F.coalesce(F.get(ranges, i - 1)["high"], F.lit(0))
            end = F.coalesce(F.get(ranges, i)["low"], F.size(words))
            kept = F.array_join(F.slice(words, begin + 1, end - begin), "")
            space = F.regexp_extract(F.get(words, F.get(ranges, i)["high"] - 1), f"({SPACE}*)\\z", 1)
            stays = F.regexp_like(kept, F.lit(rf"\n{SPACE}*\z")) & (F.get(ranges, i)["high"] < F.size(words))
            return F.when((i == F.size(ranges)) | (end == 0) | stays, kept).otherwise(F.concat(F.regexp_replace(kept, f"{SPACE}+\\z", ""), space))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(ranges)), part), "")

    # Every word with the white space after it.
    words = F.regexp_extract_all(text, F.lit(f"{WORD}{SPACE}*"), F.lit(0))
    return F.concat(F.regexp_extract(text, f"\\A({SPACE}*)", 1), _let(words, cut))


def dedup_passages(docs: DataFrame, key: str = "doc_id", text_col: str = "text", removed: str | None = None) -> DataFrame:
    """The rows and columns of ``docs``, with repeated runs of PASSAGE words or more deleted from texts.

    Words are told apart by white space, in lines and across them. A word goes if it lies in
    PASSAGE words that stand at an earlier position, by key (nulls first) and word, too, unless
    that position covers it itself: a text that repeats itself at once keeps the first PASSAGE
    words whole. What ``dedup_lines`` deletes goes, too, but for lines of such texts. With ``removed``, a column of that name counts the words.
    Keys, null texts, repeated rows and extra columns are treated as there.
    """
    lost = repeated_passages(docs, key, text_col).withColumnsRenamed({"k": "lk", "t": "lt"})
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(key).alias("k"), F.xxhash64(F.col(text_col)).alias("t"))
    if lost.count() <= BROADCAST_ROWS:
        lost = F.broadcast(lost)
    joined = whole.join(lost, F.col("k").eqNullSafe(F.col("lk")) & (F.col("t") == F.col("lt")), "left")
    text = F.col("row")[text_col]
    made = F.when(F.col("ranges").isNull(), text).otherwise(_without(text, F.col("ranges")))
    out = [(made if c == text_col else F.col("row")[c]).alias(c) for c in names]
    if removed:
        words = F.aggregate("ranges", F.lit(0), lambda n, r: n + r["high"] - r["low"])
        out.append(F.coalesce(words, F.lit(0)).cast("long").alias(removed))
    return joined.select(*out)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, removed="n_removed").select("doc_id", "n_removed", "text")


OP5_SQL = f"""
WITH lines AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS ln, unnest(ls) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
units AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY ln) AS upto
  FROM (SELECT *, len(regexp_extract_all(line, '{WORD}')) AS n FROM lines) WHERE n > 0),
spans AS (
  SELECT doc_id, ln AS low, max(ln) OVER w AS high, sum(n) OVER w AS words, list(line) OVER w AS body
  FROM (SELECT *, upto - n AS begun FROM units)
  WINDOW w AS (PARTITION BY doc_id ORDER BY begun RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
  UNION
  SELECT doc_id, min(ln) OVER w, ln, sum(n) OVER w, list(line) OVER w FROM units
  WINDOW w AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
ordered AS (SELECT doc_id, low, high, row_number() OVER w AS r, first_value(doc_id) OVER w AS f_doc, first_value(high) OVER w AS f_high
  FROM spans WHERE words >= {MIN_WORDS} WINDOW w AS (PARTITION BY body ORDER BY doc_id, low)),
lost AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN f_doc = doc_id THEN greatest(low, f_high + 1) ELSE low END, high + 1)) AS ln FROM ordered WHERE r > 1)
SELECT d.doc_id, coalesce(x.n_removed, 0) AS n_removed, CASE WHEN x.n_removed > 0 THEN coalesce(x.text, '') ELSE d.text END AS text
FROM documents d LEFT JOIN (
  SELECT l.doc_id, count(o.ln) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (WHERE o.ln IS NULL) AS text
  FROM lines l LEFT JOIN lost o USING (doc_id, ln) GROUP BY l.doc_id) x USING (doc_id)
"""
