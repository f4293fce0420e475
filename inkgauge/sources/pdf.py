"""Text out of PDF files, as relations.

A file's objects are rows. What they refer to (resources, fonts, character maps, contents) is followed by joins
on (path, number); objects inside of compressed objects join the others. A page's content is a row for each token;
windows over them tell the font that holds, the position of the line and its gaps. Characters of fonts with a map
are rows, too, that meet the ranges of the map. Python only unpacks streams and finds where a dictionary ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .extract import NOTES, PDF_LEGIBLE, inflate, legibility
from .staging import Staging

# A kern of less than this is a blank, a gap below the second is none, one above so many lines ends a paragraph, the line of a stream that tells none.
KERN, NO_GAP, PARAGRAPH, LEADING, LEAST_GAP = -170, 0.6, 1.35, 12.0, 2.0
ERROR = "No extractable text layer. This looks like a scanned PDF: run OCR on it first, or paste the text."

_OBJECT = r"(?s)(?<![^\s>\]])(\d{1,9})\s+\d{1,5}\s+obj\b(.*?)(?:endobj|\z)"
_REF = r"(\d+)\s+\d+\s+R"
_NAMED_REF = r"/([A-Za-z0-9#+.\-_]+)\s+(\d+)\s+\d+\s+R"
_PLAIN = r"[^()\\]++|\\(?s:.)"
_LITERAL = rf"\((?:{_PLAIN}|\((?:{_PLAIN}|\((?:{_PLAIN})*+\))*+\))*+\)"
_TOKEN = rf"{_LITERAL}|<(?!<)[^>]*+>|/[A-Za-z0-9#+.\-_]*+|[-+.\d]++|[A-Za-z'\"*][A-Za-z0-9*'\"]*+"
_ESCAPE = r"\\(?:[0-7]{1,3}|(?s:.))"


def _dictionary(body: str) -> str:
    """From the first << of an object to the >> that ends it."""
    begin, depth = body.find("<<"), 0
    for m in re.finditer("<<|>>", body[begin:]) if begin >= 0 else ():
        depth += 1 if m[0] == "<<" else -1
        if not depth:
            return body[begin : begin + m.end()]
    return body[begin : begin + 4000] if begin >= 0 else ""


def _stream(body: str, entries: str) -> str | None:
    """What an object's stream holds; None without one, or if it is packed in a way that is no text's."""
    at = body.find("stream")
    if at < 0:
        return None
    at += 6 + len(re.match(r"\r?\n?", body[at + 6 :])[0])
    end = body.find("endstream", at)
    data = body[at : end if end >= 0 else len(body)].rstrip("\r\n").encode("latin-1")
    if "/FlateDecode" in entries:
        for cut in (2, 0):  # behind the two bytes of its head, or without one
            try:
                return inflate(data[cut:]).decode("latin-1")
            except ValueError:
                continue
        return None
    if re.search("/(LZWDecode|ASCII85Decode|RunLengthDecode|DCTDecode|JPXDecode|JBIG2Decode|CCITTFaxDecode)", entries):
        return None
    return data.decode("latin-1")


def _read(rows: DataFrame) -> DataFrame:
    """path, num, entries, stream of objects (path, num, body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column(2).to_pylist()
            entries = [_dictionary(b or "") for b in bodies]
            streams = [_stream(b or "", e) for b, e in zip(bodies, entries, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.string()), pa.array(streams, pa.string())], names=["path", "num", "entries", "stream"])

    return rows.select("path", "num", "body").mapInArrow(run, "path string, num long, entries string, stream string")


def objects(files: DataFrame) -> DataFrame:
    """path, num, entries, stream: the objects of files (path, content), those inside of others too; of a number that repeats the last counts."""
    text = F.decode("content", "ISO-8859-1")
    found = files.select("path", F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(_OBJECT), F.lit(1)).alias("num"), F.regexp_extract_all(text, F.lit(_OBJECT), F.lit(2)).alias("body"))).alias("at", "x"))
    rows = found.groupBy("path", F.col("x.num").cast("long").alias("num")).agg(F.max_by("x.body", "at").alias("body"))
    folder = Staging(files.sparkSession, "pdf")
    plain = folder.save(_read(rows), "objects")
    packed = plain.where(F.regexp_like("entries", F.lit(r"/Type\s*/ObjStm")) & F.col("stream").isNotNull())
    first = F.regexp_extract("entries", r"/First\s+(\d+)", 1).try_cast("int")
    head = F.split(F.trim(F.substring(F.col("stream"), F.lit(1), F.col("first"))), r"\s+")
    packed = packed.withColumn("first", first).where("first IS NOT NULL").withColumn("head", head)
    number = lambda i: F.try_element_at("head", i.cast("int")).try_cast("long")
    each = packed.select("path", "stream", "first", "head", F.posexplode(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.size("head") / 2).cast("int")))).alias("at", "i"))
    each = each.select("path", "stream", "first", number(F.col("i") * 2 - 1).alias("num"), number(F.col("i") * 2).alias("off"), number(F.col("i") * 2 + 2).alias("upto")).where("num IS NOT NULL AND off IS NOT NULL")
    body = F.substring(F.col("stream"), F.col("first") + F.col("off").cast("int") + 1, F.coalesce(F.col("upto") - F.col("off"), F.length("stream").cast("long")).cast("int"))
    inner = each.groupBy("path", "num").agg(F.first(body).alias("body")).join(plain.select("path", "num"), ["path", "num"], "left_anti")
    return folder.save(plain.unionByName(_read(inner)), "all")


def _refs(entries: Column, name: str) -> Column:
    """The number of the object that an entry refers to."""
    return F.regexp_extract(entries, rf"/{name}\s+{_REF}", 1).try_cast("long")


def _of(rows: DataFrame, table: DataFrame, ref: str, **columns: str) -> DataFrame:
    """Adds columns of the objects that ``ref`` numbers; null where there are none."""
    wanted = table.select(F.col("path"), F.col("num").alias(ref), *[F.col(c).alias(a) for a, c in columns.items()])
    return rows.join(wanted, ["path", ref], "left")


def character_maps(table: DataFrame) -> DataFrame:
    """path, font, low, high, text, step: codes from low to high stand for ``text``, whose last unit grows with the code if step is 1; later entries win by ``at``."""
    fonts = table.where(F.regexp_like("entries", F.lit(r"/Type\s*/Font\b"))).select("path", F.col("num").alias("font"), "entries", _refs(F.col("entries"), "ToUnicode").alias("ref"))
    wide = F.regexp_like("entries", F.lit(r"/Subtype\s*/Type0|Identity-[HV]"))
    fonts = _of(fonts.withColumn("wide", wide), table, "ref", cmap="stream").where("cmap IS NOT NULL")
    many = lambda c, pattern, group: F.regexp_extract_all(c, F.lit(pattern), F.lit(group))
    pair = r"<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]*)>"
    chars = fonts.select("path", "font", "wide", F.explode(many(F.col("cmap"), r"(?s)beginbfchar(.*?)endbfchar", 1)).alias("part"))
    chars = chars.select("path", "font", "wide", F.posexplode(F.arrays_zip(many(F.col("part"), pair, 1).alias("low"), many(F.col("part"), pair, 2).alias("to"))).alias("at", "x"))
    chars = chars.select("path", "font", "wide", "at", F.col("x.low").alias("low"), F.col("x.low").alias("high"), F.col("x.to").alias("to"), F.lit(0).alias("step"))
    item = r"<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>\s*(\[[^\]]*\]|<[0-9a-fA-F]*>)"
    ranges = fonts.select("path", "font", "wide", F.explode(many(F.col("cmap"), r"(?s)beginbfrange(.*?)endbfrange", 1)).alias("part"))
    ranges = ranges.select("path", "font", "wide", F.posexplode(F.arrays_zip(*[many(F.col("part"), item, g).alias(a) for g, a in ((1, "low"), (2, "high"), (3, "to"))])).alias("at", "x")).select("path", "font", "wide", "at", "x.*")
    base = ranges.where(~F.col("to").startswith("[")).withColumns({"to": F.regexp_replace("to", "[<>]", ""), "step": F.lit(1)})
    listed = ranges.where(F.col("to").startswith("[")).select("path", "font", "wide", "at", "low", F.posexplode(many(F.col("to"), "<([0-9a-fA-F]*)>", 1)).alias("k", "to"))
    code = lambda c: F.conv(F.substring(c, -8, 8), 16, 10).cast("long")
    rows = chars.unionByName(base).select("path", "font", "wide", "at", code(F.col("low")).alias("from"), code(F.col("high")).alias("until"), F.length("low").alias("digits"), "to", "step")
    rows = rows.unionByName(listed.select("path", "font", "wide", "at", (code(F.col("low")) + F.col("k")).alias("from"), (code(F.col("low")) + F.col("k")).alias("until"), F.length("low").alias("digits"), "to", F.lit(0).alias("step")))
    width = F.max(F.when((F.col("digits") > 2) | F.col("wide"), 2).otherwise(1)).over(Window.partitionBy("path", "font"))
    return rows.where("until - `from` BETWEEN 0 AND 65535").select("path", "font", width.alias("width"), F.col("from").alias("low"), F.col("until").alias("high"), "to", "step", "at")


def pages(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, page, content: its streams one after the other) and (path, page, name, font: the fonts by name)."""
    found = table.where(F.regexp_like("entries", F.lit(r"/Type\s*/Page\b"))).select("path", F.col("num").alias("page"), "entries")
    inline = F.regexp_extract("entries", r"(?s)/Resources\s*(<<.*)", 1)
    d = found.select("path", "page", "entries", inline.alias("inline"), F.when(inline == "", _refs(F.col("entries"), "Resources")).alias("ref"))
    d = _of(d, table, "ref", other="entries").withColumn("resources", F.when(F.col("inline") != "", F.col("inline")).otherwise(F.coalesce("other", F.lit("")))).drop("ref", "other")
    own = F.regexp_extract("resources", r"(?s)/Font\s*(<<.*?>>)", 1)
    d = _of(d.withColumn("fonts", own).withColumn("ref", F.when(own == "", _refs(F.col("resources"), "Font"))), table, "ref", other="entries")
    fonts = F.when(F.col("fonts") != "", F.col("fonts")).otherwise(F.coalesce("other", F.lit("")))
    zipped = F.arrays_zip(F.regexp_extract_all(fonts, F.lit(_NAMED_REF), F.lit(1)).alias("name"), F.regexp_extract_all(fonts, F.lit(_NAMED_REF), F.lit(2)).alias("font"))
    named = d.select("path", "page", F.explode(zipped).alias("x")).groupBy("path", "page", F.col("x.name").alias("name")).agg(F.max(F.col("x.font").cast("long")).alias("font"))
    listed = F.regexp_extract("entries", r"/Contents\s*\[([^\]]*)\]", 1)
    refs = F.when(listed != "", F.regexp_extract_all(listed, F.lit(_REF), F.lit(1))).otherwise(F.array(_refs(F.col("entries"), "Contents").cast("string")))
    parts = _of(found.select("path", "page", F.posexplode(refs).alias("at", "x")).select("path", "page", "at", F.col("x").cast("long").alias("ref")), table, "ref", part="stream").where("part IS NOT NULL")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "\n")  # of one page
    return parts.groupBy("path", "page").agg(joined.alias("content")), named


def _literal(token: Column) -> Column:
    """The bytes of a string in parentheses or of hexadecimal digits, as characters up to 255."""
    body = F.substring(token, F.lit(2), F.length(token) - 2)
    latin = F.array(*[F.lit(chr(i)) for i in range(256)])  # 256 entries
    short = {"n": "\n", "r": "\r", "t": "\t", "b": " ", "f": " ", "\n": "", "\r": ""}

    def one(e: Column) -> Column:
        c, made = F.substring(e, 2, 3), F.substring(e, 2, 1)
        for k, v in short.items():
            made = F.when(c == k, F.lit(v)).otherwise(made)
        return F.when(c.rlike("^[0-7]"), F.element_at(latin, F.conv(F.when(c.rlike("^[0-7]"), c), 8, 10).cast("int") % 256 + 1)).otherwise(made)

    escapes = F.concat(F.transform(F.regexp_extract_all(body, F.lit(_ESCAPE), F.lit(0)), one), F.array(F.lit("")))
    plain = F.array_join(F.flatten(F.zip_with(F.split(body, _ESCAPE, -1), escapes, lambda a, b: F.array(a, b))), "")
    digits = F.regexp_replace(body, "[^0-9a-fA-F]", "")
    bytes_ = F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))
    return F.when(token.startswith("<"), F.decode(bytes_, "ISO-8859-1")).otherwise(plain)


def page_texts(contents: DataFrame, fonts: DataFrame, maps: DataFrame) -> DataFrame:
    """path, page, text: the contents of pages, with breaks where lines and paragraphs end."""
    page = Window.partitionBy("path", "page").orderBy("i")
    sofar, ahead = page.rowsBetween(Window.unboundedPreceding, 0), page.rowsBetween(0, Window.unboundedFollowing)
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    t = contents.select("path", "page", F.posexplode(F.regexp_extract_all("content", F.lit(_TOKEN), F.lit(0))).alias("i", "token"))
    t = t.withColumn("is_op", F.regexp_like("token", F.lit("^[A-Za-z'\"*]"))).withColumn("number", F.col("token").try_cast("double"))
    # Each token belongs to the next operator.
    t = t.withColumn("op_at", F.min(F.when(F.col("is_op"), F.col("i"))).over(ahead)).where("op_at IS NOT NULL")
    own = Window.partitionBy("path", "page", "op_at").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumns(
        {"op": F.last(F.when(F.col("is_op"), F.col("token")), True).over(own), "last_number": F.last("number", True).over(own), "numbers": F.count("number").over(own), "op_from": F.min("i").over(own), "name": F.last(F.when(F.col("token").startswith("/"), F.substring("token", 2, 200)), True).over(own)}
    )
    # The font and the leading that hold.
    is_op, op = F.col("is_op"), F.col("op")
    t = t.withColumns(
        {"font_name": F.last(F.when(is_op & (op == "Tf"), F.coalesce("name", F.lit(""))), True).over(sofar), "leading": F.last(F.when(is_op & op.isin("TL", "TD") & (F.col("numbers") >= F.when(op == "TD", 2).otherwise(1)), F.abs("last_number")), True).over(before)}
    )
    step = F.when(F.col("leading") > 0, F.col("leading")).otherwise(LEADING)
    # Moves: relative ones, and absolute ones; the first move behind BT is absolute.
    moves = is_op & ((op.isin("Td", "TD") & (F.col("numbers") >= 2)) | (op == "T*") | ((op == "Tm") & (F.col("numbers") >= 6)))
    t = t.withColumn("block", F.count(F.when(is_op & (op == "BT"), 1)).over(sofar)).withColumn("moves", moves)
    fresh = (F.col("block") > 0) & (F.count(F.when(F.col("moves"), 1)).over(Window.partitionBy("path", "page", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)) == 0)
    t = t.withColumn("absolute", F.col("moves") & ((op == "Tm") | (op.isin("Td", "TD") & fresh)))
    t = t.withColumn("y", F.when(F.col("absolute"), F.col("last_number")))
    quoted = is_op & op.isin("'", '"')
    t = t.withColumn("dy", F.when(F.col("moves") & op.isin("Td", "TD") & ~F.col("absolute"), F.col("last_number")).when((F.col("moves") & (op == "T*")) | quoted, -step))
    # The line: the last absolute position and the relative moves since.
    t = t.withColumn("since", F.count("y").over(before))
    moved = F.coalesce(F.sum("dy").over(Window.partitionBy("path", "page", "since").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    t = t.withColumn("line", F.last("y", True).over(before) + moved)
    gap = F.coalesce(F.abs("dy"), F.abs(F.col("line") - F.col("y")))
    t = t.withColumn("gap", gap)
    smallest = F.min(F.when(F.col("gap") > LEAST_GAP, F.col("gap"))).over(Window.partitionBy("path", "page"))
    t = t.withColumn("limit", smallest * PARAGRAPH)
    pieces = t.where("gap IS NOT NULL").select("path", "page", F.when(quoted, F.col("op_from")).otherwise(F.col("i")).alias("i"), F.lit(0).alias("k"),
        F.when(F.col("gap") < NO_GAP, " ").when(F.col("gap") > F.col("limit"), "\n\n").otherwise("\n").alias("v"))
    shows = ~is_op & op.isin("Tj", "TJ", "'", '"')
    kerns = t.where(shows & (op == "TJ") & (F.col("number") < KERN)).select("path", "page", "i", F.lit(1).alias("k"), F.lit(" ").alias("v"))
    strings = t.where(shows & F.regexp_like("token", F.lit("^[(<]"))).select("path", "page", "i", F.col("font_name").alias("name"), _literal(F.col("token")).alias("v"))
    strings = strings.join(fonts, ["path", "page", "name"], "left").join(maps.select("path", "font", "width").distinct(), ["path", "font"], "left")
    plain = strings.where("width IS NULL").select("path", "page", "i", F.lit(1).alias("k"), "v")
    codes = strings.where("width IS NOT NULL AND v <> ''").select("path", "page", "i", "font", "width", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), (F.length("v") / F.col("width")).cast("int"))), lambda j: F.substring(F.col("v"), (j - 1) * F.col("width") + 1, F.col("width")))).alias("k", "unit"))
    codes = codes.withColumn("code", F.when(F.col("width") == 2, F.ascii("unit") * 256 + F.ascii(F.substring("unit", 2, 1))).otherwise(F.ascii("unit")).cast("long"))
    ranges = maps.select(F.col("path").alias("its_path"), F.col("font").alias("its_font"), "low", "high", "to", "step", F.col("at").alias("entry"))
    met = codes.join(ranges, (F.col("path") == F.col("its_path")) & (F.col("font") == F.col("its_font")) & F.col("code").between(F.col("low"), F.col("high")), "left")
    grown = F.lpad(F.lower(F.hex(F.conv(F.substring("to", -8, 8), 16, 10).cast("long") + F.col("code") - F.col("low"))), 4, "0")
    hexes = F.when(F.col("step") == 1, F.when(F.length("to") <= 4, grown).otherwise(F.concat(F.expr("left(to, length(to) - 4)"), F.expr("right(lpad(lower(hex(cast(conv(right(to, 4), 16, 10) AS long) + code - low)), 4, '0'), 4)")))).otherwise(F.col("to"))
    padded = F.rpad(hexes, (F.ceil(F.length(hexes) / 4) * 4).cast("int"), "0")
    paired = F.regexp_replace(F.upper(padded), "(?:D[89AB][0-9A-F]{2})(?!D[C-F])", "FFFD")  # a half of a pair is no character
    made = F.when(F.col("to").isNull(), F.when(F.col("width") == 1, F.col("unit")).otherwise("")).otherwise(F.coalesce(F.decode(F.unhex(paired), "UTF-16BE"), F.lit("")))
    best = met.groupBy("path", "page", "i", "k").agg(F.max_by(made, F.coalesce("entry", F.lit(0)) + F.coalesce("step", F.lit(0)) * 1_000_000).alias("v"))
    rows = pieces.unionByName(kerns).unionByName(plain).unionByName(best.withColumn("k", F.col("k") + 1))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "k", "v"))), lambda x: x["v"]), "")  # of one page
    return rows.groupBy("path", "page").agg(text.alias("text"))


def reflow(text: Column) -> Column:
    """Joins the lines of each paragraph, and words that were parted at their ends."""
    t = F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"([A-Za-z0-9_])-\n(?!\n)([a-z])", "$1$2")
    clean = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    block = lambda b: F.array_join(F.filter(F.transform(F.split(b, "\n"), clean), lambda x: x != ""), " ")
    joined = F.array_join(F.filter(F.transform(F.split(t, r"\n{2,}"), block), lambda x: x != ""), "\n\n")
    return F.regexp_replace(joined, r"[ \t]{2,}", " ")


def loose_streams(files: DataFrame) -> DataFrame:
    """path, page, content: every stream of a file that may show text, whatever its objects say; by its place."""
    text = F.decode("content", "ISO-8859-1")
    found = F.regexp_extract_all(text, F.lit(r"(?s)<<((?:(?!<<).){0,4000}?>>\s*stream\r?\n?.*?)(?:endstream|\z)"), F.lit(1))
    rows = files.select("path", F.posexplode(found).alias("num", "body")).select("path", F.col("num").cast("long").alias("num"), F.concat(F.lit("<<"), "body").alias("body"))
    rows = rows.where(~F.regexp_like(F.substring_index("body", "stream", 1), F.lit("/(Image|DCTDecode|JPXDecode|XRef|Metadata|EmbeddedFile|JBIG2Decode|CCITTFaxDecode)")))
    return _read(rows).where("stream IS NOT NULL").where(F.regexp_like("stream", F.lit(r"\b(BT|Tj|TJ)\b"))).select("path", F.col("num").alias("page"), F.col("stream").alias("content"))


def extract_pdf(files: DataFrame) -> DataFrame:
    """path, text, note, error of PDF files (path, content); paths are the key and repeat in no row.

    Files whose objects give no words are swept for streams. Such without a text layer, null and broken contents have an
    error and a null text. Pages go by the numbers of their objects. Other columns are not read.
    """
    known = files.select("path", "content").where("path IS NOT NULL")
    pdfs = known.where("content IS NOT NULL")
    table = objects(pdfs)
    maps = Staging(files.sparkSession, "pdf-maps").save(character_maps(table), "maps")
    contents, fonts = pages(table)

    def whole(contents: DataFrame, fonts: DataFrame) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct("page", "text")))  # of one file
        return page_texts(contents, fonts, maps).groupBy("path").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias("text"))

    words = F.regexp_like("text", F.lit("[A-Za-z]{3,}"))
    good = Staging(files.sparkSession, "pdf-texts").save(whole(contents, fonts).where(words), "texts")
    swept = whole(loose_streams(pdfs.join(good.select("path"), "path", "left_anti")), fonts.where("false")).where(words)
    made = known.select("path").join(good.unionByName(swept), "path", "left").withColumn("text", reflow(F.translate("text", "\0", "")))
    note = F.when(legibility(F.col("text")) < PDF_LEGIBLE, NOTES["pdf"])
    return made.select("path", "text", F.when(F.col("text").isNotNull(), note).alias("note"), F.when(F.col("text").isNull(), ERROR).alias("error"))
