"""Text out of files and web pages.

Web pages are read by tokens: one pattern goes over a page from left to right and tells comments, elements
that are left out, declarations and tags with their quoted attributes apart; what remains of a tag is its
name between two marks. Ends of paragraphs, list items and rows that a page leaves out are put in,
blocks are parted, marks go, and references to characters are looked up in one pass. All of that, and
the XML of office files, are expressions; only archives and the character escapes of rich text are
opened in Python, a row at a time in Arrow batches.
"""

from __future__ import annotations

import html.entities
import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.style import SPACE, enough, trimmed

# Kinds of files that are text, elements that are left out of a page, and those that part blocks.
PLAIN = ("txt", "text", "md", "markdown", "csv", "log", "tex", "json", "srt", "vtt")
ACCEPTED = ("txt", "md", "markdown", "text", "csv", "log", "rtf", "html", "htm", "xml", "json", "pdf", "docx", "doc", "odt", "pptx", "epub", "tex")
LEFT_OUT = ("script", "style", "noscript", "svg", "head")
BLOCKS = "p|div|li|br|h[1-6]|tr|section|article|blockquote"
#: Tags before which a paragraph that lacks its end is over.
CLOSE_P = (
    "address|article|aside|blockquote|body|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hgroup|hr|html|li|main|menu|nav|ol|p|pre|section"
    "|summary|table|tbody|td|tfoot|th|thead|tr|ul"
)
#: What of a text is legible, in its first characters, at least; and of a PDF whose fonts can be read.
LEGIBLE_CHARS, LEGIBLE, PDF_LEGIBLE = 20_000, 0.6, 0.45
#: An old .doc has so many words at least.
DOC_WORDS = 50
#: Bytes that the parts of an archive hold at most when unpacked.
MOST_BYTES = 1 << 28
#: Parts of archives: which files, in what order, and what becomes a break before tags go.
PARTS = {
    "docx": (r"word/(document|(header|footer|footnotes|endnotes)\d*)\.xml", {"<w:tab/>": "\t", "<w:br/?>": "\n", "</w:p>": "\n\n"}),
    "pptx": (r"ppt/(slides|notesSlides)/[^/]+\.xml", {"</a:p>": "\n", "</a:tr>": "\n"}),
    "odt": (r"content\.xml", {"<text:tab/>": "\t", "<text:line-break/>": "\n", "</text:(p|h)>": "\n\n"}),
    "epub": (r".*\.x?html?", {}),
}
# What is said of a file that could be read in part, or not at all.
NOTES = {
    "pptx": "Slide text only: speaker notes and shapes without text frames are skipped.",
    "doc": "Legacy .doc format: extraction is approximate. Typography signals are unreliable for this file.",
    "pdf": "This PDF's fonts carry no reliable character map, so extraction is partial. Paste the text instead for a trustworthy reading.",
}
DOC_ERROR = "Legacy .doc binaries are not readable here. Save as .docx or paste the text."

# A tag from behind its name: attributes, whose quoted values may hold anything, and its end.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z))?+)*+(?:>|\z)"""
_NAMED = r"(?=[\s/>])"
_TOKEN = (
    r"(?is)<!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|<svg{_NAMED}{_REST}(?<=/>)"
    rf"|<(script|style|noscript|svg|template){_NAMED}{_REST}.*?(?:</\1{_NAMED}{_REST}|\z)"
    rf"|<head{_NAMED}{_REST}.*?(?:</head{_NAMED}{_REST}|(?=<body[\s>])|\z)"
    rf"|<[!?][^>]*+(?:>|\z)|</(?![a-z])[^>]*+(?:>|\z)"
    rf"|<(/?+)([a-z][^\s/>]*+){_REST}"
)
_IN, _OUT = "\u0001", "\u0002"


def _ended(text: Column, opened: str, among: str, closing: str) -> Column:
    """Puts breaks where an element ends that lacks its end tag: before a ``closing`` tag, if no other tag of ``among`` is between."""
    between = rf"[^{_IN}]*+(?:{_IN}(?!/?+(?:{among}){_OUT})[^{_IN}]*+)*+"
    return F.regexp_replace(text, f"(?i){_IN}{opened}{_OUT}{between}(?={_IN}(?:{closing}){_OUT}|\\z)", "$0\n\n")


def characters(text: Column, pattern: str, names: dict[str, str], windows: bool = False) -> Column:
    """Replaces references to characters, by number or name, in one pass; unknown names stay.

    Numbers of no character become U+FFFD; with ``windows``, those from 128 to 159 are read as pages mean them.
    """
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    odd = {i: bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)} if windows else {}
    moved = F.from_json(F.lit(json.dumps({str(i): c for i, c in odd.items() if c})), "map<string,string>")

    def one(ref: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(ref, "^&#[xX]?0*([0-9a-fA-F]*);?$", 1), "^$", "0")
        small = F.length(digits) <= 7
        code = F.when(ref.rlike("^&#[xX]"), F.conv(F.when(small, digits), 16, 10).try_cast("long")).otherwise(F.when(small, digits).try_cast("long"))
        fits = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        made = F.decode(F.unhex(F.lpad(F.hex(F.when(fits, code)), 8, "0")), "UTF-32")
        numbered = F.coalesce(F.try_element_at(moved, code.cast("string")), made, F.lit("\ufffd"))
        return F.when(ref.startswith("&#"), numbered).otherwise(F.coalesce(F.try_element_at(table, F.substring(ref, 2, 64)), ref))

    def resolved(t: Column) -> Column:
        found = F.concat(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), one), F.array(F.lit("")))
        joined = F.array_join(F.flatten(F.zip_with(F.split(t, pattern, -1), found, lambda a, b: F.array(a, b))), "")
        return F.when(F.contains(t, F.lit("&")), joined).otherwise(t)

    return F.transform(F.array(text), resolved)[0]  # an element of an array is worked out once


_LEGACY = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_HTML_REFERENCE = r"&(?:#[xX][0-9a-fA-F]++;?+|#[0-9]++;?+|[a-zA-Z][a-zA-Z0-9]*+;|(?:" + "|".join(_LEGACY) + "))"
# The names that files of XML know; a blank that does not break is a blank.
_XML_NAMES = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "apos;": "'", "nbsp;": " "}


def html_to_text(page: Column) -> Column:
    """The text of a page: blocks parted by blank lines; scripts, styles, heads and comments are left out. Null stays null.

    A comment, script or quoted value that does not end takes the rest of the page with it, as in a browser.
    """
    text = F.translate(F.regexp_replace(page, "\r\n?", "\n"), f"\0{_IN}{_OUT}", "")
    text = F.regexp_replace(text, _TOKEN, f"{_IN}$2$3{_OUT}")
    text = F.regexp_replace(text, f"{_IN}{_OUT}", "")
    text = _ended(text, "p", CLOSE_P, f"(?!/p{_OUT})/?+(?:{CLOSE_P})")
    text = _ended(text, "li", "li|ul|ol|menu", "li|/ul|/ol|/menu")
    text = _ended(text, "tr", "tr|table|tbody|thead|tfoot", "tr|/table|/?tbody|/?thead|/?tfoot")
    text = F.regexp_replace(text, f"(?i){_IN}(?:/(?:{BLOCKS})|br){_OUT}", "\n\n")
    text = F.regexp_replace(text, f"{_IN}[^{_OUT}]*+{_OUT}", "")
    return F.regexp_replace(characters(text, _HTML_REFERENCE, html.entities.html5, windows=True), "\n{3,}", "\n\n")


def legibility(text: Column) -> Column:
    """The share of plain characters among the first ones; 0 of an empty text."""
    head = F.substring(text, 1, LEGIBLE_CHARS)
    return F.when(F.length(head) > 0, F.regexp_count(head, F.lit(f"[A-Za-z0-9.,;:'\"()\\-?!]|{SPACE}")) / F.length(head)).otherwise(0.0)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, text, legible, enough: a row per page; null pages give null texts. Other columns are not read."""
    made = pages.select("page_id", trimmed(html_to_text(F.col("html"))).alias("text"))
    return made.select("page_id", "text", F.round(legibility(F.col("text")) + 1e-10, 6).alias("legible"), enough(F.col("text")).alias("enough"))


def inflate(raw: bytes, most: int = MOST_BYTES) -> bytes:
    """Unpacks a raw deflate stream; of a broken or truncated one, what comes before the fault, if anything."""
    out, size, at = [], 0, 0
    stream = zlib.decompressobj(-15)
    while at < len(raw) and not stream.eof:
        saved, part = stream.copy(), raw[at : at + 4096]
        try:
            made = [stream.decompress(part)]
        except zlib.error:
            made, stream = [], saved
            for i in range(len(part)):
                try:
                    made.append(stream.decompress(part[i : i + 1]))
                except zlib.error:
                    break
            at = len(raw)
        out += made
        size += sum(map(len, made))
        at += len(part)
        if size > most:
            raise ValueError("an embedded stream is too large")
    if not size:
        raise ValueError("could not decompress an embedded stream")
    return b"".join(out)


def _member(content: bytes, entry: zipfile.ZipInfo, most: int) -> bytes:
    """The bytes of an archive's file, as far as they can be read."""
    if entry.flag_bits & 1:
        raise ValueError("the archive is locked")
    head = content[entry.header_offset : entry.header_offset + 30]
    if len(head) < 30:
        raise ValueError("not a readable archive")
    name, extra = struct.unpack("<HH", head[26:])
    begin = entry.header_offset + 30 + name + extra
    raw = content[begin : begin + entry.compress_size]
    if entry.compress_type == zipfile.ZIP_STORED:
        return raw
    if entry.compress_type != zipfile.ZIP_DEFLATED:
        raise ValueError("unsupported compression in archive")
    return inflate(raw, most)


def _parts(content: bytes, kind: str) -> str:
    """The markup of an archive's parts, with breaks in place."""
    wanted, breaks = PARTS[kind]
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        found = {e.filename: e for e in archive.infolist() if re.fullmatch(wanted, e.filename, re.IGNORECASE if kind == "epub" else 0)}
    names = list(found)
    if kind == "pptx":
        names.sort(key=lambda n: int((re.findall(r"\d+", n) or ["0"])[0]))
    elif kind == "epub":
        names.sort()
    else:
        names.sort(key=lambda n: n != "word/document.xml")
    if kind == "odt" and not names:
        raise ValueError("no content.xml in the document")
    texts, left = [], MOST_BYTES
    for n in names:
        data = _member(content, found[n], left)
        left -= len(data)
        texts.append(data.decode("utf-8", "replace"))
    for pattern, made in breaks.items():
        texts = [re.sub(pattern, made, t) for t in texts]
    return "\n\n".join(texts)


def _rich(text: str) -> str:
    """The text of rich text. Characters outside the first plane are written as two numbers, which are joined."""
    text = re.sub(r"(?i)\\'([0-9a-f]{2})", lambda m: chr(int(m[1], 16)), text)
    text = re.sub(r"\{\\\*[^{}]*\}", "", text)
    text = re.sub(r"\\tab\b", "\t", re.sub(r"\\line\b", "\n", re.sub(r"\\pard?\b", "\n\n", text)))
    text = re.sub(r"\\u(-?\d{1,9})\s?\??", lambda m: chr(int(m[1]) % 65536), text)
    text = re.sub(r"[{}]", "", re.sub(r"(?i)\\[a-z]+-?\d* ?", "", text))
    return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")


def extract_files(files: DataFrame) -> DataFrame:
    """path, text, note, error of files (path, content), such as the source ``binaryFile`` gives.

    A row per row. What cannot be read has an error and a null text, and does not end the job: broken or
    locked archives, such that unpack to more than ``MOST_BYTES``, old .doc files of few words, unknown kinds
    that are not legible, PDF (``sources.pdf`` reads those), null contents. Of archives whose streams
    break off, what comes before is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, errors = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                kind, data, error = (path or "").lower().rpartition(".")[2], content.as_py(), None
                kind = {"ods": "odt", "odp": "odt"}.get(kind, kind)
                try:
                    if data is None:
                        raise ValueError("no content")
                    if kind == "pdf":
                        raise ValueError("cannot read .pdf files here")
                    if kind in PARTS:
                        text = _parts(data, kind)
                    elif kind in ("rtf", "doc"):
                        text = _rich(data.decode("latin-1")) if kind == "rtf" else data.decode("latin-1")
                    else:
                        text = data.decode("utf-8", "replace")
                except (ValueError, KeyError, OSError, EOFError, RuntimeError, struct.error, zlib.error, zipfile.BadZipFile, zipfile.LargeZipFile) as e:
                    text, error = None, str(e)
                raw.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.string()), pa.array(errors, pa.string())], names=["path", "raw", "error"])

    d = files.select("path", "content").mapInArrow(run, "path string, raw string, error string")
    raw = F.col("raw")
    d = d.withColumn("kind", F.lower(F.substring_index("path", ".", -1)))
    office, pages, rich = ("docx", "pptx", "odt", "ods", "odp"), ("html", "htm", "xhtml", "epub"), ("rtf",)
    kind = F.col("kind")
    # Tags go first: what a reference stands for is text.
    xml = characters(F.regexp_replace(raw, "<[^>]+>", ""), r"&(?:#[xX]?[0-9a-fA-F]++|[a-z]++);", _XML_NAMES)
    saved = F.regexp_replace(raw, r"[^\t\n\r -~\u00a0-\u024f]+", " ")
    doc = F.when(F.regexp_count(saved, F.lit("[A-Za-z]{2,}")) >= DOC_WORDS, F.regexp_replace(saved, SPACE + "{3,}", "\n\n"))
    text = (
        F.when(kind.isin(*PLAIN, *rich), raw).when(kind.isin(*pages), html_to_text(raw)).when(kind.isin(*office), xml)
        .when(kind == "doc", doc).when(legibility(raw) > LEGIBLE, raw)
    )
    d = d.withColumn("text", F.replace(text, F.lit("\0"), F.lit("")))
    known = kind.isin(*PLAIN, *rich, *pages, *office, "doc", "pdf")
    note = F.when(kind == "pptx", NOTES["pptx"]).when(kind == "doc", NOTES["doc"]).when(~known, F.concat(F.lit("Unrecognised extension ."), kind, F.lit(", read as plain text.")))
    error = F.when(F.col("text").isNull(), F.coalesce("error", F.when(kind == "doc", DOC_ERROR).otherwise(F.concat(F.lit("cannot read ."), kind, F.lit(" files")))))
    return d.select("path", "text", F.when(F.col("text").isNotNull(), note).alias("note"), error.alias("error"))
