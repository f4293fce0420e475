"""Pages by tokens against SQL that is worked out apart, and files that are broken in many ways."""

import io
import random
import zipfile
import zlib

import duckdb
import pytest

from inkgauge.plans import oracles
from inkgauge.sources import extract as X

PAGES = [
    ("It&#8217;s &mdash; caf&eacute; &#x1F600; &#150; &copy 2020 &unknown; &#0; &#xD800; &#99999999999; &amp;lt;", "It’s — café 😀 – © 2020 &unknown; � � � &lt;"),
    ("<a title='x > y'>z</a> <b title=\"<p>\">q</b>", "z q"),
    ("a<script>var x = 1; if (a<b) ", "a"),
    ("<html><head><title>t</title><script>'</p>'</script></head><body>in<p>one<p>two<br>three<div>four</div>five", "inone\n\ntwo\n\nthree\n\nfour\n\nfive"),
    ("<ul><li>a<li>b<ul><li>c</li></ul></ul><table><tr><td>1<td>2<tr><td>3</table>", "a\n\nbc\n\n12\n\n3"),
    ("<!-- a > <p> -->x<!doctype y>z<svg/>kept<svg><text>no</text></svg>1 < 2 & 3 </ foo>bar", "xzkept1 < 2 & 3 bar"),
    ("\r\na\r\n<P CLASS=x>b</P > c ", "a\nb\n\n c"),
    ("x <!-- never ends <p>y", "x"),
    ("<p title=it's>ok</p>", "ok"),
    (None, None),
    ("", ""),
]


def test_pages_by_tokens_equal_sql(spark):
    df = spark.createDataFrame([(i, p, "x") for i, (p, _) in enumerate(PAGES)] + [(0, PAGES[0][0], "x"), (None, "<p>no key", "x")], "page_id long, html string, text string")
    got = X.extract_pages(df).collect()
    assert {r["page_id"]: r["text"] for r in got} == {**{i: t for i, (_, t) in enumerate(PAGES)}, None: "no key"}
    con = duckdb.connect()
    con.register("pages", df.toArrow())
    want = con.sql(oracles.SQL["page_texts"]).select("page_id, text, legible, enough").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert X.extract_pages(df.limit(0)).count() == 0


def test_guards_take_all_white_space(spark):
    rows = [(1, "&nbsp;" * 60 + "x" * 39), (2, "&nbsp;" + "x" * 40)]
    got = {r["page_id"]: (r["text"], r["enough"], r["legible"]) for r in X.extract_pages(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got == {1: ("x" * 39, False, 1.0), 2: ("x" * 40, True, 1.0)}


def test_many_quotes_and_long_pages_do_not_overflow(spark):
    page = "<p " + "a='>' " * 20_000 + ">" + "<b>x</b>" * 20_000 + "<p>" + "y&lt;" * 20_000
    got = X.extract_pages(spark.createDataFrame([(1, page)], "page_id long, html string")).first()["text"]
    assert got == "x" * 20_000 + "\n\n" + "y<" * 20_000


def docx(text, **kind):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w", **kind) as z:
        z.writestr("word/document.xml", text)
    return made.getvalue()


def read(spark, files):
    df = spark.createDataFrame([(p, None if c is None else bytearray(c), "x") for p, c in files], "path string, content binary, error string")
    return {r["path"]: r for r in X.extract_files(df).collect()}


def test_broken_files_do_not_end_the_job(spark):
    rng = random.Random(1)
    text = "<w:p>" + " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)) + "</w:p>"
    whole = bytearray(docx(text, compression=zipfile.ZIP_DEFLATED))
    fault = whole[:]
    fault[9000:9010] = b"\xff" * 10
    locked = bytearray(docx("<w:p>x</w:p>"))
    locked[locked.find(b"PK\1\2") + 8] |= 1
    other = bytearray(docx("<w:p>x</w:p>", compression=zipfile.ZIP_BZIP2))
    got = read(spark, [
        ("entity.docx", docx("<w:p>a &#60;b&#62; c &amp;#60; &nbsp;&bogus;</w:p>")), ("fault.docx", bytes(fault)), ("locked.docx", bytes(locked)), ("other.docx", bytes(other)),
        ("short.docx", bytes(whole[:4000])), ("emoji.rtf", rb"{\rtf1 caf\'e9 \u-10179?\u-8704? \u8212? {\*\gen x}end\par}"), ("half.rtf", rb"{\rtf1 a\u-10179?b}"),
        ("old.doc", b"\xd0\xcf\x11\xe0\0\0" + b"plain words of an old file \0\1\2" * 20), ("few.doc", b"\xd0\xcf\x11\xe0 few words"), ("x.odt", docx("<w:p>x</w:p>")), ("none.rtf", None), (None, b"text"),
    ])
    assert got["entity.docx"]["text"].strip() == "a <b> c &#60;  &bogus;"
    kept = got["fault.docx"]["text"]
    assert kept and text[5:].startswith(kept[:3000]) and kept.strip() != text[5:-6] and got["fault.docx"]["error"] is None
    for path in ("locked.docx", "other.docx", "short.docx", "few.doc", "x.odt", "none.rtf"):
        assert got[path]["text"] is None and got[path]["error"] and got[path]["note"] is None, path
    assert got["emoji.rtf"]["text"].split() == ["café", "😀", "—", "end"] and got["half.rtf"]["text"] == "a�b"
    assert got["old.doc"]["note"].startswith("Legacy") and "plain words of an old file" in got["old.doc"]["text"]


def test_inflate_keeps_what_comes_before_a_fault():
    data = bytes(random.Random(2).choices(b"abcdefgh ", k=50_000))
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    raw = packer.compress(data) + packer.flush()
    assert X.inflate(raw) == data == X.inflate(raw + b"\r\n padding")
    half = X.inflate(raw[: len(raw) // 2])
    assert half and data.startswith(half) and len(half) > 10_000
    with pytest.raises(ValueError):
        X.inflate(b"\xff\xff\xff")
    with pytest.raises(ValueError):
        X.inflate(raw, most=1000)
