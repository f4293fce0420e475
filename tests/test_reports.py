import io
import zipfile

import duckdb

from inkgauge.operators import reports as R
from inkgauge.operators import signals as G
from inkgauge.operators import style as S
from inkgauge.plans import oracles
from inkgauge.sources import extract

NOTE = "However, it is important to note that the plan may work. We don't know. " * 9


def archive(**parts):
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return made.getvalue()


def test_files_become_text(spark):
    docx = archive(**{"word__header1.xml": "<w:p>head</w:p>", "word__document.xml": "<w:p>one<w:tab/>two &amp; &#233;&#x41;</w:p><w:p>three</w:p>"})
    pptx = archive(**{"ppt__slides__slide10.xml": "<a:p>ten</a:p>", "ppt__slides__slide2.xml": "<a:p>two</a:p>"})
    rows = [
        ("a.docx", docx), ("b.PPTX", pptx), ("c.odt", archive(**{"content.xml": "<text:p>x<text:tab/>y</text:p>"})),
        ("d.epub", archive(**{"b.html": "<body><p>second</body>", "a.xhtml": "<head>no</head><p>first</p>"})), ("e.rtf", rb"{\rtf1 caf\'e9\par {\*\x y}end}"),
        ("f.txt", "né\0t".encode()), ("g.docx", b"broken"), ("h.pdf", b"%PDF"), ("i.bin", bytes(range(256))), ("j.cfg", b"plain words here"), ("k.txt", None), ("l.csv", b""),
    ]
    files = spark.createDataFrame([(p, None if c is None else bytearray(c), "x") for p, c in rows], "path string, content binary, text string")
    got = {r["path"]: r for r in extract.extract_files(files).collect()}
    assert got["a.docx"]["text"].split() == ["one", "two", "&", "éA", "three", "head"] and "\t" in got["a.docx"]["text"]
    assert got["b.PPTX"]["text"].split() == ["two", "ten"] and got["c.odt"]["text"].strip() == "x\ty" and got["d.epub"]["text"].split() == ["first", "second"]
    assert got["e.rtf"]["text"].split() == ["café", "end"]
    assert got["f.txt"]["text"] == "nét" and got["j.cfg"]["note"] and got["l.csv"]["text"] == ""
    for path in ("g.docx", "h.pdf", "i.bin", "k.txt"):
        assert got[path]["text"] is None and got[path]["error"]
    assert extract.extract_files(files.limit(0)).count() == 0


def test_pages_become_text(spark):
    html = "<html><head><title>t</title></head><body><!-- no <p> --><script>if (a<b) x()</script><p>one<p>two<br>three &lt;b&gt; &amp;lt;</body>"
    rows = [(1, html, "x"), (2, None, "x"), (3, "", "x"), (1, html, "x"), (None, "<p>no key", "x")]
    got = sorted(map(tuple, extract.extract_pages(spark.createDataFrame(rows, "page_id long, html string, text string")).select("page_id", "text").collect()), key=str)
    assert got == sorted([(1, "one\n\ntwo\n\nthree <b> &lt;")] * 2 + [(2, None), (3, ""), (None, "no key")], key=str)


def test_style_queries_equal_their_sql_on_a_fixture(spark):
    odd = "- one\n\t* two\n 3. three\n\n - four\nIn the U.S. Army. etc. then. ...etc. No more.  2. 5\n“Quoted!” he said... And qu'il l'été part. " + "the the the thé théé été été " * 4
    spanish = "de la que el en y a los se del las un por con no una su para es al. Es importante destacar que podría ser; en el mundo actual me gusta. " * 3
    rows = [(1, NOTE), (2, odd + NOTE), (3, spanish), (4, None), (5, ""), (6, "Short."), (1, NOTE), (2, odd), (None, NOTE)]
    docs = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id long, text string, source string, words int")
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    same = lambda df, name: sorted(map(str, df.select(*sorted(df.columns)).collect())) and {repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect()} == {
        repr(tuple(r)) for r in con.sql(oracles.SQL[name]).select(*[f'"{c}"' for c in sorted(df.columns)]).fetchall()
    }
    assert same(G.register_hits(docs), "register_hits") and G.register_hits(docs).count() > 2
    assert same(R.paragraph_rows(docs), "paragraphs") and same(S.sentences(S.unique(docs)), "sentences")
    prepared = G.corpus(docs)
    wide = G.document_signals(prepared, G.corpus_lexicon(prepared))
    assert wide.count() == wide.select("doc_id").distinct().count() == 4
    got = {(r["doc_id"], r["signal"]): r["value"] for r in G.signals_long(wide).collect()}
    want = {(r[0], r[1]): r[2] for r in con.sql(oracles.SQL["signals_long"]).select("doc_id, signal, value").fetchall()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    scores = G.index_scores(wide, G.signals_long(wide))
    assert "prose" in scores.columns and same(R.plain_reading(scores), "plain_reading") and same(R.shape_reasons(wide), "shape_reasons")


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    prepared = G.corpus(docs)
    wide = G.document_signals(prepared, G.corpus_lexicon(prepared))
    assert wide.count() == G.signals_long(wide).count() == R.plate_pages(prepared).count() == R.paragraph_rows(docs).count() == 0


def test_lexicon_from_a_file(spark, tmp_path):
    (tmp_path / "ranks.txt").write_text("en\tthe\nen\tof\nen\tThe\nen\tand\nfr\tde\n")
    got = sorted(map(tuple, G.read_lexicon(spark, str(tmp_path / "ranks.txt")).collect()))
    assert got == [("en", "and", 4), ("en", "of", 2), ("en", "the", 1), ("fr", "de", 1)]
