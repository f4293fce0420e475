"""Hand-made PDF files: fonts with maps, packed objects, gaps of lines, sweeps of loose streams, broken ones."""

import zlib

from inkgauge.sources import pdf as X


def packed(text, extra=b""):
    data = zlib.compress(text if isinstance(text, bytes) else text.encode("latin-1"))
    return b"<< /Length %d /Filter /FlateDecode %s >>\nstream\r\n%s\nendstream" % (len(data), extra, data)


def document(*objects):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects) + b"%%EOF"


SIMPLE = document(
    (1, b"<< /Type /Page /Resources << /Font << /F1 5 0 R >> >> /Contents [3 0 R 4 0 R] >>"),
    (3, packed("BT /F1 12 Tf 14 TL 72 700 Td (First li\\156e with \\(paren\\) and a hy-) Tj T* (phen ends here.) Tj 0 -14 Td [(Ker) -50 (ned) -300 (words)] TJ")),
    (4, packed("0 -40 Td (New paragraph.) Tj T* <4142 43> Tj (second \\\nline) ' ET BT 72 300 Td (Far (nested) away) Tj ET")),
    (5, b"<< /Type /Font /Subtype /Type1 >>"),
    (2, b"<< /Type /Page /Resources 6 0 R /Contents 7 0 R >>"),
    (6, b"<< /Font 8 0 R >>"),
    (7, b"<< /Length 5 >> stream\nBT /F9 9 Tf 1 0 0 1 72 700 Tm (page two) Tj ET\nendstream"),
    (8, b"<< /F9 5 0 R >>"),
)
CMAP = """1 beginbfchar <0003> <0020> endbfchar 2 beginbfrange <0010> <0029> <0061> <0040> <0042> [<00660069> <D83DDE00> <D83D>] endbfrange 1 beginbfchar <0050> <2014> endbfchar"""
MAPPED = document(
    (1, b"<< /Type /Page /Resources << /Font << /T0 5 0 R >> >> /Contents 3 0 R >>"),
    (3, packed("BT /T0 12 Tf 72 700 Td <001800190011> Tj <0003> Tj <0040004100420050ffff> Tj <00100011> Tj ET")),
    (9, packed("5 0 6 50 " + "<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>".ljust(50) + "<< /Nothing 1 >>", b"/Type /ObjStm /N 2 /First 9")),
    (6, packed(CMAP)),
)
LOOSE = b"junk << /Length 9 /Filter /FlateDecode >>\nstream\n" + zlib.compress(b"BT (loose words) Tj ET") + b"\nendstream << /Subtype /Image >> stream\nBT (image) Tj\nendstream"


def test_pdf_files_become_text(spark):
    rows = [("a.pdf", SIMPLE), ("b.pdf", MAPPED), ("c.pdf", LOOSE), ("d.pdf", b"%PDF no text"), ("e.pdf", None), ("f.pdf", b"")]
    files = spark.createDataFrame([(p, None if c is None else bytearray(c), "x") for p, c in rows], "path string, content binary, text string")
    got = {r["path"]: r for r in X.extract_pdf(files).collect()}
    assert got["a.pdf"]["text"] == "First line with (paren) and a hyphen ends here. Kerned words\n\nNew paragraph. ABC second line\n\nFar (nested) away\n\npage two"
    assert got["b.pdf"]["text"] == "ijb fi😀�—ab"
    assert got["c.pdf"]["text"] == "loose words" and got["a.pdf"]["note"] is None
    for path in ("d.pdf", "e.pdf", "f.pdf"):
        assert got[path]["text"] is None and got[path]["error"], path
    assert X.extract_pdf(files.limit(0)).count() == 0


def test_dictionaries_and_streams():
    assert X._dictionary("x << /A << /B 1 >> /C >> y >>") == "<< /A << /B 1 >> /C >>" and X._dictionary("none") == ""
    assert X._stream("<< /Filter /FlateDecode >> stream\n\xff\xff\xff\xff\nendstream", "/FlateDecode") is None
    assert X._stream("<< /Filter /DCTDecode >> stream\nx\nendstream", "/DCTDecode") is None and X._stream("no", "") is None
    data = zlib.compress(b"some words that go on and on and on")
    assert X._stream("stream\n" + data[:-6].decode("latin-1") + "\nendstream", "/FlateDecode").startswith("some words")
