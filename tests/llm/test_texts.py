"""Operators that map each text alone, against the libraries and brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgauge.llm import media as M
from inkgauge.llm import secrets as S
from inkgauge.llm.common import tokenizer_path
from inkgauge.llm.piece_codec import digest_documents, encode_documents
from inkgauge.llm.token_counts import count_tokens

TEXTS = [
    None, "", " ", "  two  gaps ", "plain words here", "plain words here", "▁ mark ▁▁ x", "Ünïcödé 漢字 🎈\ttab\nline\n\n",
    "<|endoftext|> x <s> </s> <|startoftext|>y", "a" * 5000, "word " * 3000, "it's DON'T 12345 x2y",
    "\x1c sep \x1d", " nbsp​zero",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    alphabet = "abc  \n'.é漢▁1"
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i, t, "x", 7) for i, t in enumerate(texts)] + [(None, "no key", "x", 7), (4, "plain words here", "x", 7)]
    # Further columns carry names that the operators use inside.
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, spans int")


def by_text(df, docs):
    """Rows of ``df`` by doc_id; every input row gave one."""
    rows = df.collect()
    assert len(rows) == docs.count()
    return {r["doc_id"]: r for r in rows}


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    whole, digest = by_text(encode_documents(docs), docs), by_text(digest_documents(docs), docs)
    for r in docs.collect():
        ids = model.encode(r["text"] or "")
        text = model.decode(ids) if ids else ""
        assert whole[r["doc_id"]]["ids"] == ids and whole[r["doc_id"]]["decoded"] == text
        d = digest[r["doc_id"]]
        assert d["n_tokens"] == len(ids)
        assert d["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert d["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert encode_documents(docs.limit(0)).count() == 0


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    got = by_text(count_tokens(docs, limit=100), docs)
    for r in docs.collect():
        n = len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        g = got[r["doc_id"]]
        assert (g["n_tokens"], g["n_bytes"], g["over_limit"]) == (n, len((r["text"] or "").encode()), n > 100), r["text"]


def test_media_digests_and_features(spark, docs):
    got = by_text(M.media_digests(docs), docs)
    stored = by_text(M.media_columns(docs), docs)
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        g, media = got[r["doc_id"]], bytes(stored[r["doc_id"]]["media"])
        assert (g["n_bytes"], g["payload_bytes"]) == (len(raw), len(payload))
        assert g["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert g["tail_crc32"] == zlib.crc32(payload[-32:])
        assert (g["media_bytes"], g["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert g["feature"] == stored[r["doc_id"]]["feature"] and len(g["feature"]) == 16


def test_images_round_trip_and_resize_by_area():
    rng = np.random.default_rng(1)
    for shape in ((5, 7), (24, 24), (3, 4, 3)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        assert (M.decode_image(M.encode_bmp(image)) == image).all()
        if image.ndim == 2:
            assert (M.decode_image(M.encode_pgm(image)) == image).all()
    assert (M.decode_image(b"P1 # note\n3 2\n1 0 1\n0 1 0\n") == np.array([[0, 255, 0], [255, 0, 255]])).all()
    image = rng.integers(0, 256, (6, 10))
    by_hand = np.repeat(np.repeat(image, 4, axis=0), 3, axis=1).reshape(4, 6, 3, 10).mean(axis=(1, 3))
    assert np.allclose(M.resize_area(image, 4, 3), by_hand)
    with pytest.raises(ValueError):
        M.decode_image(b"GIF89a")


# Either case of the 26 letters: a long s is no s.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    """The base kinds as the contract states them."""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets_equal_brute_force(spark):
    rng = random.Random(5)
    bits = ["password", "PassWD", "apikey", "API_KEY", "Token", ":", "=", " ", '"', "'", "AKIA", "ABCDEF1234567890", "0123456789abcdef", "é🎈", "x.y=z-/+", "\n", "ſecret", "toKen"]
    texts = [None, "", "password", "a" * 70_000 + " token = abcdefghijkl"] + ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    rows = {r["doc_id"]: r["spans"] for r in S.secret_spans(docs).collect()}
    clean = S.redact(docs)
    assert clean.columns == docs.columns
    redacted = {r["doc_id"]: r["text"] for r in clean.collect()}
    for i, text in enumerate(texts):
        want = [(a, k, b) for a, _, k, b in base_spans(text or "")]
        got = [(s["start"], s["kind"], s["end"]) for s in rows[i] if s["kind"] in ("assign", "access", "hex")]
        assert got == want, text
        assert (redacted[i] == text) == (not rows[i])
        for s in rows[i]:
            assert f"[{s['kind']}]" in redacted[i] or len(rows[i]) > 1
    assert S.secret_spans(docs.where(F.lit(False))).count() == 0
