"""SentencePiece encoding and decoding through a table of distinct marked words.

In a vocabulary where no piece holds a whitespace marker after another symbol, no merge
can join what lies on both sides of the start of a marker run. A text is thus a row of
chunks, each a run of markers and the symbols up to the next run, and each distinct chunk
needs to be segmented only once; a text's ids are its chunks' ids joined by position.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, read_table, tokenizer_path

MARK = "▁"
#: Entries of the table of distinct chunks that a worker keeps; beyond, it starts anew.
TABLE_ENTRIES = 400_000
_RUNS = re.compile(" +[^ ]*")
_LONG = 4_000


class PieceCodec:
    """Encodes and decodes whole texts; needs a model whose pieces hold no inner markers."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("this model has pieces that cross a whitespace marker")
        if self.model.encode("a  b") == self.model.encode("a b") or self.model.decode(self.model.encode(" a")) != " a":
            raise ValueError("this model squeezes or drops white space, which chunks would not show")
        self.mark_id = pieces.index(MARK)
        self.table: dict[str, tuple[tuple[int, ...], str]] = {}

    def chunks(self, text: str) -> list[str]:
        """The text's chunks, each without its first marker."""
        text = text.replace(MARK, " ")
        if not text:
            return []
        if "  " in text or text[0] == " ":
            return [c[1:] for c in _RUNS.findall(" " + text)]
        return text.split(" ")

    def _entry(self, chunk: str) -> tuple[tuple[int, ...], str]:
        ids = tuple(self.model.encode(chunk, num_threads=1)) if chunk else (self.mark_id,)
        # Decoding drops the first marker's space; it is put back when chunks are joined.
        return ids, self.model.decode(list(ids))

    def look_up(self, chunk: str) -> tuple[tuple[int, ...], str]:
        found = self.table.get(chunk)
        if found is None:
            found = self._entry(chunk)
            if len(chunk) <= _LONG:
                if len(self.table) >= TABLE_ENTRIES:
                    self.table.clear()
                self.table[chunk] = found
        return found

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for chunk in self.chunks(text):
            ids.extend(self.look_up(chunk)[0])
        return ids

    def decode(self, ids: list[int]) -> str:
        """Cuts the ids where a piece starts with a marker, and decodes distinct runs once."""
        out: list[str] = []
        start, cache = 0, {}
        marks = self._marked()
        for at in range(1, len(ids) + 1):
            if at == len(ids) or (marks[ids[at]] and not marks[ids[at - 1]]):
                run = tuple(ids[start:at])
                if run:
                    text = cache.get(run)
                    if text is None:
                        text = cache[run] = self.model.decode(list(run))
                    out.append(" " * (bool(out) and marks[run[0]]) + text)
                start = at
        return "".join(out)

    def _marked(self) -> list[bool]:
        if not hasattr(self, "_marks"):
            self._marks = [self.model.id_to_piece(i).startswith(MARK) for i in range(self.model.get_piece_size())]
        return self._marks


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def encode_documents(
    docs: DataFrame, model: str = "piece_bpe_32k.model", key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """key, ids (array of int), decoded (the text that the ids decode to): a row per input row.

    A null or empty text gives no ids and an empty decoded text. Repeated rows give repeated
    rows; null keys stay; other columns are not read. Narrow: no shuffle, and a worker holds
    one slice of texts and its bounded table.
    """

    def compute(texts: list[str]) -> dict[str, list]:
        c = codec(tokenizer_path(model))
        ids = [c.encode(t) for t in texts]
        return {"ids": ids, "decoded": [c.decode(x) for x in ids]}

    out = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return map_texts(docs, [key], text_col, out, compute)


def digest_documents(
    docs: DataFrame, model: str = "piece_bpe_32k.model", key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """As encode_documents, with the ids and the decoded text as counts and digests.

    The table's entries are joined by position twice: their ids, written in decimal, and what
    the library decodes them to.
    """

    def compute(texts: list[str]) -> dict[str, list]:
        c = codec(tokenizer_path(model))
        rows: list[tuple[int, str, str]] = []
        shown: dict[str, tuple[int, str, str]] = {}
        for text in texts:
            n, ids, out = 0, [], []
            for chunk in c.chunks(text):
                x = shown.get(chunk)
                if x is None:
                    found, decoded = c.look_up(chunk)
                    x = shown[chunk] = (len(found), ",".join(map(str, found)), decoded)
                n += x[0]
                ids.append(x[1])
                out.append(x[2])
            sha = hashlib.sha256
            rows.append((n, sha(",".join(ids).encode()).hexdigest(), sha(" ".join(out).encode()).hexdigest()))
        return dict(zip(("n_tokens", "ids_sha256", "decoded_sha256"), zip(*rows, strict=True), strict=True))

    out = T.StructType(
        [
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return map_texts(docs, [key], text_col, out, compute)


def op1_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(read_table(spark, sf_dir, "documents"))
