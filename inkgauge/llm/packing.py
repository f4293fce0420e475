"""Packing tokenised documents into as few sequences as possible.

Lengths are whole numbers up to the capacity, so a corpus of any size is described, for
packing, by one count per length. The plan is made on that histogram: a *pattern* is a bag
of lengths that fill one sequence, with the number of sequences that look so. Best fit
decreasing gives the first patterns; a local search then exchanges one document for one,
two for one, or moves one, between underfull sequences, always increasing the sum of
squared fills, until sequences empty. Moves act on as many like sequences as there are.
The plan is as large as the number of patterns, which depends on the capacity alone;
documents find their places by length and rank within the length.
"""

from __future__ import annotations

import base64
import math
import os
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import SLICE_CHARS, SharedFolder, read_table, tokenizer_path

#: Entries of the table of distinct words that a worker keeps; beyond, it starts anew.
TABLE_ENTRIES = 250_000
#: So many of the emptiest patterns are tried as partners before the index of all.
NEAREST = 48
#: Longer words are encoded, but not kept.
LONG_WORD = 1000


class WordEncoder:
    """Ids of whole texts, from a table of what the library gives for words with their space.

    The byte-level pre-tokenizer never joins what stands before a single space or line feed with
    what follows it, and a line feed between words stands alone, so the pieces cut there are
    encoded once each, many at a time, parted by line feeds. Where the same vocabulary lies
    beside the file as ranks, those are encoded by the ranks. Texts with longer runs of white
    space, other kinds of it or special tokens go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        ids = lambda text: self.library.encode(text, add_special_tokens=False).ids
        self.many = ids
        ranks = path.removesuffix(".json") + ".tiktoken"
        if ranks != path and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                held = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.many = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens={}).encode_ordinary
        (self.feed,) = ids("\n")
        self.spaces = {x: np.array(ids(x), dtype="<u4").tobytes() for x in ("", " ", "\n")}
        self.table: dict[str, bytes] = dict(self.spaces)

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words, which hold no white space but one space before them."""
        ids = np.array(self.many("\n".join(words)), dtype="<u4")
        cuts = (4 * np.flatnonzero(ids == self.feed)).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(data)], strict=True)] if words else []

    def _cut(self, text: str) -> list[str] | None:
        """The words with the space before them, and line feeds, or None where they can't be told apart."""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or "\0" in text or any(s in text for s in self.special):
            return None
        if len("".join(text.split())) + text.count(" ") + text.count("\n") != len(text):
            return None  # other white space
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = [b""] * len(texts)
        cut = []
        for i, text in enumerate(texts):
            words = self._cut(text)
            if words is None:
                out[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                cut.append((i, words))
        table = self.table
        for at in range(0, len(cut), 64):
            part = cut[at : at + 64]
            missing = list(set().union(*(words for _, words in part)).difference(table))
            if len(table) + len(missing) > TABLE_ENTRIES:
                table.clear()
                table.update(self.spaces)
                missing = list(set().union(*(words for _, words in part)).difference(table))
            table.update(zip(missing, self._words(missing), strict=True))
            for i, words in part:
                out[i] = b"".join(map(table.__getitem__, words))
            for word in [w for w in missing if len(w) >= LONG_WORD]:
                del table[word]
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _encoded(enc: WordEncoder, texts: pa.Array) -> Iterator[tuple[int, bytes]]:
    """The numbers of the texts and their ids, some texts at a time."""
    held: list[str] = []
    chars = at = 0
    for i, text in enumerate(texts):
        held.append(text.as_py() or "")
        chars += len(held[-1])
        if chars > SLICE_CHARS // 8 or i + 1 == len(texts):
            yield from enumerate(enc.encode(held), at)
            held, chars, at = [], 0, i + 1


def tokenised_pieces(
    docs: DataFrame,
    capacity: int = 1024,
    tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 2,
    key: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Every document's ids and an end id, cut into pieces: key, piece, start, length, ids_crc32.

    Only documents over the capacity are cut; of their pieces, the first may be shorter. With
    ``with_ids`` the ids come too, as an array. A null text is an empty one: the end id alone.
    """
    fields = [
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([docs.schema[key], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path(tokenizer))
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            columns: list[list] = [[] for _ in arrow]
            held = 0
            for i, data in _encoded(enc, texts):
                data += end
                n = len(data) // 4
                start, piece, doc = 0, 0, keys[i].as_py()
                stop = (n % capacity or capacity) if n > capacity else n
                while start < n:
                    part = data[4 * start : 4 * stop]
                    row = [doc, piece, start, stop - start, zlib.crc32(part)]
                    if with_ids:
                        row.append(np.frombuffer(part, "<u4").astype(np.int32))
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                    start, piece, stop = stop, piece + 1, stop + capacity
                held += n
                if held > SLICE_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
                    columns, held = [[] for _ in arrow], 0
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select(docs[key], docs[text_col]).mapInArrow(run, schema)


class PackingPlan:
    """Patterns with multiplicities for a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        if any(not 0 < n <= capacity for n in histogram):
            raise ValueError("lengths lie from 1 to the capacity")
        self.capacity = capacity
        self.bound = -(-sum(n * c for n, c in histogram.items()) // capacity)
        self.bins: Counter[tuple[int, ...]] = Counter()
        self._best_fit(histogram)
        self.first = sum(self.bins.values())
        self._search()

    def __len__(self) -> int:
        return sum(self.bins.values())

    def _best_fit(self, histogram: dict[int, int]) -> None:
        """Best fit decreasing, as many like sequences at a time as there are."""
        room: dict[int, Counter[tuple[int, ...]]] = {}
        free: list[int] = []

        def put(pattern: tuple[int, ...], n: int) -> None:
            left = self.capacity - sum(pattern)
            if left not in room:
                room[left] = Counter()
                free.insert(bisect_left(free, left), left)
            room[left][pattern] += n

        for size in sorted(histogram, reverse=True):
            count = histogram[size]
            while count:
                at = bisect_left(free, size)
                if at == len(free):
                    per = self.capacity // size
                    if count >= per:
                        put((size,) * per, count // per)
                    if count % per:
                        put((size,) * (count % per), 1)
                    break
                left = free[at]
                pattern = next(iter(room[left]))
                n = min(count, room[left][pattern])
                room[left][pattern] -= n
                if not room[left][pattern]:
                    del room[left][pattern]
                    if not room[left]:
                        del room[left], free[at]
                put((*pattern, size), n)
                count -= n
        for patterns in room.values():
            for pattern, n in patterns.items():
                self.bins[tuple(sorted(pattern, reverse=True))] += n

    def _take(self, pattern: tuple[int, ...], n: int) -> None:
        self.bins[pattern] -= n
        if not self.bins[pattern]:
            del self.bins[pattern]

    def _replace(self, a: tuple[int, ...], b: tuple[int, ...], out: tuple[int, ...], into: tuple[int, ...]) -> None:
        """Gives b's ``into`` to a for a's ``out``, in as many pairs of such sequences as there are."""
        n = self.bins[a] // 2 if a == b else min(self.bins[a], self.bins[b])
        self._take(a, n)
        self._take(b, n)
        for pattern, less, more in ((a, out, into), (b, into, out)):
            left = list(pattern)
            for x in less:
                left.remove(x)
            if made := tuple(sorted((*left, *more), reverse=True)):
                self.bins[made] += n

    def _search(self) -> None:
        """Exchanges between underfull sequences while the number is above the bound.

        A fuller sequence a takes from an emptier one b whatever leaves a with the least room:
        a document for nothing, one for one, or one for two of its own (or two for one). Each
        exchange takes tokens from the emptier to the fuller, so squared fill increases and
        the search ends: at the bound, or where no exchange of any two sequences gains. The
        ``NEAREST`` emptiest are tried first, then all others through an index of what they hold.
        """
        changed = True
        while changed and len(self) > self.bound:
            under = sorted((p for p in self.bins if sum(p) < self.capacity), key=lambda p: (-sum(p), p))
            changed = False
            emptiest = under[::-1]
            index = None
            for a in under:
                room = self.capacity - sum(a)
                for b in emptiest[:NEAREST]:
                    if not self._partners(a, b):
                        continue
                    best = self._exchange(a, b, room)
                    if best:
                        break
                else:
                    if len(emptiest) <= NEAREST or not self.bins[a]:
                        continue
                    index = index or self._holders(emptiest)
                    b = self._partner(a, room, *index)
                    if b is None:
                        continue
                    best = self._exchange(a, b, room)
                self._replace(a, b, *best)
                changed = True

    def _partners(self, a: tuple[int, ...], b: tuple[int, ...]) -> bool:
        """Whether there are such sequences still, and a is no emptier than b."""
        return self.bins[a] >= 1 + (a == b) and self.bins[b] > 0 and sum(b) <= sum(a)

    @staticmethod
    def _holders(emptiest: list[tuple[int, ...]]) -> tuple[tuple[list[int], dict[int, list]], tuple[list[int], dict[int, list]]]:
        """The patterns that hold a length, and those that hold a length or a sum of two, emptiest first."""
        ones, both = {}, {}
        for p in emptiest:
            single = set(p)
            for x in single:
                ones.setdefault(x, []).append(p)
            for x in single | {sum(g) for g in _pairs(p)}:
                both.setdefault(x, []).append(p)
        return (sorted(ones), ones), (sorted(both), both)

    def _partner(self, a: tuple[int, ...], room: int, ones: tuple[list[int], dict[int, list]], both: tuple[list[int], dict[int, list]]) -> tuple[int, ...] | None:
        """Who gives a the largest gain that its room allows."""
        found, most = None, 0
        for out in [(), *((x,) for x in set(a)), *_pairs(a)]:
            keys, held = ones if len(out) == 2 else both
            less = sum(out)
            at = bisect_left(keys, less + room + 1) - 1
            while at >= 0 and keys[at] - less > most:
                b = next((b for b in held[keys[at]] if self._partners(a, b)), None)
                if b is not None:
                    found, most = b, keys[at] - less
                    break
                at -= 1
            if most == room:
                break
        return found

    @staticmethod
    def _exchange(a: tuple[int, ...], b: tuple[int, ...], room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
        """What a gives and what it gets: the largest gain that its room allows."""
        ones_a, ones_b = sorted(set(a)), sorted(set(b))
        gives = [(), *((x,) for x in ones_a)]
        best, most = None, 0
        gets = [(x,) for x in ones_b] + _pairs(b)
        sums = sorted((sum(g), g) for g in gets)
        keys = [s for s, _ in sums]
        for out in gives + _pairs(a):
            limit = room + sum(out)
            at = bisect_left(keys, limit + 1) - 1
            while at >= 0 and len(out) == 2 and len(sums[at][1]) == 2:
                at -= 1  # two for two is not a step of this search
            if at >= 0 and keys[at] - sum(out) > most:
                best, most = (out, sums[at][1]), keys[at] - sum(out)
                if most == room:
                    break
        return best


def _pairs(pattern: tuple[int, ...]) -> list[tuple[int, int]]:
    """The pairs of lengths in a pattern, smallest sums first."""
    held = Counter(pattern)
    sizes = sorted(held, reverse=True)
    return sorted(((x, y) for i, x in enumerate(sizes) for y in sizes[i:] if x != y or held[x] > 1), key=sum)


def placements(plan: PackingPlan) -> dict[str, np.ndarray]:
    """The plan as rows by length and rank: ranks from ``low`` on go to sequences from ``first``
    on, ``per`` in each, the first of them at ``offset``."""
    taken: Counter[int] = Counter()
    rows, number = [], 0
    for pattern, n in sorted(plan.bins.items(), reverse=True):
        offset = 0
        for size in sorted(set(pattern), reverse=True):
            per = pattern.count(size)
            rows.append((size, taken[size], number, per, offset))
            taken[size] += per * n
            offset += per * size
        number += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("size", "low", "first", "per", "offset"), table.T, strict=True))


def pack_pieces(pieces: DataFrame, capacity: int, salts: int | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces, which have a column length from 1 to the capacity.

    Reads ``pieces`` twice: give a written table. Ranks within a length are dealt over
    ``salts`` parts each, so no length, however common, lands in one task; the driver
    holds capacity x salts counts. Equal pieces are interchangeable; an empty table stays
    empty.
    """
    spark = pieces.sparkSession
    salts = salts or min(256, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    names = pieces.columns
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in names]), F.lit(salts)).cast("int")
    salted = pieces.withColumn("__part", part)
    counts = salted.groupBy("length", "__part").count().collect()  # at most capacity x salts rows
    per: dict[tuple[int, int], int] = {(r[0], r[1]): r[2] for r in counts}
    histogram: Counter[int] = Counter()
    base: dict[tuple[int, int], int] = {}
    for size, k in sorted(per):
        base[size, k] = histogram[size]
        histogram[size] += per[size, k]
    plan = PackingPlan(dict(histogram), capacity)
    table = placements(plan)
    starts = np.zeros((capacity + 1, salts), dtype=np.int64)
    for (size, k), v in base.items():
        starts[size, k] = v

    window = Window.partitionBy("length", "__part").orderBy(*[F.col(f"`{c}`") for c in names])
    ranked = salted.withColumn("__rank", F.row_number().over(window) - 1)
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    arrow = to_arrow_schema(schema)
    shared = spark.sparkContext.broadcast((starts, table))  # bounded by capacity, salts and patterns
    span = max(1, 2 * (max(histogram.values(), default=0) + 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, t = shared.value
        order = t["size"] * span + t["low"]
        for batch in batches:
            n = len(names)
            size = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(n + 1).to_numpy(zero_copy_only=False) + starts[size, batch.column(n).to_numpy(zero_copy_only=False)]
            at = np.searchsorted(order, size * span + rank, side="right") - 1
            step = rank - t["low"][at]
            sequence = t["first"][at] + step // t["per"][at]
            offset = t["offset"][at] + step % t["per"][at] * size
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(n)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], schema=arrow)

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset: a row per piece of a document.

    Documents are tokenised once, into a table in the shared folder; ids are found again by
    key, start and length. Null and empty texts are one end id. Repeated rows are packed as
    often as they occur; null keys stay. Other columns are not read.
    """
    folder = SharedFolder(docs.sparkSession, "packing")
    pieces = folder.save(tokenised_pieces(docs, capacity, key=key, text_col=text_col), "pieces")
    return pack_pieces(pieces, capacity)


def fill(n_tokens: int, sequences: int, capacity: int) -> float:
    return n_tokens / (sequences * capacity) if sequences else math.nan


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
