"""N-gram Jaccard join by PartEnum signatures.

Texts become sets of 64-bit hashes of word shingles; texts with equal sets form one *class*,
and only classes are joined. Set sizes are cut into bands whose largest size is 1 / similarity
times the smallest, so linked sets lie in one band or in neighbouring ones; a set signs for its
own band and for the next. In a band linked sets differ in at most ``k`` elements. The domain is
dealt into ``n1`` partitions, each into ``n2`` parts: with n1 > k // (k2 + 1) some partition holds
at most k2 differences, so some choice of n2 - k2 of its parts holds none, and each such choice
is a signature. There are some partitions to spare: a set may leave out that many, those where
a choice of parts is empty, as the guarantee then holds in the others.

Classes that share a signature are candidates. Groups of up to ``ALL_PAIRS`` classes give all
pairs; larger ones first give pairs with one leader. After components are made of the verified
links, a large group matters only where it spans several components. Linked sets share one
partition more than a set may still leave out, so a set leaves out its largest such groups as far
as it may, and what the others share is compared between components, in blocks of a
group. Sketches (the parity of the number of elements in each cell) exclude most candidates:
cells whose parity differs are no more than the differences of two sets. The candidates that are
left are verified with their whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .common import SharedFolder, map_texts, read_table

#: Words of a shingle, and the least similarity in hundredths.
SHINGLE, PERCENT = 5, 80
#: Groups of so many classes give all pairs at once; larger ones pairs with a leader first.
ALL_PAIRS = 8
#: Distinct pairs that a task remembers so as not to repeat them; beyond, it starts anew.
REMEMBERED = 500_000
#: Classes that a task remembers so as not to sign for copies again; beyond, it starts anew.
SIGNED = 300_000
#: Members of a large group that one task compares at once with as many others.
GROUP_ROWS = 1024
#: A class that keeps so many signatures at most tells them all, so a pair comes from one group alone.
TOLD_SIGS = 64
#: Words of sketches that a task compares at once, about.
FOLDED_WORDS = 1 << 18
#: Bytes of a text whose words are hashed at once; one word at least.
HASHED = 1 << 16
#: A table of so many rows at most (of two numbers each) is broadcast.
BROADCAST_ROWS = 1_000_000

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = np.arange(256, dtype=np.uint64)
_BYTES[ord("A") : ord("Z") + 1] += np.uint64(32)
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: A random number for each byte, letters in either case alike, nothing for white space.
_VALUES = np.where(_IS_SPACE, np.uint64(0), _mix(_BYTES, 21))
_BASE = 0x2545F4914F6CDD1D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])
    return _POWERS


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, of the sum of its bytes' numbers times powers of their places; and where it starts."""
    found, begun, at = [], [], 0
    raw = np.frombuffer(data, np.uint8)
    while at < len(raw):
        end = at + HASHED
        if end < len(raw):  # to the end of a word
            while end < len(raw) and not _IS_SPACE[raw[end : end + HASHED]].any():
                end += HASHED
            end += int(_IS_SPACE[raw[end : end + HASHED]].argmax()) if end < len(raw) else 0
        part = raw[at:end]
        edge = np.diff(np.concatenate(([1], _IS_SPACE[part].view(np.int8), [1])))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _powers(len(part))
        total = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[part] * up[: len(part)])])
        found.append((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        begun.append(starts + at)
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _mix(np.concatenate(found)), np.concatenate(begun)


def _windows(h: np.ndarray, span: int) -> np.ndarray:
    """A hash of every run of ``span`` words."""
    total = np.full(max(0, len(h) - span + 1), span, np.uint64)
    for j in range(span):
        total += h[j : j + len(total)] * (_ODD[j % 5] + np.uint64(2 * (j // 5)))
    return _mix(total, 31)


def shingle_sets(texts: list[str], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words; shorter texts are one shingle.

    Texts are hashed together, as far as they have ``HASHED`` bytes.
    """
    at = 0
    while at < len(texts):
        parts, held = [], 0
        while at < len(texts) and (not parts or held < HASHED):
            parts.append(texts[at].encode("utf-8", "replace"))
            held += len(parts[-1])
            at += 1
        h, begun = word_hashes(b"\n".join(parts))
        ends = np.cumsum([len(x) + 1 for x in parts])
        cuts = np.searchsorted(begun, ends)
        whole = _windows(h, size)
        for low, high in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            n = high - low
            found = np.sort(whole[low : high - size + 1]) if n >= size else _windows(h[low:high], n) if n else h[:0]
            yield found[np.r_[True, found[1:] != found[:-1]]] if n > size else found


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    return next(shingle_sets([text], size))


class Bands:
    """Size bands and the PartEnum parameters of each."""

    def __init__(self, percent: int = PERCENT):
        self.percent = percent
        self.low, self.high = [1], [100 // percent]

    def of(self, n: int) -> int:
        while self.high[-1] < n:
            self.low.append(self.high[-1] + 1)
            self.high.append(self.low[-1] * 100 // self.percent)
        return int(np.searchsorted(self.high, n))

    def parameters(self, band: int) -> tuple[int, int, int, int]:
        """k (differences at most), n1, n2, k2."""
        while len(self.high) <= band:
            self.of(self.high[-1] + 1)
        k = 2 * self.high[band] * (100 - self.percent) // (100 + self.percent)
        if k <= 5:
            return k, 1, k + 2, k
        n1 = k // 3 + 1
        return k, n1 + n1 // 6, 3, 2


def signatures(found: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """sig (its low 16 bits are the partition) and meta: twice the number of partitions that may
    still be left out (-1 for none), plus 1 for the next band."""
    sigs, metas = [], []
    own = bands.of(len(found))
    deal, part = (found >> np.uint64(40)).astype(np.int64), (found >> np.uint64(8) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    for step in (0, 1):
        k, n1, n2, k2 = bands.parameters(own + step)
        if not k:
            continue  # only equal sets are linked
        cell = deal % n1 * n2 + part % n2
        total = np.zeros(n1 * n2, np.uint64)
        np.add.at(total, cell, found)
        total = total.reshape(n1, n2)
        held = np.bincount(cell, minlength=n1 * n2).reshape(n1, n2) > 0
        spare = n1 - 1 - k // (k2 + 1) - int((held.sum(axis=1) <= k2).sum())
        chosen = np.array(list(combinations(range(n2), n2 - k2)), np.int64)
        at = np.arange(n1, dtype=np.uint64)[:, None]
        sum_ = at * _ODD[0] + (np.uint64((own + step) << 20) + np.arange(len(chosen), dtype=np.uint64))
        for j in chosen.T:
            sum_ = _mix(sum_ + total[:, j] * _ODD[1])
        sum_ = sum_ & np.uint64(0xFFFFFFFFFFFF0000) | at & np.uint64(0xFFFF)
        sigs.append(sum_[held[:, chosen].any(axis=2)] if spare >= 0 else sum_.ravel())
        # Where the low bits cannot tell all partitions, nothing more may be left out.
        metas.append(np.full(len(sigs[-1]), 2 * (max(-1, min(spare, 15_000)) if n1 <= 0xFFFF else -1) + step, np.int16))
    if not sigs:
        return np.zeros(0, np.int64), np.zeros(0, np.int16)
    return np.concatenate(sigs).view(np.int64), np.concatenate(metas)


def sketch_bits(high: int) -> int:
    """Cells of a sketch for sets of up to that size, a power of two near it."""
    return 1 << max(8, int(np.rint(np.log2(max(1, high)))))


def sketch(found: np.ndarray, bits: int) -> bytes:
    """A bit for each cell: whether an odd number of elements fall into it."""
    cells = (found >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketches: pa.Array, words: int, at: np.ndarray | None = None) -> np.ndarray:
    """Some of the sketches as rows of so many 64-bit words; longer ones are folded, as their cells are."""
    ends = np.frombuffer(sketches.buffers()[1], np.int32)[sketches.offset : sketches.offset + len(sketches) + 1].astype(np.int64) // 8
    flat = np.frombuffer(sketches.buffers()[2], np.uint64, int(ends[-1]))
    at = np.arange(len(sketches)) if at is None else at
    begins, sizes = ends[at], ends[at + 1] - ends[at]
    out = np.empty((len(at), words), np.uint64)
    for size in np.unique(sizes).tolist():
        those = np.flatnonzero(sizes == size)
        rows = flat[begins[those][:, None] + np.arange(size)]
        out[those] = np.bitwise_xor.reduce(rows.reshape(len(those), -1, words), axis=1)
    return out


def _sketch_words(sketches: pa.Array) -> np.ndarray:
    """How many 64-bit words each sketch has."""
    return pc.binary_length(sketches).to_numpy().astype(np.int64) // 8


def _identity(found: np.ndarray) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(found.tobytes(), seed=len(found))
    return h - (1 << 64) if h >> 63 else h


def _memberships(docs: DataFrame, key: str, text_col: str, size: int, bands: Bands) -> DataFrame:
    """key, t (hash of the text), n (set size), c (class: a hash of the set, null where it is empty), v (its sketch)."""

    def compute(texts: list[str]) -> dict[str, list]:
        sets = list(shingle_sets(texts, size))
        bits = [sketch_bits(bands.high[bands.of(len(s))]) if len(s) else 0 for s in sets]
        return {
            "n": [len(s) for s in sets],
            "c": [_identity(s) if len(s) else None for s in sets],
            "v": [sketch(s, b) if len(s) else None for s, b in zip(sets, bits, strict=True)],
        }

    out = T.StructType([T.StructField("n", T.LongType()), T.StructField("c", T.LongType()), T.StructField("v", T.BinaryType())])
    return map_texts(docs.withColumn("t", F.xxhash64(text_col)), [key, "t"], text_col, out, compute)


def _signed(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """sig, c, meta of the texts; a task signs once for the copies that it meets."""
    schema = T.StructType([T.StructField(n, t) for n, t in (("sig", T.LongType()), ("c", T.LongType()), ("meta", T.ShortType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=arrow)

        for batch in batches:
            for found in shingle_sets([t or "" for t in batch.column(0).to_pylist()], size):
                if not len(found) or (c := _identity(found)) in told:
                    continue
                if len(told) >= SIGNED:
                    told.clear()
                told.add(c)
                sig, meta = signatures(found, bands)
                held.append((sig, np.full(len(sig), c), meta))
                rows += len(sig)
                if rows > 100_000:
                    yield flush()
                    rows = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(run, schema)


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """c, found: the set of each class in ``wanted`` (c, id and t of a member)."""
    schema = T.StructType([T.StructField("c", T.LongType()), T.StructField("found", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    right = wanted.select(F.col("id").alias("wid"), F.col("t").alias("wt"), F.col("c").alias("wc"))
    right = F.broadcast(right) if wanted.count() <= BROADCAST_ROWS else right
    # The hash of the text comes with the key, so rows without a key do not meet each other's classes.
    same = (F.xxhash64("text") == F.col("wt")) & F.col("id").eqNullSafe(F.col("wid"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[int] = set()
        for batch in batches:
            rows: tuple[list, list] = ([], [])
            sets = shingle_sets([t or "" for t in batch.column(1).to_pylist()], size)
            for c, found in zip(batch.column(0).to_pylist(), sets, strict=True):
                if c not in told and len(found) and _identity(found) == c:
                    if len(told) >= SIGNED:
                        told.clear()
                    told.add(c)
                    rows[0].append(c)
                    rows[1].append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary())], schema=arrow)

    return docs.join(right, same).select("wc", "text").mapInArrow(run, schema)


def _grouped(sigs: DataFrame) -> DataFrame:
    """a, b: candidate pairs; for members of large groups also rows with sig and meta (b is null)."""
    schema = T.StructType(
        [T.StructField(n, t) for n, t in (("a", T.LongType()), ("b", T.LongType()), ("sig", T.LongType()), ("meta", T.ShortType()))]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[tuple[int, int]] = set()
        out: list[list] = [[], [], [], []]
        group: list[tuple] = []  # of one signature, its first ALL_PAIRS + 1 at most
        leader = sig = None
        big = False

        def add(a, b, s=None, m=None):
            if b is not None:
                if a == b or (a, b) in told:
                    return
                if len(told) >= REMEMBERED:
                    told.clear()
                told.add((a, b))
            for column, v in zip(out, (a, b, s, m), strict=True):
                column.append(v)

        def large(row):
            add(leader, row[0])
            add(row[0], None, sig, row[1])

        def close():
            if not big:
                for i, x in enumerate(group):
                    for y in group[i + 1 :]:
                        if not x[1] & y[1] & 1:  # two sets that sign for their next band meet in their own
                            add(x[0], y[0])

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow, strict=True)], schema=arrow)
            for c in out:
                c.clear()
            return made

        for batch in batches:
            s, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # Signatures that occur once, away from the batch's ends, are skipped at once.
            same = s[1:] == s[:-1]
            keep = np.ones(len(s), bool)
            if len(s) > 2:
                keep[1:-1] = same[1:] | same[:-1]
            meta = batch.column(2).to_numpy()
            for i in np.flatnonzero(keep).tolist():
                if s[i] != sig:
                    close()
                    sig, group, big, leader = int(s[i]), [], False, int(c[i])
                row = (int(c[i]), int(meta[i]))
                if big:
                    large(row)  # tasks that signed for copies of one text repeat it
                elif row not in group:
                    group.append(row)
                    if len(group) > ALL_PAIRS:
                        big = True
                        for x in group:
                            large(x)
                if len(out[0]) >= 50_000:
                    yield flush()
        close()
        yield flush()

    return sigs.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, schema)


def _bound(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Elements in which linked sets of these sizes differ at most."""
    return (n + m) * (100 - percent) // (100 + percent)


def _sized(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """a, b, m, n: the pairs whose sizes do not exclude a link; sizes come first, so that fewer sketches travel."""
    one, two = (classes.select(F.col("c").alias(c), F.col("n").alias(n)) for c, n in (("a", "m"), ("b", "n")))
    near = pairs.join(two, "b").join(one, "a").where(F.least("m", "n") * 100 >= F.greatest("m", "n") * percent)
    return near.select("a", "b", "m", "n")


def _possible(near: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b, with sizes m, n) that sketches do not exclude."""
    one, two = (classes.select(F.col("c").alias(c), F.col("v").alias(v)) for c, v in (("a", "x"), ("b", "y")))
    near = near.join(two, "b").join(one, "a")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            words = np.minimum(_sketch_words(x), _sketch_words(y))
            most = _bound(batch.column(4).to_numpy(), batch.column(5).to_numpy(), percent)
            keep = np.zeros(len(words), bool)
            for size in np.unique(words).tolist():
                at = np.flatnonzero(words == size)
                for cut in range(0, len(at), FOLDED_WORDS // size + 1):
                    few = at[cut : cut + FOLDED_WORDS // size + 1]
                    apart = folded(x, size, few) ^ folded(y, size, few)
                    keep[few] = np.bitwise_count(apart).sum(axis=1, dtype=np.int64) <= most[few]
            yield batch.select([0, 1]).filter(pa.array(keep))

    return near.select("a", "b", "x", "y", "m", "n").mapInArrow(run, schema)


def _across(rows: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs between the components of a large group that sizes and sketches do not exclude.

    rows: sig, c, root, n, v, and the class's other sigs, if they are not too many; sizes: sig and
    how many rows it has. A group is dealt into blocks of about ``GROUP_ROWS``, and every two blocks
    meet in a task of their own. Where both tell their sigs, the first that they share gives the pair.
    """
    blocks = F.ceil(F.col("members") / GROUP_ROWS).cast("int")
    placed = rows.join(sizes, "sig").withColumn("p", F.pmod(F.xxhash64("c"), blocks).cast("int"))
    met = placed.withColumn("q", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("sig", F.least("p", "q").alias("low"), F.greatest("p", "q").alias("high"), (F.col("p") > F.col("q")).alias("second"), "c", "root", "n", "v", "sigs")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    arrow = to_arrow_schema(schema)

    def pairs(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(group)
        second, c, root, n = (t.column(i).to_numpy() for i in (3, 4, 5, 6))
        whole, lists = t.column(7).combine_chunks(), t.column(8).combine_chunks()
        own = _sketch_words(whole)
        v = folded(whole, int(own.min()))
        sig, values, ends, tells = t.column(0)[0].as_py(), lists.values.to_numpy(), lists.offsets.to_numpy(), lists.is_valid().to_pylist()
        sigs: dict[int, set[int]] = {}

        def elsewhere(*both: int) -> bool:
            for i in both:
                if not tells[i]:
                    return False
                if i not in sigs:
                    sigs[i] = set(values[ends[i] : ends[i + 1]].tolist())
            return min(sigs[both[0]] & sigs[both[1]]) != sig

        inside = t.column(1)[0].as_py() == t.column(2)[0].as_py()
        left, right = (np.arange(len(c)),) * 2 if inside else (np.flatnonzero(~second), np.flatnonzero(second))
        found = []
        step = max(1, (1 << 20) // max(1, len(right) * v.shape[1]))
        for at in range(0, len(left), step):
            i = left[at : at + step, None]
            near = (root[i] != root[right]) & (100 * np.minimum(n[i], n[right]) >= percent * np.maximum(n[i], n[right]))
            if inside:
                near &= i < right
            x, y = np.nonzero(near)
            x, y = i[x, 0], right[y]
            apart = np.bitwise_count(v[x] ^ v[y]).sum(axis=1, dtype=np.int64)
            near = apart <= _bound(n[x], n[y], percent)
            x, y = x[near], y[near]
            # The block's shortest sketch told these; what the two have themselves can tell more.
            words, keep = np.minimum(own[x], own[y]), np.ones(len(x), bool)
            for size in np.unique(words[words > v.shape[1]]).tolist():
                mine = np.flatnonzero(words == size)
                for cut in range(0, len(mine), FOLDED_WORDS // size + 1):
                    few = mine[cut : cut + FOLDED_WORDS // size + 1]
                    apart = np.bitwise_count(folded(whole, size, x[few]) ^ folded(whole, size, y[few])).sum(axis=1, dtype=np.int64)
                    keep[few] = apart <= _bound(n[x[few]], n[y[few]], percent)
            once = [(i, j) for i, j in zip(x[keep].tolist(), y[keep].tolist(), strict=True) if not elsewhere(i, j)]
            x, y = c[[i for i, _ in once]], c[[j for _, j in once]]
            found.append((np.minimum(x, y), np.maximum(x, y)))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 2
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            cuts = [0, *(1 + np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0))).tolist(), batch.num_rows]
            for at, end in zip(cuts[:-1], cuts[1:], strict=True):
                if end == at:
                    continue
                this = tuple(int(k[at]) for k in keys)
                if key not in (None, this):
                    yield pairs(held)
                    held = []
                key = this
                held.append(batch.slice(at, end - at))
        if held:
            yield pairs(held)

    return met.repartition("sig", "low", "high").sortWithinPartitions("sig", "low", "high").mapInArrow(run, schema)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    one, two = sets.select(F.col("c").alias("a"), F.col("found").alias("x")), sets.select(F.col("c").alias("b"), F.col("found").alias("y"))
    near = pairs.join(two, "b").join(one, "a").select("a", "b", "x", "y")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return near.mapInArrow(run, schema)


def components(links: DataFrame, folder: SharedFolder, label: str) -> DataFrame:
    """c, root: the smallest class that links lead to, for each class with a link."""
    both = folder.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{label}-both")
    roots = folder.save(both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("root")).select("c", F.least("c", "root").alias("root")), f"{label}-0")
    turn = 0
    while True:
        turn += 1
        # The root of every neighbour, also told to the own root, then the root's root.
        told = both.join(roots.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.min("root").alias("seen"))
        each = roots.join(told, "c").select("c", "root", F.least("root", "seen").alias("seen"))
        hooked = each.select("c", "seen").unionByName(each.select(F.col("root").alias("c"), "seen")).groupBy("c").agg(F.min("seen").alias("root"))
        up = hooked.select(F.col("c").alias("root"), F.col("root").alias("top"))
        made = folder.save(hooked.join(up, "root", "left").select("c", F.least("root", F.coalesce("top", "root")).alias("root")), f"{label}-{turn}")
        changed = made.join(roots.withColumnRenamed("root", "was"), "c").where("root <> was").limit(1).count()
        folder.drop(f"{label}-{turn - 1}")
        roots = made
        if not changed:
            return roots


def jaccard_components(
    docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE, key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """key, n_shingles, component_id: a row per input row.

    Texts link when 100 * |intersection| >= percent * |union| of their sets of shingles.
    component_id is the smallest key that links lead to, the row's own included. Texts that are
    null, empty or without words have no shingles and link with nothing, so they keep their own
    key. Repeated rows stay repeated; a null key never is the smallest, but stays where there
    is no other. Further columns of ``docs`` are not read. Sets with one 64-bit hash are held equal.
    """
    spark = docs.sparkSession
    folder = SharedFolder(spark, "jaccard")
    texts = docs.select(F.col(key).alias("id"), F.col(text_col).alias("text"))
    bands = Bands(percent)
    members = folder.save(_memberships(texts, "id", "text", size, bands), "members")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t"))
    classes = members.where("c IS NOT NULL").groupBy("c").agg(first.alias("x"), F.first("n").alias("n"), F.first("v").alias("v"))
    classes = folder.save(classes.select("c", "x.id", "x.t", "n", "v"), "classes")
    grouped = folder.save(_grouped(_signed(texts, size, bands)), "grouped")
    ordered = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = ordered(grouped.where("b IS NOT NULL"))
    large = grouped.where("b IS NULL").select(F.col("a").alias("c"), "sig", "meta")

    def verified(near: DataFrame, label: str) -> DataFrame:
        near = folder.save(near, f"{label}-near")
        needed = near.select(F.col("a").alias("c")).unionByName(near.select(F.col("b").alias("c"))).distinct()
        wanted = folder.save(classes.join(needed, "c", "left_semi").select("c", "id", "t"), f"{label}-wanted")
        # Rows that share a key can give a set twice, which only repeats a link.
        made = folder.save(_verified(near, _sets_of(texts, wanted, size), percent), label)
        folder.drop(f"{label}-near")
        folder.drop(f"{label}-wanted")
        return made

    sized = folder.save(_sized(pairs, classes, percent), "sized")
    links = verified(_possible(sized, classes, percent), "links")
    folder.drop("sized")
    roots = components(links, folder, "first")

    # Large groups that span components, of sets that cannot leave them all out.
    rooted = large.join(roots, "c", "left").select("c", "sig", "meta", F.coalesce("root", "c").alias("root"))
    mixed = rooted.groupBy("sig").agg(F.min("root").alias("p"), F.max("root").alias("q"), F.count("*").alias("of")).where("p <> q").select("sig", "of")
    hot = folder.save(rooted.join(mixed, "sig").distinct(), "hot")
    folder.drop("grouped")
    # A set may leave out so many partitions, and instead of more its largest groups.
    spare = F.greatest(F.lit(0), F.floor(F.col("meta") / 2))
    parts = F.count_distinct(F.col("sig").bitwiseAND(0xFFFF))
    bound = hot.groupBy("c", "meta").agg(parts.alias("parts")).where(F.floor(F.col("meta") / 2) < F.col("parts")).select("c", "meta")
    rest = hot.join(bound, ["c", "meta"])
    place = F.row_number().over(Window.partitionBy("c", "meta").orderBy(F.desc("of"), F.desc("sig")))
    rest = folder.save(rest.withColumn("place", place).where(F.col("place") > spare).select("c", "sig", "root"), "rest")
    folder.drop("hot")
    sizes = rest.groupBy("sig").agg(F.count("*").alias("members"), F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("sig", "members")
    own = rest.groupBy("c").agg(F.when(F.count("*") <= TOLD_SIGS, F.collect_list("sig")).alias("sigs"))
    told = rest.join(classes.select("c", "n", "v").join(own, "c"), "c").select("sig", "c", "root", "n", "v", "sigs")
    more = verified(ordered(_across(told, sizes, percent)), "more")
    folder.drop("rest")
    if more.limit(1).count():
        roots = components(links.unionByName(more), folder, "second")

    top = classes.join(roots, "c", "left").select("c", "id", F.coalesce("root", "c").alias("root"))
    least = top.groupBy("root").agg(F.min("id").alias("component"))
    named = folder.save(top.join(least, "root").select(F.col("c").alias("named"), "component"), "named")
    small = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    return members.join(small, F.col("c") == F.col("named"), "left").select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of ``docs``, one row of each component of near copies.

    Rows are told apart by key and text. The row with the smallest key stays, of equal keys that
    with the smallest hash of the text; rows with a null key come last. Of repeated rows with the
    same key and text one stays, whatever its other columns hold. Rows whose texts have no words
    are near copies of nothing, so all of them stay, repeated ones too.
    """
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.xxhash64(F.col(text_col)).alias("hash"))
    found = jaccard_components(docs.select(row.alias("row"), F.col(text_col).alias("text")), percent, key="row", text_col="text")
    # Keys and texts of which no row stays, or one of several.
    counted = found.where("n_shingles > 0").groupBy("row").agg(F.count("*").alias("n"), F.first("component_id").alias("top"))
    wrong = counted.where((F.col("row") != F.col("top")) | (F.col("n") > 1)).select("row", (F.col("row") == F.col("top")).alias("stays"))
    folder = SharedFolder(docs.sparkSession, "keep-one")
    wrong = folder.save(wrong.select(F.col("row.key").alias("k"), F.col("row.hash").alias("t"), "stays"), "wrong")
    names = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*names).alias("row"), F.col(key).alias("rk"), F.xxhash64(F.col(text_col)).alias("rt"))
    same = F.col("rk").eqNullSafe(F.col("k")) & (F.col("rt") == F.col("t"))
    kept = whole.join(wrong, same, "left_anti").select("row")
    again = whole.join(wrong.where("stays"), same).groupBy("rk", "rt").agg(F.first("row").alias("row")).select("row")
    return kept.unionByName(again).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
