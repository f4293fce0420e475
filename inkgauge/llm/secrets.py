"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what any
match must contain. A segment of documents is indexed by the trigrams that some rule asks
for; posting lists are intersected and united as the query says, and only the documents
that remain are matched against the expression. Rules from which no trigram follows scan
all documents. Trigrams are of UTF-8 bytes with A-Z folded, so the index serves rules in
either case; folding only adds candidates, which verification removes.

Segments are slices of a partition: an index is built, asked and dropped within a task, so
memory is bounded by the slice and a lost executor costs its tasks alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property
from re import _constants as C
from re import _parser as parser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, read_table

# ---- Boolean trigram queries -------------------------------------------------------------

#: A query is True (every document), False (none), a trigram, or ("and" | "or", frozenset of queries).
Query = object
#: Sets of strings beyond these sizes are given up for what is already known of them.
EXACT_STRINGS, CLASS_CHARS = 64, 12


def _join(kind: str, parts: Sequence[Query]) -> Query:
    unit, zero = (True, False) if kind == "and" else (False, True)
    flat: set = set()
    for p in parts:
        if p is zero:
            return zero
        if p is not unit:
            flat |= p[1] if isinstance(p, tuple) and p[0] == kind else {p}
    if not flat:
        return unit
    return next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _has(text: bytes) -> Query:
    return _join("and", [text[i : i + 3] for i in range(len(text) - 2)])


def _any(texts: frozenset[bytes]) -> Query:
    return _join("or", [_has(t) for t in texts])


@dataclass(frozen=True)
class _Known:
    """What is known of the strings that a part of an expression matches: all of them, if they
    are few (exact); else sets of beginnings and ends, and a query that holds for all."""

    exact: frozenset[bytes] | None
    prefix: frozenset[bytes]
    suffix: frozenset[bytes]
    query: Query


_EMPTY = frozenset([b""])
_ANYTHING = _Known(None, _EMPTY, _EMPTY, True)


def _exactly(texts: frozenset[bytes]) -> _Known:
    return _Known(texts, texts, texts, True)


def _loose(k: _Known) -> _Known:
    if k.exact is None:
        return k
    cut = lambda end: frozenset(t[:2] if end == 0 else t[-2:] for t in k.exact)
    return _Known(None, cut(0), cut(1), _any(k.exact))


def _concat(a: _Known, b: _Known) -> _Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= EXACT_STRINGS:
        return _exactly(frozenset(x + y for x in a.exact for y in b.exact))
    ends = a.exact if a.exact is not None else a.suffix
    starts = b.exact if b.exact is not None else b.prefix
    across: Query = True
    if len(ends) * len(starts) <= EXACT_STRINGS * 4:
        across = _join("or", [_has(x[-2:] + y[:2]) for x in ends for y in starts])
    la, lb = _loose(a), _loose(b)
    prefix, suffix = la.prefix, lb.suffix
    if a.exact is not None and len(a.exact) * len(lb.prefix) <= EXACT_STRINGS:
        prefix = frozenset((x + y)[:2] for x in a.exact for y in lb.prefix)
    if b.exact is not None and len(b.exact) * len(la.suffix) <= EXACT_STRINGS:
        suffix = frozenset((x + y)[-2:] for x in la.suffix for y in b.exact)
    return _Known(None, prefix, suffix, _join("and", [la.query, across, lb.query]))


def _either(parts: list[_Known]) -> _Known:
    if all(p.exact is not None for p in parts):
        texts = frozenset().union(*(p.exact for p in parts))
        if len(texts) <= EXACT_STRINGS:
            return _exactly(texts)
    parts = [_loose(p) for p in parts]
    prefix = frozenset().union(*(p.prefix for p in parts))
    suffix = frozenset().union(*(p.suffix for p in parts))
    few = lambda s: s if len(s) <= EXACT_STRINGS else _EMPTY
    return _Known(None, few(prefix), few(suffix), _join("or", [p.query for p in parts]))


def _fold(code: int) -> bytes:
    return chr(code).encode().lower() if code < 128 else chr(code).encode()


def _char_class(items: list) -> _Known:
    found: set[bytes] = set()
    for op, arg in items:
        if op is C.LITERAL:
            found.add(_fold(arg))
        elif op is C.RANGE and arg[1] - arg[0] < 128:
            found |= {_fold(x) for x in range(arg[0], arg[1] + 1)}
        else:
            return _ANYTHING
        if len(found) > CLASS_CHARS:
            return _ANYTHING
    return _exactly(frozenset(found))


def _walk(tree: Sequence) -> _Known:
    known = _exactly(_EMPTY)
    for op, arg in tree:
        if op is C.LITERAL:
            part = _exactly(frozenset([_fold(arg)]))
        elif op is C.IN:
            part = _char_class(arg)
        elif op is C.SUBPATTERN:
            part = _walk(arg[3])
        elif op is C.BRANCH:
            part = _either([_walk(x) for x in arg[1]])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            one = _walk(inner)
            if low == 0:
                part = _either([_exactly(_EMPTY), one]) if high == 1 else _ANYTHING
            else:
                part = one
                for _ in range(min(low, 4) - 1):
                    part = _concat(part, one)
                if not low == high <= 4:
                    part = _concat(_loose(part), _ANYTHING)
        elif op is C.ATOMIC_GROUP:
            part = _walk(arg)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = _exactly(_EMPTY)
        else:  # any character, negated classes, references
            part = _ANYTHING
        known = _concat(known, part)
    return known


def trigram_query(pattern: str) -> Query:
    """What trigrams a document must hold for the expression to match in it; True: any document."""
    return _loose(_walk(parser.parse(pattern))).query


def trigrams_of(query: Query) -> set[bytes]:
    if isinstance(query, tuple):
        return set().union(*(trigrams_of(q) for q in query[1]))
    return {query} if isinstance(query, bytes) else set()


# ---- rules ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, of which ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    @cached_property
    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)

    @cached_property
    def query(self) -> Query:
        return trigram_query(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = self.compiled.finditer(text)
        return [m.span() for m in found if m.end(self.group) - m.start(self.group) >= self.least]


BASE_RULES = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Public formats of further credentials.
MORE_RULES = (
    Rule("private", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

# ---- the index of a segment --------------------------------------------------------------

#: Characters in a segment at most (one document at least).
SEGMENT_CHARS = 4_000_000
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class SegmentIndex:
    """Posting lists of the wanted trigrams over a slice of documents."""

    def __init__(self, texts: Sequence[str], wanted: set[bytes]):
        self.size = len(texts)
        self.postings: dict[bytes, np.ndarray] = {}
        if not wanted or not texts:
            return
        raw = [t.encode() for t in texts]
        # Three zero bytes part the documents: no wanted trigram spans two of them.
        data = _FOLD[np.frombuffer(b"\0\0\0".join(raw) + b"\0\0\0", np.uint8)].astype(np.uint32)
        starts = np.cumsum([0, *(len(x) + 3 for x in raw)])
        code = data[:-2] << 16 | data[1:-1] << 8 | data[2:]
        names = sorted(wanted)
        number = np.full(1 << 24, 255, dtype=np.uint8) if len(names) < 255 else np.full(1 << 24, 65535, dtype=np.uint16)
        none = number[0]
        for i, name in enumerate(names):
            number[int.from_bytes(name, "big")] = i
        which = number[code]
        at = np.flatnonzero(which != none)
        owner = np.searchsorted(starts, at, side="right") - 1
        pairs = np.unique(which[at].astype(np.int64) * self.size + owner)
        cut = np.searchsorted(pairs, np.arange(len(names) + 1, dtype=np.int64) * self.size)
        for i, name in enumerate(names):
            self.postings[name] = pairs[cut[i] : cut[i + 1]] - i * self.size

    def ask(self, query: Query) -> np.ndarray:
        """The numbers of the documents that fulfil the query, in order."""
        if query is True:
            return np.arange(self.size)
        if query is False:
            return np.arange(0)
        if isinstance(query, bytes):
            return self.postings.get(query, np.arange(0))
        found = sorted((self.ask(q) for q in query[1]), key=len)
        result = found[0]
        for x in found[1:]:
            result = np.intersect1d(result, x, assume_unique=True) if query[0] == "and" else np.union1d(result, x)
        return result


def scan(texts: Sequence[str], rules: Sequence[Rule]) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, rule number, end), ordered so."""
    wanted = set().union(*(trigrams_of(r.query) for r in rules))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end]) <= SEGMENT_CHARS):
            chars += len(texts[end])
            end += 1
        index = SegmentIndex(texts[at:end], wanted)
        for number, rule in enumerate(rules):
            for i in index.ask(rule.query).tolist():
                found[at + i] += [(a, number, b) for a, b in rule.spans(texts[at + i])]
        at = end
    for x in found:
        x.sort()
    return found


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)


def secret_spans(
    docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, key: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """key, spans (array of kind, start, end in code points, end exclusive): a row per input row.

    Spans are ordered by start, then by the rule's place. Null and empty texts have none.
    Repeated rows and null keys stay; other columns are not read. Narrow: no shuffle.
    """

    def compute(texts: list[str]) -> dict[str, list]:
        return {"spans": [[(rules[k].kind, a, b) for a, k, b in x] for x in scan(texts, rules)]}

    return map_texts(docs, [key], text_col, T.StructType([T.StructField("spans", SPANS)]), compute)


def redact(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + MORE_RULES, text_col: str = "text") -> DataFrame:
    """The same rows and columns, with every span of a secret replaced by ``[kind]``.

    Overlapping spans are replaced together, under the first one's kind. Texts without secrets,
    null texts included, stay as they are. All columns pass through, whatever they are called.
    """
    names = docs.columns
    at = names.index(text_col)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(docs.schema)

    def replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, last, end = [], 0, 0
        for a, k, b in spans:
            if a >= end:
                out += [text[max(last, end) : a], f"[{rules[k].kind}]"]
                last = end = b
            end = max(end, b)
        return "".join([*out, text[end:]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = scan([t or "" for t in texts], rules)
            done = [replaced(t, s) if s else t for t, s in zip(texts, found, strict=True)]
            columns = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=True)]
            columns[at] = pa.array(done, type=arrow.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return docs.mapInArrow(run, docs.schema)


DIGEST = T.StructType(
    [
        *(T.StructField(f"n_{r.kind}", T.LongType()) for r in BASE_RULES),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of secret_spans as counts, a digest of the base kinds, and one string."""
    found = secret_spans(read_table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE_RULES]
    told = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(number, kinds),
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )


def _positions(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: lengths of what lies between matches, summed up."""
    quoted = pattern.replace("'", "''")
    length = f"length(regexp_extract(h.m, '{quoted}', {group}))" if group else "length(h.m)"
    return f"""
    SELECT doc_id, '{kind}' AS kind, {number} AS k, place AS s, place + length(m) AS e FROM (
      SELECT h.doc_id, h.m, {length} AS size,
             list_sum([length(x) for x in h.gaps[1:h.i]])
             + coalesce(list_sum([length(x) for x in h.ms[1:h.i - 1]]), 0) AS place
      FROM (SELECT doc_id, ms, gaps, unnest(ms) AS m, generate_subscripts(ms, 1) AS i
            FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS ms,
                         string_split_regex(text, '{quoted}') AS gaps
                  FROM documents WHERE text IS NOT NULL)) h)
    WHERE size >= {least}"""


def _either_case(pattern: str) -> str:
    head = "(password|passwd|secret|token|api_?key)"
    spelt = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in head)
    return re.sub(r"\(\?i:\(.*?\)\)", lambda _: spelt, pattern)


OP4_SQL = f"""
WITH found AS ({" UNION ALL ".join(_positions(r.kind, i, _either_case(r.pattern), r.group, r.least) for i, r in enumerate(BASE_RULES + MORE_RULES))}),
told AS (
  SELECT doc_id,
    count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access,
    count(*) FILTER (WHERE k = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (WHERE k < 3), '') AS base,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN told USING (doc_id)
"""
