"""The queries of the style operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import scoring as T
from ..operators import signals as G
from ..operators import style as S
from ..sources import extract, staging
from ..streaming import scores as streams
from . import oracles
from .prepared import prepared



def _from(make):
    """A query over what is prepared of the documents."""
    return lambda spark, sf_dir: make(prepared(spark, sf_dir))


def _pages(spark, sf_dir):
    """The pages, dealt over tasks by their bytes."""
    pages = staging.read(spark, sf_dir, "pages")
    return pages.repartition(staging.tasks(pages, "html"), "page_id", "html")


def _rounded(name):
    """To six places; so that halves of the last place, which sums in another order miss, go up."""
    return F.round(F.col(name) + 1e-10, 6).alias(name)


def _long(p):
    return p.rows.select("doc_id", "code", "signal", "family", "held", *[_rounded(c) for c in ("value", "dev", "evidence")], "weight")


def _lines(p):
    return R.report_lines(p.wide, p.rows, G.register_hits(p.corpus), G.top_grams(p.corpus), p.corpus.languages)


QUERIES = {
    "word_freq": lambda spark, sf_dir: S.word_freq(staging.read(spark, sf_dir)),
    "word_stats": lambda spark, sf_dir: S.word_stats(staging.read(spark, sf_dir)),
    "typography_counts": lambda spark, sf_dir: S.typography(S.unique(staging.read(spark, sf_dir))),
    "language_detect": lambda spark, sf_dir: S.detect_language(S.unique(staging.read(spark, sf_dir))),
    "languages": lambda spark, sf_dir: T.languages(prepared(spark, sf_dir).corpus, prepared(spark, sf_dir).lexicon),
    "sentences": _from(lambda p: G.sentence_rows(p.corpus).select("doc_id", "code", "sent_idx", "sentence")),
    "sentence_offsets": _from(lambda p: G.sentence_offsets(p.corpus)),
    "rhythm_stats": _from(lambda p: G.rhythm(p.corpus)),
    "marker_rates": _from(lambda p: G.marker_rates(p.corpus)),
    "mattr": _from(lambda p: G.mattr(p.corpus, sample=G.SAMPLE).select("doc_id", _rounded("mattr"))),
    "rep5": _from(lambda p: G.rep5(p.corpus).select("doc_id", F.round("rep5", 6).alias("rep5"))),
    "top_grams": _from(lambda p: G.top_grams(p.corpus)),
    "register_hits": _from(lambda p: G.register_hits(p.corpus)),
    "register_totals": _from(lambda p: R.register_totals(G.register_hits(p.corpus))),
    "sentence_scores": _from(lambda p: G.sentence_scores(p.features)),
    "sentence_readout": _from(lambda p: R.sentence_readout(p.features)),
    "trace_buckets": _from(lambda p: G.trace_buckets(p.features)),
    "trace_ticks": _from(lambda p: R.trace_ticks(G.trace_buckets(p.features))),
    "signals_long": _from(_long),
    "index_score": _from(lambda p: p.scores),
    "score_all": _from(lambda p: T.outcomes(p.corpus.languages, p.scores)),
    "family_scores": _from(lambda p: G.family_scores(p.rows)),
    "family_counts": _from(lambda p: R.family_counts(p.rows)),
    "findings_top4": _from(lambda p: G.findings(p.rows)),
    "plain_reading": _from(lambda p: R.plain_reading(p.scores)),
    "held_signals": _from(lambda p: R.held_signals(p.rows)),
    "ladder": _from(lambda p: R.ladder(p.rows)),
    "ladder_detail": _from(lambda p: R.ladder_detail(p.rows)),
    "document_stats": _from(lambda p: R.document_stats(p.wide)),
    "shape_reasons": _from(lambda p: R.shape_reasons(p.wide)),
    "report_text": _from(lambda p: R.report_texts(_lines(p))),
    "corpus_rollup": lambda spark, sf_dir: R.corpus_rollup(prepared(spark, sf_dir).scores, staging.read(spark, sf_dir)),
    "paragraphs": _from(lambda p: R.paragraph_rows(p.corpus)),
    "plate_pages": _from(lambda p: R.plate_pages(p.corpus)),
    "stream_scores": lambda spark, sf_dir: streams.streamed(spark, f"{sf_dir}/documents.parquet", prepared(spark, sf_dir).ranked, sample=G.SAMPLE).drop("source"),
    "stream_rollup": lambda spark, sf_dir: streams.streamed(spark, f"{sf_dir}/documents.parquet", prepared(spark, sf_dir).ranked, streams.rolled_up),
    "page_texts": lambda spark, sf_dir: extract.extract_pages(_pages(spark, sf_dir)),
}

_TEXT = "(SELECT doc_id, regexp_replace(coalesce(min(text), ''), '\\r\\n?', chr(10), 'g') AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)"
_FREQ = f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({oracles._all('lower(text)', oracles.WORD)}) AS word FROM {_TEXT}) GROUP BY ALL"
_EDGES = oracles._q(f"^{oracles.SPACE}+|{oracles.SPACE}+$")


def _count(pattern: str) -> str:
    return f"len({oracles._all('text', pattern)})"


SQL = oracles.SQL | {
    "word_freq": _FREQ,
    "word_stats": f"""SELECT doc_id, sum(n)::BIGINT AS words, count(*) AS types, round(avg((n = 1)::INT), 6) AS hapax,
        round(CASE WHEN sum(n) > 1 THEN 10000.0 * (sum(n * n) - sum(n)) / (sum(n) * sum(n)) ELSE 0 END, 6)::DOUBLE AS yules_k FROM ({_FREQ}) GROUP BY doc_id""",
    "typography_counts": f"""SELECT doc_id, {_count("[—–]")} AS dashes, {_count("[“”‘’]")} AS curly, {_count(chr(91) + chr(34) + chr(39) + chr(93))} AS straight,
        {_count(rf"\.{oracles.SPACE}{{2,}}")} AS wide_gaps, {_count(rf"\.{oracles.SPACE}")} AS gaps,
        {_count(r"[\x{a0}\x{200b}-\x{200d}\x{2007}\x{202f}\x{feff}\x{2060}]")} AS odd_spaces,
        {_count(r"(?:^|\n)#{1,6}" + oracles.SPACE + r"|\*\*[^*\n]{2,}\*\*")} AS heads,
        len(ls) AS lines, len([x for x in ls if regexp_matches(x, {oracles._q("(?i)^(?:[-*•‣▪]|" + chr(92) + "d{1,2}[.)]|[a-z][.)])" + oracles.SPACE)})]) AS items
        FROM (SELECT *, [l for l in [regexp_replace(x, {_EDGES}, '', 'g') for x in string_split(text, chr(10))] if l <> ''] AS ls FROM {_TEXT})""",
}
