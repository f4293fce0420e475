"""SQL of the style queries, worked out from the rules of the measurements and not from the operators.

Sentences are told by chunks: what lies up to and with a run of end marks and its closing marks.
Whether a chunk ends a sentence is read off the characters around it, and windows gather chunks.
"""

from __future__ import annotations

from html.entities import html5

from ..functions import fixed_values as V
from ..functions import signal_values as G

LANGUAGES = ("en", "es", "pt", "fr")
SPACE = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WORD = r"\p{L}[\p{L}'’]*"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _terms(text: str) -> list[str]:
    parts = text.split("|") if "|" in text else text.split()
    return list(dict.fromkeys(p.strip().lower() for p in parts if p.strip()))


def _values(lists: dict[str, str], name: str) -> str:
    rows = ", ".join(f"({_q(c)}, {i}, {_q(m)})" for c in lists for i, m in enumerate(_terms(lists[c])))
    return f"(VALUES {rows}) AS {name}(code, ord, term)"


def _all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {_q(pattern)})"


def _by_code(choices: dict[str, str]) -> str:
    return "CASE code " + " ".join(f"WHEN {_q(c)} THEN {choices[c]}" for c in choices) + " END"


_SCRIPTS = {
    "latin": "A-Za-zÀ-ɏ", "cyrillic": "Ѐ-ӿ", "greek": "Ͱ-Ͽ", "arabic": "؀-ۿ",
    "hebrew": "֐-׿", "cjk": "぀-ヿ一-鿿가-힯", "devanagari": "ऀ-ॿ", "thai": "฀-๿",
}
_CUES = {
    "es": (r"[ñ¿¡]", 0.02), "pt": (r"[ãõçâ]", 0.02), "fr": (r"[çœêèùûîï]|\b[ldjnmts]['’]", 0.015),
    "it": (r"\b(?:gli|degli|nell|dell|sull)\b", 0.02), "de": (r"[äöüß]", 0.015),
}
_FOREIGN = "greatest(" + ", ".join(f"n_{k}" for k in _SCRIPTS if k != "latin") + ")"
_CUE = "CASE code " + " ".join(f"WHEN '{c}' THEN len({_all('s', p)}) * 1000.0 / greatest(1, length(s)) * {w}" for c, (p, w) in _CUES.items()) + " ELSE 0 END"

_SCRIPT_NAMES = {
    "cyrillic": "a Cyrillic script (Russian, Ukrainian, Bulgarian or similar)", "greek": "Greek", "arabic": "an Arabic script", "hebrew": "Hebrew", "cjk": "Chinese, Japanese or Korean",
    "devanagari": "a Devanagari script (Hindi, Marathi or similar)", "thai": "Thai",
}
_NAMES_OF = {"en": "English", "es": "Spanish", "pt": "Portuguese", "fr": "French", "it": "Italian", "de": "German", "nl": "Dutch", "ca": "Catalan", "pl": "Polish", "ru": "Russian", "tr": "Turkish", "sv": "Swedish"}
_NAME = "CASE status WHEN 'unsupported' THEN coalesce(script, " + "CASE best " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in _NAMES_OF.items()) + " END) WHEN 'ok' THEN CASE best " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in _NAMES_OF.items()) + " END END"
TEXTS = """texts AS (SELECT doc_id, regexp_replace(coalesce(min(text), ''), '\\r\\n?', chr(10), 'g') AS text
  FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)"""

DETECTED = f"""{TEXTS},
heads AS (SELECT doc_id, substr(text, 1, 20000) AS s, {_all("lower(substr(text, 1, 60000))", WORD)}[1:6000] AS tok,
  {", ".join(f"len({_all('substr(text, 1, 4000)', '[' + v + ']')}) AS n_{k}" for k, v in _SCRIPTS.items())} FROM texts),
hits AS (SELECT doc_id, code, count(*) AS c FROM (SELECT doc_id, unnest(tok) AS term FROM heads) JOIN {_values(V.VOTES, "votes")} USING (term) GROUP BY ALL),
langs AS (SELECT unnest({list(V.VOTES)}) AS code, unnest(range({len(V.VOTES)})) AS ord),
scores AS (SELECT doc_id, code, ord, round(coalesce(c, 0) / greatest(len(tok), 1) + {_CUE}, 9) AS score
  FROM heads CROSS JOIN langs LEFT JOIN hits USING (doc_id, code)),
best AS (SELECT doc_id, arg_max(code, (score, -ord)) AS best, max(score) AS score, list_sort(list(score), 'DESC')[2] AS second FROM scores GROUP BY doc_id),
detected AS (SELECT doc_id, CASE WHEN {_FOREIGN} > n_latin AND {_FOREIGN} > 0.35 * ({" + ".join("n_" + k for k in _SCRIPTS)}) THEN 'unsupported'
  WHEN len(tok) < 20 THEN 'too_short' WHEN score < 0.035 THEN 'unknown' WHEN best IN {LANGUAGES} THEN 'ok' ELSE 'unsupported' END AS status, best, score, second,
  CASE WHEN {_FOREIGN} > n_latin AND {_FOREIGN} > 0.35 * ({" + ".join("n_" + k for k in _SCRIPTS)}) THEN CASE {_FOREIGN} {" ".join(f"WHEN n_{k} THEN {_q(n)}" for k, n in _SCRIPT_NAMES.items())} END END AS script
  FROM heads JOIN best USING (doc_id)),
scored AS (SELECT doc_id, text, CASE status WHEN 'ok' THEN best ELSE 'en' END AS code FROM texts JOIN detected USING (doc_id) WHERE status IN ('ok', 'too_short'))"""

_CLOSERS = "[\"'”’)\\]}»]*"


def sentence_ctes(source: str, name: str, keys: str) -> str:
    """CTEs that split ``source`` (keys, code, text) into ``name`` (keys, code, sent_idx, sentence, nl, begun)."""
    short = {c: [a for a in _terms(V.ABBREVIATIONS[c]) if "." not in a] for c in LANGUAGES}
    known = " OR ".join(f"(code = '{c}' AND word IN ({', '.join(map(_q, short[c]))}))" for c in LANGUAGES)
    return f"""{name}_chunks AS (SELECT {keys}, code, text, unnest(ch) AS chunk, generate_subscripts(ch, 1) AS i FROM (
  SELECT {keys}, code, text, {_all("text", "[^.!?…]*[.!?…]+" + _CLOSERS + "|[^.!?…]+")} AS ch FROM {source})),
{name}_placed AS (SELECT *, sum(length(chunk)) OVER w AS k, lead(chunk) OVER w AS following, regexp_extract(chunk, {_q("[.!?…]+" + _CLOSERS + "$")}) AS mark
  FROM {name}_chunks WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
{name}_seen AS (SELECT *, substr(text, greatest(1, k - length(mark) - 13)::BIGINT, least(14, k - length(mark))::BIGINT) AS before,
  substr(text, (k + 1)::BIGINT, 3) AS after FROM {name}_placed),
{name}_told AS (SELECT *, lower(replace(regexp_extract(before, {_q("[" + chr(92) + "p{L}.'’]+$")}), '.', '')) AS word,
  substr(regexp_replace(after, '^[ \\t]+', ''), 1, 1) AS near FROM {name}_seen),
{name}_cut AS (SELECT *, (mark <> '' AND (after = '' OR substr(after, 1, 1) IN (' ', chr(9), chr(10))) AND NOT (substr(mark, 1, 1) = '.' AND (
  {known} OR (regexp_matches(before, '\\d$') AND regexp_matches(coalesce(following, ''), {_q("^" + SPACE + "*" + chr(92) + "d")}))
  OR (regexp_matches(near, '[\\p{{Ll}},;:]') AND substr(after, 1, 1) <> chr(10)))))::INT AS ends FROM {name}_told),
{name}_parts AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM {name}_cut),
{name} AS (SELECT {keys}, code, row_number() OVER (PARTITION BY {keys} ORDER BY part) - 1 AS sent_idx,
  regexp_replace(slice, {_q("^" + SPACE + "+|" + SPACE + "+$")}, '', 'g') AS sentence,
  length(regexp_extract(slice, {_q("^" + SPACE + "*")})) - length(replace(regexp_extract(slice, {_q("^" + SPACE + "*")}), chr(10), '')) AS nl, begun
  FROM (SELECT {keys}, code, part, string_agg(chunk, '' ORDER BY i) AS slice, min(k - length(chunk)) AS begun FROM {name}_parts GROUP BY {keys}, code, part)
  WHERE regexp_matches(slice, '\\p{{L}}'))"""


SENTENCES = f"{DETECTED},\n{sentence_ctes('scored', 'sents', 'doc_id')}"
TOKENS = f"""{SENTENCES},
toks AS (SELECT doc_id, code, sent_idx, sentence, nl, lower(sentence) AS low, [lower(w) FOR w IN {_all("sentence", WORD)}] AS tok FROM sents)"""
WORDS = f"""{TOKENS},
words AS (SELECT doc_id, code, sent_idx, unnest(tok) AS word, generate_subscripts(tok, 1) AS p FROM toks)"""
LEXICON = f"""{WORDS},
lexicon AS (SELECT code, word, row_number() OVER (PARTITION BY code ORDER BY c DESC, word) AS rank
  FROM (SELECT code, word, count(*) AS c FROM words GROUP BY ALL) QUALIFY rank <= 600)"""

_SCALE = 0.97 / sum((r + 2.7) ** -1.07 for r in range(1, 60_001))
_BITS = f"-log2(greatest({_SCALE!r} / pow(coalesce(rank, floor(1200 * pow(1.42, least(greatest(length(word), 3), 22) - 4) + 0.5)) + 2.7, 1.07), 1e-12))"


def _matches(text: str, patterns: dict[str, str]) -> str:
    found = {c: f"regexp_matches({text}, {_q('(?i)' + p.replace(chr(92) + 's', SPACE))})::INT" for c, p in patterns.items()}
    return _by_code(found)


def _holds(lists: dict[str, str]) -> str:
    return _by_code({c: f"len(list_filter({_terms(lists[c])!r}, lambda m: contains(low, m)))" if not any("'" in t for t in _terms(lists[c])) else
                     "len(list_filter([" + ", ".join(map(_q, _terms(lists[c]))) + "], lambda m: contains(low, m)))" for c in LANGUAGES})


def _opener(code: str) -> str:
    det, pron, conj = (x.split() for x in G.OPENERS[code])
    adverbs = sorted({m.split(" ")[0] for m in _terms(V.DISCOURSE[code])})
    among = lambda ws: f"tok[1] IN ({', '.join(map(_q, ws))})"
    return (f"CASE WHEN {among(det)} THEN 0 WHEN {among(pron)} THEN 1 WHEN {among(conj)} THEN 2 WHEN {among(adverbs)} OR tok[1] LIKE '%{G.ADVERB_END[code]}' THEN 3 "
            f"WHEN regexp_matches(regexp_extract(sentence, {_q(WORD)}), '^\\p{{Lu}}') THEN 4 ELSE 5 END")  # fmt: skip


FEATURES = f"""{LEXICON},
bits AS (SELECT doc_id, sent_idx, avg({_BITS}) AS surp FROM words LEFT JOIN lexicon USING (code, word) GROUP BY ALL),
marks AS (SELECT doc_id, code, sent_idx, len(tok) AS n, tok[1] AS first, {_by_code({c: _opener(c) for c in LANGUAGES})} AS opener,
  {_holds(V.DISCOURSE)} AS dm, {_holds(V.REGISTER)} AS rm, {_holds(V.HEDGES)} AS hg,
  {_matches("sentence", G.PASSIVE)} AS passive, {_matches("sentence", G.FIRST_PERSON_IN)} AS human,
  regexp_matches(low, {_q("[’']" + SPACE + "?(?:s|t|re|ve|ll|d|m)" + chr(92) + "b")})::INT AS contracted,
  regexp_matches(sentence, {_q("[!?][" + chr(34) + ")'’”]*$")})::INT AS exclaims, regexp_matches(sentence, {_q("[.!?…][" + chr(34) + ")'’”]*$")})::INT AS ended FROM toks),
features AS (SELECT * FROM marks JOIN bits USING (doc_id, sent_idx))"""

GRAMS = f"""{TOKENS},
starts AS (SELECT doc_id, sent_idx, tok, unnest(range(1, len(tok) - 3)) AS q FROM toks),
grams AS (SELECT doc_id, gram, count(*) AS c, min((sent_idx, q)) AS place
  FROM (SELECT doc_id, sent_idx, q, array_to_string(tok[q:q + 4], ' ') AS gram FROM starts) GROUP BY doc_id, gram)"""

#: The words that the moving ratio is taken of: those of a sample of sentences, or all.
_SAMPLED = """counted AS (SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY doc_id) / 400)) AS k FROM toks),
kept AS (SELECT *, coalesce(sum(len(tok)) OVER (PARTITION BY doc_id ORDER BY sent_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM counted WHERE sent_idx % k = 0),
stream AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx, i) - 1 AS p
  FROM (SELECT doc_id, sent_idx, unnest(tok) AS word, generate_subscripts(tok, 1) AS i FROM kept WHERE before <= 20000)),"""
_EVERY = "stream AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx, words.p) - 1 AS p FROM words),"

SQL = {
    "language_detect": f"""WITH {DETECTED}
SELECT doc_id, status, CASE WHEN status = 'ok' THEN best END AS code, CASE WHEN status IN ('ok', 'unknown') THEN round(score, 6) END AS top,
  CASE WHEN status = 'ok' THEN round(least(1, score / 0.25), 6) END AS confidence, CASE WHEN status = 'ok' THEN round(score - second, 6) END AS margin, {_NAME} AS name FROM detected""",
    "sentence_offsets": f"""WITH {SENTENCES},
placed AS (SELECT s.*, length(regexp_extract(substr(text, begun::BIGINT + 1), {_q("^" + SPACE + "*")})) AS lead FROM sents s JOIN (SELECT doc_id, text FROM scored) USING (doc_id))
SELECT doc_id, sent_idx::INTEGER AS sent_idx, begun::BIGINT AS "offset", (begun + lead)::BIGINT AS begin, length(sentence)::INTEGER AS length, nl::INTEGER AS nl FROM placed""",
    "sentences": f"WITH {SENTENCES}\nSELECT doc_id, code, sent_idx::INTEGER AS sent_idx, sentence FROM sents",
    "rhythm_stats": f"""WITH {TOKENS},
n AS (SELECT doc_id, len(tok)::DOUBLE AS n FROM toks),
m AS (SELECT doc_id, count(*) AS k, avg(n) AS mean, coalesce(stddev_samp(n), 0) AS sd FROM n GROUP BY doc_id)
SELECT doc_id, any_value(k) AS sentences, round(any_value(sd / mean), 6) AS burstiness, round(any_value(sd), 6) AS "sentSd", round(any_value(mean), 6) AS "sentMean",
  round(CASE WHEN any_value(k) >= 4 AND any_value(sd) > 0 THEN avg(pow((n.n - mean) / nullif(sd, 0), 4)) ELSE 3 END, 6) AS "sentKurt",
  round(CASE WHEN any_value(k) >= 3 AND any_value(sd) > 0 THEN avg(pow((n.n - mean) / nullif(sd, 0), 3)) ELSE 0 END, 6) AS "sentSkew",
  round(avg((n.n < 8)::INT), 6) AS "shortRate", round(avg((n.n > 35)::INT), 6) AS "longRate", round(avg((n.n BETWEEN 15 AND 28)::INT), 6) AS "bandRate"
FROM n JOIN m USING (doc_id) GROUP BY doc_id""",
    "marker_rates": f"""WITH {TOKENS},
held AS (SELECT doc_id, tok, {_holds(V.DISCOURSE)} AS dm, {_holds(V.REGISTER)} AS rm, {_holds(V.HEDGES)} AS hg,
  {_by_code({c: f"len(list_filter(tok, lambda t: t IN ({', '.join(map(_q, _terms(V.FIRST_PERSON[c])))})))" for c in LANGUAGES})} AS fp,
  {_by_code({c: f"len(list_filter(tok, lambda t: t IN ({', '.join(map(_q, _terms(V.INTENSIFIERS[c])))})))" for c in LANGUAGES})} AS it,
  {_by_code({c: f"len(list_filter(tok, lambda t: t IN ({', '.join(map(_q, _terms(V.FUNCTION_WORDS[c])))})))" for c in LANGUAGES})} AS fw FROM toks)
SELECT doc_id, sum(len(tok))::BIGINT AS words, round(1000.0 * sum(dm) / sum(len(tok)), 6) AS discourse, round(1000.0 * sum(rm) / sum(len(tok)), 6) AS "regMark",
  round(1000.0 * sum(hg) / sum(len(tok)), 6) AS hedge, round(1000.0 * sum(fp) / sum(len(tok)), 6) AS "firstPerson", round(1000.0 * sum(it) / sum(len(tok)), 6) AS intens,
  round(sum(fw) / sum(len(tok)), 6) AS "funcRate" FROM held GROUP BY doc_id""",
    "mattr": f"""WITH {TOKENS},
{_SAMPLED}
size AS (SELECT doc_id, count(*) AS n, count(DISTINCT word) AS types FROM stream GROUP BY doc_id),
seen AS (SELECT *, lag(p) OVER (PARTITION BY doc_id, word ORDER BY p) AS q FROM stream),
opened AS (SELECT doc_id, sum(greatest(0, least(p, n - 50) - greatest(p - 49, coalesce(q, -1) + 1, 0) + 1)) AS o FROM seen JOIN size USING (doc_id) GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN n >= 50 THEN o / 50 / (n - 49) ELSE types / n END + 1e-10, 6) AS mattr FROM opened JOIN size USING (doc_id)""",
    "rep5": f"WITH {GRAMS}\nSELECT doc_id, round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 6) AS rep5 FROM grams GROUP BY doc_id",
    "top_grams": f"""WITH {GRAMS}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, place)::INTEGER AS rank, gram, c FROM grams WHERE c > 1 QUALIFY rank <= 8""",
    "register_hits": f"""WITH {DETECTED},
found AS (SELECT doc_id, ord, term AS marker, ((length(lower(text)) - length(replace(lower(text), term, ''))) / length(term))::INTEGER AS c
  FROM scored JOIN {_values(V.REGISTER, "r")} USING (code))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, ord)::INTEGER AS rank, marker, c FROM found WHERE c > 0 QUALIFY rank <= 14""",
    "sentence_scores": f"""WITH {FEATURES},
placed AS (SELECT *, avg(surp) OVER w AS mu, coalesce(stddev_samp(surp) OVER w, 0) AS sigma FROM features WINDOW w AS (PARTITION BY doc_id))
SELECT doc_id, sent_idx::INTEGER AS sent_idx, n::INTEGER AS n, round(surp, 6) AS surp, round(least(0.98, greatest(0.02, 0.5 + 0.75 * (
  0.42 * least(2, greatest(-2, CASE WHEN sigma > 0 THEN (mu - surp) / sigma ELSE 0 END)) / 2 + 0.18 * least(1, greatest(-1, 1 - abs(n - 21) / 16))
  + 0.20 * least(1, 0.9 * dm) + 0.28 * least(1, 1.1 * rm) + 0.08 * passive - 0.22 * human))), 6) AS score FROM placed""",
    "trace_buckets": f"""WITH {FEATURES},
placed AS (SELECT *, ceil(count(*) OVER (PARTITION BY doc_id) / 520) AS k, row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1 AS i FROM features)
SELECT doc_id, floor(i / k)::BIGINT AS bucket, round(avg(surp), 6) AS surp, round(avg(n), 6) AS n FROM placed GROUP BY ALL""",
}

# ---- the 41 signals --------------------------------------------------------------------------

_LETTERS = {"es": "a-záéíóúüñàèìòùç", "pt": "a-zàáâãéêíóôõúüç", "fr": "a-zàâäéèêëîïôöùûüÿœæç"}
_FR_VOWELS = "aeiouyàâäéèêëîïôöùûüœæ"
#: Syllables of ``word``: Spanish vowels are taken two at a time with what stands before them.
_ES = "aeiouáéíóúüàèìòù"
_SYLLABLES = {
    "en": "CASE WHEN w = '' THEN 0 WHEN length(w) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(w, '(?:[^laeiouy]es|ed|[^laeiouy]e)$', ''), '^y', ''), '[aeiouy]+'))) END",
    "es": f"""CASE WHEN w = '' THEN 0 ELSE greatest(1, len(list_filter(range(1, length(w) + 1), lambda i: contains('{_ES}', w[i]) AND (i = 1 OR NOT contains('{_ES}', w[i - 1])
      OR (contains('aeoáéóàè', w[i]) AND contains('aeoáéóàè', w[i - 1])) OR contains('íú', w[i]) OR contains('íú', w[i - 1]))))) END""",
    "pt": "CASE WHEN w = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(w, '[aeiouáéíóúâêîôûãõàèìòù]+'))) END",
    "fr": f"""CASE WHEN w = '' THEN 0 ELSE greatest(1, len(regexp_extract_all(regexp_replace(regexp_replace(
      CASE WHEN regexp_matches(w, '(?:^|[^m])ent$') THEN left(w, length(w) - 3) ELSE w END, 'es$', ''), 'e$', ''), '[{_FR_VOWELS}]+'))) END""",
}
_SPEC_ROWS = []
_own = {}
for _line in G.BANDS.strip().splitlines():
    _name, *_bands = (x.strip() for x in _line.split("|"))
    _own |= {(c, _name): b.split("/") for c, b in zip(LANGUAGES[1:], _bands, strict=True) if b != "-"}
for _place, _line in enumerate(G.SIGNALS.strip().splitlines()):
    _name, _family, _center, _spread, _dir, _weight = (x.strip() for x in _line.split("|"))
    for _code in LANGUAGES:
        _a, _b = _own.get((_code, _name), (_center, _spread))
        _SPEC_ROWS.append(f"('{_code}', '{_name}', {_place}, '{_family}', {float(_a)!r}::DOUBLE, {float(_b)!r}::DOUBLE, {_dir}, {float(_weight)!r}::DOUBLE)")
_NAMES = [line.split("|")[0].strip() for line in G.SIGNALS.strip().splitlines()]


def _entropy(column: str, table: str, name: str) -> str:
    return f"""{name} AS (SELECT doc_id, 0.0 - sum(c / t * log2(c / t)) AS h FROM (SELECT doc_id, count(*) AS c, sum(count(*)) OVER (PARTITION BY doc_id) AS t
  FROM {table} GROUP BY doc_id, {column}) GROUP BY doc_id)"""


def _in(lists: dict[str, str], word: str = "word") -> str:
    return _by_code({c: f"({word} IN ({', '.join(map(_q, _terms(lists[c])))}))" for c in LANGUAGES})


_TRIMMED = f"lambda p: regexp_replace(p, {_q('^' + SPACE + '+|' + SPACE + '+$')}, '', 'g')"
_BLOCKS = lambda p: f"list_filter(list_transform(regexp_split_to_array(text, {_q(p)}), {_TRIMMED}), lambda p: p <> '')"
_EASE = _by_code({c: f"{a!r} - {b!r} * words / sentences - {s!r} * syll / words" for c, (a, b, s) in G.READING_EASE.items()})
_ASCII = lambda c: f"regexp_matches({c}, '^[A-Za-z0-9_]')"
#: A letter run, or its end, of three letters or more from an edge on, that begins the next run after
#: white space, up to an edge; of matches one after another every second overlaps the one before.
_DOUBLED = f"""runs AS (SELECT doc_id, i, p, lag(p) OVER w AS prior, lead(p) OVER w AS gap, lead(p, 2) OVER w AS again, lead(p, 3) OVER w AS later FROM (
  SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p FROM (SELECT doc_id, {_all("text", chr(92) + "p{L}+|" + SPACE + "+|[^" + chr(92) + "p{L}" + SPACE[1:-1] + "]+")} AS ps FROM scored))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT doc_id, i, len(list_filter(range(1, length(p) - 1), lambda j: starts_with(lower(again), lower(p[j:]))
  AND {_ASCII("CASE WHEN j = 1 THEN coalesce(right(prior, 1), '') ELSE p[j - 1] END")} <> {_ASCII("p[j]")}
  AND {_ASCII("again[length(p) - j + 1]")} <> {_ASCII("CASE WHEN length(again) > length(p) - j + 1 THEN again[length(p) - j + 2] ELSE coalesce(left(later, 1), '') END")})) > 0 AS same
  FROM runs WHERE regexp_matches(p, '^\\p{{L}}') AND regexp_matches(gap, {_q("^" + SPACE)}) AND regexp_matches(again, '^\\p{{L}}') AND contains(lower(p), left(lower(again), 3))),
doubled AS (SELECT doc_id, sum((k + 1) // 2) AS d FROM (SELECT doc_id, g, count(*) AS k FROM (
  SELECT doc_id, i - 2 * row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM pairs WHERE same) GROUP BY doc_id, g) GROUP BY doc_id)"""


def _n(pattern: str) -> str:
    return f"len({_all('text', pattern.replace(chr(92) + 's', SPACE))})"


SIGNALS = f"""{FEATURES},
{_DOUBLED},
shape AS (SELECT doc_id, avg(n) AS mean, coalesce(stddev_samp(n), 0) AS sd, avg(surp) AS mu, coalesce(stddev_samp(surp), 0) AS sigma FROM features GROUP BY doc_id),
steps AS (SELECT *, sum(jump) OVER (PARTITION BY doc_id ORDER BY sent_idx) AS run FROM (
  SELECT *, (coalesce(abs(surp - lag(surp) OVER (PARTITION BY doc_id ORDER BY sent_idx)), 1) >= 0.4)::INT AS jump FROM features)),
flat AS (SELECT doc_id, max(k) AS flat FROM (SELECT doc_id, run, count(*) AS k FROM steps GROUP BY ALL) GROUP BY doc_id),
openers AS (SELECT doc_id, sum(c) AS top3 FROM (SELECT doc_id, count(*) AS c FROM features GROUP BY doc_id, first
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC) <= 3) GROUP BY doc_id),
{_entropy("opener", "features", "opener_h")},
rhythm AS (SELECT doc_id, any_value(code) AS code, count(*) AS sentences, any_value(mean) AS mean, any_value(sd) AS sd, any_value(mu) AS mu, any_value(sigma) AS sigma,
  avg(pow((n - mean) / nullif(sd, 0), 4)) AS q4, avg(pow((n - mean) / nullif(sd, 0), 3)) AS q3, avg((n < 8)::INT) AS short, avg((n > 35)::INT) AS long,
  avg((n BETWEEN 15 AND 28)::INT) AS band, avg((n < 6)::INT) AS tiny, avg((ended = 0)::INT) AS open_ended, avg((surp > mu + sigma)::INT) AS spikes,
  sum(dm) AS dm, sum(rm) AS rm, sum(hg) AS hg, sum(contracted) AS contracted, avg(passive) AS passive, avg(exclaims) AS exclaims FROM features JOIN shape USING (doc_id) GROUP BY doc_id),
freq AS (SELECT doc_id, code, word, count(*) AS f FROM words GROUP BY ALL),
lens AS (SELECT doc_id, least(16, length(word)) AS size FROM words),
{_entropy("size", "lens", "len_h")},
lexical AS (SELECT doc_id, sum(f)::DOUBLE AS words, count(*) AS types, avg((f = 1)::INT) AS hapax, CASE WHEN sum(f) > 1 THEN 10000.0 * (sum(f * f) - sum(f)) / (sum(f) * sum(f)) ELSE 0 END AS yules,
  sum(CASE WHEN {_in(V.FUNCTION_WORDS)} THEN f ELSE 0 END) AS fw, sum(CASE WHEN {_in(V.FIRST_PERSON)} THEN f ELSE 0 END) AS fp, sum(CASE WHEN {_in(V.INTENSIFIERS)} THEN f ELSE 0 END) AS it,
  sum(CASE WHEN rank IS NULL THEN f ELSE 0 END) AS oov FROM freq LEFT JOIN lexicon USING (code, word) GROUP BY doc_id),
zipf AS (SELECT doc_id, CASE WHEN count(*) > 20 THEN -regr_slope(ln(f), ln(r)) ELSE 1.07 END AS slope FROM (
  SELECT doc_id, f, row_number() OVER (PARTITION BY doc_id ORDER BY f DESC, word) AS r FROM freq QUALIFY r <= 600) GROUP BY doc_id),
starts AS (SELECT doc_id, sent_idx, tok, unnest(range(1, len(tok) - 3)) AS q FROM toks),
grams AS (SELECT doc_id, count(*) AS c FROM starts GROUP BY doc_id, array_to_string(tok[q:q + 4], ' ')),
repeats AS (SELECT doc_id, sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c) AS rep5 FROM grams GROUP BY doc_id),
{_SAMPLED}
size AS (SELECT doc_id, count(*) AS n, count(DISTINCT word) AS types FROM stream GROUP BY doc_id),
seen AS (SELECT *, lag(p) OVER (PARTITION BY doc_id, word ORDER BY p) AS q FROM stream),
ratio AS (SELECT doc_id, CASE WHEN any_value(n) >= 50 THEN sum(greatest(0, least(p, n - 50) - greatest(p - 49, coalesce(q, -1) + 1, 0) + 1)) / 50 / (any_value(n) - 49)
  ELSE any_value(types) / any_value(n) END AS mattr FROM seen JOIN size USING (doc_id) GROUP BY doc_id),
blocks AS (SELECT doc_id, code, CASE WHEN len(b) < 3 AND contains(text, chr(10)) THEN {_BLOCKS(chr(92) + "n+")} ELSE b END AS ps
  FROM (SELECT *, {_BLOCKS(chr(92) + "n[ " + chr(92) + "t]*" + chr(92) + "n+")} AS b FROM scored)),
paras AS (SELECT doc_id, code, unnest(ps) AS text, generate_subscripts(ps, 1) AS pid FROM blocks),
{sentence_ctes("paras", "psents", "doc_id, pid")},
pwords AS (SELECT doc_id, code, pid, regexp_replace(lower(x), '[^' || {_by_code({c: _q(_LETTERS.get(c, "a-z")) for c in LANGUAGES})} || ']', '', 'g') AS w
  FROM (SELECT doc_id, code, pid, unnest({_all("text", WORD)}) AS x FROM paras)),
psyl AS (SELECT doc_id, pid, count(*) AS n, sum({_by_code(_SYLLABLES)}) AS syl FROM pwords GROUP BY ALL),
pcount AS (SELECT doc_id, pid, count(*) AS s FROM psents GROUP BY ALL),
pall AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(syl, 0) AS syl, greatest(1, coalesce(s, 0)) AS s FROM paras LEFT JOIN psyl USING (doc_id, pid) LEFT JOIN pcount USING (doc_id, pid)),
structure AS (SELECT doc_id, count(*) AS paras, count(*) FILTER (WHERE n > 0) AS para_lens, coalesce(stddev_samp(n) FILTER (WHERE n > 0) / avg(n) FILTER (WHERE n > 0), 0) AS para_cv,
  coalesce(stddev_samp(s) / avg(s), 0) AS para_sent_cv, count(*) FILTER (WHERE n >= 25) AS grades, sum(syl) AS syll,
  CASE WHEN count(*) FILTER (WHERE n >= 25) > 2 THEN stddev_samp(0.39 * n / s + 11.8 * syl / n - 15.59) FILTER (WHERE n >= 25) ELSE 2.4 END AS grade_sd FROM pall GROUP BY doc_id),
typed AS (SELECT doc_id, {_n("[—–]")} AS dashes, {_n("[“”‘’]")} AS curly, {_n("[" + chr(34) + "']")} AS straight, {_n(chr(92) + "." + chr(92) + "s{2,}")} AS wide, {_n(chr(92) + "." + chr(92) + "s")} AS gaps,
  {_n("[" + chr(92) + "x{a0}" + chr(92) + "x{200b}-" + chr(92) + "x{200d}" + chr(92) + "x{2007}" + chr(92) + "x{202f}" + chr(92) + "x{feff}" + chr(92) + "x{2060}]")} AS odd,
  {_n("(?:^|" + chr(92) + "n)#{1,6}" + chr(92) + "s|" + chr(92) + "*" + chr(92) + "*[^*" + chr(92) + "n]{2,}" + chr(92) + "*" + chr(92) + "*")} AS heads,
  len(ls) AS lines, len(list_filter(ls, lambda x: regexp_matches(x, {_q("(?i)^(?:[-*•‣▪]|" + chr(92) + "d{1,2}[.)]|[a-z][.)])" + SPACE)}))) AS items,
  {_n(chr(92) + "p{Ll}," + chr(92) + "p{L}")} + {_n(chr(92) + "p{Ll}" + chr(92) + "." + chr(92) + "p{Lu}")} + coalesce(d, 0) + CASE WHEN code = 'en' THEN {_n(chr(92) + "bi" + chr(92) + "b")} * 0.35 ELSE 0 END
  + {_n("[!?]{2,}|" + chr(92) + ".{4,}")} + {_n(chr(92) + "s+[,.;:]")} + {_n(chr(92) + "b" + chr(92) + "p{Lu}{2,}" + chr(92) + "p{Ll}+")} * 0.5 AS slips
  FROM (SELECT *, list_filter(list_transform(string_split(text, chr(10)), {_TRIMMED}), lambda x: x <> '') AS ls FROM scored) LEFT JOIN doubled USING (doc_id)),
wide AS (SELECT *, sd / mean AS v0 FROM rhythm JOIN flat USING (doc_id) JOIN openers USING (doc_id) JOIN opener_h USING (doc_id) JOIN lexical USING (doc_id) JOIN zipf USING (doc_id)
  JOIN (SELECT doc_id, h AS len_h FROM len_h) USING (doc_id) LEFT JOIN repeats USING (doc_id) JOIN ratio USING (doc_id) JOIN structure USING (doc_id) JOIN typed USING (doc_id)),
raws AS (SELECT doc_id, code, words, sentences, para_lens, grades, lines, gaps, unnest([{", ".join(map(_q, _NAMES))}]) AS signal, unnest([v0, sd, mean,
  CASE WHEN sentences >= 4 AND sd > 0 THEN q4 ELSE 3 END, CASE WHEN sentences >= 3 AND sd > 0 THEN q3 ELSE 0 END, short, long, band, mu, sigma, spikes, flat, oov / words, abs(slope - 1.07),
  mattr, hapax, yules, len_h, fw / words, coalesce(rep5, 0), 1000.0 * dm / words, 1000.0 * rm / words, 1000.0 * hg / words, 1000.0 * contracted / words, 1000.0 * fp / words, 1000.0 * it / words,
  passive, exclaims, top3 / sentences, h, para_cv, grade_sd, {_EASE}, CASE WHEN lines > 0 THEN items / lines ELSE 0 END, 1000.0 * heads / words, para_sent_cv, 1000.0 * dashes / words,
  CASE WHEN curly + straight > 0 THEN abs(curly - straight) / (curly + straight) ELSE 0.5 END, wide / greatest(gaps, 1), 1000.0 * slips / words, 1000.0 * odd / words]::DOUBLE[]) AS value FROM wide),
told AS (SELECT *, CASE WHEN signal = 'zipfDev' THEN words < 600 WHEN signal = 'rep5' THEN words < 300 WHEN signal = 'gradeSd' THEN grades < 3 WHEN signal IN ('paraCv', 'paraSentCv') THEN para_lens < 3
  WHEN signal = 'doubleSpace' THEN gaps < 20 WHEN signal IN ('sentKurt', 'sentSkew') THEN sentences < 12 WHEN signal = 'flatRun' THEN sentences < 8 WHEN signal IN ('hapax', 'yulesK') THEN words < 200
  WHEN signal = 'listRate' THEN lines < 6 WHEN signal = 'contraction' THEN code <> 'en' ELSE false END AS held FROM raws),
signals AS (SELECT doc_id, code, signal, place, family, value, held, CASE WHEN held THEN 0 ELSE dir * (value - center) / spread END AS dev, CASE WHEN held THEN 0 ELSE w END AS weight
  FROM told JOIN (VALUES {", ".join(_SPEC_ROWS)}) AS spec(code, signal, place, family, center, spread, dir, w) USING (code, signal)),
evidence AS (SELECT *, least(2.5, greatest(-2.5, dev)) AS evidence FROM signals)"""

_MEAN = "CASE WHEN sum(weight) > 0 THEN sum(weight * evidence) / sum(weight) ELSE 0 END"
SQL |= {
    "signals_long": f"""WITH {SIGNALS}
SELECT doc_id, code, signal, family, held, round(value + 1e-10, 6) AS value, round(dev + 1e-10, 6) AS dev, round(evidence + 1e-10, 6) AS evidence, round(weight, 6) AS weight FROM evidence""",
    "family_scores": f"WITH {SIGNALS}\nSELECT doc_id, family, round({_MEAN}, 6) AS score FROM evidence GROUP BY ALL",
    "findings_top4": f"""WITH {SIGNALS},
ranked AS (SELECT doc_id, 'machine' AS side, row_number() OVER (PARTITION BY doc_id ORDER BY dev DESC, place) AS rank, signal, dev FROM evidence WHERE NOT held
  UNION ALL SELECT doc_id, 'human', row_number() OVER (PARTITION BY doc_id ORDER BY dev, place), signal, dev FROM evidence WHERE NOT held)
SELECT doc_id, side, rank::INTEGER AS rank, signal, round(dev + 1e-10, 6) AS dev FROM ranked WHERE rank <= 4""",
    "index_score": f"""WITH {SIGNALS},
sums AS (SELECT doc_id, {_MEAN} AS logit FROM evidence GROUP BY doc_id),
d AS (SELECT *, 1 / (1 + exp(-1.55 * logit)) AS idx, CASE WHEN lines > 0 THEN items / lines ELSE 0 END AS list_rate, words / greatest(para_lens, 1) AS per FROM sums JOIN wide USING (doc_id)),
r AS (SELECT *, (list_rate > 0.3)::INT + (per < 12 AND paras > 8)::INT + (tiny > 0.42)::INT + (open_ended > 0.5)::INT AS reasons, list_rate > 0.6 OR (per < 8 AND paras > 12) AS over FROM d)
SELECT doc_id, code, words::BIGINT AS words, round(logit, 6) AS logit, round(idx, 6) AS index, floor(idx * 100 + 0.5)::INTEGER AS percent,
  round(least(0.5, greatest(0.035, 0.52 / sqrt(1 + words / 220.0) + 0.035)), 6) AS half,
  CASE WHEN idx < 0.28 THEN 'Consistent with human authorship' WHEN idx < 0.45 THEN 'Leans human' WHEN idx < 0.58 THEN 'Indeterminate'
    WHEN idx < 0.75 THEN 'Leans machine-assisted' ELSE 'Consistent with machine generation' END AS band,
  CASE WHEN words < 120 THEN 'insufficient' WHEN words < 350 THEN 'low' WHEN words < 1200 THEN 'moderate' ELSE 'high' END AS reliability, NOT (reasons >= 2 OR over) AS prose FROM r""",
}

# ---- reports and pages -----------------------------------------------------------------------

_INDEX = SQL["index_score"]
_NOTED = """CASE WHEN signal = 'zipfDev' THEN 'needs 600+ words to fit a rank–frequency slope' WHEN signal = 'rep5' THEN 'needs 300+ words before repetition means anything'
  WHEN signal = 'gradeSd' THEN 'needs 3+ paragraphs of 25 words or more' WHEN signal IN ('paraCv', 'paraSentCv') THEN 'needs 3+ paragraphs' WHEN signal = 'doubleSpace' THEN 'needs 20+ sentence-ending periods'
  WHEN signal IN ('sentKurt', 'sentSkew') THEN 'needs 12+ sentences' WHEN signal = 'flatRun' THEN 'needs 8+ sentences' WHEN signal IN ('hapax', 'yulesK') THEN 'needs 200+ words'
  WHEN signal = 'listRate' THEN 'needs 6+ lines' WHEN code = 'es' THEN 'Spanish has no optional contractions to count'
  WHEN code = 'pt' THEN 'Portuguese contractions are grammatically mandatory' ELSE 'French elision is mandatory, not a style choice' END"""
#: Tokens of a page: comments, tags with quoted values, declarations, texts; windows over them tell what is left out and what is open.
_MARKUP = r"""(?s)<!--(?:-?>|.*?--!?>|.*$)|</?[a-zA-Z][^\s/>]*(?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=)*>|<[!?][^>]*>|</[^a-zA-Z>][^>]*>|</>|[^<]+|<"""
_REFERENCE = "(?s)&(?:#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[a-zA-Z][a-zA-Z0-9]*;|(?:" + "|".join(sorted((n for n in html5 if n[-1] != ";"), key=lambda n: (-len(n), n))) + "))|[^&]+|&"
_HIDES = ("script", "style", "noscript", "svg", "head", "template")
_P = "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
_OPEN = {
    "p": (_P, "true"), "li": (("li", "ul", "ol", "menu"), "tag IN ('li', '/ul', '/ol', '/menu')"),
    "tr": (("tr", "table", "tbody", "thead", "tfoot"), "tag IN ('tr', '/table', 'tbody', '/tbody', 'thead', '/thead', 'tfoot', '/tfoot')"),
}
_WINDOWS = {i: bytes([i]).decode("cp1252", "ignore") for i in range(128, 160)}
PAGES = f"""keyed AS (SELECT row_number() OVER () AS r, page_id, translate(regexp_replace(html, '\\r\\n?', chr(10), 'g'), chr(1) || chr(2), '') AS html FROM pages),
cut AS (SELECT r, unnest(ts) AS tok, generate_subscripts(ts, 1) AS i FROM (SELECT r, {_all("html", _MARKUP)} AS ts FROM keyed)),
named AS (SELECT *, lower(regexp_extract(tok, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS name, starts_with(tok, '</') AS closing FROM cut),
{", ".join(f"""h_{h} AS (SELECT r, i, max(CASE WHEN name = '{h}' AND closing THEN i END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto,
  name = '{h}' AND NOT closing AND NOT (name = 'svg' AND tok LIKE '%/>') AS opens FROM named),
in_{h} AS (SELECT r, i FROM (SELECT *, min(CASE WHEN opens THEN i END) OVER (PARTITION BY r, upto) AS since FROM h_{h}) WHERE i >= since)""" for h in _HIDES)},
shown AS (SELECT r, i, tok, name, CASE WHEN closing THEN '/' ELSE '' END || name AS tag FROM named
  WHERE {" AND ".join(f"(r, i) NOT IN (SELECT (r, i) FROM in_{h})" for h in _HIDES)}),
{", ".join(f"""e_{k} AS (SELECT r, i FROM (SELECT r, i, tag, lag(tag) OVER (PARTITION BY r ORDER BY i) AS prior FROM shown WHERE name IN ({", ".join(map(_q, among))}))
  WHERE prior = '{k}' AND tag <> '/{k}' AND {closes})""" for k, (among, closes) in _OPEN.items())},
bare AS (SELECT r, string_agg(CASE WHEN tok[1] <> '<' OR tok = '<' THEN tok
  ELSE CASE WHEN {" OR ".join(f"(r, i) IN (SELECT (r, i) FROM e_{k})" for k in _OPEN)} THEN chr(10) || chr(10) ELSE '' END
    || CASE WHEN name = 'br' OR tag IN ({", ".join(_q("/" + b) for b in "p div li h1 h2 h3 h4 h5 h6 tr section article blockquote".split())}) THEN chr(10) || chr(10) ELSE '' END END, '' ORDER BY i) AS text
  FROM shown GROUP BY r),
refs AS (SELECT r, unnest(ps) AS ref, generate_subscripts(ps, 1) AS i FROM (SELECT r, {_all("text", _REFERENCE)} AS ps FROM bare)),
codes AS (SELECT *, CASE WHEN regexp_matches(ref, '^&#[xX]') THEN list_reduce(list_prepend(0::HUGEINT, [(strpos('0123456789abcdef', c) - 1)::HUGEINT FOR c IN string_split(left(ltrim(lower(regexp_extract(ref, '^&#[xX]([0-9a-fA-F]+)', 1)), '0'), 9), '') IF c <> '']), lambda a, d: a * 16 + d)
  WHEN starts_with(ref, '&#') THEN try_cast(regexp_extract(ref, '[0-9]+') AS HUGEINT) END AS code, starts_with(ref, '&#') AS numbered FROM refs),
names AS (SELECT '&' || term AS ref, made FROM (VALUES {", ".join(f"({_q(n)}, {_q(c)})" for n, c in html5.items())}) AS n(term, made)),
moved AS (SELECT code::HUGEINT AS code, made FROM (VALUES {", ".join(f"({i}, {_q(c)})" for i, c in _WINDOWS.items() if c)}) AS m(code, made)),
made AS (SELECT r, string_agg(CASE WHEN NOT numbered THEN coalesce(names.made, codes.ref) WHEN moved.made IS NOT NULL THEN moved.made
  WHEN code IS NULL OR code <= 0 OR code >= 1114112 OR code BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(code::INTEGER) END, '' ORDER BY i) AS text
  FROM codes LEFT JOIN names USING (ref) LEFT JOIN moved USING (code) GROUP BY r)"""
_LEGIBLE = _all("substr(text, 1, 20000)", "[A-Za-z0-9.,;:'\"()" + chr(92) + "-?!]|" + SPACE)
SQL |= {
    "plain_reading": f"""WITH scores AS ({_INDEX})
SELECT doc_id, percent, 100 - percent AS human_percent, floor(greatest(0, index - half) * 100 + 0.5)::INTEGER AS low, floor(least(1, index + half) * 100 + 0.5)::INTEGER AS high,
  CASE WHEN percent < 28 THEN 'This reads like a person wrote it.' WHEN percent < 45 THEN 'This leans human, with some passages that read machine-like.'
    WHEN percent < 58 THEN 'This could go either way. The bench genuinely cannot tell.' WHEN percent < 75 THEN 'This leans machine-written, probably with human editing on top.'
    ELSE 'This reads like a machine wrote it.' END AS verdict,
  CASE reliability WHEN 'insufficient' THEN 'The sample is far too short to mean anything. Treat it as noise.' WHEN 'low' THEN 'The sample is short, so the number could easily be 20 points either way.'
    WHEN 'moderate' THEN 'Enough text for a direction, not a verdict.' ELSE 'The sample is long enough for the measurements to settle.' END AS trust,
  CASE reliability WHEN 'insufficient' THEN 'Insufficient sample' WHEN 'low' THEN 'Low confidence' WHEN 'moderate' THEN 'Moderate confidence' ELSE 'Best available confidence' END AS confidence FROM scores""",
    "held_signals": f"WITH {SIGNALS}\nSELECT doc_id, signal, {_NOTED} AS reason FROM evidence WHERE held",
    "ladder": f"""WITH {SIGNALS}
SELECT doc_id, signal, round((evidence + 2.5) / 5 * 100 + 1e-10, 6) AS position, abs(evidence) > 1 AS strong, round(center - spread, 6) AS low, round(center + spread, 6) AS high,
  CASE WHEN held THEN 'held' WHEN dev >= 0 THEN 'machine' ELSE 'human' END AS toward
FROM evidence JOIN (SELECT code, signal, center, spread FROM (VALUES {", ".join(_SPEC_ROWS)}) AS b(code, signal, place, family, center, spread, dir, w)) USING (code, signal)""",
    "document_stats": f"""WITH {SIGNALS}
SELECT doc_id, code, length(text) AS chars, words::BIGINT AS words, types, sentences, paras, syll::BIGINT AS syll, round({_EASE} + 1e-10, 6) AS flesch, round(slope + 1e-10, 6) AS "zipfSlope",
  round(mu + 1e-10, 6) AS "surpMean", round(sigma + 1e-10, 6) AS "surpSd", round(mean + 1e-10, 6) AS "sentMean" FROM wide JOIN (SELECT doc_id, text FROM scored) USING (doc_id)""",
    "shape_reasons": f"""WITH {SIGNALS},
d AS (SELECT *, CASE WHEN lines > 0 THEN items / lines ELSE 0 END AS list_rate, words / greatest(para_lens, 1) AS per FROM wide)
SELECT doc_id, place::INTEGER AS place, reason FROM (SELECT doc_id, unnest(range(4)) AS place, unnest([
  CASE WHEN list_rate > 0.3 THEN floor(list_rate * 100 + 0.5)::INTEGER || '% of lines are bulleted or numbered' END,
  CASE WHEN per < 12 AND paras > 8 THEN 'paragraphs average only ' || floor(per + 0.5)::INTEGER || ' words' END,
  CASE WHEN tiny > 0.42 THEN floor(tiny * 100 + 0.5)::INTEGER || '% of sentences are under six words' END,
  CASE WHEN open_ended > 0.5 THEN floor(open_ended * 100 + 0.5)::INTEGER || '% of lines end without punctuation' END]) AS reason FROM d) WHERE reason IS NOT NULL""",
    "corpus_rollup": f"""WITH scores AS ({_INDEX}), origins AS (SELECT doc_id, min(source) AS source FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT grouping_id(code, source)::INTEGER AS level, code, source, count(*) AS documents, sum(words)::BIGINT AS words, round(avg(index) + 1e-10, 6) AS index FROM scores JOIN origins USING (doc_id) GROUP BY ROLLUP (code, source)""",
    "paragraphs": f"""WITH {DETECTED},
blocks AS (SELECT doc_id, CASE WHEN len(b) < 3 AND contains(text, chr(10)) THEN {_BLOCKS(chr(92) + "n+")} ELSE b END AS ps
  FROM (SELECT *, {_BLOCKS(chr(92) + "n[ " + chr(92) + "t]*" + chr(92) + "n+")} AS b FROM scored))
SELECT doc_id, (i - 1)::INTEGER AS para_idx, len({_all("para", WORD)})::INTEGER AS words, para FROM (SELECT doc_id, unnest(ps) AS para, generate_subscripts(ps, 1) AS i FROM blocks)""",
    "plate_pages": f"""WITH {SENTENCES},
paged AS (SELECT doc_id, sent_idx, sent_idx // 260 AS page, nl, row_number() OVER (PARTITION BY doc_id, sent_idx // 260 ORDER BY sent_idx) AS r FROM sents),
told AS (SELECT *, sum((nl >= 2 AND r > 1)::INT) OVER (PARTITION BY doc_id, page ORDER BY sent_idx) AS block FROM paged)
SELECT doc_id, page::BIGINT AS page, block::BIGINT AS block, count(*) AS sentences FROM told GROUP BY ALL""",
    "page_texts": f"""WITH {PAGES},
text AS (SELECT page_id, CASE WHEN html IS NOT NULL THEN regexp_replace(regexp_replace(coalesce(text, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), {_q("^" + SPACE + "+|" + SPACE + "+$")}, '', 'g') END AS text
  FROM keyed LEFT JOIN made USING (r))
SELECT page_id, text, round(CASE WHEN text <> '' THEN len({_LEGIBLE}) / length(substr(text, 1, 20000)) ELSE 0 END + 1e-10, 6) AS legible,
  length(regexp_replace(coalesce(text, ''), {_q(SPACE)}, '', 'g')) >= 40 AS enough FROM text""",
}

# ---- what is said of documents, sentences and signals ------------------------------------------


def _dec(x: str, places: int) -> str:
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || printf('%.{places}f', round(abs({x}) + 1e-10, {places})))"


def _plus(x: str, places: int) -> str:
    return f"(CASE WHEN {x} >= 0 THEN '+' ELSE '' END || {_dec(x, places)})"


def _fmt(x: str) -> str:
    return f"(CASE WHEN abs({x}) >= 100 THEN {_dec(x, 0)} WHEN abs({x}) >= 10 THEN {_dec(x, 1)} WHEN abs({x}) >= 1 THEN {_dec(x, 2)} ELSE {_dec(x, 3)} END)"


_SPELLED = [[x.strip() for x in line.split(";")] for line in G.LABELS.strip().splitlines()]
_TOLD = f"""rungs AS (SELECT doc_id, code, signal, place, label, unit, held, weight, round(value + 1e-10, 6) AS value, round(dev + 1e-10, 6) AS dev, round(center - spread, 6) AS lo, round(center + spread, 6) AS hi
  FROM (SELECT doc_id, code, signal, value, dev, held, weight FROM evidence) JOIN (VALUES {", ".join(_SPEC_ROWS)}) AS b(code, signal, place, family, center, spread, dir, w) USING (code, signal)
  JOIN (VALUES {", ".join(f"({_q(a)}, {_q(b)}, {_q(c)})" for a, b, c in _SPELLED)}) AS l(signal, label, unit) USING (signal)),
bands AS (SELECT *, {_fmt("lo")} || '–' || {_fmt("hi")} AS band FROM rungs)"""
_EASES = "CASE code WHEN 'en' THEN 'Flesch reading ease' WHEN 'es' THEN 'Fernández Huerta' WHEN 'pt' THEN 'Fernández Huerta (adapted)' ELSE 'Kandel–Moles' END"
_PACKS = "(VALUES ('en', 'English', 'English', 'primary', 'Flesch reading ease'), ('es', 'Spanish', 'Español', 'secondary', 'Fernández Huerta'), ('pt', 'Portuguese', 'Português', 'secondary', 'Fernández Huerta (adapted)'), ('fr', 'French', 'Français', 'secondary', 'Kandel–Moles')) AS packs(code, name, endonym, calibration, readability)"
_TOO_LITTLE = "Too little text to examine. Give it at least a paragraph."
_REFUSED = ("This document appears to be written in ", ", which this bench is not calibrated for. Measuring it against English or Spanish reference bands would produce a confident number that means nothing. Calibrated languages: English, Spanish, Portuguese, French.")
_UNKNOWN = "Could not identify the language of this document with enough confidence to pick reference bands. If you know it is English, Spanish, Portuguese or French, choose it manually and run it again."
_CAVEAT = """CAVEAT: this instrument measures style, not origin. It is not Turnitin, ZeroGPT or
QuillBot and does not reproduce any proprietary classifier. Non-native writers,
edited text, legal boilerplate, translations and short samples all read as more
synthetic than they are. Do not take a decision affecting a person on this output
alone."""


def _marks(column: str, what: str) -> str:
    return f"CASE WHEN {column} > 0 THEN ' · ' || {column}::INTEGER || ' {what} marker' || CASE WHEN {column} > 1 THEN 's' ELSE '' END ELSE '' END"


SQL |= {
    "languages": f"""WITH {LEXICON}
SELECT code, name, endonym, calibration, readability, coalesce(v, 0)::BIGINT AS vocabulary, coalesce(d, 0)::BIGINT AS documents FROM {_PACKS}
  LEFT JOIN (SELECT code, count(*) AS v FROM lexicon GROUP BY code) USING (code) LEFT JOIN (SELECT code, count(*) AS d FROM scored GROUP BY code) USING (code)""",
    "register_totals": f"""WITH hits AS ({SQL["register_hits"]})
SELECT doc_id, count(*) AS markers, sum(c)::BIGINT AS hits FROM hits GROUP BY doc_id""",
    "family_counts": f"WITH {SIGNALS}\nSELECT doc_id, family, count(*) AS signals, count(*) FILTER (WHERE NOT held) AS live FROM evidence GROUP BY ALL",
    "sentence_readout": f"""WITH {FEATURES},
placed AS (SELECT *, avg(surp) OVER w AS mu, coalesce(stddev_samp(surp) OVER w, 0) AS sigma FROM features WINDOW w AS (PARTITION BY doc_id)),
told AS (SELECT *, round(surp - mu + 1e-10, 6) AS delta, round(surp, 6) AS bits, round(least(0.98, greatest(0.02, 0.5 + 0.75 * (
  0.42 * least(2, greatest(-2, CASE WHEN sigma > 0 THEN (mu - surp) / sigma ELSE 0 END)) / 2 + 0.18 * least(1, greatest(-1, 1 - abs(n - 21) / 16))
  + 0.20 * least(1, 0.9 * dm) + 0.28 * least(1, 1.1 * rm) + 0.08 * passive - 0.22 * human))), 6) AS stain FROM placed)
SELECT doc_id, sent_idx::INTEGER AS sent_idx, 'sentence ' || (sent_idx + 1)::INTEGER || ' · ' || n::INTEGER || ' words · surprisal ' || {_dec("bits", 2)} || ' bits · Δ ' || {_plus("delta", 2)}
  || {_marks("dm", "discourse")} || {_marks("rm", "register")} || CASE WHEN passive = 1 THEN ' · passive' ELSE '' END || ' · stain ' || {_dec("stain", 2)} AS readout,
  CASE WHEN stain >= 0.5 THEN 'machine' ELSE 'human' END AS tint, round(least(0.26, round(abs(stain - 0.5), 6) * 0.55) + 1e-10, 3) AS alpha FROM told""",
    "trace_ticks": f"""WITH buckets AS ({SQL["trace_buckets"]}),
ranges AS (SELECT doc_id, 'surp' AS channel, least(9.5, min(surp)) AS a, greatest(11.7, max(surp)) AS b, avg(surp) AS mean FROM buckets GROUP BY doc_id
  UNION ALL SELECT doc_id, 'n', least(11.0, min(n)), greatest(27.0, max(n)), avg(n) FROM buckets GROUP BY doc_id),
padded AS (SELECT doc_id, channel, (a - (b - a) * 0.12)::DOUBLE AS lo, (b + (b - a) * 0.12)::DOUBLE AS hi, mean FROM ranges)
SELECT doc_id, channel, round(lo + 1e-10, 6) AS low, round(hi + 1e-10, 6) AS high, round(mean + 1e-10, 6) AS mean, round(lo + (hi - lo) * 0.12 + 1e-10, 6) AS first_tick, round(hi - (hi - lo) * 0.12 + 1e-10, 6) AS last_tick FROM padded""",
    "ladder_detail": f"""WITH {SIGNALS},
{_TOLD}
SELECT doc_id, signal, CASE WHEN signal = 'flesch' THEN {_EASES} ELSE label END AS label, {_fmt("value")} || CASE WHEN unit <> '' THEN ' ' || unit ELSE '' END AS observed, band,
  CASE WHEN NOT held THEN {_dec("abs(dev)", 2)} || 'σ toward ' || CASE WHEN dev >= 0 THEN 'machine' ELSE 'human' END END AS deviation, CASE WHEN NOT held THEN {_dec("weight", 1)} END AS weight,
  CASE WHEN held THEN {_NOTED} END AS reason FROM bands""",
    "score_all": f"""WITH {DETECTED},
graded AS ({_INDEX}),
d AS (SELECT doc_id, CASE WHEN length(regexp_replace(text, {_q(SPACE)}, '', 'g')) < 40 THEN 'too_little' ELSE status END AS state, {_NAME} AS name, CASE WHEN status = 'ok' THEN round(least(1, score / 0.25), 6) END AS confidence
  FROM detected JOIN texts USING (doc_id))
SELECT doc_id, d.state AS status, CASE d.state WHEN 'too_little' THEN {_q(_TOO_LITTLE)} WHEN 'unsupported' THEN {_q(_REFUSED[0])} || d.name || {_q(_REFUSED[1])} WHEN 'unknown' THEN {_q(_UNKNOWN)} END AS message,
  d.name, true AS detected, d.confidence, s.code, s.words, s.logit, s.index, s.percent, s.half, s.band, s.reliability, s.prose
FROM d LEFT JOIN (SELECT graded.* FROM graded JOIN d USING (doc_id) WHERE state IN ('ok', 'too_short')) s USING (doc_id)""",
    "report_text": f"""WITH {SIGNALS},
{_TOLD},
graded AS ({_INDEX}), reading AS ({SQL["plain_reading"]}), shapes AS ({SQL["shape_reasons"]}), marked AS ({SQL["register_hits"]}), top AS ({SQL["top_grams"]}), fam AS ({SQL["family_scores"]}), counted_all AS ({SQL["document_stats"]}),
why AS (SELECT doc_id, string_agg(reason, ', ' ORDER BY place) AS reasons FROM shapes GROUP BY doc_id),
d AS (SELECT * FROM graded JOIN (SELECT doc_id, human_percent, low, high FROM reading) USING (doc_id) JOIN (SELECT * EXCLUDE (code, words) FROM counted_all) USING (doc_id) LEFT JOIN why USING (doc_id) JOIN {_PACKS} USING (code)),
ladders AS (SELECT doc_id, string_agg('  ' || rpad(label, 30, ' ') || ' ' || lpad({_fmt("value")}, 9, ' ') || ' | ' || band || ' | ' ||
  CASE WHEN held THEN 'held neutral (' || {_NOTED} || ')' ELSE {_plus("dev", 2)} || 'σ' || CASE WHEN dev > 1 THEN '  << machine' WHEN dev < -1 THEN '  << human' ELSE '' END END, chr(10) ORDER BY place) AS t FROM bands GROUP BY doc_id),
families AS (SELECT doc_id, string_agg('  ' || rpad(family, 16, ' ') || ' ' || {_plus("score", 2)}, chr(10) ORDER BY list_position(['Rhythm', 'Predictability', 'Lexicon', 'Register', 'Structure', 'Typography'], family)) AS t FROM fam GROUP BY doc_id),
found AS (SELECT doc_id, chr(10) || chr(10) || 'REGISTER MARKERS FOUND' || chr(10) || string_agg('  ' || c || '× "' || marker || '"', chr(10) ORDER BY rank) AS t FROM marked GROUP BY doc_id),
repeated AS (SELECT doc_id, chr(10) || chr(10) || 'REPEATED 5-GRAMS' || chr(10) || string_agg('  ' || c || '× "' || gram || '"', chr(10) ORDER BY rank) AS t FROM top GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10), 'STYLOMETRIC REPORT', 'specimen: ' || doc_id, '', 'PLAIN READING: ' || human_percent || '% human / ' || percent || '% AI — ' || lower(band),
  CASE WHEN NOT prose THEN chr(10) || '!! DOCUMENT SHAPE WARNING: this is a list or outline, not flowing prose' || chr(10) || '   (' || coalesce(reasons, '') || '). Text shaped like this scores human' || chr(10)
    || '   almost automatically, whoever wrote it. The score above is not usable.' END,
  '', 'MACHINE-STYLE SCORE: ' || percent || '%   (95% CI ' || low || '%–' || high || '%)', 'reading: ' || band, 'sample reliability: ' || reliability,
  'language: ' || name || ' (' || endonym || '), auto-detected' || CASE WHEN calibration = 'secondary' THEN ', reference bands less calibrated than English' ELSE '' END,
  'underlying index: ' || {_dec("index", 3)} || ' on 0–1', '', 'words ' || words || ' · types ' || types || ' · sentences ' || sentences || ' · paragraphs ' || paras,
  'mean sentence ' || {_dec('"sentMean"', 1)} || 'w · surprisal ' || {_dec('"surpMean"', 2)} || '±' || {_dec('"surpSd"', 2)} || ' bits · Zipf slope ' || {_dec('"zipfSlope"', 3)} || ' · ' || readability || ' ' || {_dec("flesch", 1)},
  '', 'FAMILY SCORES  (−1 human … +1 machine)', families.t, '', 'PARAMETERS  observed | human reference band | deviation', ladders.t || coalesce(found.t, '') || coalesce(repeated.t, ''), '', {_q(_CAVEAT)}) AS report
FROM d JOIN families USING (doc_id) JOIN ladders USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN repeated USING (doc_id)""",
}

SQL |= {
    "stream_scores": SQL["score_all"],
    "stream_rollup": f"""WITH told AS ({SQL["score_all"]}), origins AS (SELECT doc_id, min(source) AS source FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)
SELECT grouping_id(code, source)::INTEGER AS level, code, source, count(*) AS documents, sum(words)::BIGINT AS words, round(avg(index) + 1e-10, 6) AS index
FROM told JOIN origins USING (doc_id) WHERE code IS NOT NULL GROUP BY ROLLUP (code, source)""",
}

# These look at all words; `mattr` and `stream_scores` keep the sample, and in the rest the ratio comes into no column.
for _name in ("signals_long", "index_score", "family_scores", "findings_top4", "plain_reading", "ladder", "ladder_detail", "score_all", "report_text", "corpus_rollup", "stream_rollup"):
    SQL[_name] = SQL[_name].replace(_SAMPLED, _EVERY)
