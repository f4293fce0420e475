"""Language identification: held-out accuracy, Viterbi against brute force, spans, and the odd tables."""

import itertools
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from inkgauge.llm import language_id as I

SYLLABLES = {
    "aa": "the ing tion er an of and to in re st ed nd ea th".split(),
    "bb": "der die sch ung ein ich und ge ver keit ß zu lich".split(),
    "cc": "что не на при ого ста ение пр ов ть ли ко".split(),
    "gg": "και το της στη ους ειν δε που με ας".split(),
}


def text(lang, rng, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def corpus(rng, n=240):
    langs = [list(SYLLABLES)[i % 4] for i in range(n)]
    return [(i, text(lang, rng, rng.randrange(3, 60)), lang) for i, lang in enumerate(langs)]


def test_held_out_texts_and_spans(spark):
    rng = random.Random(1)
    rows = corpus(rng)
    odd = [(900, None, None), (901, "", "aa"), (902, "12 ² !? _", "bb"), (None, rows[0][1], "cc"), (903, rows[3][1], None), (903, rows[3][1], None), (904, "漢字", "aa"), (905, "İstanbul " + rows[0][1], "aa")]
    mixed = [text("aa", rng, 40), text("bb", rng, 30), text("cc", rng, 20)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in [*rows, *odd, (950, " | ".join(mixed), "bb")]], "doc_id long, text string, lang string, score int, spans string").repartition(3)
    model = I.train(docs.where(~I.held_out(F.col("doc_id"))))
    assert sorted(model.langs) == sorted(SYLLABLES)
    found = I.label_languages(docs, model)
    got = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == docs.count()
    tested = [(got[i]["lang_pred"], lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(tested) > 50 and sum(a == b for a, b in tested) / len(tested) > 0.97
    for i in (900, 901, 902):
        assert tuple(got[i])[1:] == ("und", 0.0, [])
    assert got[904]["lang_pred"] in SYLLABLES and got[905]["lang_pred"] == "aa" and 0 < got[950]["score"] < 1
    whole = " | ".join(mixed)
    spans = got[950]["spans"]
    assert [(whole[s["start"] : s["end"]], s["lang"]) for s in spans] == list(zip(mixed, ("aa", "bb", "cc")))
    assert got[950]["lang_pred"] == "aa"
    flags = {r[0]: r[1] for r in docs.select("doc_id", I.held_out(F.col("doc_id"))).collect()}
    assert all(flags[i] == (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i in flags)


def test_without_languages_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, "aa")], "doc_id long, text string, lang string")
    model = I.train(docs)
    assert model.langs == [] and {tuple(r)[1:3] for r in I.label_languages(docs, model).collect()} == {("und", 0.0)}
    assert I.label_languages(docs.limit(0), model).count() == 0 and I.train(docs.limit(0)).langs == []


def test_copies_do_not_crowd_the_sample(spark):
    rng = random.Random(2)
    rows = [*corpus(rng, 40), *[(1000 + i, "the ing of", "aa") for i in range(300)]]
    model = I.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=41)
    assert sorted(model.langs) == sorted(SYLLABLES)


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    sizes = np.array([4, 0, 1, 6, 6, 3])
    score = rng.normal(size=(sizes.sum(), 3)) * 2
    got, at = I.viterbi(score, sizes, 1.5), 0
    for n in sizes:
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(score[at + i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:])))
        assert tuple(got[at : at + n]) == best
        at += n


def test_scripts_leave_those_that_use_them():
    rng = random.Random(4)
    lang, bucket, count = [], [], []
    for i, x in enumerate(SYLLABLES):
        ws = text(x, rng, 300).split()
        found = np.concatenate([b for _, b in I.ngrams(ws)] + [-1 - I.script_of(np.array([ord(w[0]) for w in ws]))])
        b, n = np.unique(found, return_counts=True)
        lang += [i] * len(b)
        bucket += b.tolist()
        count += n.tolist()
    model = I.LanguageModel.of_counts(list(SYLLABLES), np.array(lang), np.array(bucket), np.array(count))
    names = list(I.SCRIPTS)
    assert model.uses[names.index("latin")].tolist() == [True, True, False, False] and model.uses[names.index("cyrillic")].tolist() == [False, False, True, False]
    assert model.uses[names.index("han")].all()
    scores = I.Scorer(model).of(["the", "не"])
    assert scores[0].argmax() == 0 and (scores[0, 2:] < -100).all() and scores[1].argmax() == 2


def test_texts_are_labelled_alike_in_small_parts(monkeypatch):
    rng = random.Random(5)
    texts = [t for _, t, _ in corpus(rng, 30)] + ["", "the " * 3000]
    ws = [w for t in texts for w in I.words(t)]
    b, n = np.unique(np.concatenate([b for _, b in I.ngrams(ws)] + [-1 - I.script_of(np.array([ord(w[0]) for w in ws]))]), return_counts=True)
    model = I.LanguageModel.of_counts(["p", "q"], np.tile([0, 1], len(b)), np.repeat(b, 2), np.stack([n, n[::-1]], axis=1).ravel())
    want = I.labelled(texts, I.Scorer(model))
    monkeypatch.setattr(I, "PART_VALUES", 100)
    monkeypatch.setattr(I, "TABLE_ENTRIES", 10)
    assert I.labelled(texts, I.Scorer(model)) == want
