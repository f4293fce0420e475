import random

from inkgauge.llm.jaccard_join import Bands, jaccard_components, keep_one_of_each, shingle_set, signatures


def brute(rows, percent=80):
    def made(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [made(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i in range(len(rows)):
        ids = [k for k in groups[find(i)] if k is not None]
        out.append((rows[i][0], len(sets[i]), min(ids) if ids else None))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    rows, passage = [], " ".join(f"p{i}" for i in range(40))
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 3, 5, 8, 15, 30, 60, 200]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(words)
            for _ in range(rng.randrange(0, 1 + len(copy) // 25 + 1)):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows) + 100, " ".join(copy) + (" " + passage if rng.random() < 0.3 else "")))
    rng.shuffle(rows)
    return rows + [(7, None), (8, ""), (9, " \t"), (None, rows[0][1]), (None, "alone here"), rows[3], (rows[4][0], "same key, other text")]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id long, text string, c int")
        found = sorted([tuple(r) for r in jaccard_components(docs).collect()], key=str)
        assert found == brute(rows)


def test_similar_sets_share_a_signature():
    rng = random.Random(5)
    bands = Bands()
    for n in (5, 9, 14, 20, 27, 40, 90, 300, 2000):
        for _ in range(30):
            base = shingle_set(" ".join(str(rng.random()) for _ in range(n + 4)))
            drop = rng.randrange(0, n // 9 + 1)
            extra = shingle_set(" ".join(str(rng.random()) for _ in range(drop + 4)))[:drop]
            other = sorted(set(base[drop:].tolist()) | set(extra.tolist()))
            import numpy as np

            other = np.array(other, np.uint64)
            common = len(set(base.tolist()) & set(other.tolist()))
            if 100 * common < 80 * (len(base) + len(other) - common) or drop == 0:
                continue
            assert set(signatures(base, bands)[0].tolist()) & set(signatures(other, bands)[0].tolist())


def test_empty_table_and_kept_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(docs).collect() == []
    rows = [(1, "a b c d e f", "x"), (2, "A B c d e f", "y"), (3, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    assert sorted(r["root"] for r in keep_one_of_each(docs).collect()) == ["x", "z"]


def test_one_row_of_each_component_stays(spark):
    text = " ".join(f"w{i}" for i in range(40))
    near, clean, lone = text + " more", "quite another text of its own", "nothing like this has a key"
    rows = [(1, text), (1, text), (2, near), (2, clean), (3, clean + "!"), (None, near), (None, lone), (None, lone), (4, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, row string")
    got = keep_one_of_each(docs)
    assert got.columns == docs.columns
    want = [(1, text), (2, clean), (3, clean + "!"), (None, lone), (4, None), (4, None), (5, "")]
    assert sorted([(r["doc_id"], r["text"]) for r in got.collect()], key=str) == sorted(want, key=str)
    assert keep_one_of_each(docs.limit(0)).count() == 0
