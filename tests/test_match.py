"""Question matching: short items by containment, inexact ones by ratio, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from learntrail.functions import parsing as P
from learntrail.operators import retrieval as R


def test_containing_finds_items_of_any_length(spark):
    words = [f"word{k}" for k in range(14)]
    items = [(n, " ".join(words[:n])) for n in range(1, 14)] + [(20, "x"), (21, None), (22, "word2  word3 word4")]
    docs = [(1, "go " + " ".join(words)), (2, "un" + " ".join(words[:11]) + "th of it"), (3, "word0"), (4, "aword0 word1s"), (5, None), (6, ""), (7, "word2  word3 word4"), (8, "word2 word3 word4")]
    got = R.containing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((d, i) for d, t in docs for i, q in items if t and q and q in t)


def test_ratio_pairs_against_all_pairs(spark):
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for k, y in enumerate(b):
                new.append(row[k] + 1 if x == y else max(new[k], row[k + 1]))
            row = new
        return 2 * row[-1] / (len(a) + len(b)) if a and b else 0

    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 40))) for _ in range(25)]
    near = ["".join(c if rng.random() > 0.15 else rng.choice(["", "é", c + "z"]) for c in t) for t in base]
    left, right = list(enumerate(near + base[:5] + near[:3] + [""])), list(enumerate([*base, ""]))
    got = {(r[0], r[1]): r[2] for r in R.ratio_pairs(spark.createDataFrame(left, "l long, text string"), spark.createDataFrame(right, "r long, text string"), "l", "r", 0.8).collect()}
    want = {(i, j): slow(a, b) for i, a in left for j, b in right if slow(a, b) >= 0.8}
    assert got == want and any(v < 1 for v in want.values())


def test_questions_are_normalised(spark):
    rows = [("Question text  Write a\n loop. Answer:(penalty regime: 0 %) tail",), ("a b",), ("w " * 200,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(P.question_words(F.col("t"))).collect()]
    assert got == ["Write a loop.", "a b", " ".join(["w"] * 150), None]


def test_distances_in_a_band_equal_those_of_the_whole_table():
    rng = random.Random(5)
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64)
    for k in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(60)))
        b = "".join(rng.choice(["", c, c, c, c + "x"]) for c in a) if k % 5 else "".join(rng.choice("abcé") for _ in range(rng.randrange(60)))
        rows = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, rows[0] = rows[0], i
            for j, y in enumerate(b, 1):
                last, rows[j] = rows[j], min(rows[j] + 1, rows[j - 1] + 1, last + (x != y))
        limit = rng.randrange(50)
        got = R.edit_distance(codes(a), codes(b), limit)
        assert got == rows[-1] if rows[-1] <= limit else got > limit


def test_edit_pairs_compare_few_of_many_unrelated_texts(spark, monkeypatch):
    """Texts of one source and length meet as hashed grams; only near ones are compared in full."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(120)]
    texts += [t[:50] + "zz" + t[53:] for t in texts[:10]]
    compared, whole = [], R.edit_distance
    monkeypatch.setattr(R, "edit_distance", lambda a, b, n: compared.append(1) or whole(a, b, n))
    i, j, _ = R.near_texts(texts, None, 0.1)
    assert {(k, 120 + k) for k in range(10)} <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(compared) < 60
    monkeypatch.setattr(R, "CELL", 16 * 2048)  # several blocks
    df = spark.createDataFrame([(k, t, "g") for k, t in enumerate(texts)], "id long, text string, g string")
    got = {(r.left_id, r.right_id) for r in R.edit_pairs(df, "id", "text", "g").collect()}
    assert got == set(zip(i.tolist(), j.tolist(), strict=True))


def test_nearest_texts_against_all_pairs_and_leave_far_lengths_out(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abc é") for _ in range(n))
    others, texts = [word(rng.randrange(0, 70)) for _ in range(90)] + ["", "ab", "ab"], [word(rng.randrange(0, 120)) for _ in range(60)] + ["", "ab"]
    keys = rng.sample(range(1000), len(others))
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), "<u4").astype(np.uint64)
    want = [min((R.edit_distance(codes(t), codes(o), 200), k) for o, k in zip(others, keys, strict=True)) for t in texts]
    assert R.nearest_texts([*texts, None], others, keys, 8) == [*want, None]
    q = spark.createDataFrame([*enumerate(texts), (500, None)], "q long, s string")
    c = spark.createDataFrame([*zip(keys, others, strict=True), (1001, None)], "k long, s string")
    got = {r.q: (r.distance, r.k) for r in R.best_match(q, c, "q", "k", "s").collect()}
    assert got == {**dict(enumerate(want)), 500: (None, None)}
    assert R.best_match(q, c.limit(0), "q", "k", "s").count() == 0


def test_best_match_edit_takes_every_document(spark, sf_dir):
    from learntrail import plans
    from learntrail.plans.log import table

    got = [r.doc_id for r in plans.queries()["best_match_edit"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(r.doc_id for r in table(spark, sf_dir, "documents").select("doc_id").collect())
