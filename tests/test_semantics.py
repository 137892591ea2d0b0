"""Operators without SQL against brute force, and parsers on literals."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from learntrail.functions import parsing as P
from learntrail.operators import estimators as M
from learntrail.operators import evaluation as E
from learntrail.operators import retrieval as R
from learntrail.operators import sequence as S
from learntrail.sources import readers


def test_unit_test_blocks_in_the_form_of_the_files(spark):
    block = "Unittest 0:\nInput: cout << f(3);\nSTD input: 1 2\n3\nOutput: 6\n\nUnittest 1:\nInput: g();\nSTD input: \nOutput: Input: x"
    rows = [(1, block), (2, "Unittest 0:\nInput: a\nOutput: b"), (3, ""), (4, None), (5, "no block")]
    df = spark.createDataFrame(rows, "id long, t string").select("id", P.unit_tests(F.col("t")).alias("u"))
    got = {r.id: r.u and [tuple(x) for x in r.u] for r in df.collect()}
    assert got[1][0] == ("cout << f(3);", "1 2\n3", "6") and got[1][1] == ("g();", "", "Input: x") and got[2] == [] and got[3] == [] and got[5] == []
    again = df.where("id = 1").select(P.format_unit_tests(F.col("u")).alias("t")).first().t
    assert again == block


def test_topics_sections_courses_and_durations(spark):
    rows = [("Exam_L03", "L03"), ("Pointer_Basic_Inlab", "CC12"), ("ClassString_Postlab", "cn1"), ("A_Inlab_Postlab", "DT_9"), ("List", "LCC"), (None, None)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "t string, s string").select(P.normalize_topic(F.col("t")), P.section_type(F.col("s"))).collect()]
    assert got == [("Exam", "Regular"), ("Pointer Basic", "Credit-Constrained"), ("ClassString", "Compact"), ("A Inlab", "Deferred/Repeat"), ("List", "Regular"), (None, "Regular")]
    rows = [("pf_hk232", 5.0), ("DSA_HK221", 59.4), ("xx_hk231_a", 61.0), ("abc_d", 7200.0)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "c string, s double").select(P.course_label(F.col("c")), P.duration(F.col("s"))).collect()]
    assert got == [("Programming Fundamentals (Spring 2023)", "5 seconds"), ("Data Structures \\& Algorithms (Fall 2022)", "59 seconds"), ("XX (Fall 2023)", "1.0 minutes"), ("ABC", "2.0 hours")]
    assert spark.range(1).select(P.escape_latex(F.lit("a_b & 5% $x #~^"))).first()[0] == r"a\_b \& 5\% \$x \#\textasciitilde{}\textasciicircum{}"


def test_jumps_within_ten_minutes(spark):
    rows = [(1, 1, 1, "2024-01-01 10:00:00", "aaaaaaaaaa"), (2, 1, 1, "2024-01-01 10:09:59", "bbbbbbbbbb"), (3, 1, 1, "2024-01-01 10:19:59", "cccccccccc"), (4, 1, 1, "2024-01-01 10:20:10", "cccccccccx"), (5, 2, 1, "2024-01-01 10:20:11", "zzz"), (6, 2, 1, "2024-01-01 10:20:12", None)]
    df = spark.createDataFrame(rows, "row_id long, student_id long, question_id long, t string, response string").withColumn("ts", F.col("t").cast("timestamp"))
    assert [(r.row_id, r.edit_fraction) for r in S.jumps(df).collect()] == [(2, 1.0)]
    assert {r.row_id for r in S.jumps(df, 0.05, 3600).collect()} == {2, 3, 4}


def test_edits_by_keys_of_texts_equal_those_of_the_texts(spark):
    texts = [(1, "abcdef"), (2, "abxdef"), (3, None), (4, "")]
    rows = [(k, k % 3, 1, f"2024-01-01 10:{k:02d}:00", [1, 2, 0, 4, 0, 0, 3][k * (k + 1) // 2 % 7]) for k in range(40)]
    log = spark.createDataFrame(rows, "row_id long, student_id long, question_id long, t string, key long").withColumn("ts", F.col("t").cast("timestamp"))
    words = spark.createDataFrame(texts, "key long, text string")
    plain = log.join(words.withColumnRenamed("text", "response"), "key")
    shown = lambda df, c: sorted((r.row_id, r[c]) for r in df.collect() if r[c] is not None)
    got = S.edit_lag(log, "key", texts=words)
    assert got.count() == log.count() and shown(got, "edit_distance") == shown(S.edit_lag(plain), "edit_distance") != []
    assert shown(S.jumps(log, 0.1, 3600, "key", texts=words), "edit_fraction") == shown(S.jumps(plain, 0.1, 3600), "edit_fraction") != []


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_pairs_and_the_greedy_filter_against_brute_force(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(5, 90))) for _ in range(12)]
    rows = []
    for k in range(90):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(0, 1 + len(text) // 8)):
            text[rng.randrange(len(text))] = rng.choice("abcdz")
        rows.append((k, "".join(text), f"g{k % 2}"))
    rows += [(200, None, "g0"), (201, "", "g0"), (202, rows[0][1], "g0"), (203, "x", None)]
    df = spark.createDataFrame(rows, "id long, text string, g string")
    classes = R.text_classes(df, "id", "text", "g")
    cls = {r.id: r.class_id for r in classes.collect()}
    assert cls[202] == 0 and cls[0] == 0 and 203 not in cls
    firsts = [(k, t, g) for k, t, g in rows if cls.get(k) == k and t]
    want = {(a, b): levenshtein(x, y) for a, x, g in firsts for b, y, h in firsts if a < b and g == h and levenshtein(x, y) <= 0.1 * max(len(x), len(y))}
    edges = R.edit_pairs(df.join(classes.where("id = class_id").select("id"), "id", "left_semi"), "id", "text", "g")
    got = {(r.left_id, r.right_id): r.distance for r in edges.collect()}
    assert got == want and len(want) > 20
    nodes = sorted(k for k, _, _ in firsts)
    accepted = []
    for k in nodes:
        if not any((a, k) in want for a in accepted):
            accepted.append(k)
    found = R.greedy_accepted(spark.createDataFrame([(k,) for k in nodes], "id long"), edges.select(F.col("left_id").alias("u"), F.col("right_id").alias("v")))
    assert sorted(r.id for r in found.collect()) == accepted


def test_ordered_means_add_up_in_order_whatever_the_partitions(spark):
    rows = [(g, k, rng.randrange(8) / 7) for rng in [random.Random(8)] for g in range(40) for k in range(25)] + [(0, 99, None), (77, 0, None)]
    want = {}
    for g in range(40):
        total = 0.0
        for own, _, v in rows:
            total += v if own == g and v is not None else 0.0
        want[g] = total / 25
    want[77] = None
    shuffled = rows[:]
    random.Random(9).shuffle(shuffled)
    for parts in (1, 7):
        df = spark.createDataFrame(shuffled, "g long, k long, v double").repartition(parts)
        assert {r.g: r.m for r in df.groupBy("g").agg(E.ordered_mean("v", "k").alias("m")).collect()} == want


def test_ranked_numbers_all_rows_and_sums_what_is_before(spark):
    rows = [(k * 7919 % 1000, float(k % 5)) for k in range(1000)]
    got = S.ranked(spark.createDataFrame(rows, "k long, v double").repartition(7), F.col("k").desc(), total="v").collect()
    before, want = 0.0, {}
    for n, (k, v) in enumerate(sorted(rows, reverse=True)):
        want[k] = (n, before, 1000)
        before += v
    assert {r.k: (r._rank, r._before, r._rows) for r in got} == want
    assert S.ranked(spark.createDataFrame([], "k long"), F.col("k")).count() == 0


def test_whole_auc_with_ties(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), rng.randrange(30) / 10) for _ in range(500)]
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert abs(E.whole_auc(spark.createDataFrame(rows, "y int, p double")).first().auc - want) < 1e-12


def test_bootstrap_of_metrics_against_resampled_rows(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 800)
    p = np.round(np.clip(0.5 + 0.2 * (y - 0.5) + rng.normal(0, 0.25, 800), 0, 1), 3)
    df = spark.createDataFrame([("a", int(a), float(b)) for a, b in zip(y, p)] + [("one", 1, 0.7)] * 9 + [("one", None, 0.5)], "k string, y int, p double")
    got = {(r.k, r.metric): r for r in E.bootstrap_metrics(df, ["k"]).collect()}
    values = {"balanced_accuracy": [], "auc": [], "f1": []}
    for _ in range(500):
        at = rng.integers(0, 800, 800)
        a, b = y[at], p[at]
        hit = b >= 0.5
        values["balanced_accuracy"].append((hit[a == 1].mean() + (~hit)[a == 0].mean()) / 2)
        values["f1"].append(2 * (hit & (a == 1)).sum() / (hit.sum() + a.sum()))
        n, m = np.sort(b[a == 0]), b[a == 1]
        values["auc"].append((np.searchsorted(n, m, "left") + np.searchsorted(n, m, "right")).mean() / 2 / len(n))
    for name, x in values.items():
        r, width = got["a", name], np.quantile(x, 0.975) - np.quantile(x, 0.025)
        assert abs(r.mean - np.mean(x)) < 0.1 * width and abs((r.high - r.low) - width) < 0.2 * width
    assert got["one", "auc"].mean is None and got["one", "balanced_accuracy"].mean is None


def test_bootstrap_of_means_draws_anew_in_every_batch(spark):
    rows = [(1, float(k % 2)) for k in range(4000)]  # alike in every batch
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    r = E.bootstrap_mean(spark.createDataFrame(rows, "k int, v double").repartition(4), ["k"], "v", 1000).first()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    theory = 2 * 1.96 * 0.5 / math.sqrt(4000)
    assert abs((r.high - r.low) / theory - 1) < 0.15


def test_calibrated_learners_against_plain_newton(spark):
    rng = np.random.default_rng(7)
    rows = [(s, int(rng.random() < 0.6), float(rng.random()), float(rng.normal())) for s in range(6) for _ in range(40)]
    got = {r.student_id: (r.theta, r.growth) for r in M.calibrated(spark.createDataFrame(rows, "student_id long, y int, t double, offset double"), rounds=20, slope=True).collect()}
    for s in range(6):
        own = np.array([r[1:] for r in rows if r[0] == s])
        y, x, o = own[:, 0] * 0.98 + 0.01, np.c_[np.ones(40), own[:, 1]], own[:, 2]
        w = np.zeros(2)
        for _ in range(50):
            q = 1 / (1 + np.exp(-(x @ w + o)))
            w += np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.eye(2), x.T @ (y - q) - w)
        assert np.allclose(got[s], w, atol=1e-6)
    flat = M.calibrated(spark.createDataFrame(rows, "student_id long, y int, t double, offset double"), rounds=15).collect()
    assert all(r.growth == 0 for r in flat)


def test_predictions_of_later_weeks(spark):
    rows = [(s, i, a, int((s + i + a) % 3 > 0), w, float(w)) for s in range(8) for i, w in ((0, 1), (1, 2), (2, 4)) for a in range(3)] + [(99, 2, 0, 1, 4, 4.0)]
    obs = spark.createDataFrame(rows, "student_id long, item_id long, attempt_id long, y long, week long, t_days double")
    got = M.elo_predictions(obs, 3).collect()
    theta = {r.student_id: r.theta for r in M.elo(obs, 3).collect()}
    assert len(got) == 25 and all(abs(r.p - 1 / (1 + math.exp(-theta.get(r.student_id, 0.0)))) < 1e-12 for r in got)
    later = M.bkt_later(obs, 3).collect()
    params = M.bkt_fit(obs.where("week <= 3")).toPandas()
    seen = M.bkt_forward(obs.where("week <= 3"), spark.createDataFrame(params)).toPandas().groupby("student_id").mastery.mean()
    g, s, k = params.guess.mean(), params.slip.mean(), params.known.mean()
    assert all(abs(r.p - (lambda m: m * (1 - s) + (1 - m) * g)(seen.get(r.student_id, k))) < 1e-9 for r in later) and len(later) == 25


def test_json_lines_keep_missing_fields_null(spark, tmp_path):
    path = str(tmp_path / "lines")
    readers.write_lines(spark.createDataFrame([(1, "a\nb", None)], "student_id long, response string, prompt string"), path)
    r = readers.scan_lines(spark, path).first()
    assert (r.student_id, r.response, r.prompt, r.raw_response) == ("1", "a\nb", None, None)


def test_retrieval_ranks_by_cosine_and_leaves_stop_words_out(spark):
    docs = spark.createDataFrame([(0, "the red fox and the dog"), (1, "a red fox"), (2, "the and of"), (3, "blue whale"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: len(r.terms) for r in R.tfidf(docs).collect()} == {0: 3, 1: 2, 3: 2}
    got = [(r.query_id, r.doc_id) for r in R.tfidf_topk(docs, F.col("doc_id") == 0, 5).collect()]
    assert got == [(0, 1)]


def test_searches_over_many_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(R, "QUERY_BLOCK", 3)
    monkeypatch.setattr(R, "DOC_BLOCK", 20)
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(90, 4)), 1)
    x[40:60] = x[:20]  # copies: ties
    rows = [(k, [float(v) for v in row], k % 3) for k, row in enumerate(x)] + [(90, None, 1), (91, [0.0] * 4, 1), (92, [1.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r.vec_id, r["rank"]): (r.other_id, r.cos) for r in R.cosine_topk(v.where("vec_id % 10 = 0"), v, 5).collect()}
    y = np.float32(x).astype(float)
    y /= np.sqrt((y * y).sum(1))[:, None]
    want = {}
    for q in range(0, 90, 10):
        cos = np.round(y[q] @ y.T, 9)
        for n, (c, k) in enumerate(sorted((-c, k) for k, c in enumerate(cos) if k != q)[:5], 1):
            want[q, n] = (k, -c)
    assert {k: d for k, (d, _) in got.items()} == {k: d for k, (d, _) in want.items()} and all(abs(got[k][1] - want[k][1]) < 2e-9 for k in want)
    words = [f"w{chr(97 + k)}x" for k in range(12)]
    docs = spark.createDataFrame([(k, " ".join(rng.choice(words, 6))) for k in range(90)], "doc_id long, text string")
    few = sorted(tuple(r) for r in R.tfidf_topk(docs, F.col("doc_id") % 10 == 0, 5).collect())
    monkeypatch.setattr(R, "DOC_BLOCK", 10_000)
    assert few == sorted(tuple(r) for r in R.tfidf_topk(docs, F.col("doc_id") % 10 == 0, 5).collect()) and len(few) == 45
