"""Parsing quirks, readers, streams and estimators on literals."""

import json

import numpy as np
from pyspark.sql import functions as F

from learntrail.functions import parsing as P
from learntrail.operators import estimators as M
from learntrail.operators import evaluation as E
from learntrail.sources import readers
from learntrail.streaming import attempts


def column(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"c {kind}").select(expr(F.col("c"))).collect()]


def test_pass_modes(spark):
    values = ["111011", "0110", "110.0", "0.0", "", None]
    assert column(spark, values, lambda c: P.parse_pass(c)) == ["111011", "0110", "110", "0", "", None]
    assert column(spark, values, lambda c: P.parse_pass(c, "no_dots")) == ["111011", "0110", "1100", "00", "", None]
    assert column(spark, values, lambda c: P.parse_pass(c, "head")) == ["111011", "0110", "110", "", "", None]
    assert column(spark, ["1100", "", None], P.pass_fraction) == [0.5, None, None]
    assert column(spark, ["11", "10", "", None], P.is_perfect) == [True, False, False, False]


def test_times_order_by_date_not_text(spark):
    got = column(spark, ["31/01/24, 10:00:00", "01/02/24, 09:00:00", "1/9/23, 9:05:00", "bad", None], P.parse_timestamp)
    assert got[0] < got[1] and got[2].month == 9 and got[3] is None and got[4] is None


def test_unit_tests_round_trip(spark):
    block = "Unittest 0:\nInput: a\nSTD input: b\nOutput: c\n\nUnittest 1:\nInput: d\nSTD input: \nOutput: e"
    assert [[tuple(t) for t in r] for r in column(spark, [block, "Unittest 1: Input: x", ""], P.unit_tests)] == [[("a", "b", "c"), ("d", "", "e")], [], []]
    assert column(spark, [block], lambda c: P.format_unit_tests(P.unit_tests(c))) == [block]


def test_lab_files(spark, tmp_path):
    q = lambda n: {"question": n, "name": n, "template": "t", "max_score": "1", "testcases": []}
    lab = {"lab_name": "L", "list_questions": [q("Question 1"), [q("Question 2.1"), q("Question 2.2")]], "student_answers": [{"name": "A", "id": "7", "review_link": "", "response_history": [{"question": "Question 1", "results": [{"step": "1", "time": "x", "action": "Started", "state": "", "score": ""}, {"step": "2", "time": "y", "action": "Submit: z", "state": "Correct", "score": "1"}]}]}]}
    (tmp_path / "c" / "s").mkdir(parents=True)
    (tmp_path / "c" / "s" / "W3_Lists.json").write_text(json.dumps(lab))
    labs = readers.scan_labs(spark, str(tmp_path))
    assert sorted(r.name for r in readers.lab_questions(labs).collect()) == ["Question 1", "Question 2.1", "Question 2.2"]
    assert [(r.week, r.student_uid, r.action) for r in readers.lab_history(labs).orderBy("position").collect()] == [(3, "7", "Started"), (3, "7", "Submit: z")]


def test_submissions_csv(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3, 4, 0, "t", 0, "Submit", 'a "b",\nc', "0110")], readers.SUBMISSIONS)
    readers.write_submissions(rows, str(tmp_path / "x"))
    assert readers.scan_submissions(spark, str(tmp_path / "x")).collect() == rows.collect()
    assert readers.not_done(rows, rows.limit(0), ["student_id"]).count() == 1


def test_auc_and_tau_with_ties(spark):
    df = spark.createDataFrame([("g", 1, 0.8), ("g", 0, 0.8), ("g", 1, 0.9), ("g", 0, 0.1), ("h", 1, 0.5)], "k string, y int, p double")
    assert {r.k: r.auc for r in E.roc_auc(df, ["k"]).collect()} == {"g": 0.875, "h": None}
    t = spark.createDataFrame([("a", x, y) for x, y in ((1, 1), (2, 3), (3, 2), (3, 4), (5, 5))] + [("b", 1, k) for k in range(5)], "k string, x int, y int")
    got = {r.k: r.tau for r in E.kendall_tau(t, ["k"], "x", "y").collect()}
    assert abs(got["a"] - 7 / (9 * 10) ** 0.5) < 1e-9 and got["b"] is None


def test_rasch_orders_abilities(spark):
    rows = [(s, i, int((s * 7 + i * 3) % 10 < 2 + 2 * s)) for s in range(4) for i in range(8) for _ in range(3)]
    ability, item = M.rasch(spark.createDataFrame(rows, "student_id long, item_id long, y long"))
    theta = {r.student_id: r.theta for r in ability.collect()}
    assert theta[0] < theta[1] < theta[2] < theta[3] and item.count() == 8
    assert M.predict(spark.createDataFrame(rows, "student_id long, item_id long, y long"), ability, item).where("p > 0 AND p < 1").count() == 32


def test_trend_model_reaches_the_joint_optimum(spark):
    rng = np.random.default_rng(2)
    start, slope, level = np.array([-1.0, 0.0, 1.0]), np.array([2.0, 0.0, -2.0]), np.array([-0.5, 0.0, 0.5, 1.0])
    rows = [(a, b, t, int(rng.random() < 1 / (1 + np.exp(-(start[a] + slope[a] * t + level[b]))))) for a in range(3) for b in range(4) for t in np.linspace(0, 1, 30).tolist()]
    trend, own = M.trend_model(spark.createDataFrame([*rows, (0, None, 0.5, 1)], "a long, b long, t double, y int"), "a", "b", rounds=8)
    u, w = {r.a: (r.start, r.slope) for r in trend.collect()}, {r.b: r.level for r in own.collect()}
    assert u[0][1] > 0 > u[2][1] and w[0] < w[3]
    x = np.array([[*(a == k for k in range(3)), *(t * (a == k) for k in range(3)), *(b == k for k in range(4))] for a, b, t, _ in rows], float)
    y, best = np.array([r[3] for r in rows]), np.zeros(10)
    for _ in range(30):  # all parameters together
        p = 1 / (1 + np.exp(-x @ best))
        best += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(10), x.T @ (y - p) - best)
    loss = lambda v: np.logaddexp(0, x @ v).sum() - y @ (x @ v) + v @ v / 2
    got = np.array([*(u[k][0] for k in range(3)), *(u[k][1] for k in range(3)), *(w[k] for k in range(4))])
    assert loss(best) - 1e-9 <= loss(got) < loss(best) + 0.1 < loss(np.zeros(10))


def test_streams(spark, sf_dir, tmp_path):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    run = lambda df, name, mode: df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    for df, name, mode in ((attempts.windowed_counts(stream), "counts", "complete"), (attempts.running_rating(attempts.first_attempts(stream).withColumn("y", (F.col("value") > 0).cast("int"))), "ratings", "update")):
        q = run(df, name, mode)
        q.processAllAvailable()
        q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 1000 and spark.table("ratings").agg(F.sum("n")).first()[0] == 1000 and schema


def test_bkt_against_single_sequences(spark):
    rng = __import__("random").Random(1)
    rows = [(1, s, k, int(rng.random() < 0.2 + 0.15 * k)) for s in range(30) for k in range(1 + s % 5)]
    obs = spark.createDataFrame(rows, "item_id long, student_id long, attempt_id long, y long")
    p = M.bkt_fit(obs).first()
    assert all(0.01 <= x <= 0.99 for x in p[1:]) and p.learn > 0.1
    got = {r.student_id: r.mastery for r in M.bkt_forward(obs, M.bkt_fit(obs)).collect()}
    for s in range(30):
        known = p.known
        for y in [r[3] for r in rows if r[1] == s]:
            right = known * (1 - p.slip) + (1 - known) * p.guess
            post = known * (1 - p.slip) / right if y else known * p.slip / (1 - right)
            known = post + (1 - post) * p.learn
        assert abs(got[s] - known) < 1e-9
