"""The evaluation harness: stored cells, errors as rows, time limits, runs that go on; and guarded look-ups."""

import time

import pytest
from pyspark.sql import functions as F

from learntrail.operators import harness as H
from learntrail.operators.retrieval import lookup_vectors
from learntrail.operators.sequence import of_courses


@pytest.fixture
def obs(spark):
    rows = [(s, (w - 1) * 2 + i, a, (s * 7 + w * 3 + i + a) % 3 % 2, w + a / 10, w) for s in range(8) for w in (1, 2, 4) for i in range(2) for a in range(2)]
    return spark.createDataFrame(rows, "student_id long, item_id long, attempt_id long, y long, t_days double, week int")


@pytest.fixture
def models(monkeypatch):
    monkeypatch.setattr(H, "REGISTRY", dict(H.REGISTRY))
    calls = []

    @H.model("broken")
    def broken(obs, week):
        raise RuntimeError("no such thing\nsecond line")

    @H.model("counted")
    def counted(obs, week):
        calls.append(week)
        return H.student_mean(obs, week)

    @H.model("slow", minutes=500)
    def slow(obs, week):
        def sleep(batches):
            for b in batches:
                time.sleep(60)
                yield b

        return obs.select("student_id", "item_id", "attempt_id", "y", F.lit(0.5).alias("p")).mapInPandas(sleep, H.PREDICTIONS)

    return calls


def test_cells_are_stored_and_not_run_again(spark, obs, models, tmp_path):
    store = H.Store(spark, str(tmp_path / "store"))
    assert store.predictions().count() == 0 and store.manifests().count() == 0
    courses = {"even": "student_id % 2 = 0", "odd": "student_id % 2 = 1"}
    rows = H.run(store, obs, ["counted", "broken"], courses)
    assert models == [1, 2, 3, 1, 2, 3]
    assert [(r["course"], r["model"], r["horizon"], r["status"]) for r in rows[:3]] == [("even", "counted", 1, "ok"), ("even", "broken", 1, "error"), ("even", "counted", 2, "ok")]
    assert rows[1]["error"] == "RuntimeError: no such thing" and rows[1]["n"] == 0
    again = H.run(store, obs, ["counted", "broken"], courses)
    assert len(models) == 6 and [r for r in again if r["status"] == "ok"] == [r for r in rows if r["status"] == "ok"]
    kept = store.manifests()
    assert {(r.course, r.model, r.horizon, r.status, r.n) for r in kept.collect()} == {(r["course"], r["model"], r["horizon"], r["status"], r["n"]) for r in rows}
    found = store.predictions(["counted"])
    assert found.count() == sum(r["n"] for r in rows) and store.predictions(["broken"]).count() == 0
    measured = {(r.course, r.horizon): r for r in H.metrics(found).collect()}
    assert len(measured) == 6 and measured["odd", 2].n == 4 * 4
    want = obs.where("week > 2 AND student_id % 2 = 1").toPandas().merge(obs.where("week <= 2").toPandas().groupby("student_id").y.mean().rename("p"), on="student_id")
    assert abs(measured["odd", 2].brier - ((want.p - want.y) ** 2).mean()) < 1e-12


def test_a_late_model_is_stopped(spark, obs, models, tmp_path):
    store = H.Store(spark, str(tmp_path / "store"))
    began = time.monotonic()
    rows = H.run(store, obs, ["slow", "student_mean"], horizons=[2], seconds=2)
    assert time.monotonic() - began < 45 and [r["status"] for r in rows] == ["late", "ok"]
    assert H.chosen(["slow", "counted"], most_minutes=60) == [H.REGISTRY["counted"]]


def test_names_and_cutoffs(spark, obs, models):
    with pytest.raises(ValueError, match="unknown models"):
        H.chosen(["elo", "other"])
    assert H.cutoffs(obs) == [1, 2, 3] and H.cutoffs(obs, [0, 2, 4, 9]) == [2] and H.cutoffs(obs.where("week = 1")) == [] and H.cutoffs(obs.limit(0)) == []


@pytest.mark.parametrize("name", ["attempt_mean", "elo", "irt", "cirt", "dirt", "bkt"])
def test_models_predict_each_later_answer(spark, obs, name):
    got = H.REGISTRY[name].fit(obs, 2).collect()
    assert len(got) == obs.where("week > 2").count() and all(0 < r.p < 1 for r in got)


def test_vectors_are_looked_up(spark):
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(99)], "k long, embedding array<float>")
    rows = spark.createDataFrame([(k,) for k in range(100)], "k long")
    found = {r.k: r for r in lookup_vectors(rows, vectors, ["k"]).collect()}
    assert found[5].embedding == [5.0, 1.0] and not found[5].missing and found[99].embedding == [0.0, 0.0] and found[99].missing
    with pytest.raises(ValueError, match="no vector"):
        lookup_vectors(rows, vectors.where("k < 90"), ["k"])
    assert lookup_vectors(rows.limit(0), vectors, ["k"]).count() == 0


def test_unknown_courses_are_an_error(spark):
    log = spark.createDataFrame([(1,), (2,), (2,)], "course_id long")
    assert of_courses(log, [2]).count() == 2
    with pytest.raises(ValueError, match="unknown courses"):
        of_courses(log, [2, 7])
