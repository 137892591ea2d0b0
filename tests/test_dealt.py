"""Estimators' steps add up a learner's rows where they lie: nothing but sums by item is shuffled."""

import pytest

from learntrail.operators import estimators as M

ROWS = [(w, s, i, 3, (s + i + w) % 4) for w in (1, 2) for s in range(40) for i in range(6)]


@pytest.fixture
def step_plans(spark, monkeypatch):
    """The plans of an estimator's steps, as for tables that are too large to be copied unasked."""
    plans, plain = [], M.checkpointed

    def recorded(df):
        out = plain(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(M, "checkpointed", recorded)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield plans
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def shuffles_by_learner(plan):
    """How often a finished plan shuffles by learner; the dealing itself is asked for and not counted."""
    done = plan.split("\n+- == Initial Plan ==")[0]
    return sum("Exchange hashpartitioning(" in x and "student_id" in x and "ENSURE_REQUIREMENTS" in x for x in done.splitlines())


def test_response_steps_leave_learners_rows_where_they_lie(spark, step_plans):
    df = spark.createDataFrame(ROWS, "upto long, student_id long, item_id long, n long, right long")
    M.rasch(df.where("upto = 1").drop("upto"), rounds=2)
    assert len(step_plans) >= 4 and max(map(shuffles_by_learner, step_plans)) <= 1  # the abilities, a row a learner, go to their answers


def test_each_key_has_a_fit_of_its_own(spark):
    df = spark.createDataFrame(ROWS + [(2, 1, 1, 2, 2)], "upto long, student_id long, item_id long, n long, right long")
    ability, item = M.rasch(df, by=("upto",))
    for w in (1, 2):
        own, its = M.rasch(df.where(f"upto = {w}").drop("upto"))
        for whole, part, key in ((ability, own, "student_id"), (item, its, "item_id")):
            got, want = ({r[key]: r[-1] for r in x.collect()} for x in (whole.where(f"upto = {w}"), part))
            assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


@pytest.mark.parametrize("trend_on, level_on", [("item_id", "student_id"), ("student_id", "item_id")])
def test_trend_steps_leave_learners_rows_where_they_lie(spark, step_plans, trend_on, level_on):
    df = spark.createDataFrame([(s, i, (s + i) % 2, k / 2) for _, s, i, _, k in ROWS if k < 3], "student_id long, item_id long, y long, t double")
    M.trend_model(df, trend_on, level_on, rounds=2, **({"many": "student_id"} if "student_id" == trend_on else {}))
    assert len(step_plans) >= 4 and max(map(shuffles_by_learner, step_plans)) <= 1
