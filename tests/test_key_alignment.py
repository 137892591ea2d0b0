"""Key alignment reads the cube once and deals its keys to tasks by the size of the log."""

from learntrail import plans
from learntrail.plans.log import observations


def test_cube_is_read_once(spark, sf_dir):
    found = plans.queries()["key_alignment"](spark, sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "Union" not in plan and plan.count("RepartitionByExpression") == 1


def test_counts_equal_those_of_sets(spark, sf_dir):
    o = observations(spark, sf_dir).select("student_id", "item_id", "attempt_id", "week").collect()
    a, b = ({tuple(r)[:3] for r in o if keep(r.week)} for keep in (lambda w: w <= 4, lambda w: w >= 2))
    (r,) = plans.queries()["key_alignment"](spark, sf_dir).collect()
    assert (r.n, r.shared, r.only_left, r.only_right) == (len(a | b), len(a & b), len(a - b), len(b - a))
