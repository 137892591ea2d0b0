"""Abilities of growing prefixes against separate fits."""

from learntrail import plans
from learntrail.operators import estimators as M
from learntrail.plans.log import observations


def test_each_week_equals_its_own_fit(spark, sf_dir):
    rows = plans.queries()["temporal_ability"](spark, sf_dir).collect()
    o = observations(spark, sf_dir)
    weeks = sorted(r[0] for r in o.select("week").distinct().collect())
    assert sorted({r.week for r in rows}) == weeks and len(weeks) > 3
    for week in (weeks[0], weeks[-1]):
        want = {r.student_id: r.theta for r in M.rasch(o.where(f"week <= {week}").select("student_id", "item_id", "y"))[0].collect()}
        got = {r.student_id: r.theta for r in rows if r.week == week}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9
