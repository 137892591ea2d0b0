"""Knowledge tracing's fits, one an item, are spread over tasks though their rows are few; equal sequences share their mastery."""

from pyspark.sql import functions as F

from learntrail.operators import estimators as M

ROWS = [(s, i, a, (s * 7 + i * 3 + a) % 3 % 2, float(i * 3 + a), 1 + i // 10) for s in range(12) for i in range(20) for a in range(1 + (s + i) % 3)]
SCHEMA = "student_id long, item_id long, attempt_id long, y long, t_days double, week int"


def test_fits_are_not_put_together_in_one_task(spark):
    fits = M.bkt_fit(spark.createDataFrame(ROWS, SCHEMA), rounds=2).select("item_id", F.spark_partition_id().alias("task"))
    held = [r.n for r in fits.groupBy("task").agg(F.count("*").alias("n")).collect()]
    assert sum(held) == 20 and len(held) > 4 and max(held) < 10


def test_later_chances_start_from_the_learners_own_mean_mastery(spark):
    obs = spark.createDataFrame(ROWS, SCHEMA)
    train = obs.where("week <= 1")
    params = M.bkt_fit(train).toPandas()
    mastery = {r.student_id: r.m for r in M.bkt_forward(train, M.bkt_fit(train)).groupBy("student_id").agg(F.avg("mastery").alias("m")).collect()}
    guess, slip = params.guess.mean(), params.slip.mean()
    got = M.bkt_later(obs, 1).collect()
    assert len(got) == obs.where("week > 1").count()
    for r in got:
        assert abs(r.p - (mastery[r.student_id] * (1 - slip) + (1 - mastery[r.student_id]) * guess)) < 1e-12
