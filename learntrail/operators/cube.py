"""The sparse learner x test case x attempt table, and quality filters on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learntrail.operators.sequence import collapse_last


def item_base(log: DataFrame) -> DataFrame:
    """``question_id, n_tc, first_item``: test cases a question has at most, and the prefix sum of those before it.

    The running sum is over one row a question, after aggregation.
    """
    sizes = log.groupBy("question_id").agg(F.max(F.length("pass")).cast("long").alias("n_tc"))
    return sizes.withColumn("first_item", F.sum("n_tc").over(Window.orderBy("question_id")) - F.col("n_tc"))


def attempt_cube(log: DataFrame, origin: str = "2024-01-01 00:00:00", base: DataFrame | None = None) -> DataFrame:
    """One row for each test result; an absent row is a missing cell. Rows with an empty pass string give none. ``base`` is the log's ``item_base`` if that is made apart."""
    days = F.round((F.unix_micros("ts") - F.unix_micros(F.lit(origin).cast("timestamp"))) / 8.64e10, 6)
    rows = log.join(F.broadcast((item_base(log) if base is None else base).select("question_id", "first_item")), "question_id")  # a row a question, which one window has seen
    rows = rows.select("student_id", "question_id", "first_item", "attempt_id", days.alias("t_days"), "is_exam", "week", F.posexplode(F.split("pass", "")).alias("i", "bit"))
    return rows.where("bit IN ('0', '1')").select("student_id", "question_id", (F.col("first_item") + F.col("i")).alias("item_id"), "attempt_id", F.col("bit").cast("long").alias("y"), "t_days", "is_exam", "week")


def item_quality(obs: DataFrame) -> DataFrame:
    """Pass rate and coverage of each item on the last valid attempt; coverage is against all students seen."""
    last = collapse_last(obs)
    students = obs.select("student_id").distinct().count()
    return last.groupBy("item_id").agg(F.avg("y").alias("pass_rate"), (F.count("*") / F.lit(float(max(students, 1)))).alias("coverage"))


def quality_filter(obs: DataFrame, low: float = 0.1, high: float = 0.9, coverage: float = 0.05) -> DataFrame:
    """Observations of items whose pass rate lies in [low, high] and whose coverage exceeds ``coverage``."""
    kept = item_quality(obs).where((F.col("pass_rate") >= low) & (F.col("pass_rate") <= high) & (F.col("coverage") > coverage))
    return obs.join(kept.select("item_id"), "item_id", "left_semi")
