"""The attempt log as a view over the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TYPES = ("click", "error", "purchase", "signup")
ORIGIN = "2024-01-01 00:00:00"


def query(sql: str | None = None, log: bool = True):
    """Register a query under its function's name; ``sql`` is its DuckDB form, after the log's common table expressions."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = (f"WITH {LOG_SQL}" + (", " + sql.strip()[5:] if sql.strip().upper().startswith("WITH ") else " " + sql.strip())) if log else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each logged action, in typed columns, without the submitted text."""
    slot = F.lit(4)
    for k, name in enumerate(TYPES):
        slot = F.when(F.col("event_type") == name, k).otherwise(slot)
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    week = (F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(ORIGIN).cast("timestamp"))) / 6.048e11) + 1).cast("long")
    e = e.withColumn("week", week).withColumn("question_id", (F.col("week") - 1) * 5 + slot)
    kind = F.when(F.col("event_id") % 10 == 0, "Started").when(F.col("event_id") % 10 == 1, "Saved").when(F.col("event_id") % 10 < 5, "Prechecked").otherwise("Submit")
    return e.select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("student_id"), (F.col("user_id") % 4).alias("course_id"), (F.col("user_id") % 42).alias("section_id"),
        "question_id", "ts", F.date_format("ts", "dd/MM/yy, HH:mm:ss").alias("timestamp"), F.when(F.col("week") == 5, 1).otherwise(0).cast("long").alias("is_exam"),
        kind.alias("response_type"), F.lpad(F.bin(F.regexp_extract("props", "([0-9]+)", 1).cast("long")), 7, "0").alias("pass"), "week", F.col("value"),
    )


def submissions(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Graded attempts alone, numbered from 0 within learner and question, with the share of tests passed; dealt by both to ``parts`` partitions if given."""
    from learntrail.functions.parsing import pass_fraction
    from learntrail.operators.sequence import attempt_number

    log = attempt_log(spark, sf_dir).where(F.col("response_type").isin("Submit", "Prechecked"))
    log = log.repartition(parts, "student_id", "question_id") if parts else log
    return attempt_number(log).withColumn("attempt_id", F.col("attempt_no") - 1).withColumn("fraction", pass_fraction(F.col("pass")))


def observations(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """The sparse cube: one row for each learner, test case and attempt; dealt as ``submissions`` are."""
    from learntrail.operators.cube import attempt_cube, item_base

    return attempt_cube(submissions(spark, sf_dir, parts), base=item_base(submissions(spark, sf_dir)))


def responses(log: DataFrame, spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The log with the key ``response`` of a submitted text for each row, and the texts as ``key, text``: whole texts of
    benchmark items, ASCII alone, so that both engines measure edit distances in the same unit."""
    items = table(spark, sf_dir, "benchmark")
    n = items.count()
    texts = items.select(F.col("item_id").alias("key"), F.regexp_replace("text", "[^ -~]", "").alias("text"))
    return log.withColumn("response", F.col("row_id") % n).join(items.select(F.col("item_id").alias("response")), "response", "left_semi"), texts


def with_response(log: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with a submitted text for each row."""
    log, texts = responses(log, spark, sf_dir)
    return log.withColumnRenamed("response", "key").join(texts.withColumnRenamed("text", "response"), "key").drop("key")


LOG_SQL = """
e AS (SELECT *, CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 6.048e11) AS BIGINT) + 1 AS week,
        CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS slot FROM events),
log AS (SELECT event_id AS row_id, user_id AS student_id, user_id % 4 AS course_id, user_id % 42 AS section_id, CAST((week - 1) * 5 + slot AS BIGINT) AS question_id, ts,
        strftime(ts, '%d/%m/%y, %H:%M:%S') AS timestamp, CAST(CASE WHEN week = 5 THEN 1 ELSE 0 END AS BIGINT) AS is_exam,
        CASE WHEN event_id % 10 = 0 THEN 'Started' WHEN event_id % 10 = 1 THEN 'Saved' WHEN event_id % 10 < 5 THEN 'Prechecked' ELSE 'Submit' END AS response_type,
        lpad(bin(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)), 7, '0') AS pass, week, value FROM e),
sub AS (SELECT *, row_number() OVER (PARTITION BY student_id, question_id ORDER BY ts, row_id) AS attempt_no,
        row_number() OVER (PARTITION BY student_id, question_id ORDER BY ts, row_id) - 1 AS attempt_id,
        CAST(length(replace(pass, '0', '')) AS DOUBLE) / length(pass) AS fraction FROM log WHERE response_type IN ('Submit', 'Prechecked')),
tc AS (SELECT question_id, max(length(pass)) AS n_tc FROM sub GROUP BY question_id),
base AS (SELECT question_id, CAST(sum(n_tc) OVER (ORDER BY question_id) - n_tc AS BIGINT) AS first_item FROM tc),
obs AS (SELECT s.student_id, s.question_id, b.first_item + g.i - 1 AS item_id, s.attempt_id, CAST(substr(s.pass, CAST(g.i AS INT), 1) AS BIGINT) AS y,
        round((epoch_us(s.ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 8.64e10, 6) AS t_days, s.is_exam, s.week
        FROM sub s JOIN base b USING (question_id) JOIN (SELECT unnest(generate_series(1, 7)) AS i) g ON g.i <= length(s.pass))
"""
