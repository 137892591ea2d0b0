"""Readers and writers of logs, lab files and simulator lines. Schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learntrail.sources.labs import json_elements

SUBMISSIONS = "student_id long, course_id long, section_id long, question_unittest_id long, attempt_id long, timestamp string, is_exam long, response_type string, response string, pass string"
_CASES = "array<struct<input:string,std_input:string,output:string>>"
_ANSWER = "name string, id string, review_link string, response_history array<struct<question:string,results:array<struct<step:string,time:string,action:string,state:string,score:string>>>>"


def scan_submissions(spark: SparkSession, path: str) -> DataFrame:
    """The attempt log from CSV with a header; lines that don't fit are dropped. The pass column stays text."""
    return spark.read.schema(SUBMISSIONS).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "DROPMALFORMED").csv(path)


def write_submissions(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def week_topic(name: Column) -> tuple[Column, Column, Column]:
    """Week, topic and exam flag of a file named ``W<week>_<topic>.json``; null without that form."""
    week = F.try_to_number(F.nullif(F.regexp_extract(name, r"W(\d+)_", 1), F.lit("")), F.lit("9999")).cast("long")
    return week, F.nullif(F.regexp_extract(name, r"W\d+_(.*)\.json$", 1), F.lit("")), F.contains(F.lower(name), F.lit("exam")).cast("long")


def scan_labs(spark: SparkSession, path: str) -> DataFrame:
    """The elements of lab files below course and section folders (``labs.json_elements``), with the lab's name, week, topic and exam flag."""
    rows = json_elements(spark, path)
    # a file, or a folder of files that Spark wrote under that name
    week, topic, exam = week_topic(F.concat(F.regexp_extract("file", r".*(W\d+_[^/]*)\.json", 1), F.lit(".json")))
    return rows.withColumns({"week": week, "topic": topic, "is_exam": exam, "lab_name": F.col("fields")["lab_name"]})


def lab_questions(labs: DataFrame, *keep: str) -> DataFrame:
    """One row for each question or sub-question, with the lab's columns ``keep``.

    An element is an object or an array of them, so it is a variant; what is neither, and text that isn't JSON, gives no row.
    """
    rows = labs.where("name = 'list_questions'").withColumn("position", F.row_number().over(Window.partitionBy("file").orderBy("place")) - 1)  # a lab's questions are few
    v = F.try_parse_json("json")
    many = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    one = rows.select(*keep, "lab_name", "week", "topic", "position", F.explode(many).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    texts = [F.try_variant_get("v", f"$.{c}", "string").alias(c) for c in ("question", "name", "template", "max_score")]
    return one.select(*keep, "lab_name", "week", "topic", "position", *texts, F.try_variant_get("v", "$.testcases", _CASES).alias("testcases"))


def lab_history(labs: DataFrame, *keep: str) -> DataFrame:
    """One row for each step of each learner's history at each question, with the lab's columns ``keep``. A learner without a
    history has a row without a question, an empty history one without a step; an answer that isn't an object gives none."""
    a = labs.where("name = 'student_answers'").where(F.col("json").startswith("{")).select(*keep, "lab_name", "week", F.from_json("json", _ANSWER).alias("a"))
    a = a.select(*keep, "lab_name", "week", F.col("a.id").alias("student_uid"), F.explode_outer("a.response_history").alias("h"))
    return a.select(*keep, "lab_name", "week", "student_uid", F.col("h.question").alias("question"), F.posexplode_outer("h.results").alias("position", "r")).select(*keep, "lab_name", "week", "student_uid", "question", "position", "r.*")


LINE = "student_id string, course_id string, section_id string, question_unittest_id string, attempt_id string, timestamp string, is_exam string, response_type string, response string, pass string, model string, prompt string, raw_response string"


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, every field as text; nulls are left out."""
    df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).write.mode("append").json(path)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Simulated attempts from JSON lines; a field that a line lacks is null."""
    return spark.read.schema(LINE).json(path)


def merge_shards(*shards: DataFrame) -> DataFrame:
    """All shards by column name; a column that a shard lacks is null there."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def not_done(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run has still to do."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")
