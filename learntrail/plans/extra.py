"""Queries over nested literals, alignment with drop reasons, splits, masks and scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learntrail.functions import parsing as P
from learntrail.operators import estimators as M
from learntrail.operators import evaluation as E
from learntrail.operators import retrieval as R
from learntrail.operators import sequence as S
from learntrail.plans.log import attempt_log, observations, query, submissions, table
from learntrail.plans.models import UNIFORM
from learntrail.plans.texts import FIX, build_prompt, mistake_fix_pairs
from learntrail.sources import readers
from learntrail.sources.tables import shared_folder

QUESTIONS = "q AS (SELECT course_id, week, 'Question 1' AS question, 0 AS position FROM (SELECT DISTINCT course_id, week FROM log) UNION ALL SELECT course_id, week, 'Question 2.' || k, 1 FROM (SELECT DISTINCT course_id, week FROM log), (SELECT unnest(generate_series(1, 2)) AS k))"
STEPS = "h AS (SELECT course_id, week, student_id, question_id, row_id, response_type, pass, fraction, ts, row_number() OVER (PARTITION BY course_id, week, student_id, question_id ORDER BY ts, row_id) AS n, count(*) OVER (PARTITION BY course_id, week, student_id, question_id) AS m FROM log)"
STEPS = STEPS.replace("fraction, ts", "CAST(length(replace(pass, '0', '')) AS DOUBLE) / length(pass) AS fraction, ts")


def _lab_files(spark, d):
    """The log as lab files in the shared folder, one for each course and week, named W<week>_<topic>.json below the course's folder, and the folder's path.

    A lab has a plain question and one with two parts, and each learner's history of steps. It is one JSON object in one file,
    written line by line: a learner's answer is a row, so no row grows with the lab.
    """
    log = attempt_log(spark, d).withColumn("fraction", P.pass_fraction(F.col("pass")))
    action = F.when(F.col("response_type") == "Started", "Started").otherwise(F.concat("response_type", F.lit(": "), "pass"))
    step = F.struct("ts", "row_id", action.alias("action"), F.when(F.col("fraction") == 1, "Correct").otherwise("").alias("state"), F.format_string("%.4f", "fraction").alias("score"), F.col("timestamp").alias("time"))
    results = F.transform(F.array_sort(F.collect_list(step)), lambda x, i: F.struct((i + 1).cast("string").alias("step"), x["time"].alias("time"), x["action"].alias("action"), x["state"].alias("state"), x["score"].alias("score")))
    pair = log.groupBy("course_id", "week", "student_id", "question_id").agg(results.alias("results"))
    student = pair.groupBy("course_id", "week", "student_id").agg(F.collect_list(F.struct(F.concat(F.lit("Question "), F.col("question_id").cast("string")).alias("question"), "results")).alias("response_history"))
    answer = F.struct(F.concat(F.lit("Student "), F.col("student_id").cast("string")).alias("name"), F.col("student_id").cast("string").alias("id"), F.lit("").alias("review_link"), "response_history")
    case = '"testcases":[{"input":"1","std_input":"","output":"1"}]'
    asked = lambda q: f'{{"question":"{q}","name":"task {q[9:]}","template":"","max_score":"1.00",{case}}}'
    questions = f"[{asked('Question 1')},[{asked('Question 2.1')},{asked('Question 2.2')}]]"
    head = F.concat(F.lit('{"lab_name":"Week '), F.col("week").cast("string"), F.lit(f'","list_questions":{questions},"student_answers":['))
    labs = student.groupBy("course_id", "week").agg(F.min("student_id").alias("first"))
    comma = F.when(F.col("student_id") == F.col("first"), "").otherwise(",")
    lines = student.join(labs, ["course_id", "week"]).select("course_id", "week", F.lit(1).alias("place"), "student_id", F.concat(comma, F.to_json(answer)).alias("value"))
    ends = labs.select("course_id", "week", F.explode(F.array(F.struct(F.lit(0).alias("place"), head.alias("value")), F.struct(F.lit(2).alias("place"), F.lit("]}").alias("value")))).alias("e"))
    lines = lines.unionByName(ends.select("course_id", "week", "e.place", F.lit(None).cast("long").alias("student_id"), "e.value"))
    name = F.concat(F.lit("W"), F.col("week").cast("string"), F.when(F.col("week") == 5, "_Exam").otherwise("_Lists"), F.lit(".json"))
    path = shared_folder(spark)
    lines = lines.withColumn("lab", name).repartition("course_id", "lab").sortWithinPartitions("course_id", "lab", "place", "student_id")
    lines.select("course_id", "lab", "value").write.partitionBy("course_id", "lab").text(path)
    return path


def _course(labs):
    return labs.withColumn("course_id", F.regexp_extract("file", r"course_id=(\d+)", 1).cast("long"))


@query(f"WITH {QUESTIONS} SELECT course_id, week, question, 'task ' || question[10:] AS name, position, CASE WHEN week = 5 THEN 'Exam' ELSE 'Lists' END AS topic FROM q")
def scan_lab_json(spark: SparkSession, d: str) -> DataFrame:
    """Lab files written from the log and read back: questions and sub-questions with week and topic of the file's name."""
    return readers.lab_questions(_course(readers.scan_labs(spark, _lab_files(spark, d))), "course_id").select("course_id", "week", "question", "name", "position", "topic")


@query(f"WITH {STEPS} SELECT course_id, week, CAST(student_id AS VARCHAR) AS student_uid, 'Question ' || question_id AS question, n - 1 AS position, CASE WHEN response_type = 'Started' THEN 'Started' ELSE response_type || ': ' || pass END AS action FROM h")
def explode_history(spark, d):
    """The steps of all histories in the lab files."""
    return readers.lab_history(_course(readers.scan_labs(spark, _lab_files(spark, d))), "course_id").select("course_id", "week", "student_uid", "question", F.col("position").cast("long").alias("position"), "action")


@query(f"WITH {STEPS} SELECT course_id, week, CAST(student_id AS VARCHAR) AS student_uid, 'Question ' || question_id AS question, n - 2 AS attempt, round(fraction, 4) AS score, strftime(ts, '%d/%m/%y, %H:%M:%S') AS time, CASE WHEN response_type = 'Started' THEN 'Started' ELSE response_type || ': ' || pass END AS response FROM h WHERE n > 1 AND n < m")
def legacy_score_cube(spark, d):
    """Histories without their first and last step, numbered anew: score over the question's maximum (blank is 0), time and response."""
    h = readers.lab_history(_course(readers.scan_labs(spark, _lab_files(spark, d))), "course_id")
    h = h.withColumn("last", F.max("position").over(Window.partitionBy("course_id", "week", "student_uid", "question"))).where("position > 0 AND position < last")
    score = F.coalesce(F.nullif("score", F.lit("")).cast("double"), F.lit(0.0)) / 1.0
    return h.select("course_id", "week", "student_uid", "question", (F.col("position") - 1).cast("long").alias("attempt"), F.round(score, 4).alias("score"), "time", F.col("action").alias("response"))


@query("SELECT row_id AS attempt_id, student_id, course_id, section_id, question_id AS question_unittest_id, timestamp, is_exam, response_type, 'line one' || chr(10) || '\"quoted\", ' || response_type AS response, pass FROM log")
def csv_round_trip(spark, d):
    """The log written as CSV with line breaks and quotes in it, and read back with the declared schema; bit strings stay text."""
    log, path = attempt_log(spark, d), shared_folder(spark)
    readers.write_submissions(log.select("student_id", "course_id", "section_id", F.col("question_id").alias("question_unittest_id"), F.col("row_id").alias("attempt_id"), "timestamp", "is_exam", "response_type", F.concat(F.lit('line one\n"quoted", '), "response_type").alias("response"), "pass"), path)
    return readers.scan_submissions(spark, path)


@query("SELECT CAST(student_id AS VARCHAR) AS student_id, CAST(course_id AS VARCHAR) AS course_id, CAST(section_id AS VARCHAR) AS section_id, CAST(question_id AS VARCHAR) AS question_unittest_id, CAST(attempt_id AS VARCHAR) AS attempt_id, timestamp, CAST(is_exam AS VARCHAR) AS is_exam, response_type, pass AS response, pass, 'model' AS model, 'p' || row_id AS prompt, CAST(NULL AS VARCHAR) AS raw_response FROM sub")
def jsonl_round_trip(spark, d):
    """Simulated attempts written as JSON lines, all fields text, and read back; fields that a line lacks are null."""
    s, path = submissions(spark, d), shared_folder(spark)
    rows = s.select("student_id", "course_id", "section_id", F.col("question_id").alias("question_unittest_id"), "attempt_id", "timestamp", "is_exam", "response_type", F.col("pass").alias("response"), "pass", F.lit("model").alias("model"), F.concat(F.lit("p"), F.col("row_id").cast("string")).alias("prompt"))
    readers.write_lines(rows, path)
    return readers.scan_lines(spark, path)


@query("SELECT p.question_id, round(avg(abs(p.fraction - q.fraction)), 6) AS error FROM sub p JOIN sub q ON q.student_id = p.student_id AND q.question_id = p.question_id AND q.attempt_no = p.attempt_no + 1 GROUP BY p.question_id")
def grading_error(spark, d):
    nxt = F.lead("fraction").over(S.ordered())
    return submissions(spark, d).withColumn("nxt", nxt).where("nxt IS NOT NULL").groupBy("question_id").agg(F.round(F.avg(F.abs(F.col("fraction") - F.col("nxt"))), 6).alias("error"))


@query("WITH g AS (SELECT student_id, question_id, 10 * max(fraction) AS y, count(*) AS x FROM sub GROUP BY ALL) SELECT student_id, question_id, round(x - avg(x) OVER (PARTITION BY question_id), 6) + 0.0 AS x, round(y - avg(y) OVER (PARTITION BY question_id), 6) + 0.0 AS y FROM g")
def tau_centred_points(spark, d):
    return _centred(spark, d).select("student_id", "question_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _centred(spark, d):
    g = submissions(spark, d).groupBy("student_id", "question_id").agg(F.count("*").alias("x"), (10 * F.max("fraction")).alias("y"))
    return _less_means(g, "question_id").select("student_id", "question_id", "x", "y")


def _less_means(g, key):
    """``x`` and ``y`` less their means over a key, which are joined: no group is gathered."""
    means = g.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return g.join(means, key).withColumns({"x": F.col("x") - F.col("mx"), "y": F.col("y") - F.col("my")})


@query()
def tau_decomposition(spark, d):
    """Kendall's tau of each learner before and after centring by question."""
    g = submissions(spark, d).groupBy("student_id", "question_id").agg(F.count("*").alias("x"), (10 * F.max("fraction")).alias("y"))
    before = E.kendall_tau(g, ["student_id"], "x", "y").withColumnRenamed("tau", "before")
    after = E.kendall_tau(_centred(spark, d), ["student_id"], "x", "y").select("student_id", F.col("tau").alias("after"))
    return before.join(after, "student_id", "left")


@query()
def tau_drop(spark, d):
    """How far centring by the other key lowers the mean tau, in percent of its size: by learner and by question."""
    g = submissions(spark, d).groupBy("student_id", "question_id").agg(F.count("*").alias("x"), (10 * F.max("fraction")).alias("y"))
    out = None
    for key, other in (("student_id", "question_id"), ("question_id", "student_id")):
        centred = _less_means(g, other).select("student_id", "question_id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))
        before, after = (E.kendall_tau(f, [key], "x", "y").agg(F.avg("tau").alias(a), F.count("tau").alias(f"n_{a}")) for f, a in ((g, "before"), (centred, "after")))
        row = before.join(F.broadcast(after)).select(F.lit(key).alias("key"), "before", "after", "n_before", "n_after", (100 * (F.col("before") - F.col("after")) / F.greatest(F.abs("before"), F.lit(1e-9))).alias("drop_pct"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query("WITH a AS (SELECT *, row_number() OVER (PARTITION BY student_id, question_id ORDER BY ts, row_id) - 1 AS attempt FROM sub WHERE student_id IN (SELECT s_suppkey FROM supplier) AND question_id IN (SELECT c_custkey FROM customer) AND fraction > 0.2) SELECT row_id, student_id, question_id, attempt FROM a")
def replayed_attempts(spark, d):
    """Attempts numbered anew, from 0, after rows without a current learner or question or with hardly a passed test are dropped."""
    s = submissions(spark, d).where("fraction > 0.2").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("student_id")), "student_id", "left_semi")
    s = s.join(table(spark, d, "customer").select(F.col("c_custkey").alias("question_id")), "question_id", "left_semi").drop("attempt_no")
    return S.attempt_number(s).select("row_id", "student_id", "question_id", (F.col("attempt_no") - 1).alias("attempt"))


@query("WITH m AS (SELECT student_id, count(*) AS n, avg(fraction) AS rate FROM sub GROUP BY student_id), t AS (SELECT student_id, string_agg('week ' || week || ': ' || r, '; ' ORDER BY week) AS topics FROM (SELECT student_id, week, CAST(CAST(round(1000 * avg(fraction)) AS BIGINT) AS VARCHAR) AS r FROM sub GROUP BY ALL) GROUP BY student_id), p AS (SELECT student_id, md5('You are student ' || student_id || ' with ' || n || ' attempts.' || chr(10) || 'Topics: ' || topics) AS key FROM m JOIN t USING (student_id)) SELECT student_id, key FROM p WHERE key NOT IN (SELECT key FROM p WHERE student_id % 2 = 0)")
def prompt_cache_misses(spark, d):
    """Prompts that have still to be sent: their key isn't among the cached answers, here those of learners with even ids."""
    p = build_prompt(spark, d).select("student_id", "key")
    return readers.not_done(p, p.where("student_id % 2 = 0"), ["key"]).select("student_id", "key")


@query("SELECT student_id, question_id FROM (SELECT DISTINCT student_id, question_id FROM log WHERE response_type = 'Submit') EXCEPT SELECT student_id, question_id FROM log WHERE response_type = 'Prechecked'")
def resume_pairs(spark, d):
    """What a run that was stopped has still to do."""
    log, k = attempt_log(spark, d), ["student_id", "question_id"]
    return readers.not_done(log.where("response_type = 'Submit'").select(*k).distinct(), log.where("response_type = 'Prechecked'"), k)


for _n, _c in ((2, "mistake"), (3, "fix")):

    def _scenario(spark, d, c=_c):
        return mistake_fix_pairs(spark, d).select(F.col(c).alias("row_id"), "student_id", "question_id")

    _scenario.__name__ = f"scenario_{_n}"
    query(FIX + f" SELECT {_c} AS row_id, student_id, question_id FROM f")(_scenario)


@query(FIX + ", r AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY question_id) AS n FROM f) SELECT student_id, question_id, mistake, fix FROM r WHERE n = 1")
def scenario_4(spark, d):
    return S.top_k(mistake_fix_pairs(spark, d), 1, ["student_id"], F.col("question_id")).drop("rank")


@query("SELECT student_id, question_id FROM (SELECT DISTINCT student_id, question_id FROM sub) WHERE " + UNIFORM.format(seed="42:", key="student_id") + " < 0.3 AND " + UNIFORM.format(seed="42:", key="student_id || ':' || question_id") + " < 0.5")
def sample_students(spark, d):
    """A sampling operator: a fixed share of learners, and of each one's questions, by seeded hashes."""
    pairs = submissions(spark, d).select("student_id", "question_id").distinct()
    return pairs.where((P.uniform(42, "student_id") < 0.3) & (P.uniform(42, "student_id", "question_id") < 0.5))


@query("SELECT student_id, item_id, attempt_id, y, " + UNIFORM.format(seed="7:", key="student_id || ':' || item_id || ':' || attempt_id") + " < 0.2 AS held FROM obs")
def mask_responses(spark, d):
    o = observations(spark, d)
    return o.withColumn("held", P.uniform(7, "student_id", "item_id", "attempt_id") < 0.2).select("student_id", "item_id", "attempt_id", "y", "held")


@query("SELECT a.doc_id AS left_id, min(b.doc_id) AS right_id FROM documents a JOIN documents b ON a.text = b.text AND b.doc_id < a.doc_id GROUP BY a.doc_id", log=False)
def plagiarism_exact(spark, d):
    """Each copied submission with the first that has the same text."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("right_id"))
    return docs.join(first, "h").where("right_id < doc_id").select(F.col("doc_id").alias("left_id"), "right_id")


@query("WITH c AS (SELECT count(*) AS n, round(avg(fraction), 6) AS rate, course_id FROM sub GROUP BY course_id) SELECT * FROM c")
def eda_courses(spark, d):
    return submissions(spark, d).groupBy("course_id").agg(F.count("*").alias("n"), F.round(F.avg("fraction"), 6).alias("rate"))


@query("SELECT CAST(isodow(ts) AS BIGINT) AS day, count(*) AS n FROM log GROUP BY day")
def eda_weekdays(spark, d):
    return attempt_log(spark, d).groupBy(((F.dayofweek("ts") + 5) % 7 + 1).cast("long").alias("day")).agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT student_id, round(avg(fraction), 1) AS bin FROM sub GROUP BY student_id) SELECT bin, count(*) AS n FROM a GROUP BY bin")
def eda_pass_rates(spark, d):
    a = submissions(spark, d).groupBy("student_id").agg((F.round(10 * E.ordered_mean("fraction", "row_id")) / 10).alias("bin"))  # ties as doubles have them, not as their decimal digits
    return a.groupBy("bin").agg(F.count("*").alias("n"))


@query()
def temporal_ability(spark, d):
    """One-parameter abilities by week of the log: the growth form as separate fits on growing prefixes.

    All prefixes are fitted together, with learners and items keyed by their prefix's last week; a learner has rows from
    the week of the first answer on. Answers are counted by week first, so that prefixes copy counts and not answers.
    """
    o = observations(spark, d).groupBy("student_id", "item_id", "week").agg(F.count("*").alias("n"), F.sum("y").alias("right"))
    last = F.broadcast(submissions(spark, d).where(F.col("pass").rlike("[01]")).agg(F.max("week").alias("last")))  # one row
    o = o.join(last, how="cross").withColumn("upto", F.explode(F.sequence("week", "last")))
    ability, _ = M.rasch(o.select("upto", "student_id", "item_id", "n", "right"), by=("upto",))
    return ability.select(F.col("upto").alias("week"), "student_id", "theta")


@query("SELECT b.item_id, min(d.doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id", log=False)
def match_question(spark, d):
    """The first document that holds a question's whole text, word for word; ``match_question_ratio`` finds inexact ones."""
    return R.containing(table(spark, d, "documents"), table(spark, d, "benchmark")).groupBy("item_id").agg(F.min("doc_id").alias("doc_id"))


@query()
def match_question_ratio(spark, d):
    """For each document the first question of at least 0.8 Indel ratio to it, both normalised and cut to 150 words as in the reference."""
    text = lambda t, k: table(spark, d, t).select(k, P.question_words(F.col("text")).alias("text"))
    found = R.ratio_pairs(text("documents", "doc_id"), text("benchmark", "item_id"), "doc_id", "item_id", 0.8)
    return found.groupBy("doc_id").agg(F.min_by(F.struct("item_id", "ratio"), "item_id").alias("m")).select("doc_id", "m.item_id", F.round("m.ratio", 8).alias("ratio"))
