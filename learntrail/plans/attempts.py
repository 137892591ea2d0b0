"""Queries over the attempt log: projections, filters, windows, aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learntrail.functions import parsing as P
from learntrail.operators import cube as C
from learntrail.operators import evaluation as E
from learntrail.operators import sequence as S
from learntrail.operators.selection import exact_quantiles
from learntrail.plans.log import attempt_log, observations, query, responses, submissions

MICROS = "epoch_us(ts)"


@query("SELECT * FROM obs")
def attempt_cube(spark: SparkSession, d: str) -> DataFrame:
    return observations(spark, d)


@query("SELECT row_id, student_id, question_id, response_type, pass FROM sub")
def filter_submissions(spark, d):
    return submissions(spark, d).select("row_id", "student_id", "question_id", "response_type", "pass")


@query("SELECT count(*) AS n FROM log WHERE NULLIF(response_type, 'Started') IS NOT NULL AND trim(pass) <> ''")
def drop_incomplete(spark, d):
    log = attempt_log(spark, d).withColumn("response_type", F.nullif("response_type", F.lit("Started")))
    return log.na.drop(subset=["response_type"]).where(F.trim("pass") != "").agg(F.count("*").alias("n"))


@query("SELECT row_id, student_id FROM log WHERE course_id IN (SELECT c FROM (VALUES (1), (3)) t(c))")
def filter_course(spark, d):
    return S.of_courses(attempt_log(spark, d), [1, 3]).select("row_id", "student_id")


@query("""WITH x AS (SELECT row_id, CASE row_id % 4 WHEN 0 THEN CAST(CAST(pass AS DOUBLE) AS VARCHAR) WHEN 1 THEN pass WHEN 2 THEN '0.0' ELSE NULL END AS p, pass FROM log)
SELECT row_id, CASE WHEN contains(p, '.') THEN CAST(CAST(CAST(p AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE p END AS as_integer,
 regexp_replace(CASE WHEN contains(p, '.') THEN CAST(CAST(CAST(p AS DOUBLE) AS BIGINT) AS VARCHAR) ELSE p END, '[^01]', '', 'g') AS as_bits,
 CASE WHEN p IN ('0.0', '0') THEN '' ELSE split_part(p, '.', 1) END AS as_head, replace(p, '.', '') AS as_no_dots, p AS as_raw FROM x""")
def pass_parse_modes(spark, d):
    p = F.when(F.col("row_id") % 4 == 0, F.concat(F.col("pass").cast("long").cast("string"), F.lit(".0"))).when(F.col("row_id") % 4 == 1, F.col("pass")).when(F.col("row_id") % 4 == 2, "0.0")
    x = attempt_log(spark, d).withColumn("p", p)
    return x.select("row_id", P.parse_pass(F.col("p")).alias("as_integer"), P.parse_pass(F.col("p"), "bits").alias("as_bits"), P.parse_pass(F.col("p"), "head").alias("as_head"), P.parse_pass(F.col("p"), "no_dots").alias("as_no_dots"), P.parse_pass(F.col("p"), "raw").alias("as_raw"))


@query("SELECT row_id, round(CAST(length(replace(pass, '0', '')) AS DOUBLE) / length(pass), 6) AS fraction, round(10 * CAST(length(replace(pass, '0', '')) AS DOUBLE) / length(pass), 6) AS marks, regexp_full_match(pass, '1+') AS perfect FROM log")
def pass_fraction(spark, d):
    c = F.col("pass")
    return attempt_log(spark, d).select("row_id", F.round(P.pass_fraction(c), 6).alias("fraction"), F.round(P.marks(c), 6).alias("marks"), P.is_perfect(c).alias("perfect"))


@query("SELECT question_id, CAST(max(length(pass)) AS BIGINT) AS n_tests FROM sub GROUP BY question_id")
def count_testcases(spark, d):
    return submissions(spark, d).groupBy("question_id").agg(F.max(F.length("pass")).cast("long").alias("n_tests"))


@query("SELECT row_id, strptime(timestamp, '%d/%m/%y, %H:%M:%S') AS ts, CAST(NULL AS TIMESTAMP) AS bad FROM log")
def parse_timestamp(spark, d):
    return attempt_log(spark, d).select("row_id", P.parse_timestamp(F.col("timestamp")).cast("timestamp_ntz").alias("ts"), P.parse_timestamp(F.concat(F.lit("x"), F.col("timestamp"))).cast("timestamp_ntz").alias("bad"))


@query("SELECT row_id, round(greatest(0, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-08 00:00:00')) / 8.64e10), 6) AS t_days FROM log")
def course_time_days(spark, d):
    return attempt_log(spark, d).select("row_id", F.round(P.course_days(F.col("ts"), F.lit("2024-01-08 00:00:00").cast("timestamp")), 6).alias("t_days"))


@query("SELECT row_id, round((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY student_id)) / 1e6, 3) AS since_first FROM log")
def time_since_first(spark, d):
    m = F.unix_micros("ts")
    return attempt_log(spark, d).select("row_id", F.round((m - F.min(m).over(Window.partitionBy("student_id"))) / 1e6, 3).alias("since_first"))


@query("SELECT row_id, student_id, question_id, attempt_no FROM sub")
def attempt_number(spark, d):
    return submissions(spark, d).select("row_id", "student_id", "question_id", "attempt_no")


@query("SELECT row_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY student_id, question_id ORDER BY ts, row_id)) / 1e6, 3) AS delta_s FROM sub")
def time_delta(spark, d):
    return S.time_delta(submissions(spark, d)).select("row_id", F.round("delta_s", 3).alias("delta_s"))


RESP = "WITH n AS (SELECT count(*) AS n FROM benchmark), r AS (SELECT s.*, regexp_replace(d.text, '[^ -~]', '', 'g') AS response FROM sub s CROSS JOIN n JOIN benchmark d ON d.item_id = s.row_id % n.n)"


@query(RESP + ", l AS (SELECT *, lag(response) OVER (PARTITION BY student_id, question_id ORDER BY ts, row_id) AS prev FROM r) SELECT row_id, CAST(levenshtein(response, prev) AS DOUBLE) AS edit_distance FROM l")
def edit_distance_lag(spark, d):
    x, texts = responses(submissions(spark, d), spark, d)
    return S.edit_lag(x, texts=texts).select("row_id", F.col("edit_distance").cast("double").alias("edit_distance"))


@query(RESP + """, l AS (SELECT *, lag(response) OVER w AS prev, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS delta FROM r WINDOW w AS (PARTITION BY student_id, question_id ORDER BY ts, row_id))
SELECT row_id, round(CAST(levenshtein(response, prev) AS DOUBLE) / greatest(length(response), length(prev), 1), 6) AS edit_fraction, round(delta, 3) AS delta_s FROM l
WHERE prev IS NOT NULL AND CAST(levenshtein(response, prev) AS DOUBLE) / greatest(length(response), length(prev), 1) > 0.9 AND delta < 600""")
def suspicious_jumps(spark, d):
    """Attempts that change over nine tenths of the text within ten minutes; the events of the test tables lie further apart, so few or none are found."""
    x, texts = responses(submissions(spark, d), spark, d)
    return S.jumps(x, texts=texts).select("row_id", F.round("edit_fraction", 6).alias("edit_fraction"), F.round("delta_s", 3).alias("delta_s"))


@query(RESP + """, l AS (SELECT *, lag(response) OVER w AS prev, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS delta FROM r WINDOW w AS (PARTITION BY student_id, question_id ORDER BY ts, row_id))
SELECT row_id, round(CAST(levenshtein(response, prev) AS DOUBLE) / greatest(length(response), length(prev), 1), 6) AS edit_fraction, round(delta, 3) AS delta_s FROM l
WHERE prev IS NOT NULL AND CAST(levenshtein(response, prev) AS DOUBLE) / greatest(length(response), length(prev), 1) > 0.6 AND delta < 86400""")
def wide_jumps(spark, d):
    """The same with wider limits, so that rows come out of the test tables: six tenths within a day."""
    x, texts = responses(submissions(spark, d), spark, d)
    return S.jumps(x, 0.6, 86400, texts=texts).select("row_id", F.round("edit_fraction", 6).alias("edit_fraction"), F.round("delta_s", 3).alias("delta_s"))


@query("SELECT row_id, round(fraction - avg(fraction) OVER (PARTITION BY student_id), 6) + 0.0 AS by_student, round(fraction - avg(fraction) OVER (PARTITION BY question_id), 6) + 0.0 AS by_question FROM sub")
def center_by_group(spark, d):
    s = submissions(spark, d).select("row_id", "student_id", "question_id", "fraction")
    for key in ("student_id", "question_id"):  # means are joined: no group is gathered
        s = s.join(s.groupBy(key).agg(F.avg("fraction").alias(f"of_{key}")), key)
    return s.select("row_id", *[F.round(F.col("fraction") - F.col(f"of_{k}"), 6).alias(a) for k, a in (("student_id", "by_student"), ("question_id", "by_question"))])


@query("""WITH g AS (SELECT DISTINCT student_id, item_id FROM obs), s AS (SELECT unnest(generate_series(1, 5)) AS n), o AS (SELECT *, row_number() OVER (PARTITION BY student_id, item_id ORDER BY attempt_id) AS n FROM obs)
SELECT g.student_id, g.item_id, CAST(s.n AS BIGINT) AS n, last_value(o.y IGNORE NULLS) OVER (PARTITION BY g.student_id, g.item_id ORDER BY s.n ROWS UNBOUNDED PRECEDING) AS y FROM g CROSS JOIN s LEFT JOIN o ON o.student_id = g.student_id AND o.item_id = g.item_id AND o.n = s.n""")
def attempt_snapshots(spark, d):
    return S.snapshots(observations(spark, d), 5)


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY student_id, item_id ORDER BY attempt_id) AS n FROM obs) SELECT student_id, item_id, arg_max(y, attempt_id) AS y FROM k WHERE n <= 3 GROUP BY ALL")
def collapse_last(spark, d):
    return S.collapse_last(observations(spark, d), 3)


@query("WITH k AS (SELECT *, row_number() OVER (PARTITION BY student_id, question_id ORDER BY ts, row_id) - 1 AS n FROM log) SELECT row_id, student_id FROM k WHERE n < 4")
def cap_attempts(spark, d):
    return S.attempt_number(attempt_log(spark, d)).where("attempt_no - 1 < 4").select("row_id", "student_id")


@query("WITH c AS (SELECT question_id, student_id, count(*) AS n FROM sub GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, student_id) AS rank FROM c) SELECT * FROM r WHERE rank <= 3")
def top_submitters(spark, d):
    return S.top_k(submissions(spark, d).groupBy("question_id", "student_id").agg(F.count("*").alias("n")), 3, ["question_id"], F.desc("n"), F.col("student_id"))


@query("""WITH c AS (SELECT question_id, student_id, count(*) AS n FROM sub GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, student_id) AS rank FROM c)
SELECT student_id, count(*) AS freq, string_agg(CAST(question_id AS VARCHAR), ',' ORDER BY question_id) AS questions FROM r WHERE rank <= 3 GROUP BY student_id HAVING count(*) > 1""")
def repeated_top_submitters(spark, d):
    return top_submitters(spark, d).groupBy("student_id").agg(F.count("*").alias("freq"), F.array_join(F.transform(F.sort_array(F.collect_list("question_id")), lambda x: x.cast("string")), ",").alias("questions")).where("freq > 1")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY ts DESC, row_id DESC) AS n FROM sub) SELECT student_id, row_id, n FROM r WHERE n <= 20")
def event_sequence_capped(spark, d):
    return S.top_k(submissions(spark, d), 20, ["student_id"], F.desc("ts"), F.desc("row_id")).select("student_id", "row_id", F.col("rank").alias("n"))


@query("SELECT student_id, attempt_id, item_id, item_id * 2 + y AS token, coalesce(lead(item_id) OVER w, -1) AS next_item, coalesce(lead(y) OVER w, -1) AS next_y FROM obs WINDOW w AS (PARTITION BY student_id ORDER BY t_days, item_id, attempt_id)")
def next_step_pairs(spark, d):
    w = Window.partitionBy("student_id").orderBy("t_days", "item_id", "attempt_id")
    return observations(spark, d).select("student_id", "attempt_id", "item_id", (F.col("item_id") * 2 + F.col("y")).alias("token"), F.lead("item_id", 1, -1).over(w).alias("next_item"), F.lead("y", 1, -1).over(w).alias("next_y"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY student_id, question_id ORDER BY ts DESC, row_id DESC) AS n FROM log) SELECT student_id, question_id, row_id FROM r WHERE n = 1")
def dedupe_keep_last(spark, d):
    return S.top_k(attempt_log(spark, d), 1, ["student_id", "question_id"], F.desc("ts"), F.desc("row_id")).select("student_id", "question_id", "row_id")


@query("SELECT row_id, dense_rank() OVER (PARTITION BY student_id ORDER BY ts) - 1 AS time_index FROM sub")
def time_index(spark, d):
    return submissions(spark, d).select("row_id", (F.dense_rank().over(Window.partitionBy("student_id").orderBy("ts")) - 1).cast("long").alias("time_index"))


@query("WITH p AS (SELECT student_id, avg(y) AS pr FROM obs GROUP BY student_id) SELECT student_id, row_number() OVER (ORDER BY round(pr, 9) DESC, student_id) AS rank FROM p")
def student_rank_by_pass_rate(spark, d):
    rates = observations(spark, d).groupBy("student_id").agg(F.avg("y").alias("pr"))
    return S.ranked(rates, F.round("pr", 9).desc(), F.col("student_id")).select("student_id", (F.col("_rank") + 1).alias("rank"))


@query("""WITH f AS (SELECT *, CASE WHEN lag(question_id) OVER (PARTITION BY student_id ORDER BY ts, row_id) = question_id THEN 0 ELSE 1 END AS nw FROM sub), g AS (SELECT *, sum(nw) OVER (PARTITION BY student_id ORDER BY ts, row_id) AS run FROM f)
SELECT row_id, row_number() OVER (PARTITION BY student_id, run ORDER BY ts, row_id) - 1 AS run_attempt FROM g""")
def run_attempt_counter(spark, d):
    return S.run_counter(submissions(spark, d), F.col("question_id"), ("ts", "row_id")).select("row_id", "run_attempt")


@query("SELECT student_id, question_id, min(ts) AS first_ts, round(10 * arg_max(fraction, row(ts, row_id)), 6) AS final_mark FROM sub GROUP BY ALL")
def final_mark_per_problem(spark, d):
    return submissions(spark, d).groupBy("student_id", "question_id").agg(F.min("ts").cast("timestamp_ntz").alias("first_ts"), F.round(10 * F.max_by("fraction", F.struct("ts", "row_id")), 6).alias("final_mark"))


@query(RESP + """, l AS (SELECT *, levenshtein(response, lag(response) OVER (PARTITION BY student_id, question_id ORDER BY ts, row_id)) AS ed FROM r)
SELECT student_id, question_id, count(*) AS n_attempts, round(avg(ed), 6) AS avg_edit, round(max(fraction), 6) AS max_ratio, arg_min(course_id, row_id) AS course_id, arg_min(section_id, row_id) AS section_id, arg_min(is_exam, row_id) AS is_exam FROM l GROUP BY ALL""")
def student_question_features(spark, d):
    x, texts = responses(submissions(spark, d), spark, d)
    x = S.edit_lag(x, texts=texts)
    return x.groupBy("student_id", "question_id").agg(F.count("*").alias("n_attempts"), F.round(F.avg("edit_distance"), 6).alias("avg_edit"), F.round(F.max("fraction"), 6).alias("max_ratio"), *[F.min_by(c, "row_id").alias(c) for c in ("course_id", "section_id", "is_exam")])


DELTA = "WITH t AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY student_id ORDER BY ts, row_id)) / 1e6 AS delta FROM sub)"


@query(DELTA + " SELECT student_id, round(median(delta), 6) AS median_s, count(*) AS n, round(max(10 * fraction), 6) AS best FROM t GROUP BY student_id")
def student_pace(spark, d):
    return S.time_delta(submissions(spark, d), ("student_id",)).groupBy("student_id").agg(F.round(F.percentile("delta_s", F.lit(0.5)), 6).alias("median_s"), F.count("*").alias("n"), F.round(F.max(F.col("fraction") * 10), 6).alias("best"))


@query(DELTA + " SELECT round(avg(delta) / 60, 6) AS mean_min, round(median(delta) / 60, 6) AS median_min, round(min(delta) / 60, 6) AS least_min, round(max(delta) / 60, 6) AS most_min, round(quantile_cont(delta, 0.95) / 60, 6) AS p95_min FROM t")
def pace_summary(spark, d):
    m = F.col("delta_s")
    x = S.time_delta(submissions(spark, d), ("student_id",))
    whole = x.agg(F.avg(m).alias("mean_min"), F.min(m).alias("least_min"), F.max(m).alias("most_min"))
    both = whole.join(F.broadcast(exact_quantiles(x, [], m, {"median_min": 0.5, "p95_min": 0.95})))  # one row each
    return both.select(*[F.round(F.col(c) / 60, 6).alias(c) for c in ("mean_min", "median_min", "least_min", "most_min", "p95_min")])


@query("SELECT response_type, count(*) AS n FROM log GROUP BY response_type")
def action_counts(spark, d):
    return attempt_log(spark, d).groupBy("response_type").agg(F.count("*").alias("n"))


STUDENT_Q = "SELECT student_id, question_id, max(attempt_no) AS steps, 10 * max(fraction) AS best, 10 * arg_max(fraction, attempt_no) AS last_mark FROM sub GROUP BY ALL"


@query(f"WITH s AS ({STUDENT_Q}) SELECT question_id, round_even(avg(steps), 2) AS mean_steps, round_even(avg(best), 2) AS mean_best, round(max(best), 6) AS max_best, count(last_mark) AS n FROM s GROUP BY question_id")
def problem_summary(spark, d):
    return _student_question(spark, d).groupBy("question_id").agg(F.bround(F.avg("steps"), 2).alias("mean_steps"), F.bround(F.avg("best"), 2).alias("mean_best"), F.round(F.max("best"), 6).alias("max_best"), F.count("last_mark").alias("n"))


def _student_question(spark, d):
    return submissions(spark, d).groupBy("student_id", "question_id").agg(F.max("attempt_no").alias("steps"), (10 * F.max("fraction")).alias("best"), (10 * F.max_by("fraction", "attempt_no")).alias("last_mark"))


def _r(x, y):
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


@query(f"WITH s AS ({STUDENT_Q}) SELECT question_id, CASE WHEN count(*) >= 3 THEN round({_r('steps', 'last_mark')}, 6) + 0.0 END AS r_last, CASE WHEN count(*) >= 3 THEN round({_r('steps', 'best')}, 6) + 0.0 END AS r_best, CASE WHEN count(*) >= 3 THEN round({_r('best', 'last_mark')}, 6) + 0.0 END AS r_marks FROM s WHERE best > 0 GROUP BY question_id")
def problem_correlations(spark, d):
    enough = lambda x, y: F.when(F.count("*") >= 3, F.round(E.correlation(x, y), 6))
    return _student_question(spark, d).where("best > 0").groupBy("question_id").agg(enough("steps", "last_mark").alias("r_last"), enough("steps", "best").alias("r_best"), enough("best", "last_mark").alias("r_marks"))


@query(f"WITH s AS (SELECT student_id, count(*) AS n, avg(fraction) AS score FROM sub GROUP BY student_id) SELECT round(covar_pop(n, score) / nullif(var_pop(n), 0), 8) AS slope, round(avg(score) - avg(n) * covar_pop(n, score) / nullif(var_pop(n), 0), 8) AS intercept, round({_r('n', 'score')}, 8) AS r FROM s")
def regression_submits_score(spark, d):
    s = submissions(spark, d).groupBy("student_id").agg(F.count("*").alias("n"), F.avg("fraction").alias("score"))
    slope = F.try_divide(F.covar_pop("n", "score"), F.nullif(F.var_pop("n"), F.lit(0.0)))
    return s.agg(F.round(slope, 8).alias("slope"), F.round(F.avg("score") - F.avg("n") * slope, 8).alias("intercept"), F.round(E.correlation("n", "score"), 8).alias("r"))


@query(f"WITH s AS ({STUDENT_Q}), q AS (SELECT question_id, avg(steps) AS a, avg(best) AS b FROM s GROUP BY question_id) SELECT round(avg(a), 6) AS mean_steps, round(avg(b), 6) AS mean_best FROM q")
def problem_overall(spark, d):
    return _student_question(spark, d).groupBy("question_id").agg(F.avg("steps").alias("a"), F.avg("best").alias("b")).agg(F.round(F.avg("a"), 6).alias("mean_steps"), F.round(F.avg("b"), 6).alias("mean_best"))


@query(RESP + """, l AS (SELECT *, levenshtein(response, lag(response) OVER w) AS ed, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS delta FROM r WINDOW w AS (PARTITION BY student_id, question_id ORDER BY ts, row_id))
SELECT student_id, round(coalesce(avg(delta), 0), 4) AS mean_delta, round(coalesce(avg(ed), 0), 6) AS mean_edit, count(*) AS n FROM l GROUP BY student_id HAVING count(*) >= 2""")
def behavior_metrics(spark, d):
    x, texts = responses(submissions(spark, d), spark, d)
    x = S.edit_lag(S.time_delta(x), texts=texts)
    return x.groupBy("student_id").agg(F.round(F.coalesce(F.avg("delta_s"), F.lit(0.0)), 4).alias("mean_delta"), F.round(F.coalesce(F.avg("edit_distance"), F.lit(0.0)), 6).alias("mean_edit"), F.count("*").alias("n")).where("n >= 2")


@query("SELECT course_id, count(*) AS n, count(DISTINCT student_id) AS students, count(DISTINCT question_id) AS questions FROM sub GROUP BY course_id")
def distinct_counts(spark, d):
    return submissions(spark, d).groupBy("course_id").agg(F.count("*").alias("n"), F.count_distinct("student_id").alias("students"), F.count_distinct("question_id").alias("questions"))


@query("WITH p AS (SELECT student_id, question_id, count(*) AS n, max(length(pass)) AS t FROM sub GROUP BY ALL) SELECT question_id, CAST(max(t) AS BIGINT) AS max_tests, max(n) AS max_attempts FROM p GROUP BY question_id")
def cube_dimensions(spark, d):
    p = submissions(spark, d).groupBy("student_id", "question_id").agg(F.count("*").alias("n"), F.max(F.length("pass")).alias("t"))
    return p.groupBy("question_id").agg(F.max("t").cast("long").alias("max_tests"), F.max("n").alias("max_attempts"))


@query("SELECT question_id, CAST(floor(date_diff('day', DATE '2024-01-01', CAST(min(ts) AS DATE)) / 7.0) + 1 AS BIGINT) AS week FROM log GROUP BY question_id")
def derive_week(spark, d):
    return attempt_log(spark, d).groupBy("question_id").agg((F.floor(F.datediff(F.min("ts"), F.lit("2024-01-01").cast("date")) / 7.0) + 1).cast("long").alias("week"))


LASTY = "l AS (SELECT student_id, item_id, arg_max(y, attempt_id) AS y FROM obs GROUP BY ALL)"
QUALITY = f"{LASTY}, q AS (SELECT item_id, avg(y) AS pass_rate, count(*) / CAST((SELECT count(DISTINCT student_id) FROM obs) AS DOUBLE) AS coverage FROM l GROUP BY item_id)"


@query(f"WITH {QUALITY} SELECT item_id, round(pass_rate, 6) AS pass_rate, round(coverage, 6) AS coverage FROM q")
def item_quality(spark, d):
    return C.item_quality(observations(spark, d)).select("item_id", F.round("pass_rate", 6).alias("pass_rate"), F.round("coverage", 6).alias("coverage"))


@query(f"WITH {QUALITY} SELECT item_id, count(*) AS n, CAST(sum(y) AS BIGINT) AS passed FROM obs WHERE item_id IN (SELECT item_id FROM q WHERE pass_rate >= 0.3 AND pass_rate <= 0.49 AND coverage > 0.5) GROUP BY item_id")
def quality_filter(spark, d):
    return C.quality_filter(observations(spark, d), 0.3, 0.49, 0.5).groupBy("item_id").agg(F.count("*").alias("n"), F.sum("y").alias("passed"))


@query("SELECT item_id, round(ln(least(0.99, greatest(0.01, avg(y))) / (1 - least(0.99, greatest(0.01, avg(y))))), 6) AS logit FROM obs WHERE week <= 3 GROUP BY item_id")
def item_logit(spark, d):
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.avg("y")))
    return observations(spark, d).where("week <= 3").groupBy("item_id").agg(F.round(F.ln(p / (1 - p)), 6).alias("logit"))


def _rates(key):
    return lambda spark, d: observations(spark, d).groupBy(key).agg(F.round(F.avg("y"), 6).alias("pass_rate"), F.count("*").alias("n"))


for _k in ("student", "item", "attempt"):
    _f = _rates(f"{_k}_id")
    _f.__name__ = f"pass_rate_by_{_k}"
    query(f"SELECT {_k}_id, round(avg(y), 6) AS pass_rate, count(*) AS n FROM obs GROUP BY {_k}_id")(_f)


@query("WITH c AS (SELECT student_id, item_id, count(*) AS n FROM obs GROUP BY ALL) SELECT item_id, round(avg(n), 6) AS avg_attempts FROM c GROUP BY item_id")
def avg_attempts(spark, d):
    return observations(spark, d).groupBy("student_id", "item_id").agg(F.count("*").alias("n")).groupBy("item_id").agg(F.round(F.avg("n"), 6).alias("avg_attempts"))


@query("WITH c AS (SELECT student_id, item_id, CASE WHEN max(y) = 0 THEN 'always_fail' WHEN min(y) = 1 THEN 'always_pass' ELSE 'mixed' END AS outcome FROM obs GROUP BY ALL HAVING count(*) >= 2) SELECT outcome, count(*) AS n FROM c GROUP BY outcome")
def trajectory_outcomes(spark, d):
    c = observations(spark, d).groupBy("student_id", "item_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("*").alias("n")).where("n >= 2")
    return c.groupBy(S.trajectory_class(F.col("lo"), F.col("hi")).alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY student_id, item_id) AS n FROM obs WINDOW w AS (PARTITION BY student_id, item_id ORDER BY attempt_id)),
g AS (SELECT student_id, item_id, avg(y) FILTER (WHERE rn > n // 2) - avg(y) FILTER (WHERE rn <= n // 2) AS gain FROM o WHERE n >= 3 GROUP BY ALL) SELECT CASE WHEN gain > 0.05 THEN 'improving' WHEN gain < -0.05 THEN 'declining' ELSE 'stable' END AS pattern, count(*) AS n FROM g GROUP BY pattern""")
def improvement_patterns(spark, d):
    w = Window.partitionBy("student_id", "item_id")
    o = observations(spark, d).withColumn("rn", F.row_number().over(w.orderBy("attempt_id"))).withColumn("n", F.count("*").over(w)).where("n >= 3")
    half = F.floor(F.col("n") / 2)
    g = o.groupBy("student_id", "item_id").agg((F.avg(F.when(F.col("rn") > half, F.col("y"))) - F.avg(F.when(F.col("rn") <= half, F.col("y")))).alias("gain"))
    return g.groupBy(S.improvement_class(F.col("gain")).alias("pattern")).agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT course_id, student_id, avg(fraction) AS f FROM sub GROUP BY ALL) SELECT course_id, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS sd, round(quantile_cont(f, 0.75) - quantile_cont(f, 0.25), 6) AS iqr, round(avg(CASE WHEN f < 0.1 THEN 1.0 ELSE 0.0 END), 6) AS low_share FROM s GROUP BY course_id")
def course_summary(spark, d):
    s = submissions(spark, d).groupBy("course_id", "student_id").agg(F.avg("fraction").alias("f"))
    whole = s.groupBy("course_id").agg(F.round(F.avg("f"), 6).alias("mean"), F.round(F.stddev_pop("f"), 6).alias("sd"), F.round(F.avg(F.when(F.col("f") < 0.1, 1.0).otherwise(0.0)), 6).alias("low_share"))
    quarters = exact_quantiles(s, ["course_id"], "f", {"low": 0.25, "high": 0.75})
    return whole.join(quarters, "course_id").select("course_id", "mean", "sd", F.round(F.col("high") - F.col("low"), 6).alias("iqr"), "low_share")


@query("""WITH p AS (SELECT student_id, question_id, max(10 * fraction) AS best FROM sub GROUP BY ALL), g AS (SELECT unnest(generate_series(1, 30)) AS n)
SELECT CAST(g.n AS BIGINT) AS n, round(avg(coalesce(10 * s.fraction, p.best)), 6) AS mean_mark FROM p CROSS JOIN g LEFT JOIN sub s ON s.student_id = p.student_id AND s.question_id = p.question_id AND s.attempt_no = g.n GROUP BY g.n""")
def learning_curve_padded(spark, d):
    s = submissions(spark, d).select("student_id", "question_id", "attempt_no", (10 * F.col("fraction")).alias("mark"))
    grid = s.groupBy("student_id", "question_id").agg(F.max("mark").alias("best")).withColumn("attempt_no", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long"))))
    return grid.join(s, ["student_id", "question_id", "attempt_no"], "left").groupBy(F.col("attempt_no").alias("n")).agg(F.round(F.avg(F.coalesce("mark", "best")), 6).alias("mean_mark"))


@query("""WITH f AS (SELECT student_id, question_id, min(ts) AS t, 10 * max(fraction) AS best FROM sub GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY student_id ORDER BY t, question_id) AS nth, count(*) OVER (PARTITION BY student_id) AS c FROM f),
a AS (SELECT nth, avg(best) AS m, count(*) AS n FROM r WHERE c >= 5 AND nth <= 80 GROUP BY nth HAVING count(*) >= 10) SELECT nth, n, round(avg(m) OVER (ORDER BY nth ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM a""")
def score_progression(spark, d):
    f = submissions(spark, d).groupBy("student_id", "question_id").agg(F.min("ts").alias("t"), (10 * F.max("fraction")).alias("best"))
    w = Window.partitionBy("student_id")
    r = f.withColumn("nth", F.row_number().over(w.orderBy("t", "question_id")).cast("long")).withColumn("c", F.count("*").over(w)).where("c >= 5 AND nth <= 80")
    a = r.groupBy("nth").agg(F.avg("best").alias("m"), F.count("*").alias("n")).where("n >= 10")
    return a.select("nth", "n", F.round(F.avg("m").over(Window.orderBy("nth").rowsBetween(-2, 2)), 6).alias("smoothed"))
