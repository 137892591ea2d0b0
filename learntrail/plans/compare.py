"""Queries of the evaluation harness and of checks between tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from learntrail.operators import harness as H
from learntrail.operators import trees as T
from learntrail.operators.retrieval import lookup_vectors
from learntrail.operators.selection import exact_quantiles
from learntrail.plans.log import attempt_log, observations, query, submissions, table
from learntrail.plans.relations import METRICS
from learntrail.sources.tables import shared_folder, written

HARNESS = f"""WITH w AS (SELECT unnest(generate_series(greatest(min(week), 1), max(week) - 1)) AS horizon FROM obs WHERE week > 0),
t AS (SELECT w.horizon, o.* FROM w JOIN obs o ON o.week <= w.horizon), l AS (SELECT w.horizon, o.* FROM w JOIN obs o ON o.week > w.horizon),
q AS (SELECT horizon, avg(y) AS q FROM t GROUP BY ALL), a AS (SELECT horizon, attempt_id, avg(y) AS p FROM t GROUP BY ALL), s AS (SELECT horizon, student_id, avg(y) AS p FROM t GROUP BY ALL),
raw AS (SELECT 'attempt_mean' AS model, l.horizon, y, coalesce(a.p, q.q) AS p FROM l JOIN q USING (horizon) LEFT JOIN a USING (horizon, attempt_id)
  UNION ALL SELECT 'student_mean', l.horizon, y, coalesce(s.p, q.q) FROM l JOIN q USING (horizon) LEFT JOIN s USING (horizon, student_id)),
pred AS (SELECT model, horizon, y, p AS score, least(1 - 1e-7, greatest(1e-7, p)) AS p FROM raw),
b AS (SELECT model, horizon, score, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY ALL),
c AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, horizon ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
r AS (SELECT model, horizon, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 8) AS auc FROM c GROUP BY ALL),
m AS (SELECT model, horizon, {METRICS} FROM pred GROUP BY ALL)
SELECT 'all' AS course, m.model, CAST(m.horizon AS BIGINT) AS horizon, m.* EXCLUDE (model, horizon), r.auc FROM m JOIN r USING (model, horizon)"""


def _compared(spark, d, names, horizons=None):
    store = H.Store(spark, shared_folder(spark))
    H.run(store, written(observations(spark, d)), names, horizons=horizons)
    found = H.metrics(store.predictions())
    return found.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query(HARNESS)
def harness_metrics(spark, d):
    """The two models of plain means at every horizon, their predictions stored and measured from the store."""
    return _compared(spark, d, ["attempt_mean", "student_mean"])


@query()
def harness_models(spark, d):
    """Ratings, the one-parameter model and knowledge tracing against each other at the third week."""
    return _compared(spark, d, ["elo", "irt", "bkt"], [3])


@query("WITH c AS (SELECT unnest(generate_series(greatest(min(week), 1), max(week) - 1)) AS cutoff FROM log WHERE week > 0) SELECT CAST(cutoff AS BIGINT) AS cutoff, question_id, CASE WHEN week <= cutoff THEN 'train' ELSE 'test' END AS role FROM (SELECT DISTINCT question_id, week FROM log WHERE week > 0) CROSS JOIN c")
def temporal_splits(spark, d):
    """Questions' roles at every cutoff between the first and the last week that the log has."""
    q = attempt_log(spark, d).where("week > 0").select("question_id", "week").distinct()
    weeks = q.agg(F.greatest(F.min("week"), F.lit(1)).alias("first"), F.max("week").alias("last")).where("first < last")  # one row
    return q.join(F.broadcast(weeks), how="cross").withColumn("cutoff", F.explode(F.sequence(F.col("first"), F.col("last") - 1))).select("cutoff", "question_id", F.when(F.col("week") <= F.col("cutoff"), "train").otherwise("test").alias("role"))


@query("""WITH s AS (SELECT student_id FROM (SELECT DISTINCT student_id FROM sub) ORDER BY md5(CAST(student_id AS VARCHAR)), student_id LIMIT 50), c AS (SELECT student_id, question_id, attempt_id, string_agg(y, '' ORDER BY item_id) AS bits FROM obs GROUP BY ALL)
SELECT count(DISTINCT u.student_id) AS students, count(*) AS attempts, count(*) FILTER (WHERE c.bits = u.pass) AS equal, count(*) FILTER (WHERE c.bits <> u.pass) AS other, count(*) FILTER (WHERE c.bits IS NULL) AS missing FROM sub u JOIN s USING (student_id) LEFT JOIN c USING (student_id, question_id, attempt_id)""")
def alignment_check(spark, d):
    """Fifty learners' test results as the cube has them against the log: how many attempts agree, differ or lack a row."""
    sub = submissions(spark, d)
    some = sub.select("student_id").distinct().orderBy(F.md5(F.col("student_id").cast("string")), "student_id").limit(50)
    cube = observations(spark, d).join(F.broadcast(some), "student_id", "left_semi").groupBy("student_id", "question_id", "attempt_id").agg(F.array_sort(F.collect_list(F.struct("item_id", "y"))).alias("x"))
    cube = cube.select("student_id", "question_id", "attempt_id", F.array_join(F.transform("x", lambda x: x["y"].cast("string")), "").alias("bits"))
    both = sub.join(F.broadcast(some), "student_id", "left_semi").join(cube, ["student_id", "question_id", "attempt_id"], "left")
    same = F.col("bits") == F.col("pass")
    return both.agg(F.count_distinct("student_id").alias("students"), F.count("*").alias("attempts"), F.count_if(same).alias("equal"), F.count_if(~same).alias("other"), F.count_if(F.col("bits").isNull()).alias("missing"))


@query("SELECT course_id, round(quantile_cont(value, 0.01), 6) AS p1, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM log GROUP BY course_id")
def clipped_ranges(spark, d):
    """The 1-99 and the 5-95 range of each course's values."""
    q = exact_quantiles(attempt_log(spark, d), ["course_id"], "value", {"p1": 0.01, "p5": 0.05, "p95": 0.95, "p99": 0.99})
    return q.select("course_id", *[F.round(c, 6).alias(c) for c in ("p1", "p5", "p95", "p99")])


@query("WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings) SELECT l.row_id, m.vec_id IS NULL AS missing, round(CAST(coalesce(m.embedding[1], 0) AS DOUBLE), 6) AS first, round(CAST(coalesce(m.embedding[len(m.embedding)], 0) AS DOUBLE), 6) AS last, CAST(coalesce(len(m.embedding), (SELECT max(len(embedding)) FROM embeddings)) AS BIGINT) AS size FROM log l CROSS JOIN n LEFT JOIN embeddings m ON m.vec_id = l.row_id % n.n")
def embedding_lookup(spark, d):
    """Each row's vector, zeros where there is none; more than 2 % without one are an error."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    rows = attempt_log(spark, d).join(F.broadcast(v.agg((F.max("vec_id") + 1).alias("n"))), how="cross").select("row_id", (F.col("row_id") % F.col("n")).alias("vec_id"))  # one row
    found = lookup_vectors(rows, v, ["vec_id"])
    at = lambda k: F.round(F.element_at("embedding", k).cast("double"), 6)
    return found.select("row_id", "missing", at(1).alias("first"), at(-1).alias("last"), F.size("embedding").cast("long").alias("size"))


def _nodes(spark, d):
    """Regions, nations and suppliers as nodes of a tree."""
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    named = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nodes = r.select(named("r", "r_regionkey").alias("id"), F.lit("").alias("parent_id"), F.col("r_name").alias("label"))
    return nodes.unionAll(n.select(named("n", "n_nationkey"), named("r", "n_regionkey"), "n_name")).unionAll(s.select(named("s", "s_suppkey"), named("n", "s_nationkey"), "s_name"))


NODES = "nodes AS (SELECT 'r' || r_regionkey AS id, '' AS parent_id, r_name AS label FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, s_name FROM supplier)"


@query("SELECT 1 AS level, '' AS parent_id, 'r' || r_regionkey AS id, r_name AS label FROM region UNION ALL SELECT 2, 'r' || n_regionkey, 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 3, 'n' || s_nationkey, 's' || s_suppkey, s_name FROM supplier", log=False)
def tree_flatten(spark, d):
    """A tree of any depth as an adjacency table: each level joins the one above."""
    return T.tree_levels(_nodes(spark, d))


def _by_length(texts, options, attempt):
    """A stand-in for a classifier: options whose length and the text's add up to a multiple of three; its first answer to every other text is none of the options."""
    return [["no such label"] if attempt == 0 and len(t) % 2 else [o for o in own if (len(t) + len(o)) % 3 == 0] for t, own in zip(texts, options, strict=True)]


@query(f"WITH RECURSIVE {NODES}, t AS (SELECT item_id, length(text) AS n FROM benchmark), c AS (SELECT t.item_id, t.n, 1 AS level, nodes.id FROM t JOIN nodes ON parent_id = '' AND (t.n + length(label)) % 3 = 0 UNION ALL SELECT c.item_id, c.n, c.level + 1, nodes.id FROM c JOIN nodes ON nodes.parent_id = c.id AND (c.n + length(label)) % 3 = 0) SELECT item_id AS question_id, level, id AS node_id, true AS valid FROM c", log=False)
def tag_questions(spark, d):
    """Questions tagged down a tree: each answer is checked against the node's children, failing rows alone are asked again."""
    return T.assign_tags(table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), "text"), _nodes(spark, d), _by_length)


@query("WITH a AS (SELECT row_id, CASE WHEN student_id NOT IN (SELECT s_suppkey FROM supplier) THEN 'student' WHEN question_id NOT IN (SELECT c_custkey FROM customer) THEN 'question' ELSE 'kept' END AS reason FROM sub) SELECT reason, count(*) AS n FROM a GROUP BY reason")
def align_events(spark, d):
    """Events joined to the current learners and questions; each dropped one is counted under the first reason."""
    students = table(spark, d, "supplier").select(F.col("s_suppkey").alias("student_id")).distinct()
    questions = table(spark, d, "customer").select(F.col("c_custkey").alias("question_id")).distinct()
    return T.align_keys(submissions(spark, d).select("row_id", "student_id", "question_id"), [("student", students, ["student_id"]), ("question", questions, ["question_id"])])[1]


@query("WITH a AS (SELECT *, row_number() OVER (ORDER BY student_id, item_id, t_days, attempt_id) AS n FROM obs) SELECT a.student_id, a.item_id, a.y, b.attempt_id FROM a JOIN a b USING (n)")
def borrowed_attempts(spark, d):
    """Attempt numbers for predictions without them, from those of a model with the same rows in the same order."""
    o = observations(spark, d).withColumn("place", F.col("attempt_id"))
    return T.borrowed(o.select("student_id", "item_id", "t_days", "place", "y"), o, ["student_id", "item_id", "t_days", "place"], "attempt_id").select("student_id", "item_id", "y", "attempt_id")


@query("""WITH m AS (SELECT course_id, CAST(count(*) AS VARCHAR) AS attempts, CAST(CAST(round(avg(fraction), 3) AS DECIMAL(10, 3)) AS VARCHAR) AS mean FROM sub GROUP BY course_id)
SELECT row_number() OVER (ORDER BY course_id) AS place, course_id || ' & ' || attempts || ' & ' || mean || ' \\\\' AS line FROM m UNION ALL SELECT * FROM (VALUES (-2, '\\begin{tabular}{lrr}'), (-1, 'course_id & attempts & mean \\\\'), (0, '\\hline'), (2147483647, '\\end{tabular}')) t(place, line)""")
def latex_metrics(spark, d):
    """A LaTeX table of each course's attempts and mean mark; a missing cell is an error."""
    m = submissions(spark, d).groupBy("course_id").agg(F.count("*").cast("string").alias("attempts"), F.round(F.avg("fraction"), 3).cast("decimal(10,3)").cast("string").alias("mean"))
    cells = m.select("course_id", F.explode(F.map_from_arrays(F.array(F.lit("attempts"), F.lit("mean")), F.array("attempts", "mean"))).alias("what", "text"))
    return T.latex_lines(cells, "course_id", "what", "text", ["attempts", "mean"]).withColumn("place", F.col("place").cast("long"))
