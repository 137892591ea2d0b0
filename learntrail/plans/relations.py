"""Queries over dimension tables, labels, vectors and texts: joins, sets, reshaping, evaluation, retrieval."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learntrail.functions import parsing as P
from learntrail.operators import evaluation as E
from learntrail.operators import retrieval as R
from learntrail.operators import sequence as S
from learntrail.plans.log import attempt_log, observations, query, submissions, table
from learntrail.sources.tables import checkpointed


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey", log=False)
def join_course_left(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey", log=False)
def join_section_course(spark, d):
    n, r, c = (table(spark, d, t) for t in ("nation", "region", "customer"))
    dims = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return c.join(F.broadcast(dims), c.c_nationkey == dims.n_nationkey).select("c_custkey", "n_name", "r_name")


@query("SELECT l_orderkey, l_linenumber, p_name, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_name IS NOT NULL", log=False)
def join_questions(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).dropna(subset=["p_name"]).select("l_orderkey", "l_linenumber", "p_name", "l_quantity")


@query("SELECT a.student_id, a.question_id, a.n, round(b.best, 6) AS best FROM (SELECT student_id, question_id, count(*) AS n FROM log GROUP BY ALL) a JOIN (SELECT student_id, question_id, max(fraction) AS best FROM sub GROUP BY ALL) b USING (student_id, question_id)")
def join_alignment(spark, d):
    k = ["student_id", "question_id"]
    return attempt_log(spark, d).groupBy(k).agg(F.count("*").alias("n")).join(submissions(spark, d).groupBy(k).agg(F.round(F.max("fraction"), 6).alias("best")), k)


@query("WITH w AS (SELECT question_id, max(week) AS week FROM log WHERE is_exam = 0 GROUP BY question_id) SELECT q.question_id, coalesce(w.week, 99) AS week FROM (SELECT DISTINCT question_id FROM log) q LEFT JOIN w USING (question_id)")
def lookup_week_default(spark, d):
    log = attempt_log(spark, d)
    w = log.where("is_exam = 0").groupBy("question_id").agg(F.max("week").alias("w"))
    return log.select("question_id").distinct().join(w, "question_id", "left").select("question_id", F.coalesce("w", F.lit(99)).alias("week"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)", log=False)
def semi_students(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 40)", log=False)
def anti_missing_questions(spark, d):
    return table(spark, d, "part").join(table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("""WITH a AS (SELECT student_id, question_id, count(*) AS n FROM log WHERE response_type <> 'Saved' GROUP BY ALL), b AS (SELECT student_id, question_id, count(*) AS n FROM log WHERE response_type <> 'Submit' GROUP BY ALL),
r AS (SELECT CASE WHEN a.n IS NULL THEN 'only_right' WHEN b.n IS NULL THEN 'only_left' WHEN a.n = b.n THEN 'equal' WHEN a.n > b.n THEN 'left_more' ELSE 'right_more' END AS reason FROM a FULL JOIN b USING (student_id, question_id)) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def reconcile_full_outer(spark, d):
    log, k = attempt_log(spark, d), ["student_id", "question_id"]
    a = log.where("response_type <> 'Saved'").groupBy(k).agg(F.count("*").alias("a"))
    b = log.where("response_type <> 'Submit'").groupBy(k).agg(F.count("*").alias("b"))
    reason = F.when(F.col("a").isNull(), "only_right").when(F.col("b").isNull(), "only_left").when(F.col("a") == F.col("b"), "equal").when(F.col("a") > F.col("b"), "left_more").otherwise("right_more")
    return a.join(b, k, "full_outer").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("""WITH own AS (SELECT s_nationkey AS k, min(s_name) AS name FROM supplier WHERE s_acctbal > 5000 GROUP BY 1), other AS (SELECT n_regionkey AS r, min(s_name) AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
SELECT c_custkey, coalesce(own.name, other.name, 'none') AS name, CASE WHEN own.name IS NOT NULL THEN 1 WHEN other.name IS NOT NULL THEN 2 ELSE 3 END AS priority FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN own ON own.k = c_nationkey LEFT JOIN other ON other.r = n_regionkey""", log=False)
def fallback_join(spark, d):
    s, n, c = (table(spark, d, t) for t in ("supplier", "nation", "customer"))
    own = s.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_name").alias("own"))
    region = n.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    other = s.withColumnRenamed("s_nationkey", "c_nationkey").join(F.broadcast(region), "c_nationkey").groupBy("n_regionkey").agg(F.min("s_name").alias("other"))
    both = region.join(own, "c_nationkey", "left").join(other, "n_regionkey", "left")  # one row a nation
    return c.join(F.broadcast(both), "c_nationkey").select("c_custkey", F.coalesce("own", "other", F.lit("none")).alias("name"), F.when(F.col("own").isNotNull(), 1).when(F.col("other").isNotNull(), 2).otherwise(3).alias("priority"))


@query("""WITH t AS (SELECT student_id, min(ts) AS cutoff FROM sub WHERE week = 4 GROUP BY student_id) SELECT t.student_id, count(s.row_id) AS n_prior, round(avg(s.fraction), 6) AS mean_prior FROM t LEFT JOIN sub s ON s.student_id = t.student_id AND s.ts < t.cutoff AND s.week < 4 GROUP BY t.student_id""")
def range_prior_events(spark, d):
    s = submissions(spark, d)
    t = s.where("week = 4").groupBy("student_id").agg(F.min("ts").alias("cutoff"))
    prior = s.where("week < 4").select("student_id", "ts", "row_id", "fraction")
    return t.join(prior, (t.student_id == prior.student_id) & (prior.ts < t.cutoff), "left").groupBy(t.student_id).agg(F.count("row_id").alias("n_prior"), F.round(F.avg("fraction"), 6).alias("mean_prior"))


ASCII = "regexp_replace(text, '[^ -~]', '', 'g')"


def _alike(spark, d):
    """Documents with their class of equal texts within a source, and the links between classes: edit distance at most a tenth of the longer."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    classes = checkpointed(R.text_classes(docs, "doc_id", "text", "source"))
    firsts = docs.join(classes.where("doc_id = class_id").select("doc_id"), "doc_id", "left_semi")
    return classes, checkpointed(R.edit_pairs(firsts, "doc_id", "text", "source").select(F.col("left_id").alias("u"), F.col("right_id").alias("v")))


@query()
def similar_pairs(spark, d):
    """Each document's class of equal texts within its source, and how many other classes there are within a tenth of the longer text's length in edits."""
    classes, edges = _alike(spark, d)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = both.groupBy(F.col("u").alias("class_id")).agg(F.count("*").alias("n_links"))
    return classes.join(links, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query()
def plagiarism_greedy(spark, d):
    """The greedy filter in order of id within a source: a document is accepted unless an accepted one before it lies within a tenth of the longer text in edits."""
    classes, edges = _alike(spark, d)
    accepted = R.greedy_accepted(classes.where("doc_id = class_id").select(F.col("doc_id").alias("id")), edges)
    return classes.join(accepted.select(F.col("id").alias("doc_id"), F.lit(True).alias("accepted")), "doc_id", "left").select("doc_id", "class_id", F.coalesce("accepted", F.lit(False)).alias("accepted"))


@query(f"""WITH q AS (SELECT doc_id, {ASCII} AS s FROM documents), b AS (SELECT item_id, {ASCII} AS s FROM benchmark), x AS (SELECT q.doc_id, b.item_id, levenshtein(q.s, b.s) AS ed FROM q CROSS JOIN b)
SELECT doc_id, arg_min(item_id, ed * 1000000 + item_id) AS item_id, CAST(min(ed) AS BIGINT) AS distance FROM x GROUP BY doc_id""", log=False)
def best_match_edit(spark, d):
    plain = F.regexp_replace("text", "[^ -~]", "").alias("s")
    return R.best_match(table(spark, d, "documents").select("doc_id", plain), table(spark, d, "benchmark").select("item_id", plain), "doc_id", "item_id", "s")



@query("""WITH a AS (SELECT student_id, question_id, arg_max(pass, attempt_id) AS p, arg_min(pass, attempt_id) AS q FROM sub GROUP BY ALL) SELECT student_id, question_id, CAST(g.i AS BIGINT) AS pos, CAST(p[CAST(g.i AS INT):CAST(g.i AS INT)] = q[CAST(g.i AS INT):CAST(g.i AS INT)] AS INT) AS same FROM a JOIN (SELECT unnest(generate_series(1, 7)) AS i) g ON g.i <= least(length(p), length(q))""")
def align_testcases(spark, d):
    a = submissions(spark, d).groupBy("student_id", "question_id").agg(F.max_by("pass", "attempt_id").alias("p"), F.min_by("pass", "attempt_id").alias("q"))
    pairs = F.slice(F.arrays_zip(F.split("p", "").alias("p"), F.split("q", "").alias("q")), F.lit(1), F.least(F.length("p"), F.length("q")))
    return a.select("student_id", "question_id", F.posexplode(pairs).alias("i", "z")).select("student_id", "question_id", (F.col("i") + 1).cast("long").alias("pos"), (F.col("z.p") == F.col("z.q")).cast("int").alias("same"))


@query("""WITH t AS (SELECT student_id, question_id, pass AS want FROM sub WHERE attempt_no = 2), r AS (SELECT t.student_id, t.question_id, s.row_id, row_number() OVER (PARTITION BY t.student_id, t.question_id ORDER BY CASE WHEN s.pass = t.want THEN 1 ELSE 2 END, s.attempt_no) AS rn, CASE WHEN s.pass = t.want THEN 1 ELSE 2 END AS kind
FROM t JOIN sub s USING (student_id, question_id) WHERE s.pass = t.want OR s.fraction > 0 AND s.fraction < 1) SELECT student_id, question_id, row_id, kind FROM r WHERE rn = 1""")
def match_attempt(spark, d):
    s, k = submissions(spark, d), ["student_id", "question_id"]
    t = s.where("attempt_no = 2").select(*k, F.col("pass").alias("want"))
    kind = F.when(F.col("pass") == F.col("want"), 1).otherwise(2)
    j = s.join(t, k).where("pass = want OR (fraction > 0 AND fraction < 1)").withColumn("kind", kind)
    return S.top_k(j, 1, k, F.col("kind"), F.col("attempt_no")).select(*k, "row_id", "kind")


@query("WITH p AS (SELECT item_id AS a, item_id + 1 AS b FROM (SELECT DISTINCT item_id FROM obs) WHERE item_id % 7 < 6), q AS (SELECT item_id, 1 - avg(y) AS diff FROM obs GROUP BY item_id) SELECT a, b, round(x.diff - y.diff, 6) + 0.0 AS gap FROM p JOIN q x ON x.item_id = a JOIN q y ON y.item_id = b")
def pair_difficulty(spark, d):
    q = observations(spark, d).groupBy("item_id").agg((1 - F.avg("y")).alias("diff"))
    p = q.where("item_id % 7 < 6").select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"), F.col("diff").alias("da"))
    return p.join(q.select(F.col("item_id").alias("b"), F.col("diff").alias("db")), "b").select("a", "b", F.round(F.col("da") - F.col("db"), 6).alias("gap"))


@query("""WITH p AS (SELECT item_id AS a, item_id + 1 AS b, item_id // 7 % 5 AS category FROM (SELECT DISTINCT item_id FROM obs) WHERE item_id % 7 < 6), q AS (SELECT item_id, 1 - avg(y) AS diff FROM obs GROUP BY item_id), g AS (SELECT category, x.diff AS l, y.diff AS r FROM p JOIN q x ON x.item_id = a JOIN q y ON y.item_id = b)
SELECT category, round(sqrt(avg((l - r) * (l - r))), 6) AS rmse, round(avg(abs(l - r)), 6) AS mad, round(covar_pop(l, r) / nullif(stddev_pop(l) * stddev_pop(r), 0), 6) + 0.0 AS r FROM g GROUP BY category""")
def concept_pair_summary(spark, d):
    q = observations(spark, d).groupBy("item_id").agg((1 - F.avg("y")).alias("diff"))
    p = q.where("item_id % 7 < 6").select((F.col("item_id") + 1).alias("item_id"), (F.floor(F.col("item_id") / 7) % 5).alias("category"), F.col("diff").alias("l")).join(q.withColumnRenamed("diff", "r"), "item_id")
    gap = F.col("l") - F.col("r")
    return p.groupBy("category").agg(F.round(F.sqrt(F.avg(gap * gap)), 6).alias("rmse"), F.round(F.avg(F.abs(gap)), 6).alias("mad"), F.round(E.correlation("l", "r"), 6).alias("r"))


@query("WITH a AS (SELECT student_id, question_id FROM log WHERE response_type = 'Submit'), b AS (SELECT student_id, question_id FROM log WHERE response_type = 'Prechecked') SELECT student_id, question_id FROM a INTERSECT SELECT student_id, question_id FROM b")
def shared_keys(spark, d):
    k = attempt_log(spark, d).select("response_type", "student_id", "question_id")
    return k.where("response_type = 'Submit'").drop("response_type").intersect(k.where("response_type = 'Prechecked'").drop("response_type"))


@query("SELECT DISTINCT student_id, question_id FROM log WHERE response_type = 'Submit' EXCEPT SELECT student_id, question_id FROM log WHERE response_type = 'Prechecked'")
def only_left_keys(spark, d):
    k = attempt_log(spark, d).select("response_type", "student_id", "question_id")
    return k.where("response_type = 'Submit'").drop("response_type").subtract(k.where("response_type = 'Prechecked'").drop("response_type"))


@query("SELECT DISTINCT student_id, course_id FROM log")
def distinct_students(spark, d):
    return attempt_log(spark, d).select("student_id", "course_id").dropDuplicates()


@query("SELECT student_id, dense_rank() OVER (ORDER BY first_row) - 1 AS student_idx FROM (SELECT student_id, min(row_id) AS first_row FROM log GROUP BY student_id)")
def surrogate_ids(spark, d):
    first = attempt_log(spark, d).groupBy("student_id").agg(F.min("row_id").alias("f"))
    return S.ranked(first, F.col("f")).select("student_id", F.col("_rank").alias("student_idx"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS canonical_id FROM documents", log=False)
def dedup_items(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    return docs.join(docs.groupBy("h").agg(F.min("doc_id").alias("canonical_id")), "h").select("doc_id", "canonical_id")


@query("WITH c AS (SELECT student_id, count(*) AS n FROM log GROUP BY student_id), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, student_id) - 1 AS i, (SELECT count(*) FROM c) AS m FROM c) SELECT student_id, n FROM r WHERE i IN (SELECT CAST(floor(k * (m - 1) / 9.0) AS BIGINT) FROM (SELECT unnest(generate_series(0, 9)) AS k), (SELECT max(m) AS m FROM r))")
def spread_students(spark, d):
    c = attempt_log(spark, d).groupBy("student_id").agg(F.count("*").alias("n"))
    places = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.floor(k * (F.col("_rows") - 1) / F.lit(9.0)))
    return S.ranked(c, F.desc("n"), F.col("student_id")).where(F.array_contains(places, F.col("_rank"))).select("student_id", "n")


@query("SELECT DISTINCT student_id FROM log ORDER BY student_id LIMIT 25")
def first_n_students(spark, d):
    return attempt_log(spark, d).select("student_id").distinct().orderBy("student_id").limit(25)


@query("SELECT row_id, ts, student_id FROM log")
def sorted_log(spark, d):
    return attempt_log(spark, d).select("row_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "student_id").orderBy("student_id", "ts", "row_id")


PRED = "pred AS (SELECT o.*, 1 / (1 + exp(-(((item_id * 37 + student_id * 11 + attempt_id * 5) % 21) - 10) / 4.0)) AS p, (item_id * 37 + student_id * 11 + attempt_id * 5) % 21 AS s FROM obs o)"


def predictions(spark, d):
    """Observations with a stand-in prediction that is computed from the keys."""
    s = (F.col("item_id") * 37 + F.col("student_id") * 11 + F.col("attempt_id") * 5) % 21
    return observations(spark, d).withColumn("s", s).withColumn("p", P.sigmoid((F.col("s") - 10) / 4.0))


AUC = "b AS (SELECT {k} s, sum(y) AS pos, sum(1 - y) AS neg FROM pred GROUP BY ALL), c AS (SELECT *, coalesce(sum(neg) OVER ({w} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b)"


@query(f"WITH {PRED}, {AUC.format(k='', w='')} SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 8) AS auc FROM c")
def roc_auc(spark, d):
    return E.whole_auc(predictions(spark, d), p="s").select(F.round("auc", 8).alias("auc"))


METRICS = """round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 8) AS accuracy,
round((sum(CASE WHEN y = 1 AND p >= 0.5 THEN 1.0 ELSE 0 END) / sum(y) + sum(CASE WHEN y = 0 AND p < 0.5 THEN 1.0 ELSE 0 END) / sum(1 - y)) / 2, 8) AS balanced_accuracy,
round(2 * sum(CASE WHEN y = 1 AND p >= 0.5 THEN 1.0 ELSE 0 END) / (sum(y) + sum(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0 END)), 8) AS f1,
round(avg(y * ln(p) + (1 - y) * ln(1 - p)), 8) AS log_likelihood, round(avg((p - y) * (p - y)), 8) AS brier, round(sqrt(avg((p - y) * (p - y))), 8) AS rmse, count(*) AS n"""


def _rounded(df):
    return df.select(*[F.round(c, 8).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {PRED} SELECT {METRICS} FROM pred")
def eval_metrics(spark, d):
    return _rounded(E.binary_metrics(predictions(spark, d), []))


@query(f"WITH {PRED}, {AUC.format(k='attempt_id,', w='PARTITION BY attempt_id')}, m AS (SELECT attempt_id, {METRICS} FROM pred GROUP BY attempt_id HAVING count(*) >= 10), r AS (SELECT attempt_id, round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 8) AS auc FROM c GROUP BY attempt_id) SELECT * FROM m JOIN r USING (attempt_id)")
def metrics_per_attempt(spark, d):
    p = predictions(spark, d)
    return _rounded(E.binary_metrics(p, ["attempt_id"]).where("n >= 10").join(E.roc_auc(p, ["attempt_id"], p="s"), "attempt_id"))


@query(f"WITH {PRED} SELECT round(-avg(y * ln(p) + (1 - y) * ln(1 - p)), 8) AS log_loss, round(avg(y), 8) AS base_rate, round(avg(p), 8) AS mean_p FROM pred")
def metrics_summary(spark, d):
    q = P.clipped(F.col("p"))
    return predictions(spark, d).agg(F.round(-F.avg(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q)), 8).alias("log_loss"), F.round(F.avg("y"), 8).alias("base_rate"), F.round(F.avg("p"), 8).alias("mean_p"))


@query(f"WITH {PRED} SELECT least(CAST(sum(1 - y) AS DOUBLE) / greatest(sum(y), 1), 10) AS pos_weight FROM pred")
def pos_weight(spark, d):
    y = F.col("y")
    return observations(spark, d).agg(F.least(F.sum(1 - y).cast("double") / F.greatest(F.sum(y), F.lit(1)), F.lit(10.0)).alias("pos_weight"))


@query(f"WITH {PRED} SELECT student_id, round(sum(y * (s - 10) / 4.0 - (greatest((s - 10) / 4.0, 0) + ln(1 + exp(-abs((s - 10) / 4.0))))), 6) AS loglik FROM pred GROUP BY student_id")
def bernoulli_loglik(spark, d):
    return predictions(spark, d).groupBy("student_id").agg(F.round(F.sum(P.bernoulli_loglik(F.col("y"), (F.col("s") - 10) / 4.0)), 6).alias("loglik"))


@query(f"WITH {PRED}, m AS (SELECT student_id, item_id, avg(y) AS a, avg(p) AS q FROM pred GROUP BY ALL) SELECT student_id, item_id, row_number() OVER (PARTITION BY student_id ORDER BY item_id) AS n, round(a, 6) AS actual, round(q, 6) AS predicted FROM m")
def student_trajectory(spark, d):
    m = predictions(spark, d).groupBy("student_id", "item_id").agg(F.round(F.avg("y"), 6).alias("actual"), F.round(F.avg("p"), 6).alias("predicted"))
    return m.withColumn("n", F.row_number().over(Window.partitionBy("student_id").orderBy("item_id")).cast("long"))


@query(f"WITH {PRED}, x AS (SELECT week, attempt_id, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS hit, y FROM pred) SELECT week, round(avg(CASE WHEN attempt_id = 0 THEN CAST(hit = y AS INT) END), 6) AS first, round(avg(CASE WHEN attempt_id = 1 THEN CAST(hit = y AS INT) END), 6) AS second FROM x GROUP BY week")
def metrics_pivot(spark, d):
    x = predictions(spark, d).withColumn("ok", ((F.col("p") >= 0.5).cast("long") == F.col("y")).cast("double"))
    wide = x.groupBy("week").pivot("attempt_id", [0, 1]).agg(F.avg("ok"))
    return wide.select("week", F.round("0", 6).alias("first"), F.round("1", 6).alias("second"))


@query(f"WITH {PRED}, x AS (SELECT week, course, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS acc FROM (SELECT *, student_id % 4 AS course FROM pred) GROUP BY ALL) SELECT week, round(avg(acc), 8) AS mean, round(stddev_samp(acc) / sqrt(count(*)), 8) AS sem FROM x GROUP BY week")
def metrics_by_horizon(spark, d):
    x = predictions(spark, d).groupBy("week", (F.col("student_id") % 4).alias("course")).agg(F.avg(((F.col("p") >= 0.5).cast("long") == F.col("y")).cast("double")).alias("acc"))
    return x.groupBy("week").agg(F.round(F.avg("acc"), 8).alias("mean"), F.round(F.stddev_samp("acc") / F.sqrt(F.count("*")), 8).alias("sem"))


@query(f"WITH {PRED}, x AS (SELECT CASE WHEN y = 1 THEN 'right' ELSE 'wrong' END AS real, CASE WHEN p >= 0.5 THEN 'right' ELSE 'wrong' END AS predicted FROM pred) SELECT coalesce(real, 'all') AS real, coalesce(predicted, 'all') AS predicted, count(*) AS n FROM x GROUP BY CUBE (real, predicted)")
def error_flow(spark, d):
    x = predictions(spark, d).select(F.when(F.col("y") == 1, "right").otherwise("wrong").alias("real"), F.when(F.col("p") >= 0.5, "right").otherwise("wrong").alias("predicted"))
    return x.cube("real", "predicted").agg(F.count("*").alias("n")).select(F.coalesce("real", F.lit("all")).alias("real"), F.coalesce("predicted", F.lit("all")).alias("predicted"), "n")


TAU = """WITH g AS (SELECT {k} AS k, student_id, question_id, count(*) AS x, 10 * max(fraction) AS y FROM sub GROUP BY ALL), n AS (SELECT k, count(*) AS n FROM g GROUP BY k HAVING count(*) >= 5),
s AS (SELECT a.k, sum(sign(b.x - a.x) * sign(b.y - a.y)) AS s FROM g a JOIN g b ON a.k = b.k AND (a.student_id, a.question_id) < (b.student_id, b.question_id) GROUP BY a.k),
tx AS (SELECT k, sum(t * (t - 1) / 2.0) AS t FROM (SELECT k, x, count(*) AS t FROM g GROUP BY ALL) GROUP BY k), ty AS (SELECT k, sum(t * (t - 1) / 2.0) AS t FROM (SELECT k, y, count(*) AS t FROM g GROUP BY ALL) GROUP BY k)
SELECT k AS {k}, n, round(s / nullif(sqrt((n * (n - 1) / 2.0 - tx.t) * (n * (n - 1) / 2.0 - ty.t)), 0), 8) + 0.0 AS tau FROM n JOIN s USING (k) JOIN tx USING (k) JOIN ty USING (k)"""


def _tau(spark, d, key):
    g = submissions(spark, d).groupBy("student_id", "question_id").agg(F.count("*").alias("x"), (10 * F.max("fraction")).alias("y"))
    return E.kendall_tau(g, [key], "x", "y").withColumn("tau", F.round("tau", 8))


@query(TAU.format(k="student_id"))
def kendall_tau_by_student(spark, d):
    return _tau(spark, d, "student_id")


@query(TAU.format(k="question_id"))
def kendall_tau_by_question(spark, d):
    return _tau(spark, d, "question_id")



@query("""WITH c AS (SELECT student_id % 5 AS param, student_id % 3 AS chain, row_id AS draw, value FROM log), h AS (SELECT *, ntile(2) OVER (PARTITION BY param, chain ORDER BY draw) AS half FROM c), s AS (SELECT param, chain, half, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM h GROUP BY ALL)
SELECT CAST(param AS VARCHAR) AS param, round(sqrt((avg(n) - 1) / avg(n) + var_samp(m) / avg(v)), 6) AS rhat FROM s GROUP BY param""")
def rhat(spark, d):
    return E.split_rhat(_chains(spark, d)).withColumn("rhat", F.round("rhat", 6))


def _chains(spark, d):
    return attempt_log(spark, d).select((F.col("student_id") % 5).cast("string").alias("param"), (F.col("student_id") % 3).alias("chain"), F.col("row_id").alias("draw"), "value")


@query()
def bootstrap_metrics(spark, d):
    """Intervals of balanced accuracy, F1 and the area under the curve by attempt, from 500 replicates."""
    return E.bootstrap_metrics(predictions(spark, d), ["attempt_id"])


@query()
def bootstrap_metrics_by_course(spark, d):
    """The same by course, from 2,000 replicates."""
    return E.bootstrap_metrics(predictions(spark, d).withColumn("course_id", F.col("student_id") % 4), ["course_id"], replicates=2000)


@query("""WITH c AS (SELECT CAST(student_id % 5 AS VARCHAR) AS param, student_id % 3 AS chain, row_id AS draw, value FROM log), m AS (SELECT *, value - avg(value) OVER (PARTITION BY param, chain) AS v FROM c), k AS (SELECT unnest(generate_series(1, 5)) AS lag), n AS (SELECT *, row_number() OVER (PARTITION BY param, chain ORDER BY draw) AS i FROM m),
s AS (SELECT param, chain, sum(v * v) AS s FROM m GROUP BY ALL) SELECT a.param, a.chain, CAST(k.lag AS BIGINT) AS lag, round(sum(a.v * b.v) / any_value(s.s), 8) + 0.0 AS acf FROM n a CROSS JOIN k JOIN n b ON b.param = a.param AND b.chain = a.chain AND b.i = a.i - k.lag JOIN s ON s.param = a.param AND s.chain = a.chain GROUP BY ALL""")
def autocorrelation(spark, d):
    return E.autocorrelation(_chains(spark, d), 5).withColumn("acf", F.round("acf", 8))


@query()
def chain_summary(spark, d):
    """One row for each parameter: mean, spread, split R-hat, the effective size summed over chains, and the number of draws."""
    c = _chains(spark, d)
    base = c.groupBy("param").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    return base.join(E.split_rhat(c), "param").join(E.effective_size(c), "param")


@query()
def ess(spark, d):
    return E.effective_size(_chains(spark, d))


@query()
def bootstrap_ci(spark, d):
    return E.bootstrap_mean(observations(spark, d), ["attempt_id"], "y")


@query("SELECT vec_id, label, rn, cos FROM (SELECT a.vec_id, b.vec_id AS other, b.label, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS cos, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) DESC, b.vec_id) AS rn FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rn <= 5", log=False)
def embedding_cosine_topk(spark, d):
    v = table(spark, d, "embeddings")
    return R.cosine_topk(v.where("vec_id % 100 = 0"), v, 5).select("vec_id", "label", F.col("rank").alias("rn"), "cos")


TFIDF = f"""WITH t AS (SELECT doc_id, lower(w) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^ -~]', ' ', 'g'), '[A-Za-z]{{2,}}')) AS w FROM documents)), tf AS (SELECT doc_id, w, count(*) AS tf FROM t WHERE w NOT IN ({', '.join(f"'{w}'" for w in R.STOP_WORDS)}) GROUP BY ALL), n AS (SELECT count(DISTINCT doc_id) AS n FROM documents),
idf AS (SELECT w, ln((1.0 + max(n)) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY w ORDER BY sum(tf) DESC, w LIMIT 5000), x AS (SELECT doc_id, w, tf * idf AS v FROM tf JOIN idf USING (w)), u AS (SELECT doc_id, w, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM x),
s AS (SELECT a.doc_id AS query_id, b.doc_id, round(sum(a.v * b.v), 8) AS similarity FROM u a JOIN u b USING (w) WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS rank FROM s WHERE similarity > 0)"""


@query(TFIDF + " SELECT query_id, doc_id, similarity, rank FROM r WHERE rank <= 5", log=False)
def tfidf_similarity(spark, d):
    return R.tfidf_topk(table(spark, d, "documents"), F.col("doc_id") % 100 == 0, 5)


@query(TFIDF + """, p AS (SELECT a.doc_id AS query_id, b.doc_id FROM (SELECT DISTINCT doc_id FROM u WHERE doc_id % 100 = 0) a, (SELECT DISTINCT doc_id FROM u) b WHERE a.doc_id <> b.doc_id),
z AS (SELECT query_id, doc_id, 0.5 * coalesce(similarity, 0) + 0.5 * exp(-0.693 * abs(query_id - doc_id) / 28.0) AS score FROM p LEFT JOIN s USING (query_id, doc_id)), y AS (SELECT query_id, doc_id, round(score, 7) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 7) DESC, doc_id) AS rank FROM z) SELECT * FROM y WHERE rank <= 5""", log=False)
def retrieve_similar(spark, d):
    """Half similarity, half recency with a half-life of 28 days; the distance of ids stands for days."""
    score = lambda s, q, o: 0.5 * np.round(s, 8) + 0.5 * np.exp(-0.693 * np.abs(q - o) / 28.0)
    return R.tfidf_topk(table(spark, d, "documents"), F.col("doc_id") % 100 == 0, 5, score, digits=7).withColumnRenamed("similarity", "score")


@query("WITH r AS (SELECT student_id, row_id, round(exp(-0.693 * (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 8.64e10 / 28), 8) AS weight, row_number() OVER (PARTITION BY student_id ORDER BY ts DESC, row_id DESC) AS rank FROM sub) SELECT * FROM r WHERE rank <= 5")
def retrieve_recent(spark, d):
    age = (F.unix_micros(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros("ts")) / 8.64e10
    return S.top_k(submissions(spark, d), 5, ["student_id"], F.desc("ts"), F.desc("row_id")).select("student_id", "row_id", F.round(P.recency_weight(age), 8).alias("weight"), "rank")
