"""Queries of estimators, nested sources and user-function surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrail.functions import special
from learntrail.functions.parsing import sigmoid
from learntrail.operators import betamodel as B
from learntrail.operators import estimators as M
from learntrail.operators import posterior as G
from learntrail.operators import recurrent as N
from learntrail.operators import sequence as S
from learntrail.plans.attempts import behavior_metrics
from learntrail.plans.log import attempt_log, observations, query, submissions, table
from learntrail.sources.tables import checkpointed

#: Gibbs sweeps of the queries, and how many of them are left out of the means, as in the reference.
SWEEPS, WARMUP = 2500, 500


@query()
def elo_ratings(spark: SparkSession, d: str) -> DataFrame:
    return M.elo(observations(spark, d), train_weeks=3)


@query()
def elo_predictions(spark, d):
    """Chances of right answers in the weeks after the third."""
    return M.elo_predictions(observations(spark, d), 3)


@query()
def irt_student_split(spark, d):
    """Held-out learners calibrated on the first three weeks against difficulties of training learners, and their later answers' chances."""
    o = _roles(spark, d)
    _, item = M.rasch(o.where("role = 'train'").select("student_id", "item_id", "y"))
    known = o.where("role = 'test'").join(item, "item_id").withColumn("offset", -F.col("b"))
    return _predicted(known, M.calibrated(known.where("week <= 3").withColumn("t", F.lit(0.0))))


@query()
def cirt_student_split(spark, d):
    """The same with items whose difficulty drifts with the attempt's time."""
    o = _roles(spark, d)
    trend, _ = M.trend_model(o.where("role = 'train'"), "item_id", "student_id")
    known = o.where("role = 'test'").join(trend, "item_id").withColumn("offset", F.col("start") + F.col("slope") * F.col("t")).drop("start", "slope")
    return _predicted(known, M.calibrated(known.where("week <= 3")))


@query()
def dirt_student_split(spark, d):
    """The same with learners whose ability grows with time."""
    o = _roles(spark, d)
    _, level = M.trend_model(o.where("role = 'train'"), "student_id", "item_id", many="student_id")
    known = o.where("role = 'test'").join(level, "item_id").withColumn("offset", F.col("level"))
    return _predicted(known, M.calibrated(known.where("week <= 3"), slope=True))


def _roles(spark, d):
    o = observations(spark, d)
    last = F.broadcast(o.agg(F.max("t_days").alias("last")))  # one row
    return checkpointed(o.join(last, how="cross").withColumn("t", F.col("t_days") / F.col("last")).join(M.student_split(o.select("student_id").distinct()), "student_id"))


def _predicted(known, ability):
    """The later answers of calibrated learners with their chances."""
    p = sigmoid(F.col("theta") + F.col("growth") * F.col("t") + F.col("offset"))
    return known.where("week > 3").join(ability, "student_id").select("student_id", "item_id", "attempt_id", "y", p.alias("p"))


@query()
def irt_item_params(spark, d):
    return M.rasch(_responses(spark, d))[1]


@query()
def irt_predict(spark, d):
    r = _responses(spark, d)
    ability, item = M.rasch(r)
    return M.predict(r, ability, item)


def _responses(spark, d):
    return observations(spark, d).select("student_id", "item_id", "y")


def _timed(spark, d):
    """Answers with the share of the log's days that had passed."""
    o = observations(spark, d)
    return o.join(F.broadcast(o.agg(F.max("t_days").alias("last"))), how="cross").select("student_id", "item_id", "y", (F.col("t_days") / F.col("last")).alias("t"))


@query()
def cirt_params(spark, d):
    """Items whose difficulty changes with time: ability - difficulty - drift * t."""
    trend, _ = M.trend_model(_timed(spark, d), "item_id", "student_id")
    return trend.select("item_id", (-F.col("start")).alias("difficulty"), (-F.col("slope")).alias("drift"))


@query()
def dirt_params(spark, d):
    """Learners whose ability grows with time: ability + growth * t - difficulty."""
    trend, _ = M.trend_model(_timed(spark, d), "student_id", "item_id", many="student_id")
    return trend.select("student_id", F.col("start").alias("ability"), F.col("slope").alias("growth"))


@query()
def bkt_params(spark, d):
    return M.bkt_fit(observations(spark, d))


@query()
def bkt_mastery(spark, d):
    o = observations(spark, d)
    return M.bkt_forward(o, M.bkt_fit(o))


@query()
def bkt_global(spark, d):
    """The mean parameters over all items."""
    return M.bkt_fit(observations(spark, d)).agg(*[F.avg(c).alias(c) for c in ("known", "learn", "guess", "slip")])


@query()
def bkt_student_mastery(spark, d):
    """Each learner's mean mastery over the items seen."""
    return bkt_mastery(spark, d).groupBy("student_id").agg(F.avg("mastery").alias("mastery"), F.count("*").alias("n_items"))


@query()
def bkt_predictions(spark, d):
    return M.bkt_later(observations(spark, d), 3)


@query("SELECT a.i, b.i AS j, round(exp(-(a.i - b.i) * (a.i - b.i) / 8.0), 9) AS rbf, round((1 + sqrt(5) * abs(a.i - b.i) / 2 + 5 * (a.i - b.i) * (a.i - b.i) / 12.0) * exp(-sqrt(5) * abs(a.i - b.i) / 2), 9) AS matern FROM (SELECT CAST(n_nationkey AS BIGINT) AS i FROM nation) a, (SELECT CAST(n_nationkey AS BIGINT) AS i FROM nation) b", log=False)
def gp_kernel(spark, d):
    t = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"))
    grid = t.agg(F.collect_set("i").alias("js"))  # the kernel's own points: the matrix has a row and a column for each
    x = t.join(F.broadcast(grid)).withColumn("j", F.explode("js"))
    return x.select("i", "j", F.round(M.rbf(F.col("i") - F.col("j"), 2.0), 9).alias("rbf"), F.round(M.matern52(F.col("i") - F.col("j"), 2.0), 9).alias("matern"))


@query()
def html_to_text(spark, d):
    return M.html_text(table(spark, d, "pages"))


@query()
def behavior_clusters(spark, d):
    """Learners in four groups by the pauses, edits and numbers of their attempts."""
    return M.clusters(behavior_metrics(spark, d), ["mean_delta", "mean_edit", "n"], 4)


@query("SELECT DISTINCT item_id, CASE WHEN week <= 3 THEN 'calibration' ELSE 'prediction' END AS role FROM obs")
def split_items(spark, d):
    """Items of the first weeks calibrate, later ones are predicted."""
    return observations(spark, d).select("item_id", F.when(F.col("week") <= 3, "calibration").otherwise("prediction").alias("role")).distinct()


@query("SELECT student_id, row_number() OVER (ORDER BY md5('42:' || student_id), student_id) - 1 AS place FROM (SELECT DISTINCT student_id FROM log)")
def shuffled_students(spark, d):
    """A seeded order of the learners."""
    s = attempt_log(spark, d).select("student_id").distinct()
    return S.ranked(s, F.md5(F.concat(F.lit("42:"), F.col("student_id").cast("string"))), F.col("student_id")).select("student_id", F.col("_rank").alias("place"))


UNIFORM = "CAST(CAST('0x' || substr(md5('{seed}' || {key}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296"


@query("SELECT student_id, CASE WHEN u < 0.55 THEN 'train' WHEN u < 0.55 + 0.15 THEN 'valid' ELSE 'test' END AS role FROM (SELECT student_id, " + UNIFORM.format(seed="42:", key="student_id") + " AS u FROM (SELECT DISTINCT student_id FROM obs))")
def student_split(spark, d):
    return M.student_split(observations(spark, d).select("student_id").distinct())


@query()
def gpirt_posterior(spark, d):
    """Easiness of items under the Gaussian-process model of the first three weeks: mean, spread, and split R-hat of two chains."""
    _, traces = G.gp_posterior(observations(spark, d).where("week <= 3"), sweeps=SWEEPS, warmup=WARMUP)
    return G.split_rhat(traces, WARMUP)


@query()
def gpirt_predictions(spark, d):
    """Chances of right answers in the weeks after the third by the posterior abilities at the end of it."""
    o = observations(spark, d)
    learners, _ = G.gp_posterior(o.where("week <= 3"), sweeps=SWEEPS, warmup=WARMUP)
    return G.gp_predictions(learners, o.where("week > 3"))


@query()
def dkt_predictions(spark, d):
    """Chances of right answers after the third week by a recurrent network over the answers before."""
    return N.answer_predictions(observations(spark, d), 3, hidden=16, epochs=10)


def _shares(spark, d):
    """Attempts of the first three weeks: the share of tests passed and the share of the log's days that had passed."""
    s = submissions(spark, d).where("week <= 3").withColumn("day", F.unix_micros("ts") / 8.64e10)
    span = F.broadcast(s.agg(F.min("day").alias("first"), F.max("day").alias("last")))  # one row
    return s.join(span, how="cross").select("student_id", "question_id", F.col("fraction").alias("y"), ((F.col("day") - F.col("first")) / F.greatest(F.col("last") - F.col("first"), F.lit(1e-9))).alias("t"))


@query()
def cirt_beta_params(spark, d):
    """Questions' difficulty where shares of tests passed are Beta distributed about ceiling times progress."""
    return B.beta_trend(_shares(spark, d), rounds=5)[1].select("question_id", F.col("z").alias("difficulty"))


@query()
def cirt_beta_learners(spark, d):
    """Learners' rate of progress and ceiling under the same model."""
    return B.beta_trend(_shares(spark, d), rounds=5)[0].select("student_id", "rate", sigmoid(F.col("ceiling")).alias("ceiling"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(lgamma(l_quantity), 6) AS of_quantity, round(lgamma(l_extendedprice / 1000), 6) AS of_price FROM lineitem", log=False)
def log_gamma(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(special.log_gamma(F.col("l_quantity")), 6).alias("of_quantity"), F.round(special.log_gamma(F.col("l_extendedprice") / 1000), 6).alias("of_price"))
