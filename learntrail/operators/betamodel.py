"""Response model of the share of tests passed, with a Beta likelihood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learntrail.functions.parsing import sigmoid, smoothed
from learntrail.functions.special import digamma, log_gamma, trigamma
from learntrail.sources.tables import checkpointed

#: The mean is kept so far from 0 and 1.
EDGE = 1e-6


def _mean() -> tuple[Column, Column, Column]:
    """The Beta's mean, and the two sigmoids it is made of: ceiling times progress."""
    ceiling, progress = sigmoid(F.col("ceiling")), sigmoid(F.col("rate") * F.col("t") - F.col("z"))
    return F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), ceiling * progress)), ceiling, progress


def beta_loglik(y: Column, mean: Column, concentration: float) -> Column:
    """The log-density of ``y`` under the Beta of a mean and a concentration."""
    a, b = mean * concentration, (1 - mean) * concentration
    return log_gamma(F.lit(float(concentration))) - log_gamma(a) - log_gamma(b) + (a - 1) * F.ln(y) + (b - 1) * F.ln(1 - y)


def beta_trend(rows: DataFrame, rounds: int = 10, concentration: float = 10.0, prior: float = 1.0, eps: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """Learners' ``student_id, rate, ceiling`` and questions' ``question_id, z`` of rows ``student_id, question_id, y, t``.

    ``y``, a share in [0, 1] drawn in by ``eps``, is Beta with mean ``sigmoid(ceiling) * sigmoid(rate * t - z)`` and a fixed
    concentration; the parameters have normal priors about 0 (precision ``prior``). Alternating damped Fisher scoring: a
    half-round takes the score and the expected information of each learner (two parameters together) or each question from one
    aggregation by key, so no group is gathered. Rows with nulls are left out; no rows give no parameters.
    """
    obs = rows.select("student_id", "question_id", smoothed(F.col("y").cast("double"), eps).alias("y"), F.col("t").cast("double").alias("t")).dropna()
    obs = checkpointed(obs)
    learner = obs.select("student_id").distinct().withColumns({"rate": F.lit(0.0), "ceiling": F.lit(0.0)})
    question = obs.select("question_id").distinct().withColumn("z", F.lit(0.0))
    damped = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))

    def scored() -> DataFrame:
        """Each row's derivative of the log-density by the mean, its information, and the mean's derivatives by rate, ceiling and z."""
        mean, ceiling, progress = _mean()
        both = obs.join(learner, "student_id").join(question, "question_id").select("*", mean.alias("m"), ceiling.alias("c"), progress.alias("s"))
        a, b = F.col("m") * concentration, (1 - F.col("m")) * concentration
        slope = concentration * (digamma(b) - digamma(a) + F.ln("y") - F.ln(1 - F.col("y")))
        inner = F.col("c") * F.col("s") * (1 - F.col("s"))
        return both.select("*", slope.alias("e"), (concentration**2 * (trigamma(a) + trigamma(b))).alias("w"), (inner * F.col("t")).alias("d_rate"), (F.col("c") * (1 - F.col("c")) * F.col("s")).alias("d_ceiling"), (-inner).alias("d_z"))

    for _ in range(rounds):
        d0, d1, e, w = F.col("d_rate"), F.col("d_ceiling"), F.col("e"), F.col("w")
        sums = scored().groupBy("student_id", "rate", "ceiling").agg(F.sum(e * d0).alias("g0"), F.sum(e * d1).alias("g1"), F.sum(w * d0 * d0).alias("h00"), F.sum(w * d0 * d1).alias("h01"), F.sum(w * d1 * d1).alias("h11"))
        g0, g1, h00, h01, h11 = F.col("g0") - prior * F.col("rate"), F.col("g1") - prior * F.col("ceiling"), F.col("h00") + prior, F.col("h01"), F.col("h11") + prior
        det = h00 * h11 - h01 * h01
        learner = checkpointed(sums.select("student_id", (F.col("rate") + damped((h11 * g0 - h01 * g1) / det)).alias("rate"), (F.col("ceiling") + damped((h00 * g1 - h01 * g0) / det)).alias("ceiling")))
        sums = scored().groupBy("question_id", "z").agg(F.sum(e * F.col("d_z")).alias("g"), F.sum(w * F.col("d_z") * F.col("d_z")).alias("h"))
        question = checkpointed(sums.select("question_id", (F.col("z") + damped((F.col("g") - prior * F.col("z")) / (F.col("h") + prior))).alias("z")))
    return learner, question


def beta_score(rows: DataFrame, learner: DataFrame, question: DataFrame, concentration: float = 10.0, eps: float = 0.01) -> DataFrame:
    """One row: the mean log-density of the rows under the parameters, and their number."""
    obs = rows.select("student_id", "question_id", smoothed(F.col("y").cast("double"), eps).alias("y"), F.col("t").cast("double").alias("t")).dropna()
    both = obs.join(learner, "student_id").join(question, "question_id")
    return both.agg(F.avg(beta_loglik(F.col("y"), _mean()[0], concentration)).alias("loglik"), F.count("*").alias("n"))
