"""Latent-trait estimators and small user-function surfaces, distributed by learner or item."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learntrail.functions.parsing import sigmoid, smoothed, uniform
from learntrail.sources.tables import checkpointed, dealt

#: A table of at most so many parameters is copied to the tasks instead of shuffling the answers.
MOST_COPIED = 200_000


def copied(params: DataFrame) -> DataFrame:
    """``params``, to be broadcast if there are few of them: the join's other side then stays where it is."""
    return F.broadcast(params) if params.count() <= MOST_COPIED else params


def elo(obs: DataFrame, train_weeks: int, k: float = 0.4) -> DataFrame:
    """Sequential ratings with fixed item difficulty from the training weeks, one ordered fold a learner inside the JVM.

    Difficulties are the items' failure logits, so learners are independent and no task holds more than a learner. The
    reference also updates an item at each answer and predicts the later weeks; that needs a whole course in one ordered
    group and is left out.
    """
    return _elo(obs.where(F.col("week") <= train_weeks), _failure_logits(obs, train_weeks), k)


def _failure_logits(obs: DataFrame, train_weeks: int) -> DataFrame:
    p = F.least(F.lit(0.99), F.greatest(F.lit(0.01), F.avg("y")))
    return copied(checkpointed(obs.where(F.col("week") <= train_weeks).groupBy("item_id").agg((-F.ln(p / (1 - p))).alias("b"))))


def _elo(train: DataFrame, item: DataFrame, k: float) -> DataFrame:
    steps = train.join(item, "item_id").groupBy("student_id").agg(F.array_sort(F.collect_list(F.struct("t_days", "item_id", "attempt_id", "y", "b"))).alias("s"))
    theta = F.aggregate("s", F.lit(0.0), lambda t, x: t + k * (x["y"] - 1 / (1 + F.exp(x["b"] - t))))
    return steps.select("student_id", theta.alias("theta"), F.size("s").cast("long").alias("n"))


def elo_predictions(obs: DataFrame, train_weeks: int, k: float = 0.4) -> DataFrame:
    """``student_id, item_id, attempt_id, y, p`` for the weeks after training: the learner's rating after it against the item's
    difficulty, 0 for learners and items that training didn't see."""
    item = _failure_logits(obs, train_weeks)
    theta = _elo(obs.where(F.col("week") <= train_weeks), item, k).select("student_id", "theta")
    later = obs.where(F.col("week") > train_weeks).join(theta, "student_id", "left").join(item, "item_id", "left")
    return later.select("student_id", "item_id", "attempt_id", "y", sigmoid(F.coalesce("theta", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))).alias("p"))


def calibrated(obs: DataFrame, rounds: int = 12, prior: float = 1.0, slope: bool = False, eps: float = 0.01) -> DataFrame:
    """``student_id, theta, growth`` of learners whose items are known: rows ``student_id, y, t, offset`` with the logit's known part.

    Labels are smoothed by ``eps``. Newton steps with normal priors, each one aggregation by learner; ``growth`` is 0 unless
    ``slope``. Learners are independent, so nothing but their own answers decides.
    """
    obs = checkpointed(obs.select("student_id", smoothed(F.col("y"), eps).alias("y"), F.col("t").cast("double").alias("t"), "offset"))
    state = obs.select("student_id").distinct().withColumn("theta", F.lit(0.0)).withColumn("growth", F.lit(0.0))
    damped = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    for _ in range(rounds):
        p = sigmoid(F.col("theta") + F.col("growth") * F.col("t") + F.col("offset"))
        w, e, t = p * (1 - p), F.col("y") - p, F.col("t")
        sums = obs.join(state, "student_id").groupBy("student_id", "theta", "growth").agg(F.sum(e).alias("g0"), F.sum(e * t).alias("g1"), F.sum(w).alias("h00"), F.sum(w * t).alias("h01"), F.sum(w * t * t).alias("h11"))
        g0, g1, h00, h01, h11 = F.col("g0") - prior * F.col("theta"), F.col("g1") - prior * F.col("growth"), F.col("h00") + prior, F.col("h01"), F.col("h11") + prior
        det = h00 * h11 - h01 * h01
        steps = (damped((h11 * g0 - h01 * g1) / det), damped((h00 * g1 - h01 * g0) / det)) if slope else (damped(g0 / h00), F.lit(0.0))
        state = checkpointed(sums.select("student_id", (F.col("theta") + steps[0]).alias("theta"), (F.col("growth") + steps[1]).alias("growth")))
    return state


def rasch(responses: DataFrame, rounds: int = 6, prior: float = 1.0, eps: float = 0.01, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """One-parameter logistic model by alternating damped Newton steps with a normal prior; labels are smoothed by ``eps``, responses are counted first.

    Every step is an aggregation by learner or by item over (learner, item) counts, which lie dealt by learner, so that only
    sums by item are shuffled. Returns abilities and difficulties. Rows may be counted already, several for a learner and item
    too: ``n`` answers, of which ``right`` were right, instead of ``y``. Each value of the columns ``by`` has a fit of its own, and its rows in the results.
    """
    who, what = [*by, "student_id"], [*by, "item_id"]
    if "n" not in responses.columns:
        responses = responses.groupBy(*who, "item_id").agg(F.count("*").alias("n"), F.sum("y").alias("right"))
    with dealt(responses, who) as counts:
        counts = counts.withColumn("r", F.col("right") * (1 - 2 * eps) + F.col("n") * eps)
        ability = counts.select(*who).distinct().withColumn("theta", F.lit(0.0))
        item = copied(checkpointed(counts.select(*what).distinct().withColumn("b", F.lit(0.0))))
        for _ in range(rounds):
            both = counts.join(ability, who).join(item, what).withColumn("p", 1 / (1 + F.exp(F.col("b") - F.col("theta"))))
            step = both.groupBy(*who, "theta").agg(F.sum(F.col("r") - F.col("n") * F.col("p")).alias("g"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"))
            ability = checkpointed(step.select(*who, (F.col("theta") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("g") - prior * F.col("theta")) / (F.col("h") + prior)))).alias("theta")))
            both = counts.join(ability, who).join(item, what).withColumn("p", 1 / (1 + F.exp(F.col("b") - F.col("theta"))))
            step = both.groupBy(*what, "b").agg(F.sum(F.col("n") * F.col("p") - F.col("r")).alias("g"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("h"))
            item = copied(checkpointed(step.select(*what, (F.col("b") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("g") / (F.col("h") + 1e-6)))).alias("b"))))
    return ability, item


def trend_model(obs: DataFrame, trend_on: str, level_on: str, rounds: int = 6, prior: float = 1.0, many: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Logistic model ``start + slope * t + level`` of ``y`` by alternating damped Newton steps with normal priors.

    ``start`` and ``slope`` belong to ``trend_on`` and are solved together, ``level`` belongs to ``level_on``; ``t`` lies in
    [0, 1]. Every step is one aggregation by key, so no group is gathered. Rows lie dealt by ``many``, the one of the two keys
    with more values (``level_on`` if not given); sums by the other alone are shuffled. Rows with a null among the columns
    are left out.
    """
    many = many or level_on
    damped = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))
    held = lambda key, state: state if key == many else copied(state)
    with dealt(obs.select(trend_on, level_on, "y", F.col("t").cast("double").alias("t")).dropna(), [many]) as obs:
        obs = obs.withColumn("y", F.col("y").cast("double"))
        trend = held(trend_on, checkpointed(obs.select(trend_on).distinct().withColumn("start", F.lit(0.0)).withColumn("slope", F.lit(0.0))))
        level = held(level_on, checkpointed(obs.select(level_on).distinct().withColumn("level", F.lit(0.0))))
        for _ in range(rounds):
            both = obs.join(trend, trend_on).join(level, level_on).withColumn("p", sigmoid(F.col("start") + F.col("slope") * F.col("t") + F.col("level")))
            w, e, t = F.col("p") * (1 - F.col("p")), F.col("y") - F.col("p"), F.col("t")
            sums = both.groupBy(trend_on, "start", "slope").agg(F.sum(e).alias("g0"), F.sum(e * t).alias("g1"), F.sum(w).alias("h00"), F.sum(w * t).alias("h01"), F.sum(w * t * t).alias("h11"))
            g0, g1, h00, h01, h11 = F.col("g0") - prior * F.col("start"), F.col("g1") - prior * F.col("slope"), F.col("h00") + prior, F.col("h01"), F.col("h11") + prior
            det = h00 * h11 - h01 * h01
            trend = held(trend_on, checkpointed(sums.select(trend_on, (F.col("start") + damped((h11 * g0 - h01 * g1) / det)).alias("start"), (F.col("slope") + damped((h00 * g1 - h01 * g0) / det)).alias("slope"))))
            both = obs.join(trend, trend_on).join(level, level_on).withColumn("p", sigmoid(F.col("start") + F.col("slope") * F.col("t") + F.col("level")))
            sums = both.groupBy(level_on, "level").agg(F.sum(e).alias("g"), F.sum(w).alias("h"))
            level = held(level_on, checkpointed(sums.select(level_on, (F.col("level") + damped((F.col("g") - prior * F.col("level")) / (F.col("h") + prior))).alias("level"))))
    return trend, level


def predict(responses: DataFrame, ability: DataFrame, item: DataFrame) -> DataFrame:
    return responses.select("student_id", "item_id").distinct().join(ability, "student_id").join(item, "item_id").select("student_id", "item_id", (1 / (1 + F.exp(F.col("b") - F.col("theta")))).alias("p"))


def _forward(y: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mastery before each attempt and the chance of a right answer, for one learner's answers."""
    known, learn, guess, slip = p
    mastery, right = np.empty(len(y)), np.empty(len(y))
    for k, answer in enumerate(y):
        mastery[k], right[k] = known, known * (1 - slip) + (1 - known) * guess
        post = known * (1 - slip) / right[k] if answer else known * slip / (1 - right[k])
        known = post + (1 - post) * learn
    return mastery, right


def bkt_fit(obs: DataFrame, rounds: int = 50) -> DataFrame:
    """Knowledge-tracing parameters of each item by expectation maximisation; equal answer sequences are counted first,
    so an item's group holds its distinct sequences and not its learners."""
    return _bkt_fit(_sequences(obs), rounds)


def _sequences(obs: DataFrame) -> DataFrame:
    """``item_id, student_id, seq``: a learner's answers to an item in order."""
    return obs.groupBy("item_id", "student_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attempt_id", "y"))), lambda x: x["y"].cast("string")), "").alias("seq"))


def _bkt_fit(seqs: DataFrame, rounds: int = 50) -> DataFrame:
    # the fits are long and their rows few: dealt in a fixed number, or they would be put together in one task
    counted = seqs.groupBy("item_id", "seq").agg(F.count("*").alias("n")).repartition(4 * seqs.sparkSession.sparkContext.defaultParallelism, "item_id")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        p = np.array([0.3, 0.1, 0.2, 0.1])
        batches = [(np.array([np.frombuffer(x.encode(), np.uint8) - 48 for x in own.seq], np.float64), own.n.to_numpy(float)) for _, own in group.groupby(group.seq.str.len())]
        for _ in range(rounds):
            total = np.zeros(8)
            for y, n in batches:  # sequences of one length together
                a = np.array([[1 - p[1], p[1]], [0, 1]])
                e = np.stack([np.where(y == 1, p[2], 1 - p[2]), np.where(y == 1, 1 - p[3], p[3])], 2)
                f, b = np.zeros(e.shape), np.ones(e.shape)
                f[:, 0] = np.array([1 - p[0], p[0]]) * e[:, 0]
                f[:, 0] /= f[:, 0].sum(1, keepdims=True)
                for k in range(1, y.shape[1]):
                    f[:, k] = f[:, k - 1] @ a * e[:, k]
                    f[:, k] /= f[:, k].sum(1, keepdims=True)
                for k in range(y.shape[1] - 2, -1, -1):
                    b[:, k] = (e[:, k + 1] * b[:, k + 1]) @ a.T
                    b[:, k] /= b[:, k].sum(1, keepdims=True)
                g = f * b
                g /= g.sum(2, keepdims=True)
                later = e[:, 1:] * b[:, 1:]
                moved = f[:, :-1, 0] * p[1] * later[:, :, 1]
                kept = f[:, :-1, 0] * (1 - p[1]) * later[:, :, 0] + f[:, :-1, 1] * later[:, :, 1]
                parts = (g[:, 0, 1], np.ones(len(n)), (moved / (moved + kept)).sum(1), g[:, :-1, 0].sum(1), (g[:, :, 0] * y).sum(1), g[:, :, 0].sum(1), (g[:, :, 1] * (1 - y)).sum(1), g[:, :, 1].sum(1))
                total += np.array([n @ x for x in parts])
            p = np.clip(total[::2] / np.maximum(total[1::2], 1e-9), 0.01, 0.99)
        return pd.DataFrame([[group.item_id.iloc[0], *p]], columns=["item_id", "known", "learn", "guess", "slip"])

    return counted.groupBy("item_id").applyInPandas(fit, "item_id long, known double, learn double, guess double, slip double")


def bkt_forward(obs: DataFrame, params: DataFrame) -> DataFrame:
    """Mastery of each learner at each item after all attempts, as a fold inside the JVM, and the chance ``p`` of a right next answer."""
    return _mastered(obs.groupBy("item_id", "student_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("attempt_id", "y"))), lambda x: x["y"]).alias("s")), params).select("student_id", "item_id", "mastery", "p")


def _mastered(seqs: DataFrame, params: DataFrame) -> DataFrame:
    """Rows ``item_id, s`` with ``mastery`` after the answers ``s`` and the chance ``p`` of a right next one."""

    def step(k: Column, y: Column) -> Column:
        right = k * (1 - F.col("slip")) + (1 - k) * F.col("guess")
        post = F.when(y == 1, k * (1 - F.col("slip")) / right).otherwise(k * F.col("slip") / (1 - right))
        return post + (1 - post) * F.col("learn")

    after = seqs.join(params, "item_id").withColumn("mastery", F.aggregate("s", F.col("known"), step))
    return after.withColumn("p", F.col("mastery") * (1 - F.col("slip")) + (1 - F.col("mastery")) * F.col("guess"))


def bkt_later(obs: DataFrame, train_weeks: int) -> DataFrame:
    """``student_id, item_id, attempt_id, y, p`` for the weeks after training, whose items have no parameters of their own: a
    learner starts from the mean mastery of the items seen, with the mean parameters of all items."""
    with dealt(_sequences(obs.where(F.col("week") <= train_weeks)), ["student_id"]) as seqs:
        params = checkpointed(_bkt_fit(seqs))
        mean = params.agg(*[F.avg(c).alias(c) for c in ("known", "guess", "slip")])
        distinct = seqs.select("item_id", "seq").distinct().withColumn("s", F.transform(F.split("seq", ""), lambda x: x.cast("long")))
        after = copied(checkpointed(_mastered(distinct, copied(params)).select("item_id", "seq", "mastery")))  # equal sequences have one mastery
        seen = checkpointed(seqs.join(after, ["item_id", "seq"]).groupBy("student_id").agg(F.avg("mastery").alias("mastery")))
    later = obs.where(F.col("week") > train_weeks).join(seen, "student_id", "left").join(F.broadcast(mean))  # one row
    m = F.coalesce("mastery", "known")
    return later.select("student_id", "item_id", "attempt_id", "y", (m * (1 - F.col("slip")) + (1 - m) * F.col("guess")).alias("p"))


def rbf(gap: Column, scale: float) -> Column:
    return F.exp(-(gap * gap) / (2 * scale * scale))


def matern52(gap: Column, scale: float) -> Column:
    r = F.sqrt(F.lit(5.0)) * F.abs(gap) / scale
    return (1 + r + r * r / 3) * F.exp(-r)


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.links, self.skip = [], 0, 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.links += tag == "a" and any(k == "href" for k, _ in attrs)

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.parts.append(" ".join(data.split()))


def html_text(pages: DataFrame) -> DataFrame:
    """``page_id, text, n_links`` of raw pages, parsed batch by batch; null pages are empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, html in zip(batch.page_id, batch.html, strict=True):
                parser = _Text()
                parser.feed(html or "")
                rows.append((key, "\n".join(parser.parts), parser.links))
            yield pd.DataFrame(rows, columns=["page_id", "text", "n_links"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string, n_links long")


def clusters(df: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    """K-means on columns scaled to [0, 1]."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import MinMaxScaler, VectorAssembler

    df = checkpointed(df.select("student_id", *columns))  # read once for the scaling, once for the means and once for the result
    x = VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip").transform(df)
    x = MinMaxScaler(inputCol="raw", outputCol="features").fit(x).transform(x)
    return KMeans(k=k, seed=seed).fit(x).transform(x).select("student_id", F.col("prediction").alias("cluster"))


def student_split(students: DataFrame, train: float = 0.55, valid: float = 0.15, seed: int = 42) -> DataFrame:
    """Roles by a seeded hash of the id: the same at every size and partitioning, without gathering ids."""
    u = uniform(seed, "student_id")
    return students.select("student_id", F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test").alias("role"))
