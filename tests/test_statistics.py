"""Special functions, the Beta model, rank correlation, exact quantiles and chain statistics against plain code."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from learntrail.functions import special
from learntrail.operators import betamodel as B
from learntrail.operators import evaluation as E
from learntrail.operators.selection import exact_quantiles, from_bits, ordered_bits


def bernoulli_reference(x, order):
    """digamma (order 0) and trigamma (order 1) by a recurrence to 60 and a series in exact fractions' floats."""
    x, out = float(x), 0.0
    while x < 60:
        out += -1 / x if order == 0 else 1 / x**2
        x += 1
    if order == 0:
        return out + math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6) + 1 / (240 * x**8)
    return out + 1 / x + 1 / (2 * x**2) + 1 / (6 * x**3) - 1 / (30 * x**5) + 1 / (42 * x**7) - 1 / (30 * x**9)


def test_special_functions(spark):
    xs = [*np.logspace(-3, 6, 400).tolist(), 0.5, 1.0, 2.0, 7.999999, 8.0, 8.000001, 1.4616321449683622]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.log_gamma(F.col("x")).alias("g"), special.digamma(F.col("x")).alias("d"), special.trigamma(F.col("x")).alias("t")).collect()
    for r in rows:
        for got, want in ((r.g, math.lgamma(r.x)), (r.d, bernoulli_reference(r.x, 0)), (r.t, bernoulli_reference(r.x, 1))):
            assert abs(got - want) <= 1e-10 * max(1.0, abs(want)), (r.x, got, want)
    below = spark.createDataFrame([(-0.5,), (-1.3,), (-7.7,), (0.0,), (-2.0,), (float("nan"),), (None,)], "x double")
    got = below.select("x", special.log_gamma(F.col("x")).alias("g"), special.digamma(F.col("x")).alias("d"), special.trigamma(F.col("x")).alias("t")).collect()
    for r in got[:3]:
        assert abs(r.g - math.lgamma(r.x)) < 1e-10
        h = 1e-5
        assert abs(r.d - (math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h)) < 1e-6
        assert abs(r.t - (math.lgamma(r.x + 1e-3) - 2 * math.lgamma(r.x) + math.lgamma(r.x - 1e-3)) / 1e-6) < 1e-3 * max(1, abs(r.t))
    assert all(r.g is None and r.d is None and r.t is None for r in got[3:])


def test_beta_model_reaches_the_optimum(spark):
    rng = np.random.default_rng(3)
    rows = [(s, q, float(rng.choice([0, 0.3, 0.5, 0.8, 1])), float(rng.random())) for s in range(6) for q in range(4) for _ in range(3)]
    df = spark.createDataFrame(rows, "student_id long, question_id long, y double, t double").repartition(3)
    learner, question = B.beta_trend(df, rounds=9, prior=20.0)
    par = {**{("r", r.student_id): r.rate for r in learner.collect()}, **{("c", r.student_id): r.ceiling for r in learner.collect()}, **{("z", r.question_id): r.z for r in question.collect()}}

    def value(p):
        total = -10 * sum(v * v for v in p.values())
        for s, q, y, t in rows:
            y = y * 0.98 + 0.01
            m = 1 / (1 + math.exp(-p["c", s])) / (1 + math.exp(p["z", q] - p["r", s] * t))
            a, b = 10 * m, 10 * (1 - m)
            total += math.lgamma(10) - math.lgamma(a) - math.lgamma(b) + (a - 1) * math.log(y) + (b - 1) * math.log(1 - y)
        return total

    for key in par:
        up, down = ({**par, key: par[key] + h} for h in (1e-4, -1e-4))
        assert abs(value(up) - value(down)) / 2e-4 < 0.1, key  # of a curvature over 20: within 0.005 of the optimum
        assert value({**par, key: par[key] + 0.05}) < value(par) > value({**par, key: par[key] - 0.05})
    got = B.beta_score(df, learner, question).first()
    assert got.n == len(rows) and abs(got.loglik * got.n - 10 * sum(v * v for v in par.values()) - value(par)) < 1e-6
    none, nothing = B.beta_trend(df.limit(0), rounds=1)
    assert none.count() == 0 and nothing.count() == 0


def brute_tau(x, y):
    dx, dy = np.sign(np.subtract.outer(x, x)), np.sign(np.subtract.outer(y, y))
    up = np.triu_indices(len(x), 1)
    s, n = (dx * dy)[up].sum(), len(up[0])
    below = (n - (dx[up] == 0).sum()) * (n - (dy[up] == 0).sum())
    return None if below == 0 else s / math.sqrt(below)


def fenwick(order):
    """Pairs i < j with order[i] < order[j] in a permutation."""
    tree, below = [0] * (len(order) + 1), 0
    for v in order:
        k = v
        while k:
            below += tree[k]
            k &= k - 1
        k = v + 1
        while k <= len(order):
            tree[k] += 1
            k += k & -k
    return below


def test_kendall_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(g, float(rng.integers(0, 6) if g % 2 else rng.normal()), float(rng.integers(0, 4) if g % 3 else rng.normal())) for g in range(30) for _ in range(rng.integers(1, 60))]
    rows += [(99, 1.0, float(k)) for k in range(6)] + [(98, None, 1.0)] * 9
    found = {r.g: r for r in E.kendall_tau(spark.createDataFrame(rows, "g long, x double, y double").repartition(5), ["g"], "x", "y").collect()}
    for g in range(30):
        x, y = (np.array([r[k] for r in rows if r[0] == g]) for k in (1, 2))
        if len(x) < 5:
            assert g not in found
        else:
            want = brute_tau(x, y)
            assert found[g].n == len(x) and (found[g].tau is None if want is None else abs(found[g].tau - want) < 1e-12)
    assert found[99].tau is None and 98 not in found


def test_kendall_of_one_hot_group_over_many_tasks(spark):
    n = 200_000
    rng = np.random.default_rng(2)
    order = rng.permutation(n)
    ties = rng.integers(0, 50, 4000)
    df = spark.createDataFrame(__import__("pandas").DataFrame({"g": np.r_[np.zeros(n, int), np.ones(4000, int)], "x": np.r_[np.arange(n), ties], "y": np.r_[order, rng.integers(0, 2000, 4000)]})).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.g: r.tau for r in E.kendall_tau(df, ["g"], "x", "y").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    pairs = n * (n - 1) / 2
    assert abs(got[0] - (2 * fenwick(order.tolist()) - pairs) / pairs) < 1e-12
    own = df.where("g = 1").toPandas()
    assert abs(got[1] - brute_tau(own.x.to_numpy(), own.y.to_numpy())) < 1e-12


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    values = {"a": rng.normal(size=501) * 1e9, "b": np.r_[rng.integers(-3, 3, 400).astype(float), -0.0, 0.0], "c": np.array([5.0]), "d": rng.normal(size=300) * 1e-300, None: np.array([1.0, 2.0])}
    rows = [(k, float(v)) for k, own in values.items() for v in own] + [("e", None), ("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    probs = {"lo": 0.0, "q1": 0.25, "m": 0.5, "p95": 0.95, "hi": 1.0}
    found = {r.k: r for r in exact_quantiles(df, ["k"], "v", probs).collect()}
    for k, own in values.items():
        np.testing.assert_allclose([found[k][n] for n in probs], np.quantile(own, list(probs.values())), rtol=1e-12)
    assert len(found) == 6 and found["e"].m is None
    all_ = np.concatenate(list(values.values()))
    assert math.isclose(exact_quantiles(df, [], "v", {"m": 0.5}).first().m, np.quantile(all_, 0.5))
    assert exact_quantiles(df.limit(0), [], "v", {"m": 0.5}).collect() == [(None,)]
    assert exact_quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_bits_order_like_doubles(spark):
    xs = sorted([0.0, -0.0, 1.5, -1.5, 1e308, -1e308, 5e-324, -5e-324, 3.0, float("inf"), -float("inf")])
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ordered_bits(F.col("x")).alias("b")).withColumn("back", from_bits(F.col("b"))).collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows) and all(r.back == r.x for r in rows)


def whole_ess(x):
    x = x - x.mean()
    n = len(x)
    f = np.fft.rfft(x, 2 * n)
    rho = np.fft.irfft(f * f.conj())[:n]
    rho = rho / rho[0] if rho[0] > 0 else np.r_[1.0, np.zeros(n - 1)]
    pairs = rho[: n // 2 * 2].reshape(-1, 2).sum(1)
    end = int(np.argmax(pairs <= 0)) if (pairs <= 0).any() else len(pairs)
    return n / max(1.0, 2 * pairs[:end].sum() - 1)


@pytest.mark.parametrize("lags", [32, 256])
def test_chain_statistics_equal_the_whole_chain(spark, lags):
    rng, chains = np.random.default_rng(5), {}
    for p, slow in (("a", 0.0), ("b", 0.9), ("c", 0.995)):
        for c in (0, 1):
            x = [0.0]
            for e in rng.normal(size=2000 + 17 * c):
                x.append(slow * x[-1] + e)
            chains[p, c] = np.array(x)
    chains["d", 0], chains["d", 1] = np.ones(9), np.arange(3.0)
    rows = [(p, c, 3 * k - 50, float(v)) for (p, c), x in chains.items() for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "param string, chain long, draw long, value double").repartition(6)
    ess = {r.param: r.ess for r in E.effective_size(df, lags).collect()}
    rhat = {r.param: r.rhat for r in E.split_rhat(df).collect()}
    acf = {(r.param, r.chain, r.lag): r.acf for r in E.autocorrelation(df, 5).collect()}
    for p in "abc":
        own = [chains[p, c] for c in (0, 1)]
        assert math.isclose(ess[p], sum(map(whole_ess, own)), rel_tol=1e-9)
        halves = [h for x in own for h in (x[: (len(x) + 1) // 2], x[(len(x) + 1) // 2 :])]
        w, b, n = np.mean([h.var(ddof=1) for h in halves]), np.var([h.mean() for h in halves], ddof=1), np.mean([len(h) for h in halves])
        assert math.isclose(rhat[p], math.sqrt((n - 1) / n + b / w), rel_tol=1e-9)
        for c, x in enumerate(own):
            v = x - x.mean()
            for k in range(1, 6):
                assert math.isclose(acf[p, c, k], (v[k:] * v[:-k]).sum() / (v * v).sum(), rel_tol=1e-7, abs_tol=1e-10)
    assert math.isclose(ess["d"], 9 + whole_ess(np.arange(3.0))) and acf["d", 1, 3] is None and acf["d", 0, 1] is None
