"""Evaluation of binary predictions, rank correlation, chains and resampling."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learntrail.functions.parsing import clipped
from learntrail.operators.sequence import ranked
from learntrail.sources.tables import checkpointed


def ordered_mean(value: str, *by: str) -> Column:
    """The mean of a group's values, added up in the order of ``by``, so that it has the same last bits in every run and is
    rounded the same way where it lies between two figures. A group's values are held together. Null values don't count."""
    held = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(*by, F.col(value).cast("double").alias("_v")))))
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda total, x: total + x["_v"]), F.size(held))


def roc_auc(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Tie-aware area under the curve by the Mann-Whitney sum. Rows are first counted by score, so a hot group costs its distinct scores."""
    scores = df.groupBy(*keys, p).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.sum(1.0 - F.col(y)).alias("neg"))
    below = F.sum("neg").over(Window.partitionBy(*keys).orderBy(p).rowsBetween(Window.unboundedPreceding, -1))
    won = scores.withColumn("won", F.col("pos") * (F.coalesce(below, F.lit(0.0)) + F.col("neg") / 2))
    return won.groupBy(*keys).agg((F.try_divide(F.sum("won"), F.sum("pos") * F.sum("neg"))).alias("auc"))


def whole_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """The area over all rows: distinct scores are dealt by ranges, so none of them is sorted in one task with all others."""
    scores = df.groupBy(p).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.sum(1.0 - F.col(y)).alias("neg"))
    won = ranked(scores, F.col(p), total="neg")
    return won.agg(F.try_divide(F.sum(F.col("pos") * (F.col("_before") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def binary_metrics(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", cut: float = 0.5) -> DataFrame:
    """Accuracy, balanced accuracy, F1, log-likelihood, Brier score, RMSE and n in one pass. Balanced accuracy and F1 are null with one class only."""
    q, t = clipped(F.col(p)), F.col(y).cast("double")
    hit = (q >= cut).cast("double")
    tp, fp, fn, tn = (F.sum(F.when((t == a) & (hit == b), 1.0).otherwise(0.0)) for a, b in ((1, 1), (0, 1), (1, 0), (0, 0)))
    both = (F.min(t) == 0) & (F.max(t) == 1)
    brier = F.avg((q - t) * (q - t))
    out = [
        F.avg((hit == t).cast("double")).alias("accuracy"),
        F.when(both, (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        F.when(both, F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(0.0))).alias("f1"),
        F.avg(t * F.ln(q) + (1 - t) * F.ln(1 - q)).alias("log_likelihood"),
        brier.alias("brier"), F.sqrt(brier).alias("rmse"), F.count(F.lit(1)).alias("n"),
    ]
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


def correlation(x: str, y: str) -> Column:
    """Pearson's r; null when a side doesn't vary."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def _concordance(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> float:
    """The sum over pairs of distinct points (a, b) of sign(da) * sign(db) * the product of their weights.

    Points are sorted by a, then b. Level by level, neighbouring runs of double length are counted against each other by binary
    search, and pairs equal in a, which that counts as rising in both, are taken away.
    """
    order = np.lexsort((b, a))
    a, rank, w = a[order], np.unique(b[order], return_inverse=True)[1], w[order]
    n, total, width = len(a), 0.0, 1
    wide, place = np.int64(rank.max() + 2 if n else 1), np.arange(n)
    while width < n:
        block, right = place // (2 * width), place // width % 2 == 1
        left = np.flatnonzero(~right)
        keys = block[left] * wide + rank[left]
        left = left[np.argsort(keys, kind="stable")]
        keys, sums = np.sort(keys), np.r_[0, np.cumsum(w[left])]
        own, r = block[right] * wide, rank[right]
        first, last = (sums[np.searchsorted(keys, x)] for x in (own, own + wide))
        below, upto = sums[np.searchsorted(keys, own + r, "left")], sums[np.searchsorted(keys, own + r, "right")]
        total += (w[right] * ((below - first) - (last - upto))).sum()
        width *= 2
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if n else np.zeros(0, np.int64)
    ties = (np.add.reduceat(w, starts) ** 2 - np.add.reduceat(w * w, starts)).sum() / 2 if n else 0.0
    return total - ties


def kendall_tau(df: DataFrame, keys: list[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Kendall's tau-b of each group with at least ``least`` rows and variation in both; null where one doesn't vary.

    Rows are first counted by (x, y). Points are dealt by ranges of (group, x), and again by ranges of (group, y), so a group may
    span many tasks: pairs in one range of x are counted there, pairs in one range of y but not of x in that, and all others
    by the numbers of points that two ranges share. Each count takes n log n steps. Rows with a null in the keys, x or y are left out.
    """
    points = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna().groupBy(*keys, "_x", "_y").agg(F.count("*").cast("double").alias("_m"))
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def counted(a: str, b: str, w: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [p for p in batches if len(p)]
            if parts:
                groups = pd.concat(parts, ignore_index=True).groupby(keys, sort=False)
                yield pd.DataFrame([(*key, _concordance(*(own[c].to_numpy() for c in (a, b, w)))) for key, own in groups], columns=[*keys, "_s"])

        return run

    sums = f"{kinds}, _s double"
    by_x = checkpointed(points.repartitionByRange(*keys, "_x").withColumn("_i", F.spark_partition_id()))
    within = by_x.select(*keys, "_x", "_y", "_m").mapInPandas(counted("_x", "_y", "_m"), sums)
    spans = by_x.groupBy(*keys).agg(F.min("_i").alias("a"), F.max("_i").alias("b")).where("a < b").select(*keys)
    wide = by_x.join(spans, keys, "left_semi").groupBy(*keys, "_y", "_i").agg(F.sum("_m").alias("_m"))
    by_y = checkpointed(wide.repartitionByRange(*keys, "_y").withColumn("_j", F.spark_partition_id()))
    across = by_y.select(*keys, "_y", "_i", "_m").mapInPandas(counted("_y", "_i", "_m"), sums)
    cells = by_y.groupBy(*keys, "_i", "_j").agg(F.sum("_m").alias("_m"))
    apart = cells.groupBy(*keys).applyInPandas(lambda own: next(counted("_i", "_j", "_m")(iter([own]))), sums)
    pairs = within.unionByName(across).unionByName(apart).groupBy(*keys).agg(F.sum("_s").alias("s"))
    ties = lambda c: points.groupBy(*keys, c).agg(F.sum("_m").alias("t")).groupBy(*keys).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(f"t{c}"))
    n = points.groupBy(*keys).agg(F.sum("_m").alias("n"))
    whole = F.col("n") * (F.col("n") - 1) / 2
    out = n.where(F.col("n") >= least).join(pairs, keys).join(ties("_x"), keys).join(ties("_y"), keys)
    return out.select(*keys, F.col("n").cast("long").alias("n"), F.try_divide(F.col("s"), F.sqrt((whole - F.col("t_x")) * (whole - F.col("t_y")))).alias("tau"))


def _placed(chains: DataFrame) -> DataFrame:
    """``param, chain, pos, v, n, mean``: each value's place from 0 in its chain by ``draw``, and less the chain's mean.

    Draws are dealt by ranges of (param, chain, draw), so a chain spans many tasks; draws of a chain should differ. Rows with nulls are left out.
    """
    rows = chains.select("param", "chain", "draw", F.col("value").cast("double").alias("value")).dropna()
    each = rows.groupBy("param", "chain").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    first = F.sum("n").over(Window.orderBy("param", "chain").rowsBetween(Window.unboundedPreceding, -1))  # one row a chain
    each = each.withColumn("first", F.coalesce(first, F.lit(0)))
    placed = ranked(rows, F.col("param"), F.col("chain"), F.col("draw")).join(each, ["param", "chain"])
    return placed.select("param", "chain", (F.col("_rank") - F.col("first")).alias("pos"), "value", (F.col("value") - F.col("mean")).alias("v"), "n", "mean")


def split_rhat(chains: DataFrame) -> DataFrame:
    """Split R-hat of each parameter from rows ``param, chain, draw, value``; halves by each draw's place, the middle one in the first."""
    half = (F.col("pos") * 2 >= F.col("n")).cast("int")
    parts = _placed(chains).groupBy("param", "chain", half.alias("half")).agg(F.avg("value").alias("mean"), F.var_samp("value").alias("var"), F.count("*").alias("n"))
    out = parts.groupBy("param").agg(F.avg("var").alias("w"), F.var_samp("mean").alias("b"), F.avg("n").alias("n"))
    return out.select("param", F.sqrt((F.col("n") - 1) / F.col("n") + F.try_divide(F.col("b"), F.col("w"))).alias("rhat"))


def _lag_sums(placed: DataFrame, lags: int) -> DataFrame:
    """``param, chain, n, lag, s``: the sums of products with the value ``lag`` places later, for lags below ``lags``.

    Chains are cut in blocks of ``lags`` places; a block gets the next one as well and multiplies by a Fourier transform of
    four blocks' length, and blocks' sums add up by lag.
    """
    block = F.floor(F.col("pos") / lags)
    both = placed.select("param", "chain", "n", "pos", "v", F.explode(F.array(block, block - 1)).alias("block")).where("block >= 0")
    kinds = ", ".join(f"{k} {placed.schema[k].dataType.simpleString()}" for k in ("param", "chain"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        at = (group.pos - group.block.iloc[0] * lags).to_numpy()
        x = np.zeros(2 * lags)
        x[at] = group.v.to_numpy()
        own = np.r_[x[:lags], np.zeros(lags)]
        s = np.fft.irfft(np.fft.rfft(own, 4 * lags).conj() * np.fft.rfft(x, 4 * lags))[:lags]
        return pd.DataFrame({"param": group.param.iloc[0], "chain": group.chain.iloc[0], "n": group.n.iloc[0], "lag": np.arange(lags), "s": s})

    sums = both.groupBy("param", "chain", "block").applyInPandas(one, f"{kinds}, n long, lag int, s double")
    return sums.groupBy("param", "chain", "n", "lag").agg(F.sum("s").alias("s"))


def effective_size(chains: DataFrame, lags: int = 256) -> DataFrame:
    """Effective sample size of each parameter by Geyer's initial positive sequence, summed over chains.

    Autocorrelations come from sums over blocks of chains (``_lag_sums``), for ``lags`` lags at first; chains whose sequence
    hasn't turned by then go again with eight times as many, until it turns or the chain ends. A task holds two blocks, and a
    chain's lags up to its turn, not its draws. A chain that doesn't vary counts in full.
    """
    placed = checkpointed(_placed(chains))
    kinds = ", ".join(f"{k} {placed.schema[k].dataType.simpleString()}" for k in ("param", "chain"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("lag")
        n, most = int(own.n.iloc[0]), len(own)
        rho = own.s.to_numpy()[:n]
        rho = rho / rho[0] if rho[0] > 1e-300 else np.r_[1.0, np.zeros(len(rho) - 1)]
        pairs = rho[: len(rho) // 2 * 2].reshape(-1, 2).sum(1)
        turned = (pairs <= 0).any()
        end = int(np.argmax(pairs <= 0)) if turned else len(pairs)
        tau = max(1.0, 2 * pairs[:end].sum() - 1)
        return pd.DataFrame({"param": [group.param.iloc[0]], "chain": [group.chain.iloc[0]], "ess": [n / tau], "done": [bool(turned or most >= n)]})

    out, rest = None, placed
    while True:
        found = checkpointed(_lag_sums(rest, lags).groupBy("param", "chain").applyInPandas(one, f"{kinds}, ess double, done boolean"))
        out = found if out is None else out.unionByName(found)
        open_ = found.where("NOT done").select("param", "chain")
        if open_.isEmpty():
            return out.where("done").groupBy("param").agg(F.sum("ess").alias("ess"))
        rest, lags = placed.join(open_, ["param", "chain"], "left_semi"), lags * 8


def autocorrelation(chains: DataFrame, lags: int) -> DataFrame:
    """``param, chain, lag, acf`` for lags from 1 to ``lags``, of rows ``param, chain, draw, value``; null where nothing varies or the chain is too short."""
    sums = _lag_sums(_placed(chains), max(256, lags + 1)).where(F.col("lag") <= lags)
    whole = sums.where("lag = 0").select("param", "chain", F.col("s").alias("all"))
    acf = F.when(F.col("lag") < F.col("n"), F.try_divide(F.col("s"), F.col("all")))
    return sums.where("lag > 0").join(whole, ["param", "chain"]).select("param", "chain", F.col("lag").cast("long").alias("lag"), acf.alias("acf"))


def bootstrap_metrics(df: DataFrame, keys: list[str], y: str = "y", p: str = "p", cut: float = 0.5, replicates: int = 500, seed: int = 42, digits: int = 3) -> DataFrame:
    """``keys, metric, mean, low, high``: percentile intervals of balanced accuracy, F1 and the area under the curve of each group.

    Rows are first counted by score (to ``digits`` places) and label; drawing as many rows again with replacement is one
    multinomial draw over these counts, so a task holds a group's distinct scores, at most 10**digits + 1, and not its rows.
    Replicates in which a class is missing are left out; a metric without any is null.
    """
    cells = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.round(p, digits).alias("_p")).agg(F.sum(F.col(y).cast("long")).alias("_pos"), F.sum(1 - F.col(y).cast("long")).alias("_neg"))

    def drawn(group: pd.DataFrame) -> pd.DataFrame:
        own = group.sort_values("_p")
        counts = np.r_[own["_pos"].to_numpy(np.int64), own["_neg"].to_numpy(np.int64)]
        rng = np.random.default_rng([seed, zlib.crc32(repr(group[keys].iloc[0].tolist()).encode())])
        w = rng.multinomial(counts.sum(), counts / counts.sum(), replicates).astype(float)
        pos, neg = w[:, : len(own)], w[:, len(own) :]
        hit = own["_p"].to_numpy(float) >= cut
        tp, fp, n_pos, n_neg = pos[:, hit].sum(1), neg[:, hit].sum(1), pos.sum(1), neg.sum(1)
        with np.errstate(all="ignore"):
            found = {
                "balanced_accuracy": (tp / n_pos + 1 - fp / n_neg) / 2,
                "f1": np.where((n_pos > 0) & (n_neg > 0), 2 * tp / np.maximum(tp + fp + n_pos, 1e-12), np.nan),
                "auc": (pos * (np.cumsum(neg, 1) - neg / 2)).sum(1) / (n_pos * n_neg),
            }
        rows = []
        for name, x in found.items():
            x = x[np.isfinite(x)]
            rows.append((*group[keys].iloc[0], name, *((x.mean(), *np.quantile(x, [0.025, 0.975])) if len(x) else (None,) * 3)))
        return pd.DataFrame(rows, columns=[*keys, "metric", "mean", "low", "high"])

    kinds = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys)
    return cells.groupBy(*keys).applyInPandas(drawn, f"{kinds}, metric string, mean double, low double, high double")


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, replicates: int = 500, seed: int = 42) -> DataFrame:
    """Percentile interval of each group's mean. Each row draws its Poisson(1) weight in every replicate from a generator
    seeded by its partition, and sums meet by replicate: no group is gathered, only ``replicates`` partial sums a task and group."""
    schema = ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), "rep int, w double, s double"])

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            for key, group in batch.groupby(keys, dropna=False, sort=True):
                x = group[value].to_numpy(float)
                w = rng.poisson(1.0, (replicates, len(x)))
                yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "rep": range(replicates), "w": w.sum(1).astype(float), "s": w @ x})

    rows = df.where(F.col(value).isNotNull()).select(*keys, value)
    means = rows.mapInPandas(drawn, schema).groupBy(*keys, "rep").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
