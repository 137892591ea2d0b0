"""Toxicity by classifier chains: linear models over words and word beginnings, each fed the earlier ones' probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learntrail.llm.common import drop_written, mixed, table, written

CATEGORIES = ("junk", "toxic", "severe")
#: Labelled rows used for training at most (a sample by hash of the id), features a category may use, folds, decision.
TRAIN_ROWS, FEATURES, FOLDS, THRESHOLD = 5000, 400, 5, 0.4
#: A toxic row with so many distinct marks is severe.
SEVERE_MARKS = 3
CACHE = 400_000


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of the lower-case word without marks at its ends, of its first four and five letters, of the marks, and of capitals throughout."""
    own = word.strip(".,;:!?\"'()[]|*#%&$<>-")
    marks = word.replace(own, "", 1) if own else word
    found = [xxhash.xxh3_64_intdigest(marks, 1)] if len(marks) > 1 or marks in ("|", "#", "*") else []
    if not own:
        return tuple(found)
    if len(own) > 1 and own.isupper():
        found.append(xxhash.xxh3_64_intdigest("", 2))
    bare = own.lower()
    found.append(xxhash.xxh3_64_intdigest(bare))
    found += [xxhash.xxh3_64_intdigest(bare[:n], n) for n in (4, 5) if len(bare) >= n]
    return tuple(found)


@dataclass
class Linear:
    """Logistic regression on the presence of chosen features and the logits of earlier categories."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 0.02, passes: int = 25) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps; the last weight is the bias, which isn't penalised."""
    x = np.c_[x, np.ones(len(x))].astype(np.float64)
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], l2 * max(1.0, np.sqrt(len(x))))
    ridge[-1] = 1e-6
    for _ in range(passes):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def label_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, toxic, quality``: about ``most`` labelled documents by a hash of the id, one row for each id."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"), F.min(F.coalesce("quality", F.lit(1))).cast("int").alias("quality"))
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * share))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.join(known, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("quality").alias("quality"))


def sample_features(sample: DataFrame) -> DataFrame:
    """``doc_id, fold, junk, toxic, feats``: the distinct feature hashes of each text of the sample.

    Of texts that share two minhashes only the one of least id stays: copies would make any of their words look marked.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.iloc[at]
                feats = np.unique(np.array([h for w in set(row.text.split()) for h in word_features(w)], np.uint64))
                first, second = (feats.min(), mixed(feats).min()) if len(feats) else (np.uint64(0), np.uint64(0))
                yield pd.DataFrame({"doc_id": [row.doc_id], "junk": [1 - row.quality], "toxic": [row.toxic], "m1": [first.astype(np.int64)], "m2": [second.astype(np.int64)], "feats": pd.Series([feats.view(np.int64)], dtype=object)})

    rows = sample.mapInPandas(run, "doc_id long, junk long, toxic long, m1 long, m2 long, feats array<long>")
    once = rows.groupBy("m1", "m2").agg(F.min(F.struct("doc_id", "junk", "toxic", "feats")).alias("r")).select("r.*")
    return once.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(FOLDS)).cast("int"))


def marked_features(sample: DataFrame, targets: list[str], most: int = FEATURES, margin: float = 4.0) -> dict[tuple[str, int], np.ndarray]:
    """For each target and each left-out fold (-1: none): features more frequent in rows with the target, by the likelihood
    ratio against one common rate; the largest ``most``.

    What twice the logarithm of the number of features and ``margin`` don't exceed is chance among so many, and left out.
    Features are counted in Spark; only the chosen ones reach the driver.
    """
    folds = range(FOLDS)
    of = lambda c, f: F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(c) if c else F.lit(1))), F.lit(0)).cast("double")
    sums = [of(c, f).alias(f"{c}_{f}") for c in ("", *targets) for f in folds]
    total = sample.agg(*sums).first()
    counts = written(sample.select("fold", *targets, F.explode("feats").alias("feature")).groupBy("feature").agg(*sums))
    names = max(2, counts.count())
    entropy = lambda k, n: k * F.ln(F.greatest(k, F.lit(1e-9)) / n) + (n - k) * F.ln(F.greatest(n - k, F.lit(1e-9)) / n)
    scores = []
    for t in targets:
        for out in (-1, *folds):
            kept = [f for f in folds if f != out]
            pos, rows = (float(sum(total[f"{c}_{f}"] for f in kept)) for c in (t, ""))
            neg = rows - pos
            if pos and neg:
                a, n = (sum((F.col(f"{c}_{f}") for f in kept[1:]), F.col(f"{c}_{kept[0]}")) for c in (t, ""))
                ratio = 2 * (entropy(a, F.lit(pos)) + entropy(n - a, F.lit(neg)) - entropy(n, F.lit(rows)))
                scores.append(F.when((n > 0) & (a * neg > 3 * (n - a) * pos), F.struct(F.lit(t).alias("target"), F.lit(out).alias("out"), ratio.alias("ratio"))))
    found: dict[tuple[str, int], list[int]] = {(t, out): [] for t in targets for out in (-1, *folds)}
    if scores:
        high = counts.select("feature", F.explode(F.array(*scores)).alias("s")).select("feature", "s.*").where(F.col("ratio") >= 2 * math.log(names) + margin)
        best = Window.partitionBy("target", "out").orderBy(F.desc("ratio"), "feature")
        for r in high.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).collect():
            found[r.target, r.out].append(r.feature)
    drop_written(counts)
    return {k: np.sort(np.array(v, np.int64)) for k, v in found.items()}


def trained_chain(docs: DataFrame, labels: DataFrame) -> list[Linear]:
    """One model a category, in order. The earlier categories' columns are out-of-fold predictions, made with features chosen
    without the fold, so that a later model sees such errors in training as it will meet; severity too counts a row's marks
    among features chosen without it. Without rows of both kinds a category's probability is zero.

    What reaches the driver is at most FEATURES features for each category and fold, and a bit for each in each sample row.
    """
    sample = written(sample_features(label_sample(docs, labels)))
    chosen = marked_features(sample, ["junk", "toxic"])
    marks = F.lit(0)
    for k in range(FOLDS):
        marks = F.when(F.col("fold") == k, F.size(F.array_intersect("feats", F.array(*map(F.lit, chosen["toxic", k].tolist())).cast("array<bigint>")))).otherwise(marks)
    severe = written(sample.withColumn("severe", (F.col("toxic") * (marks >= SEVERE_MARKS).cast("long"))))
    chosen |= marked_features(severe, ["severe"])
    names = np.unique(np.concatenate(list(chosen.values())))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="feats").assign(bits=[np.packbits(np.isin(names, x)).tobytes() for x in batch.feats])

    got = severe.select("doc_id", "fold", *CATEGORIES, "feats").mapInPandas(bits, "doc_id long, fold int, junk long, toxic long, severe long, bits binary").orderBy("doc_id").toPandas()
    drop_written(sample)
    drop_written(severe)
    there = np.unpackbits(np.frombuffer(b"".join(got.bits), np.uint8).reshape(len(got), -1), axis=1, count=len(names)) if len(got) and len(names) else np.zeros((len(got), len(names)), np.uint8)
    there, folds = there.astype(np.float32), got.fold.to_numpy()
    columns = {k: there[:, np.searchsorted(names, v)] for k, v in chosen.items()}
    chain: list[Linear] = []
    earlier = np.zeros((len(got), 0))
    for name in CATEGORIES:
        y = got[name].to_numpy(np.int64)
        if y.sum() < 2 or (1 - y).sum() < 2:
            chain.append(Linear(earlier=np.zeros(earlier.shape[1])))
            earlier = np.c_[earlier, np.full(len(got), _logit(np.zeros(1))[0])]
            continue
        n = columns[name, -1].shape[1]
        w = _fit(np.c_[columns[name, -1], earlier], y)
        chain.append(Linear(chosen[name, -1].view(np.uint64), w[:n], w[n:-1], float(w[-1])))
        out = np.full(len(got), y.mean())
        for k in range(FOLDS):
            own = folds == k
            x = np.c_[columns[name, k], earlier]
            if y[~own].sum() >= 2 and own.any():
                out[own] = 1 / (1 + np.exp(-np.clip(np.c_[x[own], np.ones(own.sum())] @ _fit(x[~own], y[~own]), -30, 30)))
        earlier = np.c_[earlier, _logit(out)]
    for m in chain:
        order = np.argsort(m.hashes)
        m.hashes, m.weights = m.hashes[order], m.weights[order]
    return chain


def chain_probabilities(chain: list[Linear]):
    """A column function from text to the struct p_junk, p_toxic, p_severe: words with weights are looked up, batch by batch."""
    names = np.unique(np.concatenate([m.hashes for m in chain]))
    index = {int(h): k for k, h in enumerate(names)}
    tables = np.zeros((len(CATEGORIES), len(names)))
    for k, m in enumerate(chain):
        tables[k, np.searchsorted(names, m.hashes)] = m.weights

    @F.pandas_udf("p_junk double, p_toxic double, p_severe double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        store: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            linear = np.zeros((len(texts), len(CATEGORIES)))
            for k, text in enumerate(texts):
                hit: set[int] = set()
                for w in set(text.split()) if isinstance(text, str) else ():
                    got = store.get(w)
                    if got is None:
                        got = tuple(index[h] for h in word_features(w) if h in index)
                        if len(store) >= CACHE:
                            store.clear()
                        store[w] = got
                    if got:
                        hit.update(got)
                if hit:
                    linear[k] = tables[:, sorted(hit)].sum(1)
            logits, probs = np.zeros_like(linear), np.zeros_like(linear)
            for k, m in enumerate(chain):
                z = linear[:, k] + m.bias + (logits[:, :k] @ m.earlier if k else 0)
                probs[:, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                logits[:, k] = _logit(probs[:, k])
            yield pd.DataFrame(probs, columns=[f"p_{c}" for c in CATEGORIES])

    return scored


def score_toxicity(docs: DataFrame, chain: list[Linear], threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, p_junk, p_toxic, p_severe, toxic``, one row for each row of ``docs``, scored over the whole text.

    Null or blank text has no features: the models' biases decide. Repeated rows and null ids are kept as they come; other
    columns are not read. No shuffle; the chain is a few thousand numbers.
    """
    scored = docs.select("doc_id", chain_probabilities(chain)(F.col("text").cast("string")).alias("p"))
    return scored.select("doc_id", "p.*", (F.col("p.p_toxic") >= threshold).alias("toxic"))


def without_toxic(docs: DataFrame, chain: list[Linear], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose probability of being toxic is under ``threshold``."""
    return docs.where(chain_probabilities(chain)(F.col("text").cast("string"))["p_toxic"] < threshold)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, trained_chain(docs, table(spark, sf_dir, "labels")))
