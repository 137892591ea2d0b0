"""Document quality: random-indexing word vectors, pooled, and a small two-layer network with calibrated probabilities."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrail.llm.common import null_safe_text, ragged, table

#: Words have 16384 vectors of 32 numbers by hash, so a frequent word shares its own with rare ones at most; the first MARKS of
#: them belong to marks (case, digits, symbols, repeats).
BUCKETS, SIZE, MARKS, SPAN = 16384, 32, 64, 2
SLICES, GROUPS = 16, 256
TRAIN_ROWS, HIDDEN, THRESHOLD, CACHE = 6000, 24, 0.3, 400_000
_UPPER, _TITLE, _DIGIT, _LONG, _REPEAT, _ODD = range(6)


def index_vectors(seed: int = 5, ones: int = 4) -> np.ndarray:
    """The sparse random index vector of each bucket: four entries of 1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, SIZE), np.float32)
    at = rng.random((BUCKETS, SIZE)).argsort(1)[:, :ones]
    np.put_along_axis(out, at, rng.choice([-1.0, 1.0], (BUCKETS, ones)), 1)
    return out


def word_tokens(word: str) -> tuple[int, ...]:
    """A word's buckets: its letters in lower case, and marks for its case, digits, length and the symbols round it."""
    bare = word.strip(".,;:!?\"'()[]{}<>|*#%&$@~^_=+-/\\")
    out = []
    if bare:
        out.append(MARKS + xxhash.xxh3_64_intdigest(bare.lower()) % (BUCKETS - MARKS))
        if bare.isupper() and len(bare) > 1:
            out.append(_UPPER)
        elif bare[0].isupper():
            out.append(_TITLE)
        if any(c.isdigit() for c in bare):
            out.append(_DIGIT)
        if len(bare) > 24:
            out.append(_LONG)
        if not bare.isalnum():
            out.append(_ODD)
    marks = word.replace(bare, "", 1) if bare else word
    if marks:
        out.append(8 + xxhash.xxh3_64_intdigest(marks) % (MARKS - 8))
    return tuple(out)


class Tokens(dict):
    """The bucket sequences of texts, with a bounded store of words met."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        got = word_tokens(word)
        if len(word) <= 40:
            if len(self) >= CACHE:
                self.clear()
            self[word] = got
        return got

    def of(self, text: str) -> np.ndarray:
        ids = np.fromiter(chain.from_iterable(map(self.__getitem__, text.split())), np.int32)
        again = np.flatnonzero((ids[1:] == ids[:-1]) & (ids[1:] >= MARKS)) + 1 if len(ids) else []
        return np.insert(ids, again, _REPEAT) if len(again) else ids


def context_sums(ids: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each bucket, the sum of the index vectors that stand up to SPAN places from it, within its document.

    The vectors hold 1, 0 and -1, so that a word's surroundings fit a byte each; ids of 16 bits are sorted by radix.
    """
    out = np.zeros((BUCKETS, SIZE))
    if len(ids) == 0:
        return out
    place = ragged(lengths)
    vectors = index.astype(np.int8)[ids]
    around = np.zeros((len(ids), SIZE), np.int8)
    for k in range(1, SPAN + 1):
        near = (place >= k)[k:, None]
        around[k:] += vectors[:-k] * near
        around[:-k] += vectors[k:] * near
    order = np.argsort(ids.astype(np.uint16), kind="stable")
    ids = ids[order]
    begin = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    out[ids[begin]] = np.add.reduceat(around[order], begin, axis=0, dtype=np.float32)
    return out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, SIZE) unit vectors from the contexts of all words of all documents.

    Each task adds up its own table of whole numbers, which doubles hold exactly up to 2**53; the tables are summed in two steps
    by slice, and SLICES rows of a fixed size, four megabytes in all, reach the driver whatever the corpus.
    """
    index = index_vectors()

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, total = Tokens(), np.zeros((BUCKETS, SIZE))
        for batch in batches:
            some, size = [], 0
            for k, text in enumerate(batch.text):
                some.append(tokens.of(text))
                size += len(some[-1])
                if size > 200_000 or k == len(batch) - 1:
                    total += context_sums(np.concatenate(some), np.array([len(x) for x in some], np.int64), index)
                    some, size = [], 0
        slices = total.reshape(SLICES, -1)
        yield pd.DataFrame({"slice": range(SLICES), "part": TaskContext.get().partitionId() % GROUPS, "sums": [x.tobytes() for x in slices]})

    def added(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float64) for x in group.sums)
        return pd.DataFrame({"slice": [group.slice.iloc[0]], "part": [group.part.iloc[0]], "sums": [total.tobytes()]})

    schema = "slice int, part int, sums binary"
    summed = null_safe_text(docs).mapInPandas(partial, schema).groupBy("slice", "part").applyInPandas(added, schema).withColumn("part", F.lit(0)).groupBy("slice", "part").applyInPandas(added, schema)
    out = np.zeros((SLICES, BUCKETS * SIZE // SLICES), np.float32)
    for row in summed.collect():
        out[row["slice"]] = np.frombuffer(row["sums"], np.float64)
    out = out.reshape(BUCKETS, SIZE)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(docs: DataFrame, vectors: np.ndarray, *keep: str) -> DataFrame:
    """``keep`` and ``pool``: the mean and the spread of a document's word vectors, shares of the marks, and how few words it repeats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = Tokens()
        for batch in batches:
            rows = []
            for text in batch.text:
                ids = tokens.of(text)
                if len(ids) == 0:
                    rows.append(np.zeros(2 * SIZE + MARKS + 2, np.float32).tobytes())
                    continue
                counts = np.bincount(ids, minlength=BUCKETS)
                used = np.flatnonzero(counts)
                share = counts[used] / len(ids)
                mean = share @ vectors[used]
                spread = np.sqrt(np.maximum(share @ vectors[used] ** 2 - mean**2, 0))
                rows.append(np.concatenate([mean, spread, np.sqrt(counts[:MARKS] / len(ids)), [len(used) / len(ids), math.log1p(len(ids))]]).astype(np.float32).tobytes())
            yield batch[list(keep)].assign(pool=rows)

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return null_safe_text(docs, *keep).mapInPandas(run, f"{kinds}, pool binary")


class Network:
    """Standardised inputs, one hidden layer of tanh units, one output; the logit is divided by a temperature."""

    def __init__(self, inputs: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.w = [rng.standard_normal((inputs, HIDDEN)) / math.sqrt(inputs), np.zeros(HIDDEN), rng.standard_normal(HIDDEN) / math.sqrt(HIDDEN), np.zeros(1)]
        self.temperature = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh(np.clip((x - self.mean) / self.scale, -6, 6) @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3][0]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = 300, rate: float = 0.02, decay: float = 1e-3) -> Network:
        """Adam on the mean log loss; every fifth row is left out of the weights and calibrates the temperature."""
        if len(y) < 10 or y.min() == y.max():
            self.w[2][:] = 0
            self.w[3][0] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
            return self
        held = np.arange(len(y)) % 5 == 4
        own, want = x[~held], y[~held]
        self.mean, self.scale = own.mean(0), own.std(0) + 1e-3
        z = np.clip((own - self.mean) / self.scale, -6, 6)
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.w]
        for t in range(1, passes + 1):
            h = np.tanh(z @ self.w[0] + self.w[1])
            error = (1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3][0], -40, 40))) - want) / len(want)
            back = np.outer(error, self.w[2]) * (1 - h * h)
            for w, g, m in zip(self.w, (z.T @ back + decay * self.w[0], back.sum(0), h.T @ error + decay * self.w[2], np.array([error.sum()])), moments, strict=True):
                m[0] = 0.9 * m[0] + 0.1 * g
                m[1] = 0.999 * m[1] + 0.001 * g * g
                w -= rate * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
        logits, truth = self.logits(x[held]), y[held]
        grid = np.exp(np.linspace(math.log(0.25), math.log(8), 60))
        loss = [np.mean(np.logaddexp(0, -logits / t) * truth + np.logaddexp(0, logits / t) * (1 - truth)) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        return self


def held_out(doc_id) -> Column:
    """Rows whose labels are never read: crc32 of the id as text divisible by five."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def quality_model(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, most: int = TRAIN_ROWS) -> Network:
    """The network, trained on the driver on about ``most`` labelled rows (a sample by hash) that aren't held out."""
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("double").alias("quality")).where(~held_out("doc_id"))
    share = min(1.0, most / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * share))
    sample = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))  # a repeated id counts once
    got = pooled(sample, vectors, "doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    inputs = 2 * SIZE + MARKS + 2
    x = np.frombuffer(b"".join(got.pool), np.float32).reshape(-1, inputs).astype(np.float64)
    return Network(inputs).fit(x, got.quality.to_numpy(float))


def score_quality(docs: DataFrame, vectors: np.ndarray, model: Network, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted``, one row for each row of ``docs``, from the whole text alone.

    Null and blank texts have a pool of zeros and the score that the network gives it. Repeated rows are scored alike; a null
    id counts as held out. Other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.pool), np.float32).reshape(len(batch), -1).astype(np.float64)
            yield batch[["doc_id"]].assign(score=model.probabilities(x) if len(batch) else [])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = pooled(docs, vectors, "doc_id").mapInPandas(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    vectors = word_vectors(docs)
    return score_quality(docs, vectors, quality_model(docs, labels, vectors))
