"""Small helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the rolling word-window hash, and the finaliser's constants (SplitMix64).
PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Words handled together by one numpy pass inside a task: bounds its memory whatever the documents' lengths.
CHUNK_BYTES = 8_000_000
#: With these, shuffle files go when a write has ended, and not when the driver's collector comes to them.
SHUFFLE_CLEANUP = ("spark.sql.shuffleDependency.fileCleanup.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")
#: A group of one in so many rows is hot.
HOT = 1000
#: Partitions of a packed exchange at most, so that the driver tracks blocks in proportion to the input and a sender's record
#: still holds several keys; beyond it a partition has several buckets, one after the other.
REDUCERS = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only a local session without one gets a folder of its own."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = {key: spark.conf.get(key, None) for key in SHUFFLE_CLEANUP}
    for key in SHUFFLE_CLEANUP:
        spark.conf.set(key, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete a table of ``written`` that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exchange_buckets(df: DataFrame, least: int = 48) -> int:
    """How many buckets a packed exchange of this input uses: grows with its partitions, so a bucket's size doesn't."""
    return max(least, 4 * df.rdd.getNumPartitions())


def exchanged(records: DataFrame, buckets: int) -> DataFrame:
    """``records`` with the rows of each of the ``buckets`` (column ``bucket``) in one run of one partition, whatever
    spark.sql.shuffle.partitions is: a partition a bucket, or, of more than REDUCERS buckets, several in each, sorted (the sort spills)."""
    if buckets <= REDUCERS:
        return records.repartitionById(buckets, F.col("bucket").cast("int"))
    return records.repartitionById(REDUCERS, F.pmod(F.col("bucket"), F.lit(REDUCERS)).cast("int")).sortWithinPartitions("bucket")


def bucket_groups(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All rows of a bucket of ``exchanged`` at a time; only one bucket is held."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        cuts = np.flatnonzero(np.diff(batch.bucket.to_numpy())) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if begin < end:
                part = batch.iloc[begin:end]
                if held and held[0].bucket.iloc[0] != part.bucket.iloc[0]:
                    yield pd.concat(held, ignore_index=True)
                    held = []
                held.append(part)
    if held:
        yield pd.concat(held, ignore_index=True)


def join_hot(rows: DataFrame, groups: DataFrame, on: list[str], size: str, how: str = "left", total: int | None = None) -> DataFrame:
    """``rows`` joined to ``groups``, which has one row for each group and the group's number of rows in ``size``; ``total`` is
    their sum or more, if it is known.

    Groups of at least 1 / HOT of all rows, of which there can't be more than HOT whatever the data, are broadcast, so that no
    task gets the rows of a large group together; the others are joined by a shuffle.
    """
    if total is None:
        total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.broadcast(groups.where(F.col(size) * HOT >= total).drop(size))
    cold = groups.where(F.col(size) * HOT < total).drop(size)
    return rows.join(hot, on).unionByName(rows.join(hot.select(*on), on, "left_anti").join(cold.hint("merge"), on, how))


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * MIX[0]
    x = x ^ (x >> np.uint64(27))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(31))


def as_bytes(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` parts exactly at those six bytes."""
    words = data.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words that start at each position; positions whose window leaves ``words`` are not there."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    found = np.zeros(n, np.uint64)
    for k in range(width):
        found = found * PRIME + words[k : k + n]
    return mixed(found)


def chunks(ids: Iterable, texts: Iterable, most: int = CHUNK_BYTES):
    """Lists of ids and of byte strings, of about ``most`` bytes together or one text."""
    some, held, size = [], [], 0
    for i, text in zip(ids, texts, strict=True):
        data = as_bytes(text)
        some.append(i)
        held.append(data)
        size += len(data)
        if size >= most:
            yield some, held
            some, held, size = [], [], 0
    if some:
        yield some, held


def ragged(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run of ``counts`` elements."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def null_safe_text(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and ``text`` alone, so that other columns, whatever their names, can't clash; null text is empty."""
    return df.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
