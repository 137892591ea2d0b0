"""Operators on the ordered attempts of a learner at an item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learntrail.sources.tables import checkpointed

PAIR = ("student_id", "question_id")


def ordered(keys=PAIR, by=("ts", "row_id")) -> Window:
    return Window.partitionBy(*keys).orderBy(*by)


def attempt_number(log: DataFrame, keys=PAIR, by=("ts", "row_id")) -> DataFrame:
    return log.withColumn("attempt_no", F.row_number().over(ordered(keys, by)).cast("long"))


def of_courses(log: DataFrame, courses: list[int], key: str = "course_id") -> DataFrame:
    """The rows of the named courses; a course that the log doesn't have is an error."""
    rows = log.where(F.col(key).isin(courses))
    unknown = set(courses) - {r[0] for r in rows.select(key).distinct().collect()}
    if unknown:
        raise ValueError(f"unknown courses: {sorted(unknown)}")
    return rows


def time_delta(log: DataFrame, keys=PAIR) -> DataFrame:
    """Seconds since the same pair's attempt before."""
    micros = F.unix_micros("ts")
    return log.withColumn("delta_s", (micros - F.lag(micros).over(ordered(keys))) / 1e6)


def _compared(log: DataFrame, own: str, before: str, texts: DataFrame | None) -> DataFrame:
    """``log`` with ``_own`` and ``_before``, how long the two columns' texts are, and ``_edits``, how far apart.

    With ``texts`` the columns hold keys of its rows ``key, text``: two texts are compared once however often they meet, and
    no row of the log carries one. Null where a text is.
    """
    if texts is None:
        return log.withColumns({"_own": F.length(own), "_before": F.length(before), "_edits": F.levenshtein(own, before)})
    pairs = log.where(F.col(own).isNotNull() & F.col(before).isNotNull()).select(F.col(own).alias("_a"), F.col(before).alias("_b")).distinct()
    pairs = pairs.repartition(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few rows, but each takes long: no task may have them all
    met = pairs.join(texts.select(F.col("key").alias("_a"), F.col("text").alias("_x")), "_a").join(texts.select(F.col("key").alias("_b"), F.col("text").alias("_y")), "_b")
    met = checkpointed(met.select("_a", "_b", F.length("_x").alias("_own"), F.length("_y").alias("_before"), F.levenshtein("_x", "_y").alias("_edits")))  # else filters would compare again
    return log.join(met, (F.col(own) == met["_a"]) & (F.col(before) == met["_b"]), "left").drop("_a", "_b")


def edit_lag(log: DataFrame, text: str = "response", keys=PAIR, by=("ts", "row_id"), texts: DataFrame | None = None) -> DataFrame:
    """Edit distance to the attempt before; null text is the word nan. With ``texts`` (``key, text``), ``text`` holds keys."""
    nan = F.lit("nan")
    own = F.col(text) if texts is not None else F.coalesce(F.col(text), nan)
    words = texts.select("key", F.coalesce("text", nan).alias("text")) if texts is not None else None
    x = log.withColumn("_text", own).withColumn("_prev", F.lag("_text").over(ordered(keys, by)))
    return _compared(x, "_text", "_prev", words).withColumn("edit_distance", F.col("_edits").cast("long")).drop("_text", "_prev", "_own", "_before", "_edits")


def jumps(log: DataFrame, fraction: float = 0.9, seconds: float = 600, text: str = "response", keys=PAIR, texts: DataFrame | None = None) -> DataFrame:
    """Attempts whose text differs from the one before by more than ``fraction`` of the longer, within less than ``seconds``.
    With ``texts`` (``key, text``), ``text`` holds keys."""
    x = time_delta(log, keys).withColumn("_prev", F.lag(text).over(ordered(keys))).where(F.col("_prev").isNotNull() & (F.col("delta_s") < seconds))
    share = F.col("_edits").cast("double") / F.greatest(F.col("_own"), F.col("_before"), F.lit(1))
    return _compared(x, text, "_prev", texts).withColumn("edit_fraction", share).where(F.col("edit_fraction") > fraction).drop("_prev", "_own", "_before", "_edits")


def collapse_last(obs: DataFrame, k: int | None = None, keys=("student_id", "item_id"), order: str = "attempt_id", value: str = "y") -> DataFrame:
    """The last of the first k valid observations of each pair."""
    if k is not None:
        obs = obs.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_n") <= k)
    return obs.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def ranked(df: DataFrame, *order: Column, total: str | None = None) -> DataFrame:
    """``df`` with ``_rank``, the place of each row from 0 in the order of all rows, and ``_rows``, their number; with ``total``
    also ``_before``, the sum of that column over all rows before.

    Rows are dealt by ranges of the order and numbered within each; only one row of counts for each range is gathered. The
    order should tell all rows apart.
    """
    ranged = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, w = F.shiftrightunsigned("_at", 33), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    value = F.col(total).cast("double") if total else F.lit(0.0)
    sums = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    starts = sums.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_first"), F.coalesce(F.sum("_v").over(w), F.lit(0.0)).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("_rows"))
    out = ranged.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("_rank", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    if total:
        own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        out = out.withColumn("_before", F.col("_base") + own)
    return out.drop("_part", "_at", "_first", "_base")


def top_k(df: DataFrame, k: int, keys, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def snapshots(obs: DataFrame, most: int, keys=("student_id", "item_id"), order: str = "attempt_id", value: str = "y") -> DataFrame:
    """One row for each of the first ``most`` attempts of each pair; a later one than the last carries its value forward."""
    numbered = obs.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    grid = obs.select(*keys).distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most))))
    carried = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return grid.join(numbered.select(*keys, "n", value), [*keys, "n"], "left").withColumn(value, carried).withColumn("n", F.col("n").cast("long"))


def run_counter(df: DataFrame, key: Column, by) -> DataFrame:
    """Numbers rows within each unbroken run of ``key`` among a student's rows in order."""
    w = Window.partitionBy("student_id").orderBy(*by)
    runs = df.withColumn("_new", F.when(F.lag(key).over(w) == key, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return runs.withColumn("run_attempt", (F.row_number().over(Window.partitionBy("student_id", "_run").orderBy(*by)) - 1).cast("long")).drop("_new", "_run")


def trajectory_class(lowest: Column, highest: Column) -> Column:
    return F.when(highest == 0, "always_fail").when(lowest == 1, "always_pass").otherwise("mixed")


def improvement_class(gain: Column, least: float = 0.05) -> Column:
    return F.when(gain > least, "improving").when(gain < -least, "declining").otherwise("stable")
