"""The attempt log as a stream: windowed counts with a watermark, resumable appends, running ratings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Attempts and mean value for each window and kind; rows later than ``late`` are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def first_attempts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event once within the watermark, for sinks that are written again after a failure."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_rating(events: DataFrame, k: float = 0.4) -> DataFrame:
    """A rating for each learner, kept as state across batches: ``student_id, theta, n``."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        theta, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for y in rows.y:
            theta += k * (y - 1 / (1 + 2.718281828459045**-theta))
            n += 1
        state.update((theta, n))
        yield pd.DataFrame({"student_id": [key[0]], "theta": [theta], "n": [n]})

    return events.withColumnRenamed("user_id", "student_id").groupBy("student_id").applyInPandasWithState(update, "student_id long, theta double, n long", "theta double, n long", "update", GroupStateTimeout.NoTimeout)
