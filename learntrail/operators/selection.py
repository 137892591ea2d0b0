"""Exact quantiles of groups of any size by selection on ordered bits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learntrail.sources.tables import checkpointed

#: Bits of a value that one pass decides: a range has at most 2**16 counters.
STEP = 16
_LOW = (1 << 63) - 1


def ordered_bits(value: Column) -> Column:
    """A double's 64 bits as a whole number that orders like it; both zeros are one."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + 0.0).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(_LOW))).otherwise(bits)


def from_bits(bits: Column) -> Column:
    """The double of ``ordered_bits``."""
    back = F.when(bits < 0, bits.bitwiseXOR(F.lit(_LOW))).otherwise(bits)
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), back).cast("double")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, probs: dict[str, float]) -> DataFrame:
    """``keys`` and a column for each of ``probs`` (name: share), interpolated between neighbours as ``percentile`` does.

    Four passes, each a histogram of 16 more bits of the values that lie in a wanted rank's range so far: a task holds at most
    2**16 counters a range, whatever a group's number of distinct values; all ranks and groups narrow together. Nulls and NaN are
    left out; a group with nothing else has null quantiles, and without keys there is always one row. Null keys are a group.
    """
    keys = list(keys)
    value = F.col(value) if isinstance(value, str) else value
    same = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], [F.col(k).isNull() for k in keys]
    group = F.struct(F.lit(0), *same[0], *same[1]).cast("string") if keys else F.lit("")
    rows = df.select(*keys, group.alias("_g"), F.nanvl(value.cast("double"), F.lit(None).cast("double")).alias("_v"))
    bits = checkpointed(rows.where("_v IS NOT NULL").select("_g", ordered_bits(F.col("_v")).alias("_b")))
    groups = rows.groupBy("_g", *keys).agg(F.count("_v").alias("_n")) if keys else rows.agg(F.count("_v").alias("_n")).withColumn("_g", F.lit(""))
    groups = checkpointed(groups)
    places = {name: (F.col("_n") - 1) * F.lit(p) for name, p in probs.items()}
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(p), F.ceil(p)) for p in places.values()])))
    found = groups.where("_n > 0").select("_g", F.explode(ranks).alias("_rank")).withColumn("_left", F.col("_rank")).withColumn("_in", F.lit(0).cast("long"))
    for shift in range(64 - STEP, -1, -STEP):
        parent = F.shiftright("_b", shift + STEP) if shift + STEP < 64 else F.lit(0).cast("long")
        part = bits.select("_g", parent.alias("_in"), F.shiftright("_b", shift).alias("_to"))
        if shift + STEP < 64:
            part = part.join(found.select("_g", "_in").distinct(), ["_g", "_in"], "left_semi")
        counts = part.groupBy("_g", "_in", "_to").agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy("_g", "_in").orderBy("_to").rowsBetween(Window.unboundedPreceding, 0))
        counts = counts.withColumn("_upto", upto)
        hit = found.join(counts, ["_g", "_in"]).where("_left < _upto AND _left >= _upto - _c")
        found = checkpointed(hit.select("_g", "_rank", (F.col("_left") - F.col("_upto") + F.col("_c")).alias("_left"), F.col("_to").alias("_in")))
    values = found.select("_g", "_rank", from_bits(F.col("_in")).alias("_x")).groupBy("_g").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))

    def quantile(name: str) -> Column:
        place = places[name]
        low, high = F.col("_at")[F.floor(place)], F.col("_at")[F.ceil(place)]
        share = place - F.floor(place)
        return F.when(F.col("_n") > 0, F.when(share == 0, low).otherwise(low * (1 - share) + high * share)).alias(name)

    return groups.join(values, "_g", "left").select(*keys, *[quantile(n) for n in probs])
