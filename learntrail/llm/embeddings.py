"""Near-duplicate vectors by collision-counting projections, verified in double precision."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrail.llm.common import PRIME, exchange_buckets, join_hot, mixed, table, written
from learntrail.llm.components import components
from learntrail.llm.stars import key_lists, passing_edges

COSINE = 0.98
#: Projections, the window's half-width in standard deviations of the projected distance at COSINE, and the share of
#: pairs at exactly COSINE that the needed count must pass: from these ``needed_count`` calibrates the count.
PROJECTIONS, HALF_WIDTH, RECALL = 24, 1.0, 0.9999
#: Width of a meeting cell in the same standard deviations, and the chance meetings that a row may have with unrelated rows.
CELL, CHANCE = 12.0, 0.2
BLOCK = 1024


def needed_count(projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``: a binomial tail."""
    p = math.erf(half_width / math.sqrt(2))
    tail, count = 0.0, projections + 1
    while tail < recall and count > 0:
        count -= 1
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
    return count


def same_cell(width: float) -> float:
    """The chance that two values lie in one randomly placed cell of ``width`` standard deviations of their difference."""
    return math.erf(width / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * width) * (1 - math.exp(-(width**2) / 2))


def meeting_shape(rows: int, cosine: float) -> tuple[int, int]:
    """(cells a key, keys a row): the shortest keys by which a row meets at most CHANCE of ``rows`` orthogonal ones, and so many
    keys that a pair at the threshold misses each other in all of them with probability at most 1 - RECALL."""
    spread = math.sqrt(2 * (1 - cosine))
    near, far = same_cell(CELL), same_cell(CELL * spread / math.sqrt(2))
    for cells in range(2, 128):
        keys = math.ceil(math.log(1 - RECALL) / math.log1p(-(near**cells)))
        if rows * keys * far**cells <= CHANCE:
            break
    return cells, keys


def directions_of(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((count, dim))


def window_collisions(left: np.ndarray, right: np.ndarray, half: float) -> np.ndarray:
    """(left, right) counts: on how many projections the right value lies in the window centred at the left one.

    For each projection the right values are sorted and each left value's window is one range of that order; a range is
    counted by a difference at its two ends, so a projection costs two searches a row and one pass of adding.
    """
    counts = np.zeros((left.shape[1], right.shape[1]), np.int16)
    n = right.shape[1]
    rows = np.arange(left.shape[1])
    for a, b in zip(left, right, strict=True):
        order = np.argsort(b, kind="stable")
        low, high = np.searchsorted(b[order], a - half, "left"), np.searchsorted(b[order], a + half, "right")
        edges = np.zeros((len(a), n + 1), np.int8)
        edges[rows, low] += 1
        edges[rows, high] -= 1
        counts[:, order] += np.cumsum(edges[:, :-1], axis=1, dtype=np.int8)
    return counts


def block_links(unit: np.ndarray, cluster: np.ndarray, left: np.ndarray, right: np.ndarray | None, cosine: float, need: int, half: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (positions a, b) of equal clusters: ``left`` against ``right`` rows, or ``left`` among themselves."""
    alone = right is None
    right = left if alone else right
    projected = directions_of(unit.shape[1], PROJECTIONS, 7) @ unit.T
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(left), 512):
        own = left[at : at + 512]
        a, b = np.nonzero((window_collisions(projected[:, own], projected[:, right], half) >= need) & (cluster[own][:, None] == cluster[right]))
        a, b = own[a], right[b]
        if alone:
            a, b = a[a < b], b[a < b]
        for k in range(0, len(a), 100_000):
            x, y = a[k : k + 100_000], b[k : k + 100_000]
            near = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
            found_a.append(x[near])
            found_b.append(y[near])
    return np.concatenate(found_a), np.concatenate(found_b)


def meeting_edges(classes: DataFrame, cells: int, keys: int, half: float, need: int, buckets: int) -> DataFrame:
    """Edges ``u, v`` between classes of one label that lie in the same cells of some group of sorted projections and collide in
    at least ``need`` windows of PROJECTIONS others."""
    width = CELL * half / HALF_WIDTH

    def keyed(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids, out = [], []
        for dim, own in part.groupby("dim"):
            unit = np.stack(own.unit.to_numpy()).astype(np.float64)
            lines, shift = directions_of(dim, keys * cells, 11), np.random.default_rng(13).random(keys * cells) * width
            salt = mixed(own.salt.to_numpy(np.int64).view(np.uint64))
            for t in range(keys):
                mine = slice(t * cells, (t + 1) * cells)
                at = np.floor((unit @ lines[mine].T + shift[mine]) / width).astype(np.int64).view(np.uint64)
                key = salt + np.uint64(t)
                for k in range(cells):
                    key = mixed(key * PRIME + at[:, k])
                ids.append(own.rep.to_numpy(np.int64))
                out.append(key)
        return (np.concatenate(ids), np.concatenate(out)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.uint64))

    def colliding(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        gap = np.ascontiguousarray(a).view(np.float32) - np.ascontiguousarray(b).view(np.float32)
        return (np.abs(gap) <= half * 1.0001).sum(1) >= need  # float32 projections: a hair wider

    lists = written(key_lists(classes.select("rep", "dim", "unit", F.xxhash64("label", "dim").alias("salt")), keyed, buckets))
    return passing_edges(lists, classes.select(F.col("rep").alias("id"), F.col("projected").alias("sketch")), colliding, buckets)


def projected(classes: DataFrame) -> DataFrame:
    """``classes`` with their values on PROJECTIONS directions, packed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.empty((len(batch), PROJECTIONS), np.float32)
            for dim, at in batch.groupby("dim").indices.items():
                out[at] = np.stack(batch.unit.to_numpy()[at]).astype(np.float64) @ directions_of(dim, PROJECTIONS, 7).T
            yield batch.assign(projected=[x.tobytes() for x in out])

    return classes.mapInPandas(run, "label string, key string, vec long, copies long, dim int, unit array<double>, projected binary")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for rows ``vec_id, embedding, label``; links join equal, non-null labels.

    1. Equal vectors of a label are one class, so copies cost one row. ``n_links`` counts every other row linked, copies included.
    2. Sorted projections are cut into cells; classes of a label that share all cells of some group of projections meet, and
       those that collide in enough query-centred windows of PROJECTIONS other projections join a candidate cluster. Cells,
       groups and the count are calibrated so that a pair at the threshold meets and passes with probability RECALL each, and a
       row meets hardly any unrelated one, whatever the label's size; only keys and projected values travel.
    3. In a cluster all pairs are counted by windows once more, and those that pass are verified by their cosine in double
       precision, each pair once. A cluster of over BLOCK classes is compared by pairs of blocks.
    4. Components of the verified links.

    Vectors that are null, zero, empty or hold null or non-finite components, and rows with a null label, link with nothing
    and stand alone. Vectors of different lengths don't link. Rows with a null id are left out; rows that repeat an id count
    as rows of their own. Other columns are not read.

    ``n_links`` is a count of pairs: a family of N vectors that are all near one another takes N * N / 2 cosines.
    """
    half = HALF_WIDTH * math.sqrt(2 * (1 - cosine))
    need = needed_count()
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("string").alias("label"))
    usable = F.col("label").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0)
    rows = rows.withColumn("ok", F.coalesce(usable, F.lit(False))).withColumn("key", F.when(F.col("ok"), F.sha2(F.concat_ws(",", F.transform("e", lambda v: v.cast("string"))), 256)))
    rows = written(rows)
    classes = rows.where("ok").groupBy("label", "key").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies"), F.first("e").alias("e"))
    top = F.array_max(F.transform("e", F.abs))
    scaled = F.transform("e", lambda v: v / F.col("top"))
    classes = classes.withColumn("top", top).withColumn("s", scaled).withColumn("norm", F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, v: a + v * v)))
    classes = classes.select("label", "key", "vec", "copies", F.size("e").alias("dim"), F.transform("s", lambda v: v / F.col("norm")).alias("unit"))
    classes = written(projected(classes).withColumn("rep", F.monotonically_increasing_id()))
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 0
    buckets = exchange_buckets(vectors)
    edges = meeting_edges(classes, *meeting_shape(largest, cosine), half, need, buckets)
    met = written(components(edges).select(F.col("id").alias("rep"), F.col("component").alias("cluster")))
    parts = met.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("size"))
    placed = classes.select("rep", "label", "dim", "copies", "unit").join(join_hot(met, parts, ["cluster"], "size"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    paired = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    p, q = F.least("j", "block"), F.greatest("j", "block")
    bundle = F.when(F.col("parts") > 1, F.xxhash64("cluster", p, q)).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(buckets)))
    paired = paired.select("cluster", "label", "dim", "rep", "copies", "unit", (F.col("parts") > 1).alias("large"), p.alias("p"), q.alias("q"), F.when(F.col("block") <= F.col("j"), 0).otherwise(1).alias("side"), bundle.alias("bundle"))

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        rep, copies = group.rep.to_numpy(np.int64), group["copies"].to_numpy(np.int64)
        unit, cluster = np.stack(group.unit.to_numpy()).astype(np.float64), group.cluster.to_numpy(np.int64)
        cluster = np.unique(np.stack([cluster, pd.factorize(group.label)[0]], 1), axis=0, return_inverse=True)[1].reshape(-1)  # keys of two labels may collide
        if group.large.iloc[0] and group.p.iloc[0] < group.q.iloc[0]:
            a, b = block_links(unit, cluster, np.flatnonzero(group.side == 0), np.flatnonzero(group.side == 1), cosine, need, half)
        else:  # whole clusters, some at a time
            order, found, at = np.argsort(cluster, kind="stable"), [], 0
            ends = np.flatnonzero(np.r_[np.diff(cluster[order]) != 0, True]) + 1
            while at < len(order):
                end = max(ends[np.searchsorted(ends, at + BLOCK // 2, "right") - 1], ends[np.searchsorted(ends, at, "right")])
                found.append(block_links(unit, cluster, order[at:end], None, cosine, need, half))
                at = end
            a, b = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        n = np.bincount(a, copies[b], len(rep)) + np.bincount(b, copies[a], len(rep))
        least = rep.copy()  # a forest is enough: links to the least neighbour, and what that leaves apart, by propagation
        while True:
            before = least.copy()
            np.minimum.at(least, a, before[b])
            np.minimum.at(least, b, before[a])
            if (least == before).all():
                break
        some = n > 0
        return pd.DataFrame({"rep": rep[some], "least": least[some], "n": n[some].astype(np.int64)})

    links = written(paired.groupBy("dim", "large", "bundle", "p", "q").applyInPandas(linked, "rep long, least long, n long"))
    joined = components(links.select(F.col("rep").alias("u"), F.col("least").alias("v")))
    counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
    named = classes.select("label", "key", "rep", "vec", "copies").join(counts, "rep", "left").join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    named = written(named.withColumn("component", F.coalesce("component", "rep")))
    least = named.groupBy("component").agg(F.min("vec").alias("component_id"), F.count("*").alias("size"))
    keyed = written(join_hot(named, least, ["component"], "size").select("label", "key", "copies", F.col("copies").alias("others"), "n", "component_id"))
    out = join_hot(rows.select("vec_id", "label", "key"), keyed, ["label", "key"], "copies")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", (F.coalesce(F.col("others") - 1, F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
