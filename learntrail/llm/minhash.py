"""Near-duplicate documents by tensored MinHash tables, with exact verification of whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrail.llm.common import PRIME, chunks, exchange_buckets, join_hot, mixed, null_safe_text, table, window_hashes, word_hashes, written
from learntrail.llm.components import components
from learntrail.llm.stars import key_lists, passing_edges

WIDTH = 5
PERCENT = 75
#: Two families of SIDE collections of ROWS minhashes each give SIDE * SIDE tables of 2 * ROWS rows a key: 36 minhashes for
#: 81 tables, where plain banding would need 324. A pair at similarity 0.75 shares no key with probability 2 * (1 - 0.75**2)**9 < 0.0013.
SIDE, ROWS = 9, 2
#: Ranges of a sketch, and how many standard deviations below the threshold its estimate may lie: a pair at the threshold fails with probability under 0.0001.
BINS, SIGMAS = 128, 4.0
_BOUNDS = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
#: Shingles and documents compared in one group; larger candidate clusters are compared block by block, with PIVOTS of the cluster in each.
BLOCK_SHINGLES, BLOCK_DOCS, PIVOTS = 600_000, 1500, 8
_SEEDS = np.random.default_rng(20240607).integers(1, 2**63, (2 * SIDE * ROWS, 2), dtype=np.uint64) | np.uint64(1)


def shingle_set(data: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; of the whole sequence if it is shorter; empty without words."""
    words = word_hashes(data.lower())
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, min(width, len(words))) ^ np.uint64(min(width, len(words))))


def collection_values(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set, the values of the 2 * SIDE small collections: (sets, 2 * SIDE)."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
    out = np.zeros((len(sets), 2 * SIDE), np.uint64)
    for k, (a, b) in enumerate(_SEEDS):
        low = np.minimum.reduceat(mixed(joined * a + b), starts)
        out[:, k // ROWS] = mixed(out[:, k // ROWS] * PRIME + low)
    return out


def tensored_keys(values: np.ndarray) -> np.ndarray:
    """(sets, SIDE * SIDE) table keys: each pairs a collection of the first family with one of the second."""
    left, right = values[:, :SIDE], values[:, SIDE:]
    keys = mixed(left[:, :, None] * PRIME + right[:, None, :]).reshape(len(values), SIDE * SIDE)
    return mixed(keys + np.arange(SIDE * SIDE, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


def sketch(values: np.ndarray) -> bytes:
    """The set's size and, of each of BINS equal ranges of hashes, one byte of the least hash in it: a one-permutation sketch. Empty ranges hold 0."""
    at = np.searchsorted(values, _BOUNDS)
    there = np.r_[at[1:], len(values)] > at
    out = np.zeros(BINS, np.uint8)
    out[there] = values[at[there]] % np.uint64(255) + np.uint64(1)
    return np.int64(len(values)).tobytes() + out.tobytes()


def sketches_pass(left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Whether two sketches may belong to sets at the threshold: sizes allow it, and the share of equal ranges lies at most SIGMAS deviations below it."""
    a, b = (np.ascontiguousarray(x[:, :8]).view(np.int64)[:, 0] for x in (left, right))
    fits = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    one, two = left[:, 8:], right[:, 8:]
    used, equal = ((one | two) > 0).sum(1), ((one == two) & (one > 0)).sum(1)
    p = percent / 100
    return fits & (equal >= used * p - SIGMAS * np.sqrt(used * p * (1 - p)))


def signatures(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc_id, key, n_shingles, h1, h2, sig, sketch``: the set's size, two hashes that tell equal sets, the collections' values, a sketch."""

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, held in chunks(zip(batch.doc_id, batch.key, strict=True), batch.text):
                sets = [shingle_set(x, width) for x in held]
                full = [k for k, x in enumerate(sets) if len(x)]
                values = collection_values([sets[k] for k in full]) if full else np.zeros((0, 0), np.uint64)
                sig: list = [None] * len(sets)
                for k, row in zip(full, values, strict=True):
                    sig[k] = row.tobytes()
                two = [[np.int64(np.uint64(xxhash.xxh3_64_intdigest(x.tobytes(), seed)).astype(np.int64)) for x in sets] for seed in (1, 2)]
                yield pd.DataFrame({"doc_id": [r[0] for r in rows], "key": [r[1] for r in rows], "n_shingles": [len(x) for x in sets], "h1": two[0], "h2": two[1], "sig": sig, "sketch": [sketch(x) for x in sets]})

    return docs.mapInPandas(signed, "doc_id long, key long, n_shingles long, h1 long, h2 long, sig binary, sketch binary")


def candidate_edges(classes: DataFrame, buckets: int, percent: int = PERCENT) -> DataFrame:
    """Edges ``u, v`` that join classes which share a table key and whose sketches pass."""

    def keyed(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        keys = tensored_keys(np.frombuffer(b"".join(part.sig), np.uint64).reshape(len(part), 2 * SIDE)).ravel()
        return np.repeat(part.rep.to_numpy(np.int64), SIDE * SIDE), keys

    lists = written(key_lists(classes.select("rep", "sig"), keyed, buckets))
    return passing_edges(lists, classes.select(F.col("rep").alias("id"), "sketch"), lambda a, b: sketches_pass(a, b, percent), buckets)


def linked_forest(ids: np.ndarray, sets: list[np.ndarray], groups: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (id, least id of its component here) among sets with 100 * intersection >= percent * union, within each of ``groups``."""
    n, sizes = len(ids), np.array([len(x) for x in sets], np.int64)
    values = np.concatenate([x ^ mixed(np.full(1, g, np.int64).view(np.uint64)) for x, g in zip(sets, groups, strict=True)])
    owners = np.repeat(np.arange(n), sizes)
    order = np.lexsort((owners, values))
    values, owners = values[order], owners[order]
    begins = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    runs = np.diff(np.r_[begins, len(values)])
    counts = np.zeros((n, n), np.int32)
    sparse: list[np.ndarray] = []
    for length in np.unique(runs[runs > 1]):
        mine = begins[runs == length]
        if length > 200:
            for b in mine:
                who = owners[b : b + length]
                counts[np.ix_(who, who)] += 1
            continue
        a, b = np.triu_indices(length, 1)
        step = max(1, 4_000_000 // len(a))
        for at in range(0, len(mine), step):
            who = owners[mine[at : at + step, None] + np.arange(length)]
            flat = (who[:, a] * n + who[:, b]).ravel()
            if len(flat) > n * n // 8:
                counts += np.bincount(flat, minlength=n * n).reshape(n, n).astype(np.int32)
            else:
                sparse.append(flat)
                if sum(map(len, sparse)) > 8_000_000:
                    found, times = np.unique(np.concatenate(sparse), return_counts=True)
                    counts.ravel()[found] += times.astype(np.int32)
                    sparse = []
    if sparse:
        found, times = np.unique(np.concatenate(sparse), return_counts=True)
        counts.ravel()[found] += times.astype(np.int32)
    a, b = np.nonzero(np.triu(counts, 1))
    both = counts[a, b].astype(np.int64)
    linked = 100 * both >= percent * (sizes[a] + sizes[b] - both)
    parent = np.arange(n)
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    order = np.argsort(ids, kind="stable")

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(rank[a[linked]].tolist(), rank[b[linked]].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    tops = [root(x) for x in range(n)]
    return [(int(ids[order[x]]), int(ids[order[t]])) for x, t in enumerate(tops) if t != x]


def _verified(texts: DataFrame, tasks: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``u, v, large`` among the classes of each task: ``tasks`` has ``rep, key, cluster, large, task``; ``key`` is the row whose text stands for the class."""

    def verified(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("rep")
        sets = [shingle_set(x.encode("utf-8", "surrogatepass"), width) for x in group.text]
        ids, keys, found, some = group.rep.to_numpy(np.int64), group.cluster.to_numpy(np.int64), [], []
        order = np.argsort(keys, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):  # clusters of a bundle in turn, some at a time
            if some and (len(some) + len(own) > BLOCK_DOCS or sum(len(sets[k]) for k in some) > BLOCK_SHINGLES):
                found += linked_forest(ids[some], [sets[k] for k in some], keys[some], percent)
                some = []
            some = [*some, *own]
        found += linked_forest(ids[some], [sets[k] for k in some], keys[some], percent)
        return pd.DataFrame({"u": [x[0] for x in found], "v": [x[1] for x in found]}, dtype="int64").assign(large=bool(group.large.iloc[0]))

    members = texts.select("key", "text").join(tasks.hint("merge"), "key")
    return members.groupBy("task").applyInPandas(verified, "u long, v long, large boolean")


def _parts(n: str = "n"):
    return F.greatest(F.ceil(F.sum(n) / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int")


def verified_links(texts: DataFrame, clusters: DataFrame, buckets: int, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``u, v``: links that span each component of the exact comparison in each cluster of ``rep, key, n, cluster`` rows.

    A small cluster is compared in one task. A large one first in blocks, each with a few pivots of the cluster, which joins
    near copies at a cost that follows their number; then the classes that its largest component has not taken up are held
    against all others, block by block. So only two classes of that component are never compared, and they are linked already.
    """
    pivots = F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("rep", F.lit(s)).alias("x"), F.struct("rep", "key").alias("r")))["r"] for s in range(PIVOTS)]))
    weight = clusters.groupBy("cluster").agg(_parts().alias("parts"), F.count("*").alias("size"), pivots.alias("pivots"))
    placed = join_hot(clusters, weight.select("cluster", "parts", "size"), ["cluster"], "size").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("long"))
    large = F.col("parts") > 1
    own = placed.select("rep", "key", "cluster", large.alias("large"), F.when(large, F.xxhash64("cluster", "block")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(buckets))).alias("task"))
    spread = weight.where(large).select("cluster", F.explode("pivots").alias("r"), "parts").select("r.rep", "r.key", "cluster", F.lit(True).alias("large"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"))
    spread = spread.select("rep", "key", "cluster", "large", F.xxhash64("cluster", F.col("block").cast("long")).alias("task"))
    first = written(_verified(texts, own.unionByName(spread), width, percent))
    if weight.where(large).isEmpty():
        return first.select("u", "v")
    joined = components(first.where("large").select("u", "v")).select(F.col("id").alias("rep"), F.col("component").alias("c"))
    state = written(placed.where(large).join(joined, "rep", "left").withColumn("c", F.coalesce("c", "rep")))
    main = state.groupBy("cluster", "c").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max(F.struct("k", "c"))["c"].alias("main"), F.sum("k").alias("size"))
    outside = written(join_hot(state, main, ["cluster"], "size").where("c <> main").select("rep", "key", "n", "cluster", "parts"))
    if outside.isEmpty():
        return first.select("u", "v")
    slices = outside.groupBy("cluster").agg(_parts().alias("slices"), F.count("*").alias("size"))
    outside = join_hot(outside, slices, ["cluster"], "size", "inner").withColumn("slice", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("slices")).cast("long"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    left = outside.select("rep", "key", "cluster", "slice", upto("parts").alias("block"))
    against = join_hot(state, state.groupBy("cluster").agg(F.count("*").alias("size")).join(slices.select("cluster", "slices"), "cluster"), ["cluster"], "size", "inner")
    right = against.select("rep", "key", "cluster", upto("slices").alias("slice"), "block")
    tasks = left.unionByName(right).select("rep", "key", "cluster", F.lit(True).alias("large"), F.xxhash64("cluster", "slice", "block").alias("task"))
    return first.select("u", "v").unionByName(written(_verified(texts, tasks, width, percent)).select("u", "v"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, keep_key: bool = False) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row with a doc_id.

    1. One pass over the texts gives each document's set size, set hashes, small minhash collections and a sketch.
    2. Documents with equal sets are one class, so copies cost one row.
    3. Classes meet in the tensored tables. Two that share a key are held against each other by sketch, and only those that
       may reach the threshold join a candidate cluster; a text that shares no more than boilerplate joins none.
    4. Inside a cluster whole sets are compared exactly (``verified_links``).
    5. Components of the verified links; a document is kept if its id is the least of its component.

    Null or blank texts have no shingles and stand alone. Rows with a null id are left out. Rows that repeat an id are
    documents of their own: each has the component of its own text. Other columns are not read. With ``keep_key`` there are two
    columns more: ``key``, xxhash64 of id and text, and ``stays``, true for one (id, text) of each component. Every table of links is
    distributed; none goes to the driver.
    """
    buckets = exchange_buckets(docs)
    texts = null_safe_text(docs.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").withColumn("key", F.xxhash64("doc_id", "text"))
    signed = written(signatures(texts, width))
    full = signed.where("n_shingles > 0")
    some = [F.first(c).alias(c) for c in ("sig", "sketch")]
    classes = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "key")).alias("least"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), *some)
    classes = written(classes.withColumn("key", F.col("least.key")).withColumn("rep", F.monotonically_increasing_id()))
    clusters = components(candidate_edges(classes, buckets, percent)).select(F.col("id").alias("rep"), F.col("component").alias("cluster"))
    clusters = written(clusters.join(classes.select("rep", "key", "n"), "rep"))
    links = components(verified_links(texts, clusters, buckets, width, percent))
    named = classes.select("h1", "h2", "rep", "least", "copies").join(links.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = written(named)
    least = named.groupBy("component").agg(F.min("least").alias("top"), F.count("*").alias("size"))
    named = join_hot(named.select("h1", "h2", "copies", "component"), least, ["component"], "size")
    out = join_hot(signed.select("doc_id", "key", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("h1")).alias("h1"), "h2"), written(named.select("h1", "h2", "copies", "top")), ["h1", "h2"], "copies")
    component = F.coalesce("top.doc_id", "doc_id")
    more = [F.col("key"), (F.coalesce("top.key", "key") == F.col("key")).alias("stays")] if keep_key else []
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"), *more)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
