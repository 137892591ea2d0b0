"""Candidate links: rows that share a table key and whose sketches pass, by two packed exchanges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learntrail.llm.common import bucket_groups, exchanged, mixed

_EDGES, _KEYS, _FREQUENT = 0, 1, 2
#: Rows whose keys are made together in a task.
PART = 4000
#: A key shared by more of PART rows, or by more rows in all, isn't looked into: its rows become one cluster as they are, so
#: that nothing is lost and no list grows without bound. The exact comparison in the cluster decides.
LOCAL, LIST = 64, 4096


def _packed(kind: int, bucket: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    order = np.argsort(bucket, kind="stable")
    bucket, a, b = bucket[order], a[order], b[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    some = len(bucket) > 0
    return pd.DataFrame({"bucket": bucket[np.r_[0, cuts]].astype(np.int64) if some else [], "kind": np.int32(kind), "a": [x.tobytes() for x in np.split(a, cuts)] if some else [], "b": [x.tobytes() for x in np.split(b, cuts)] if some else []})


def _runs(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, id) in order, and the begin and the size of each key's run."""
    order = np.lexsort((ids, keys))
    ids, keys = ids[order], keys[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])][: len(keys)]
    ids, keys = ids[new], keys[new]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return ids, keys, begin, np.diff(np.r_[begin, len(keys)])


def key_lists(rows: DataFrame, keyed: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]], buckets: int) -> DataFrame:
    """``members, forced``: distinct ascending lists of the ids under one key; ``keyed`` gives ids (long) and keys (uint64) of some rows.

    Keys of one id give no list. Lists that are ``forced`` are links between an id and the least one under a very frequent key:
    of such a key only the least id of each PART rows travels. An empty table gives no lists.
    """

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PART):
                ids, keys, begin, size = _runs(*keyed(batch.iloc[at : at + PART]))
                frequent = np.repeat(size > LOCAL, size)
                hub = ids[np.repeat(begin, size)]
                rest = ~frequent | (ids == hub)
                edges = np.unique(np.stack([ids[~rest], hub[~rest]], 1), axis=0)
                yield _packed(_EDGES, (mixed(edges[:, 0].view(np.uint64)) % np.uint64(buckets)).astype(np.int64), edges[:, 0], edges[:, 1])
                for kind, some in ((_KEYS, rest & ~frequent), (_FREQUENT, rest & frequent)):
                    yield _packed(kind, (keys[some] % np.uint64(buckets)).astype(np.int64), keys[some].view(np.int64), ids[some])

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in bucket_groups(batches):
            known, own = group[group.kind == _EDGES], group[group.kind != _EDGES]
            ids, keys, begin, size = _runs(np.frombuffer(b"".join(own.b), np.int64), np.frombuffer(b"".join(own.a), np.uint64))
            frequent = np.isin(keys[begin], np.frombuffer(b"".join(own.a[own.kind == _FREQUENT]), np.uint64)) | (size > LIST)
            plain = (size > 1) & ~frequent
            lists = {ids[b : b + n].tobytes() for b, n in zip(begin[plain], size[plain], strict=True)}
            edges = [np.stack([np.frombuffer(b"".join(known.b), np.int64), np.frombuffer(b"".join(known.a), np.int64)], 1)]
            edges += [np.stack([np.full(n - 1, ids[b]), ids[b + 1 : b + n]], 1) for b, n in zip(begin[frequent], size[frequent], strict=True) if n > 1]
            pairs = np.unique(np.concatenate(edges), axis=0)
            yield pd.DataFrame({"members": pd.Series([np.frombuffer(x, np.int64) for x in sorted(lists)] + list(pairs), dtype=object), "forced": np.repeat([False, True], [len(lists), len(pairs)])})

    records = rows.mapInPandas(sent, "bucket long, kind int, a binary, b binary")
    return exchanged(records, buckets).mapInPandas(met, "members array<long>, forced boolean").distinct()


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """A spanning forest of the graph whose neighbours of x among some nodes are ``near(x, nodes)``: each node is held against the unvisited ones only."""
    left = np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = near(x, left)
            if hit.any():
                yield x, left[hit]
                queue += left[hit].tolist()
                left = left[~hit]


def passing_edges(lists: DataFrame, sketches: DataFrame, passes: Callable[[np.ndarray, np.ndarray], np.ndarray], buckets: int) -> DataFrame:
    """Edges ``u, v`` (with repeats) that join two ids of a list wherever ``passes`` says so of their sketches (``id, sketch`` rows of one width).

    ``passes`` takes two byte matrices row by row, of which one may be a single row. Of a list only a spanning forest of the
    passing pairs is returned. Forced lists pass as they are.
    """
    exploded = lists.where("NOT forced").select(F.xxhash64("members").alias("list"), F.explode("members").alias("id"))
    known = exploded.join(sketches.hint("merge"), "id").select(F.pmod("list", F.lit(buckets)).alias("bucket"), "list", "id", "sketch")

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in bucket_groups(batches):
            lists, ids = group["list"].to_numpy(np.int64), group.id.to_numpy(np.int64)
            order = np.lexsort((ids, lists))
            lists, ids = lists[order], ids[order]
            held = np.frombuffer(b"".join(group.sketch), np.uint8).reshape(len(group), -1)[order]
            begin = np.flatnonzero(np.r_[True, lists[1:] != lists[:-1]])
            size = np.diff(np.r_[begin, len(lists)])
            two = begin[size == 2]
            hit = two[passes(held[two], held[two + 1])]
            found = [(ids[hit], ids[hit + 1])]
            for b, n in zip(begin[size > 2], size[size > 2], strict=True):
                own = held[b : b + n]
                for x, others in forest(n, lambda x, some, own=own: passes(own[x : x + 1], own[some])):
                    found.append((np.full(len(others), ids[b + x]), ids[b + others]))
            edges = np.unique(np.stack([np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], 1), axis=0)
            yield pd.DataFrame({"u": edges[:, 0], "v": edges[:, 1]})

    forced = lists.where("forced").select(F.get("members", F.lit(0)).alias("u"), F.get("members", F.lit(1)).alias("v"))
    return exchanged(known, buckets).mapInPandas(met, "u long, v long").unionByName(forced)
