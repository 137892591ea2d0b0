"""Removal of repeated word windows by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrail.llm.common import as_bytes, bucket_groups, chunks, exchange_buckets, exchanged, mixed, null_safe_text, table, window_hashes, word_hashes, written

WINDOW = 13
#: Every residue modulo 7 is a difference of two elements of {0, 1, 3}: two starts of a repeated window have a shift k < 7
#: at which both are at cover positions, and the ANCHOR = 13 - 7 + 1 words from there lie inside the window.
PERIOD, COVER = 7, (0, 1, 3)
_LOCAL, _SENT = 0, 1
_NONE = np.zeros(0, np.uint32)


def _packed(kind: int, bucket: np.ndarray, ids: np.ndarray, keys: np.ndarray, at: np.ndarray, hashes: np.ndarray, more: np.ndarray) -> pd.DataFrame:
    """Records as one row for each bucket, with binary columns."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    part = lambda x: ([y.tobytes() for y in np.split(x[order], cuts)] if len(x) else [b""] * (len(cuts) + 1)) if len(bucket) else []
    return pd.DataFrame({"bucket": bucket[np.r_[0, cuts]] if len(bucket) else [], "kind": np.int32(kind), "ids": part(ids), "keys": part(keys), "at": part(at.astype(np.uint32)), "hashes": part(hashes), "more": part(more)})


_SCHEMA = "bucket long, kind int, ids binary, keys binary, at binary, hashes binary, more binary"


def _unpacked(group: pd.DataFrame) -> tuple[np.ndarray, ...]:
    kinds = {"ids": np.int64, "keys": np.int64, "at": np.uint32, "hashes": np.uint64, "more": np.uint32}
    return tuple(np.frombuffer(b"".join(group[c]), t) for c, t in kinds.items())


def _ordered(ids: np.ndarray, hashes: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by hash and id; in that order, each record's run of equal hashes, and where each run begins."""
    order = np.lexsort((ids, more, hashes) if len(more) else (ids, hashes))
    first, second = hashes[order], more[order] if len(more) else None
    new = first[1:] != first[:-1]
    if second is not None:
        new |= second[1:] != second[:-1]
    new = np.r_[True, new][: len(order)]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _by_document(keys: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """Positions gathered to one row for each document key."""
    order = np.lexsort((at, keys))
    keys, at = keys[order], at[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return pd.DataFrame({"key": keys[np.r_[0, cuts]] if len(keys) else [], "at": [x.tobytes() for x in np.split(at, cuts)] if len(keys) else []})


def _meet(records: DataFrame, buckets: int, later_only: bool) -> DataFrame:
    """``key, at``: the positions whose hash also occurs in another document; with ``later_only``, in one of a smaller id."""

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in bucket_groups(batches):
            _, keys, at, _, _ = _unpacked(group[group.kind == _LOCAL])
            ids, own, where, hashes, more = _unpacked(group[group.kind == _SENT])
            if not later_only:
                ids, hashes, more = own, more, _NONE
            order, run, first = _ordered(ids, hashes, more)
            ids, own, where = ids[order], own[order], where[order]
            if later_only:
                found = ids > ids[first][run]
            else:
                last = np.r_[first[1:], len(ids)][: len(first)] - 1
                found = (ids[last] > ids[first])[run]
            yield _by_document(np.r_[keys, own[found]], np.r_[at, where[found]])

    return exchanged(records, buckets).mapInPandas(met, "key long, at binary")


def _presettled(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, hashes: np.ndarray, more: np.ndarray, buckets: int, later_only: bool) -> Iterator[pd.DataFrame]:
    """What one batch can settle alone is sent as settled, dealt by document; of a hash only the least document's records
    travel by hash, so a passage that very many documents share costs a bucket one document's records for each batch.
    Anchors need no ranks: ``ids`` are the row keys then, and aren't sent."""
    order, run, first = _ordered(ids, hashes, more)
    ids, keys, at, hashes, more = ids[order], keys[order], at[order], hashes[order], more[order] if len(more) else more
    settled = ids > ids[first][run]
    shared = settled
    if not later_only:
        last = np.r_[first[1:], len(ids)][: len(first)] - 1
        shared = (ids[last] > ids[first])[run]
    yield _packed(_LOCAL, (keys[shared].view(np.uint64) % np.uint64(buckets)).astype(np.int64), ids[:0], keys[shared], at[shared], hashes[:0], more[:0])
    rest = ~settled
    bucket = (hashes[rest] % np.uint64(buckets)).astype(np.int64)
    if later_only:
        yield _packed(_SENT, bucket, ids[rest], keys[rest], at[rest], hashes[rest], more[rest])
    else:  # a bucket holds the same number of anchors at every size: 32 bits more part them, and a false one only costs a look
        yield _packed(_SENT, bucket, ids[:0], keys[rest], at[rest], hashes[:0], (hashes[rest] >> np.uint64(32)).astype(np.uint32))


def shared_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """``key, at``: the cover positions of each document whose anchor another document has at a cover position too."""
    anchor = WINDOW - PERIOD + 1

    def anchored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, held in chunks(batch.key, batch.text):
                found = [window_hashes(word_hashes(x), anchor) for x in held]
                at = [np.flatnonzero(np.isin(np.arange(len(x)) % PERIOD, COVER)) for x in found]
                n = [len(x) for x in at]
                keys = np.repeat(np.array(rows, np.int64), n)
                yield from _presettled(keys, keys, np.concatenate(at), np.concatenate([x[a] for x, a in zip(found, at, strict=True)]), _NONE, buckets, False)

    return _meet(texts.select("key", "text").mapInPandas(anchored, _SCHEMA), buckets, False)


def repeated_windows(texts: DataFrame, anchors: DataFrame, buckets: int) -> DataFrame:
    """``key, at``: the starts of windows that also start in a document of a smaller id; only windows round shared anchors are extended.

    Windows are equal if two hashes of their words are, of 96 bits together: among 10**14 windows a false match has a chance under 0.1.
    """
    reach = WINDOW - PERIOD

    def extended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, held in chunks(zip(batch.doc_id, batch.key, batch["at"], strict=True), batch.text):
                ids, keys, starts, hashes, more = [], [], [], [], []
                for (doc, key, at), text in zip(rows, held, strict=True):
                    words = word_hashes(text)
                    windows = window_hashes(words, WINDOW)
                    near = np.zeros(len(windows) + WINDOW, bool)
                    where = np.frombuffer(b"".join(at), np.uint32).astype(np.int64)
                    for k in range(reach + 1):
                        near[np.maximum(where - k, 0)] = True
                    mine = np.flatnonzero(near[: len(windows)])
                    ids.append(np.full(len(mine), doc, np.int64))
                    keys.append(np.full(len(mine), key, np.int64))
                    starts.append(mine)
                    hashes.append(windows[mine])
                    more.append((window_hashes(mixed(words), WINDOW)[mine] >> np.uint64(32)).astype(np.uint32))
                yield from _presettled(*map(np.concatenate, (ids, keys, starts, hashes, more)), buckets, True)

    gathered = anchors.groupBy("key").agg(F.collect_list("at").alias("at"))
    return _meet(texts.join(gathered, "key").mapInPandas(extended, _SCHEMA), buckets, True)


def remove_repeats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, with ``keep_text``, ``text`` (the kept words joined by one space).

    Words are runs of anything but the six ASCII white-space characters, unchanged. Each word that lies in a window of 13
    words whose sequence also starts in a document of a smaller id goes; windows are judged on the input. Null text has no
    words. Rows with a null id have no rank among documents: they are returned whole and take part in nothing. Rows that
    repeat an id don't remove each other. Other columns are not read.

    Anchors (three of seven positions) are exchanged first; only documents that share one are read for the second exchange,
    of whole windows. Both exchanges carry packed arrays in buckets, whose number grows with the input's partitions while that
    of partitions is bounded.
    """
    buckets = exchange_buckets(docs)
    texts = null_safe_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").withColumn("key", F.xxhash64("doc_id", "text"))
    known = texts.where("doc_id IS NOT NULL")
    anchors = written(shared_anchors(known, buckets))
    windows = written(repeated_windows(known, anchors, buckets))
    packer = "key long, doc_id long, data binary"

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pd.DataFrame({"key": batch.key, "doc_id": batch.doc_id, "data": [press.compress(as_bytes(x)) for x in batch.text]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, data, at in zip(batch.doc_id, batch["data"], batch["at"], strict=True):
                words = zstandard.decompress(data).split() if len(data) else []
                gone = np.zeros(len(words) + 1, np.int32)
                if at is not None and len(at):
                    starts = np.unique(np.frombuffer(b"".join(at), np.uint32)).astype(np.int64)
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + WINDOW, -1)
                covered = np.cumsum(gone[:-1]) > 0
                kept = b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]) if covered.any() else b" ".join(words)
                rows.append((doc, len(words), int(covered.sum()), hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "surrogatepass")] if keep_text else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *(["text"] if keep_text else [])])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    gathered = windows.groupBy("key").agg(F.collect_list("at").alias("at"))
    return texts.mapInPandas(pack, packer).join(gathered, "key", "left").mapInPandas(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text)


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
