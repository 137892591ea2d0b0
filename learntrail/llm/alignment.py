"""Alignment of two tokenizers' tokens by sparse products of token-byte and token-group incidence matrices."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from sentencepiece import sentencepiece_model_pb2

from learntrail.llm import bpe
from learntrail.llm.common import exchanged, null_safe_text, ragged, table, written

FIRST, SECOND = "byte_bpe_50k", "piece_bpe_32k"
#: Characters whose links ask for their counts together; a longer text is alone.
BLOCK = 4_000_000
#: Terms of a sparse product made at a time.
TERMS = 1_000_000
#: Fewest and most parts of the table of id pairs.
LEAST, MOST = 48, 4096


@dataclass
class Csr:
    """A sparse matrix by rows: row i has ``columns`` and ``values`` from ``starts[i]`` to ``starts[i + 1]``, columns rising."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.starts)

    def transposed(self) -> Csr:
        order = np.argsort(self.columns, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(self.columns, minlength=self.width))]
        return Csr(starts, np.repeat(np.arange(len(self.sizes)), self.sizes)[order], self.values[order], len(self.sizes))

    def rows(self, begin: int, end: int) -> Csr:
        a, b = self.starts[begin], self.starts[end]
        return Csr(self.starts[begin : end + 1] - a, self.columns[a:b], self.values[a:b], self.width)

    def times(self, other: Csr) -> Csr:
        """Gustavson's product: row i is the sum of ``other``'s rows k, weighted by this row's values at k."""
        sizes = other.sizes[self.columns]
        own = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = np.repeat(other.starts[self.columns], sizes) + ragged(sizes)
        keys = np.repeat(own, sizes) * np.int64(other.width) + other.columns[at]
        values = np.repeat(self.values, sizes) * other.values[at]
        if len(keys) and (keys[1:] < keys[:-1]).any():
            order = np.argsort(keys, kind="stable")
            keys, values = keys[order], values[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        keys, values = keys[first], np.add.reduceat(values, first) if len(first) else values
        starts = np.r_[0, np.cumsum(np.bincount(keys // other.width, minlength=len(self.sizes)))]
        return Csr(starts, keys % other.width, values, other.width)


def product_entries(a: Csr, b: Csr, terms: int = TERMS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of ``a`` times ``b``, some rows of ``a`` at a time so that about ``terms`` terms are held."""
    work = np.r_[0, np.cumsum(b.sizes[a.columns])][a.starts]
    begin = 0
    while begin < len(a.sizes):
        end = max(begin + 1, int(np.searchsorted(work, work[begin] + terms, "right")) - 1)
        part = a.rows(begin, end).times(b)
        yield begin + np.repeat(np.arange(end - begin), part.sizes), part.columns, part.values
        begin = end


def byte_incidence(lengths: np.ndarray) -> Csr:
    """Tokens times bytes, for tokens of the given lengths one after another: 1 where a token covers a byte."""
    total = int(lengths.sum())
    return Csr(np.r_[0, np.cumsum(lengths)], np.arange(total), np.ones(total, np.int64), total)


def group_incidence(groups: np.ndarray, n_groups: int) -> Csr:
    """Tokens times groups: 1 at a token's group."""
    return Csr(np.arange(len(groups) + 1), groups, np.ones(len(groups), np.int64), n_groups)


def overlap_links(a_lengths: np.ndarray, b_lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of an A and a B token whose byte ranges overlap and how many bytes they share: A times B transposed."""
    parts = list(product_entries(byte_incidence(a_lengths), byte_incidence(b_lengths).transposed()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def shared_group_links(a_groups: np.ndarray, b_groups: np.ndarray, n_groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of an A and a B token of one group, some rows at a time: the entries of the product of the group incidences."""
    for rows, columns, _ in product_entries(group_incidence(a_groups, n_groups), group_incidence(b_groups, n_groups).transposed()):
        yield rows, columns


#: A space after another sign.
_CUT = re.compile("(?<=[^ ]) ")
#: Most chunks, and ids of chunks, that a worker keeps.
KEPT, KEPT_IDS = 300_000, 3_000_000


class Pieces:
    """A sentence-piece model's ids of batches of texts; ids of chunks seen before are kept.

    No merge leads from another sign to a space if no piece does, so a BPE model that takes texts as they are (no rules of
    normalisation, spaces kept, one put before) gives a text the ids of its parts at such spaces. Other models get whole texts.
    """

    def __init__(self, model: sentencepiece.SentencePieceProcessor):
        self.model = model
        proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        rules, kind = proto.normalizer_spec, proto.trainer_spec
        plain = not rules.precompiled_charsmap and rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces
        crossing = any("▁" in x.piece.lstrip("▁") for x in proto.pieces)
        self.parted = plain and not crossing and kind.model_type == kind.BPE and not kind.treat_whitespace_as_suffix and all(x.type in (x.NORMAL, x.BYTE, x.CONTROL, x.UNKNOWN) for x in proto.pieces)
        self._empty()

    def _empty(self) -> None:
        self.noted: list[str] = []
        self.done = 1
        self.numbers = bpe._Numbers(self, "")
        self.numbers[""] = 0  # the space that ends a text
        self.ids = np.array(self.model.encode("x ")[len(self.model.encode("x")) :], np.int32)
        self.counts = np.array([len(self.ids)], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row and how many each text has."""
        if not self.parted:
            return _flat(self.model.encode(texts, num_threads=1))
        if self.done > KEPT or len(self.ids) > KEPT_IDS:
            self._empty()
        known = self.numbers.__getitem__
        numbers = [list(map(known, x.split(" ") if "  " not in x and x[0] != " " else _CUT.split(x))) if x else [] for x in texts]
        if self.noted:
            ids, counts = _flat(self.model.encode(self.noted, num_threads=1))
            self.done += len(self.noted)
            self.noted.clear()
            self.ids, self.counts = np.concatenate([self.ids, ids.astype(np.int32)]), np.concatenate([self.counts, counts])
        chunk, sizes = _flat(numbers)
        counts = self.counts[chunk]
        ids = self.ids[np.repeat((np.cumsum(self.counts) - self.counts)[chunk], counts) + ragged(counts)].astype(np.int64)
        ends, upto = np.r_[0, np.cumsum(counts)], np.cumsum(sizes)
        return ids, ends[upto] - ends[upto - sizes]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(counts.sum())), counts


class Tokenizers:
    """A: a byte-level BPE's ids of a space and the text. B: a sentence-piece model's ids of the text, to which it adds the space."""

    def __init__(self, first: str = FIRST, second: str = SECOND):
        self.a = bpe.Encoder(first, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{second}.model"))
        self.pieces = Pieces(self.b)
        piece = lambda k: bytes([int(self.b.id_to_piece(k)[3:-1], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode("utf-8")
        self.a_tokens, self.b_tokens = self.a.merges.tokens, bpe.Packed([piece(k) for k in range(len(self.b))])
        self.numbers = bpe.Packed([b"%d," % k for k in range(max(len(self.a_tokens.lengths), len(self.b)))])

    def align(self, texts: list[str]) -> Aligned:
        """The tokens of all texts, cut into groups where both end."""
        a_ids, a_counts = self.a.encode([" " + x for x in texts])
        b_ids, b_counts = self.pieces.encode(texts)
        a_raw, b_raw = _joined(self.a_tokens, a_ids, a_counts), _joined(self.b_tokens, b_ids, b_counts)
        fits = np.array([bool(x) and a == (own := b" " + x.encode("utf-8", "surrogatepass")) and b == own for x, a, b in zip(texts, a_raw, b_raw, strict=True)], bool)
        a_ids, b_ids = a_ids[np.repeat(fits, a_counts)].astype(np.int64), b_ids[np.repeat(fits, b_counts)]
        a_counts, b_counts = a_counts * fits, b_counts * fits
        a_lengths, b_lengths = self.a_tokens.lengths[a_ids], self.b_tokens.lengths[b_ids]
        a_ends, b_ends = np.cumsum(a_lengths), np.cumsum(b_lengths)
        cuts = a_ends[np.isin(a_ends, b_ends, assume_unique=True)]
        rows, columns, shared = overlap_links(a_lengths, b_lengths)
        return Aligned(a_ids, b_ids, a_counts, b_counts, np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends), len(cuts), rows, columns, shared)

    def group_digests(self, x: Aligned) -> list[str]:
        """Of each text, the SHA-256 of its groups as ``a1,a2|b1;a3|b2,b3``; empty for a text without tokens."""
        a_at = np.arange(len(x.a_ids)) + np.searchsorted(x.b_groups, x.a_groups, "left")
        b_at = np.arange(len(x.b_ids)) + np.searchsorted(x.a_groups, x.b_groups, "right")
        ids, signs = np.zeros(len(a_at) + len(b_at), np.int64), np.full(len(a_at) + len(b_at), ord(","), np.uint8)
        ids[a_at], ids[b_at] = x.a_ids, x.b_ids
        for at, groups, sign in ((a_at, x.a_groups, "|"), (b_at, x.b_groups, ";")):
            signs[at[np.flatnonzero(np.r_[groups[1:] != groups[:-1], True])] if len(at) else at] = ord(sign)
        data, lengths = self.numbers.gather(ids)
        ends = np.cumsum(lengths)
        data[ends - 1] = signs
        raw, bounds = data.tobytes(), np.r_[0, ends][np.r_[0, np.cumsum(x.a_counts + x.b_counts)]].tolist()
        return [hashlib.sha256(raw[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _joined(tokens: bpe.Packed, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    data, lengths = tokens.gather(ids)
    raw, ends = data.tobytes(), np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]].tolist()
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@dataclass
class Aligned:
    """The tokens of some texts in a row, their groups, and the overlap links by position in these rows."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_counts: np.ndarray  # of each text
    b_counts: np.ndarray
    a_groups: np.ndarray
    b_groups: np.ndarray
    n_groups: int
    rows: np.ndarray
    columns: np.ndarray
    shared: np.ndarray

    def by_text(self) -> pd.DataFrame:
        """For each text: numbers of tokens, groups, overlap links, and of pairs of one group."""
        n, a_text, b_text = len(self.a_counts), *(np.repeat(np.arange(len(c)), c) for c in (self.a_counts, self.b_counts))
        group_text = np.zeros(self.n_groups, np.int64)
        group_text[self.b_groups] = b_text
        pairs = np.bincount(self.a_groups, minlength=self.n_groups) * np.bincount(self.b_groups, minlength=self.n_groups)  # the entries of that product, without making them
        of = lambda text, weights=None: np.bincount(text, weights, minlength=n).astype(np.int64)
        return pd.DataFrame({"n_a": self.a_counts, "n_b": self.b_counts, "n_groups": of(group_text), "n_links": of(a_text[self.rows]), "n_shared": of(group_text, pairs)})


_LOADED: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(first: str = FIRST, second: str = SECOND) -> Tokenizers:
    """Both tokenizers, loaded once in each Python worker."""
    if (first, second) not in _LOADED:
        _LOADED[first, second] = Tokenizers(first, second)
    return _LOADED[first, second]


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values.astype(np.int32)))


def align_documents(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """The alignment of each whole text: ``doc_id``, ``a_ids, b_ids`` (tokens), ``a_groups, b_groups`` (each token's group, from 0), and
    the overlap links as ``link_a, link_b`` (token positions) and ``link_bytes`` (bytes shared).

    Tokens of one group are the shared-group links (``shared_group_links`` makes the pairs); they are given by group and not
    pair by pair, since a group's pairs grow with its square. Texts that are null, empty, or whose tokens' bytes are not those of a space and the text (a sign
    that a model writes otherwise) have no tokens. Repeated rows and null ids are kept as they come; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tokenizers(first, second)
        for batch in batches:
            for begin, texts in bpe.text_slices(batch):
                x, end = known.align(texts), begin + len(texts)
                a_text = np.repeat(np.arange(end - begin), x.a_counts)
                a_first, b_first = np.cumsum(x.a_counts) - x.a_counts, np.cumsum(x.b_counts) - x.b_counts
                group_first = np.zeros(end - begin, np.int64)
                group_first[x.a_counts > 0] = x.a_groups[a_first[x.a_counts > 0]]
                text, links = a_text[x.rows], np.bincount(a_text[x.rows], minlength=end - begin)
                columns = [
                    batch.column("doc_id").slice(begin, end - begin), _lists(x.a_ids, x.a_counts), _lists(x.b_ids, x.b_counts), _lists(x.a_groups - np.repeat(group_first, x.a_counts), x.a_counts), _lists(x.b_groups - np.repeat(group_first, x.b_counts), x.b_counts),
                    _lists(x.rows - a_first[text], links), _lists(x.columns - b_first[text], links), _lists(x.shared, links),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "a_ids", "b_ids", "a_groups", "b_groups", "link_a", "link_b", "link_bytes"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return null_safe_text(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} array<int>" for c in ("a_ids", "b_ids", "a_groups", "b_groups", "link_a", "link_b", "link_bytes")))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, at = np.unique(keys, return_inverse=True)
    total = np.zeros(len(own), np.int64)
    np.add.at(total, at, counts)
    return own, total


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_shared")


def _requests(docs: DataFrame, buckets: int, first: str, second: str) -> DataFrame:
    """Rows of kind 1, one for each document: numbers, digest, and in ``keys`` its links as places in its block's pairs (sorted
    differences). Rows of kind 0: of each block and bucket (B id modulo ``buckets``), the pairs and how many links have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = tokenizers(first, second), TaskContext.get().partitionId() << 32
        wide = np.int64(len(known.a_tokens.lengths))
        held: list[tuple] = []

        def record(n: int, **known: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(n, f.type) for f in schema], schema=schema)

        def rows() -> Iterator[pa.RecordBatch]:
            ids, numbers, digests, keys = zip(*held, strict=True)
            numbers, keys = pd.concat(numbers, ignore_index=True), np.concatenate(keys)
            own, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
            bucket = own // wide % buckets
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(own), np.int64)
            place[order] = np.arange(len(own))
            links = numbers.n_links.to_numpy()
            text = np.repeat(np.arange(len(links)), links)
            places = np.sort(text << np.int64(32) | place[at]) & np.int64(0xFFFFFFFF)
            ends = np.r_[0, np.cumsum(links)]
            begun = ends[:-1][links > 0]
            steps = np.diff(places, prepend=0)
            steps[begun] = places[begun]
            raw = steps.astype("<i4").tobytes()
            steps = [raw[4 * a : 4 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield record(len(links), kind=[1] * len(links), block=[block] * len(links), doc_id=list(chain.from_iterable(ids)), groups_sha256=list(chain.from_iterable(digests)), keys=steps, **{c: numbers[c].tolist() for c in NUMBERS})
            bucket, own, counts = bucket[order], own[order], counts[order]
            begins = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
            bounds = list(zip(begins.tolist(), [*begins[1:].tolist(), len(bucket)], strict=True)) if len(begins) else []
            yield record(len(bounds), kind=[0] * len(bounds), block=[block] * len(bounds), bucket=bucket[begins].tolist(), keys=[own[a:b].astype("<i8").tobytes() for a, b in bounds], counts=[counts[a:b].astype("<i8").tobytes() for a, b in bounds])

        size = 0
        for batch in batches:
            for begin, texts in bpe.text_slices(batch):
                x = known.align(texts)
                held.append((batch.column("doc_id").slice(begin, len(texts)).to_pylist(), x.by_text(), known.group_digests(x), x.b_ids[x.columns] * wide + x.a_ids[x.rows]))
                size += sum(map(len, texts))
                if size >= BLOCK:
                    yield from rows()
                    held.clear()
                    size, block = 0, block + 1
        if held:
            yield from rows()

    kind = docs.schema["doc_id"].dataType
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("bucket", pa.int32()), ("doc_id", to_arrow_type(kind)), *((c, pa.int64()) for c in NUMBERS), ("groups_sha256", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())])
    return null_safe_text(docs, "doc_id").mapInArrow(run, f"kind int, block long, bucket int, doc_id {kind.simpleString()}, {', '.join(f'{c} long' for c in NUMBERS)}, groups_sha256 string, keys binary, counts binary")


def pair_counts(asked: DataFrame, buckets: int, wide: int) -> DataFrame:
    """``bucket, keys, counts, best``: each id pair's count over all blocks and whether it is its B id's highest.

    A bucket has all pairs of its B ids. Its rows are added up as they stream in; what a task holds is bounded by the two
    vocabularies, whatever the number of documents.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts, own, more, size, bucket = np.zeros(0, np.int64), np.zeros(0, np.int64), [], [], 0, None
        for batch in batches:
            for bucket, k, c in zip(batch.bucket, batch["keys"], batch.counts, strict=True):
                own.append(np.frombuffer(k, "<i8"))
                more.append(np.frombuffer(c, "<i8"))
                size += len(own[-1])
                if size >= max(1_000_000, len(keys)):
                    keys, counts = _summed(np.concatenate([keys, *own]), np.concatenate([counts, *more]))
                    own, more, size = [], [], 0
        if bucket is None:
            return
        keys, counts = _summed(np.concatenate([keys, *own]), np.concatenate([counts, *more]))
        b = keys // wide
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        best = counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(np.r_[first, len(b)]))
        yield pd.DataFrame({"bucket": [bucket], "keys": [keys.astype("<i8").tobytes()], "counts": [counts.astype("<i8").tobytes()], "best": [best.astype(np.uint8).tobytes()]})

    return exchanged(asked, buckets).mapInPandas(run, "bucket int, keys binary, counts binary, best binary")


def _answers(asked: DataFrame, known: DataFrame, buckets: int, salts: int) -> DataFrame:
    """``block, bucket, counts, best`` for the pairs of each row of ``asked``, in its order.

    A bucket's rows are dealt to ``salts`` tasks, each of which gets the bucket's part of ``known``, of bounded size, first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = counts = best = None
        for batch in batches:
            out = []
            for block, bucket, k, c, b in zip(batch.block, batch.bucket, batch["keys"], batch.counts, batch.best, strict=True):
                if block < 0:
                    keys, counts, best = np.frombuffer(k, "<i8"), np.frombuffer(c, "<i8"), np.frombuffer(b, np.uint8)
                else:
                    at = np.searchsorted(keys, np.frombuffer(k, "<i8"))
                    out.append((block, bucket, counts[at].tobytes(), best[at].tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["block", "bucket", "counts", "best"])

    place = lambda salt: (F.col("bucket") * salts + salt).cast("int").alias("place")
    copies = known.select(F.lit(-1).cast("long").alias("block"), "bucket", "keys", "counts", "best", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s")).select("block", "bucket", "keys", "counts", "best", place(F.col("s")))
    rows = asked.select("block", "bucket", "keys", F.lit(None).cast("binary").alias("counts"), F.lit(None).cast("binary").alias("best"), place(F.pmod(F.xxhash64("block"), F.lit(salts))))
    dealt = copies.unionByName(rows).repartitionById(buckets * salts, F.col("place")).sortWithinPartitions("block")
    return dealt.select("block", "bucket", "keys", "counts", "best").mapInPandas(run, "block long, bucket int, counts binary, best binary")


def alignment_statistics(docs: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """One row for each document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared``.

    ``n_best`` are the links whose id pair's count over all documents is the highest of its B id, ``count_sum`` the sum of
    these counts over the document's links; ``n_shared`` counts pairs of tokens of one group. Texts that are null, empty, or
    that a tokenizer doesn't give back byte by byte have zeros and an empty digest. Repeated rows count each; null ids are kept;
    other columns are not read; an empty table gives none.

    Each block of documents asks once for the counts of the distinct pairs in it. Pairs are added up by B id in a bounded
    number of buckets; the answers go back to the blocks, where documents wait with their links as places in the block's pairs.
    Nothing is broadcast.
    """
    parts = max(1, docs.rdd.getNumPartitions())
    buckets = min(MOST, max(LEAST, parts))
    wide = len(bpe.encoder(first).merges.tokens.lengths)
    found = written(_requests(docs, buckets, first, second))
    asked = found.where("kind = 0").select("block", "bucket", "keys", "counts")
    known = written(pair_counts(asked, buckets, wide))
    answers = _answers(asked, known, buckets, -(-parts // buckets))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, counts, best, parts = None, None, None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.block != at:
                    at, counts, parts = row.block, None, []
                if row.kind == 0:
                    parts.append((np.frombuffer(row.counts, "<i8"), np.frombuffer(row.best, np.uint8)))
                    continue
                if counts is None and parts:
                    counts, best = (np.concatenate(x) for x in zip(*parts, strict=True))
                links = np.cumsum(np.frombuffer(row.keys, "<i4"))
                own = (int(best[links].sum()), int(counts[links].sum())) if len(links) else (0, 0)
                out.append((row.doc_id, row.n_a, row.n_b, row.n_groups, row.n_links, *own, row.groups_sha256, row.n_shared))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared"])

    waiting = found.where("kind = 1").drop("counts").withColumns({"counts": F.lit(None).cast("binary"), "best": F.lit(None).cast("binary")})
    both = waiting.unionByName(answers.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "kind", "bucket").mapInPandas(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_shared long")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_statistics(table(spark, sf_dir, "documents"))
