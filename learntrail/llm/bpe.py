"""Byte-pair encoding by batched numpy merge rounds, and decoding, for byte-level vocabularies."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrail.llm.common import null_safe_text, ragged, table

VOCABULARY = "byte_bpe_50k"
#: No merge: greater than any rank.
NONE = np.int64(1 << 40)
#: Bytes from which a word takes rounds by rank instead of rounds by word.
LONG = 256
#: Chunks, and ids of chunks, that a worker keeps; both are emptied together when one is exceeded.
KEPT, KEPT_IDS = 400_000, 4_000_000
#: Bytes that are encoded or decoded together.
SLICE = 2_000_000
_ODD_SPACE = re.compile(r"\s | \s")


def byte_signs() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 signs for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class Packed:
    """Byte strings one after another, gathered by number."""

    def __init__(self, parts: list[bytes]):
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids`` in a row, and each one's length."""
        lengths = self.lengths[ids]
        return self.data[np.repeat(self.starts[ids], lengths) + ragged(lengths)], lengths


class Merges:
    """A byte-level BPE: its merges as sorted keys of pairs of ids, with rank and result."""

    def __init__(self, name: str = VOCABULARY):
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
            known = json.load(file)
        vocab, signs = known["model"]["vocab"], byte_signs()
        self.special = {x["content"]: x["id"] for x in known["added_tokens"]}
        own = [b""] * (1 + max(*vocab.values(), *self.special.values()))
        for token, k in vocab.items():
            own[k] = bytes(signs[c] for c in token)
        for token, k in self.special.items():
            own[k] = token.encode("utf-8")
        self.tokens = Packed(own)
        self.byte_ids = np.zeros(256, np.int64)
        for sign, b in signs.items():
            self.byte_ids[b] = vocab[sign]
        merges = [x if isinstance(x, list) else x.split(" ") for x in known["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self.results = np.array([vocab[a + b] for a, b in merges], np.int64)  # by rank
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair by binary search over the sorted keys; NONE where it doesn't merge."""
        keys = left << np.int64(32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in a row and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        long = lengths > LONG
        if not long.any():
            return self._by_word(words, lengths)
        parts = [self._by_word([w for w, x in zip(words, long, strict=True) if not x], lengths[~long]), self._by_rank([w for w, x in zip(words, long, strict=True) if x], lengths[long])]
        counts = np.zeros(len(words), np.int64)
        counts[~long], counts[long] = parts[0][1], parts[1][1]
        starts = np.cumsum(counts) - counts
        out = np.zeros(counts.sum(), np.int64)
        for (ids, own), which in zip(parts, (~long, long), strict=True):
            out[np.repeat(starts[which], own) + ragged(own)] = ids
        return out, counts

    def _symbols(self, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' byte symbols in one flat array, each one's word, and the rank of each with its right neighbour."""
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        ranks = np.full(len(symbols), NONE)
        inner = np.flatnonzero(word[:-1] == word[1:])
        ranks[inner] = self.pair_ranks(symbols[inner], symbols[inner + 1])
        return symbols, word, ranks

    def _by_word(self, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges, in every word at once, all pairs of the word's lowest rank; finished words leave the arrays."""
        symbols, word, ranks = self._symbols(words, lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[first, len(word)])
            best = np.minimum.reduceat(ranks, first)
            over = np.repeat(best == NONE, sizes)
            if over.any():
                done.append((word[over], symbols[over]))
                best = np.repeat(best, sizes)[~over]
                symbols, word, ranks = symbols[~over], word[~over], ranks[~over]
                if not len(symbols):
                    break
            else:
                best = np.repeat(best, sizes)
            at = np.flatnonzero(ranks == best)
            # the pairs of a run overlap (they are of one sign): every other one merges, from the left
            run = np.cumsum(np.r_[True, np.diff(at) != 1]) - 1
            at = at[(ragged(np.bincount(run)) & 1) == 0]
            symbols[at] = self.results[ranks[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            moved = np.cumsum(stays) - 1
            at = moved[at]
            symbols, word, ranks = symbols[stays], word[stays], ranks[stays]
            changed = np.unique(np.r_[at, at[at > 0] - 1])
            ranks[changed] = NONE
            changed = changed[changed < len(symbols) - 1]
            changed = changed[word[changed] == word[changed + 1]]
            ranks[changed] = self.pair_ranks(symbols[changed], symbols[changed + 1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        word, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _by_rank(self, words: list[bytes], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for long words: a round for each rank that comes up, in rising order, over linked symbols.

        A merge makes only pairs of higher rank, so there are at most as many rounds as ranks, however long the words are, and
        a round touches only its own pairs and their neighbours.
        """
        symbols, word, ranks = self._symbols(words, lengths)
        n = len(symbols)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.flatnonzero(np.r_[word[1:] != word[:-1], True])
        after[ends], before[ends[:-1] + 1] = n, -1
        alive = np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[ranks[at] < NONE]
            at = at[np.argsort(ranks[at], kind="stable")]
            own, first = np.unique(ranks[at], return_index=True)
            for rank, part in zip(own.tolist(), np.split(at, first[1:]), strict=True) if len(at) else ():
                if rank not in waiting:
                    heapq.heappush(heap, rank)
                waiting.setdefault(rank, []).append(part)

        wait(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[alive[at] & (ranks[at] == rank)]
            if not len(at):
                continue
            run = np.cumsum(np.r_[True, after[at[:-1]] != at[1:]]) - 1
            at = at[(ragged(np.bincount(run)) & 1) == 0]
            right = after[at]
            symbols[at] = self.results[rank]
            alive[right], ranks[right] = False, NONE
            after[at] = after[right]
            linked = at[after[at] < n]
            before[after[linked]] = linked
            changed = np.unique(np.r_[at, before[at][before[at] >= 0]])
            ranks[changed] = NONE
            changed = changed[after[changed] < n]
            ranks[changed] = self.pair_ranks(symbols[changed], symbols[after[changed]])
            wait(changed)
        return symbols[alive], np.bincount(word[alive], minlength=len(words))


class _Numbers(dict):
    """Numbers chunks by first appearance, after the encoder's ``done`` ones; new ones are noted."""

    def __init__(self, owner: Encoder, head: str):
        self.owner, self.head = owner, head

    def __missing__(self, part: str) -> int:
        self[part] = k = self.owner.done + len(self.owner.noted)
        self.owner.noted.append(self.head + part)
        return k


class Encoder:
    """Encodes batches of texts; ids of chunks seen before are kept, new ones are merged together.

    A text is parted at single spaces between other signs, where the pattern always parts it, and by the pattern elsewhere.
    """

    def __init__(self, name: str = VOCABULARY, special: bool = True):
        self.merges = Merges(name)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = self.merges.special if special else {}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._empty()

    def _empty(self) -> None:
        self.noted: list[str] = []
        self.done = len(self.special)
        self.plain, self.spaced = _Numbers(self, ""), _Numbers(self, " ")
        self.marks = {token: k for k, token in enumerate(self.special)}
        self.ids = np.array(list(self.special.values()), np.int32)  # of all numbered chunks in a row
        self.counts = np.ones(self.done, np.int64)

    def _numbers(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.parts.split(text) if self.parts and self.parts.search(text) else (text,):
            if part in self.special:
                out.append(self.marks[part])
            elif not part:
                continue
            elif _ODD_SPACE.search(part):
                out += map(self.plain.__getitem__, self.pattern.findall(part))
            else:
                first, *rest = part.split(" ")
                if first:
                    out.append(self.plain[first])
                out += map(self.spaced.__getitem__, rest)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (int32) and how many each text has."""
        if self.done > KEPT or len(self.ids) > KEPT_IDS:
            self._empty()
        numbers = [np.array(self._numbers(x), np.int64) for x in texts]
        self._merge_new()
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        chunk = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        counts = self.counts[chunk]
        starts = np.cumsum(self.counts) - self.counts
        ids = self.ids[np.repeat(starts[chunk], counts) + ragged(counts)]
        ends = np.r_[0, np.cumsum(counts)]
        upto = np.cumsum(sizes)
        return ids, ends[upto] - ends[upto - sizes]

    def _merge_new(self) -> None:
        if not self.noted:
            return
        number: dict[str, int] = {}
        pieces = [[number.setdefault(x, len(number)) for x in self.pattern.findall(chunk)] for chunk in self.noted]
        self.done += len(self.noted)
        self.noted.clear()
        ids, counts = self.merges.encode_words([x.encode("utf-8", "surrogatepass") for x in number])
        starts = np.cumsum(counts) - counts
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter((k for own in pieces for k in own), np.int64, int(sizes.sum()))
        own = counts[flat]
        ends = np.r_[0, np.cumsum(own)]
        upto = np.cumsum(sizes)
        self.ids = np.concatenate([self.ids, ids[np.repeat(starts[flat], own) + ragged(own)].astype(np.int32)])
        self.counts = np.concatenate([self.counts, ends[upto] - ends[upto - sizes]])


def decode(merges: Merges, ids: np.ndarray, counts: np.ndarray) -> list[str]:
    """The texts of runs of ``counts`` ids: their tokens' bytes as UTF-8, bytes that are none as U+FFFD."""
    data, lengths = merges.tokens.gather(np.asarray(ids, np.int64))
    raw, ends = data.tobytes(), np.r_[0, np.cumsum(lengths)][np.r_[0, np.cumsum(counts)]].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


_LOADED: dict[tuple, Encoder] = {}


def encoder(name: str = VOCABULARY, special: bool = True) -> Encoder:
    """The encoder, made once in each Python worker."""
    if (name, special) not in _LOADED:
        _LOADED[name, special] = Encoder(name, special)
    return _LOADED[name, special]


def slices(sizes: list[int], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Bounds of neighbours of about ``most`` together, or one."""
    begin, total = 0, 0
    for k, n in enumerate(sizes):
        total += n
        if total >= most or k == len(sizes) - 1:
            yield begin, k + 1
            begin, total = k + 1, 0


def text_slices(batch: pa.RecordBatch, most: int = SLICE) -> Iterator[tuple[int, list[str]]]:
    """The texts of a batch as lists of about ``most`` bytes, or one text, each with its first row."""
    column = batch.column("text")
    for a, b in slices(pc.binary_length(column).to_pylist(), most):
        yield a, column.slice(a, b - a).to_pylist()


def _encoded(batches: Iterable[pa.RecordBatch], name: str, special: bool) -> Iterator[pa.RecordBatch]:
    known = encoder(name, special)
    for batch in batches:
        for a, texts in text_slices(batch):
            ids, counts = known.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, len(texts)), lists], ["doc_id", "ids"])


def _decoded(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    merges = encoder(name).merges
    most = len(merges.tokens.lengths)
    for batch in batches:
        rows = batch.column("ids")
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        sizes = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.r_[0, np.cumsum(sizes)]
        for a, b in slices((sizes * 4).tolist()):
            ids = flat[ends[a] : ends[b]].astype(np.int64)
            ok = (ids >= 0) & (ids < most)
            own = np.r_[0, np.cumsum(ok)][ends[a : b + 1] - ends[a]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), rows.slice(a, b - a), pa.array(decode(merges, ids[ok], np.diff(own)), pa.string())], ["doc_id", "ids", "text"])


def encode_documents(docs: DataFrame, name: str = VOCABULARY, special: bool = True) -> DataFrame:
    """``doc_id, ids``: the token ids (array<int>) of each whole text, equal to the library's without begin and end tokens.

    With ``special``, the strings of special tokens in a text become those tokens, as the library does by default; without, they
    are plain text. Null text is empty and has no ids; repeated rows and null ids are kept as they come; other columns are not
    read. Batches of about SLICE bytes are encoded together, a longer text alone; no shuffle, and a task run again gives the same rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return null_safe_text(docs, "doc_id").mapInArrow(lambda batches: _encoded(batches, name, special), f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids, text`` for rows ``doc_id, ids``: the text of the ids, special tokens as their strings.

    Null ids and an empty array give the empty text; an id that the vocabulary lacks or a null inside the array is left out, as
    the library leaves it out; bytes that are no UTF-8 (ids cut in the midst of a sign) become U+FFFD. Other columns are not read.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()
    known = F.filter(F.coalesce(F.col("ids"), F.array().cast("array<int>")), lambda x: x.isNotNull())
    return encoded.select("doc_id", known.alias("ids")).mapInArrow(lambda batches: _decoded(batches, name), f"doc_id {kind}, ids array<int>, text string")


def round_trip(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """``decode_documents`` of ``encode_documents`` in one pass through Python: ``doc_id, ids, text``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return null_safe_text(docs, "doc_id").mapInArrow(lambda batches: _decoded(_encoded(batches, name, True), name), f"doc_id {kind}, ids array<int>, text string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = round_trip(table(spark, sf_dir, "documents"))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
