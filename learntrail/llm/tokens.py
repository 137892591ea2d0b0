"""Token counts by prefix dynamic programming, and fast token ids, for byte-level BPE vocabularies."""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learntrail.llm.common import null_safe_text, table

VOCABULARY = "byte_bpe_50k"
BUDGET = 512
#: Distinct space-delimited chunks whose result a worker keeps; the store is emptied when full.
CACHE = 600_000
#: Characters whose counts are sent together.
SLICE = 1_000_000
#: A space beside other white space: only there may parting a text at its spaces part a token.
_ODD_SPACE = re.compile(r"\s | \s")


class Vocabulary:
    """The vocabulary files of one byte-level BPE: the .json gives the ids, the special strings and the pattern, the .tiktoken the ranks."""

    def __init__(self, name: str = VOCABULARY):
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as file:
            self.special = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        self.encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens=self.special)
        self.pieces = regex.compile(public_tokenizers.PATTERN)
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.lengths: dict[bytes, list[int]] = {}  # of the tokens that end in two given bytes, longest first
        for token in sorted(self.ranks, key=len, reverse=True):
            own = self.lengths.setdefault(token[-2:], []) if len(token) > 1 else []
            if not own or own[-1] != len(token):
                own.append(len(token))
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        self._plain = self.encoding._core_bpe.encode_ordinary
        self._ids: dict[str, bytes] = {}
        self._pieces: dict[str, list[int]] = {}
        self._prefixes: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text; special strings inside it become their own ids, as the library does by default."""
        store = self._ids
        if _ODD_SPACE.search(text):
            return np.asarray(self._encode(text), "<u4")
        first, *rest = text.split(" ")
        out = [array("I", self._encode(first)).tobytes()]
        for part in rest:
            got = store.get(part)
            if got is None:
                got = array("I", self._encode(" " + part)).tobytes()
                if len(part) <= 64:
                    if len(store) >= CACHE:
                        store.clear()
                    store[part] = got
            out.append(got)
        return np.frombuffer(b"".join(out), "<u4")

    def _encode(self, text: str) -> list[int]:
        if self.parts and self.parts.search(text):
            return self.encoding.encode(text, allowed_special="all", disallowed_special=())
        return self._plain(text)

    def _joins(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens in a row (the left one may be empty) stay as they are when their bytes are encoded together."""
        found = self._pairs.get((left, right))
        if found is None:
            if len(self._pairs) > 2_000_000:
                self._pairs.clear()
            found = self._pairs[left, right] = self._ends([left, right]) == self.encoding._core_bpe.encode_single_piece(left + right)
        return found

    def _ends(self, tokens: list[bytes]) -> list[int]:
        return [self.ranks[x] for x in tokens if x]

    def piece_counts(self, piece: bytes) -> list[int]:
        """The exact number of tokens of each byte prefix of one pre-token, the empty one included.

        The last token of the prefix of length n is the only token t that ends there and that may follow the last token
        of the prefix of length n - len(t); its count is that prefix's count and one more.
        """
        last, begins, counts = [b""], [0], [0]
        ranks, pairs, lengths = self.ranks, self._pairs, self.lengths

        def ends_here(start: int, n: int) -> bool:
            token = piece[start:n]
            if token not in ranks:
                return False
            fits = pairs.get((last[start], token))
            if fits is None:
                fits = self._joins(last[start], token)
            if fits:
                last.append(token)
                begins.append(start)
                counts.append(counts[start] + 1)
            return fits

        for n in range(1, len(piece) + 1):  # mostly the last token grows or a byte begins one
            if not (ends_here(begins[-1], n) or ends_here(n - 1, n)):
                any(ends_here(n - size, n) for size in lengths.get(piece[n - 2 : n], ()) if size <= n)
        return counts

    def _piece(self, piece: str) -> list[int]:
        """The token counts of a pre-token's prefixes by characters, from its first on."""
        found = self._pieces.get(piece)
        if found is None:
            if piece[0] == "'" and piece[-1].isalpha():  # a contraction of at most three characters: cut short, it is parted otherwise
                found = [len(self._plain(piece[:n])) for n in range(1, len(piece) + 1)]
            else:
                found = self.piece_counts(piece.encode("utf-8"))
                found = found[1:] if piece.isascii() else [found[n] for n in accumulate(len(c.encode("utf-8")) for c in piece)]
            if len(piece) <= 64:
                if len(self._pieces) >= CACHE:
                    self._pieces.clear()
                self._pieces[piece] = found
        return found

    def _chunk_counts(self, chunk: str) -> list[int]:
        """Of one chunk: the number of tokens of each prefix by characters, the empty one left out."""
        out, done, before = [], 0, ""
        for part in self.parts.split(chunk) if self.parts and self.parts.search(chunk) else [chunk]:
            if part in self.special:
                own = done - len(self._plain(before))
                out += [own + len(self._plain(before + part[:n])) for n in range(1, len(part))]
                done += 1
                out.append(done)
                before = ""
            elif part:
                out += [done + x for x in self._plain_counts(part)]
                done = out[-1]
                before = part
        return out

    def _plain_counts(self, text: str) -> list[int]:
        out, done, before = [], 0, ""
        for piece in self.pieces.findall(text):
            counts = self._piece(piece)
            here = [done + x for x in counts] if done else list(counts)
            if before and piece[0].isspace() and before.isspace():  # cut there, the space joins the white space before it
                here[0] = done - len(self._plain(before)) + len(self._plain(before + piece[0]))
            out += here
            done += counts[-1]
            before = piece
        if before.isspace():  # the rest of the chunk decides how white space at its end is parted
            out[-1] = len(self._plain(text))
        return out

    def prefix_counts(self, text: str) -> np.ndarray:
        """The exact number of tokens of every prefix of a text, by characters: element n is that of ``text[:n]``."""
        store = self._prefixes
        if not text:
            return np.zeros(1, np.int32)
        first, *rest = [text] if _ODD_SPACE.search(text) else text.split(" ")
        got = self._chunk_counts(first)
        found: list = [bytes(got) if len(first) < 60 else got]
        short = len(first) < 60
        for part in rest:
            got = store.get(part)
            if got is None:
                got = self._chunk_counts(" " + part)
                if len(part) < 60:  # no count is over 255: kept as bytes
                    if len(store) >= CACHE:
                        store.clear()
                    got = store[part] = bytes(got)
                else:
                    short = False
            found.append(got)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        joined = np.frombuffer(b"".join(found), np.uint8) if short else np.concatenate([np.frombuffer(x, np.uint8) if isinstance(x, bytes) else np.array(x, np.int32) for x in found])
        totals = np.zeros(len(found), np.int32)
        full = lengths > 0
        totals[full] = joined[np.cumsum(lengths)[full] - 1]
        out = np.zeros(len(text) + 1, np.int32)
        out[1:] = joined + np.repeat(np.cumsum(totals, dtype=np.int32) - totals, lengths)
        return out


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(name: str = VOCABULARY) -> Vocabulary:
    """The vocabulary, loaded once in each Python worker."""
    if name not in _LOADED:
        _LOADED[name] = Vocabulary(name)
    return _LOADED[name]


def prefix_token_counts(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_bytes, prefix_tokens``: element n of the array is the exact token count of the first n characters.

    Any truncation or budget question about a text is then a look-up (``tokens_of_prefix``, ``longest_prefix``) without
    encoding again. Null text counts as empty: one element, 0. Repeated rows and null ids are kept as they come; other
    columns are not read. No shuffle; a task holds one Arrow batch of texts, the counts of SLICE characters or of one text, and
    a bounded store of chunk results.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(name)
        for batch in batches:
            begin, size, held, bytes_ = 0, 0, [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                held.append(known.prefix_counts(text))
                bytes_.append(len(text) if text.isascii() else len(text.encode("utf-8")))
                size += len(held[-1])
                if size >= SLICE or k == len(batch) - 1:
                    ends = np.cumsum([0, *map(len, held)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(held)), pa.array(bytes_, pa.int64()), lists], ["doc_id", "n_bytes", "prefix_tokens"])
                    begin, size, held, bytes_ = k + 1, 0, [], []

    kind = docs.schema["doc_id"].dataType.simpleString()
    return null_safe_text(docs, "doc_id").mapInArrow(counted, f"doc_id {kind}, n_bytes long, prefix_tokens array<int>")


def tokens_of_prefix(prefix_tokens, characters):
    """Column: the token count of the first ``characters`` characters (of the whole text beyond its end)."""
    return F.element_at(prefix_tokens, (F.least(F.lit(characters), F.size(prefix_tokens) - 1) + 1).cast("int")).cast("long")


def longest_prefix(prefix_tokens, budget):
    """Column: how many leading characters fit in ``budget`` tokens (the longest such prefix)."""
    return (F.size(prefix_tokens) - F.array_position(F.transform(F.reverse(prefix_tokens), lambda x: x <= budget), True)).cast("long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = prefix_token_counts(table(spark, sf_dir, "documents"))
    total = F.element_at("prefix_tokens", -1).cast("long")
    return counted.select("doc_id", "n_bytes", total.alias("n_tokens"), (total > BUDGET).alias("over_limit"))
