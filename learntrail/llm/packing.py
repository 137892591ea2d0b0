"""Hierarchical multi-length packing of documents into token sequences."""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from learntrail.llm.common import null_safe_text, table
from learntrail.llm.tokens import VOCABULARY, vocabulary

LENGTH = 1024
TIERS = (1024, 512, 256, 128)
#: Full sequences that an optimiser step's cost equals, and the share of a token's cost that doesn't depend on the sequence, in tokens attended to.
STEP, LINEAR = 16, 4096
#: Tokens that are packed together: bounds a task's memory.
WINDOW = 2_000_000
SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


def plan_sequences(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS, longest: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), for documents of the given token counts.

    Full windows of ``longest`` are cut off each document first. What remains goes to the smallest tier that holds it, so it
    fills more than half of that tier's size. Then, from the longest tier down, each remainder opens a window of its own
    tier's size, and the gap is filled from the shorter tiers: from the longest one whose remainders fit whole, and where none
    does with a cut piece, whose rest goes back to a tier. A window that stays open when no remainder is left is parted at
    powers of two, which need no padding.
    """
    out: list[list[tuple[int, int, int]]] = []
    waiting: dict[int, deque[tuple[int, int, int]]] = {t: deque() for t in sorted(tiers)}
    sizes = sorted(tiers)

    def route(doc: int, start: int, n: int) -> None:
        if n:
            waiting[next(t for t in sizes if n <= t)].append((doc, start, n))

    for doc, n in enumerate(lengths.tolist()):
        full = n // longest * longest
        out += [[(doc, at, longest)] for at in range(0, full, longest)]
        route(doc, full, n - full)
    for tier in reversed(sizes):
        while waiting[tier]:
            doc, start, n = waiting[tier].popleft()
            window, gap = [(doc, start, n)], tier - n
            while gap:
                source = next((t for t in reversed(sizes) if t <= gap and waiting[t]), None) or next((t for t in sizes if waiting[t]), None)
                if source is None:
                    break
                doc, start, n = waiting[source].popleft()
                used = min(n, gap)
                window.append((doc, start, used))
                gap -= used
                route(doc, start + used, n - used)
            out += [window] if not gap else powers(window)
    return out


def step_cost(length: int) -> int:
    """The work of a sequence: attention over its own length, and per token as much again as attending to LINEAR tokens."""
    return length * (length + LINEAR)


def balanced_groups(lengths: list[int], step: int = STEP, longest: int = LENGTH) -> list[int]:
    """A group for each sequence, so that all groups cost nearly the same: costliest first, each to the cheapest group so far.

    There are as many groups as ``step`` full sequences a group would need for the total cost.
    """
    costs = [step_cost(n) for n in lengths]
    n_groups = max(1, -(-sum(costs) // (step * step_cost(longest))))
    heap, out = [(0, g) for g in range(n_groups)], [0] * len(lengths)
    for k in sorted(range(len(costs)), key=lambda k: (-costs[k], k)):
        total, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (total + costs[k], g))
    return out


def powers(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window that isn't full, parted into windows whose lengths are powers of two, longest first."""
    total, pieces, out = sum(x[2] for x in window), deque(window), []
    while total:
        room = part = 1 << (total.bit_length() - 1)
        own = []
        while room:
            doc, start, n = pieces.popleft()
            used = min(n, room)
            own.append((doc, start, used))
            room -= used
            if n > used:
                pieces.appendleft((doc, start + used, n - used))
        out.append(own)
        total -= part
    return out


def pack_documents(docs: DataFrame, name: str = VOCABULARY, tiers: tuple[int, ...] = TIERS, longest: int = LENGTH, step: int = STEP) -> DataFrame:
    """One row for each piece: ``doc_id`` and SCHEMA's columns.

    A document's ids, then id 0, lie in exactly one piece each. ``sequence_id`` is unique, ``offset`` gapless from 0 in it;
    every sequence is full or has a power of two of tokens, so nothing is padded. ``tier`` is the sequence's size class, and
    the sequences of one ``step_group`` cost about as much as ``step`` full ones (``step_cost``), so that optimiser steps take like times.
    Packing is done within each task over windows of bounded size: no shuffle, and a task run again gives the same rows.
    Null text is empty: its one piece is the id 0. Repeated rows and null ids are packed as they come; other columns aren't read.
    """

    def packed(ids: list, tokens: list[np.ndarray], sequences: int, groups: int) -> tuple[pd.DataFrame, int, int]:
        lengths = np.array([len(x) for x in tokens], np.int64)
        plan = plan_sequences(lengths, tiers, longest)
        sizes = [sum(x[2] for x in s) for s in plan]
        tier = [next(t for t in sorted((*tiers, longest)) if n <= t) for n in sizes]
        group = balanced_groups(sizes, step, longest)
        n_groups = max(group) + 1
        rows = []
        for k, window in enumerate(plan):
            offset = 0
            for doc, start, n in window:
                rows.append((ids[doc], start, n, zlib.crc32(tokens[doc][start : start + n].tobytes()), int(lengths[doc]), sequences + k, offset, tier[k], groups + group[k]))
                offset += n
        return pd.DataFrame(rows, columns=["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]), sequences + len(plan), groups + n_groups

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = vocabulary(name)
        sequences = groups = TaskContext.get().partitionId() << 40
        ids, tokens, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                ids.append(doc)
                tokens.append(np.append(known.ids(text), np.uint32(0)).astype("<u4"))
                size += len(tokens[-1])
                if size >= WINDOW:
                    out, sequences, groups = packed(ids, tokens, sequences, groups)
                    yield out
                    ids, tokens, size = [], [], 0
        if ids:
            yield packed(ids, tokens, sequences, groups)[0]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return null_safe_text(docs, "doc_id").mapInPandas(run, f"doc_id {kind}, {SCHEMA}")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
