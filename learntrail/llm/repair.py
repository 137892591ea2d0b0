"""Repair of conversation structure by Knuth's lightest-derivation agenda."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from learntrail.llm.common import table, written

#: Rows, and characters, of which a block has no more (one row may be longer).
ROWS, CHARACTERS = 1024, 1_000_000
#: What has been emitted so far: nothing, a system turn, a user turn, an assistant turn last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = (NOTHING, SYSTEM, USER, ASSISTANT)
#: The state after a turn of a role's initial, where the form ``(s?(ua)+)?`` allows it.
STEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state after a turn whose role is chosen, and that role: there is one choice in each state.
CHOSEN = {q: (ASSISTANT, "assistant") if q == USER else (USER, "user") for q in STATES}
#: Costs of the edits Rerole, Delete and Insert, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
_SIGN, _LAST, _ENDS = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z"), frozenset(".!?")

Weight = tuple[int, str]


def lightest(rows: str, start: int = NOTHING, goal: bool = False) -> dict[int, Weight]:
    """The lightest weight (cost, audit) of each state after all rows, beginning in ``start``; with ``goal`` that of the cheapest whole repair, at -1.

    ``rows`` has two signs a row: its role's initial, and ``!`` for a row that must go, ``-`` for a truncated one, ``.`` otherwise.

    Items are (rows read, state); a deduction takes a finished item, and the row after it as an axiom, to another item by Keep,
    Rerole or Delete, or by Insert without a row. Its weight is the item's cost and audit with the edit's added. That never makes a weight less, and keeps the
    order of two weights of one item: of equal cost, neither audit begins the other, as what is between would be Inserts, which
    cost. So the item popped with the least weight is final (Knuth), and the goal, deduced from (all rows, nothing or
    assistant), is final when it is popped.
    """
    n, done = len(rows) // 2, {}
    agenda: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in done:
            continue
        done[i, q] = cost, audit
        if i > n:
            return {-1: (cost, audit)}
        if i == n:
            if goal and q in (NOTHING, ASSISTANT):
                heapq.heappush(agenda, (cost, audit, n + 1, -1))
        else:
            initial, fault = rows[2 * i], rows[2 * i + 1]
            heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
            if fault != "!":
                cut = CUT if fault == "-" else 0
                kept = STEP.get((q, initial))
                if kept is not None:
                    heapq.heappush(agenda, (cost + cut, audit + "K", i + 1, kept))
                heapq.heappush(agenda, (cost + REROLE + cut, audit + "R", i + 1, CHOSEN[q][0]))
        if (i, CHOSEN[q][0]) not in done:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, CHOSEN[q][0]))
    return {q: done[n, q] for q in STATES if (n, q) in done}


@lru_cache(maxsize=100_000)
def whole_repair(rows: str) -> Weight:
    """The cheapest repair of a conversation of few rows; repairs of equal forms are kept."""
    return lightest(rows, goal=True)[-1]


def joined_repair(segments: list[dict[tuple[int, int], Weight]]) -> tuple[Weight, list[tuple[int, str]]]:
    """The cheapest repair of a conversation in segments, and each segment's first state and part of the audit.

    The same agenda with deductions of two premises: a finished item (segments read, state) and a segment's item (its state
    before and after), whose weights add up in order. Segments' items are axioms, final from the start.
    """
    done: set[tuple[int, int]] = set()
    agenda: list[tuple] = [(0, "", 0, NOTHING, ())]
    while agenda:
        cost, audit, k, q, way = heapq.heappop(agenda)
        if (k, q) in done:
            continue
        done.add((k, q))
        if k > len(segments):
            parts: list[tuple[int, str]] = []
            while way:
                way, part = way
                parts.append(part)
            return (cost, audit), parts[::-1]
        if k == len(segments):
            if q in (NOTHING, ASSISTANT):
                heapq.heappush(agenda, (cost, audit, k + 1, -1, way))
            continue
        for (before, after), (more, part) in segments[k].items():
            if before == q and (k + 1, after) not in done:
                heapq.heappush(agenda, (cost + more, audit + part, k + 1, after, (way, (q, part))))
    raise AssertionError("deleting all rows is always a repair")


def rendered(roles: list[str], texts: list[str], audit: str, state: int = NOTHING) -> list[str]:
    """The lines ``role:text`` of the repaired turns, for the audit of these rows from a state on."""
    out, i = [], 0
    for edit in audit:
        if edit in "RI":
            state, role = CHOSEN[state]
            out.append(f"{role}:{texts[i] if edit == 'R' else ''}")
        elif edit == "K":
            state = STEP[state, roles[i][:1]]
            out.append(f"{roles[i]}:{texts[i]}")
        i += edit != "I"
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: the rows with planted faults, by the CRC-32 of ``conv_id:turn`` modulo 20.

    0 drops a row (it stays as ``gone``, so that its conversation is still known), 1 empties its text, 2 takes out ``.!?``, 3
    repeats it, 4 makes it a user turn. Nulls in role and text, and in the key of the CRC, are one space.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    df = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), F.pmod(F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "utf-8")), F.lit(20)).cast("int").alias("k"))
    text = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).when(F.col("k") == 0, "").otherwise(F.col("text"))
    df = df.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), F.when(F.col("k") == 3, 2).otherwise(1).alias("times"))
    return df.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("time", "times")


@dataclass
class Block:
    """Neighbouring rows of one conversation, as they are read."""

    conv: object
    known: set[bytes] = field(default_factory=set)  # role and text of rows so far, in this task
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    signs: list[str] = field(default_factory=list)
    firsts: list[bytes] = field(default_factory=list)  # keys of rows not seen before in this task, with their places
    places: list[int] = field(default_factory=list)
    size: int = 0
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        key = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"))
        if not _SIGN.search(text):
            fault = "b"
        elif key in self.known:
            fault = "d"
        else:
            fault = "." if _LAST.search(text)[1] in _ENDS else "-"
        if key not in self.known:
            self.known.add(key)
            self.firsts.append(key)
            self.places.append(len(self.signs))
        self.signs.append((role[:1] or "\0") + fault)
        self.roles.append(role)
        self.texts.append(text)
        self.size += len(text)
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn

    def next(self) -> Block:
        return Block(self.conv, self.known)


def form(signs: str) -> str:
    """Rows for ``lightest``: blank and duplicate rows must go."""
    return signs.replace("b", "!").replace("d", "!") if not {"b", "d"} & set(signs[::2]) else "".join(a + ("!" if f in "bd" else f) for a, f in zip(signs[::2], signs[1::2], strict=True))


def illegal(signs: str) -> int:
    """Neighbours whose roles' initials are not su, ua or au."""
    initials = signs[::2]
    return sum(x not in ("su", "ua", "au") for x in map("".join, zip(initials, initials[1:], strict=False)))


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _result(blocks: list[tuple[int | None, int | None, int]], signs: list[str], weight: Weight, digest: str) -> tuple:
    """A conversation's numbers from its blocks' (least turn, greatest turn, distinct turns) and their rows."""
    turns, last = 0, None
    for low, high, n in blocks:
        if n:
            turns += n - (low == last)
            last = high
    first = next((low for low, _, n in blocks if n), None)
    all_ = "".join(signs)
    faults = all_[1::2]
    return (last - first + 1 - turns if turns else 0, faults.count("b"), faults.count("d"), faults.count("-"), illegal(all_), weight[0], weight[1], digest)


NAMES = [x.split()[0] for x in RESULT.split(", ")]
BLOCK = f"kind int, conv_id CONV, block long, low long, high long, turns long, signs string, roles array<string>, texts array<string>, firsts array<binary>, places array<int>, {RESULT}"
ITEMS = "conv_id CONV, block long, low long, high long, turns long, signs string, items array<struct<before:int,after:int,cost:long,audit:string>>"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((),) * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _read(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows as they stream in: finished conversations (kind 1), and as blocks (kind 0) those of several blocks and those
    that may go on in the task before or after."""
    number = TaskContext.get().partitionId() << 32
    out: list[tuple] = []
    held: Block | None = None
    size, edge, split = 0, True, False  # characters in out; whether the conversation may have begun in another task, or has left blocks

    def block() -> None:
        nonlocal number, size
        out.append((0, held.conv, number, held.low, held.high, held.turns, "".join(held.signs), held.roles, held.texts, held.firsts, held.places, *[None] * 8))
        number += 1
        size += held.size

    def finished() -> None:
        signs = "".join(held.signs)
        weight = whole_repair(form(signs))
        digest = hashlib.sha256("\n".join(rendered(held.roles, held.texts, weight[1])).encode("utf-8", "surrogatepass")).hexdigest()
        out.append((1, held.conv, *[None] * 9, *_result([(held.low, held.high, held.turns)], [signs], weight, digest)))

    for conv, turn, role, text, gone in _rows(batches):
        if held is None:
            held = Block(conv)
        elif conv != held.conv:
            block() if edge or split else finished()
            held, edge, split = Block(conv), False, False
        elif len(held.signs) >= ROWS or held.size >= CHARACTERS:
            block()
            held, split = held.next(), True
        if not gone:
            held.add(turn, role, text)
        if len(out) >= 1000 or size > CHARACTERS:
            yield _batch(out, schema)
            out.clear()
            size = 0
    if held is not None:
        block()
        yield _batch(out, schema)


def _segments(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each block's items: for every state before it and after it the lightest weight. ``late`` has rows first seen in an earlier block."""
    for batch in batches:
        out = []
        for conv, number, low, high, turns, signs, late in _rows([batch]):
            signs = list(signs)
            for place in late or ():
                if signs[2 * place + 1] != "b":
                    signs[2 * place + 1] = "d"
            signs = "".join(signs)
            items = [{"before": q, "after": after, "cost": cost, "audit": audit} for q in STATES for after, (cost, audit) in lightest(form(signs), q).items()]
            out.append((conv, number, low, high, turns, signs, items))
        yield _batch(out, schema)


def _joined(blocks: pa.Table, schema: pa.Schema) -> pa.Table:
    """One conversation's blocks: its numbers, with the first of them, and each block's state and part of the audit."""
    rows = sorted(_rows(blocks.to_batches()), key=lambda r: r[1])
    weight, parts = joined_repair([{(x["before"], x["after"]): (x["cost"], x["audit"]) for x in r[6]} for r in rows])
    result = _result([r[2:5] for r in rows], [r[5] for r in rows], weight, "")
    return pa.Table.from_batches([_batch([(r[0], r[1], *part, *(result if k == 0 else [None] * 8)) for k, (r, part) in enumerate(zip(rows, parts, strict=True))], schema)])


def _hashed(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's repaired text, from its blocks as they stream in order."""
    conv, digest, head, lines = None, None, None, False
    for batch in batches:
        out = []
        for own, state, part, roles, texts, *numbers in _rows([batch]):
            if digest is None or own != conv:
                if digest is not None:
                    out.append((conv, *head[:-1], digest.hexdigest()))
                conv, head, digest, lines = own, numbers, hashlib.sha256(), False
            for line in rendered(roles, texts, part, state):
                digest.update((("\n" if lines else "") + line).encode("utf-8", "surrogatepass"))
                lines = True
        yield _batch(out, schema)
    if digest is not None:
        yield _batch([(conv, *head[:-1], digest.hexdigest())], schema)


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``conv_id, turn, role, text, gone``: RESULT's columns.

    Rows go by turn, nulls first; rows of one turn by a hash of role and text, so that repeats are neighbours. Rows that are
    ``gone`` only say that their conversation exists: one without other rows has zeros, an empty audit and the digest of the
    empty string. Null role and text must have been made text before; a null conv_id is a conversation of its own. Other columns are
    not read; an empty table gives none.

    Rows are dealt by ranges of conversation, turn and hash, so a conversation of any size spans as many tasks as it needs. Conversations that lie
    inside a task are repaired as they stream by. The others, and those of over ROWS rows, are kept as blocks: rows seen in an
    earlier block are found by a join of keys, every block is reduced to its lightest items between states, these are joined
    by the same agenda, and only then are the texts read again, in order, for the digest; as SHA-256 can't be added up, that
    last step streams a conversation through one task, block by block, and holds one. The step before it holds a conversation's items in
    one task, about 18 bytes a row; its result, the audit, has a byte for each row by contract.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    key = F.xxhash64("role", "text")
    dealt = rows.select("conv_id", "turn", "role", "text", "gone", key.alias("h")).repartitionByRange("conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "h", "role", "text")
    block, items, part, result = (StructType.fromDDL(x.replace("CONV", kind)) for x in (BLOCK, ITEMS, f"conv_id CONV, block long, state int, part string, {RESULT}", f"conv_id CONV, {RESULT}"))
    as_block, as_items, as_part, as_result = map(to_arrow_schema, (block, items, part, result))
    found = written(dealt.drop("h").mapInArrow(lambda b: _read(b, as_block), block))
    whole = found.where("kind = 1").select("conv_id", *NAMES)
    blocks = found.where("kind = 0").select("conv_id", "block", "low", "high", "turns", "signs", "roles", "texts", "firsts", "places")
    keys = blocks.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("c"), F.col("conv_id").isNull().alias("none"), "block", F.explode(F.arrays_zip("firsts", "places")).alias("x")).select("c", "none", "block", F.col("x.firsts").alias("key"), F.col("x.places").alias("place"))
    least = keys.groupBy("c", "none", "key").agg(F.min("block").alias("first"))
    late = keys.join(least, ["c", "none", "key"]).where("block > first").groupBy("block").agg(F.collect_list("place").alias("late"))
    segments = blocks.drop("roles", "texts", "firsts", "places").join(late, "block", "left").select("conv_id", "block", "low", "high", "turns", "signs", "late").mapInArrow(lambda b: _segments(b, as_items), items)
    decided = segments.groupBy("conv_id").applyInArrow(lambda t: _joined(t, as_part), part)
    texts = blocks.select("block", "roles", "texts").join(decided, "block").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return whole.unionByName(texts.select("conv_id", "state", "part", "roles", "texts", *NAMES).mapInArrow(lambda b: _hashed(b, as_result), result))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))
