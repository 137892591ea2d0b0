"""Benchmark decontamination by template canonicalisation: finds items also when their numbers, names or units were replaced."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learntrail.llm.common import null_safe_text, table, window_hashes, written

#: Template words a window holds, literal words it needs at least, the share of an item's windows that makes a leak, and
#: the number of windows that does whatever the share (six windows of 8 are 13 words).
WINDOW, LITERALS, SHARE, RUN = 8, 4, 0.5, 6
#: Bits of the prefilter of benchmark windows: SPARE for each window, between half a megabyte and 32 megabytes. At the most, a benchmark
#: of 16 million windows lets a sixteenth of foreign windows pass; a larger one lets more pass, to the join.
FILTER_BITS, SPARE = (1 << 22, 1 << 28), 16
#: Benchmark windows that are broadcast to the join (a few tens of megabytes); more are shuffled, each to SALTS tasks.
BROADCAST_WINDOWS, SALTS = 200_000, 16
CACHE = 400_000
_WORD, _NUMBER, _NAME, _UNIT = range(4)
_NUMERIC_FIRST = frozenset("+-$€£0123456789")
_NUMERIC = re.compile(r"[+-]?[$€£]?[0-9][0-9.,:/]*(?:%|[A-Za-z]{1,3})?")
UNITS = {"m", "km", "cm", "mm", "mile", "miles", "foot", "feet", "ft", "inch", "inches", "yard", "yards", "kg", "g", "gram", "grams", "mg", "lb", "lbs", "pound", "pounds", "ton", "tons", "l", "litre", "litres", "liter", "liters", "ml", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees", "mph", "kph"}
_TYPED = np.array([0, *(xxhash.xxh3_64_intdigest(f"<{k}>") for k in ("number", "name", "unit"))], np.uint64)


class Templates:
    """Words of texts without marks: (hashes in lower case, kinds by two rules). Names are capitals inside a sentence by the first rule and any capitals by the second."""

    def __init__(self):
        self.store: dict[str, int] = {}
        self.hashes, self.traits = np.empty(CACHE, np.uint64), np.empty(CACHE, np.int64)

    def _word(self, word: str) -> int:
        bare = word.strip(".,;:!?\"'()[]{}<>|*#&")
        lower = bare.lower()
        kind = 1 if bare[:1] in _NUMERIC_FIRST and _NUMERIC.fullmatch(bare) else 2 if lower in UNITS else 0
        name = len(bare) > 1 and bare[0].isupper() and bare[1:].islower()
        at = len(self.store)
        self.hashes[at] = xxhash.xxh3_64_intdigest(lower)
        self.traits[at] = kind + 4 * name + 8 * (word[-1] in ".!?:;|" or word[-2:-1] in (".", "!", "?")) + 16 * (not bare)
        self.store[word] = at
        return at

    def _known(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and traits of at most CACHE words; the store is emptied before it would grow beyond CACHE."""
        if len(self.store) + len(words) > CACHE:
            self.store.clear()
        ids = np.fromiter(map(self.store.get, words, repeat(-1)), np.int64, len(words))
        for k in np.flatnonzero(ids < 0).tolist():
            at = self.store.get(words[k])
            ids[k] = self._word(words[k]) if at is None else at
        return self.hashes[ids], self.traits[ids]

    def of(self, text: str) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        words, starts = [], []
        for line in text.split("\n"):
            own = line.split()
            if own:
                starts.append(len(words))
                words += own
        if len(words) <= CACHE:
            hashes, traits = self._known(words)
        else:  # a text with more words than the store holds
            parts = [self._known(words[k : k + CACHE]) for k in range(0, len(words), CACHE)]
            hashes, traits = (np.concatenate(x) for x in zip(*parts, strict=True))
        opens = np.zeros(len(words), bool)
        opens[starts] = True
        opens[1:] |= (traits[:-1] & 8) > 0
        kind = np.where((traits & 3) == 1, _NUMBER, _WORD)
        kind[1:][((traits[1:] & 3) == 2) & (kind[:-1] == _NUMBER)] = _UNIT
        name = (kind == _WORD) & ((traits & 4) > 0)
        there = (traits & 16) == 0
        return hashes[there], tuple(np.where(own, _NAME, kind)[there] for own in (name & ~opens, name))


def template_windows(hashes: np.ndarray, kinds: tuple[np.ndarray, ...], width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of ``width`` as plain words and by each rule of kinds: (hashes, which count, slot values or 0 for literal words).

    Plain windows all count; typed ones where they hold enough literal words to mean something. A typed window without
    slots has its plain window's hash.
    """
    n, size = len(hashes) - width + 1, len(hashes)
    if n <= 0:
        return []
    found = window_hashes(np.concatenate([hashes, *(np.where(k == _WORD, hashes, _TYPED[k]) for k in kinds)]), width) ^ np.uint64(width)
    made = [(found[:n], np.ones(n, bool), np.zeros(size, np.uint64))]
    for v, kind in enumerate(kinds, 1):
        literal = np.zeros(size + 1, np.int64)
        np.cumsum(kind == _WORD, out=literal[1:])
        made.append((found[v * size : v * size + n], literal[width:] - literal[:n] >= min(LITERALS, width), np.where(kind == _WORD, np.uint64(0), hashes | np.uint64(1))))
    return made


def filter_bits(windows: int) -> int:
    """A power of two."""
    return int(min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (SPARE * windows - 1).bit_length())))


def bit_filter(items: DataFrame, bits: int) -> np.ndarray:
    """A bit for each remainder of a hash by ``bits``, packed in bytes; slices of it are made in tasks, and bits / 8 bytes reach the driver."""
    span = max(1 << 12, bits >> 10)

    def sliced(group: pd.DataFrame) -> pd.DataFrame:
        some = np.zeros(span, bool)
        some[group["at"].to_numpy(np.int64) % span] = True
        return pd.DataFrame({"slice": [group.slice.iloc[0]], "bits": [np.packbits(some, bitorder="little").tobytes()]})

    at = F.pmod("hash", F.lit(bits))  # of the signed hash: equals the unsigned remainder, as the number of bits divides 2**64
    out = np.zeros(bits // 8, np.uint8)
    for row in items.select(at.alias("at"), F.floor(at / span).alias("slice")).distinct().groupBy("slice").applyInPandas(sliced, "slice long, bits binary").collect():
        out[row["slice"] * span // 8 : (row["slice"] + 1) * span // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


_SCHEMA = "id long, at int, hash long, forms int, typed boolean, slots array<long>"


def windows_of(rows: DataFrame, widths: list[int] | None, passing: np.ndarray | None) -> DataFrame:
    """``id, at, hash, forms, typed, slots`` of the windows, equal forms of one place once with the sum of their bits: 1 plain, 2 and
    4 typed by the first and second rule. ``typed`` places have a window of bit 2.

    An item has windows of WINDOW words or, if it is shorter, of its own length.
    """

    def frame(ids, ats, hashes, masks, typed, values) -> pd.DataFrame:
        return pd.DataFrame({"id": np.array(ids, np.int64), "at": np.array(ats, np.int32), "hash": np.array(hashes, np.uint64).view(np.int64), "forms": np.array(masks, np.int32), "typed": np.array(typed, bool), "slots": pd.Series(values, dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for batch in batches:
            ids, ats, hashes, masks, typed, values = [], [], [], [], [], []
            for doc, text in zip(batch.id, batch.text, strict=True):
                words, kinds = templates.of(text)
                for width in [min(WINDOW, len(words))] if widths is None else widths:
                    if width == 0:
                        continue
                    forms = template_windows(words, kinds, width)
                    maybe = passes(passing, np.array([found for found, _, _ in forms])) if forms and passing is not None else None
                    for v, (found, enough, slots) in enumerate(forms):
                        if maybe is not None:
                            enough = enough & maybe[v]
                        for at in np.flatnonzero(enough).tolist():
                            mask = sum(1 << k for k, (other, counts, _) in enumerate(forms) if counts[at] and other[at] == found[at])
                            if mask & ((1 << v) - 1):  # an earlier form's row has it
                                continue
                            ids.append(doc)
                            ats.append(at)
                            hashes.append(found[at])
                            masks.append(mask)
                            typed.append(forms[1][1][at])
                            values.append(slots[at : at + width][slots[at : at + width] > 0].view(np.int64))
                if len(ids) > 20_000:
                    yield frame(ids, ats, hashes, masks, typed, values)
                    ids, ats, hashes, masks, typed, values = [], [], [], [], [], []
            yield frame(ids, ats, hashes, masks, typed, values)

    return rows.mapInPandas(run, _SCHEMA)


def _as_rows(df: DataFrame, key: str) -> DataFrame:
    return null_safe_text(df.where(F.col(key).isNotNull()).withColumn("id", F.col(key).cast("long")), "id")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, item_id, n_windows, n_item_windows, same_values``: documents that hold a benchmark item, with its own or other values.

    Windows of 8 words in lower case without marks meet by hash, and so do windows of template words, in which numbers, names
    (capitals inside a sentence, and in a second form all capitals) and units after numbers are typed placeholders. Windows of
    equal words always count. Those with other slot values count by runs, neighbours on a diagonal (position in the document
    less that in the item): in a run one value of the item always stands for one value of the document. A pair is a leak if it
    holds half of the item's windows, half of those with four literal words, or six. ``same_values``: a diagonal without
    other values is among the pair's.

    A bit filter of the benchmark's windows, sized by their number within bounds, goes to the tasks, so only windows that may
    match leave them; the join decides. Items of few literal words (sequences of numbers, lists of names) are found by their
    plain windows, so with their own values only. Null or blank texts match nothing, an item of fewer than 8 words counts whole.
    Rows with a null id are left out, repeated rows count once; other columns are not read.
    """
    items = written(windows_of(_as_rows(benchmark, "item_id"), None, None).select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "hash", F.col("forms").alias("item_forms"), "typed", F.col("slots").alias("item_slots")))
    n_items = items.count()
    passing = bit_filter(items, filter_bits(n_items))
    widths = sorted(r[0] for r in _widths(benchmark).collect())
    sizes = items.groupBy("item_id").agg(F.count_distinct("item_at").alias("n_item_windows"), F.count_distinct(F.when(F.col("typed"), F.col("item_at"))).alias("n_item_typed"))
    found = windows_of(_as_rows(docs, "doc_id"), widths, passing).withColumnRenamed("id", "doc_id").drop("typed")
    distinct = items.dropDuplicates(["item_id", "item_at", "hash"])
    if n_items <= BROADCAST_WINDOWS:
        found = found.join(F.broadcast(distinct), "hash")
    else:  # a window that a third of all documents hold is spread over SALTS tasks
        salted = distinct.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "at"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"]).drop("salt")
    pair, line = ["doc_id", "item_id"], ["doc_id", "item_id", "diagonal"]
    same = lambda v: v["i"] == v["d"]
    values = F.transform(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda p: F.struct(p["i"].alias("i"), p["d"].alias("d")))
    found = found.select(*pair, (F.col("at") - F.col("item_at")).alias("diagonal"), "item_at", "typed", F.col("forms").bitwiseAND(F.col("item_forms")).alias("shared"), values.alias("values")).repartition(*pair)
    # rule 0 takes what both sides type by the first rule, rule 1 takes all, so that the second's values can't spoil the first's runs
    found = found.withColumn("rule", F.explode(F.when(F.col("shared").bitwiseAND(F.lit(2)).cast("boolean") | F.forall("values", same), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    merged = F.array_distinct(F.flatten(F.collect_set("values"))).alias("values")
    spots = found.groupBy(*line, "rule", "item_at").agg(F.bool_or(F.forall("values", same)).alias("equal"), F.bool_or("typed").alias("typed"), merged)
    spots = spots.withColumn("run", F.col("item_at") - F.row_number().over(Window.partitionBy(*line, "rule", "equal").orderBy("item_at")))
    runs = spots.groupBy(*line, "rule", "equal", "run").agg(F.collect_list(F.struct("item_at", "typed")).alias("ats"), merged)
    counts = F.col("equal") | (F.size("values") == F.size(F.array_distinct(F.transform("values", lambda v: v["i"]))))
    lines = runs.groupBy(*line).agg(F.flatten(F.collect_list(F.when(counts, F.col("ats")))).alias("ats"), F.bool_and("equal").alias("same"))
    whole = lines.groupBy(*pair).agg(F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.max("same").alias("same_values"))
    whole = whole.select(*pair, F.size("ats").cast("long").alias("n_windows"), F.size(F.filter("ats", lambda x: x["typed"])).alias("n_typed"), "same_values")
    enough = (F.col("n_windows") >= share * F.col("n_item_windows")) | ((F.col("n_item_typed") > 0) & (F.col("n_typed") >= share * F.col("n_item_typed"))) | (F.col("n_windows") >= RUN)
    return whole.join(sizes, "item_id").where(enough).select("doc_id", "item_id", "n_windows", "n_item_windows", "same_values")


def _widths(benchmark: DataFrame) -> DataFrame:
    """The window lengths that items have: at most WINDOW different ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for batch in batches:
            yield pd.DataFrame({"width": sorted({min(WINDOW, len(templates.of(x)[0])) for x in batch.text})})

    return _as_rows(benchmark, "item_id").mapInPandas(run, "width int").where("width > 0").distinct()


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
