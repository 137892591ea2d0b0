"""Large JSON objects read in ranges: the elements of their arrays as rows, no row larger than an element."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes scanned at a time, bytes of whole elements in a range (more only for one larger element), bytes of a task's ranges, and
#: a name's or scalar's most.
BLOCK, RANGE, TASK, SMALL = 4_000_000, 1_000_000, 64_000_000, 65_536
_OPEN, _CLOSE = (ord("{"), ord("[")), (ord("}"), ord("]"))


class Structure:
    """The brackets, commas and colons outside strings of a byte stream, with the depth after each, block by block."""

    def __init__(self) -> None:
        self.depth, self.inside, self.escape = 0, False, False

    def of(self, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in the block, characters and depths."""
        x = np.frombuffer(block, np.uint8)
        slash = np.flatnonzero(x == 92)
        escaped = np.zeros(len(x) + 1, bool)  # the last stands for the next block's first byte
        first = np.r_[True, np.diff(slash) > 1][: len(slash)]
        begin = slash[first]
        size = np.diff(np.r_[np.flatnonzero(first), len(slash)])
        odd = (size + (self.escape & (begin == 0))) % 2 == 1
        escaped[(begin + size)[odd]] = True
        if self.escape and (len(begin) == 0 or begin[0] > 0):
            escaped[0] = True
        marks = (x == 34) & ~escaped[:-1]
        inside = (np.cumsum(marks) + self.inside) % 2 == 1
        at = np.flatnonzero(~inside & np.isin(x, np.frombuffer(b"{}[],:", np.uint8)))
        chars = x[at]
        depth = self.depth + np.cumsum(np.isin(chars, _OPEN).astype(np.int64) - np.isin(chars, _CLOSE))
        if len(x):
            self.inside, self.escape = bool(inside[-1]), bool(escaped[-1])
        if len(at):
            self.depth = int(depth[-1])
        return at, chars, depth


def json_ranges(read: Callable[[int, int], bytes], length: int, size: int = RANGE) -> tuple[dict[str, str], list[tuple[str, int, int]]]:
    """The scalars of a JSON object, as text, and ranges (name, begin, end) of whole elements of its arrays; an object among its
    values is one element. ``read(begin, end)`` gives bytes. ValueError without a single whole object."""
    structure, fields, ranges = Structure(), {}, []
    name, mark, value, opener, begin, nested, over = None, 0, 0, 0, 0, False, False

    def small(a: int, b: int, parsed: bool = True):
        if b - a > SMALL:
            raise ValueError("a name or a scalar is too long")
        return json.loads(read(a, b)) if parsed else read(a, b)

    for base in range(0, length, BLOCK):
        at, chars, depths = structure.of(read(base, min(length, base + BLOCK)))
        some = depths <= 2
        for pos, char, depth in zip((at[some] + base).tolist(), chars[some].tolist(), depths[some].tolist(), strict=True):
            sign = chr(char)
            if over or depth < 0:
                raise ValueError("more than one value")
            if depth == 2 and sign in "{[":
                opener, begin, nested = sign, pos + 1, True
            elif depth == 2 and sign == ",":
                if opener == "[" and pos - begin >= size:
                    ranges.append((name, begin, pos))
                    begin = pos + 1
            elif depth == 1 and sign in "}]":
                if name is None or opener + sign not in ("[]", "{}"):
                    raise ValueError("brackets don't match")
                ranges.append((name, begin, pos) if sign == "]" else (name, begin - 1, pos + 1))
            elif depth == 1 and sign in "{[":
                if sign != "{":
                    raise ValueError("not an object")
                mark = pos
            elif depth == 1 and sign == ":":
                name, value, nested = small(mark + 1, pos), pos + 1, False
                if not isinstance(name, str):
                    raise ValueError("a name isn't text")
            elif depth == 1 or (depth == 0 and sign == "}"):
                if name is None and (sign == "," or small(mark + 1, pos, False).strip()):
                    raise ValueError("a value without a name")
                if name is not None and not nested:
                    found = small(value, pos)
                    fields[name] = found if isinstance(found, str) else json.dumps(found)
                name, mark, over = None, pos, depth == 0
            elif depth == 0:
                raise ValueError("not an object")
    if not over or structure.inside:
        raise ValueError("the object doesn't end")
    return fields, ranges


def elements(data: bytes) -> list[tuple[int, str]]:
    """(place, text) of the elements in a range of an array."""
    at, chars, depths = Structure().of(data)
    cuts = at[(chars == ord(",")) & (depths == 0)].tolist()
    parts = [(a, data[a:b].strip()) for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(data)], strict=True)]
    return [(a, x.decode("utf-8", "replace")) for a, x in parts if x]


def _opened(path: str):
    """A file of Spark's listing, open for reading at any place."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme is None or scheme[1] == "file":
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/*", "/", path))
    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/=@?&+%,"))
    return system.open_input_file(inner)


def json_elements(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """``file, fields, name, place, json, malformed`` of the JSON objects, a file each, below ``path``: a row for each element of each top-level array.

    ``fields`` has the object's scalars as text, ``place`` is the element's byte in the file, so it gives their order. One pass
    over a file, streaming, finds ranges of whole elements of about ``size`` bytes; these are dealt to tasks of about TASK bytes,
    which read them again and part them. A file that isn't one whole UTF-8 object gives one row alone, with ``malformed``; an empty file and an
    object without arrays give none. Elements aren't parsed: what is wrong inside one is its own row's affair. Compressed files aren't read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")  # the content isn't read here

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, length in zip(batch.path, batch.length, strict=True):
                with _opened(file) as held:
                    try:
                        fields, found = json_ranges(lambda a, b, held=held: held.read_at(b - a, a), length, size)
                    except (ValueError, RecursionError):
                        fields, found = {}, [(None, 0, 0)]
                if found:
                    yield pd.DataFrame({"file": file, "fields": json.dumps(fields), "name": [f[0] for f in found], "begin": [f[1] for f in found], "end": [f[2] for f in found]})

    def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.name is None:
                    yield pd.DataFrame({"file": [row.file], "fields": ["{}"], "name": [None], "place": [0], "json": [None], "malformed": [True]})
                    continue
                with _opened(row.file) as held:
                    found = elements(held.read_at(row.end - row.begin, row.begin))
                if found:
                    yield pd.DataFrame({"file": row.file, "fields": row.fields, "name": row.name, "place": [row.begin + a for a, _ in found], "json": [x for _, x in found], "malformed": False})

    ranges = files.mapInPandas(ranged, "file string, fields string, name string, begin long, end long")
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]  # a range's row is small, so the number of tasks is set, or they would be coalesced
    tasks = max(-(-total // TASK), min(spark.sparkContext.defaultParallelism, -(-total // size)), 1)
    dealt = ranges.repartition(tasks, "file", "begin")
    return dealt.mapInPandas(parted, "file string, fields string, name string, place long, json string, malformed boolean").withColumn("fields", F.from_json("fields", "map<string,string>"))
