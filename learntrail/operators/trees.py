"""Trees as tables of nodes, tags assigned level by level, and tables that must fit each other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learntrail.operators.sequence import ranked
from learntrail.sources.tables import checkpointed


def tree_levels(nodes: DataFrame) -> DataFrame:
    """``level, parent_id, id, label`` of rows ``id, parent_id, label``, from the roots (null or empty parent, level 1) down, of any depth.

    One join a level until none is left; a node counts at the level where it is first reached, so a loop ends, and nodes that no
    root reaches are left out.
    """
    nodes = checkpointed(nodes.select("id", F.nullif("parent_id", F.lit("")).alias("parent_id"), "label").dropDuplicates(["id"]))
    level, k = checkpointed(nodes.where("parent_id IS NULL").withColumn("level", F.lit(1))), 1
    out = level
    while not level.isEmpty():
        k += 1
        below = nodes.join(level.select(F.col("id").alias("parent_id")), "parent_id").withColumn("level", F.lit(k))
        level = checkpointed(below.join(out.select("id"), "id", "left_anti").select("id", "parent_id", "label", "level"))
        out = out.unionByName(level)
    return out.select("level", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "id", "label")


def assign_tags(questions: DataFrame, nodes: DataFrame, ask: Callable[[list[str], list[list[str]], int], list], tries: int = 5) -> DataFrame:
    """``question_id, level, node_id, valid``: the nodes that a classifier chooses for each question, from the roots down.

    ``ask(texts, options, attempt)`` gives for each text the labels it chooses among that text's options; it may raise or give
    anything. An answer counts if it is a list of at least one option and of options only. Questions whose answer doesn't count are
    asked again, alone, up to ``tries`` times; then what their last answer has of the options is taken, and is not ``valid``. The
    chosen nodes with children are the next level's frontier. Null texts are empty; repeated questions are asked each.
    """
    nodes = checkpointed(nodes.select("id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "label").dropDuplicates(["id"]))
    options = checkpointed(nodes.groupBy("parent_id").agg(F.array_sort(F.collect_list(F.struct("id", "label"))).alias("options")))
    asked = questions.select("question_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = questions.schema["question_id"].dataType.simpleString()

    def run(attempt: int):
        def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                labels = [[o["label"] for o in own] for own in batch.options]
                try:
                    answers = list(ask(batch.text.tolist(), labels, attempt))
                except Exception:
                    answers = []
                answers += [None] * (len(batch) - len(answers))
                lists = [list(a) if isinstance(a, (list, tuple)) else [] for a in answers]
                yield batch.assign(
                    valid=[bool(a) and all(x in own for x in a) for a, own in zip(lists, labels, strict=True)],
                    chosen=[sorted({o["id"] for o in own if o["label"] in a}) for a, own in zip(lists, batch.options, strict=True)],
                )[["question_id", "text", "parent_id", "options", "valid", "chosen"]]

        return answered

    row = "parent_id string, options array<struct<id:string,label:string>>"
    frontier, level, out = asked.withColumn("parent_id", F.lit("")), 0, None
    while True:
        level += 1
        left, settled = checkpointed(frontier.join(options, "parent_id").select("question_id", "text", "parent_id", "options")), None
        if left.isEmpty():
            break
        for attempt in range(tries):
            tried = checkpointed(left.mapInPandas(run(attempt), f"question_id {kind}, text string, {row}, valid boolean, chosen array<string>"))
            done = tried if attempt == tries - 1 else tried.where("valid")
            settled = done if settled is None else settled.unionByName(done)
            left = tried.where("NOT valid").select("question_id", "text", "parent_id", "options")
            if attempt < tries - 1 and left.isEmpty():
                break
        chosen = checkpointed(settled.select("question_id", "text", "valid", F.explode("chosen").alias("node_id")))
        found = chosen.select("question_id", F.lit(level).alias("level"), "node_id", "valid")
        out = found if out is None else out.unionByName(found)
        frontier = chosen.select("question_id", "text", F.col("node_id").alias("parent_id"))
    return out if out is not None else questions.sparkSession.createDataFrame([], f"question_id {kind}, level int, node_id string, valid boolean")


def align_keys(events: DataFrame, universes: list[tuple[str, DataFrame, list[str]]], strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Events whose keys all universes have, with their other columns, and ``reason, n``: how many were kept, and dropped under the first universe that lacks them.

    A universe is (reason, table with unique keys and perhaps columns to add, key columns, composite or not). With ``strict``, any dropped event is an error. Null keys are in no universe.
    """
    reason = F.lit("kept")
    for k, (name, table, keys) in reversed(list(enumerate(universes))):
        events = events.join(table.withColumn(f"_has{k}", F.lit(True)), keys, "left")
        reason = F.when(F.col(f"_has{k}").isNull(), name).otherwise(reason)
    marked = checkpointed(events.withColumn("reason", reason).drop(*[f"_has{k}" for k in range(len(universes))]))
    counts = marked.groupBy("reason").agg(F.count("*").alias("n"))
    if strict:
        lost = {r.reason: r.n for r in counts.where("reason <> 'kept'").collect()}  # one row a universe
        if lost:
            raise ValueError(f"events outside the universe: {lost}")
    return marked.where("reason = 'kept'").drop("reason"), counts


def borrowed(rows: DataFrame, sibling: DataFrame, order: list[str], column: str) -> DataFrame:
    """``rows`` with ``column`` of the sibling's row at the same place in ``order``; other numbers of rows are an error."""
    a = ranked(rows, *map(F.col, order))
    b = ranked(sibling.select(*order, column), *map(F.col, order))
    n, m = (x.agg(F.coalesce(F.max("_rows"), F.lit(0))).first()[0] for x in (a, b))
    if n != m:
        raise ValueError(f"{n} rows can't borrow from {m}")
    return a.drop("_rows").join(b.select("_rank", column), "_rank").drop("_rank")


def latex_lines(cells: DataFrame, row: str, column: str, text: str, columns: list[str]) -> DataFrame:
    """``place, line``: a LaTeX table's lines from cells ``row, column, text``, rows in order and ``columns`` as named.

    Every row must have one cell for every column; a missing or null cell is an error, so that no half-filled table is written.
    """
    wide = cells.groupBy(F.col(row).alias("r")).pivot(column, columns).agg(F.first(text))
    missing = wide.where(" OR ".join(f"`{c}` IS NULL" for c in columns)).select("r").limit(20).collect()
    if missing:
        raise ValueError(f"rows with missing cells: {[r[0] for r in missing]}")
    lines = wide.select(F.row_number().over(Window.orderBy("r")).alias("place"), F.concat_ws(" & ", F.col("r").cast("string"), *[F.col(f"`{c}`") for c in columns]).alias("line"))
    lines = lines.withColumn("line", F.concat("line", F.lit(" \\\\")))
    head = [(-2, "\\begin{tabular}{l" + "r" * len(columns) + "}"), (-1, " & ".join([row, *columns]) + " \\\\"), (0, "\\hline")]
    ends = cells.sparkSession.createDataFrame([*head, (2**31 - 1, "\\end{tabular}")], "place int, line string")
    return lines.unionByName(ends)
