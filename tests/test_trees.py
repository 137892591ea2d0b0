"""Trees of any depth, tagging with retries, aligned keys, borrowed columns and guarded tables."""

import pytest
from pyspark.sql import functions as F

from learntrail.operators import trees as T


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, parent_id string, label string")


def test_levels_of_any_depth(spark):
    chain = [(f"k{i}", f"k{i - 1}" if i else None, f"l{i}") for i in range(9)]
    loop = [("x", "y", "x"), ("y", "x", "y"), ("lost", "nowhere", "lost"), ("k3", "k2", "l3")]
    found = {r.id: (r.level, r.parent_id) for r in T.tree_levels(nodes(spark, chain + loop)).collect()}
    assert found == {f"k{i}": (i + 1, f"k{i - 1}" if i else "") for i in range(9)}
    assert T.tree_levels(nodes(spark, [])).count() == 0


TREE = [("a", "", "alpha"), ("b", "", "beta"), ("a1", "a", "one"), ("a2", "a", "two"), ("a1x", "a1", "deep"), ("b1", "b", "one")]


def test_failing_rows_alone_are_asked_again(spark, tmp_path):
    log = str(tmp_path / "asked")

    def ask(texts, options, attempt):
        with open(log, "a") as file:
            file.writelines(f"{attempt} {t} {' '.join(o)}\n" for t, o in zip(texts, options, strict=True))
        answers = {"good": lambda o: o[:1], "late": lambda o: o[:1] if attempt >= 2 else ["wrong"], "never": lambda o: ["wrong", o[-1]], "odd": lambda o: None, "": lambda o: "text"}
        return [answers[t](o) for t, o in zip(texts, options, strict=True)]

    questions = spark.createDataFrame([(1, "good"), (2, "late"), (3, "never"), (4, "odd"), (5, None)], "question_id long, text string")
    found = {(r.question_id, r.level, r.node_id, r.valid) for r in T.assign_tags(questions, nodes(spark, TREE), ask, tries=3).collect()}
    deep = {(1, "a"), (2, "a1"), (3, "a1x")}
    assert found == {(q, level, n, True) for q in (1, 2) for level, n in deep} | {(3, 1, "b", False), (3, 2, "b1", False)}
    asked = [x.split()[:2] for x in open(log)]
    assert [x for x in asked if x[1:] == ["good"]] == [["0", "good"]] * 3 and sorted(x[0] for x in asked if x[1:] == ["late"]) == sorted("012" * 3)


def test_a_classifier_that_raises_gives_no_tags(spark):
    def ask(texts, options, attempt):
        raise RuntimeError("down")

    questions = spark.createDataFrame([(1, "x")], "question_id long, text string")
    assert T.assign_tags(questions, nodes(spark, TREE), ask, tries=2).count() == 0
    assert T.assign_tags(questions, nodes(spark, []), ask).count() == 0 and T.assign_tags(questions.limit(0), nodes(spark, TREE), ask).count() == 0


def test_keys_are_aligned(spark):
    events = spark.createDataFrame([(1, "u", 1, 5), (2, "v", 1, 5), (3, "u", 2, 5), (4, None, 1, 5), (5, "w", 9, 9)], "row_id long, uid string, course long, q long")
    learners = spark.createDataFrame([("u", 0), ("w", 1)], "uid string, s long")
    questions = spark.createDataFrame([(1, 5, 7)], "course long, q long, item long")
    pairs = [("student", learners, ["uid"]), ("question", questions, ["course", "q"])]
    kept, counts = T.align_keys(events, pairs)
    assert [(r.row_id, r.s, r["item"]) for r in kept.collect()] == [(1, 0, 7)]
    assert {r.reason: r.n for r in counts.collect()} == {"kept": 1, "student": 2, "question": 2}
    with pytest.raises(ValueError, match="student"):
        T.align_keys(events, pairs, strict=True)
    assert T.align_keys(events.where("row_id = 1"), pairs, strict=True)[0].count() == 1


def test_borrowing_needs_as_many_rows(spark):
    rows = spark.createDataFrame([(2, "b"), (1, "a"), (3, "c")], "k long, v string")
    other = spark.createDataFrame([(10, 7), (30, 9), (20, 8)], "k long, attempt long")
    assert {r.v: r.attempt for r in T.borrowed(rows, other, ["k"], "attempt").collect()} == {"a": 7, "b": 8, "c": 9}
    with pytest.raises(ValueError, match="borrow"):
        T.borrowed(rows, other.limit(2), ["k"], "attempt")


def test_tables_with_holes_are_not_written(spark):
    cells = spark.createDataFrame([("m", "a", "1"), ("m", "b", "2"), ("n", "a", "3"), ("n", "b", "4")], "model string, what string, text string")
    lines = [r.line for r in T.latex_lines(cells, "model", "what", "text", ["b", "a"]).orderBy("place").collect()]
    assert lines == ["\\begin{tabular}{lrr}", "model & b & a \\\\", "\\hline", "m & 2 & 1 \\\\", "n & 4 & 3 \\\\", "\\end{tabular}"]
    with pytest.raises(ValueError, match="'n'"):
        T.latex_lines(cells.where(F.col("text") != "4"), "model", "what", "text", ["b", "a"])
