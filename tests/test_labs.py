"""Ranges of large JSON objects against the whole object parsed at once; broken files; labs over several tasks."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from learntrail.sources import labs, readers

TEXT = st.text(st.sampled_from('ab"\\{}[],: \n\té😀'), max_size=8)
VALUE = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | TEXT, lambda v: st.lists(v, max_size=4) | st.dictionaries(TEXT, v, max_size=3), max_leaves=12)


def parted(data, size):
    """Scalars, and the elements by name, as the reader's two passes give them."""
    fields, ranges = labs.json_ranges(lambda a, b: data[a:b], len(data), size)
    found = {}
    for name, begin, end in ranges:
        found.setdefault(name, []).extend(json.loads(x) for _, x in labs.elements(data[begin:end]))
    return fields, found


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(TEXT, VALUE, max_size=4), st.integers(1, 40), st.integers(1, 60), st.sampled_from([None, 1, 4]), st.booleans())
def test_elements_equal_the_parsed_object(held, size, block, indent, ascii_only):
    before, labs.BLOCK = labs.BLOCK, block
    try:
        fields, found = parted(json.dumps(held, indent=indent, ensure_ascii=ascii_only).encode(), size)
    finally:
        labs.BLOCK = before
    assert fields == {k: v if isinstance(v, str) else json.dumps(v) for k, v in held.items() if not isinstance(v, (list, dict))}
    assert {k: v for k, v in found.items() if v} == {k: v if isinstance(v, list) else [v] for k, v in held.items() if isinstance(v, (list, dict)) and (v or isinstance(v, dict))}


@pytest.mark.parametrize("text", ["", "  ", "[]", "5", '"x"', '{"a": [1, 2]', '{"a": [1, 2}', '{"a": "x', '{"a": [1]} {"b": 2}', '{"a": [1]]}', '{"a"}', '{"a", "b": 1}', "{1: 2}", '{"a": nonsense}', "}"])
def test_broken_objects_are_errors(text):
    with pytest.raises(ValueError):
        labs.json_ranges(lambda a, b: text.encode()[a:b], len(text))


def lab(answers, questions=()):
    return {"lab_name": "L", "list_questions": list(questions), "student_answers": answers}


def answer(k):
    return {"name": f"S{k}", "id": str(k), "review_link": "", "response_history": [{"question": "Question 1", "results": [{"step": "1", "time": "t", "action": f'say "{k}", [{{', "state": "", "score": ""}]}]}


def test_a_lab_is_read_in_several_tasks(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "W12_Final Exam.json").write_text(json.dumps(lab([answer(k) for k in range(4000)]), indent=2))
    rows = labs.json_elements(spark, str(tmp_path), size=20_000)
    spread = rows.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(spread) > 1 and sum(r["count"] for r in spread) == 4000
    assert [json.loads(r.json)["id"] for r in rows.orderBy("place").collect()] == [str(k) for k in range(4000)]
    steps = readers.lab_history(readers.scan_labs(spark, str(tmp_path))).select("lab_name", "week", "student_uid", "action").collect()
    assert {tuple(r) for r in steps} == {("L", 12, str(k), f'say "{k}", [{{') for k in range(4000)} and len(steps) == 4000


def test_broken_files_and_odd_elements(spark, tmp_path):
    q = lambda n, **more: {"question": n, "name": n, "template": "t", "max_score": "1", "testcases": [{"input": "a", "std_input": "", "output": "b"}], **more}
    odd = lab([answer(1), {"id": "2"}, {"id": "3", "response_history": []}, {"id": "4", "response_history": [{"question": "Question 1", "results": []}]}, 5, None, [answer(6)]], [q("Question 1"), [q("Question 2.1"), q("Question 2.2", extra=[1])], 7, None, [], "x"])
    (tmp_path / "W1_Lists.json").write_text(json.dumps(odd))
    (tmp_path / "W2_Trees.json").write_text(json.dumps(odd)[:-40])
    (tmp_path / "W3_Empty.json").write_text("")
    (tmp_path / "W4_None.json").write_text("{}")
    (tmp_path / "W5_Exam.json").write_text(json.dumps(lab([])))
    rows = readers.scan_labs(spark, str(tmp_path))
    assert sorted(r.week for r in rows.where("malformed").collect()) == [2] and {r.week for r in rows.where("NOT malformed").collect()} == {1}
    asked = readers.lab_questions(rows).orderBy("question").collect()
    assert [(r.question, r.position, r.max_score, r.testcases[0].output) for r in asked] == [("Question 1", 0, "1", "b"), ("Question 2.1", 1, "1", "b"), ("Question 2.2", 1, "1", "b")]
    steps = readers.lab_history(rows).collect()
    assert sorted((r.student_uid, r.question, r.action) for r in steps if r.action) == [("1", "Question 1", 'say "1", [{')]
    assert sorted((r.student_uid, r.question or "") for r in steps if not r.action) == [("2", ""), ("3", ""), ("4", "Question 1")]
