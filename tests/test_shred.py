import json

import pytest

from harborlight.operators import shred
from harborlight.operators.shred import adjacency, entity_table, filled, parse


def paths(spark, rows):
    df = spark.createDataFrame(rows, "id long, name string, faq string")
    out = filled(adjacency(df, "id", ["faq"])).collect()
    return {(r.id, r.path, r.parent_path) for r in out}


def test_nested_arrays_optional_members_and_encoded_values(spark):
    rows = [
        (1, "a", json.dumps([{"q": "x", "followups": [{"q": "y"}, None, {"q": "z"}]}, {}])),
        (2, "b", json.dumps({"q": "alone", "followups": {"q": "also alone"}})),
        (3, "c", json.dumps(json.dumps([{"q": json.dumps({"inner": 1})}]))),
    ]
    assert paths(spark, rows) == {
        (1, "faq[0]", ""), (1, "faq[0].followups[0]", "faq[0]"), (1, "faq[0].followups[2]", "faq[0]"),
        (2, "faq[0]", ""), (2, "faq[0].followups[0]", "faq[0]"),
        (3, "faq[0]", ""), (3, "faq[0].q", "faq[0]"),
    }


def test_an_object_that_is_never_an_array_keeps_its_path(spark):
    assert paths(spark, [(1, "a", '{"x": {"y": {"z": 1}}}')]) == {(1, "faq", ""), (1, "faq.x", "faq"), (1, "faq.x.y", "faq.x")}


def test_no_rows_for_nulls_blanks_scalars_and_bad_json(spark):
    assert paths(spark, [(1, "a", None), (2, "a", ""), (3, "a", " "), (4, "a", "null"), (5, "a", '{"x": 1'), (6, "a", '{"x": NaN}'), (7, "a", '"text"'), (None, "a", '{"x": 1}'), (8, "a", '{}')]) == set()
    assert paths(spark, []) == set()


def test_deep_nesting_and_long_text():
    deep = "[" * 200 + '{"a":1}' + "]" * 200
    assert parse(deep) is not None and parse("[" * 200_000) is None
    assert parse(json.dumps({"a": "x" * 1_000_000}))["a"][-1] == "x"


def test_entity_table_ties_children_to_parents(spark):
    df = spark.createDataFrame([(1, json.dumps([{"question": "q1", "answer": None, "followups": [{"question": "q2", "answer": 3}]}]))], "id long, faq string")
    flat = {r.path: r for r in entity_table(adjacency(df, "id", ["faq"]), r"faq\[\d+\]", ["question", "answer"]).collect()}
    assert flat["faq[0]"].question == "q1" and flat["faq[0]"].answer is None and flat["faq[0]"].parent_path == ""
    assert flat["faq[0].followups[0]"].answer == "3" and flat["faq[0].followups[0]"].parent_path == "faq[0]"


@pytest.mark.parametrize("most", [5_000, 0])
def test_deep_objects_repeated_records_and_long_lists_of_shapes(spark, monkeypatch, most):
    monkeypatch.setattr(shred, "MOST_SHAPES", most)
    value, want, path = {"end": 1}, set(), "faq"
    for _ in range(20):
        value = {"x": [None, value], "one": {"y": 0}}
    deep = json.dumps(value)
    for k in range(21):
        above = path.rsplit(".", 1)[0] if k else ""
        want |= {(i, path, above) for i in (1, 1)}
        if k < 20:
            want.add((1, f"{path}.one", path))
        path += ".x[1]"
    assert paths(spark, [(1, "a", deep), (1, "b", deep)]) == want
    assert paths(spark, [(1, "a", '{"m": {"k": 1}}'), (2, "a", '{"m": [{"k": 1}]}')]) == {(1, "faq", ""), (2, "faq", ""), (1, "faq.m[0]", "faq"), (2, "faq.m[0]", "faq")}


def test_objects_without_children_come_from_the_links(spark):
    nodes = adjacency(spark.createDataFrame([(1, '{"a": {}, "b": {"c": null}}')], "id long, faq string"), "id", ["faq"])
    assert {r.path for r in shred.objects(nodes).collect()} == {"faq", "faq.a", "faq.b"} and {r.path for r in filled(nodes).collect()} == {"faq", "faq.b"}
    assert {r.path for r in shred.objects(nodes.where("parent < 0 or label <> 'b'")).collect()} == {"faq", "faq.a"}
