import json
import uuid

import pytest
from pyspark.sql import functions as F

from harborlight.functions import text as X
from harborlight.functions import values as V
from harborlight.operators import mining
from harborlight.operators import relational as R
from harborlight.sources import readers, writers


def test_versions_move_behind_a_pointer_and_keys_are_replaced(spark, tmp_path):
    folder = str(tmp_path)
    a = spark.createDataFrame([(1, "a"), (2, "b"), (None, "x")], "id long, v string")
    with pytest.raises(FileNotFoundError):
        writers.current(spark, folder, "t")
    writers.upsert(a, folder, "t", "id", "1")
    for _ in range(2):
        writers.upsert(spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id long, v string"), folder, "t", "id", f"2-{_}")
    assert {tuple(r) for r in writers.current(spark, folder, "t").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in spark.table("t").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    writers.write_layers({"edges": a, "places": a.limit(0)}, folder, "9")
    assert writers.current(spark, folder, "edges").count() == 3 and writers.current(spark, folder, "places").count() == 0


def test_vectors_come_back_by_key(spark, tmp_path):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (None, [1.0, 1.0])], "id long, v array<double>")
    writers.write_vectors(v, f"{tmp_path}/v", "id", "v", 2)
    assert [(r.id, r.v) for r in readers.read_vectors(spark, f"{tmp_path}/v", "id", "v").collect()] == [(1, [1.0, 2.0])]
    with pytest.raises(Exception, match="length 2"):
        writers.write_vectors(spark.createDataFrame([(7, [1.0])], "id long, v array<double>"), f"{tmp_path}/w", "id", "v", 2)


def test_broken_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": \n{"x": 2}\n')
    assert {r.x for r in readers.read_lines(spark, str(tmp_path), "x int").collect()} == {1, 2}
    assert [r.line for r in readers.rejected_lines(spark, str(tmp_path), "x int").collect()] == ['{"x": ']


def test_reports_and_times(spark):
    m = spark.createDataFrame([("a", 1.0, 0.0), ("a", 0.5, 0.0), ("b", None, 1.0)], "grp string, recall double, zero_result double")
    report = writers.evaluation_report(m, "grp", ["recall"], [0.1] * 20 + [9.0])
    assert "| a | 2 | 0.75 |" in report and "| b | 1 | 0.0 |" in report and "| all | 3 | 0.75 |" in report and "results: 1" in report and "p95 0.100 s" in report
    assert len(writers.timed(lambda: None, 2, 3)) == 3


def test_registries_names_and_rules(spark):
    known = spark.createDataFrame([("a", "t", "A1"), ("b", None, "B1")], "name string, type string, id string")
    rows = spark.createDataFrame([(1, "a", "t"), (2, "b", "t"), (3, "c", None)], "k long, name string, type string")
    got = {r.k: (r.id, r.fresh) for r in R.register(rows, known, [["name", "type"], ["name"]], "id", F.concat(F.lit("N_"), F.col("name"))).collect()}
    assert got == {1: ("A1", False), 2: ("B1", False), 3: ("N_c", True)}
    ids = known.select("name", "id")
    assert R.map_all(rows.where("k < 3").select("k", "name"), ids, "name", "id").count() == 2
    with pytest.raises(ValueError, match="c"):
        R.map_all(rows.select("k", "name"), ids, "name", "id")


def test_answers_of_a_call_that_fails(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(6)], "id long, t string").coalesce(1)

    def call(part):
        if any(r["id"] == 4 for r in part):
            raise OSError("busy")
        return [json.dumps({"n": r["id"]}) for r in part]

    got = {r.id: (r.answer, r.failed) for r in mining.annotate(rows, call, tries=2, batch=2).collect()}
    assert got[0] == ('{"n": 0}', False) and got[4] == (None, True) and got[5] == (None, True) and len(got) == 6

    def refused(_):
        raise PermissionError("no key")

    with pytest.raises(Exception, match="no key"):
        mining.annotate(rows, refused).collect()


def test_small_functions(spark):
    df = spark.createDataFrame([(1, "﻿ a \t b\r\n\n\n\nc ", "A_b  C", ["AMEN_A", "OBJ_B", None], {"x": 1.0, "y": None})], "id long, t string, u string, c array<string>, m map<string,double>")
    r = df.select(X.clean_space(F.col("t")).alias("clean"), X.normalise(F.col("u")).alias("norm"), V.with_prefix(F.col("c"), "AMEN_").alias("pre"), V.drop_nulls(F.col("m")).alias("m"), X.name_uuid(F.col("u")).alias("uuid"), X.segmented(F.col("t"), lambda c: F.upper(c)).alias("seg"), X.segmented(F.col("t")).alias("same"), X.long_words(F.col("u"), 1).alias("w"), V.map_lines(F.col("m")).alias("lines"), V.first_positive(F.array(F.lit(-1), F.lit(3), F.lit(2))).alias("pos"), X.variants(F.lit("Đà Nẵng")).alias("var"), V.lookup(F.lit("q"), {"a": "b"}, "z").alias("look"), X.fold(F.lit("Й Ё が Ờ")).alias("fold")).first()
    assert r.clean == "a b\n\nc" and r.norm == "a b c" and r.pre == ["AMEN_A"] and r.m == {"x": 1.0} and r.uuid == str(uuid.uuid5(uuid.NAMESPACE_DNS, "A_b  C"))
    assert r.seg == r.same.upper() and r.w == ["a", "b", "c"] and r.lines == ["x: 1.0"] and r.pos == 2 and r.var == ["Đà Nẵng", "đà nẵng", "đa nang", "da nang"] and r.look == "z" and r.fold == "и е か o"
