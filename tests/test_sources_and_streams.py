import json

from harborlight.sources import readers, writers
from harborlight.streaming import metrics as M


def hotel(i, **more):
    return {"hotel_id": i, "name": f"h{i}", "star_rating": "4,5", "amenities": ["b", " "], "amenities_general": ["a"], "amenity_groups": {"g": ["c", "a"]}, "images": [{"url": "u", "caption": "x"}],
            "rooms": [{"room_type_id": 1, "name": "r", "price_per_night": "1.500 đ"}, {"name": "s", "price_per_night": 7}], "nearby_places": [{"name": "n", "distance_km": 1.25}],
            "activities": [{"activity_id": 3, "price": {"display": {"perBook": {"total": {"allInclusive": {"chargeTotal": 9.5}}}}}}], "useful_info": {"k": "v"}, "rating_breakdown": {}, "faq": [], **more}


def test_records_become_tables_and_bad_files_are_set_aside(spark, tmp_path):
    for name, text in {"hotel_1.json": json.dumps(hotel(1)), "hotel_2.json": json.dumps(hotel(1, name="later")), "hotel_3.json": "{broken", "hotel_4.json": json.dumps(hotel("x"))}.items():
        (tmp_path / name).write_text(text)
    records, rejected = readers.read_hotels(spark, str(tmp_path / "hotel_*.json"))
    assert sorted(r.reason for r in rejected.collect()) == ["no id", "unreadable"]
    tables = readers.to_tables(records)
    h = tables["hotels"].collect()
    assert len(h) == 1 and h[0].name == "h1" and h[0].amenities == ["a", "b", "c"] and float(h[0].star_rating) == 4.5 and h[0].images == ["u"]
    assert [float(r.price) for r in tables["rooms"].orderBy("seq").collect()] == [1500.0, 7.0]
    assert float(tables["activities"].first().price_amount) == 9.5 and float(tables["nearby_places"].first().distance_km) == 1.25
    writers.reload(tables, str(tmp_path / "out"))
    writers.reload(tables, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/rooms.parquet")).count() == 2


def test_lines_golden_and_markdown(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_lines(spark, str(tmp_path / "l.jsonl"), "a long").collect()) == [1, 2]
    (tmp_path / "g.json").write_text(json.dumps({"queries": [{"query_id": "q1", "relevant_hotel_ids": [1]}, {"query_id": "q2", "relevant_hotel_ids": []}]}))
    assert readers.read_golden(spark, str(tmp_path / "g.json")).count() == 1 and readers.read_golden(spark, str(tmp_path / "g.json"), True).count() == 2
    (tmp_path / "m.md").write_text('### Q1-2 — Title\ntext\n```jsonc\n{"a": "x//y", // note\n "b": 1}\n```\n')
    row = readers.read_golden_markdown(spark, str(tmp_path / "m.md")).first()
    assert (row.query_id, row.title, json.loads(row.body)) == ("Q1-2", "Title", {"a": "x//y", "b": 1})
    (tmp_path / "c.json").write_text(json.dumps({"concepts": {"A": {"facet": "f", "label": {"vi": "x"}, "surface_forms": {"vi": ["y"], "en": ["z"]}}}}))
    assert readers.read_concepts(spark, str(tmp_path / "c.json")).first().surface_forms == ["y", "z"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, 'b"')], "id long, v string")
    assert writers.append_unseen(df, str(tmp_path / "e"), "id", "id long, v string") == 2
    assert writers.append_unseen(df.unionAll(spark.createDataFrame([(3, "c"), (3, "c")], df.schema)), str(tmp_path / "e"), "id", "id long, v string") == 1
    writers.publish(df, str(tmp_path / "p"), "tbl", "1")
    writers.publish(df.limit(1), str(tmp_path / "p"), "tbl", "2")
    assert spark.table("tbl").count() == 1
    assert writers.inject("x\n<!-- AUTO-STATS:START -->\nold\n<!-- AUTO-STATS:END -->\ny", "new").count("new") == 1
    assert 'm{v="b\\""} 2' in writers.exposition(df, "m", ["v"], "id")
    assert writers.documents(df, "id").first().name == "acc_1" and writers.markdown(df).count("\n") == 3


def test_streams_agree_with_batches_and_resume(spark, tmp_path):
    src = tmp_path / "src"
    rows = [(i, f"2024-01-01T00:{i % 40:02d}:00", "a" if i % 3 else "b") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, ts string, kind string").selectExpr("id", "cast(ts as timestamp) ts", "kind")
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    M.stream_rates(stream, "ts", ["kind"], str(tmp_path / "out"), str(tmp_path / "ck"), late="1 minute").awaitTermination()
    got = {(r.window_start, r.kind): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r.window_start, r.kind): r.n for r in M.rate(df, "ts", ["kind"]).collect()}
    assert got and all(want[k] == n for k, n in got.items())
    for _ in range(2):
        M.stream_unseen(spark.readStream.schema(df.schema).parquet(str(src)), "ts", "id", str(tmp_path / "u"), str(tmp_path / "uck")).awaitTermination()
    assert spark.read.schema("id long").json(str(tmp_path / "u")).count() == 100


def test_gauges_and_buckets(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 9.0), ("a", 3, None), ("b", 1, None)], "k string, t int, v double")
    h = {(r.k, r.le): r.n for r in M.histogram(df, ["k"], "v", [2, 8]).collect()}
    assert h == {("a", "2"): 1, ("a", "8"): 1, ("a", "+Inf"): 2, ("b", "2"): 0, ("b", "8"): 0, ("b", "+Inf"): 0}
    q = {r.k: r.p for r in M.bucket_quantile(df, ["k"], "v", [2.0, 8.0], 0.5, "p").collect()}
    assert q == {"a": 2.0, "b": None}
