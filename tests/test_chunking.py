import json
import re

import pytest
from pyspark.sql import functions as F

from harborlight.plans import chunking


def brute_sections(text):
    out, path, title, lines = [], [], "Document", []

    def flush():
        body = re.sub(r"[ \t]+", " ", "\n".join(lines)).strip(" ")
        if re.sub(r"\s", "", body):
            out.append((title, re.sub(r"\s+", " ", body).strip()))

    for line in text.split("\n"):
        m = re.match(r"^(#{1,6})\s+(\S.*)$", line)
        if m:
            flush()
            path[len(m[1]) - 1 :] = [m[2].strip()]
            title, lines = " > ".join(path), []
        else:
            lines.append(line)
    flush()
    return out


@pytest.mark.parametrize("text", ["# A\nx\n# B\ny\n# A\nz", "before\n## Sub\nbody\n#### Deep\nmore\n# Top\nend", "no heading at all", "# only\n# headings", "", "#nohash\ntext\n####### seven\nx", "# A \r\ntext\r\n\r\n\r\n\r\nmore\r\n## B\r\n", "x " * 20_000 + "\n# H\n" + "y\n" * 3_000])
def test_sections_are_numbered_and_never_merged(spark, text):
    df = spark.createDataFrame([(1, text), (2, None)], "id long, t string")
    rows = chunking.sections(df, "id", "t").orderBy("section").collect()
    assert [(r.breadcrumb, re.sub(r"\s+", " ", r.body).strip()) for r in rows] == brute_sections(text.replace("\r\n", "\n"))
    assert len({r.section for r in rows}) == len(rows)


H = "id long, name string, description string, amenities array<string>, policy_notes array<string>, useful_info string, faq string, reviews_detail string, crawled_at long"
R = "id long, hotel_id long, name string, room_size string, bed_type string, room_view string, max_occupancy int, room_amenities array<string>, crawled_at long"


def test_all_kinds_of_chunks(spark):
    faq = json.dumps([{"question": "Q1?", "answer": "A1"}, None, {"question": None, "answer": "A3"}])
    reviews = json.dumps({"sample_comments": [{"title": f"T{i}", "text": "ok", "positives": None, "response": "thanks"} for i in range(11)]})
    h = spark.createDataFrame([(1, "Nhà A", "Mô tả ngắn.", ["Hồ bơi", " Hồ bơi", "", None], ["Không hút thuốc"], json.dumps({"b": 2, "a": "một", "c": "", "d": None}), faq, reviews, 1), (1, "old", None, None, None, None, None, None, 9), (2, None, None, None, None, "not json", "{", None, 1), (None, "x", "y", None, None, None, None, None, 1)], H)
    r = spark.createDataFrame([(7, 1, "Phòng đôi", "20 m2", None, "vườn", 2, ["Tivi", None]), (8, 1, None, None, None, None, None, None), (9, None, "x", None, None, None, None, None)], R.replace(", crawled_at long", "")).withColumn("crawled_at", F.lit(1).cast("long"))
    n = spark.createDataFrame([(5, 1, "Chợ", "Chợ", None), (6, 1, "Hồ", None, "1.50")], "id long, hotel_id long, name string, type string, distance_km string").withColumn("distance_km", F.col("distance_km").cast("decimal(6,2)"))
    a = spark.createDataFrame([(3, 1, "Đi bộ", None), (4, 1, None, None)], "id long, hotel_id long, title string, description string")
    got = {x.chunk_id: (x.source_type, x.seq, x.text) for x in chunking.hotel_chunks(h, r, n, a).collect()}
    assert all("null" not in t for _, _, t in got.values()) and not any(c.startswith("chunk-2") for c in got)
    assert got["chunk-1-room-7-001"] == ("room_info", 1, "Phòng đôi. diện tích 20 m2. hướng vườn. tối đa 2 khách. tiện nghi phòng: Tivi") and "chunk-1-room-8-001" not in got
    assert got["chunk-1-near-5-001"][2] == "Chợ (Chợ)" and got["chunk-1-near-6-001"][2] == "Hồ — cách 1.50 km"
    assert got["chunk-1-faq-001"][2] == "Q1?. A1" and got["chunk-1-faq-003"][2] == "A3" and "chunk-1-faq-002" not in got
    assert {k: v[2] for k, v in got.items() if v[0] == "policy"} == {"chunk-1-policy-001": "Không hút thuốc", "chunk-1-policy-002": "a: một", "chunk-1-policy-003": "b: 2"}
    assert sorted(v[1] for v in got.values() if v[0] == "review") == [*range(1, 9)] and got["chunk-1-review-001"][2] == "T0. ok. thanks"
    assert got["chunk-1-amen-001"][2] == "Tiện nghi: Hồ bơi" and got["chunk-1-desc-001"][2] == "Mô tả ngắn."


def test_reviews_pages_and_their_dispatch(spark):
    r = spark.createDataFrame([(1, "a", "Good", "We liked it a lot here", "bed", None), (1, "b", "GOOD", "we liked it a lot here", "BED", ""), (2, "c", "Good", "We liked it a lot here", "bed", None), (2, "d", None, "short", None, None), (None, "e", None, "x" * 30, None, None)], "owner long, review string, title string, text string, positives string, negatives string")
    got = [(x.owner, x.review, x.text) for x in chunking.review_chunks(r, "owner", "review").orderBy("owner").collect()]
    assert [g[:2] for g in got] == [(1, "a"), (2, "c")] and got[0][2] == "Good\nWe liked it a lot here\nDiem tich cuc: bed"
    pages = spark.createDataFrame([(1, "Site", "# A\none. two.\n# A\nthree."), (2, None, "plain text"), (3, "t", None)], "id long, title string, body string")
    out = [(x.id, x.section, x.text) for x in chunking.cms_chunks(pages, "id", "title", "body").orderBy("id", "section").collect()]
    assert out == [(1, 0, "Site — A\none. two."), (1, 1, "Site — A\nthree."), (2, 0, "Document\nplain text")]
    mixed = spark.createDataFrame([(["r"], "h", None), (None, None, "b"), (None, "h", None)], "reviews array<string>, hotel_name string, body string")
    assert [x.k for x in mixed.select(chunking.source_kind(mixed.columns).alias("k")).collect()] == ["review", "cms", "hotel"]
    odd = spark.createDataFrame([], "id long, description string, _x int, tags array<string>, rooms array<string>, nested array<struct<a:int>>, s struct<a:int>")
    assert chunking.metadata(odd) == ["id", "tags"]
