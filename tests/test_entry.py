import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    import decimal
    import math

    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else f"{float(v):.6g}"
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_query_matches_its_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    r = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(row[names.index(c)]) for c in columns)) for row in r.fetchall())
    assert sorted(repr(tuple(plain(x[c]) for c in columns)) for x in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(__spark_entry__.queries()) - set(__spark_entry__.oracle_sql())))
def test_query_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_hotel_documents_have_every_room_place_and_activity(spark, duck):
    got = __spark_entry__.queries()["hotel_document_parts"](spark, DATA).orderBy("hotel_id", "part").collect()
    hotels = {r[0] for r in duck.execute("SELECT DISTINCT id FROM hotels WHERE id IS NOT NULL").fetchall()}
    assert {r.hotel_id for r in got if r.hotel} == hotels and sum(r.hotel is not None for r in got) == len(hotels) and all((r.hotel is not None) == (r.part == 0) for r in got)
    first = "(SELECT * FROM rooms WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY crawled_at) = 1)"
    for name, source, order in (("rooms", first, "price NULLS LAST,"), ("nearby_places", "(SELECT DISTINCT id, hotel_id, distance_km FROM nearby_places)", "distance_km NULLS LAST,"), ("activities", "(SELECT DISTINCT id, hotel_id FROM activities)", "")):
        want = duck.execute(f"SELECT hotel_id, id FROM {source} WHERE hotel_id IN (SELECT id FROM hotels) ORDER BY hotel_id, {order} id").fetchall()
        assert [(r.hotel_id, x.id) for r in got for x in r[name]] == want and all(len(r[name]) <= 200 for r in got)
    assert max(sum(len(r.rooms) for r in got if r.hotel_id == h) for h in hotels) > 20


def test_cities_with_marks_or_other_signs_have_ids_and_texts(spark, tmp_path):
    import unicodedata

    nfc, nfd = "Đà Nẵng", unicodedata.normalize("NFD", "Đà Nẵng")
    cities = [nfc, nfd, nfd, "Da Nang", "Da Nang", "H? N?i", "Huế?", "Huế", "Huế", "???", "樂", None, " "]
    spark.createDataFrame([(i, c, i) for i, c in enumerate(cities)], "id long, city string, crawled_at long").write.parquet(f"{tmp_path}/hotels.parquet")
    got = {(r.city, r.n, r.place_id) for r in __spark_entry__.queries()["location_ids"](spark, str(tmp_path)).collect()}
    assert got == {(nfc, 3, "DA_NANG"), ("Da Nang", 2, "DA_NANG_2"), ("H? N?i", 1, "H_N_I"), ("Huế", 2, "HUE"), ("Huế?", 1, "HUE_2"), ("???", 1, "PLACE"), ("樂", 1, "PLACE_2")}
    texts = {r.id: (r.name, r.n) for r in __spark_entry__.queries()["text_toolbox"](spark, str(tmp_path)).collect()}
    assert texts == {i: (c.strip() if i != 1 and i != 2 else nfc, len(unicodedata.normalize("NFC", c))) for i, c in enumerate(cities) if c is not None}


def test_full_hybrid_search_finds_what_only_the_vectors_find(spark, tmp_path):
    texts = ["Khách sạn có hồ bơi", "ho boi", "Nhà hàng ven sông"]
    spark.createDataFrame([(i, 10 + i, t) for i, t in enumerate(texts)], "doc_id long, hotel_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("AMEN_POOL", "hồ bơi", "amenity")], "concept_id string, label_vi string, facet string").write.parquet(f"{tmp_path}/concepts.parquet")
    lexical = __spark_entry__.queries()["bm25_topk"](spark, str(tmp_path)).collect()
    got = __spark_entry__.queries()["full_hybrid_search"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in lexical} == {0} and {10, 11} <= {r.hotel_id for r in got}
