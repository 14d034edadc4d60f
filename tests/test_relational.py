import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harborlight.functions import text as X
from harborlight.functions import values as V
from harborlight.operators import mining as K
from harborlight.operators import relational as R
from harborlight.plans import chunking, intent, search


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("out")).first().out


def test_no_filter_is_the_whole_corpus_and_no_key_is_nothing(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, city string")
    assert R.condition({"city": None}, {"city": []}, {}, {}) is None and R.whitelist(df, "id", None) is None
    assert R.restrict(df, None, "id").count() == 2
    empty = R.whitelist(df, "id", R.condition({"city": "nowhere"}))
    assert R.restrict(df, empty, "id").count() == 0
    assert [r.id for r in R.whitelist(df, "id", R.condition({"city": "a"})).collect()] == [1]


def test_membership_with_nulls(spark):
    df = spark.createDataFrame([(["a", None],), (None,), ([],)], "v array<string>")
    rows = df.select(V.has_any(F.col("v"), ["b"]).alias("x"), V.has_all(F.col("v"), ["a"]).alias("y")).collect()
    assert [(r.x, r.y) for r in rows] == [(False, True), (False, False), (False, False)]


def test_folding_keeps_or_maps_the_stroke(spark):
    assert one(spark, X.fold(F.col("t")), t="Đường Ẩm Ướt") == "đuong am uot"
    assert one(spark, X.fold(F.col("t"), False), t="Đường Ẩm Ướt") == "duong am uot"
    assert one(spark, X.slug(F.col("t")), t="  Phố Cổ (Hà Nội) ") == "PHO_CO_HA_NOI"
    assert one(spark, X.tokens(F.col("t")), t="") == []


def test_qualifiers_snippets_and_comments(spark):
    got = one(spark, X.split_qualifier(F.col("t")), t="Quy (Bình) ")
    assert (got.name, got.qualifier) == ("Quy", "Bình")
    assert tuple(one(spark, X.split_qualifier(F.col("t")), t="A / B")) == ("A", "B")
    assert tuple(one(spark, X.split_qualifier(F.col("t")), t=" A ")) == ("A", None)
    assert one(spark, X.snippet(F.col("t"), F.lit("needle"), 3), t="abcdef needle uvwxyz") == "ef needle uv"
    assert one(spark, X.strip_comments(F.col("t")), t='{"a": "x//y"} // gone') == '{"a": "x//y"} '
    assert one(spark, X.fenced(F.col("t")), t='see ```json\n{"a":1}\n``` end') == '{"a":1}'


def test_negation_looks_three_words_back_at_the_first_place(spark):
    cues = ["không"]
    assert one(spark, X.negated(F.col("t"), F.lit("hồ bơi"), cues), t="nơi này không có hồ bơi")
    assert not one(spark, X.negated(F.col("t"), F.lit("hồ bơi"), cues), t="không a b c hồ bơi")
    assert not one(spark, X.negated(F.col("t"), F.lit("hồ bơi"), cues), t="hồ bơi không sâu, không có hồ bơi")


def test_numbers(spark):
    assert one(spark, V.lenient_float(F.col("t")), t="12,5") == 12.5 and one(spark, V.lenient_float(F.col("t")), t="x") is None
    assert int(one(spark, V.digits(F.col("t")), t="12.5 m2")) == 1252
    assert one(spark, F.bround(F.lit(2.5), 0), t="") == 2.0
    assert one(spark, V.wilson(F.lit(0), F.lit(0)), t="") == 0.0
    import uuid

    assert one(spark, X.name_uuid(F.col("t")), t="chunk-1") == str(uuid.uuid5(uuid.NAMESPACE_DNS, "chunk-1"))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 500), st.integers(1, 500))
def test_wilson_is_below_the_share(spark, pos, more):
    n = pos + more
    got = one(spark, V.wilson(F.lit(pos), F.lit(n)), t="")
    assert 0 <= got <= pos / n + 1e-12


def test_rank_fusion_ties_and_metrics(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "q long, k long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (1, 12, 3)], "q long, k long, rank int")
    assert [r.k for r in search.fuse([a, b], "q", "k").orderBy("rank").collect()] == [10, 11, 12]
    ideal = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 5, 1)], "q long, k long, place int")
    m = {r.q: r for r in search.ranking_metrics(a, ideal, "q", "k", 10).collect()}
    assert (m[1].recall, m[1].ndcg, m[1].mrr, m[1].zero_result) == (1.0, 1.0, 1.0, 0.0)
    assert (m[2].recall, m[2].hit, m[2].zero_result) == (0.0, 0.0, 1.0)


def test_budget_keeps_the_first_and_is_a_prefix(spark):
    df = spark.createDataFrame([("a", 1, 90), ("a", 2, 5), ("b", 1, 3), ("b", 2, 3), ("b", 3, 9), ("b", 4, 1)], "g string, r int, cost long")
    kept = R.within_budget(df, ["g"], [F.col("r")], "cost", 10).collect()
    assert sorted((r.g, r.r) for r in kept) == [("a", 1), ("b", 1), ("b", 2)]


@pytest.mark.parametrize("n", [1, 4, 7])
def test_balanced_sample_takes_even_steps_of_groups_of_any_size(spark, n):
    sizes = {"a": 1, "b": 7, "c": 10, "d": 400}
    df = spark.createDataFrame([(g, i) for g, k in sizes.items() for i in range(k)] + [(None, 5)], "g string, v int")
    want = {(g, i * k // n) for g, k in sizes.items() if k > n for i in range(n)} | {(g, i) for g, k in sizes.items() if k <= n for i in range(k)}
    assert {(r.g, r.v) for r in R.balanced_sample(df, "g", [F.col("v")], n).collect()} == want


def test_running_totals_go_on_across_partitions(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(500)] + [("b", 1, None)], "g string, r int, cost long")
    got = sorted((r.g, r.r, r.position, r.total) for r in R.positions(df, "g", [F.col("r")], cost="cost").collect())
    run, want = 0, []
    for i in range(500):
        run += i % 3
        want.append(("a", i, i + 1, run))
    assert got == [*want, ("b", 1, 1, 0)]


def brute_pack(text, limit):
    import re

    text = (text or "").strip(" ")
    if not text:
        return []
    if len(text) <= limit:
        return [text]
    out, buf = [], ""
    for p in (s.strip(" ") for s in re.split(r"(?<=[.!?…])\s+", text)):
        if not p:
            continue
        if buf and len(buf) + len(p) + 1 > limit:
            out.append(buf)
            buf = p
        else:
            buf = f"{buf} {p}" if buf else p
    return out + [buf] * bool(buf)


def test_character_packing_matches_a_loop(spark):
    texts = ["", None, "short.", "a. bb. ccc. " * 40, "x" * 120 + ". y. z!", "một. hai! ba? " * 9]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.pack_characters(F.col("t"), 50).alias("c"))
    for r in df.collect():
        assert r.c == brute_pack(r.t, 50)


def test_word_packing_overlaps_and_sections(spark):
    text = " ".join(f"s{i} a b c d." for i in range(12))
    chunks = spark.createDataFrame([(text,)], "t string").select(chunking.pack_words(F.col("t"), 20, 5).alias("c")).first().c
    assert all(len(c.split()) <= 20 for c in chunks) and all(b.startswith(a.split(". ")[-1].rstrip(".")) for a, b in zip(chunks, chunks[1:]))
    df = spark.createDataFrame([(1, "intro\n# A\none\n## B\ntwo\n# C\nthree")], "id long, t string")
    assert [(r.breadcrumb, r.body) for r in chunking.sections(df, "id", "t").orderBy("section").collect()] == [("Document", "intro"), ("A", "one"), ("A > B", "two"), ("C", "three")]


def test_synonyms_leave_out_risky_short_folds(spark):
    df = spark.createDataFrame([("C1", "hồ"), ("C2", "Hồ bơi"), ("C3", "ho boi")], "c string, f string")
    got = {r.form: r.concept_ids for r in K.synonym_index(df, "f", "c").collect()}
    assert got == {"hồ": ["C1"], "hồ bơi": ["C2"], "ho boi": ["C2", "C3"]}


def test_many_forms_are_joined_instead(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "Có hồ bơi và sân vườn"), (2, None)], "id long, t string")
    forms = spark.createDataFrame([("A", "hồ bơi"), ("B", "sân vườn"), ("C", "nhà hàng")], "c string, f string")
    few = K.find_forms(docs, "id", "t", forms, "f", "c").collect()
    monkeypatch.setattr(K, "MOST_FORMS", 1)
    many = K.find_forms(docs, "id", "t", forms, "f", "c").collect()
    assert sorted(map(tuple, few)) == sorted(map(tuple, many)) and {r.concept for r in few} == {"A", "B"}


def test_greedy_words_are_used_once(spark):
    d = spark.createDataFrame([("ho boi", ["P"]), ("boi", ["S"]), ("san", ["G"])], "form string, concept_ids array<string>")
    df = spark.createDataFrame([(1, "Hồ bơi, sân")], "id long, t string")
    assert sorted(r.concept for r in K.greedy_concepts(df, "id", "t", d).collect()) == ["G", "P"]


def test_vector_search_is_exact_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(1)
    vs = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [1.0])]
    df = spark.createDataFrame(vs, "id long, v array<float>").repartition(3)
    q = df.where("id < 7").withColumnRenamed("id", "q")
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    got = {(r.q, r.id) for r in search.vector_search(df, "id", "v", q, "q", "v", 5).collect()}

    def cos(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 6) if na and nb else 0.0

    full = {i: [float(x) for x in v] for i, v in vs if v and len(v) == 8}
    want = {(a, b) for a in range(7) for b in sorted(full, key=lambda k: (-cos(full[a], full[k]), k))[:5]}
    assert got == want


def test_requests_become_filters(spark):
    d = spark.createDataFrame([("ho boi", ["P"]), ("tra duong", ["C"])], "form string, concept_ids array<string>")
    labels = spark.createDataFrame([("P", "amenity", "Hồ bơi"), ("C", "city", "Trà Dương")], "concept_id string, facet string, label string")
    rows = [(1, "Khách sạn 4 sao ở Trà Dương có hồ bơi, từ 8,5 điểm"), (2, None), (3, "bất kỳ")]
    got = {r.id: r for r in intent.parse(spark.createDataFrame(rows, "id long, t string"), "id", "t", d, labels, {"any": "bất kỳ"}).collect()}
    assert (got[1].star_min, got[1].review_min, got[1].place, got[1].amenities, got[1].confidence) == (4.0, 8.5, "C", ["P"], 1.0)
    assert got[1].expanded.endswith("Hồ bơi Trà Dương") and (got[2].confidence, got[3].confidence, got[3].rules) == (0.0, 0.0, ["any"])
    assert got[1].filters == '{"place":"C","amenities":["P"],"star_min":4.0,"review_min":8.5}' and got[2].filters == "{}"
    asked = [(1, "dưới 1,5 triệu"), (2, "trên 500k một đêm"), (3, "tầm 2tr"), (4, "từ 8 điểm, dưới 500000"), (5, "từ 1 triệu đến 3 triệu"), (6, None), (7, "khoảng 3 km"), (8, "under 2 million")]
    got = {r.id: (r.price_min, r.price_max) for r in spark.createDataFrame(asked, "id long, t string").select("id", *intent.prices(F.col("t"))).collect()}
    assert got == {1: (None, 1.5e6), 2: (5e5, None), 3: (1.4e6, 2.6e6), 4: (None, 5e5), 5: (1e6, None), 6: (None, None), 7: (None, None), 8: (None, 2e6)}
    assert intent.merge_filters({"city": "a", "star": 3}, {"city": "b", "star": None}) == {"city": "b", "star": 3}
    with pytest.raises(ValueError):
        intent.check_request(top_k=51)


def test_positions_of_a_hot_group_cover_all_its_rows(spark):
    rows = [(1 if i % 10 else i, (i * 7919) % 500, i) for i in range(3000)] + [(None, 1, -1)]
    got = sorted(tuple(r) for r in R.positions(spark.createDataFrame(rows, "g long, s long, id long"), "g", [F.col("s"), F.col("id")]).collect())
    by = {}
    for g, s, i in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(g, []).append((g, s, i))
    assert got == sorted((*r, k) for v in by.values() for k, r in enumerate(v, 1))
