"""Queries that build knowledge objects, search them and serve contexts, on the test tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import mining as K
from ..operators import relational as R
from ..tables import table
from . import knowledge, search, serving
from .serving import H, hotels_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
query = serving.registrar(QUERIES, ORACLE)


@query("""WITH v AS (SELECT hotel_id, room_type_id, bool_or(review_score >= 8) AS p FROM rooms WHERE hotel_id IS NOT NULL AND review_score IS NOT NULL AND room_type_id IS NOT NULL GROUP BY 1, 2),
a AS (SELECT hotel_id, count(*) FILTER (WHERE p) AS pos, count(*) FILTER (WHERE NOT p) AS neg, count(*) AS n FROM v GROUP BY 1), s AS (SELECT hotel_id, arg_min(left(name, 200), id) AS span FROM rooms WHERE review_score >= 8 AND name IS NOT NULL AND room_type_id IS NOT NULL GROUP BY 1)
SELECT a.hotel_id, pos, neg, round(greatest(0.0, (pos / n + 3.8416 / (2 * n) - 1.96 * sqrt((pos / n * (1 - pos / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 6) AS score, span FROM a LEFT JOIN s USING (hotel_id) WHERE pos >= 3""")
def voted_profiles(spark, d):
    """Profiles that three votes or more speak for, one vote a voter, with the first positive span."""
    votes = table(spark, d, "rooms").where("hotel_id is not null and review_score is not null and room_type_id is not null")
    return K.profile(votes, "hotel_id", "room_type_id", F.col("review_score") >= 8, F.substring("name", 1, 200), "id", least=3)


# Signals of a setting, the share of a place's hotels from which on it counts, for the example queries.
SIGNALS = {"SETTING_FAMILY": ("gia đình", 0.5), "SETTING_COUPLE": ("cặp đôi", 0.3), "SETTING_WORK": ("công tác", 0.5)}
_SETTINGS_SQL = " UNION ALL ".join(f"SELECT city, '{s}' AS setting, round(avg(CASE WHEN list_contains(suitable_for, '{w}') THEN 1 ELSE 0 END), 6) AS share FROM h WHERE city IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 AND avg(CASE WHEN list_contains(suitable_for, '{w}') THEN 1 ELSE 0 END) >= {t}" for s, (w, t) in SIGNALS.items())


def _settings(h: DataFrame) -> DataFrame:
    flags = {s: (V.has_any(F.col("suitable_for"), [w]), t) for s, (w, t) in SIGNALS.items()}
    return R.shares_by(h, "city", flags, 5, "setting")


@query(f"WITH h AS {H} {_SETTINGS_SQL}")
def place_settings(spark, d):
    """What a place is like by the share of its hotels with each signal, each with a threshold of its own."""
    return _settings(hotels_once(spark, d, "city", "suitable_for")).select("city", "setting", F.round("share", 6).alias("share"))


_TAGS = knowledge.ORACLE["tag_fusion"]


@query(f"""WITH t AS ({_TAGS}), h AS {H}, s AS ({_SETTINGS_SQL}), own AS (SELECT hotel_id, arg_max(concept, (confidence, -row)) AS best, string_agg(concept, '|' ORDER BY confidence DESC, concept) AS amenities FROM (SELECT *, row_number() OVER (PARTITION BY hotel_id ORDER BY concept) AS row FROM t) GROUP BY 1),
x AS (SELECT h.id, list_sort(list_distinct(list_concat(CASE WHEN list_contains(h.suitable_for, 'gia đình') THEN ['SETTING_FAMILY'] ELSE []::VARCHAR[] END, coalesce((SELECT list(setting) FROM s WHERE s.city = h.city), []::VARCHAR[])))) AS settings FROM h)
SELECT h.id AS hotel_id, own.best, coalesce(own.amenities, '') AS amenities, x.settings FROM h LEFT JOIN own ON own.hotel_id = h.id JOIN x ON x.id = h.id""")
def object_facets(spark, d):
    """The facets of objects: of a facet with one value the surest concept, of one with many all by confidence, settings of
    the object joined by those of its place."""
    tags = knowledge.tag_fusion(spark, d)
    one, many = F.min_by("concept", F.struct(-F.col("confidence"), F.col("concept"))).alias("best"), F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "concept"))).alias("all")
    own = tags.groupBy("hotel_id").agg(one, many).select("hotel_id", "best", F.array_join(F.transform("all", lambda x: x["concept"]), "|").alias("amenities"))
    h = hotels_once(spark, d, "city", "suitable_for")
    of_place = _settings(h).groupBy("city").agg(F.collect_set("setting").alias("there"))
    empty = F.array().cast("array<string>")
    mine = F.when(V.has_any(F.col("suitable_for"), ["gia đình"]), F.array(F.lit("SETTING_FAMILY"))).otherwise(empty)
    out = h.join(of_place, "city", "left").withColumnRenamed("id", "hotel_id").join(own, "hotel_id", "left")
    return out.select("hotel_id", "best", F.coalesce("amenities", F.lit("")).alias("amenities"), F.array_sort(F.array_union(mine, F.coalesce("there", empty))).alias("settings"))


# Edges that the ontology has, for the example query.
EDGES = (("Hồ bơi", "Phòng xông hơi", "related"), ("Nhà hàng", "Quầy rượu", "narrower"), ("Hồ bơi", "Hồ bơi", "related"))


@query(f"""WITH c AS ({serving.ORACLE["cooccurrence_lift"]}), r AS (SELECT src AS a, dst AS b FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b, _ in EDGES)}) t(src, dst) WHERE src <> dst)
SELECT a AS src, b AS dst, 'relation' AS source, NULL::DOUBLE AS lift FROM r UNION ALL SELECT a, b, 'cooccurrence', lift FROM c WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.a = c.a AND r.b = c.b)""")
def expansion_mining(spark, d):
    """Expansion edges of the ontology, then those that co-occurrence adds."""
    known = spark.createDataFrame(list(EDGES), "src string, dst string, relation string")
    mined = serving.cooccurrence_lift(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), "lift")
    return K.merge_edges(known, mined)


@query(f"""WITH s AS (SELECT DISTINCT id, v FROM (SELECT id, unnest(suitable_for) AS v FROM {H}) WHERE v IS NOT NULL), e AS (SELECT * FROM (VALUES ('gia đình', 'nhóm bạn'), ('cặp đôi', 'một mình')) t(src, dst))
SELECT src, dst, count(*) AS triggers, count(x.id) AS hits, count(*) - count(x.id) AS noise FROM e JOIN s ON s.v = src LEFT JOIN s x ON x.id = s.id AND x.v = dst GROUP BY 1, 2""")
def rule_audit(spark, d):
    """How often each expansion rule applies, and how often what it adds is wanted or is noise."""
    sets = hotels_once(spark, d, "suitable_for").select("id", F.explode(F.array_distinct("suitable_for")).alias("concept")).where("concept is not null")
    rules = spark.createDataFrame([("gia đình", "nhóm bạn"), ("cặp đôi", "một mình")], "src string, dst string")
    return K.audit_rules(rules, sets, sets, "id", "concept")


@query("""SELECT event_id, CASE WHEN event_type LIKE 'sign%' OR event_type LIKE 'pur%' THEN CASE WHEN event_id % 3 = 0 THEN 'out_of_scope' ELSE 'router_needed' END WHEN event_id % 3 = 0 THEN 'out_of_scope' WHEN event_id % 5 = 0 THEN 'parser_miss' WHEN event_id % 7 = 0 THEN 'expansion_risk' ELSE 'ok' END AS class FROM events""")
def request_classes(spark, d):
    """Requests by what became of them, in five classes; here sets of concepts made from the events' ids."""
    i, none = F.col("event_id"), F.array().cast("array<string>")
    some = lambda when, *c: F.when(when, F.array(*map(F.lit, c))).otherwise(none)
    expected = F.when(i % 3 == 0, F.array(F.lit("ASPECT_CLEAN"))).otherwise(F.array(F.lit("AMEN_POOL")))
    parsed = F.array_union(some(i % 5 != 0, "AMEN_POOL"), some(i % 7 == 0, "AMEN_BAR"))
    return table(spark, d, "events").select("event_id", K.request_class(F.col("event_type"), expected, parsed, none, none, ("sign", "pur")).alias("class"))


@query("""WITH n AS (SELECT DISTINCT id, lower(trim(name, ' ')) AS name, type FROM nearby_places WHERE trim(name, ' ') <> ''), l AS (SELECT CAST(landmark_id AS VARCHAR) AS i, lower(trim(name, ' ')) AS name, landmark_type AS type FROM landmarks),
a AS (SELECT name, type, min(i) AS i FROM l GROUP BY 1, 2)
SELECT n.id, coalesce(a.i, 'PLACE_' || left(sha1(n.name || '|' || coalesce(n.type, '')), 12)) AS place_id, a.i IS NULL AS fresh FROM n LEFT JOIN a ON a.name = n.name AND a.type = n.type""")
def registry_append(spark, d):
    """Places with the id the registry has, or a new one that their name and type fix for good."""
    n = table(spark, d, "nearby_places").where(F.trim("name") != "").select("id", F.lower(F.trim("name")).alias("name"), "type").distinct()
    known = table(spark, d, "landmarks").select(F.lower(F.trim("name")).alias("name"), F.col("landmark_type").alias("type"), F.col("landmark_id").cast("string").alias("place_id"))
    proposed = F.concat(F.lit("PLACE_"), X.short_hash(F.concat(F.col("name"), F.lit("|"), F.coalesce("type", F.lit(""))), 12))
    return R.register(n, known, [["name", "type"]], "place_id", proposed).select("id", "place_id", "fresh")


@query(f"""WITH h AS {H} SELECT 'country' AS kind, country AS name, NULL AS parent, count(*) AS n FROM h WHERE country IS NOT NULL GROUP BY 2
UNION ALL SELECT 'city', city, country, count(*) FROM h WHERE country IS NOT NULL AND city IS NOT NULL GROUP BY 2, 3 UNION ALL SELECT 'area', area, country || ' / ' || city, count(*) FROM h WHERE country IS NOT NULL AND city IS NOT NULL AND area IS NOT NULL GROUP BY 2, 3""")
def place_tree(spark, d):
    """Countries, their cities and the cities' areas, each with its parent and its hotels, in one aggregation."""
    h = hotels_once(spark, d, "country", "city", "area").where("country is not null")
    g = h.rollup("country", "city", "area").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "country").when(F.col("g") == 1, "city").when(F.col("g") == 0, "area")
    named = g.where("g = 3 or (g = 1 and city is not null) or (g = 0 and city is not null and area is not null)")
    return named.select(kind.alias("kind"), F.when(F.col("g") == 3, F.col("country")).when(F.col("g") == 1, F.col("city")).otherwise(F.col("area")).alias("name"), F.when(F.col("g") == 1, F.col("country")).when(F.col("g") == 0, F.concat_ws(" / ", "country", "city")).alias("parent"), "n")


@query(f"""WITH c AS ({serving.ORACLE["context_package"]}), m AS (SELECT h.id, concat_ws(' | ', h.name, h.city, CAST(h.star_rating AS VARCHAR), CAST(p.price_from AS BIGINT)) AS metadata FROM {H} h JOIN ({serving.ORACLE["price_from"]}) p ON p.id = h.id)
SELECT m.id AS hotel_id, m.metadata, c.citations, coalesce(n_chunks, 0) AS n_chunks, CAST(CASE WHEN c.hotel_id IS NULL THEN 0 ELSE greatest(1, length(context_text) // 4) END AS INTEGER) AS context_tokens, CAST(greatest(1, length(metadata) // 4) AS INTEGER) AS metadata_tokens FROM m LEFT JOIN c ON c.hotel_id = m.id""")
def context_documents(spark, d):
    """Contexts with their hotel's metadata and the tokens of both; a hotel without documents gives its metadata alone."""
    meta = hotels_once(spark, d, "name", "city", "star_rating").join(serving.price_from(spark, d), "id").select(F.col("id").alias("hotel_id"), F.concat_ws(" | ", "name", "city", F.col("star_rating").cast("string"), F.col("price_from").cast("long").cast("string")).alias("metadata"))
    out = search.with_metadata(serving.context_package(spark, d), meta, "hotel_id", "metadata")
    return out.select("hotel_id", "metadata", "citations", "n_chunks", "context_tokens", "metadata_tokens")


@query(f"""SELECT s.concept_id, s.rank, s.hotel_id, s.score, c.name, c.star, c.price_from, c.nearby FROM ({serving.ORACLE["full_hybrid_search"]}) s JOIN ({serving.ORACLE["hotel_cards"]}) c ON c.hotel_id = s.hotel_id""")
def ranked_cards(spark, d):
    """Cards of the hotels that a search has found, with rank and score."""
    found = serving.full_hybrid_search(spark, d).select("concept_id", "hotel_id", "score", "rank")
    return found.join(serving.hotel_cards(spark, d), "hotel_id").select("concept_id", "rank", "hotel_id", "score", "name", "star", "price_from", "nearby")


@query(f"""WITH {knowledge._OBJECTS_SQL}, q AS (SELECT hotel_id, CAST(avg(review_score) / 10 AS DOUBLE) AS quiet, CAST(min(price) AS DOUBLE) AS price FROM rooms WHERE hotel_id IS NOT NULL GROUP BY 1),
f AS (SELECT o.id, CAST(len(list_intersect(concepts, ['AMEN_GYM', 'AMEN_BAR'])) AS INTEGER) AS n_soft, CAST(len(list_intersect(concepts, ['AMEN_PLAYGROUND', 'AMEN_KITCHEN'])) AS INTEGER) AS n_purpose, round(coalesce(quiet, 0), 6) AS feel, CASE WHEN price > 0 THEN abs(price - 1500000) ELSE 1e12 END AS price_gap, o.review_score AS rating
 FROM o JOIN h ON h.id = o.id LEFT JOIN q ON q.hotel_id = o.id WHERE list_contains(concepts, 'AMEN_POOL') AND coalesce(quiet, 0) >= 0.6 AND contains(replace(strip_accents(lower(concat_ws(' ', h.city, h.area))), 'đ', 'd'), 'a') AND o.star >= 2 AND o.review_score >= 6 AND h.accommodation_type IN ('Resort', 'Khách sạn', 'Căn hộ'))
SELECT *, CAST(row_number() OVER (ORDER BY n_soft DESC, n_purpose DESC, feel DESC, price_gap, rating DESC NULLS LAST, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 15""")
def object_search(spark, d):
    """Objects by required concepts, kind, place, stars and score, ranked by preferred concepts, evidence of the purpose, feel,
    distance from a price and score."""
    q = table(spark, d, "rooms").where("hotel_id is not null").groupBy(F.col("hotel_id").alias("id")).agg((F.avg("review_score").cast("double") / 10).alias("q"), F.min("price").cast("double").alias("price"))
    more = hotels_once(spark, d, "city", "area", "accommodation_type").select("id", F.concat_ws(" ", "city", "area").alias("where"), F.col("accommodation_type").alias("kind"))
    objects = knowledge._objects(spark, d).join(more, "id").join(q, "id", "left").withColumn("scores", F.create_map(F.lit("STYLE_GOOD"), F.coalesce("q", F.lit(0.0))))
    wanted = K.Wanted(hard=["AMEN_POOL", "AMEN_UNKNOWN"], soft=["AMEN_GYM", "AMEN_BAR"], feel=["STYLE_GOOD"], kinds=["Resort", "Khách sạn", "Căn hộ"], evidence=["AMEN_PLAYGROUND", "AMEN_KITCHEN"], place="a", star=2, score=6, price=1_500_000)
    return K.object_search(objects, "id", wanted, size=15)


@query(f"""WITH a AS ({{activities}}) SELECT h.id AS hotel_id, coalesce(a.activities, '') AS activities, coalesce(array_to_string(h.policy_notes, '|'), '') AS policies, coalesce(array_to_string(h.amenities, '|'), '') AS amenities FROM {H} h LEFT JOIN a ON a.hotel_id = h.id""".replace("{activities}", "SELECT hotel_id, string_agg(coalesce(title, ''), '|' ORDER BY id) AS activities FROM (SELECT DISTINCT id, hotel_id, title FROM activities WHERE hotel_id IS NOT NULL AND id IS NOT NULL) GROUP BY 1"))
def merged_corpus(spark, d):
    """Activities, policies and amenities beside the hotels that are there."""
    a = table(spark, d, "activities").where("hotel_id is not null and id is not null").select("id", "hotel_id", "title").dropDuplicates(["id"])
    titles = a.groupBy(F.col("hotel_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("title", F.lit("")).alias("t")))), lambda x: x["t"]), "|").alias("activities"))
    line = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))
    return hotels_once(spark, d, "policy_notes", "amenities").join(titles, "id", "left").select(F.col("id").alias("hotel_id"), F.coalesce("activities", F.lit("")).alias("activities"), line("policy_notes").alias("policies"), line("amenities").alias("amenities"))
