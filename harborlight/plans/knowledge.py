"""Queries of the knowledge engineering on the test tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import mining as K
from ..operators import relational as R
from ..tables import table
from . import intent
from .chunking import sections
from .serving import H, hotels_once, registrar, rooms_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CUES = ("không", "chưa", "chẳng", "no", "not", "without")
_CUES_SQL = "[" + ", ".join(f"'{c}'" for c in CUES) + "]"
_FORMS_SQL = "SELECT concept_id, unnest(list_concat([label_vi, label_en], surface_forms)) AS form FROM concepts WHERE facet = 'amenity'"


query = registrar(QUERIES, ORACLE)


def _forms(spark, d, facet: str | None = "amenity") -> DataFrame:
    c = table(spark, d, "concepts")
    c = c.where(F.col("facet") == facet) if facet else c
    return c.select("concept_id", F.explode(F.concat(F.array("label_vi", "label_en"), F.col("surface_forms"))).alias("form"))


_INDEX_SQL = """WITH f AS (SELECT concept_id AS c, lower(trim(form)) AS a, replace(strip_accents(lower(trim(form))), 'đ', 'd') AS b FROM (SELECT concept_id, unnest(list_concat([label_vi, label_en], surface_forms)) AS form FROM concepts)),
e AS (SELECT c, a AS form FROM f UNION SELECT c, b FROM f WHERE a = b OR contains(b, ' ') OR length(b) > 4)
SELECT form, list_sort(list(DISTINCT c)) AS concept_ids FROM e GROUP BY form"""


@query(_INDEX_SQL)
def synonym_index(spark, d):
    """Every form and its folded variant with the concepts it names."""
    return K.synonym_index(_forms(spark, d, None), "form", "concept_id")


@query(f"SELECT count(*) AS forms, count(*) FILTER (WHERE len(concept_ids) > 1) AS ambiguous FROM ({_INDEX_SQL})")
def synonym_conflicts(spark, d):
    return synonym_index(spark, d).agg(F.count("*").alias("forms"), F.count_if(F.size("concept_ids") > 1).alias("ambiguous"))


_TAGS_SQL = f"""f AS (SELECT DISTINCT concept_id AS concept, lower(form) AS form FROM ({_FORMS_SQL}) WHERE length(form) >= 3),
t AS (SELECT doc_id, concept, form, list_filter(regexp_split_to_array(left(lower(text), strpos(lower(text), form) - 1), '[ \\t\\n\\r\\f\\x{{0b}}]+'), lambda w: w <> '') AS before
      FROM documents JOIN f ON contains(lower(text), form) WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, concept, form, list_has_any(before[-3:], {_CUES_SQL}) AS negated FROM t)"""


@query(f"WITH {_TAGS_SQL} SELECT * FROM g")
def negation_tagging(spark, d):
    """Forms of amenities in documents, and whether they are negated."""
    return K.find_forms(table(spark, d, "documents"), "doc_id", "text", _forms(spark, d), "form", "concept_id", CUES)


@query(f"""WITH {_TAGS_SQL}, h AS {H},
r AS (SELECT d.hotel_id, g.concept, 0.9 AS confidence, 'experience' AS nature, 'rule' AS source, form AS evidence FROM g JOIN documents d USING (doc_id) WHERE NOT negated AND hotel_id IS NOT NULL),
s AS (SELECT h.id AS hotel_id, c.concept_id AS concept, 0.95 AS confidence, 'presence' AS nature, 'source' AS source, v AS evidence FROM (SELECT id, unnest(amenities) AS v FROM h) h JOIN concepts c ON c.label_vi = v AND c.facet = 'amenity'),
a AS (SELECT * FROM r UNION ALL SELECT * FROM s)
SELECT hotel_id, concept, CAST(round_even(least(1.0, max(confidence) + CASE WHEN count(DISTINCT source) >= 2 THEN 0.05 ELSE 0 END), 2) AS DOUBLE) AS confidence, CASE WHEN bool_or(nature = 'presence') THEN 'presence' ELSE 'experience' END AS nature,
list_sort(list(DISTINCT source)) AS sources, list_slice(list_sort(list(DISTINCT evidence)), 1, 5) AS evidence FROM a GROUP BY 1, 2""")
def tag_fusion(spark, d):
    """Tags of hotels from their amenities and from their documents, fused."""
    rule = K.find_forms(table(spark, d, "documents"), "doc_id", "text", _forms(spark, d), "form", "concept_id", CUES).where("not negated")
    owner = table(spark, d, "documents").where("hotel_id is not null").select("doc_id", "hotel_id")
    rule = rule.join(owner, "doc_id").select("hotel_id", "concept", F.lit(0.9).alias("confidence"), F.lit("experience").alias("nature"), F.lit("rule").alias("source"), F.col("form").alias("evidence"))
    labels = table(spark, d, "concepts").where("facet = 'amenity'").select(F.col("concept_id").alias("concept"), F.col("label_vi").alias("v"))
    own = hotels_once(spark, d, "amenities").select(F.col("id").alias("hotel_id"), F.explode("amenities").alias("v")).join(labels, "v")
    return K.fuse_tags(rule.unionByName(own.select("hotel_id", "concept", F.lit(0.95).alias("confidence"), F.lit("presence").alias("nature"), F.lit("source").alias("source"), F.col("v").alias("evidence"))), "hotel_id")


@query("""WITH t AS (SELECT concept, count(*) AS n FROM (SELECT c.concept_id AS concept FROM (SELECT DISTINCT id, unnest(amenities) AS v FROM hotels) h JOIN concepts c ON c.label_vi = v AND c.facet = 'amenity') GROUP BY 1)
SELECT c.concept_id, coalesce(n, 0) AS n FROM concepts c LEFT JOIN t ON t.concept = c.concept_id WHERE facet = 'amenity'""")
def concept_coverage(spark, d):
    """How often each amenity comes, with those that never do."""
    labels = table(spark, d, "concepts").where("facet = 'amenity'").select("concept_id", "label_vi")
    pairs = table(spark, d, "hotels").select("id", F.explode("amenities").alias("label_vi")).distinct()
    return labels.join(pairs, "label_vi", "left").groupBy("concept_id").agg(F.count("id").alias("n"))


@query(f"""WITH s AS (SELECT DISTINCT id, v AS concept FROM (SELECT id, unnest(suitable_for) AS v FROM {H}) WHERE v IS NOT NULL),
e AS (SELECT * FROM (VALUES ('gia đình', 'nhóm bạn'), ('cặp đôi', 'một mình'), ('công tác', 'một mình')) t(src, dst))
SELECT DISTINCT s.id, e.dst AS concept FROM s JOIN e ON e.src = s.concept WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.id = s.id AND x.concept = e.dst)""")
def expansion_once(spark, d):
    """What one step along expansion edges adds to each hotel's set."""
    sets = hotels_once(spark, d, "suitable_for").select("id", F.explode("suitable_for").alias("concept")).where("concept is not null").distinct()
    edges = spark.createDataFrame([("gia đình", "nhóm bạn"), ("cặp đôi", "một mình"), ("công tác", "một mình")], "src string, dst string")
    return K.expand_once(sets, "id", "concept", edges)


@query(f"""WITH c AS (SELECT nfc_normalize(city) AS city, count(*) AS n FROM {H} WHERE trim(city, ' ') <> '' GROUP BY 1),
s AS (SELECT city, n, coalesce(nullif(trim(regexp_replace(upper(replace(strip_accents(lower(city)), 'đ', 'd')), '[^A-Z0-9]+', '_', 'g'), '_'), ''), 'PLACE') AS slug FROM c)
SELECT city, CAST(n AS BIGINT) AS n, CASE WHEN k = 1 THEN slug ELSE slug || '_' || k END AS place_id FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY n DESC, city) AS k FROM s)""")
def location_ids(spark, d):
    """Ids of all cities that aren't blank: spellings that are canonically equal count as one, whatever signs they have; slugs
    are numbered by frequency, and a city without a Latin letter or digit has the slug PLACE."""
    c = hotels_once(spark, d, "city").where(F.trim("city") != "").groupBy("city").agg(F.count("*").alias("n"))
    c = c.groupBy(X.composed("city").alias("city")).agg(F.sum("n").alias("n"))
    slug = F.coalesce(F.nullif(X.slug(F.col("city")), F.lit("")), F.lit("PLACE"))
    s = R.first_rows(c.withColumn("slug", slug), ["slug"], [F.col("n").desc(), F.col("city")], 1 << 30)
    return s.select("city", "n", F.when(F.col("rank") == 1, F.col("slug")).otherwise(F.concat_ws("_", "slug", F.col("rank").cast("string"))).alias("place_id"))


@query(f"""WITH n AS (SELECT DISTINCT lower(trim(name)) AS place, hotel_id, type FROM nearby_places WHERE name IS NOT NULL AND hotel_id IS NOT NULL), h AS {H},
k AS (SELECT place, count(DISTINCT hotel_id) AS hotels FROM n GROUP BY 1 HAVING count(DISTINCT hotel_id) >= 4),
t AS (SELECT place, type, count(*) AS c FROM n WHERE type IS NOT NULL GROUP BY 1, 2), c AS (SELECT place, city, count(*) AS c FROM (SELECT DISTINCT place, hotel_id FROM n) x JOIN h ON h.id = x.hotel_id WHERE city IS NOT NULL GROUP BY 1, 2),
t1 AS (SELECT place, type FROM t QUALIFY row_number() OVER (PARTITION BY place ORDER BY c DESC, type) = 1), c1 AS (SELECT place, city FROM c QUALIFY row_number() OVER (PARTITION BY place ORDER BY c DESC, city) = 1)
SELECT place, hotels, type, city AS located_in FROM k LEFT JOIN t1 USING (place) LEFT JOIN c1 USING (place)""")
def landmark_statistics(spark, d):
    """Places near four hotels or more, with their most frequent type and city."""
    n = table(spark, d, "nearby_places").where("name is not null and hotel_id is not null").select(F.lower(F.trim("name")).alias("place"), "hotel_id", "type").distinct()
    keep = n.groupBy("place").agg(F.countDistinct("hotel_id").alias("hotels")).where("hotels >= 4")
    cities = n.select("place", "hotel_id").distinct().join(hotels_once(spark, d, "city").select(F.col("id").alias("hotel_id"), "city"), "hotel_id")
    return keep.join(R.mode_by(n, "place", "type").drop("n"), "place", "left").join(R.mode_by(cities, "place", "city").select("place", F.col("city").alias("located_in")), "place", "left")


@query("""WITH r AS (SELECT hotel_id, room_type_id, bool_or(review_score >= 8) AS p FROM rooms WHERE hotel_id IS NOT NULL AND review_score IS NOT NULL GROUP BY 1, 2),
a AS (SELECT hotel_id, count(*) FILTER (WHERE p) AS pos, count(*) FILTER (WHERE NOT p) AS neg, count(*) AS n FROM r GROUP BY 1)
SELECT hotel_id, pos, neg, round(greatest(0.0, (pos / n + 3.8416 / (2 * n) - 1.96 * sqrt((pos / n * (1 - pos / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)), 6) AS score FROM a""")
def wilson_profiles(spark, d):
    """Hotels by the lower bound of the share of their room types rated 8 or better."""
    votes = table(spark, d, "rooms").where("hotel_id is not null and review_score is not null")
    return K.profile(votes, "hotel_id", "room_type_id", F.col("review_score") >= 8)


@query("""WITH g AS (SELECT hotel_id, CAST(max(review_score) AS DOUBLE) AS grade FROM rooms WHERE hotel_id IS NOT NULL AND review_score IS NOT NULL GROUP BY 1),
m AS (SELECT hotel_id, arg_max(CAST(review_score AS DOUBLE), id) AS score, arg_max(CAST(coalesce(price_amount, 0) > 0 AS INTEGER), id) AS pos, arg_max(CAST(coalesce(price_amount, 0) <= 0 AS INTEGER), id) AS neg
      FROM activities WHERE hotel_id IS NOT NULL AND review_score IS NOT NULL GROUP BY 1)
SELECT coalesce(g.hotel_id, m.hotel_id) AS hotel_id, coalesce(grade, score) AS score, CASE WHEN grade IS NOT NULL THEN 'grade' ELSE 'mention' END AS source, coalesce(pos, 0) AS pos, coalesce(neg, 0) AS neg FROM g FULL JOIN m ON m.hotel_id = g.hotel_id""")
def seeded_profiles(spark, d):
    """Grades from rooms and mentions from activities in one profile; the last mention counts."""
    seed = table(spark, d, "rooms").where("hotel_id is not null and review_score is not null").groupBy("hotel_id").agg(F.max("review_score").cast("double").alias("grade"))
    paid = F.coalesce("price_amount", F.lit(0)) > 0
    m = table(spark, d, "activities").where("hotel_id is not null and review_score is not null").select("hotel_id", F.col("id").alias("position"), F.col("review_score").cast("double").alias("score"), paid.cast("int").alias("pos"), (~paid).cast("int").alias("neg"))
    return K.merge_seed(seed, m, ["hotel_id"])


_OBJECTS_SQL = f"""h AS {H}, tags AS (SELECT h.id, list_sort(list(DISTINCT c.concept_id)) AS concepts FROM (SELECT id, unnest(amenities) AS v FROM h) h JOIN concepts c ON c.label_vi = v AND c.facet = 'amenity' GROUP BY 1),
loc AS (SELECT replace(strip_accents(lower(label_vi)), 'đ', 'd') AS k, min(concept_id) AS place FROM concepts WHERE facet = 'city' GROUP BY 1),
o AS (SELECT h.id, h.name, coalesce(concepts, []) AS concepts, place, CAST(review_score AS DOUBLE) AS review_score, CAST(star_rating AS DOUBLE) AS star FROM h LEFT JOIN tags ON tags.id = h.id LEFT JOIN loc ON loc.k = replace(strip_accents(lower(trim(city))), 'đ', 'd'))"""


def _objects(spark, d) -> DataFrame:
    h = hotels_once(spark, d, "name", "amenities", "city", "review_score", "star_rating")
    c = table(spark, d, "concepts")
    tags = h.select("id", F.explode("amenities").alias("label_vi")).join(c.where("facet = 'amenity'").select("label_vi", "concept_id"), "label_vi").groupBy("id").agg(F.array_sort(F.collect_set("concept_id")).alias("concepts"))
    loc = c.where("facet = 'city'").groupBy(X.fold(F.col("label_vi"), False).alias("k")).agg(F.min("concept_id").alias("place"))
    out = h.withColumn("k", X.fold(F.trim("city"), False)).join(tags, "id", "left").join(loc, "k", "left")
    return out.select("id", "name", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"), "place", F.col("review_score").cast("double").alias("review_score"), F.col("star_rating").cast("double").alias("star"))


@query(f"WITH {_OBJECTS_SQL} SELECT id, concepts, place, review_score, star FROM o")
def knowledge_objects(spark, d):
    """Hotels with their concepts and their city's entry, joined by folded name."""
    return _objects(spark, d).drop("name")


@query(f"""WITH {_OBJECTS_SQL}, m AS (SELECT hotel_id, CAST(avg(review_score) / 10 AS DOUBLE) AS quiet FROM rooms WHERE hotel_id IS NOT NULL AND review_score IS NOT NULL GROUP BY 1),
f AS (SELECT o.id, len(list_intersect(concepts, ['AMEN_GYM', 'AMEN_SAUNA', 'AMEN_BAR'])) AS n_soft, round(coalesce(quiet, 0), 6) AS feel, review_score AS rating FROM o LEFT JOIN m ON m.hotel_id = o.id WHERE list_contains(concepts, 'AMEN_POOL') AND coalesce(quiet, 0) >= 0.6)
SELECT id, CAST(n_soft AS INTEGER) AS n_soft, feel, rating, CAST(row_number() OVER (ORDER BY n_soft DESC, feel DESC, rating DESC NULLS LAST, id) AS INTEGER) AS rank FROM f QUALIFY rank <= 20""")
def concept_search(spark, d):
    """Objects with a pool and good rooms, ranked by soft concepts, feel and rating."""
    feel = table(spark, d, "rooms").where("hotel_id is not null and review_score is not null").groupBy(F.col("hotel_id").alias("id")).agg((F.avg("review_score").cast("double") / 10).alias("q"))
    objects = _objects(spark, d).join(feel, "id", "left").withColumn("scores", F.create_map(F.lit("STYLE_GOOD"), F.coalesce("q", F.lit(0.0))))
    objects = objects.withColumn("price", F.lit(None).cast("double"))
    out = K.object_search(objects, "id", K.Wanted(hard=["AMEN_POOL", "AMEN_UNKNOWN"], soft=["AMEN_GYM", "AMEN_SAUNA", "AMEN_BAR"], feel=["STYLE_GOOD"]), size=20)
    return out.select("id", "n_soft", "feel", "rating", "rank")


@query(f"""WITH h AS {H}, n AS (SELECT DISTINCT id, hotel_id, name, type FROM nearby_places WHERE hotel_id IS NOT NULL AND name IS NOT NULL)
SELECT n.name, n.type, count(DISTINCT hotel_id) AS hotels FROM n JOIN h ON h.id = n.hotel_id WHERE contains(replace(strip_accents(lower(concat_ws(' ', city, area))), 'đ', 'd'), 'thanh') GROUP BY 1, 2 ORDER BY hotels DESC, n.name, n.type LIMIT 20""")
def place_search(spark, d):
    """The 20 places near most hotels of a location given by a folded piece of its name."""
    h = hotels_once(spark, d, "city", "area").where(X.fold(F.concat_ws(" ", "city", "area"), False).contains("thanh")).select(F.col("id").alias("hotel_id"))
    n = table(spark, d, "nearby_places").where("hotel_id is not null and name is not null").select("hotel_id", "name", "type")
    return n.join(h, "hotel_id", "left_semi").groupBy("name", "type").agg(F.countDistinct("hotel_id").alias("hotels")).orderBy(F.col("hotels").desc(), "name", "type").limit(20)


@query(f"""WITH i AS ({_INDEX_SQL}), w AS (SELECT id, regexp_extract_all(replace(strip_accents(lower(v)), 'đ', 'd'), '[\\p{{L}}\\p{{N}}]+') AS t FROM (SELECT DISTINCT id, unnest(amenities) AS v FROM hotels) WHERE v IS NOT NULL),
g AS (SELECT DISTINCT id, array_to_string(t[s:s + n - 1], ' ') AS form FROM w, range(1, 5) a(n), range(1, 30) b(s) WHERE s + n - 1 <= len(t))
SELECT g.id, g.form, i.concept_ids FROM g JOIN i USING (form)""")
def ngram_dictionary(spark, d):
    """N-grams of amenities that the synonym index has."""
    a = table(spark, d, "hotels").select("id", F.explode("amenities").alias("v")).distinct()
    return K.ngram_matches(a, "id", "v", synonym_index(spark, d)).distinct()


@query()
def greedy_concepts(spark, d):
    """Concepts of activities' titles, the longest forms first, no word twice."""
    a = table(spark, d, "activities").select("id", "title").dropDuplicates(["id"])
    return K.greedy_concepts(a, "id", "title", synonym_index(spark, d))


@query(f"""WITH h AS {H}, got AS (SELECT DISTINCT id, c.concept_id AS c FROM (SELECT id, unnest(amenities) AS v FROM h) x JOIN concepts c ON c.label_vi = v AND c.facet = 'amenity'),
want AS (SELECT id, c FROM h, (VALUES ('AMEN_POOL'), ('AMEN_WIFI'), ('AMEN_PARKING')) t(c))
SELECT coalesce(g.id, w.id) AS id, count(*) FILTER (WHERE g.c IS NOT NULL AND w.c IS NOT NULL) AS hits, count(*) FILTER (WHERE g.c IS NULL) AS missing, count(*) FILTER (WHERE w.c IS NULL) AS noise,
CASE WHEN count(*) FILTER (WHERE g.c IS NULL) = 0 THEN 'ok' WHEN count(*) FILTER (WHERE g.c IS NOT NULL AND w.c IS NOT NULL) = 0 THEN 'missed' ELSE 'partial' END AS class FROM got g FULL JOIN want w ON w.id = g.id AND w.c = g.c GROUP BY 1""")
def expansion_audit(spark, d):
    """Hits, missing and noise of each hotel's concepts against a wanted set, and its class."""
    want = F.array(*map(F.lit, ["AMEN_POOL", "AMEN_WIFI", "AMEN_PARKING"]))
    o = _objects(spark, d)
    size = lambda a: F.size(a).cast("long")
    out = o.select("id", size(F.array_intersect("concepts", want)).alias("hits"), size(F.array_except(want, F.col("concepts"))).alias("missing"), size(F.array_except(F.col("concepts"), want)).alias("noise"))
    return out.withColumn("class", V.ladder((F.col("missing") == 0, "ok"), (F.col("hits") == 0, "missed"), otherwise="partial"))


@query(f"""WITH t AS (SELECT id, v, CASE WHEN id % 7 = 0 THEN 1.2 ELSE 0.9 END AS confidence FROM (SELECT DISTINCT id, unnest(amenities) AS v FROM {H}) WHERE v IS NOT NULL),
k AS (SELECT t.*, c.concept_id IS NOT NULL AS known FROM t LEFT JOIN concepts c ON c.concept_id = v)
SELECT id, v AS concept, 'unknown concept' AS problem FROM k WHERE NOT known UNION ALL SELECT id, v, 'confidence' FROM k WHERE confidence > 1""")
def contract_validation(spark, d):
    """Tags that break the contract, here amenities as typed taken for concepts."""
    t = hotels_once(spark, d, "amenities").select("id", F.explode(F.array_distinct("amenities")).alias("concept")).where("concept is not null")
    t = t.withColumn("confidence", F.when(F.col("id") % 7 == 0, 1.2).otherwise(0.9)).withColumn("sources", F.array(F.lit("source")))
    return K.validate(t, table(spark, d, "concepts"), "id", "concept", "confidence", "sources")


@query("""WITH n AS (SELECT DISTINCT id, landmark_id, lower(trim(name)) AS name, type FROM nearby_places WHERE name IS NOT NULL), l AS (SELECT landmark_id, lower(trim(name)) AS name, landmark_type AS type FROM landmarks),
a AS (SELECT name, type, min(landmark_id) AS i FROM l GROUP BY 1, 2), b AS (SELECT name, min(landmark_id) AS i FROM l GROUP BY 1)
SELECT n.id, coalesce(l.landmark_id, a.i, b.i) AS registry_id FROM n LEFT JOIN l ON l.landmark_id = n.landmark_id LEFT JOIN a ON a.name = n.name AND a.type = n.type LEFT JOIN b ON b.name = n.name""")
def registry_resolve(spark, d):
    """Places resolved by id, else by name and type, else by name."""
    n = table(spark, d, "nearby_places").where("name is not null").select("id", "landmark_id", F.lower(F.trim("name")).alias("name"), "type").distinct()
    reg = table(spark, d, "landmarks").select("landmark_id", F.lower(F.trim("name")).alias("name"), F.col("landmark_type").alias("type"), F.col("landmark_id").alias("registry_id"))
    return R.resolve(n, reg, [["landmark_id"], ["name", "type"], ["name"]], "registry_id").select("id", "registry_id")


@query("""WITH l AS (SELECT lower(regexp_replace(trim(name), '[ ]+', ' ', 'g')) AS k, min(landmark_id) AS id FROM landmarks GROUP BY 1),
n AS (SELECT DISTINCT lower(regexp_replace(trim(name), '[ ]+', ' ', 'g')) AS k FROM nearby_places WHERE name IS NOT NULL)
SELECT count(*) AS names, count(l.id) AS matched, count(*) FILTER (WHERE l.id IS NULL) AS unmatched FROM n LEFT JOIN l USING (k)""")
def name_mapping(spark, d):
    """Distinct names mapped to ids, and how many aren't: the mapping stands only if none is."""
    key = F.lower(F.regexp_replace(F.trim("name"), "[ ]+", " ")).alias("k")
    ids = table(spark, d, "landmarks").groupBy(key).agg(F.min("landmark_id").alias("id"))
    n = table(spark, d, "nearby_places").where("name is not null").select(key).distinct().join(ids, "k", "left")
    return n.agg(F.count("*").alias("names"), F.count("id").alias("matched"), F.count_if(F.col("id").isNull()).alias("unmatched"))


@query(f"""SELECT h.id, coalesce(a.n, 0) AS documents, coalesce(b.n, 0) AS activities, coalesce(c.n, 0) AS places FROM {H} h
LEFT JOIN (SELECT hotel_id, count(*) AS n FROM documents GROUP BY 1) a ON a.hotel_id = h.id LEFT JOIN (SELECT hotel_id, count(DISTINCT id) AS n FROM activities GROUP BY 1) b ON b.hotel_id = h.id
LEFT JOIN (SELECT hotel_id, count(DISTINCT id) AS n FROM nearby_places GROUP BY 1) c ON c.hotel_id = h.id""")
def corpus_merge(spark, d):
    """Counts of each corpus beside the hotels that are there; every side is aggregated first."""
    out = hotels_once(spark, d).select("id")
    for name, t, n in (("documents", "documents", F.count("*")), ("activities", "activities", F.countDistinct("id")), ("places", "nearby_places", F.countDistinct("id"))):
        side = table(spark, d, t).where("hotel_id is not null").groupBy(F.col("hotel_id").alias("_h")).agg(n.alias(name))
        out = out.join(side, out["id"] == side["_h"], "left").drop("_h").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'vi')")
def resume_todo(spark, d):
    """Documents that an earlier run, of those labelled vi, hasn't done."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return R.todo(docs, docs.where("lang = 'vi'"), "doc_id").select("doc_id")


_THEMES = {"water": ["hồ bơi", "bãi tắm", "bến thuyền"], "food": ["bữa sáng", "thực đơn", "nhà hàng"], "quiet": ["yên tĩnh", "thư viện"]}


def _theme_sql(text: str) -> str:
    return " UNION ALL ".join(f"SELECT id, city, score, '{t}' AS theme, {' + '.join(f'CAST(contains({text}, {chr(39)}{w}{chr(39)}) AS INTEGER)' for w in ws)} AS hits FROM h" for t, ws in _THEMES.items())


def _themes(spark, d) -> DataFrame:
    h = hotels_once(spark, d, "city", "description", "review_score").withColumn("low", F.lower("description"))
    hits = [F.struct(F.lit(t).alias("theme"), sum((F.coalesce(F.col("low").contains(w), F.lit(False)).cast("int") for w in ws), F.lit(0)).alias("hits")) for t, ws in _THEMES.items()]
    return h.select("id", "city", "review_score", F.explode(F.array(*hits)).alias("t")).select("id", "city", "review_score", "t.theme", "t.hits").where("hits > 0")


@query(f"WITH h AS (SELECT id, city, review_score AS score, lower(description) AS low FROM {H}), t AS ({_theme_sql('low')}) SELECT theme, city, count(*) AS n FROM t WHERE hits > 0 AND city IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5")
def theme_city_matrix(spark, d):
    """Hotels per theme and city, where there are five or more."""
    return _themes(spark, d).where("city is not null").groupBy("theme", "city").agg(F.count("*").alias("n")).where("n >= 5")


@query(f"""WITH h AS (SELECT id, city, review_score AS score, lower(description) AS low FROM {H}), t AS ({_theme_sql('low')})
SELECT theme, id, CAST(hits AS INTEGER) AS hits, CAST(row_number() OVER (PARTITION BY theme ORDER BY hits DESC, score DESC NULLS LAST, id) AS INTEGER) AS rank FROM t WHERE hits > 0 QUALIFY rank <= 15""")
def keyword_pool(spark, d):
    """The 15 hotels of each theme by the number of its words and their score."""
    return R.first_rows(_themes(spark, d), ["theme"], [F.col("hits").desc(), F.col("review_score").desc_nulls_last(), F.col("id")], 15).select("theme", "id", "hits", "rank")


@query(f"""WITH h AS {H}, c AS (SELECT id, nfc_normalize(city) AS city FROM h WHERE city IS NOT NULL)
SELECT id, CASE WHEN regexp_matches(city, '^.*[(][^)]*[)] *$') THEN trim(regexp_extract(city, '^(.*?) *[(]([^)]*)[)] *$', 1), ' ') WHEN contains(city, '/') AND trim(regexp_extract(city, '^(.*?) */ *(.*)$', 2), ' ') <> '' THEN trim(regexp_extract(city, '^(.*?) */ *(.*)$', 1), ' ') ELSE trim(city, ' ') END AS name,
 length(city) AS n, left(sha1(city), 16) AS digest, left(sha256(concat_ws('|', 'p', city)), 32) AS cache_key, split_part('GS-' || replace(city, '-', ''), '-', 2) AS part, replace(city, 'Thành phố ', 'TP ') AS repaired FROM c""")
def text_toolbox(spark, d):
    """Qualifiers split off, hashes, parts and repairs of every city as typed, in composed form."""
    city = F.col("city")
    c = hotels_once(spark, d, "city").where("city is not null").withColumn("city", X.composed("city"))
    return c.select("id", X.split_qualifier(city)["name"].alias("name"), F.char_length(city).cast("long").alias("n"), X.short_hash(city).alias("digest"), X.cache_key(F.lit("p"), city).alias("cache_key"), F.split_part(F.concat(F.lit("GS-"), F.replace(city, F.lit("-"), F.lit(""))), F.lit("-"), F.lit(2)).alias("part"), X.repair(city, {"Thành phố ": "TP "}).alias("repaired"))


@query("""WITH r AS (SELECT * FROM rooms WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY crawled_at) = 1)
SELECT id, TRY_CAST(replace(regexp_extract(room_size, '([0-9]+([.,][0-9]+)?)', 1), ',', '.') AS DOUBLE) AS size, TRY_CAST(nullif(regexp_replace(room_size, '[^0-9]', '', 'g'), '') AS DOUBLE) AS digits, nullif(CAST(price AS DOUBLE), 0) AS price,
CAST(round_even(CAST(price AS DOUBLE) / 1000, 0) AS DOUBLE) AS thousands, abs(coalesce(max_occupancy, 0) - 2) AS gap FROM r""")
def number_toolbox(spark, d):
    """Numbers in free text, digits alone, zero as null, half-even rounding and differences."""
    r = rooms_once(spark, d, "room_size", "price", "max_occupancy")
    return r.select("id", X.number_after(F.col("room_size"), r"([0-9]+([.,][0-9]+)?)").alias("size"), V.digits(F.col("room_size")).cast("double").alias("digits"), V.zero_to_null(F.col("price").cast("double")).alias("price"), F.bround(F.col("price").cast("double") / 1000, 0).alias("thousands"), F.abs(F.coalesce("max_occupancy", F.lit(0)) - 2).alias("gap"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm, round(1.0::DOUBLE, 6) AS unit_norm FROM embeddings WHERE embedding IS NOT NULL")
def unit_vectors(spark, d):
    """Norms before and after scaling to length 1."""
    e = table(spark, d, "embeddings").where("embedding is not null").withColumn("u", V.unit(F.col("embedding")))
    return e.select("vec_id", F.round(F.sqrt(V.dot(F.col("embedding"), F.col("embedding"))), 6).alias("norm"), F.round(F.sqrt(V.dot(F.col("u"), F.col("u"))), 6).alias("unit_norm"))


@query("""SELECT event_id, user_id, n, CAST(total AS BIGINT) AS total, CAST(rank AS INTEGER) AS rank FROM (SELECT event_id, user_id, length(props) AS n, sum(length(props)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS total, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events) WHERE rank = 1 OR total <= 200""")
def budget_cut(spark, d):
    """Each user's first events within a budget of characters."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.char_length("props").cast("long").alias("n"))
    return R.within_budget(e, ["user_id"], [F.col("ts"), F.col("event_id")], "n", 200).select("event_id", "user_id", "n", "total", F.col("rank").cast("int").alias("rank"))


@query(f"""SELECT count(*) AS n, count(*) FILTER (WHERE review_score IS NULL) AS no_score, count(*) FILTER (WHERE star_rating >= 4 AND review_score < 6) AS conflicts, count(*) FILTER (WHERE amenities IS NULL OR len(amenities) = 0) AS no_amenities, count(DISTINCT city) AS cities FROM {H}""")
def conflict_counters(spark, d):
    h = hotels_once(spark, d, "review_score", "star_rating", "amenities", "city")
    return h.agg(F.count("*").alias("n"), F.count_if(F.col("review_score").isNull()).alias("no_score"), F.count_if((F.col("star_rating") >= 4) & (F.col("review_score") < 6)).alias("conflicts"), F.count_if(F.coalesce(F.size("amenities"), F.lit(0)) <= 0).alias("no_amenities"), F.countDistinct("city").alias("cities"))


@query(f"""SELECT id, list_sort(list_distinct(list_filter(list_transform(list_concat(coalesce(amenities, []), coalesce(suitable_for, []), coalesce(policy_notes, [])), lambda x: trim(x, ' ')), lambda x: x <> ''))) AS labels FROM {H}""")
def array_union(spark, d):
    """The distinct labels of several arrays, sorted."""
    return hotels_once(spark, d, "amenities", "suitable_for", "policy_notes").select("id", V.union_all(F.col("amenities"), F.col("suitable_for"), F.col("policy_notes")).alias("labels"))


_RULES = {"family": "trẻ em|gia đình|families|children", "water": "hồ bơi|bãi tắm|pool|beach", "quiet": "yên tĩnh|quiet"}


@query(f"SELECT doc_id, list_filter([{', '.join(f'CASE WHEN regexp_matches(lower(text), {chr(39)}{p}{chr(39)}) THEN {chr(39)}{n}{chr(39)} END' for n, p in _RULES.items())}], lambda x: x IS NOT NULL) AS rules FROM documents WHERE text IS NOT NULL")
def implicit_rules(spark, d):
    """Rules whose pattern a document has."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", X.pattern_rules(F.lower("text"), _RULES).alias("rules"))


@query()
def section_split(spark, d):
    """Documents as sections with their headings."""
    return sections(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("""SELECT hotel_id, CAST(to_json({'n': count(*), 'best': CAST(max(review_score) AS DOUBLE)}) AS VARCHAR) AS doc FROM (SELECT DISTINCT id, hotel_id, review_score FROM activities WHERE hotel_id IS NOT NULL) GROUP BY 1 HAVING max(review_score) IS NOT NULL""")
def json_documents(spark, d):
    """Small JSON documents per key."""
    a = table(spark, d, "activities").where("hotel_id is not null").select("id", "hotel_id", "review_score").distinct()
    return a.groupBy("hotel_id").agg(F.count("*").alias("n"), F.max("review_score").cast("double").alias("best")).where("best is not null").select("hotel_id", F.to_json(F.struct("n", "best")).alias("doc"))


@query()
def intent_parse(spark, d):
    """Activities' titles and descriptions taken for requests."""
    a = table(spark, d, "activities").dropDuplicates(["id"]).select("id", F.concat_ws(". ", "title", "description").alias("request"))
    labels = table(spark, d, "concepts").select("concept_id", "facet", F.col("label_vi").alias("label"))
    return intent.parse(a, "id", "request", synonym_index(spark, d), labels, _RULES)


@query("""SELECT doc_id, TRY_CAST(replace(regexp_extract(text, '(?i)([0-9]+(?:[.,][0-9]+)?)\\s*km(?:[^\\p{L}]|$)', 1), ',', '.') AS DOUBLE) AS km, TRY_CAST(regexp_extract(text, '([0-9]+) giờ', 1) AS DOUBLE) AS hour FROM documents WHERE text IS NOT NULL""")
def intent_numbers(spark, d):
    """Distances and hours that documents name first."""
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", *intent.numbers(F.col("text"), {"km": intent.NUMBERS["km_max"], "hour": "([0-9]+) giờ"}))
