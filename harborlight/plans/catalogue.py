"""Queries over single records, topics, requests and evaluation pools on the test tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import mining as K
from ..operators import relational as R
from ..operators import shred
from ..streaming import metrics as M
from ..tables import table
from . import chunking, intent, serving
from .serving import H, hotels_once

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
query = serving.registrar(QUERIES, ORACLE)


def _plain_sql(text: str) -> str:
    return f"replace(strip_accents(lower({text})), 'đ', 'd')"


def _any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _any(text: Column, words) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w)), F.lit(False))


@query(f"""SELECT b.concept_id, b.rank, b.doc_id, d.hotel_id, left(d.text, 200) AS snippet FROM ({serving._BM25}) b LEFT JOIN documents d ON d.doc_id = b.doc_id""")
def multi_get(spark, d):
    """Ranked ids with the fields of their documents; a document that is gone keeps its place."""
    docs = table(spark, d, "documents").select("doc_id", "hotel_id", F.substring("text", 1, 200).alias("snippet"))
    return serving.bm25_topk(spark, d).join(docs, "doc_id", "left").select("concept_id", "rank", "doc_id", "hotel_id", "snippet")


@query("""SELECT hotel_id, doc_id, source_type, CAST(row_number() OVER (PARTITION BY hotel_id ORDER BY doc_id) AS INTEGER) AS rank FROM documents WHERE hotel_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY hotel_id ORDER BY doc_id) <= 100""")
def term_scan(spark, d):
    """The first 100 documents of every hotel by id, as a term query with its size gives them."""
    docs = table(spark, d, "documents").where("hotel_id is not null").select("hotel_id", "doc_id", "source_type")
    return R.first_rows(docs, ["hotel_id"], [F.col("doc_id")], 100)


@query(f"SELECT id AS hotel_id, name, city, area, CAST(star_rating AS DOUBLE) AS star, accommodation_type, is_luxury, CAST(review_score AS DOUBLE) AS score, review_count, coalesce(array_to_string(amenities, '|'), '') AS amenities, coalesce(description, '') AS description FROM {H}")
def slim_corpus(spark, d):
    """The fields of hotels that golden labels are looked up in."""
    h = hotels_once(spark, d, "name", "city", "area", "star_rating", "accommodation_type", "is_luxury", "review_score", "review_count", "amenities", "description")
    return h.select(F.col("id").alias("hotel_id"), "name", "city", "area", F.col("star_rating").cast("double").alias("star"), "accommodation_type", "is_luxury", F.col("review_score").cast("double").alias("score"), "review_count", F.coalesce(F.array_join("amenities", "|"), F.lit("")).alias("amenities"), F.coalesce("description", F.lit("")).alias("description"))


@query("""WITH a AS (SELECT DISTINCT id, hotel_id, title, description FROM activities WHERE hotel_id IS NOT NULL AND id IS NOT NULL)
SELECT hotel_id, count(*) AS n, string_agg(coalesce(title, '') || ': ' || left(coalesce(description, ''), 80), '|' ORDER BY id) AS activities FROM a GROUP BY 1""")
def slim_activities(spark, d):
    """Titles and the beginnings of descriptions of each hotel's activities in one row, in order."""
    a = table(spark, d, "activities").where("hotel_id is not null and id is not null").select("id", "hotel_id", "title", "description").dropDuplicates(["id"])
    line = F.concat(F.coalesce("title", F.lit("")), F.lit(": "), F.substring(F.coalesce("description", F.lit("")), 1, 80))
    return a.groupBy("hotel_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("t")))), lambda x: x["t"]), "|").alias("activities"))


@query()
def slim_faq(spark, d):
    """Questions of each hotel with category and the beginning of the answer, one row a question."""
    flat = shred.entity_table(shred.adjacency(hotels_once(spark, d, "faq"), "id", ["faq"]), r"^faq\[\d+\]$", ["question", "answer", "category"])
    return flat.select(F.col("id").alias("hotel_id"), F.col("path").alias("node"), "question", F.substring("answer", 1, 200).alias("answer"), F.coalesce("category", F.lit("none")).alias("category"))


@query()
def faq_categories(spark, d):
    """How many questions each category has."""
    return slim_faq(spark, d).groupBy("category").agg(F.count("*").alias("n"))


@query("""SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(title), '[\\p{L}]+')) AS w FROM (SELECT DISTINCT id, title FROM activities WHERE id IS NOT NULL)) WHERE length(w) >= 4 GROUP BY 1""")
def title_words(spark, d):
    """Words of four letters or more in activities' titles."""
    a = table(spark, d, "activities").where("id is not null").select("id", "title").dropDuplicates(["id"])
    return a.select(F.explode(X.long_words(F.col("title"), 4)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


# Topics of policies and the words that name them, folded.
TOPICS = {"children": ("tre em", "tre duoi", "children"), "pets": ("thu nuoi", "thu cung", "pets"), "night": ("dem", "night"), "fees": ("thue va phi", "mien phi", "free", "fee")}
_TOPICS_SQL = "\nUNION ALL\n".join(f"SELECT '{t}' AS topic, count(*) AS n FROM p WHERE {_any_sql('t', ws)}" for t, ws in TOPICS.items())


@query(f"WITH p AS (SELECT {_plain_sql(chr(34) + 'x' + chr(34))} AS t FROM (SELECT array_to_string(policy_notes, chr(10)) AS x FROM {H})) {_TOPICS_SQL}")
def policy_topics(spark, d):
    """Hotels whose notes name a topic, each counted once a topic."""
    text = X.fold(F.array_join("policy_notes", "\n"), False)
    found = F.filter(F.array(*(F.when(_any(text, ws), F.lit(t)) for t, ws in TOPICS.items())), lambda x: x.isNotNull())
    counts = hotels_once(spark, d, "policy_notes").select(F.explode(found).alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))
    every = spark.createDataFrame([(t,) for t in TOPICS], "topic string")
    return every.join(counts, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT doc_id, list_sort(list_filter(t, lambda c: starts_with(c, 'AMEN_'))) AS hard, list_sort(list_filter(t, lambda c: starts_with(c, 'CITY_') OR starts_with(c, 'OBJ_'))) AS soft FROM (
SELECT d.doc_id, coalesce(list(DISTINCT c.concept_id) FILTER (WHERE c.concept_id IS NOT NULL), []) AS t FROM documents d LEFT JOIN concepts c ON contains(lower(d.text), lower(c.label_vi)) WHERE d.doc_id IS NOT NULL GROUP BY 1)""")
def concept_classes(spark, d):
    """The concepts whose label a document has, split by their prefix into those to require and those to prefer."""
    labels = table(spark, d, "concepts").select("concept_id", "label_vi")
    docs = table(spark, d, "documents").where("doc_id is not null")
    found = K.find_forms(docs, "doc_id", "text", labels, "label_vi", "concept_id").groupBy("doc_id").agg(F.array_sort(F.collect_set("concept")).alias("c"))
    out = docs.select("doc_id").join(found, "doc_id", "left").withColumn("c", F.coalesce("c", F.array().cast("array<string>")))
    return out.select("doc_id", V.with_prefix(F.col("c"), "AMEN_").alias("hard"), V.with_prefix(F.col("c"), "CITY_", "OBJ_").alias("soft"))


# Kinds of landmarks kept and names left out, for the example query.
KEPT, LEFT_OUT = ("Chợ", "Bảo tàng", "Chùa", "Công viên"), ("hạc", "bãi")


@query(f"SELECT landmark_id, name, landmark_type FROM landmarks WHERE landmark_type IN {KEPT} AND NOT {_any_sql('lower(name)', LEFT_OUT)}")
def kept_landmarks(spark, d):
    """Landmarks of the kinds in a list whose name has none of the words of another."""
    kinds = spark.createDataFrame([(k,) for k in KEPT], "landmark_type string")
    marks = table(spark, d, "landmarks").select("landmark_id", "name", "landmark_type")
    return marks.join(kinds, "landmark_type", "left_semi").where(~_any(F.lower("name"), LEFT_OUT)).select("landmark_id", "name", "landmark_type")


_PLACE_WORDS, _FUN = ("cho", "bai tam", "khu vui choi", "tham quan", "market"), ("cong vien", "cho", "bao tang")


@query(f"SELECT doc_id, {_any_sql(_plain_sql('text'), _PLACE_WORDS)} AS place_intent FROM documents WHERE text IS NOT NULL")
def place_intent(spark, d):
    """Whether a text asks for places rather than for hotels, by its words."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", _any(X.fold(F.col("text"), False), _PLACE_WORDS).alias("place_intent"))


@query(f"""WITH n AS (SELECT DISTINCT id, hotel_id, name, type FROM nearby_places WHERE hotel_id IS NOT NULL AND name IS NOT NULL), h AS {H}
SELECT n.name, min(n.type) AS type, count(DISTINCT n.hotel_id) AS hotels FROM n JOIN h ON h.id = n.hotel_id WHERE contains({_plain_sql("concat_ws(' ', h.city, h.area)")}, 'tra') AND {_any_sql(_plain_sql("coalesce(n.type, '')"), _FUN)} GROUP BY 1 ORDER BY hotels DESC, n.name LIMIT 20""")
def fun_places(spark, d):
    """The 20 places of kinds to visit near most hotels of a location."""
    h = hotels_once(spark, d, "city", "area").where(X.fold(F.concat_ws(" ", "city", "area"), False).contains("tra")).select(F.col("id").alias("hotel_id"))
    n = table(spark, d, "nearby_places").where("hotel_id is not null and name is not null").select("hotel_id", "name", "type").where(_any(X.fold(F.coalesce("type", F.lit("")), False), _FUN))
    return n.join(h, "hotel_id", "left_semi").groupBy("name").agg(F.min("type").alias("type"), F.countDistinct("hotel_id").alias("hotels")).orderBy(F.col("hotels").desc(), "name").limit(20)


@query(f"SELECT id, list_filter([CASE WHEN star_rating > 0 THEN 'star' END, CASE WHEN review_score IS NOT NULL THEN 'score' END, CASE WHEN review_count IS NOT NULL THEN 'reviews' END], lambda x: x IS NOT NULL) AS filters FROM {H}")
def range_filters(spark, d):
    """The ranges that a hotel can be filtered by: a map without its nulls, a star of 0 counting as none."""
    h = hotels_once(spark, d, "star_rating", "review_score", "review_count")
    values = F.create_map(F.lit("star"), V.zero_to_null(F.col("star_rating").cast("double")), F.lit("score"), F.col("review_score").cast("double"), F.lit("reviews"), F.col("review_count").cast("double"))
    return h.select("id", F.map_keys(V.drop_nulls(values)).alias("filters"))


# Slugs of accommodation types.
SLUGS = {"Khách sạn": "hotel", "Căn hộ": "apartment", "Homestay": "homestay", "Biệt thự": "villa", "Nhà nghỉ": "motel", "Resort": "resort", "Hostel": "hostel"}


@query(f"""WITH h AS {H}, r AS (SELECT hotel_id, CAST(min(price) FILTER (WHERE price > 0) AS DOUBLE) AS least FROM rooms WHERE hotel_id IS NOT NULL GROUP BY 1),
n AS (SELECT DISTINCT id, hotel_id, name, distance_km FROM nearby_places WHERE hotel_id IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY hotel_id ORDER BY distance_km NULLS LAST, id) AS k FROM n QUALIFY k <= 10),
m AS (SELECT hotel_id, string_agg(coalesce(name, ''), '|' ORDER BY k) AS landmarks FROM t GROUP BY 1)
SELECT h.id, CASE accommodation_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in SLUGS.items())} ELSE 'hotel' END AS object_type, nullif(CAST(star_rating AS DOUBLE), 0) AS star, r.least AS price_min, coalesce(m.landmarks, '') AS landmarks FROM h LEFT JOIN r ON r.hotel_id = h.id LEFT JOIN m ON m.hotel_id = h.id""")
def hotel_metadata(spark, d):
    """Type by slug with a default, star without 0, least positive price, the ten nearest places, those of unknown distance last."""
    h = hotels_once(spark, d, "accommodation_type", "star_rating")
    low = table(spark, d, "rooms").where("hotel_id is not null").groupBy(F.col("hotel_id").alias("id")).agg(F.min(F.when(F.col("price") > 0, F.col("price"))).cast("double").alias("price_min"))
    n = table(spark, d, "nearby_places").where("hotel_id is not null").select("id", "hotel_id", "name", "distance_km").dropDuplicates(["id"])
    top = R.first_rows(n, ["hotel_id"], [F.col("distance_km").asc_nulls_last(), F.col("id")], 10).groupBy(F.col("hotel_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("name", F.lit("")).alias("name")))), lambda x: x["name"]), "|").alias("landmarks"))
    out = h.join(low, "id", "left").join(top, "id", "left")
    return out.select("id", V.lookup(F.col("accommodation_type"), SLUGS, "hotel").alias("object_type"), V.zero_to_null(F.col("star_rating").cast("double")).alias("star"), "price_min", F.coalesce("landmarks", F.lit("")).alias("landmarks"))


@query("""WITH e AS (SELECT event_type, ts FROM events WHERE ts IS NOT NULL), w AS (SELECT event_type, time_bucket(INTERVAL '15 seconds', ts) - INTERVAL '15 seconds' * i AS window_start FROM e, range(20) t(i))
SELECT window_start, event_type, count(*) AS n, round(count(*) / 300, 6) AS per_second FROM w GROUP BY 1, 2""")
def rate_sliding(spark, d):
    """Events per second in windows of five minutes that begin every 15 seconds."""
    return M.rate(table(spark, d, "events"), "ts", ["event_type"], slide="15 seconds")


_B = (0.0, *serving._BOUNDS)


@query(f"""WITH b AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, {", ".join(f"count(*) FILTER (WHERE value <= {b}) AS c{i + 1}" for i, b in enumerate(serving._BOUNDS))}, 0 AS c0, count(value) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)
SELECT window_start, event_type, round(CASE WHEN n = 0 THEN NULL {" ".join(f"WHEN c{i} >= 0.95 * n THEN CASE WHEN c{i} = c{i - 1} THEN {_B[i]} ELSE {_B[i - 1]} + ({_B[i]} - {_B[i - 1]}) * (0.95 * n - c{i - 1}) / (c{i} - c{i - 1}) END" for i in range(1, len(_B)))} ELSE {_B[-1]} END, 6) AS p95 FROM b""")
def p95_5m(spark, d):
    """The 95th percentile within buckets, of every window of five minutes."""
    e = table(spark, d, "events").where("ts is not null").withColumn("window_start", F.window("ts", "5 minutes")["start"])
    return M.bucket_quantile(e, ["window_start", "event_type"], "value", serving._BOUNDS, 0.95, "p95")


_MONEY_SQL = "TRY_CAST(replace(regexp_extract({t}, '(?i)(dưới|tối đa|không quá|trên|từ|khoảng|tầm) *([0-9]+(?:[.,][0-9]+)?) *(triệu|tr|nghìn|k)([^\\p{{L}}]|$)', {g}), ',', '.') AS DOUBLE)"


@query(r"""WITH r AS (SELECT DISTINCT id, concat_ws('. ', title, 'Giá ' || CASE id % 4 WHEN 0 THEN 'dưới ' WHEN 1 THEN 'trên ' WHEN 2 THEN 'khoảng ' ELSE '' END || (id % 9 + 1) || CASE id % 3 WHEN 0 THEN ' triệu' WHEN 1 THEN '00k' ELSE 'tr' END || ', ' || (id % 5 + 1) || ' sao, trên ' || (id % 10) || ' điểm') AS request FROM activities WHERE id IS NOT NULL),
n AS (SELECT id, id % 4 AS k, CASE id % 3 WHEN 1 THEN (id % 9 + 1) * 100000.0::DOUBLE ELSE (id % 9 + 1) * 1000000.0::DOUBLE END AS x FROM r)
SELECT id, CASE k WHEN 1 THEN x WHEN 2 THEN x * 0.7 END AS price_min, CASE k WHEN 0 THEN x WHEN 2 THEN x * 1.3 END AS price_max, CAST(id % 5 + 1 AS DOUBLE) AS star_min, CAST(id % 10 AS DOUBLE) AS review_min FROM n""")
def intent_ranges(spark, d):
    """Prices with their units, stars and scores that requests name, here activities' titles with a request appended."""
    i = F.col("id")
    unit = F.when(i % 3 == 0, " triệu").when(i % 3 == 1, "00k").otherwise("tr")
    cue = F.when(i % 4 == 0, "dưới ").when(i % 4 == 1, "trên ").when(i % 4 == 2, "khoảng ").otherwise("")
    asked = F.concat_ws(". ", "title", F.concat(F.lit("Giá "), cue, (i % 9 + 1).cast("string"), unit, F.lit(", "), (i % 5 + 1).cast("string"), F.lit(" sao, trên "), (i % 10).cast("string"), F.lit(" điểm")))
    a = table(spark, d, "activities").where("id is not null").select("id", "title").dropDuplicates(["id"]).select("id", asked.alias("request"))
    return a.select("id", *intent.prices(F.col("request")), *intent.numbers(F.col("request"), {k: intent.NUMBERS[k] for k in ("star_min", "review_min")}))


@query(f"""SELECT id, list_filter(['AMEN_POOL', CASE WHEN contains(lower(coalesce(title, '')), 'trọn ngày') AND NOT regexp_matches(lower('ngân sách ' || id || ' triệu'), '(budget|ngân sách)[^0-9]{{0,6}}[0-9.,]+ *(triệu|tr|k|nghìn|đồng)') THEN 'PRICE_BUDGET' END], lambda x: x IS NOT NULL) AS concepts FROM (SELECT DISTINCT id, title FROM activities WHERE id IS NOT NULL)""")
def budget_suppression(spark, d):
    """A budget that is named with a sum of money is a range, not a wish for something cheap."""
    a = table(spark, d, "activities").where("id is not null").select("id", "title").dropDuplicates(["id"])
    found = F.filter(F.array(F.lit("AMEN_POOL"), F.when(F.lower(F.coalesce("title", F.lit(""))).contains("trọn ngày"), F.lit("PRICE_BUDGET"))), lambda x: x.isNotNull())
    return a.select("id", intent.without_budget(found, F.concat(F.lit("ngân sách "), F.col("id").cast("string"), F.lit(" triệu"))).alias("concepts"))


_PLAIN_REQUEST = f"regexp_replace({_plain_sql('request')}, '[ \\t\\n\\r\\f\\x{{0b}}]+', ' ', 'g')"
_SAID = ("nhà tôi có 2 con", "hai vợ chồng đi nghỉ", "nhom 6 nguoi di choi", "đi công tác vài ngày", "cần nghỉ ngơi, xả stress", "có hồ bơi")


@query(f"""WITH r AS (SELECT DISTINCT id, concat_ws('. ', title, [{', '.join(f"'{x}'" for x in _SAID)}][id % 6 + 1]) AS request FROM activities WHERE id IS NOT NULL), p AS (SELECT id, {_PLAIN_REQUEST} AS t FROM r)
{' UNION ALL '.join(f"SELECT id, '{k}' AS purpose, trim(regexp_extract(t, '{p}', 0), ' ') AS evidence FROM p WHERE trim(regexp_extract(t, '{p}', 0), ' ') <> ''" for k, p in intent.PURPOSES.items())}""")
def purpose_rules(spark, d):
    """Purposes that requests speak of without naming them, with the words that say so; here titles with a request appended."""
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("id") % 6 + 1).cast("int"))
    a = table(spark, d, "activities").where("id is not null").select("id", "title").dropDuplicates(["id"])
    return a.select("id", F.explode(intent.purposes(F.concat_ws(". ", "title", said))).alias("purpose", "evidence"))


_POOLS = {"desc": ("description", ("yên tĩnh", "hồ bơi")), "pol": ("array_join(policy_notes, ' ')", ("trẻ", "mèo", "đêm")), "amen": ("array_join(amenities, ' ')", ("hồ bơi", "wifi"))}
_POOLS_SQL = " UNION ALL ".join(f"SELECT '{p}' AS pool, id, score, {' + '.join(f'CAST(contains(lower(coalesce({x}, {chr(39)*2})), {chr(39)}{w}{chr(39)}) AS INTEGER)' for w in ws)} AS hits FROM h" for p, (x, ws) in {"desc": ("description", _POOLS["desc"][1]), "pol": ("array_to_string(policy_notes, ' ')", _POOLS["pol"][1]), "amen": ("array_to_string(amenities, ' ')", _POOLS["amen"][1])}.items())


@query(f"""WITH h AS (SELECT *, review_score AS score FROM {H}), a AS (SELECT hotel_id AS id, count(DISTINCT id) AS hits FROM activities WHERE contains(lower(title), 'đi bộ') AND hotel_id IS NOT NULL GROUP BY 1),
t AS ({_POOLS_SQL} UNION ALL SELECT 'act', h.id, score, a.hits FROM h JOIN a ON a.id = h.id),
k AS (SELECT pool, id, hits, row_number() OVER (PARTITION BY pool ORDER BY hits DESC, score DESC NULLS LAST, id) AS rank FROM t WHERE hits > 0 QUALIFY rank <= 14),
old AS (SELECT p.pool, h.id, row_number() OVER (PARTITION BY p.pool ORDER BY h.id) AS rank FROM (SELECT DISTINCT pool FROM t) p, (SELECT id FROM {H} ORDER BY id LIMIT 3) h),
u AS (SELECT pool, id, min(o * 1000 + rank) AS r FROM (SELECT pool, id, 0 AS o, rank FROM old UNION ALL SELECT pool, id, 1, rank FROM k) GROUP BY 1, 2)
SELECT pool, id, CAST(row_number() OVER (PARTITION BY pool ORDER BY r, id) AS INTEGER) AS rank FROM u QUALIFY rank <= 15""")
def golden_pools(spark, d):
    """Candidates of four kinds (words of descriptions, policies and amenities, matching activities), behind the labels that
    were there, 15 a pool."""
    h = hotels_once(spark, d, "review_score", "description", "policy_notes", "amenities")
    n = lambda text, words: sum((F.coalesce(F.lower(F.expr(text)).contains(w), F.lit(False)).cast("int") for w in words), F.lit(0))
    hits = F.array(*(F.struct(F.lit(p).alias("pool"), n(t, ws).cast("long").alias("hits")) for p, (t, ws) in _POOLS.items()))
    found = h.select("id", "review_score", F.explode(hits).alias("p")).select("p.pool", "id", "review_score", "p.hits").where("hits > 0")
    acts = table(spark, d, "activities").where(F.lower("title").contains("đi bộ") & F.col("hotel_id").isNotNull()).groupBy(F.col("hotel_id").alias("id")).agg(F.countDistinct("id").alias("hits"))
    found = found.unionByName(h.join(acts, "id").select(F.lit("act").alias("pool"), "id", "review_score", "hits"))
    new = R.first_rows(found, ["pool"], [F.col("hits").desc(), F.col("review_score").desc_nulls_last(), F.col("id")], 14)
    labels = h.select("id").orderBy("id").limit(3).select("id", F.explode(F.array(*map(F.lit, [*_POOLS, "act"]))).alias("pool"))
    old = R.first_rows(labels, ["pool"], [F.col("id")], 3)
    return R.union_keep_order([old, new], "pool", "id", "rank", 15)


@query(f"""WITH c AS (SELECT doc_id AS chunk_id, hotel_id, row_number() OVER (PARTITION BY hotel_id ORDER BY length(text) DESC, doc_id) AS rank FROM documents WHERE hotel_id IS NOT NULL AND text IS NOT NULL),
rel AS (SELECT doc_id AS chunk_id, hotel_id FROM documents WHERE hotel_id IS NOT NULL AND doc_id % 10 = 0)
SELECT r.hotel_id, round(count(c.chunk_id) / count(*), 6) AS chunk_recall, round(count(*) FILTER (WHERE c.rank <= 3) / count(*), 6) AS citation_coverage FROM rel r LEFT JOIN (SELECT * FROM c WHERE rank <= 10) c ON c.chunk_id = r.chunk_id GROUP BY 1""")
def chunk_metrics(spark, d):
    """The share of each hotel's relevant documents among the ten that are found and among the three that are cited."""
    docs = table(spark, d, "documents").where("hotel_id is not null")
    found = R.first_rows(docs.where("text is not null").select("hotel_id", "doc_id", F.char_length("text").alias("n")), ["hotel_id"], [F.col("n").desc(), F.col("doc_id")], 10)
    relevant = docs.where("doc_id % 10 = 0").select("hotel_id", "doc_id")
    met = relevant.join(found.select("hotel_id", "doc_id", "rank"), ["hotel_id", "doc_id"], "left").groupBy("hotel_id")
    return met.agg(F.round(F.count("rank") / F.count("*"), 6).alias("chunk_recall"), F.round(F.count_if(F.col("rank") <= 3) / F.count("*"), 6).alias("citation_coverage"))


@query(f"""WITH h AS {H} SELECT d AS dimension, v AS value, count(*) AS n FROM (
SELECT 'accommodation_type' AS d, accommodation_type AS v FROM h UNION ALL SELECT 'country', country FROM h UNION ALL SELECT 'star_rating', CAST(star_rating AS VARCHAR) FROM h UNION ALL SELECT 'is_luxury', CAST(is_luxury AS VARCHAR) FROM h
UNION ALL SELECT 'description_lang', description_lang FROM h UNION ALL SELECT 'city', city FROM h UNION ALL SELECT 'amenities', unnest(list_distinct(amenities)) FROM h UNION ALL SELECT 'suitable_for', unnest(list_distinct(suitable_for)) FROM h UNION ALL SELECT 'policy_notes', unnest(list_distinct(policy_notes)) FROM h) WHERE v IS NOT NULL GROUP BY 1, 2""")
def freq_all(spark, d):
    """Frequencies of nine dimensions in one pass."""
    scalars, arrays = ["accommodation_type", "country", "star_rating", "is_luxury", "description_lang", "city"], ["amenities", "suitable_for", "policy_notes"]
    return R.frequencies(hotels_once(spark, d, *scalars, *arrays), scalars, arrays)
