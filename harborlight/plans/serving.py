"""Queries of the serving store, retrieval and evaluation on the test tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..operators import relational as R
from ..operators import shred
from ..streaming import metrics as M
from ..tables import table
from . import chunking, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: One row per hotel, the first delivered; the same in SQL.
H = "(SELECT * FROM hotels WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY crawled_at) = 1)"
RM = "(SELECT * FROM rooms WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY crawled_at) = 1)"


def registrar(queries: dict, oracle: dict) -> Callable:
    """A decorator that enters a query, and its SQL if it has one, under the function's name."""

    def query(sql: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return register

    return query


query = registrar(QUERIES, ORACLE)


def hotels_once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.first_wins(table(spark, d, "hotels").where("id is not null").select("id", *columns, "crawled_at"), ["id"], ["crawled_at"])


def rooms_once(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return R.first_wins(table(spark, d, "rooms").where("id is not null").select("id", *columns, "crawled_at"), ["id"], ["crawled_at"])


@query(f"""SELECT h.id FROM {H} h WHERE h.country = 'Việt Nam' AND h.accommodation_type IN ('Khách sạn', 'Resort', 'Homestay')
AND h.star_rating >= 3 AND h.star_rating <= 4.5 AND h.review_score >= 7 AND list_has_any(h.suitable_for, ['gia đình', 'cặp đôi'])
AND EXISTS (SELECT 1 FROM rooms r WHERE r.hotel_id = h.id AND r.price BETWEEN 300000 AND 2000000)""")
def prefilter_whitelist(spark, d):
    """Equality, list, ranges, overlap and a children's range in one whitelist."""
    where = R.condition({"country": "Việt Nam"}, {"accommodation_type": ["Khách sạn", "Resort", "Homestay"]}, {"star_rating": R.Range(3, 4.5), "review_score": R.Range(7)}, {"suitable_for": ["gia đình", "cặp đôi"]})
    h = hotels_once(spark, d, "country", "accommodation_type", "star_rating", "review_score", "suitable_for")
    return R.whitelist(h, "id", where, table(spark, d, "rooms"), "hotel_id", F.col("price").between(300000, 2000000))


@query(f"SELECT id, list_has_any(amenities, ['Hồ bơi', 'Phòng xông hơi']) AS any_of, list_has_all(amenities, ['Hồ bơi', 'Bãi đỗ xe']) AS all_of FROM {H} WHERE amenities IS NOT NULL")
def array_membership(spark, d):
    """Any and all of some amenities."""
    h = hotels_once(spark, d, "amenities").where("amenities is not null")
    return h.select("id", V.has_any(F.col("amenities"), ["Hồ bơi", "Phòng xông hơi"]).alias("any_of"), V.has_all(F.col("amenities"), ["Hồ bơi", "Bãi đỗ xe"]).alias("all_of"))


@query(f"SELECT h.id, CAST(coalesce(min(r.price), 0) AS DOUBLE) AS price_from FROM {H} h LEFT JOIN rooms r ON r.hotel_id = h.id GROUP BY h.id")
def price_from(spark, d):
    """The least room price of every hotel, 0 for none."""
    out = R.least_of_children(hotels_once(spark, d).select("id"), "id", table(spark, d, "rooms").where("hotel_id is not null"), "hotel_id", "price", "price_from")
    return out.select("id", F.col("price_from").cast("double").alias("price_from"))


@query(f"SELECT count(*) AS n, count(*) FILTER (WHERE review_score >= 9) AS best, count(*) FILTER (WHERE is_luxury) AS luxury, count(*) FILTER (WHERE list_contains(amenities, 'Hồ bơi')) AS pools FROM {H}")
def count_filtered(spark, d):
    h = hotels_once(spark, d, "review_score", "is_luxury", "amenities")
    return h.agg(F.count("*").alias("n"), F.count_if(F.col("review_score") >= 9).alias("best"), F.count_if("is_luxury").alias("luxury"), F.count_if(V.has_any(F.col("amenities"), ["Hồ bơi"])).alias("pools"))


@query("""WITH n AS (SELECT DISTINCT id, hotel_id, name, distance_km FROM nearby_places WHERE hotel_id IS NOT NULL)
SELECT hotel_id, name, CAST(distance_km AS DOUBLE) AS distance_km, CAST(row_number() OVER (PARTITION BY hotel_id ORDER BY distance_km NULLS LAST, id) AS INTEGER) AS rank
FROM n QUALIFY row_number() OVER (PARTITION BY hotel_id ORDER BY distance_km NULLS LAST, id) <= 5""")
def nearest_places(spark, d):
    """The five nearest places of each hotel by the distance given, unknown ones last."""
    n = table(spark, d, "nearby_places").where("hotel_id is not null").select("id", "hotel_id", "name", "distance_km").dropDuplicates(["id"])
    out = R.first_rows(n, ["hotel_id"], [F.col("distance_km").asc_nulls_last(), F.col("id")], 5)
    return out.select("hotel_id", "name", F.col("distance_km").cast("double").alias("distance_km"), "rank")


@query(f"""WITH h AS (SELECT id, accommodation_type, country, CAST(star_rating AS VARCHAR) AS star_rating, list_distinct(amenities) AS amenities, list_distinct(suitable_for) AS suitable_for FROM {H})
SELECT 'accommodation_type' AS dimension, accommodation_type AS value, count(*) AS n FROM h WHERE accommodation_type IS NOT NULL GROUP BY 2
UNION ALL SELECT 'country', country, count(*) FROM h WHERE country IS NOT NULL GROUP BY 2
UNION ALL SELECT 'star_rating', star_rating, count(*) FROM h WHERE star_rating IS NOT NULL GROUP BY 2
UNION ALL SELECT 'amenities', v, count(*) FROM (SELECT unnest(amenities) AS v FROM h) WHERE v IS NOT NULL GROUP BY 2
UNION ALL SELECT 'suitable_for', v, count(*) FROM (SELECT unnest(suitable_for) AS v FROM h) WHERE v IS NOT NULL GROUP BY 2""")
def freq_tables(spark, d):
    """Frequencies of scalar and array dimensions in one pass."""
    h = hotels_once(spark, d, "accommodation_type", "country", "star_rating", "amenities", "suitable_for")
    return R.frequencies(h, ["accommodation_type", "country", "star_rating"], ["amenities", "suitable_for"])


@query(f"SELECT country, city, area, count(*) AS n FROM {H} GROUP BY ROLLUP (country, city, area)")
def geo_rollup(spark, d):
    """Counts by country, city and area, with subtotals."""
    return hotels_once(spark, d, "country", "city", "area").rollup("country", "city", "area").agg(F.count("*").alias("n"))


@query(f"SELECT city, count(*) AS n, round(avg(CASE WHEN list_has_any(suitable_for, ['gia đình']) THEN 1 ELSE 0 END), 6) AS share FROM {H} WHERE city IS NOT NULL GROUP BY city HAVING count(*) >= 5")
def share_min_support(spark, d):
    """The share of a city's hotels with a signal, for cities with five or more."""
    out = R.share_by(hotels_once(spark, d, "city", "suitable_for"), "city", V.has_any(F.col("suitable_for"), ["gia đình"]), 5)
    return out.select("city", "n", F.round("share", 6).alias("share"))


@query(f"""WITH p AS (SELECT DISTINCT id, v FROM (SELECT id, unnest(amenities) AS v FROM {H}) WHERE v IS NOT NULL),
t AS (SELECT count(DISTINCT id) AS total FROM p), s AS (SELECT v, count(*) AS n FROM p GROUP BY v),
b AS (SELECT x.v AS a, y.v AS b, count(*) AS n_ab FROM p x JOIN p y ON x.id = y.id AND x.v <> y.v GROUP BY 1, 2),
l AS (SELECT b.a, b.b, sa.n AS n_a, b.n_ab, round(b.n_ab / sa.n, 4) AS probability, round((b.n_ab / sa.n) / (sb.n / total), 4) AS lift
      FROM b JOIN s sa ON sa.v = b.a JOIN s sb ON sb.v = b.b, t WHERE sa.n >= 15 AND b.n_ab / sa.n >= 0.1 AND (b.n_ab / sa.n) / (sb.n / total) >= 1.1)
SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY lift DESC, b) AS INTEGER) AS rank FROM l QUALIFY row_number() OVER (PARTITION BY a ORDER BY lift DESC, b) <= 5""")
def cooccurrence_lift(spark, d):
    """Amenities that come together more often than by chance."""
    pairs = hotels_once(spark, d, "amenities").select("id", F.explode("amenities").alias("v"))
    return R.lift(pairs, "id", "v", 15, 0.1, 1.1, 5)


@query("""SELECT n.hotel_id, l.landmark_id, CAST(min(n.distance_km) AS DOUBLE) AS distance_km FROM nearby_places n
JOIN landmarks l ON lower(trim(n.name)) = lower(trim(l.name)) WHERE n.hotel_id IS NOT NULL AND n.distance_km IS NOT NULL GROUP BY 1, 2""")
def near_relations(spark, d):
    """Hotel-landmark edges by exact name, with the least distance claimed."""
    n = table(spark, d, "nearby_places").where("hotel_id is not null and distance_km is not null").groupBy("hotel_id", F.lower(F.trim("name")).alias("k")).agg(F.min("distance_km").alias("km"))
    marks = table(spark, d, "landmarks").select("landmark_id", F.lower(F.trim("name")).alias("k"))
    return n.join(marks, "k").groupBy("hotel_id", "landmark_id").agg(F.min("km").cast("double").alias("distance_km"))


@query("SELECT sha1(lower(trim(text))) AS fingerprint, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE length(trim(text)) >= 20 GROUP BY 1")
def first_wins_dedupe(spark, d):
    """One document per fingerprint, the smallest id, with the number of its copies."""
    docs = table(spark, d, "documents").where(F.char_length(F.trim("text")) >= 20)
    return docs.groupBy(F.sha1(F.lower(F.trim("text"))).alias("fingerprint")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""WITH f AS (SELECT concept_id, unnest(list_concat([label_vi, label_en], surface_forms)) AS form FROM concepts)
SELECT concept_id, form, strip_accents(lower(form)) AS folded, replace(strip_accents(lower(form)), 'đ', 'd') AS plain,
 regexp_extract_all(replace(strip_accents(lower(form)), 'đ', 'd'), '[\\p{L}\\p{N}]+') AS terms FROM f""")
def fold_tokens(spark, d):
    """Forms folded with and without đ, and their terms."""
    f = table(spark, d, "concepts").select("concept_id", F.explode(F.concat(F.array("label_vi", "label_en"), F.col("surface_forms"))).alias("form"))
    return f.select("concept_id", "form", X.fold(F.col("form")).alias("folded"), X.fold(F.col("form"), False).alias("plain"), X.tokens(F.col("form"), True).alias("terms"))


_BM25 = """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents WHERE text IS NOT NULL),
w2 AS (SELECT doc_id, t, len(t) AS dl FROM w WHERE len(t) > 0), st AS (SELECT count(*) AS nd, avg(dl) AS av FROM w2),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w2) GROUP BY 1, 2),
q AS (SELECT DISTINCT concept_id, term FROM (SELECT concept_id, unnest(regexp_extract_all(lower(label_vi), '[\\p{L}\\p{N}]+')) AS term FROM concepts WHERE facet = 'amenity')),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT q.concept_id, p.doc_id, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / av))), 6) AS score
      FROM q JOIN p USING (term) JOIN df USING (term) JOIN w2 ON w2.doc_id = p.doc_id, st GROUP BY 1, 2)
SELECT concept_id, doc_id, score, CAST(row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, doc_id) <= 10"""


def _lexical(spark, d, size: int, allowed: DataFrame | None = None) -> DataFrame:
    index = search.build_index(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return search.bm25(index, "doc_id", table(spark, d, "concepts").where("facet = 'amenity'"), "concept_id", "label_vi", size, allowed)


@query(_BM25)
def bm25_topk(spark, d):
    """The ten best documents of each amenity's label."""
    return _lexical(spark, d, 10)


_DOT = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


def _near_vectors(spark, d, size: int) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.vector_search(e, "vec_id", "embedding", e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), "query_id", "embedding", size, without_self=True)


@query(f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10""")
def vector_topk(spark, d):
    """The ten nearest vectors of every vector whose id is divisible by 100, against all."""
    return _near_vectors(spark, d, 10)


_RANKS = f"""v AS (SELECT a.vec_id AS query_id, b.vec_id, round({_DOT}, 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
vr AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM v QUALIFY rank <= 50),
l AS (SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY abs(b.vec_id - a.vec_id), b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 QUALIFY rank <= 50),
f AS (SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(CASE WHEN o = 0 THEN rank END) AS r0, min(CASE WHEN o = 1 THEN rank END) AS r1
      FROM (SELECT *, 0 AS o FROM l UNION ALL SELECT *, 1 FROM vr) GROUP BY 1, 2)"""


def _label_list(spark, d) -> DataFrame:
    """Another ranking of the same vectors: those of the same label by the distance of their ids, looked up in label order."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    near = asked.join(e, "label").where("query_id <> vec_id")
    return R.first_rows(near, ["query_id"], [F.abs(F.col("vec_id") - F.col("query_id")), F.col("vec_id")], 50).select("query_id", "vec_id", (-F.col("rank")).cast("double").alias("score"), "rank")


@query(f"WITH {_RANKS} SELECT query_id, vec_id, rrf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, r0 NULLS LAST, r1 NULLS LAST, vec_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 15")
def rrf_fusion(spark, d):
    """Reciprocal rank fusion of two rankings of 50."""
    return search.fuse([_label_list(spark, d), _near_vectors(spark, d, 50)], "query_id", "vec_id", size=15)


@query(f"""WITH {_RANKS}, h AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, r0 NULLS LAST, r1 NULLS LAST, vec_id) AS p FROM f QUALIFY p <= 15)
SELECT 'hybrid_no_rerank' AS mode, query_id, vec_id, CAST(count(*) OVER (PARTITION BY query_id) - p + 1 AS DOUBLE) AS score, CAST(p AS INTEGER) AS rank FROM h
UNION ALL SELECT 'bm25_only', query_id, vec_id, CAST(count(*) OVER (PARTITION BY query_id) - rank + 1 AS DOUBLE), CAST(rank AS INTEGER) FROM l WHERE rank <= 15
UNION ALL SELECT 'vector_only', query_id, vec_id, CAST(count(*) OVER (PARTITION BY query_id) - rank + 1 AS DOUBLE), CAST(rank AS INTEGER) FROM vr WHERE rank <= 15""")
def hybrid_modes(spark, d):
    """Three modes of the hybrid search, scored by place."""
    lex, vec = _label_list(spark, d), _near_vectors(spark, d, 50)
    parts = [search.hybrid(m, lex, vec, "query_id", "vec_id").select(F.lit(m).alias("mode"), "query_id", "vec_id", "score", "rank") for m in ("hybrid_no_rerank", "bm25_only", "vector_only")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def embed(text: Column) -> Column:
    """The embedding of a text: counts of its folded words in 256 buckets, which stand in for a model. Another embedder is a
    function of a text column to an array column, such as a pandas UDF around a model."""
    return V.hashed(X.tokens(text, True))


def _near_texts(docs: DataFrame, asked: DataFrame, size: int, allowed: DataFrame | None = None, embedder: Callable[[Column], Column] = embed) -> DataFrame:
    """The documents nearest to each label; unlike BM25 the stand-in finds a word whatever its marks."""
    numbers = asked.select("concept_id", F.xxhash64("concept_id").alias("query"), embedder(F.col("label_vi")).alias("v"))
    vectors = search.build_vectors(docs, "doc_id", "text", embedder)
    found = search.vector_search(vectors, "doc_id", "v", numbers, "query", "v", size, allowed).where("score > 0")
    return found.join(numbers.select("concept_id", "query"), "query").select("concept_id", "doc_id", "score", "rank")


def _modes(spark, d, modes, allowed: DataFrame | None) -> DataFrame:
    """(mode, concept_id, hotel_id, score, doc_id, rank): the hotels of each label by their best document in each mode; the
    allowed documents restrict both arms before anything is ranked."""
    docs = table(spark, d, "documents").select("doc_id", "hotel_id", "text")
    asked = table(spark, d, "concepts").where("facet = 'amenity'").select("concept_id", "label_vi")
    lex, vec = _lexical(spark, d, 50, allowed), _near_texts(docs, asked, 50, allowed)

    def score(found: DataFrame) -> DataFrame:
        return found.join(docs, "doc_id").join(asked, "concept_id").withColumn("score", F.round(search.lexical_overlap(F.col("label_vi"), F.col("text")), 6)).drop("text", "label_vi", "hotel_id")

    out = []
    for mode in modes:
        ranked = search.hybrid(mode, lex, vec, "concept_id", "doc_id", score)
        rolled = search.roll_up(ranked.join(docs.select("doc_id", "hotel_id"), "doc_id").where("hotel_id is not null"), "concept_id", "hotel_id", "doc_id", 10)
        out.append(rolled.select(F.lit(mode).alias("mode"), *rolled.columns))
    return reduce(DataFrame.unionByName, out)


def _allowed(spark, d) -> DataFrame:
    """The documents of the hotels that a request's filters leave, here four stars or more and a score of 7 or more."""
    where = R.condition(ranges={"star_rating": R.Range(4), "review_score": R.Range(7)})
    keys = R.whitelist(hotels_once(spark, d, "star_rating", "review_score"), "id", where)
    return table(spark, d, "documents").select("doc_id", "hotel_id").join(keys.withColumnRenamed("id", "hotel_id"), "hotel_id", "left_semi").select("doc_id")


def _modes_sql(allowed: str) -> str:
    """All four modes in SQL; ``allowed`` is a condition on documents."""
    bucket = "CAST('0x' || left(md5(t), 8) AS BIGINT) % 256"
    folded = "regexp_extract_all(replace(strip_accents(lower({0})), 'đ', 'd'), '[\\p{{L}}\\p{{N}}]+')"
    plain = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
    return f"""WITH h AS {H}, ok AS (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND {allowed}),
q AS (SELECT concept_id, label_vi FROM concepts WHERE facet = 'amenity'),
w AS (SELECT doc_id, hotel_id, text, {plain.format('text')} AS t FROM documents WHERE text IS NOT NULL), w2 AS (SELECT *, len(t) AS dl FROM w WHERE len(t) > 0),
st AS (SELECT count(*) AS nd, avg(dl) AS av FROM w2), p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w2) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
qt AS (SELECT DISTINCT concept_id, term FROM (SELECT concept_id, unnest({plain.format('label_vi')}) AS term FROM q)),
bs AS (SELECT qt.concept_id, p.doc_id, round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / av))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term) JOIN w2 ON w2.doc_id = p.doc_id JOIN ok ON ok.doc_id = p.doc_id, st GROUP BY 1, 2),
b AS (SELECT concept_id, doc_id, row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, doc_id) AS rank FROM bs QUALIFY rank <= 50),
dv AS (SELECT doc_id, {bucket} AS k, count(*) AS c FROM (SELECT doc_id, unnest({folded.format('text')}) AS t FROM w JOIN ok USING (doc_id)) GROUP BY 1, 2), dn AS (SELECT doc_id, sqrt(sum(c * c)) AS n FROM dv GROUP BY 1),
qv AS (SELECT concept_id, {bucket} AS k, count(*) AS c FROM (SELECT concept_id, unnest({folded.format('label_vi')}) AS t FROM q) GROUP BY 1, 2), qn AS (SELECT concept_id, sqrt(sum(c * c)) AS n FROM qv GROUP BY 1),
vs AS (SELECT qv.concept_id, dv.doc_id, round(sum((qv.c / qn.n) * (dv.c / dn.n)), 6) AS score FROM qv JOIN dv USING (k) JOIN qn ON qn.concept_id = qv.concept_id JOIN dn ON dn.doc_id = dv.doc_id GROUP BY 1, 2),
v AS (SELECT concept_id, doc_id, row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, doc_id) AS rank FROM vs WHERE score > 0 QUALIFY rank <= 50),
f AS (SELECT concept_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS rrf, min(CASE WHEN o = 0 THEN rank END) AS r0, min(CASE WHEN o = 1 THEN rank END) AS r1 FROM (SELECT *, 0 AS o FROM b UNION ALL SELECT *, 1 FROM v) GROUP BY 1, 2),
c AS (SELECT 'fused' AS arm, concept_id, doc_id, row_number() OVER (PARTITION BY concept_id ORDER BY rrf DESC, r0 NULLS LAST, r1 NULLS LAST, doc_id) AS place FROM f QUALIFY place <= 15
 UNION ALL SELECT 'bm25_only', concept_id, doc_id, rank FROM b WHERE rank <= 15 UNION ALL SELECT 'vector_only', concept_id, doc_id, rank FROM v WHERE rank <= 15),
s AS (SELECT CASE arm WHEN 'fused' THEN 'full_hybrid' ELSE arm END AS mode, concept_id, doc_id, round(len(list_intersect(list_distinct({plain.format('label_vi')}), list_distinct({plain.format('text')}))) / len(list_distinct({plain.format('label_vi')})), 6) AS score FROM c JOIN q USING (concept_id) JOIN w USING (doc_id)
 UNION ALL SELECT 'hybrid_no_rerank', concept_id, doc_id, CAST(count(*) OVER (PARTITION BY concept_id) - place + 1 AS DOUBLE) FROM c WHERE arm = 'fused'),
j AS (SELECT mode, concept_id, hotel_id, doc_id, score FROM s JOIN documents USING (doc_id) WHERE hotel_id IS NOT NULL),
o AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY mode, concept_id, hotel_id ORDER BY score DESC, doc_id) = 1)
SELECT mode, concept_id, hotel_id, score, doc_id, CAST(row_number() OVER (PARTITION BY mode, concept_id ORDER BY score DESC, hotel_id) AS INTEGER) AS rank FROM o QUALIFY rank <= 10"""


@query(_modes_sql("hotel_id IN (SELECT id FROM h WHERE star_rating >= 4 AND review_score >= 7)"))
def search_modes(spark, d):
    """Filtered search in all four modes: BM25 and vectors over the filtered documents, fused, reranked, rolled up to hotels."""
    return _modes(spark, d, search.MODES, _allowed(spark, d))


@query(f"SELECT concept_id, hotel_id, score, doc_id, rank FROM ({_modes_sql('true')}) WHERE mode = 'full_hybrid'")
def full_hybrid_search(spark, d):
    """BM25 fused with the vector search over all documents, reranked by a pluggable scorer, here term overlap, and rolled up."""
    return _modes(spark, d, ["full_hybrid"], None).drop("mode")


@query(f"""WITH b AS ({_BM25.replace("<= 10", "<= 50")}), j AS (SELECT b.concept_id, hotel_id, doc_id, score FROM b JOIN documents USING (doc_id) WHERE hotel_id IS NOT NULL),
o AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY concept_id, hotel_id ORDER BY score DESC, doc_id) = 1)
SELECT concept_id, hotel_id, score, doc_id, CAST(row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, hotel_id) AS INTEGER) AS rank FROM o QUALIFY rank <= 10""")
def chunk_rollup_max(spark, d):
    """Hotels by their best document."""
    found = _lexical(spark, d, 50).drop("rank").join(table(spark, d, "documents").select("doc_id", "hotel_id"), "doc_id").where("hotel_id is not null")
    return search.roll_up(found, "concept_id", "hotel_id", "doc_id", 10)


_METRICS = f"""WITH {_RANKS}, rk AS (SELECT query_id, vec_id, rank FROM vr WHERE rank <= 10), rel AS (SELECT query_id, vec_id, rank AS place FROM l WHERE rank <= 20),
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), g AS (SELECT query_id, vec_id, n - place + 1 AS gain, place FROM rel JOIN n USING (query_id)),
i AS (SELECT query_id, sum(gain / log2(place + 1)) AS idcg FROM g WHERE place <= 10 GROUP BY 1),
h AS (SELECT query_id, count(*) AS hits, min(rank) AS first, sum(gain / log2(rank + 1)) AS dcg FROM rk JOIN g USING (query_id, vec_id) GROUP BY 1),
m AS (SELECT query_id, round(coalesce(hits / n, 0), 6) AS recall, CASE WHEN hits > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit, round(coalesce(1 / first, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg, 0.0::DOUBLE AS zero_result
 FROM n LEFT JOIN i USING (query_id) LEFT JOIN h USING (query_id))"""


def _metrics(spark, d) -> DataFrame:
    relevant = _label_list(spark, d).where("rank <= 20").select("query_id", "vec_id", F.col("rank").alias("place"))
    return search.ranking_metrics(_near_vectors(spark, d, 10), relevant, "query_id", "vec_id", 10)


@query(f"{_METRICS} SELECT * FROM m")
def ir_metrics(spark, d):
    """Recall, hit, MRR, NDCG and zero results at 10 of the vector search against graded relevance."""
    return _metrics(spark, d)


@query(f"""{_METRICS}, k AS (SELECT *, CASE WHEN query_id % 200 = 0 THEN 'even' ELSE 'odd' END AS grp FROM m)
SELECT grp, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM k GROUP BY grp
UNION ALL SELECT 'all', round(avg(recall), 6), round(avg(mrr), 6), round(avg(ndcg), 6) FROM k""")
def mean_ir_metrics(spark, d):
    """Means per group of queries and over all."""
    return search.mean_metrics(_metrics(spark, d), ["recall", "mrr", "ndcg"], F.when(F.col("query_id") % 200 == 0, "even").otherwise("odd"))


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events WHERE event_type IS NOT NULL GROUP BY 1")
def p95_nearest_rank(spark, d):
    return R.nearest_rank(table(spark, d, "events").where("event_type is not null"), ["event_type"], "value", 0.95, "p95")


@query("""WITH d AS (SELECT hotel_id, doc_id, text, greatest(1, length(text) // 4) AS tok FROM documents WHERE hotel_id IS NOT NULL AND text IS NOT NULL),
r AS (SELECT *, row_number() OVER w AS rk, sum(tok) OVER (PARTITION BY hotel_id ORDER BY n DESC, doc_id ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT *, length(text) AS n FROM d) WINDOW w AS (PARTITION BY hotel_id ORDER BY n DESC, doc_id))
SELECT hotel_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY rk) AS context_text, string_agg('cit-' || lpad(CAST(rk AS VARCHAR), 3, '0') || ':' || doc_id, ',' ORDER BY rk) AS citations,
CAST(count(*) AS INTEGER) AS n_chunks, CAST(sum(tok) AS INTEGER) AS used_tokens FROM r WHERE rk = 1 OR total <= 600 GROUP BY 1""")
def context_package(spark, d):
    """Each hotel's longest documents that fit 600 tokens, with citations."""
    docs = table(spark, d, "documents").where("hotel_id is not null and text is not null").withColumn("score", F.char_length("text"))
    return search.context(docs, "hotel_id", "doc_id", "text", "score", 600)


@query("""WITH e AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value NULLS LAST, event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_id, event_type, value FROM e WHERE n <= 40 OR pos IN (SELECT (i * e.n) // 40 FROM range(40) t(i))""")
def balanced_sample(spark, d):
    """40 events of each type at even steps of their value."""
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    return R.balanced_sample(e, "event_type", [F.col("value").asc_nulls_last(), F.col("event_id")], 40)


@query("""SELECT time_bucket(INTERVAL '5 minutes', ts) AS window_start, event_type, count(*) AS n, round(count(*) / 300, 6) AS per_second FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def rate_5m(spark, d):
    """Events per second in windows of five minutes."""
    return M.rate(table(spark, d, "events"), "ts", ["event_type"])


_BOUNDS = (5.0, 10.0, 25.0, 50.0, 75.0, 100.0)


@query("\nUNION ALL\n".join(f"SELECT event_type, '{b:g}' AS le, count(*) FILTER (WHERE value <= {b}) AS n FROM events GROUP BY 1" for b in _BOUNDS) + "\nUNION ALL SELECT event_type, '+Inf', count(value) FROM events GROUP BY 1")
def value_histogram(spark, d):
    """Cumulative buckets of values by type."""
    return M.histogram(table(spark, d, "events"), ["event_type"], "value", _BOUNDS)


@query(f"""WITH b AS (SELECT event_type, {", ".join(f"count(*) FILTER (WHERE value <= {b}) AS c{i + 1}" for i, b in enumerate(_BOUNDS))}, 0 AS c0, count(value) AS n FROM events GROUP BY 1)
SELECT event_type, round(CASE {" ".join(f"WHEN c{i + 1} >= 0.5 * n THEN CASE WHEN c{i + 1} = c{i} THEN {b} ELSE {([0.0, *_BOUNDS])[i]} + ({b} - {([0.0, *_BOUNDS])[i]}) * (0.5 * n - c{i}) / (c{i + 1} - c{i}) END" for i, b in enumerate(_BOUNDS))} ELSE {_BOUNDS[-1]} END, 6) AS p50 FROM b""")
def bucket_median(spark, d):
    """The median as interpolated within its bucket."""
    return M.bucket_quantile(table(spark, d, "events"), ["event_type"], "value", _BOUNDS, 0.5, "p50")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS last_value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def last_value_gauge(spark, d):
    return M.last_value(table(spark, d, "events"), ["user_id", "event_type"], "ts", "value", "event_id")


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS first_path FROM events""")
def json_extract(spark, d):
    """Members of JSON texts, with a fallback path."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), V.first_path(F.col("props"), "$.missing", "$.k").alias("first_path"))


@query("""WITH a AS (SELECT DISTINCT hotel_id FROM rooms WHERE price > 1000000 AND hotel_id IS NOT NULL), b AS (SELECT DISTINCT hotel_id FROM activities WHERE hotel_id IS NOT NULL)
SELECT 'union' AS op, hotel_id FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', hotel_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'except', hotel_id FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def set_ops(spark, d):
    a = table(spark, d, "rooms").where("price > 1000000 and hotel_id is not null").select("hotel_id")
    b = table(spark, d, "activities").where("hotel_id is not null").select("hotel_id")
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b)}
    tagged = [x.select(F.lit(k).alias("op"), "hotel_id") for k, x in parts.items()]
    return tagged[0].unionAll(tagged[1]).unionAll(tagged[2])


@query("""WITH p AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rank, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) <= 4),
q AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings QUALIFY rank <= 8),
u AS (SELECT label, vec_id, min(o * 1000 + r) AS k FROM (SELECT label, vec_id, 0 AS o, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS r FROM p UNION ALL SELECT label, vec_id, 1, rank FROM q) GROUP BY 1, 2)
SELECT label, vec_id, CAST(row_number() OVER (PARTITION BY label ORDER BY k, vec_id) AS INTEGER) AS rank FROM u QUALIFY rank <= 10""")
def pool_union(spark, d):
    """Two ranked lists one after the other, each item once."""
    e = table(spark, d, "embeddings").select("label", "vec_id")
    return R.union_keep_order([R.first_rows(e, ["label"], [F.col("vec_id").desc()], 4), R.first_rows(e, ["label"], [F.col("vec_id")], 8)], "label", "vec_id", "rank", 10)


@query(f"""WITH h AS {H}, n AS (SELECT DISTINCT id, hotel_id, name, distance_km FROM nearby_places WHERE hotel_id IS NOT NULL),
t AS (SELECT hotel_id, name, row_number() OVER (PARTITION BY hotel_id ORDER BY distance_km NULLS LAST, id) AS k FROM n QUALIFY k <= 5),
p AS (SELECT hotel_id, string_agg(name, ' · ' ORDER BY k) AS near FROM t GROUP BY 1), r AS (SELECT hotel_id, min(price) AS price FROM rooms WHERE hotel_id IS NOT NULL GROUP BY 1)
SELECT h.id AS hotel_id, coalesce(h.name, '') AS name, CAST(coalesce(star_rating, 0) AS DOUBLE) AS star, CAST(coalesce(r.price, 0) AS DOUBLE) AS price_from, left(coalesce(description, ''), 200) AS teaser,
CAST(len(list_slice(coalesce(amenities, []), 1, 8)) AS INTEGER) AS n_amenities, coalesce(images[1], '') AS image, coalesce(p.near, '') AS nearby
FROM h LEFT JOIN r ON r.hotel_id = h.id LEFT JOIN p ON p.hotel_id = h.id""")
def hotel_cards(spark, d):
    """Cards of all hotels: scalars with fallbacks, least price, five nearest places in order."""
    h = hotels_once(spark, d, "name", "star_rating", "description", "amenities", "images")
    low = table(spark, d, "rooms").where("hotel_id is not null").groupBy(F.col("hotel_id").alias("id")).agg(F.min("price").alias("price"))
    near = nearest_places(spark, d).groupBy(F.col("hotel_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]), " · ").alias("near"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    amenities = F.coalesce("amenities", F.array().cast("array<string>"))
    out = h.join(low, "id", "left").join(near, "id", "left")
    return out.select(F.col("id").alias("hotel_id"), text("name").alias("name"), F.coalesce(F.col("star_rating").cast("double"), F.lit(0.0)).alias("star"), F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price_from"), F.substring(text("description"), 1, 200).alias("teaser"), F.size(F.slice(amenities, 1, 8)).alias("n_amenities"), F.coalesce(F.try_element_at("images", F.lit(1)), F.lit("")).alias("image"), text("near").alias("nearby"))


@query(f"""WITH h AS {H}, r AS {RM}, n AS (SELECT hotel_id, count(*) AS n_rooms, CAST(min(price) AS DOUBLE) AS least, CAST(max(price) AS DOUBLE) AS most FROM r WHERE hotel_id IS NOT NULL GROUP BY 1),
t AS (SELECT hotel_id, name, row_number() OVER (PARTITION BY hotel_id ORDER BY price NULLS LAST, id) AS k FROM r WHERE hotel_id IS NOT NULL QUALIFY k <= 20),
x AS (SELECT hotel_id, string_agg(coalesce(name, ''), '|' ORDER BY k) AS rooms FROM t GROUP BY 1),
a AS (SELECT hotel_id, count(*) AS n_activities, CAST(sum(coalesce(price_amount, 0)) AS DOUBLE) AS activity_sum FROM (SELECT DISTINCT id, hotel_id, price_amount FROM activities WHERE hotel_id IS NOT NULL) GROUP BY 1)
SELECT h.id AS hotel_id, h.city, coalesce(n_rooms, 0) AS n_rooms, least, most, rooms, coalesce(n_activities, 0) AS n_activities, activity_sum FROM h LEFT JOIN n ON n.hotel_id = h.id LEFT JOIN x ON x.hotel_id = h.id LEFT JOIN a ON a.hotel_id = h.id""")
def hotel_documents(spark, d):
    """Summaries of hotels: number and price range of their rooms, names of the 20 cheapest in order, number and sum of their
    activities. ``hotel_document_parts`` has the whole documents."""
    r = rooms_once(spark, d, "hotel_id", "name", "price").where("hotel_id is not null")
    all_rooms = r.groupBy("hotel_id").agg(F.count("*").alias("n_rooms"), F.min("price").cast("double").alias("least"), F.max("price").cast("double").alias("most"))
    cheap = R.first_rows(r, ["hotel_id"], [F.col("price").asc_nulls_last(), F.col("id")], 20)
    names = cheap.groupBy("hotel_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("name", F.lit("")).alias("name")))), lambda s: s["name"]), "|").alias("rooms"))
    a = table(spark, d, "activities").where("hotel_id is not null").select("id", "hotel_id", "price_amount").dropDuplicates(["id"]).groupBy("hotel_id").agg(F.count("*").alias("n_activities"), F.sum(F.coalesce("price_amount", F.lit(0))).cast("double").alias("activity_sum"))
    h = hotels_once(spark, d, "city").withColumnRenamed("id", "hotel_id")
    out = h.join(all_rooms, "hotel_id", "left").join(names, "hotel_id", "left").join(a, "hotel_id", "left")
    return out.select("hotel_id", "city", F.coalesce("n_rooms", F.lit(0)).alias("n_rooms"), "least", "most", "rooms", F.coalesce("n_activities", F.lit(0)).alias("n_activities"), "activity_sum")


#: Rooms, places and activities, each, that one part of a hotel's document holds at most.
PART_ROWS = 200


@query()
def hotel_document_parts(spark, d):
    """Whole documents of hotels in parts: the hotel's own fields (part 0 only), all its rooms by price, all nearby places by
    distance and all activities by id, PART_ROWS of each a part. What belongs to no delivered hotel is left out."""
    word, number = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c), lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    whole, texts = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c), lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")).alias(c)
    h = hotels_once(spark, d, "name", "accommodation_type", "star_rating", "is_luxury", "address", "city", "latitude", "longitude", "review_score", "review_count", "reviews_detail", "description", "amenities", "suitable_for", "policy_notes", "useful_info", "images", "source_url").withColumnRenamed("id", "hotel_id")
    once = lambda t, order, *c: R.first_wins(table(spark, d, t).where("id is not null").select("id", *c), ["id"], order)
    low = once("rooms", ["crawled_at", "hotel_id", "price"], "crawled_at", "hotel_id", "price").where("hotel_id is not null").groupBy("hotel_id").agg(F.min("price").cast("double").alias("price_from"))
    own = F.struct(word("name"), word("accommodation_type"), number("star_rating"), F.coalesce("is_luxury", F.lit(False)).alias("is_luxury"), word("address"), word("city"), number("latitude"), number("longitude"), number("review_score"), whole("review_count"), "reviews_detail", word("description"), texts("amenities"), texts("suitable_for"), texts("policy_notes"), "useful_info", number("price_from"), texts("images"), word("source_url"))
    parts = [h.join(low, "hotel_id", "left").select("hotel_id", F.lit(0).cast("long").alias("part"), own.alias("hotel"))]
    for name, first, by, rest, fields in (
        ("rooms", ["crawled_at"], ["price"], ["room_type_id", "name", "room_size", "max_occupancy", "bed_type", "room_view", "room_amenities", "images", "review_score"], ["id", whole("room_type_id"), word("name"), number("price"), word("room_size"), whole("max_occupancy"), word("bed_type"), "room_view", texts("room_amenities"), texts("images"), number("review_score")]),
        ("nearby_places", [], ["distance_km"], ["name", "type"], ["id", word("name"), word("type"), number("distance_km")]),
        ("activities", [], [], ["title", "description", "price_amount", "review_score"], ["id", word("title"), word("description"), number("price_amount"), number("review_score")]),
    ):
        # positions come from the key columns alone; both sides take the same first row, so only the items are shuffled whole
        order = [*first, "hotel_id", *by]
        keys = once(name, order, *order).select("id", "hotel_id", *by).join(h.select("hotel_id"), "hotel_id", "left_semi")
        placed = R.positions(keys, "hotel_id", [*(F.col(c).asc_nulls_last() for c in by), F.col("id")]).select("id", F.col("hotel_id").alias("owner"), "position")
        grouped = once(name, order, *order, *rest).join(placed, "id").groupBy(F.col("owner").alias("hotel_id"), F.floor((F.col("position") - 1) / PART_ROWS).alias("part")).agg(F.array_sort(F.collect_list(F.struct("position", F.struct(*fields).alias("item")))).alias("items"))
        parts.append(grouped.select("hotel_id", "part", F.transform("items", lambda x: x["item"]).alias(name)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    lists = [F.first(c, ignorenulls=True).alias(c) for c in ("hotel", "rooms", "nearby_places", "activities")]
    return every.groupBy("hotel_id", "part").agg(*lists).select("hotel_id", "part", "hotel", *(F.coalesce(c, F.array()).alias(c) for c in ("rooms", "nearby_places", "activities")))


#: Sentences of a text packed up to 1,000 characters, in SQL.
_PACKED = r"""(SELECT {key}, CASE WHEN length(t) <= 1000 THEN [t] ELSE list_filter(list_append(f.done, f.buf), lambda c: c <> '') END AS chunks FROM (
SELECT {key}, t, list_reduce(list_transform(string_split(regexp_replace(t, '([.!?…]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: {{'done': []::VARCHAR[], 'buf': trim(x, ' ')}}),
 lambda a, x: CASE WHEN x.buf = '' THEN a WHEN a.buf <> '' AND length(a.buf) + length(x.buf) + 1 > 1000 THEN {{'done': list_append(a.done, a.buf), 'buf': x.buf}} WHEN a.buf = '' THEN x ELSE {{'done': a.done, 'buf': a.buf || ' ' || x.buf}} END) AS f
FROM (SELECT {key}, trim(regexp_replace({text}, '[ \t\n\r\f\x{{0b}}]+', ' ', 'g'), ' ') AS t FROM {source}) WHERE t <> ''))"""


@query(f"SELECT doc_id, CAST(unnest(generate_series(0, len(chunks) - 1)) AS INTEGER) AS seq, unnest(chunks) AS chunk FROM {_PACKED.format(key='doc_id', text='text', source='documents')}")
def sentence_chunks(spark, d):
    """Documents packed by characters."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.pack_characters(F.col("text"))).alias("seq", "chunk"))
    return docs.select("doc_id", "seq", "chunk")


@query()
def overlap_chunks(spark, d):
    """Documents packed by words, with sentences repeated at the start of the next chunk."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.pack_words(F.col("text"), 120, 30)).alias("seq", "chunk"))


@query()
def hotel_chunks(spark, d):
    """Retrieval chunks of hotels, of all eight kinds."""
    return chunking.hotel_chunks(*(table(spark, d, t) for t in ("hotels", "rooms", "nearby_places", "activities")))


_ROOM_TEXT = "concat_ws('. ', nullif(trim(name, ' '), ''), 'diện tích ' || nullif(trim(room_size, ' '), ''), 'giường ' || nullif(trim(bed_type, ' '), ''), 'hướng ' || nullif(trim(room_view, ' '), ''), 'tối đa ' || max_occupancy || ' khách', 'tiện nghi phòng: ' || nullif(array_to_string(list_filter(list_transform(room_amenities, lambda x: trim(x, ' ')), lambda x: x <> ''), ', '), ''))"


@query(f"""WITH h AS {H}, r AS {RM}, n AS (SELECT DISTINCT id, hotel_id, name, type, distance_km FROM nearby_places WHERE id IS NOT NULL), a AS (SELECT DISTINCT id, hotel_id, title, description FROM activities WHERE id IS NOT NULL),
p AS (SELECT id, list_filter(list_transform(policy_notes, lambda x: trim(x, ' ')), lambda x: x <> '') AS notes FROM h),
c AS (SELECT id AS hotel_id, 'hotel_description' AS kind, 'desc' AS code, NULL AS record, unnest(generate_series(1, len(chunks))) AS seq, unnest(chunks) AS text FROM {_PACKED.format(key='id', text='description', source='h')}
UNION ALL SELECT id, 'amenity', 'amen', NULL, 1, 'Tiện nghi: ' || array_to_string(list_filter(list_transform(amenities, lambda x: trim(x, ' ')), lambda x: x <> ''), ', ') FROM (SELECT id, list_reduce(list_transform(amenities, lambda x: [x]), lambda a, x: CASE WHEN list_contains(list_transform(a, lambda y: trim(y, ' ')), trim(x[1], ' ')) THEN a ELSE list_concat(a, x) END) AS amenities FROM h WHERE len(amenities) > 0) WHERE len(list_filter(amenities, lambda x: trim(x, ' ') <> '')) > 0
UNION ALL SELECT id, 'policy', 'policy', NULL, unnest(generate_series(1, len(notes))), unnest(notes) FROM p
UNION ALL SELECT hotel_id, 'room_info', 'room', id, 1, {_ROOM_TEXT} FROM r WHERE hotel_id IS NOT NULL
UNION ALL SELECT hotel_id, 'nearby', 'near', id, 1, trim(coalesce(name, '') || coalesce(' (' || type || ')', '') || coalesce(' — cách ' || distance_km || ' km', ''), ' ') FROM n WHERE hotel_id IS NOT NULL
UNION ALL SELECT hotel_id, 'activity', 'act', id, 1, concat_ws('. ', nullif(trim(title, ' '), ''), nullif(trim(description, ' '), '')) FROM a WHERE hotel_id IS NOT NULL)
SELECT concat_ws('-', 'chunk', c.hotel_id, code, record, printf('%03d', seq)) AS chunk_id, c.hotel_id, kind AS source_type, CAST(record AS BIGINT) AS record_id, CAST(seq AS INTEGER) AS seq, text,
CASE WHEN code = 'none' THEN '' ELSE concat_ws(' — ', nullif(trim(h.name, ' '), ''), CASE code WHEN 'desc' THEN 'Mô tả' WHEN 'amen' THEN 'Tiện nghi' WHEN 'policy' THEN 'Chính sách' WHEN 'room' THEN 'Phòng' WHEN 'near' THEN 'Địa điểm lân cận' ELSE 'Hoạt động' END) || '. ' || text END AS embed_text
FROM c JOIN h ON h.id = c.hotel_id WHERE text <> ''""")
def flat_chunks(spark, d):
    """Those of ``hotel_chunks`` that come from flat fields: all but questions, reviews and useful information."""
    return hotel_chunks(spark, d).where("source_type not in ('faq', 'review') and embed_text not like '%Thông tin hữu ích. %'")


@query()
def review_chunks(spark, d):
    """All sample reviews of hotels, one chunk per wording and hotel."""
    h = hotels_once(spark, d, "reviews_detail")
    said = shred.entity_table(shred.adjacency(h, "id", ["reviews_detail"]), r"sample_comments\[\d+\]$", ["title", "text", "positives", "negatives"])
    return chunking.review_chunks(said.withColumnRenamed("id", "hotel_id"), "hotel_id", "path")


@query()
def cms_chunks(spark, d):
    """Documents taken for pages, by sections, packed by words."""
    return chunking.cms_chunks(table(spark, d, "documents").where("source = 'cms'").select("doc_id", "source_type", "text"), "doc_id", "source_type", "text", 120, 30)


@query("""WITH t AS (SELECT doc_id, trim(text) AS text FROM documents WHERE length(trim(text)) >= 20)
SELECT left(sha1(lower(text)), 16) AS chunk_id, min(doc_id) AS doc_id, arg_min(text, doc_id) AS text FROM t GROUP BY 1""")
def atomic_chunks(spark, d):
    return chunking.atomic_chunks(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS approximate, CAST(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x{0b}]+'), lambda x: x <> '')) AS INTEGER) AS words FROM documents WHERE text IS NOT NULL")
def token_estimates(spark, d):
    docs = table(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", X.approximate_tokens(F.col("text")).alias("approximate"), X.word_count(F.col("text")).alias("words"))
