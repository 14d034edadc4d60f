"""Readers with explicit schemas; nothing is inferred from data."""

from __future__ import annotations

import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import values as V

#: The nested source record; members whose names vary are maps.
HOTEL = """
hotel_id string, name string, property_type string, accommodation_type string, star_rating string, is_luxury boolean,
review_score double, review_count int, address string, area string, district string, city string, province string, country string,
latitude double, longitude double, description string, source_url string, crawled_at string,
useful_info map<string,string>, amenity_groups map<string,array<string>>, rating_breakdown map<string,double>,
amenities array<string>, amenities_general array<string>, amenities_leisure array<string>, amenities_dining array<string>,
highlights array<string>, suitable_for array<string>, images array<struct<url:string,caption:string,category:string>>,
nearby_places array<struct<name:string,type:string,distance_km:double>>,
faq array<struct<question:string,answer:string,category:string>>,
rooms array<struct<room_type_id:bigint,name:string,room_size:string,max_occupancy:int,bed_type:string,room_view:string,room_amenities:array<string>,images:array<string>,review_score:double,price_per_night:string>>,
activities array<struct<activity_id:bigint,title:string,description:string,review_score:double,price:struct<currency:string,display:struct<perBook:struct<total:struct<allInclusive:struct<chargeTotal:double>>>>>>>,
reviews_detail struct<score:double,review_count:int,tags:array<struct<tag:string,mentioned:int,positive_pct:double>>,sample_comments:array<struct<rating:double,title:string,text:string,positives:string,negatives:string,response:string>>>,
policy_notes array<string>, _corrupt string
"""


def read_vectors(spark: SparkSession, path: str, key: str, vector: str) -> DataFrame:
    """Vectors by key as ``write_vectors`` left them; they meet their texts by a join on the key."""
    return spark.read.parquet(path).select(key, vector)


def read_hotels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of nested records, one JSON document per file.

    Rejected are files that can't be parsed and records without a whole number as their id; both keep their file's name.
    Of records with one id the first by file name stands.
    """
    raw = spark.read.schema(HOTEL).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path).withColumn("file", F.input_file_name())
    raw = raw.withColumn("id", F.col("hotel_id").try_cast("bigint"))
    bad = F.col("_corrupt").isNotNull() | F.col("id").isNull()
    rejected = raw.where(bad).select("file", "hotel_id", F.when(F.col("_corrupt").isNotNull(), "unreadable").otherwise("no id").alias("reason"))
    good = raw.where(~bad).drop("_corrupt", "hotel_id")
    names = [c for c in good.columns if c not in ("id", "file")]
    once = good.groupBy("id").agg(F.min_by(F.struct(*names), "file").alias("r"))
    return once.select("id", "r.*"), rejected


def to_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The serving tables hotels, rooms, nearby_places and activities of nested records."""
    amenities = V.union_all(F.col("amenities"), F.col("amenities_general"), F.col("amenities_leisure"), F.col("amenities_dining"), F.flatten(F.map_values("amenity_groups")))
    hotels = records.select("id", "name", "accommodation_type", V.lenient_float(F.col("star_rating")).cast("decimal(3,1)").alias("star_rating"), "is_luxury", "address", "city", "area", "country", "latitude", "longitude", F.col("review_score").cast("decimal(3,1)").alias("review_score"), "review_count", "description", amenities.alias("amenities"), V.text_list(F.col("suitable_for")).alias("suitable_for"), F.to_json("useful_info").alias("useful_info"), F.to_json("reviews_detail").alias("reviews_detail"), V.text_list(F.col("policy_notes")).alias("policy_notes"), F.to_json("faq").alias("faq"), F.transform("images", lambda i: i["url"]).alias("images"), "source_url")
    at = lambda c: records.select(F.col("id").alias("hotel_id"), F.posexplode(c).alias("seq", "x"))
    number = F.coalesce(V.lenient_float(F.col("x.price_per_night")), V.digits(F.col("x.price_per_night")).cast("double"))
    rooms = at("rooms").select("hotel_id", "seq", "x.room_type_id", "x.name", number.cast("decimal(15,2)").alias("price"), "x.room_size", "x.max_occupancy", "x.bed_type", "x.room_view", V.text_list(F.col("x.room_amenities")).alias("room_amenities"), "x.images", F.col("x.review_score").cast("decimal(3,1)").alias("review_score"))
    nearby = at("nearby_places").select("hotel_id", "seq", "x.name", "x.type", F.col("x.distance_km").cast("decimal(6,2)").alias("distance_km"))
    activities = at("activities").select("hotel_id", "seq", "x.activity_id", "x.title", "x.description", F.col("x.price.display.perBook.total.allInclusive.chargeTotal").cast("decimal(15,2)").alias("price_amount"), F.col("x.review_score").cast("decimal(3,1)").alias("review_score"))
    return {"hotels": hotels, "rooms": rooms, "nearby_places": nearby, "activities": activities}


def _lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line, r) of the lines of JSON files that aren't blank; ``r._corrupt`` is set where a line can't be parsed."""
    text = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return text.select(F.input_file_name().alias("file"), F.col("value").alias("line"), parsed.alias("r"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank lines are left out, lines that can't be parsed are in ``rejected_lines``."""
    rows = _lines(spark, path, schema).where(F.col("r._corrupt").isNull())
    return rows.select("r.*").drop("_corrupt")


def rejected_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line) of the lines that ``read_lines`` can't parse."""
    return _lines(spark, path, schema).where(F.col("r._corrupt").isNotNull()).select("file", "line")


def read_golden(spark: SparkSession, path: str, smoke: bool = False) -> DataFrame:
    """Golden queries; those without relevant ids only in a smoke run."""
    schema = "queries array<struct<query_id:string,query:string,intent_type:string,relevant_hotel_ids:array<bigint>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.inline("queries"))
    return rows if smoke else rows.where(F.size("relevant_hotel_ids") > 0)


def file_ids(df: DataFrame, pattern: str = r"(\d+)") -> DataFrame:
    """The id in the name of the file a row comes from."""
    return df.withColumn("file_id", F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), pattern, 1).try_cast("bigint"))


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(concept_id, facet, label_vi, label_en, surface_forms, parent) of a YAML or JSON file of concepts by id. A dimension:
    the driver parses it."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading YAML needs the package yaml; JSON needs none") from e
        data = yaml.safe_load(text)
    rows = []
    for key, c in (data.get("concepts", data) or {}).items():
        label, forms = c.get("label") or {}, c.get("surface_forms") or {}
        rows.append((key, c.get("facet"), label.get("vi"), label.get("en"), [*forms.get("vi", []), *forms.get("en", [])], c.get("parent")))
    return spark.createDataFrame(rows, "concept_id string, facet string, label_vi string, label_en string, surface_forms array<string>, parent string")


_HEAD = re.compile(r"^###\s+(Q[\w-]+)\s+[—–-]+\s+(.*)$")


def read_golden_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, title, body) of headings ``### Q1-2 — title``, each with the JSON of its first fenced block, comments out."""
    rows, head, block, inside = [], None, [], False
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if m := _HEAD.match(line):
            head, block, inside = (m[1], m[2].strip()), [], False
        elif line.startswith("```"):
            if inside and head:
                plain = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda x: x[1] or "", "\n".join(block), flags=re.S)
                rows.append((*head, json.dumps(json.loads(plain), ensure_ascii=False)))
                head = None
            inside = not inside
        elif inside:
            block.append(line)
    return spark.createDataFrame(rows, "query_id string, title string, body string")
