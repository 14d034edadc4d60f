"""Chunkers: sentences packed by characters or by words with overlap, sections, and one chunk per fact of a record."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_space, context_prefix, join_non_empty, sentences, short_hash, word_count
from ..functions.values import text_list
from ..operators import shred
from ..operators.relational import first_wins


def pack_characters(text: Column, limit: int = 1000) -> Column:
    """Sentences packed greedily into chunks of at most ``limit`` characters; a longer sentence is a chunk of its own.

    White space counts as one space. One fold over the sentences in the JVM; a text within the limit is one chunk. Null and blank texts give no chunk.
    """
    state = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def add(s: Column, p: Column) -> Column:
        full = (s["buf"] != "") & (F.char_length(s["buf"]) + F.char_length(p) + 1 > limit)
        return F.struct(F.when(full, F.array_append(s["out"], s["buf"])).otherwise(s["out"]).alias("out"), F.when(full | (s["buf"] == ""), p).otherwise(F.concat_ws(" ", s["buf"], p)).alias("buf"))

    whole = F.trim(F.regexp_replace(text, r"\s{2,}|[\t-\r]", " "))
    packed = F.aggregate(sentences(whole), state, add, lambda s: F.filter(F.array_append(s["out"], s["buf"]), lambda c: c != ""))
    return F.when(whole.isNull() | (whole == ""), F.array().cast("array<string>")).when(F.char_length(whole) <= limit, F.array(whole)).otherwise(packed)


def pack_words(text: Column, target: int = 300, overlap: int = 40) -> Column:
    """Sentences packed greedily into chunks of about ``target`` words; each chunk after the first begins with the last
    sentences of the one before that have ``overlap`` words together at most."""
    empty = F.array().cast("array<string>")
    state = F.struct(empty.alias("out"), empty.alias("cur"), F.lit(0).alias("n"))
    count = lambda a: F.aggregate(a, F.lit(0), lambda x, t: x + word_count(t))

    def tail(cur: Column) -> Column:
        kept = F.aggregate(F.reverse(cur), F.struct(empty.alias("a"), F.lit(0).alias("n"), F.lit(True).alias("go")), lambda s, p: F.struct(F.when(s["go"] & (s["n"] + word_count(p) <= overlap), F.array_prepend(s["a"], p)).otherwise(s["a"]).alias("a"), F.when(s["go"] & (s["n"] + word_count(p) <= overlap), s["n"] + word_count(p)).otherwise(s["n"]).alias("n"), (s["go"] & (s["n"] + word_count(p) <= overlap)).alias("go")))
        return kept["a"]

    def add(s: Column, p: Column) -> Column:
        full = (F.size(s["cur"]) > 0) & (s["n"] + word_count(p) > target)
        cur = F.when(full, tail(s["cur"])).otherwise(s["cur"])
        return F.struct(F.when(full, F.array_append(s["out"], F.array_join(s["cur"], " "))).otherwise(s["out"]).alias("out"), F.array_append(cur, p).alias("cur"), (F.when(full, count(tail(s["cur"]))).otherwise(s["n"]) + word_count(p)).alias("n"))

    return F.coalesce(F.aggregate(sentences(text, True), state, add, lambda s: F.filter(F.array_append(s["out"], F.array_join(s["cur"], " ")), lambda c: c != "")), empty)


_HEADING = r"^(#{1,6})\s+(\S.*)$"


def sections(df: DataFrame, key: str, text: str, untitled: str = "Document") -> DataFrame:
    """(key, section, breadcrumb, body) of Markdown texts: one row per heading with a body, numbered in order, its headings
    joined by ' > '; headings of one name that come twice are two sections.

    The text is split at its headings, and a fold over these, not over the lines, keeps those open; a heading closes those
    of its level and below. What stands before the first heading is called ``untitled``. Null texts give no rows.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<struct<breadcrumb:string,body:string>>").alias("out"), empty.alias("path"))

    def step(s: Column, part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        n, title = F.char_length(F.regexp_extract(head, _HEADING, 1)), F.trim(F.regexp_extract(head, _HEADING, 2))
        opened = F.when(n > 0, F.concat(F.slice(s["path"], 1, F.greatest(n - 1, F.lit(0))), F.array(title))).otherwise(s["path"])
        body = F.when(n > 0, F.substring(part, F.char_length(head) + 1, F.char_length(part))).otherwise(part)
        crumb = F.when(F.size(opened) > 0, F.array_join(opened, " > ")).otherwise(F.lit(untitled))
        return F.struct(F.array_append(s["out"], F.struct(crumb.alias("breadcrumb"), clean_space(body).alias("body"))).alias("out"), opened.alias("path"))

    plain = F.regexp_replace(F.col(text), r"\r\n?", "\n")
    parts = F.split(plain, r"(?:^|(?<=\n))(?=#{1,6}[^\S\n]+\S)")
    rows = df.where(F.col(text).isNotNull()).select(key, F.posexplode(F.aggregate(parts, start, step, lambda s: s["out"])).alias("section", "s"))
    return rows.where("s.body <> ''").select(key, "section", "s.breadcrumb", "s.body")


def numbered(df: DataFrame, owner: str, kind: str, code: str, texts: Column, record: Column, section: str, name: str, first: Column | None = None) -> DataFrame:
    """Chunks of one kind: (chunk_id, owner, source_type, record_id, seq, text, embed_text); ``seq`` counts from ``first``, 1
    if it isn't given."""
    at = df.select(owner, name, record.cast("long").alias("record_id"), (first if first is not None else F.lit(1)).alias("_first"), F.posexplode(texts).alias("at", "text")).where("text <> ''")
    seq = (F.col("at") + F.col("_first")).cast("int")
    return at.select(F.concat_ws("-", F.lit("chunk"), F.col(owner).cast("string"), F.lit(code), F.col("record_id").cast("string"), F.format_string("%03d", seq)).alias("chunk_id"), owner, F.lit(kind).alias("source_type"), "record_id", seq.alias("seq"), "text", context_prefix(F.col("text"), F.col(name), F.lit(section)).alias("embed_text"))


#: Reviews of one record that become chunks; the further ones are left to the review chunker.
REVIEWS = 8


def room_text(room: str = "room") -> Column:
    """A room in one line: name, size, bed, view, guests, amenities, without what is missing."""
    has = lambda before, c, after="": F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(before), F.trim(F.col(c).cast("string")), F.lit(after)))
    things = F.array_join(text_list(F.col("room_amenities")), ", ")
    return join_non_empty(". ", F.col(room), has("diện tích ", "room_size"), has("giường ", "bed_type"), has("hướng ", "room_view"), has("tối đa ", "max_occupancy", " khách"), F.when(things != "", F.concat(F.lit("tiện nghi phòng: "), things)))


def hotel_chunks(hotels: DataFrame, rooms: DataFrame, nearby: DataFrame, activities: DataFrame, limit: int = 1000) -> DataFrame:
    """The chunks of hotels, one projection per kind and a union: description, amenities, policies and useful information,
    rooms, nearby places, activities, questions and the first REVIEWS sample reviews. Rows delivered again count once.

    Child tables bring their hotel's name along by a join. The nested fields are shredded once into an adjacency table; the
    questions, facts and reviews are its entities. Fields that aren't valid JSON give no chunks.
    """
    fields = ["useful_info", "faq", "reviews_detail"]
    h = first_wins(hotels.where("id is not null").select(F.col("id").alias("hotel_id"), "name", "description", "amenities", "policy_notes", *fields, "crawled_at"), ["hotel_id"], ["crawled_at"])
    names = h.select("hotel_id", "name")
    none, one = F.lit(None).cast("long"), lambda c: F.filter(F.array(c), lambda t: t.isNotNull() & (t != ""))
    r = first_wins(rooms.where("id is not null and hotel_id is not null").select("id", "hotel_id", F.col("name").alias("room"), "room_size", "bed_type", "room_view", "max_occupancy", "room_amenities", "crawled_at"), ["id"], ["crawled_at"]).join(names, "hotel_id")
    n = nearby.where("id is not null and hotel_id is not null").select("id", "hotel_id", F.col("name").alias("place"), "type", "distance_km").dropDuplicates(["id"]).join(names, "hotel_id")
    a = activities.where("id is not null and hotel_id is not null").select("id", "hotel_id", "title", "description").dropDuplicates(["id"]).join(names, "hotel_id")
    km = F.when(F.col("distance_km").isNotNull(), F.concat(F.lit(" — cách "), F.col("distance_km").cast("string"), F.lit(" km")))
    place = F.concat(F.coalesce("place", F.lit("")), F.when(F.col("type").isNotNull(), F.concat(F.lit(" ("), F.col("type"), F.lit(")"))).otherwise(F.lit("")), F.coalesce(km, F.lit("")))
    amenities = F.array_join(F.array_distinct(text_list(F.col("amenities"))), ", ")
    parts = [
        numbered(h, "hotel_id", "hotel_description", "desc", pack_characters(F.col("description"), limit), none, "Mô tả", "name"),
        numbered(h, "hotel_id", "amenity", "amen", one(F.when(amenities != "", F.concat(F.lit("Tiện nghi: "), amenities))), none, "Tiện nghi", "name"),
        numbered(h, "hotel_id", "policy", "policy", text_list(F.col("policy_notes")), none, "Chính sách", "name"),
        numbered(r, "hotel_id", "room_info", "room", one(room_text()), F.col("id"), "Phòng", "name"),
        numbered(n, "hotel_id", "nearby", "near", one(F.trim(place)), F.col("id"), "Địa điểm lân cận", "name"),
        numbered(a, "hotel_id", "activity", "act", one(join_non_empty(". ", F.col("title"), F.col("description"))), F.col("id"), "Hoạt động", "name"),
        *nested_chunks(h),
    ]
    return reduce(DataFrame.unionByName, parts)


def nested_chunks(h: DataFrame) -> list[DataFrame]:
    """The chunks of the nested fields of hotels (hotel_id, name, policy_notes, useful_info, faq, reviews_detail)."""
    nodes = shred.adjacency(h, "hotel_id", ["useful_info", "faq", "reviews_detail"])
    own = h.select(F.col("hotel_id").alias("id"), "name", F.size(text_list(F.col("policy_notes"))).alias("notes"))
    index = lambda pattern: F.regexp_extract("path", pattern, 1).try_cast("int")
    none = F.lit(None).cast("long")
    asked = shred.entity_table(nodes, r"^faq\[\d+\]$", ["question", "answer"]).withColumn("at", index(r"\[(\d+)\]$"))
    said = shred.entity_table(nodes, r"^reviews_detail\.sample_comments\[\d+\]$", ["title", "text", "positives", "negatives", "response"]).withColumn("at", index(r"\[(\d+)\]$")).where(F.col("at") < REVIEWS)
    facts = nodes.where("field = 'useful_info' and kind = 'scalar' and depth = 1 and ordinal is null and trim(scalar) <> ''").select("id", "label", "scalar")
    # useful information is numbered on after the notes, by its labels
    listed = facts.groupBy("id").agg(F.transform(F.array_sort(F.collect_set(F.struct("label", "scalar"))), lambda x: F.concat_ws(": ", x["label"], x["scalar"])).alias("facts"))
    out = []
    for rows, kind, code, section, text in ((asked, "faq", "faq", "Câu hỏi thường gặp", join_non_empty(". ", F.col("question"), F.col("answer"))), (said, "review", "review", "Đánh giá khách", join_non_empty(". ", *map(F.col, ("title", "text", "positives", "negatives", "response"))))):
        with_name = rows.join(own, "id").withColumnRenamed("id", "hotel_id")
        out.append(numbered(with_name, "hotel_id", kind, code, F.array(text), none, section, "name", F.col("at") + 1))
    out.append(numbered(listed.join(own, "id").withColumnRenamed("id", "hotel_id"), "hotel_id", "policy", "policy", F.col("facts"), none, "Thông tin hữu ích", "name", F.col("notes") + 1))
    return out


def review_text() -> Column:
    """A review in lines: title, text, what was good and what was bad."""
    said = lambda before, c: F.when(F.trim(F.col(c)) != "", F.concat(F.lit(before), F.trim(F.col(c))))
    return join_non_empty("\n", F.col("title"), F.col("text"), said("Diem tich cuc: ", "positives"), said("Diem tieu cuc: ", "negatives"))


def review_chunks(reviews: DataFrame, owner: str, review: str, least: int = 20) -> DataFrame:
    """(chunk_id, owner, review, text): one chunk per review of ``least`` characters or more; of those of an owner that read
    the same in lower case, the first by its id."""
    some = reviews.where(F.col(owner).isNotNull() & F.col(review).isNotNull()).select(owner, review, clean_space(review_text()).alias("text")).where(F.char_length("text") >= least)
    once = first_wins(some.withColumn("chunk_id", short_hash(F.concat_ws("|", F.col(owner).cast("string"), F.lit("review"), F.lower("text")))), [owner, "chunk_id"], [review, "text"])
    return once.select("chunk_id", owner, review, "text")


def cms_chunks(pages: DataFrame, key: str, title: str, text: str, target: int = 512, overlap: int = 40) -> DataFrame:
    """(chunk_id, key, section, breadcrumb, seq, text): the sections of pages, packed by words; the breadcrumb and the title
    stand before each chunk."""
    found = sections(pages.select(key, text), key, text).join(pages.select(key, title).dropDuplicates([key]), key)
    packed = found.select(key, title, "section", "breadcrumb", F.posexplode(pack_words(F.col("body"), target, overlap)).alias("seq", "piece"))
    whole = F.concat_ws("\n", F.nullif(join_non_empty(" — ", F.col(title), F.col("breadcrumb")), F.lit("")), F.col("piece"))
    return packed.select(short_hash(F.concat_ws("|", F.col(key).cast("string"), F.lit("cms"), F.col("section").cast("string"), F.col("seq").cast("string"), F.col("piece"))).alias("chunk_id"), key, "section", "breadcrumb", "seq", whole.alias("text"))


def source_kind(columns: Sequence[str]) -> Column:
    """review, cms or hotel by which of a record's members are there (P25): reviews and hotel_name, else a body."""
    there = lambda c: F.col(c).isNotNull() if c in columns else F.lit(False)
    return F.when(there("reviews") & there("hotel_name"), "review").when(there("body") | there("content") | there("document_id"), "cms").otherwise("hotel")


def metadata(df: DataFrame, drop: Sequence[str] = ("description", "description_full", "description_short", "embedding_text", "faq", "rooms", "activities", "reviews")) -> list[str]:
    """The columns that filters use: scalars and lists of scalars, but for texts to embed and names that begin with _."""
    plain = lambda t: not isinstance(t, (T.StructType, T.MapType, T.ArrayType))
    return [f.name for f in df.schema if f.name not in drop and not f.name.startswith("_") and (plain(f.dataType) or (isinstance(f.dataType, T.ArrayType) and plain(f.dataType.elementType)))]


def atomic_chunks(df: DataFrame, key: str, text: str, least: int = 20) -> DataFrame:
    """(chunk_id, key, text): whole texts of ``least`` characters or more, one per fingerprint (SHA-1 of the lower-case text),
    the smallest key first."""
    some = df.select(key, F.trim(text).alias("text")).where(F.col(key).isNotNull() & (F.char_length("text") >= least))
    return first_wins(some.withColumn("chunk_id", short_hash(F.lower("text"))), ["chunk_id"], [key, "text"]).select("chunk_id", key, "text")
