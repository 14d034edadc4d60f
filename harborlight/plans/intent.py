"""Free-text requests as filters, concepts, an expanded text and a confidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, number_after, pattern_rules
from ..functions.values import lookup_number
from ..operators.mining import greedy_concepts

#: Numbers that a request may name: the pattern's first group is the number.
NUMBERS = {"star_min": r"(?i)([0-9](?:[.,][0-9])?)\s*(?:sao|stars?)(?![\p{L}])", "review_min": r"(?i)([0-9]+(?:[.,][0-9])?)\s*(?:điểm|points?)(?![\p{L}])", "km_max": r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*km(?![\p{L}])"}
#: What each kind of finding adds to the confidence, out of three.
WEIGHTS = {"place": 1.0, "kinds": 1.0, "amenity": 1.0, "star_min": 0.5, "review_min": 0.5, "price": 0.3}
# Words before a sum of money, and what its units are worth.
CUES = {"max": "dưới|duoi|không quá|khong qua|tối đa|toi da|under|below|up to|<", "min": "trên|tren|từ|tu|over|above|from|>", "about": "khoảng|khoang|tầm|tam|cỡ|xấp xỉ|around|about"}
UNITS = {"triệu": 1e6, "trieu": 1e6, "tr": 1e6, "million": 1e6, "nghìn": 1e3, "nghin": 1e3, "k": 1e3, "000": 1e3}
#: How far a sum that is only about right reaches to both sides.
ABOUT = 0.3


# What people say of their company or purpose, folded; the first group of words that a request has is the evidence.
_HOW_MANY = "(?:[0-9]{1,2}|mot|hai|ba|bon|nam|sau|bay|vai|may|dua|nhung)"
PURPOSES = {
    "PURPOSE_FAMILY": rf"{_HOW_MANY} +(?:con|be|chau|nhoc|em be|tre|nho)\b|\b(?:co con|vo con|chong con|con nho|con cai|em be|tre nho|tui nho|bon tre|cac be)\b",
    "PURPOSE_ROMANTIC": r"\b(?:(?:hai )?vo chong(?: son| tre)|hai vo chong|voi (?:nguoi yeu|ban gai|ban trai)|ky niem (?:ngay )?cuoi|di hen ho|hai dua)\b",
    "PURPOSE_GROUP": r"\b(?:(?:nhom|dam|hoi) ban|ca (?:nhom|hoi)|di voi ban be|(?:nhom|doan) [0-9]+ nguoi|[0-9]+ dua ban|team building)\b",
    "PURPOSE_BUSINESS": r"\b(?:(?:di|chuyen) cong tac|(?:du|di) hoi (?:nghi|thao)|di hop|di cong chuyen)\b",
    "PURPOSE_WELLNESS": r"\b(?:(?:can|muon) nghi ngoi|xa (?:stress|hoi)|(?:an|tinh) duong|duong suc)\b",
}


def purposes(text: Column) -> Column:
    """The purposes that a request's folded text speaks of, each with the words that say so; an empty map for no text."""
    plain = F.regexp_replace(fold(text, False), r"\s+", " ")
    found = F.array(*(F.struct(F.lit(k).alias("key"), F.nullif(F.trim(F.regexp_extract(plain, p, 0)), F.lit("")).alias("value")) for k, p in PURPOSES.items()))
    return F.map_from_entries(F.filter(found, lambda e: e["value"].isNotNull()))


def _money(text: Column, cue: str) -> Column:
    """The sum of money after a cue, in units of one; a bare number has four digits or more."""
    units = "|".join(UNITS)
    pattern = rf"(?i)(?<![\p{{L}}])(?:{CUES[cue]})\s*([0-9]+(?:[.,][0-9]+)*)\s*({units})(?![\p{{L}}\p{{N}}])"
    bare = rf"(?i)(?<![\p{{L}}])(?:{CUES[cue]})\s*([0-9]{{4,}})(?![\p{{L}}\p{{N}}.,])"
    worth = lookup_number(F.lower(F.regexp_extract(text, pattern, 2)), UNITS)
    return F.coalesce(number_after(text, pattern) * worth, number_after(text, bare))


def prices(text: Column) -> list[Column]:
    """The price_min and price_max a text names with its units; a sum that is about right gives both ends, a limit alone one."""
    low, high, about = _money(text, "min"), _money(text, "max"), _money(text, "about")
    near = high.isNull() & low.isNull()
    return [F.coalesce(low, F.when(near, about * (1 - ABOUT))).alias("price_min"), F.coalesce(high, F.when(near, about * (1 + ABOUT))).alias("price_max")]


def without_budget(concepts: Column, text: Column, budget: str = "PRICE_BUDGET") -> Column:
    """The concepts without the one for cheap things where a text names its budget with a sum of money."""
    named = F.lower(text).rlike(r"(budget|ngân sách|ngan sach)[^0-9]{0,6}[0-9.,]+\s*(triệu|trieu|tr|k|nghìn|nghin|đồng|dong)")
    return F.when(named, F.array_remove(concepts, budget)).otherwise(concepts)


def numbers(text: Column, patterns: dict[str, str] | None = None) -> list[Column]:
    """The number of each pattern's first place; null where there is none."""
    return [number_after(text, p).alias(name) for name, p in (patterns or NUMBERS).items()]


def parse(requests: DataFrame, key: str, text: str, dictionary: DataFrame, labels: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(key, text, numbers, price_min, price_max, place, kinds, amenities, rules, filters, expanded, confidence) of every
    request.

    Concepts are found greedily, the longest forms first; ``labels`` (concept_id, facet, label) tells their facet: city,
    object for kinds of accommodation, amenity. The first place, the kinds and all amenities become filters beside the
    numbers and prices; ``filters`` has those that were found, as JSON. The expanded text has the labels of what was found.
    The confidence is the sum of the weights of what was found over three, 1 at most. Requests without text get nulls and
    confidence 0.
    """
    found = greedy_concepts(requests, key, text, dictionary).join(labels.select(F.col("concept_id").alias("concept"), "facet", "label"), "concept")
    each = found.groupBy(key).agg(
        F.array_min(F.collect_set(F.when(F.col("facet") == "city", F.col("concept")))).alias("place"),
        F.array_sort(F.collect_set(F.when(F.col("facet") == "object", F.col("concept")))).alias("kinds"),
        F.array_sort(F.collect_set(F.when(F.col("facet") == "amenity", F.col("concept")))).alias("amenities"),
        F.array_sort(F.collect_set("label")).alias("found_labels"),
    )
    base = requests.select(key, text, *numbers(F.col(text)), *prices(F.col(text)), pattern_rules(F.lower(text), rules or {}).alias("rules") if rules else F.array().cast("array<string>").alias("rules"))
    empty = F.array().cast("array<string>")
    out = base.join(each, key, "left").withColumn("amenities", F.coalesce("amenities", empty)).withColumn("kinds", F.coalesce("kinds", empty))
    priced = F.col("price_min").isNotNull() | F.col("price_max").isNotNull()
    seen = {"place": F.col("place").isNotNull(), "kinds": F.size("kinds") > 0, "amenity": F.size("amenities") > 0, "price": priced, **{n: F.col(n).isNotNull() for n in NUMBERS}}
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    filters = F.to_json(F.struct("place", some("kinds"), some("amenities"), *NUMBERS, "price_min", "price_max"))
    total = sum((F.when(seen[k], F.lit(w)).otherwise(0.0) for k, w in WEIGHTS.items()), F.lit(0.0))
    expanded = F.array_join(F.concat(F.array(F.coalesce(text, F.lit(""))), F.coalesce("found_labels", F.array().cast("array<string>"))), " ")
    return out.select(key, text, *NUMBERS, "price_min", "price_max", "place", "kinds", "amenities", "rules", filters.alias("filters"), F.trim(expanded).alias("expanded"), F.bround(F.least(F.lit(1.0), total / 3), 2).alias("confidence"))


def merge_filters(parsed: dict, asked: dict | None) -> dict:
    """Filters of a request as parsed, overridden by those that were asked for; empty ones don't count."""
    given = {k: v for k, v in (asked or {}).items() if v not in (None, "", [], {})}
    return {**{k: v for k, v in parsed.items() if v not in (None, "", [], {})}, **given}


def check_request(top_k: int = 10, page: int = 0, mode: str = "full_hybrid", tokens: int = 2_000, modes: Sequence[str] = ("full_hybrid", "bm25_only", "vector_only", "hybrid_no_rerank")) -> None:
    """Raises ValueError for bounds that a request breaks."""
    if not 1 <= top_k <= 50 or page < 0 or mode not in modes or not 100 <= tokens <= 8_000:
        raise ValueError("top_k is 1..50, page 0 or more, mode one of those known, tokens 100..8000")
