"""Functions on numbers, arrays, maps and JSON."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lenient_float(text: Column) -> Column:
    """The number a text holds, a comma taken for a point; null if it holds none."""
    return F.trim(F.replace(text.cast("string"), F.lit(","), F.lit("."))).try_cast("double")


def lenient_int(text: Column) -> Column:
    return lenient_float(text).try_cast("bigint")


def digits(text: Column) -> Column:
    """The number of a text's digits alone; null if there are none or if they don't fit."""
    return F.nullif(F.regexp_replace(text.cast("string"), "[^0-9]", ""), F.lit("")).try_cast("decimal(38,0)")


def zero_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(0).cast("double"))


def wilson(positive: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of the share of positives with n votes; 0 for none."""
    p = positive / n
    centre, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (centre - spread) / (1 + z * z / n)))


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double; null if the lengths differ or an element is null."""
    return F.when(F.size(a) == F.size(b), F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def unit(v: Column) -> Column:
    """The vector scaled to length 1; the zero vector as it is."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


def has_all(values: Column, wanted: list) -> Column:
    """Whether an array holds every wanted value; false for no array."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, wanted)), values)) == 0, F.lit(False)) if wanted else F.lit(True)


def has_any(values: Column, wanted: list) -> Column:
    """Whether an array holds one of the wanted values; false, not null, for no array or null elements."""
    return F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(False)


def text_list(values: Column) -> Column:
    """Trimmed texts without empty ones and nulls; an empty array for no array."""
    return F.coalesce(F.filter(F.transform(values, lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != "")), F.array().cast("array<string>"))


def union_all(*arrays: Column) -> Column:
    """The distinct values of all arrays, sorted; no array counts as an empty one."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*(text_list(a) for a in arrays)))))


def with_prefix(values: Column, *prefixes: str) -> Column:
    """The values that begin with one of the prefixes."""
    return F.filter(values, lambda v: reduce(Column.__or__, (v.startswith(p) for p in prefixes)))


def drop_nulls(entries: Column) -> Column:
    """A map without the entries that hold null."""
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def map_lines(entries: Column) -> Column:
    """``key: value`` of a map's entries whose value isn't null, by key."""
    return F.transform(F.array_sort(F.filter(F.map_entries(entries), lambda e: e["value"].isNotNull())), lambda e: F.concat_ws(": ", e["key"], e["value"]))


def first_path(json: Column, *paths: str) -> Column:
    """The first path of a JSON text that holds something."""
    return F.coalesce(*(F.get_json_object(json, p) for p in paths))


def first_positive(values: Column) -> Column:
    """The smallest positive number of an array; null if there is none."""
    return F.array_min(F.filter(values, lambda x: x > 0))


def ladder(*steps: tuple[Column, object], otherwise: object = None) -> Column:
    """The value of the first condition that holds."""
    first, *rest = steps
    return reduce(lambda w, s: w.when(s[0], F.lit(s[1])), rest, F.when(first[0], F.lit(first[1]))).otherwise(F.lit(otherwise))


def lookup(key: Column, values: dict[str, str], default: str | None = None) -> Column:
    """A small fixed map; the default for keys it hasn't."""
    if not values:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key), F.lit(default))


def lookup_number(key: Column, values: dict[str, float]) -> Column:
    """The number of a small fixed map; null for keys it hasn't."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _counts(buckets: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else np.bincount(b, minlength=n).astype(float) for b, n in zip(buckets, size)])


def hashed(words: Column, size: int = 256) -> Column:
    """How many of the words fall into each of ``size`` buckets by their hash; a stand-in for an embedding."""
    return _counts(F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(size)).cast("int")), F.lit(size))
