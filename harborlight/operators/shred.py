"""Problem 2: nested JSON records as adjacency tables and flat entity tables."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import table, write_shared

_SEP = "\x1f"


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON")


def parse(text: str | None):
    """The object or array that a text is, however often it is encoded as a JSON string; None if it is none.

    Text nested deeper than Python's parser can follow (some tens of thousands of levels) counts as not valid.
    """
    while isinstance(text, str):
        head = text.lstrip(" \t\n\r")[:1]
        if not head or head not in '{["':
            return None
        try:
            value = json.loads(text, parse_constant=_refuse)
        except (ValueError, RecursionError):
            return None
        if isinstance(value, (dict, list)):
            return value
        text = value  # a decoded string is shorter than its encoding
    return None


def shred_value(field: str, value, first: int) -> Iterator[tuple]:
    """Adjacency rows of one parsed field, without recursion, their numbers counted from ``first``:
    (node, parent, owner, depth, kind, label, ordinal, scalar, shape, step, alone).

    ``owner`` is the nearest enclosing object, -1 if there is none, and ``depth`` the number of objects around the node.
    Objects have a ``shape``, their labels from the field on, a ``step``, their path from the owner on, and tell whether
    they stand ``alone`` where other records may have an array.
    """
    stack, n = [(value, -1, -1, 0, field, None, field, field)], first
    while stack:
        v, parent, owner, depth, label, ordinal, shape, step = stack.pop()
        if isinstance(v, str) and (inner := parse(v)) is not None:
            v = inner
        node, n = n, n + 1
        if isinstance(v, dict):
            yield node, parent, owner, depth, "object", label, ordinal, None, shape, step, ordinal is None
            stack += [(x, node, node, depth + 1, k, None, f"{shape}{_SEP}{k}", f".{k}") for k, x in v.items()]
        elif isinstance(v, list):
            yield node, parent, owner, depth, "array", label, ordinal, None, None, None, None
            stack += [(x, node, owner, depth, label, i, shape, f"{step}[{i}]") for i, x in enumerate(v)]
        else:
            scalar = None if v is None else v if isinstance(v, str) else json.dumps(v)
            yield node, parent, owner, depth, "scalar", label, ordinal, scalar, None, None, None


_SCHEMA = pa.schema(
    [("rec", pa.int64()), ("id", pa.int64()), ("field", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("owner", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("label", pa.string()), ("ordinal", pa.int32()), ("scalar", pa.string()), ("shape", pa.string()), ("step", pa.string()), ("alone", pa.bool_())]
)
_DDL = "rec long, id long, field string, node int, parent int, owner int, depth int, kind string, label string, ordinal int, scalar string, shape string, step string, alone boolean"


def _rows(fields: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for rec, key, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                first = 0
                for field, text in zip(fields, texts):
                    if (value := parse(text)) is None:
                        continue
                    for row in shred_value(field, value, first):
                        rows.append((rec, key, field, *row))
                        if len(rows) > 20_000:
                            yield _batch(rows)
                            rows = []
                        first = row[0] + 1
            if rows:
                yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def adjacency(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The adjacency table of the JSON texts in ``fields``, written to the shared folder: one row per node, with its record,
    number, parent, label, ordinal within an array and scalar; see ``shred_value`` for the rest.

    Every text is parsed once. Null and blank texts, texts that aren't valid JSON and bare scalars give no rows; a text
    that is itself JSON counts as its value, however often encoded. A repeated member name counts with its last value.
    Rows that repeat a key are records of their own. Rows with a null key give nothing.
    """
    some = df.where(F.col(key).isNotNull()).select(F.monotonically_increasing_id(), F.col(key).cast("long"), *(F.col(f).cast("string") for f in fields))
    return write_shared(some.mapInArrow(_rows(fields), _DDL), "adjacency")


#: Shapes up to which the list of those that are arrays elsewhere goes with the plan; beyond it, it is joined.
MOST_SHAPES = 5_000


def objects(nodes: DataFrame) -> DataFrame:
    """(rec, id, node, shape, path, parent_path): the objects of an adjacency table, their paths joined along its links.

    An object that stands alone where other records have an array of objects counts as that array's [0]. Each round joins
    every object with the one its path so far starts at, so paths double in length: nesting of depth d takes log2(d) joins
    on record and node, in which an object meets one other at most.
    """
    own = nodes.where("kind = 'object'")
    shapes = own.groupBy("shape").agg(F.bool_or(~F.col("alone")).alias("array"), F.bool_or("alone").alias("lone"), F.max("depth").alias("depth"))
    mixed = shapes.where("array and lone").select("shape")
    few = [r.shape for r in mixed.limit(MOST_SHAPES + 1).collect()]
    deepest = shapes.agg(F.max("depth")).first()[0] or 0
    if len(few) <= MOST_SHAPES:
        own = own.withColumn("listed", F.col("shape").isin(few) if few else F.lit(False))
    else:
        own = own.join(mixed.withColumn("listed", F.lit(True)), "shape", "left")
    step = F.when(F.col("alone") & F.col("listed"), F.concat("step", F.lit("[0]"))).otherwise(F.col("step"))
    out = own.select("rec", "id", "node", "shape", "owner", step.alias("path"), F.char_length(step).alias("n"))
    for _ in range(deepest.bit_length()):
        head = out.select("rec", F.col("node").alias("owner"), F.col("owner").alias("above"), F.col("path").alias("head"))
        out = out.join(head, ["rec", "owner"], "left").select("rec", "id", "node", "shape", F.coalesce("above", F.lit(-1)).alias("owner"), F.concat(F.coalesce("head", F.lit("")), "path").alias("path"), "n")
    return out.select("rec", "id", "node", "shape", "path", F.expr("left(path, char_length(path) - n)").alias("parent_path"))


def entity_table(nodes: DataFrame, pattern: str, members: Sequence[str]) -> DataFrame:
    """The flat table of the objects whose path matches ``pattern``, tied to their record and parent object.

    (rec, id, path, parent_path, one text column per member): object nodes are joined with their scalar children on record
    and node, and the children's labels are pivoted. Members that an object lacks, or that are null or nested, are null. An
    entity without any of them keeps its row.
    """
    own = objects(nodes).where(F.col("path").rlike(pattern))
    children = nodes.where((F.col("kind") == "scalar") & F.col("label").isin(*members) & F.col("ordinal").isNull()).groupBy("rec", F.col("parent").alias("node")).agg(*(F.max(F.when(F.col("label") == m, F.col("scalar"))).alias(m) for m in members))
    return own.join(children, ["rec", "node"], "left").select("rec", "id", "path", "parent_path", *members)


def filled(nodes: DataFrame) -> DataFrame:
    """The objects that have a child."""
    return objects(nodes).join(nodes.where("parent >= 0").select("rec", F.col("parent").alias("node")), ["rec", "node"], "left_semi")


_FIELDS = ("useful_info", "faq", "reviews_detail")


def _out() -> list:
    return [F.col("id").alias("hotel_id"), F.col("path").alias("node"), F.col("parent_path").alias("parent")]


def p2_found(spark, sf_dir: str) -> DataFrame:
    """Path and parent path of every non-empty object in useful_info, faq and reviews_detail."""
    return filled(adjacency(table(spark, sf_dir, "hotels"), "id", _FIELDS)).select(*_out()).distinct()


def _entities(spark, sf_dir: str, field: str, pattern: str, members: Sequence[str]) -> DataFrame:
    hotels = table(spark, sf_dir, "hotels").select("id", field)
    return entity_table(adjacency(hotels, "id", [field]), pattern, members).select(*_out(), *members).distinct()


def p2_faq(spark, sf_dir: str) -> DataFrame:
    """Questions and follow-up questions of hotels as a flat table."""
    return _entities(spark, sf_dir, "faq", r"^faq\[\d+\](\.followups\[\d+\])*$", ["question", "answer", "category"])


def p2_comments(spark, sf_dir: str) -> DataFrame:
    """Sample comments of hotels as a flat table."""
    return _entities(spark, sf_dir, "reviews_detail", r"sample_comments\[\d+\]$", ["review_id", "rating", "title", "text"])


def p2_members(spark, sf_dir: str) -> DataFrame:
    """Every entity of the three fields in one flat table: its shape (labels from the field on) and its scalar members as
    pivoted label-value pairs in the order of their labels. Nested members are rows of their own, so are empty objects."""
    nodes = adjacency(table(spark, sf_dir, "hotels"), "id", _FIELDS)
    pair = F.struct("label", F.coalesce("scalar", F.lit("null")).alias("value"))
    children = nodes.where("kind = 'scalar' and ordinal is null and parent >= 0").groupBy("rec", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list(pair)).alias("members"))
    flat = objects(nodes).join(children, ["rec", "node"], "left")
    return flat.select(*_out(), F.translate("shape", _SEP, ".").alias("entity"), F.to_json("members").alias("members")).distinct()
