"""Problem 6: the top N rows of every group by a global sort with prefix-summed positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..tables import cut_lineage, free_name


def _differs(col: pa.ChunkedArray | pa.Array, last: pa.Scalar | None) -> np.ndarray:
    """For each row, whether its value isn't that of the row before (``last`` before the first)."""
    first = True if last is None else bool(last.as_py() != col[0].as_py())
    rest = pc.not_equal(col.slice(1), col.slice(0, len(col) - 1))
    rest = rest.combine_chunks() if isinstance(rest, pa.ChunkedArray) else rest
    return np.concatenate([[first], rest.to_numpy(zero_copy_only=False).astype(bool)])


def _positions(groups: Sequence[str], keys: Sequence[str], n: int, pos: str, pid: str, size: str, schema: pa.Schema):
    """Counts each group's rows along one sorted partition.

    A row within the first ``n`` of its group here is passed on with its local position; besides, the partition's last
    group leaves one marker row (position 0) with its number of rows, all that later partitions need to know.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: dict[str, pa.Scalar] = {}
        seen, tail = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            new_group = np.zeros(t.num_rows, bool)
            for g in groups:
                new_group |= _differs(t[g].combine_chunks(), last.get(g))
            new_row = new_group.copy()
            for k in keys:
                new_row |= _differs(t[k].combine_chunks(), last.get(k))
            last = {c: t[c][t.num_rows - 1] for c in {*groups, *keys}}
            t, new_group = t.filter(pa.array(new_row)), new_group[new_row]  # a row delivered again stands beside itself
            if not t.num_rows:
                continue
            at = np.arange(t.num_rows)
            start = np.maximum.accumulate(np.where(new_group, at, -1))
            local = np.where(start < 0, seen + at + 1, at - start + 1)
            seen, tail = int(local[-1]), t.slice(t.num_rows - 1)
            keep = local <= n
            t = t.filter(pa.array(keep))
            yield from _out(t, local[keep], part, 0, schema, pos, pid, size)
        if tail is not None:
            yield from _out(tail, np.zeros(1, np.int64), part, seen, schema, pos, pid, size)

    return run


def _out(t: pa.Table, local: np.ndarray, part: int, seen: int, schema: pa.Schema, pos: str, pid: str, size: str) -> list[pa.RecordBatch]:
    t = t.append_column(pos, pa.array(local, pa.int64())).append_column(pid, pa.array(np.full(len(local), part), pa.int32())).append_column(size, pa.array(np.full(len(local), seen), pa.int64()))
    return t.cast(schema).to_batches()


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[Column], unique: Sequence[str], n: int, position: str = "position", partitions: int | None = None) -> DataFrame:
    """The first ``n`` rows of every group, with their exact ``position`` from 1.

    All rows are range-partitioned and sorted on group, order and ``unique``, so a group of any size is spread over as
    many partitions as it needs. Positions are counted along each partition; a partition's last group may go on in the
    next ones, so its count (one row a partition) is prefix-summed and added there. Only rows whose local position is
    ``n`` at most are kept on the way, a necessary condition.

    Rows with a null in a group column take no part. Rows that repeat group and ``unique`` and stand beside each other in
    the order count once, so ``unique`` names all that tells rows apart, such as the score and the identifier.
    Ties in ``order`` go by ``unique`` ascending, so the result is deterministic. Smaller groups give all their rows; an
    empty table gives an empty one. Other columns are carried along, whatever their names.
    """
    spark = df.sparkSession
    pos, pid, size = (free_name(df, c) for c in ("__pos", "__pid", "__size"))
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = F.lit(True)
    for g in group:
        some &= F.col(g).isNotNull()
    by = [F.col(g).asc() for g in group] + list(order) + [F.col(u).asc() for u in unique]
    ordered = df.where(some).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    schema = T.StructType([*df.schema.fields, T.StructField(pos, T.LongType()), T.StructField(pid, T.IntegerType()), T.StructField(size, T.LongType())])
    # Range bounds come from a sample, another one each time the sort is planned, so the counted rows (already cut to n a
    # group and partition) are written once and both uses below read the same partitions.
    counted = cut_lineage(ordered.mapInArrow(_positions(list(group), list(unique), n, pos, pid, size, to_arrow_schema(schema)), schema))

    # one row a partition: what its last group brings along for the partitions after it
    tails = counted.where(F.col(pos) == 0).select(*group, F.col(pid).alias("__from"), F.col(size).alias("__count"))
    rows = counted.where(F.col(pos) > 0)
    firsts = rows.groupBy(*group, pid).agg(F.lit(0).alias("__one")).join(F.broadcast(tails), list(group)).where(F.col("__from") < F.col(pid))
    shift = firsts.groupBy(*group, pid).agg(F.sum("__count").alias("__shift"))
    exact = rows.join(F.broadcast(shift), [*group, pid], "left").withColumn(position, F.col(pos) + F.coalesce(F.col("__shift"), F.lit(0)))
    return exact.where(F.col(position) <= n).select(*df.columns, position)


def p6_found(spark, sf_dir: str) -> DataFrame:
    """The 3 best rooms of each hotel and the 10 best hotels of each accommodation type."""
    from ..tables import table

    rooms = table(spark, sf_dir, "rooms").where("review_score is not null").select("hotel_id", "id", "review_score")
    hotels = table(spark, sf_dir, "hotels").where("review_score is not null").select("accommodation_type", "id", "review_score")
    best = F.col("review_score").desc()
    a = top_n(rooms, ["hotel_id"], [best], ["review_score", "id"], 3)
    b = top_n(hotels, ["accommodation_type"], [best], ["review_score", "id"], 10)
    row = lambda kind, g: (F.lit(kind).alias("kind"), F.col(g).cast("string").alias("group_key"), F.col("id").alias("item_id"))
    return a.select(*row("room", "hotel_id")).unionAll(b.select(*row("hotel", "accommodation_type")))
