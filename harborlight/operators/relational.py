"""Filters, joins, aggregates, windows and set operations that the serving store and the mining share."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import has_all, has_any
from ..tables import cut_lineage


@dataclass(frozen=True)
class Range:
    """A closed range; an end that is None is open."""

    least: float | None = None
    most: float | None = None


def condition(equal: dict | None = None, among: dict[str, Sequence] | None = None, ranges: dict[str, Range] | None = None, any_of: dict[str, list] | None = None, all_of: dict[str, list] | None = None) -> Column | None:
    """One predicate from the filters that are given; None if none is. Nulls never satisfy a filter."""
    terms: list[Column] = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    terms += [F.col(c).isin(list(v)) for c, v in (among or {}).items() if v]
    for c, r in (ranges or {}).items():
        terms += [F.col(c) >= r.least] * (r.least is not None) + [F.col(c) <= r.most] * (r.most is not None)
    terms += [has_any(F.col(c), v) for c, v in (any_of or {}).items() if v]
    terms += [has_all(F.col(c), v) for c, v in (all_of or {}).items() if v]
    return reduce(Column.__and__, terms) if terms else None


def whitelist(items: DataFrame, key: str, where: Column | None, children: DataFrame | None = None, child_key: str = "", child_where: Column | None = None) -> DataFrame | None:
    """Keys of the items that pass the filters: None for no filter at all, which means the whole corpus, while no keys mean
    no results. Children's filters are an EXISTS, a semi-join below which their predicate is pushed."""
    if where is None and child_where is None:
        return None
    out = items.where(where) if where is not None else items
    if children is not None and child_where is not None:
        out = out.join(children.where(child_where).select(F.col(child_key).alias(key)), key, "left_semi")
    return out.select(key)


def restrict(df: DataFrame, keys: DataFrame | None, key: str) -> DataFrame:
    """The rows whose key is allowed; all of them where ``keys`` is None."""
    return df if keys is None else df.join(keys, key, "left_semi")


def least_of_children(items: DataFrame, key: str, children: DataFrame, child_key: str, value: str, name: str) -> DataFrame:
    """Items with the least value of their children, 0 if they have none; the children are aggregated before the join."""
    low = children.groupBy(F.col(child_key).alias(key)).agg(F.min(value).alias(name))
    return items.join(low, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def first_rows(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of every group of bounded size; a rank limit below the shuffle leaves n rows a group and task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def positions(df: DataFrame, group: str, order: Sequence[Column], position: str = "position", cost: str | None = None, total: str = "total") -> DataFrame:
    """All rows of every group of any size with their ``position`` from 1, and with the running ``total`` of ``cost`` if one
    is given; ``order`` has to tell all rows of a group apart.

    Rows are range-partitioned by group and order; places and totals within a partition are shifted by those of the group in
    the partitions before, of which there is one row a group and partition. Rows with a null group take no part.
    """
    parts, by = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), [F.col(group), *order]
    # the bounds come from a sample, so both uses below have to read the same partitions
    cut = cut_lineage(df.where(F.col(group).isNotNull()).repartitionByRange(parts, *by).withColumn("_pid", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.count("*").alias("_n"), *([F.sum(cost).alias("_c")] if cost else [])]
    shift = cut.groupBy(group, "_pid").agg(*sums).select(group, "_pid", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_shift{c}") for c in (("_n", "_c") if cost else ("_n",))))
    within = Window.partitionBy(group, "_pid").orderBy(*order)
    local = cut.withColumn("_local", F.row_number().over(within))
    if cost:
        local = local.withColumn("_run", F.sum(cost).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    more = [(F.coalesce("_run", F.lit(0)) + F.col("_shift_c")).alias(total)] if cost else []
    return local.join(shift, [group, "_pid"]).select(*df.columns, (F.col("_local") + F.col("_shift_n")).alias(position), *more)


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``; partial aggregation keeps one candidate a task, however often a key comes."""
    rest = [c for c in df.columns if c not in key]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return df.groupBy(*key).agg(best).select(*key, *(F.col("first")[c].alias(c) for c in rest))


def _tag(dimension: str):
    return lambda v: F.struct(F.lit(dimension).alias("dimension"), v.alias("value"))


def frequencies(df: DataFrame, scalars: Sequence[str] = (), arrays: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """(dimension, value, n) of all dimensions in one pass; an array's value counts once a row, or once a ``key``."""
    pairs = [F.array(F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))) for c in scalars]
    pairs += [F.transform(F.coalesce(F.array_distinct(F.col(c)), F.array().cast("array<string>")), _tag(c)) for c in arrays]
    long = df.select(*([key] if key else []), F.explode(F.concat(*pairs)).alias("p")).where("p.value is not null").select(*([key] if key else []), "p.*")
    n = F.countDistinct(key) if key else F.count("*")
    return long.groupBy("dimension", "value").agg(n.alias("n"))


def share_by(df: DataFrame, group: str, flag: Column, least: int) -> DataFrame:
    """(group, n, share) of the groups with ``least`` rows or more: the share of their rows for which the flag holds."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(F.coalesce(flag, F.lit(False)).cast("int")).alias("share")).where(F.col("n") >= least)


def shares_by(df: DataFrame, group: str, flags: dict[str, tuple[Column, float]], least: int, name: str) -> DataFrame:
    """(group, name, share) of the signals that hold for a share of a group's rows no less than the signal's own threshold,
    in groups of ``least`` rows or more; all signals in one aggregation."""
    cols = [F.avg(F.coalesce(f, F.lit(False)).cast("int")).alias(f"_s{i}") for i, (f, _) in enumerate(flags.values())]
    agg = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"), *cols).where(F.col("_n") >= least)
    rows = F.array(*(F.struct(F.lit(k).alias(name), F.col(f"_s{i}").alias("share"), F.lit(float(t)).alias("_t")) for i, (k, (_, t)) in enumerate(flags.items())))
    return agg.select(group, F.explode(rows).alias("_x")).where("_x.share >= _x._t").select(group, f"_x.{name}", "_x.share")


def mode_by(df: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n): the most frequent value of each group, the smaller one if several are."""
    counts = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value)))
    return counts.groupBy(group).agg(best.alias("b")).select(group, F.col("b")[value].alias(value), F.col("b")["n"].alias("n"))


def lift(pairs: DataFrame, item: str, value: str, support: int, probability: float, least_lift: float, most: int) -> DataFrame:
    """(a, b, n_a, n_ab, probability, lift): the ``most`` strongest followers of each value, by how much more often items that
    have a also have b. Item-value pairs count once. Values are joined within an item, which has few."""
    once = pairs.where(F.col(item).isNotNull() & F.col(value).isNotNull()).select(item, value).distinct()
    total = once.agg(F.countDistinct(item).alias("total"))
    single = once.groupBy(value).agg(F.count("*").alias("n"))
    often = single.where(F.col("n") >= support)
    both = once.select(item, F.col(value).alias("a")).join(often.select(F.col(value).alias("a")), "a", "left_semi").join(once.select(item, F.col(value).alias("b")), item).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n_ab"))
    p = both.join(single.select(F.col(value).alias("a"), F.col("n").alias("n_a")), "a").join(single.select(F.col(value).alias("b"), F.col("n").alias("n_b")), "b").join(F.broadcast(total))
    p = p.withColumn("probability", F.round(F.col("n_ab") / F.col("n_a"), 4)).withColumn("lift", F.round((F.col("n_ab") / F.col("n_a")) / (F.col("n_b") / F.col("total")), 4))
    kept = p.where((F.col("n_ab") / F.col("n_a") >= probability) & ((F.col("n_ab") / F.col("n_a")) / (F.col("n_b") / F.col("total")) >= least_lift))
    return first_rows(kept, ["a"], [F.col("lift").desc(), F.col("b")], most).select("a", "b", "n_a", "n_ab", "probability", "lift", "rank")


def nearest_rank(df: DataFrame, group: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    """The value at rank ceil(share * n) of each group; nulls are left out."""
    return df.groupBy(*group).agg(F.expr(f"percentile_disc({share}) within group (order by {value})").alias(name))


def balanced_sample(df: DataFrame, group: str, order: Sequence[Column], n: int) -> DataFrame:
    """Up to n rows of each group of any size at even steps of its order: those at ranks floor(i * size / n), or all if it has
    no more. ``order`` has to tell the rows of a group apart; rows with a null group take no part."""
    placed = positions(df, group, order, "_at")
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_size"))
    # only steps i near rank * n / size can land on a rank
    hit = F.expr(f"_size <= {n} or exists(sequence(greatest(0, ((_at - 1) * {n}) div _size - 1), least({n - 1}, ((_at - 1) * {n}) div _size + 2)), i -> (i * _size) div {n} = _at - 1)")
    return placed.join(sizes, group).where(hit).select(*df.columns)


def within_budget(df: DataFrame, group: Sequence[str], order: Sequence[Column], cost: str, budget: int, least_cost: int = 0) -> DataFrame:
    """The first rows of each group whose costs add up to the budget at most; always the very first one.

    Where no row costs less than ``least_cost``, no more than budget / least_cost rows of a group can be kept; a rank limit
    below the shuffle then leaves out the rest of a group of any size. Where costs can be 0, the running totals of a group
    of any size come from ``positions``, for one group column whose rows ``order`` tells apart.
    """
    if least_cost > 0:
        df = first_rows(df, group, order, budget // least_cost + 1, "_rank")
        run = df.withColumn("total", F.sum(cost).over(Window.partitionBy(*group).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)))
    else:
        run = positions(df, group[0], order, "_rank", cost)
    return run.where((F.col("_rank") == 1) | (F.col("total") <= budget)).withColumnRenamed("_rank", "rank")


def todo(all_rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key hasn't been done."""
    return all_rows.join(done.select(key), key, "left_anti")


def resolve(rows: DataFrame, registry: DataFrame, tiers: Sequence[Sequence[str]], id_col: str) -> DataFrame:
    """The registered id of each row by the first tier of keys that knows it; null for new ones."""
    found = []
    for k, keys in enumerate(tiers):
        known = registry.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in keys))).groupBy(*keys).agg(F.min(id_col).alias(f"_id{k}"))
        rows = rows.join(known, list(keys), "left")
        found.append(f"_id{k}")
    return rows.withColumn(id_col, F.coalesce(*found)).drop(*found)


def register(rows: DataFrame, registry: DataFrame, tiers: Sequence[Sequence[str]], id_col: str, proposed: Column) -> DataFrame:
    """Rows with their registered id, or the one proposed for them, and whether it is ``fresh``; ids that were given never
    change. The fresh ones, once each, are what to append to the registry."""
    return resolve(rows, registry, tiers, id_col).withColumn("fresh", F.col(id_col).isNull()).withColumn(id_col, F.coalesce(id_col, proposed))


def map_all(names: DataFrame, ids: DataFrame, key: str, id_col: str, most: int = 20) -> DataFrame:
    """Names with their ids, all or none: raises ValueError, naming some, if any name has no id."""
    lost = names.join(ids, key, "left_anti").select(key).limit(most + 1).collect()
    if lost:
        raise ValueError(f"no id for {[r[0] for r in lost[:most]]}{' and more' if len(lost) > most else ''}")
    return names.join(ids.select(key, id_col), key)


def union_keep_order(lists: Sequence[DataFrame], group: str, item: str, rank: str, most: int) -> DataFrame:
    """Ranked lists one after the other, each item once at its first place, cut to ``most`` a group."""
    tagged = reduce(DataFrame.unionByName, (d.select(group, item, F.lit(i).alias("_list"), F.col(rank).alias("_rank")) for i, d in enumerate(lists)))
    once = first_wins(tagged, [group, item], ["_list", "_rank"])
    return first_rows(once, [group], [F.col("_list"), F.col("_rank"), F.col(item)], most, rank).select(group, item, rank)
