"""Windowed service metrics that run on batches and on streams alike, and streams that resume."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rate(events: DataFrame, time: str, keys: Sequence[str], window: str = "5 minutes", slide: str | None = None, seconds: int = 300) -> DataFrame:
    """(window_start, keys, n, per_second) of every window; pass a watermarked stream for appended results."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.where(F.col(time).isNotNull()).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n", F.round(F.col("n") / seconds, 6).alias("per_second"))


def histogram(events: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float]) -> DataFrame:
    """Cumulative counts per upper bound, with +Inf last, in one aggregation."""
    counts = [F.count_if(F.col(value) <= b) for b in bounds] + [F.count(value)]
    rows = F.array(*(F.struct(F.lit(le).alias("le"), F.lit(i).alias("at"), F.lit(float(b)).alias("bound")) for i, (le, b) in enumerate([(f"{b:g}", b) for b in bounds] + [("+Inf", 0.0)])))
    agg = events.groupBy(*keys).agg(F.array(*counts).alias("counts"))
    return agg.select(*keys, F.explode(rows).alias("b"), "counts").select(*keys, F.col("b.le").alias("le"), F.element_at("counts", F.col("b.at") + 1).alias("n"))


def bucket_quantile(events: DataFrame, keys: Sequence[str], value: str, bounds: Sequence[float], q: float, name: str) -> DataFrame:
    """The quantile by linear interpolation within its bucket; the last bound if it lies above it; null for no events."""
    edges = [0.0, *bounds]
    agg = events.groupBy(*keys).agg(F.array(F.lit(0).cast("long"), *(F.count_if(F.col(value) <= b) for b in bounds)).alias("c"), F.count(value).alias("n"))
    located = agg.withColumn("i", F.when(F.col("n") > 0, F.try_element_at(F.filter(F.sequence(F.lit(1), F.lit(len(bounds))), lambda i: F.element_at("c", i + 1) >= F.col("n") * q), F.lit(1))))
    e = F.array(*map(F.lit, edges))
    low, high = F.element_at(e, F.col("i")), F.element_at(e, F.col("i") + 1)
    before, inside = F.element_at("c", F.col("i")), F.element_at("c", F.col("i") + 1) - F.element_at("c", F.col("i"))
    value_at = F.when(F.col("n") == 0, None).when(F.col("i").isNull(), F.lit(edges[-1])).when(inside == 0, high).otherwise(low + (high - low) * (F.col("n") * q - before) / inside)
    return located.select(*keys, F.round(value_at, 6).alias(name))


def last_value(events: DataFrame, keys: Sequence[str], time: str, value: str, tie: str) -> DataFrame:
    """The value at the latest time of each key, the larger ``tie`` first; null times are left out."""
    return events.where(F.col(time).isNotNull()).groupBy(*keys).agg(F.max_by(value, F.struct(time, tie)).alias("last_value"))


def stream_rates(events: DataFrame, time: str, keys: Sequence[str], out: str, checkpoint: str, late: str = "10 minutes", window: str = "5 minutes") -> StreamingQuery:
    """Appends the final rate of every window to Parquet files once the watermark has passed it; events later than ``late``
    are left out. All that is there is read, then the query ends; a later run resumes where it stopped."""
    rates = rate(events.withWatermark(time, late), time, keys, window)
    return rates.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_unseen(events: DataFrame, time: str, key: str, out: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Appends events whose key hasn't come within ``late``; resumes where it stopped."""
    fresh = events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return fresh.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
