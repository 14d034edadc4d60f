"""Sinks: tables replaced as a whole, versions behind a pointer, JSON documents, reports and metrics as text."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def reload(tables: dict[str, DataFrame], folder: str) -> None:
    """Replaces each table with its new rows; running it again gives the same."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _text_file(spark: SparkSession, path: str, text: str | None = None) -> str | None:
    """Writes a small text file as a whole, or reads it; None if it isn't there."""
    fs, p = _fs(spark, path)
    if text is None:
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
    tmp = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.new")
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(p):
        fs.delete(p, False)
    fs.rename(tmp, p)
    return text


def publish(df: DataFrame, folder: str, name: str, version: str, partition: Sequence[str] = ()) -> DataFrame:
    """Writes a version and moves the pointer file ``CURRENT`` and the view ``name`` to it once it is whole; readers, also of
    other sessions, see the version before or this one, never half a table."""
    path = f"{folder}/{name}/version={version}"
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)
    _text_file(df.sparkSession, f"{folder}/{name}/CURRENT", version)
    return current(df.sparkSession, folder, name)


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The published version of a table, also as the view ``name``."""
    version = _text_file(spark, f"{folder}/{name}/CURRENT")
    if version is None:
        raise FileNotFoundError(f"{folder}/{name} has no published version")
    out = spark.read.parquet(f"{folder}/{name}/version={version.strip()}")
    out.createOrReplaceTempView(name)
    return out


def upsert(rows: DataFrame, folder: str, name: str, key: str, version: str) -> DataFrame:
    """A new version of a table in which the given rows stand in place of those of the same key; running it again with the
    same rows gives the same. Of several given rows of a key one stands, the first by its values."""
    spark, rest = rows.sparkSession, [c for c in rows.columns if c != key]
    fresh = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, *(F.col("r")[c].alias(c) for c in rest)) if rest else rows.select(key).distinct()
    if _text_file(spark, f"{folder}/{name}/CURRENT") is not None:
        fresh = current(spark, folder, name).join(fresh.select(key), key, "left_anti").select(*fresh.columns).unionByName(fresh)
    return publish(fresh, folder, name, version)


def write_vectors(df: DataFrame, path: str, key: str, vector: str, dim: int) -> None:
    """Vectors by key as lists of floats; an error if one isn't of the given length. Nothing depends on the order of rows."""
    right = F.when(F.size(vector) == dim, F.col(vector).cast("array<float>")).otherwise(F.raise_error(F.concat(F.lit(f"a vector isn't of length {dim}: "), F.col(key).cast("string"))).cast("array<float>"))
    df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, right.alias(vector)).write.mode("overwrite").parquet(path)


def write_layers(layers: dict[str, DataFrame], folder: str, version: str) -> None:
    """Generated layers (synonyms, expansions, relations, places, settings), each published as a version of its own table."""
    for name, df in layers.items():
        publish(df, folder, name, version)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def documents(df: DataFrame, key: str, prefix: str = "acc_") -> DataFrame:
    """(name, doc): one JSON document per row, named by its key."""
    return df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("name"), F.to_json(F.struct(*df.columns)).alias("doc"))


def append_unseen(rows: DataFrame, path: str, key: str, schema: str) -> int:
    """Appends the rows whose key isn't stored yet; how many. An interrupted run goes on where it stopped."""
    spark = rows.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    fresh = rows.dropDuplicates([key])
    if there:
        fresh = fresh.join(spark.read.schema(schema).parquet(path).select(key), key, "left_anti")
    n = fresh.count()
    fresh.write.mode("append").parquet(path)
    return n


def inject(text: str, block: str, start: str = "<!-- AUTO-STATS:START -->", end: str = "<!-- AUTO-STATS:END -->") -> str:
    """The text with what stands between two markers replaced; the markers and the block at its end if it has none."""
    whole = f"{start}\n{block.strip()}\n{end}"
    pattern = re.compile(re.escape(start) + r".*?" + re.escape(end), re.S)
    return pattern.sub(lambda _: whole, text, count=1) if pattern.search(text) else f"{text.rstrip()}\n\n{whole}\n"


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A small result as a Markdown table; an error if it has more than ``most`` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), line("---" for _ in df.columns), *map(line, rows)])


def evaluation_report(metrics: DataFrame, group: str, names: Sequence[str], seconds: Sequence[float] = ()) -> str:
    """The report of an evaluation as Markdown: means per group and over all, queries without results, and the 95th percentile
    of the times, by nearest rank."""
    means = [F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in names]
    by = metrics.groupBy(group).agg(F.count("*").alias("queries"), *means).orderBy(group)
    every = metrics.agg(F.lit("all").alias(group), F.count("*").alias("queries"), *means)
    parts = ["# Evaluation", "", markdown(by.withColumn(group, F.col(group).cast("string")).unionByName(every))]
    if "zero_result" in metrics.columns:
        parts += ["", f"Queries without results: {metrics.where('zero_result > 0').count()}"]
    if seconds:
        times = sorted(seconds)
        parts += ["", f"Time of {len(times)} runs: p95 {times[max(0, -(-95 * len(times) // 100) - 1)]:.3f} s, mean {sum(times) / len(times):.3f} s"]
    return "\n".join(parts) + "\n"


def timed(run: Callable[[], object], warm_up: int = 5, runs: int = 30) -> list[float]:
    """Seconds of each run after some that aren't counted."""
    out = []
    for k in range(warm_up + runs):
        start = time.perf_counter()
        run()
        if k >= warm_up:
            out.append(time.perf_counter() - start)
    return out


def exposition(df: DataFrame, metric: str, labels: Sequence[str], value: str, kind: str = "counter", most: int = 10_000) -> str:
    """A small result in the text format that metric collectors read."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    quoted = lambda v: str(v).replace("\\", r"\\").replace('"', r"\"").replace("\n", r"\n")
    body = [f"{metric}{{{','.join(f'{k}="{quoted(r[k])}"' for k in labels)}}} {r[value]}" for r in rows]
    return "\n".join([f"# TYPE {metric} {kind}", *sorted(body), ""])


def log_stream(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, zone: str = "+07:00") -> StreamingQuery:
    """Events of JSON files as JSON lines with their time in a fixed zone; reads what is there, then ends."""
    events = spark.readStream.schema(schema).json(source)
    lines = events.withColumn("ts", F.date_format(F.from_utc_timestamp("ts", zone), f"yyyy-MM-dd'T'HH:mm:ss.SSS'{zone}'"))
    return lines.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
