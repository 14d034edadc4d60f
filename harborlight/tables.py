"""Access to the input tables and to the session's shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` (one Parquet file, or a folder of them) under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, read from ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests) is a folder of this machine used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"harborlight-{os.getpid()}")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder; survives the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


#: Files up to which a table's state is asked for.
MOST_FILES = 10_000


def table_state(df: DataFrame) -> tuple | None:
    """The session, the plan and the table's files with their sizes and times: what was built from a table in one state holds
    until it changes. None where the files are too many, or none, to tell."""
    files = df.inputFiles()
    if not 0 < len(files) <= MOST_FILES:
        return None
    spark = df.sparkSession
    conf, out = spark._jsc.hadoopConfiguration(), [spark.sparkContext.applicationId, df.semanticHash()]
    for f in sorted(files):
        path = spark._jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append((f, status.getLen(), status.getModificationTime()))
    return tuple(out)


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table of its own in the shared folder and read again; cuts the lineage and keeps columns apart, so
    that each use reads only those it needs."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that does not clash with any of ``df``, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name
