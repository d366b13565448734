"""Cutting the lineage of iterative queries, and of facts that many rules read."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written by this session and not dropped yet.
WRITTEN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where nothing is named, a local session
    (tests) gets a folder of its own; on a cluster that is an error, since no machine's own
    folder is seen by the others."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read back: its plan begins at a scan,
    which prunes columns, knows its size, and outlives any executor."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that may be broadcast: some 30 MB of styles.
SENT = 100_000


def unsent(df: DataFrame, rows: int) -> DataFrame:
    """df, which has so many rows, for a join: with more than SENT it is joined by sorting.

    Spark broadcasts what is small on disk, but there repeated values and empty columns take
    hardly any room: a cut table of 10 MB can be a thousand times that in the driver's memory."""
    return df.hint("merge") if rows > SENT else df


@contextmanager
def dropped(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that are cut inside, once what was made of them is written."""
    before = len(WRITTEN)
    try:
        yield
    finally:
        for path in WRITTEN[before:]:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        del WRITTEN[before:]
