"""Small Spark helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one the cluster names in
    spark.checkpoint.dir. Where nothing is named, a local session (tests) gets a folder of
    its own; on a cluster that is an error, since no machine's own folder would do."""
    found = spark.conf.get(DIR, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"{DIR} must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Tables written by this session and not dropped yet.
WRITTEN: list[str] = []


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished writes now: it does so when the driver's
    garbage is collected, which otherwise can be long after they are of use. The last query
    that ran is still referred to, so an empty one is run first."""
    spark.range(0, 1, 1, 1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.java.lang.System.gc()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends
    here, and the files outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing will read again: all that was made of them is written."""
    for df in tables:
        files = df.inputFiles()
        path = next((w for w in WRITTEN if files and files[0].rsplit("/", 1)[0].endswith(w.rsplit("/", 1)[1])), None)
        if path:
            delete(df.sparkSession, path)
            WRITTEN.remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that are materialised inside, once what was made of them is written."""
    before = set(WRITTEN)
    try:
        yield
    finally:
        for path in [w for w in WRITTEN if w not in before]:
            delete(spark, path)
            WRITTEN.remove(path)


def prefix_sums(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """df with before_<c> for each c in sums: the sum of c over all rows that come
    earlier in the order of the columns named by order.

    Range partitions hold consecutive rows, so only their totals (one row for each
    partition) meet in one place; every row then adds its partition's offset to a
    running sum inside the partition. The ranged rows are written once, because a
    second evaluation could sample other bounds than the totals were taken under.
    Rows equal in all of order take any order among themselves.
    """
    ranged = df.repartitionByRange(*[F.asc_nulls_first(c) for c in order])
    ranged = materialise(ranged.withColumn("__part", F.spark_partition_id()), "ranged")
    inside = Window.partitionBy("__part").orderBy(*[F.asc_nulls_first(c) for c in order])
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__part").agg(*[F.sum(c).alias(f"__t_{c}") for c in sums])
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__t_{c}").over(upto), F.lit(0)).alias(f"__o_{c}") for c in sums])
    rows = ranged.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c in sums})
    # one row for each range partition: bounded by the number of partitions, not by the rows
    rows = rows.join(F.broadcast(offsets), "__part")
    rows = rows.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"__o_{c}") for c in sums})
    return rows.drop("__part", *[f"__o_{c}" for c in sums])


def n_words(text: Column | str) -> Column:
    """Words of the class [^\\x20\\x09-\\x0D]+ in a text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    squeezed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1).cast("long")


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """(key) of those whose count n is a quarter or more of a partition's share of `total`
    rows: four for each shuffle partition at most, so they can be broadcast."""
    partitions = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counts.where(F.col(n) * 4 * partitions >= total).select(key)


def join_counted(rows: DataFrame, lookup: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows left-joined with lookup, which has one row for each key and in n the number of rows
    of that key among the `total` rows. The few keys with many rows are broadcast; their
    rows take no part in the exchange by key, where each is sent to a place of its own."""
    hot = lookup.join(F.broadcast(hot_keys(lookup, key, n, total)), key, "left_semi")
    others = [c for c in lookup.columns if c != key]
    first = rows.join(F.broadcast(hot.select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__h_{c}") for c in others])), F.col(key) == F.col("__hot"), "left")
    open_ = F.when(F.col("__hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("-"), F.monotonically_increasing_id().cast("string")))
    cold = lookup.join(F.broadcast(hot.select(key)), key, "left_anti").select(F.col(key).alias("__cold"), *others)
    both = first.withColumn("__open", open_).join(cold, F.col("__open") == F.col("__cold"), "left")
    return both.select(*rows.columns, *[F.coalesce(f"__h_{c}", c).alias(c) for c in others])
