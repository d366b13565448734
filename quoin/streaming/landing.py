"""A landing folder of PDF files, scanned as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quoin.sources.pdf import scan_pdf

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, pattern: str = "*.pdf", per_trigger: int = 100) -> DataFrame:
    """Tagged facts of each file, once, as it arrives."""
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(folder)
    return scan_pdf(files.select(F.col("path").alias("doc_id"), "content"))


def land(spark: SparkSession, folder: str, store: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the facts of arriving files to Parquet at store, by kind; rules then run over
    the store as over any batch. No state is held; the checkpoint says which files are done."""
    return arriving(spark, folder).writeStream.partitionBy("kind").format("parquet").option("path", store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
