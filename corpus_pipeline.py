"""The corpus pipeline: five stages, each written as Parquet and read as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quoin.llm._spark import scratch, shared_dir
from quoin.llm.decontaminate import drop_contaminated
from quoin.llm.jaccard import keep_one_of_each
from quoin.llm.mixing import mixed
from quoin.llm.oracles import PIPELINE
from quoin.llm.quality import keep_good
from quoin.llm.shards import shard_by_bytes


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the line-first quality rules, without the lines that fail."""
    return keep_good(docs, chars_col="n_chars")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar documents: that of the smallest id."""
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating share of benchmark windows."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document of the mix goes."""
    return shard_by_bytes(docs)


STAGES = [("quality", quality), ("deduplicate", deduplicate), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents table; what each keeps lies in the shared folder,
    the tables that a stage made for itself go when it is written.

    Null and empty texts fall at the first stage. Null sources are one source, null ids are
    ids like others; of rows that repeat an id and a text one passes the second stage; an
    empty table gives no rows; further columns are carried to the mix and dropped at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: All five stages in SQL: cleaned texts, components, contamination, the mix, the shards.
ORACLE_SQL = PIPELINE
