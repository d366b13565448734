"""Sharding by global byte-size prefix sums (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm._spark import prefix_sums


def shard_by_bytes(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", slack: float = 0.01) -> DataFrame:
    """Deal documents into contiguous shards of nearly equal bytes.

    Documents are put in one global order: by a hash of the text, then by id, so that
    equal texts stand side by side. Per-partition totals give every document the bytes
    before it, and the line of all bytes is cut at equal targets. A document belongs to the
    shard in which its middle lies. Only a group of equal texts that lies on a cut can be
    parted: the cut moves to the group's nearer end if that is within `slack` of a shard's
    bytes (less than a half), the measure of what counts as near equal; if it is not, the
    law binds first and the group is cut in two. There are `shards` - 1 cuts, whatever the
    size of the table, so no more groups than that are looked at.

    Returns id_col, size (UTF-8 bytes plus 1), text_crc32, law ('bytes'), shard, slot
    (position in the shard, gapless from 0), grown_shard (null under this law).
    Null and empty texts: size 1, crc32 0, one group. Repeated rows: each is dealt on its
    own; those of equal id and text may change places. An empty table gives no rows. Other columns are not read, so none can clash.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long").alias("group"),
        F.lit(1).cast("long").alias("one"),
    )
    placed = prefix_sums(rows, ["group", "text_crc32", "id"], ["size", "one"])
    whole = F.broadcast(placed.agg(F.sum("size").alias("total")))  # one row
    placed = placed.crossJoin(whole)
    # integer arithmetic in decimals: bytes times shards may pass 64 bits
    at = lambda spot: F.expr(f"cast(cast({spot} as decimal(38,0)) * {int(shards)} div (2 * cast(total as decimal(38,0))) as int)")
    placed = placed.withColumn("shard", at("(2 * before_size + size)"))

    # the groups on the cuts, a row for each cut at most, and how far they reach
    on_cut = placed.where(at("2 * before_size") != at("2 * (before_size + size)")).select("group", "text_crc32").distinct()
    ends = placed.join(F.broadcast(on_cut), ["group", "text_crc32"]).groupBy("group", "text_crc32", "total").agg(F.min("before_size").alias("lo"), F.max(F.col("before_size") + F.col("size")).alias("hi"))
    cut = F.explode(F.sequence(at("2 * lo") + 1, at("2 * hi"))).alias("cut")
    moved = ends.select("lo", "hi", "total", cut).withColumn("target", F.col("cut") * F.col("total") / shards)
    moved = moved.where((F.col("cut") > 0) & (F.col("cut") < shards))
    edge = F.when(F.col("target") - F.col("lo") <= F.col("hi") - F.col("target"), F.col("lo")).otherwise(F.col("hi"))
    moved = moved.withColumn("edge", edge).where(F.abs(F.col("edge") - F.col("target")) <= slack * F.col("total") / shards)
    moved = F.broadcast(moved.agg(F.map_from_entries(F.collect_list(F.struct("cut", "edge"))).alias("moved")))  # one row, an entry for each cut at most
    placed = placed.crossJoin(moved)
    middle = F.col("before_size") * 2 + F.col("size")
    here, beyond = F.try_element_at("moved", F.col("shard")), F.try_element_at("moved", F.col("shard") + 1)
    shard = F.col("shard") - F.coalesce(middle < 2 * here, F.lit(False)).cast("int") + F.coalesce(middle >= 2 * beyond, F.lit(False)).cast("int")
    placed = placed.withColumn("shard", shard)
    firsts = placed.groupBy("shard").agg(F.min("before_one").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before_one") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
