"""Aggregates: inventories, histograms, flags, examples, arg-max."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.operators.ordered import ranked


def distinct_sorted(col: str | Column) -> Column:
    return F.array_sort(F.collect_set(col))


def inventory(events: DataFrame, scope: list[str], key: str, *, page: str, order: str, sets: list[str] = (), base: list[str] = (), lists: bool = True) -> DataFrame:
    """Events by key: uses, distinct pages, further distinct sets, and the base attributes
    of the first event; ordered by pages, then uses (both falling), then first seen, and
    by key where events share an order.

    place numbers the keys of a scope in that order. Pages are gathered as lists, which a
    document bounds, or only counted (n_pages) where lists is False. Without a scope the
    numbers come from ranges of the order (ordered.ranked), so no task sees all keys.
    """
    first = F.min_by(F.struct(*base), order).alias("__base") if base else F.lit(None).alias("__base")
    out = events.groupBy(*scope, key).agg(F.count("*").alias("uses"), distinct_sorted(page).alias("pages") if lists else F.count_distinct(page).alias("n_pages"), *[distinct_sorted(s).alias(f"{s}s") for s in sets], F.min(order).alias("first_seen"), first)
    spread = F.size("pages") if lists else F.col("n_pages")
    order_by = [spread.desc(), F.col("uses").desc(), F.col("first_seen").asc(), F.col(key).asc()]
    out = out.withColumn("place", F.row_number().over(Window.partitionBy(*scope).orderBy(*order_by))) if scope else ranked(out, order_by, "place")
    return out.select(*scope, key, "uses", "pages" if lists else "n_pages", *[f"{s}s" for s in sets], *[f"__base.{b}" for b in base], "first_seen", "place")


def histogram(rows: DataFrame, scope: list[str], key: Column, *, page: str, order: str | None = None) -> DataFrame:
    """Rows by key, the most frequent first; of equals the one seen first."""
    order = order or page
    out = rows.withColumn("bucket", key).groupBy(*scope, "bucket").agg(F.count("*").alias("n"), distinct_sorted(page).alias("pages"), F.min(order).alias("first_seen"))
    w = Window.partitionBy(*scope).orderBy(F.col("n").desc(), "first_seen")
    return out.withColumn("place", F.row_number().over(w))


def flags(rows: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """For each group whether any row meets each condition; null counts as no."""
    return rows.groupBy(*by).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in conditions.items()])


def counts(rows: DataFrame, by: list[str], **conditions: Column) -> DataFrame:
    """For each group how many rows meet each condition."""
    return rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def sums_in_order(rows: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """(by…, value): the sum of each group's numbers, added one after the other in the order, which must break
    ties. A sum of doubles depends on the order of its terms; this one is the same however rows are dealt. Nulls
    add nothing; a group of nulls alone has null. Groups are windows, so one of any size is held by no list."""
    w = Window.partitionBy(*by).orderBy(*order)
    so_far = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = F.lead(F.lit(True)).over(w).isNull()
    return rows.select(*by, so_far.alias(value), last.alias("__last")).where("__last").drop("__last")


def level_counts(findings: DataFrame, by: list[str], level: str = "level", levels: tuple[str, ...] = ("error", "warn", "info", "pass")) -> DataFrame:
    return counts(findings, by, **{x: F.col(level) == x for x in levels})


def best_row(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One whole row of each group, the first in the order, which must break all ties."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def examples(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group, numbered from 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("example", F.row_number().over(w)).where(F.col("example") <= n)


def two_level(hits: DataFrame, group: list[str], check: list[str], *, chars: str, size: str) -> DataFrame:
    """Hits summed for each item of group and check, then for each check: items, characters
    and the smallest size. Both levels combine on the map side."""
    per = hits.groupBy(*dict.fromkeys([*check, *group])).agg(F.sum(chars).alias(chars), F.min(size).alias(size))
    return per.groupBy(*check).agg(F.count("*").alias("items"), F.sum(chars).alias(chars), F.min(size).alias(size))


def image_spaces(placements: DataFrame, scope: list[str], *, family: str = "family", image: str = "image_id", page: str = "page") -> DataFrame:
    return placements.groupBy(*scope, family).agg(F.count("*").alias("placements"), F.count_distinct(image).alias("images"), distinct_sorted(page).alias("pages"))
