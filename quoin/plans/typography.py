"""Fonts of the text of PDF pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.functions.numbers import places
from quoin.operators.aggregates import distinct_sorted


def size_of(transform: Column) -> Column:
    """The size of a run in tenths of a point: the length of its vertical axis, else of its
    horizontal one; null for 0."""
    x, y = (F.hypot(F.get(transform, F.lit(k)), F.get(transform, F.lit(k + 1))) for k in (0, 2))
    return F.nullif(places(F.when(y != 0, y).otherwise(F.coalesce(x, F.lit(0.0)))), F.lit(0.0))


def font_runs(text: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """For each font of a document: items (runs), pages (distinct), sizes (rising) and first,
    the place of its first run; the most used first by items."""
    scope = scope or ["doc_id"]
    sized = text.withColumn("__size", size_of(F.col("transform")))
    return sized.groupBy(*scope, "font_key").agg(F.count("*").alias("items"), F.count_distinct("page").alias("pages"), distinct_sorted("__size").alias("sizes"), F.min(F.struct("page", "seq")).alias("first"))


def size_label(sizes: Column, limit: int = 12) -> Column:
    """The first sizes, with an ellipsis if there are more."""
    shown = F.array_join(F.transform(F.slice(sizes, 1, limit), lambda s: s.cast("string")), ", ")
    return F.when(F.size(sizes) == 0, "size unavailable").otherwise(F.concat(shown, F.when(F.size(sizes) > limit, "…").otherwise(""), F.lit(" pt")))


def shown_runs(text: DataFrame, page: int | None = None, font: str | None = None) -> DataFrame:
    """The runs of one page or all, in one font or all."""
    out = text if page is None else text.where(F.col("page") == page)
    return out if font is None else out.where(F.col("font_key") == font)
