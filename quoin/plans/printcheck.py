"""Checks of text in a layout against printers' profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions.text import font_key, is_light
from quoin.operators.aggregates import examples, two_level
from quoin.operators.hierarchy import resolve_swatches

MM_PT = 72 / 25.4
LEVELS = {"small-text": "warn", "light-weight": "warn", "multi-ink": "warn", "reversed-out": "warn", "frame-past-trim": "info", "frame-in-safe": "info"}


def hits(items: DataFrame, pages: DataFrame, story: DataFrame, effective: DataFrame, swatch: DataFrame, profiles: DataFrame, font_map: DataFrame | None = None) -> DataFrame:
    """(doc_id, profile_id, page, item_id, check, chars, size, extra): a row for each frame
    and check that it fails; frames that are hidden, empty or without a box are left out.

    font_map, if given: doc_id, key, style; the mapped style then counts for its weight.
    """
    p = F.broadcast(profiles)
    frame = items.where("kind = 'TextFrame' and not hidden and box is not null and page is not null").select("doc_id", "page", "item_id", "story_id", "box")
    frame = frame.join(story.where(F.trim("text") != "").select("doc_id", "story_id"), ["doc_id", "story_id"])
    on = frame.join(pages.where("not is_master").select("doc_id", F.col("ord").alias("page"), F.col("box").alias("of")), ["doc_id", "page"])
    gap = F.least(F.col("box.x") - F.col("of.x"), F.col("of.x") + F.col("of.w") - F.col("box.x") - F.col("box.w"), F.col("box.y") - F.col("of.y"), F.col("of.y") + F.col("of.h") - F.col("box.y") - F.col("box.h"))
    edge = on.withColumn("gap", gap).crossJoin(p)
    edge = edge.withColumn("check", F.when(F.col("gap") < -0.01, "frame-past-trim").when(F.col("gap") < F.col("safe_mm") * MM_PT, "frame-in-safe")).where("check is not null")
    edge = edge.select("doc_id", "profile_id", "page", "item_id", "check", F.lit(0).cast("long").alias("chars"), F.abs(F.col("gap") / MM_PT).alias("size"), F.lit(None).cast("string").alias("extra"))

    ink = resolve_swatches(swatch, ["doc_id"]).select(F.col("doc_id").alias("s_doc"), F.col("id").alias("s_id"), "inks", "reversed", F.col("kind").alias("s_kind"), F.col("name").alias("s_name"))
    size = F.regexp_extract("e.size", r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
    run = effective.where("n > 0").select("doc_id", "story_id", "n", size.alias("size"), F.col("e.fill").alias("fill"), F.coalesce("e.font_style", F.lit("Regular")).alias("style"), F.when(F.col("e.font").isNotNull(), font_key(F.col("e.font"), F.col("e.font_style"))).alias("key")).where("size is not null")
    if font_map is not None:
        run = run.join(font_map.select("doc_id", "key", F.col("style").alias("mapped")), ["doc_id", "key"], "left").withColumn("style", F.coalesce("mapped", "style")).drop("mapped")
    # runs are summed by what the checks look at before they meet frames and profiles
    run = run.groupBy("doc_id", "story_id", "size", "fill", "style").agg(F.sum("n").alias("n"))
    run = run.join(ink, (F.col("doc_id") == F.col("s_doc")) & (F.col("fill") == F.col("s_id")), "left").join(frame.drop("box"), ["doc_id", "story_id"]).crossJoin(p)
    turned = F.coalesce("reversed", F.lit(False)) & (F.col("size") < F.col("reverse_min"))
    many = (F.col("inks") >= 2) & (F.col("s_kind") != "registration") & (F.col("size") < F.col("multi_ink_min"))
    tests = [
        (F.col("size") < F.col("min_text"), "small-text", F.lit(None).cast("string")),
        (is_light(F.col("style")) & (F.col("size") < F.col("light_min")), "light-weight", F.col("style")),
        (turned, "reversed-out", F.lit(None).cast("string")),
        (~turned & F.coalesce(many, F.lit(False)), "multi-ink", F.concat(F.col("s_name"), F.lit(", "), F.col("inks").cast("string"), F.lit(" inks"))),
    ]
    failed = F.filter(F.array(*[F.when(t, F.struct(F.lit(c).alias("check"), x.alias("extra"))) for t, c, x in tests]), lambda x: x.isNotNull())
    text = run.select("doc_id", "profile_id", "page", "item_id", "n", "size", F.explode(failed).alias("f"))
    text = text.groupBy("doc_id", "profile_id", "page", "item_id", F.col("f.check").alias("check")).agg(F.sum("n").alias("chars"), F.min("size").alias("size"), F.max("f.extra").alias("extra"))
    return edge.unionByName(text)


def report(found: DataFrame) -> DataFrame:
    """For each check: frames, characters, the smallest size, and its level."""
    level = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    out = two_level(found, ["item_id"], ["doc_id", "profile_id", "check"], chars="chars", size="size")
    return out.withColumnRenamed("items", "frames").withColumn("level", level[F.col("check")])


def shown(found: DataFrame, n: int = 10) -> DataFrame:
    """Up to n examples of each check, in the order of pages."""
    return examples(found, ["doc_id", "profile_id", "check"], [F.col("page"), F.col("item_id")], n)
