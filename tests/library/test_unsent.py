"""Tables that are small on disk alone are not broadcast."""

import pytest
from pyspark.sql import functions as F

from quoin.operators import hierarchy
from quoin.plans import fontmap, structure


def broadcast_rows(df) -> int:
    """The most rows that one broadcast of the plan holds."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if name.startswith("BroadcastExchange"):
            most = max(most, node.metrics().get("numOutputRows").get().value())
    return most


def styles(spark, n: int):
    k = F.col("id")
    fields = {f: F.lit(None).cast("string") for f in hierarchy.FIELDS} | {"font": F.when(k % 4 == 0, F.concat(F.lit("Face "), (k % 3).cast("string")))}
    named = lambda c: F.concat(F.lit("CharacterStyle/"), c.cast("string"))
    return spark.range(n).select((k % 5).cast("string").alias("doc_id"), F.lit("char").alias("kind"), named(k).alias("self"), F.when(k >= 5, named(k - 5)).alias("based_on"), *[c.alias(f) for f, c in fields.items()])


@pytest.mark.parametrize("n, sent", [(120_000, False), (50, True)])
def test_styles_are_sent_only_if_few(spark, tmp_path, n, sent):
    styles(spark, n).write.parquet(str(tmp_path / "style"))
    style = spark.read.parquet(str(tmp_path / "style"))
    none = [F.lit(None).cast("string").alias(f"{p}_{f}") for p in "pc" for f in hierarchy.FIELDS]
    run = style.select("doc_id", F.lit("s").alias("story_id"), F.col("self").alias("para_ord"), F.lit(0).alias("run_ord"), F.lit("ab").alias("text"), F.lit(None).cast("string").alias("para_style"), F.col("self").alias("char_style"), *none)
    effective = structure.effective_runs(run, structure.resolved_styles(style))
    mapping = fontmap.font_map(spark.createDataFrame([("0", "Face 0", "Regular", "New", "Bold")], "doc_id string, from_family string, from_style string, to_family string, to_style string"))
    for df in (effective.select("doc_id", "e", "n"), fontmap.plan_styles(style, mapping)):
        most = broadcast_rows(df)
        assert most == n if sent else most < 100
    if not sent:
        assert effective.where("e.font is not null and n = 2").count() > n / 2
