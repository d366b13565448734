"""How many rows the assignment of items to pages makes, and its grids against a plain version."""

import pytest
from pyspark.sql import functions as F

from quoin.operators import joins
from tests.library.test_spatial import CASES, plain

BOX = "box struct<x:double,y:double,w:double,h:double>"


def most_rows(df) -> int:
    """The most rows that any node of the plan put out."""
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
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    return most


def tables(spark, n: int, step: float):
    """n items on n pages of one scope; the pages lie step apart."""
    box = lambda x, y, w, h: F.struct(*[F.lit(v).cast("double").alias(c) for c, v in zip("xywh", (x, y, w, h))])
    items = spark.range(n).select(F.lit("s").alias("scope"), F.col("id").alias("item"), box(F.col("id") % 90, 5, 4, 4).alias("box"))
    pages = spark.range(n).select(F.lit("s").alias("scope"), F.col("id").alias("page"), F.col("id").alias("ord"), box(F.col("id") * step, 0, 100, 100).alias("box"))
    return items, pages


@pytest.mark.parametrize("step", [0.0, 1e-6], ids=["one box", "other boxes"])
def test_no_row_for_each_pair(spark, step):
    n = 600
    got = joins.assign_boxes(*tables(spark, n, step), ["scope"], item="item", page="page", order="ord")
    assert most_rows(got) <= 300 * n  # 360,000 pairs, on several cells
    assert got.where("page = 0").count() == n


@pytest.mark.parametrize("case", CASES)
def test_grids(spark, monkeypatch, case):
    monkeypatch.setattr(joins, "FEW", 0)
    items, pages = CASES[case]
    i = spark.createDataFrame(items, f"scope string, item string, {BOX}")
    p = spark.createDataFrame(pages, f"scope string, page string, ord int, {BOX}")
    got = {(x.scope, x.item): x.page for x in joins.assign_boxes(i, p, ["scope"], item="item", page="page", order="ord").collect()}
    nan = lambda b: None if b and b[0] != b[0] else b
    assert got == plain([(s, n, nan(b)) for s, n, b in items], pages)


def test_lists_that_are_not_sent(spark, monkeypatch):
    monkeypatch.setattr(joins, "SENT", 0)
    items, pages = CASES["random sizes"]
    i = spark.createDataFrame(items + items[:20], f"scope string, item string, {BOX}")
    p = spark.createDataFrame(pages, f"scope string, page string, ord int, {BOX}")
    got = [((x.scope, x.item), x.page) for x in joins.assign_boxes(i, p, ["scope"], item="item", page="page", order="ord").collect()]
    want = plain(items, pages)
    assert len(got) == len(items) + 20 and all(want[k] == page for k, page in got)


def test_rows_of_one_item_share_its_best_page(spark):
    i = spark.createDataFrame([("s", "a", (1.0, 1.0, 2.0, 2.0)), ("s", "a", (90.0, 90.0, 1.0, 1.0)), ("s", None, (1.0, 1.0, 2.0, 2.0)), (None, "b", (1.0, 1.0, 2.0, 2.0))], f"scope string, item string, {BOX}")
    p = spark.createDataFrame([("s", "p", 1, (0.0, 0.0, 10.0, 10.0)), (None, "q", 1, (0.0, 0.0, 10.0, 10.0))], f"scope string, page string, ord int, {BOX}")
    got = joins.assign_boxes(i, p, ["scope"], item="item", page="page", order="ord").select("scope", "item", "page").collect()
    want = [("s", "a", "p"), ("s", "a", "p"), ("s", None, None), (None, "b", None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
