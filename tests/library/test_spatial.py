"""Items on pages, against a plain version."""

import random

import pytest


def plain(items, pages):
    """{(scope, item): page}"""
    out = {}
    for scope, item, b in items:
        mine = sorted((order, page, r) for s, page, order, r in pages if s == scope and r)
        found = None
        if b:
            x, y, w, h = b
            cx, cy = x + w / 2, y + h / 2
            found = next((page for _, page, r in mine if r[0] <= cx <= r[0] + r[2] and r[1] <= cy <= r[1] + r[3]), None)
            if found is None:
                most = 0
                for _, page, r in mine:
                    dx, dy = min(x + w, r[0] + r[2]) - max(x, r[0]), min(y + h, r[1] + r[3]) - max(y, r[1])
                    if dx > 0 and dy > 0 and dx * dy > most:
                        most, found = dx * dy, page
        out[scope, item] = found
    return out


CASES = {
    "no extent": ([("s", "a", (0.0, 0.0, 100.0, 100.0)), ("s", "on it", (0.0, 0.0, 0.0, 0.0))], [("s", "p", 0, (0.0, 0.0, 0.0, 0.0))]),
    "thin page": ([("s", "a", (0.0, 0.0, 100.0, 100.0)), ("s", "b", (500.0, 0.0, 3.0, 3.0))], [("s", "p", 0, (10.0, 0.0, 0.001, 1e6))]),
    "item larger than all pages": ([("s", "a", (-1e7, -1e7, 1e7 + 900, 1e7 + 100))], [("s", f"p{k}", k, (100.0 * k, 0.0, 100.0, 50.0 + k)) for k in range(9)]),
    "huge page": ([("s", f"i{k}", (k * 10.0, 5.0, 4.0, 4.0)) for k in range(300)], [("s", "huge", 999, (-1e9, -1e9, 1e8, 2e9))] + [("s", f"p{k}", k, (k * 10.0, 0.0, 9.0, 9.0)) for k in range(300)]),
    "edges and first page": ([("s", "a", (5.0, 5.0, 10.0, 0.0))], [("s", "second", 2, (10.0, 0.0, 10.0, 10.0)), ("s", "first", 1, (0.0, 0.0, 10.0, 10.0))]),
    "negative and odd": ([("s", "a", (10.0, 10.0, -4.0, -4.0)), ("s", "n", None), ("s", "nan", (float("nan"), 0.0, 1.0, 1.0)), ("t", "other", (1.0, 1.0, 1.0, 1.0))], [("s", "p", 0, (0.0, 0.0, 20.0, 20.0)), ("s", "q", 1, None)]),
    "no pages": ([("s", "a", (1.0, 1.0, 1.0, 1.0))], []),
}
r = random.Random(2)
CASES["random sizes"] = (
    [(r.choice("st"), f"i{k}", (r.uniform(-50, 50), r.uniform(-50, 50), 10 ** r.uniform(-3, 2.5), 10 ** r.uniform(-3, 2.5))) for k in range(200)],
    [(r.choice("st"), f"p{k}", k, (r.uniform(-50, 50), r.uniform(-50, 50), 10 ** r.uniform(-3, 1.7), 10 ** r.uniform(-3, 1.7))) for k in range(60)],
)


@pytest.mark.parametrize("case", CASES)
def test_assign_boxes(spark, case):
    from quoin.operators.joins import assign_boxes

    items, pages = CASES[case]
    box = "box struct<x:double,y:double,w:double,h:double>"
    i = spark.createDataFrame(items, f"scope string, item string, {box}")
    p = spark.createDataFrame(pages, f"scope string, page string, ord int, {box}")
    got = {(x.scope, x.item): x.page for x in assign_boxes(i, p, ["scope"], item="item", page="page", order="ord").collect()}
    nan = lambda b: None if b and b[0] != b[0] else b
    assert got == plain([(s, n, nan(b)) for s, n, b in items], pages)


def test_candidates_are_bounded(spark):
    """One page as large as all others together does not make all pairs."""
    from pyspark.sql import functions as F

    from quoin.operators import joins

    n = 2000
    box = lambda x, y, w, h: F.struct(*[v.cast("double").alias(c) for c, v in zip("xywh", (x, y, w, h))])
    items = spark.range(n).select(F.lit("s").alias("scope"), F.col("id").alias("item"), box(F.col("id") * 10, F.lit(1), F.lit(4), F.lit(4)).alias("box"))
    pages = spark.range(n).select(F.lit("s").alias("scope"), F.col("id").alias("page"), F.col("id").cast("int").alias("ord"), box(F.col("id") * 10, F.lit(0), F.lit(9), F.lit(9)).alias("box"))
    pages = pages.unionByName(spark.range(1).select(F.lit("s").alias("scope"), F.lit(-1).cast("long").alias("page"), F.lit(n).alias("ord"), box(F.lit(-100000), F.lit(-100000), F.lit(90000), F.lit(300000)).alias("box")))
    b = items.withColumn("__own", joins._level("box"))
    left = joins._cells(b, F.array(F.lit(3), F.lit(4)), F.col("box"))
    right = joins._cells(pages.withColumn("__own", joins._level("box")), F.array("__own"), F.col("box")).select("__level", "__cx", "__cy", "page")
    assert left.join(right, ["__level", "__cx", "__cy"]).count() < 8 * n
    got = joins.assign_boxes(items, pages, ["scope"], item="item", page="page", order="ord")
    assert got.where("item = page").count() == n
