"""Two multisets of each group: sums in the stored order, nulls last."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

from quoin.operators import aggregates, joins
from quoin.queries import multiset_reconcile


def whole_thousand():
    """Prices whose sum is 198000 in their order, and just less where the first is added last."""
    draw = random.Random(4)
    while True:
        cents = [draw.randint(90_000, 5_000_000) for _ in range(5)]
        cents.append(19_800_000 - sum(cents))
        prices = [c / 100 for c in cents]
        if cents[-1] > 0 and sum_of(prices) == 198_000 and sum_of(prices[1:] + prices[:1]) < 198_000:
            return prices


def sum_of(prices):
    total = 0.0
    for p in prices:  # the sum of Python adds with a correction
        total += p
    return total


def test_sums_follow_the_stored_order(spark, tmp_path):
    prices = whole_thousand()
    pq.write_table(pa.table({"o_orderkey": [1], "o_custkey": [7], "o_totalprice": [198_000.0]}), tmp_path / "orders.parquet")
    (tmp_path / "lineitem.parquet").mkdir()
    lines = lambda keys, prices: pa.table({"l_orderkey": pa.array(keys, pa.int64()), "l_extendedprice": pa.array(prices, pa.float64())})
    # Spark reads the longer file first, whatever its name
    pq.write_table(lines([1], prices[:1]), tmp_path / "lineitem.parquet" / "a.parquet")
    pq.write_table(lines([1] * 5 + list(range(1000, 6000)), prices[1:] + [1.0] * 5000), tmp_path / "lineitem.parquet" / "b.parquet")
    got = multiset_reconcile(spark, str(tmp_path)).collect()
    assert [(r.g, r.n, r.v_a, r.v_b) for r in got] == [(7, 1, 198, 198)]


def test_sums_in_order(spark):
    rows = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 1e16), ("a", 2, -1e16), ("b", 1, None), ("b", 2, 2.0), ("c", 1, None), (None, 1, 4.0)], "k string, at int, v double")
    got = {r.k: r.v for r in aggregates.sums_in_order(rows, ["k"], "v", ["at"]).collect()}
    assert got == {"a": 1.0, "b": 2.0, "c": None, None: 4.0}


def test_nulls_come_last(spark):
    a = spark.createDataFrame([(1, None), (1, 5)], "g int, v long")
    b = spark.createDataFrame([(1, 5)], "g int, v long")
    got = sorted((r.n, r.v_a, r.v_b) for r in joins.paired(a, b, ["g"], "v").collect())
    assert got == [(1, 5, 5), (2, None, None)]
