"""Colours that are a swatch or a tint of one, against a plain version and at size."""

import random
import time

import pytest
from pyspark.sql import functions as F


def plain(colours, swatches):
    out = {}
    for key, *a in colours:
        exact = any(all(abs(x - y) <= 0.6 for x, y in zip(a, b)) for b in swatches)
        tint = False
        for b in swatches:
            k = next((i for i, v in enumerate(b) if v > 0), None)
            if k is not None and a[k] > 0 and a[k] / b[k] < 1.001:
                tint = tint or all(abs(y / b[k] * a[k] - x) <= 0.8 for x, y in zip(a, b))
        out[key] = "exact" if exact else "tint" if tint else "other"
    return out


@pytest.mark.parametrize("inks", ["cm", "cmyk"])
def test_against_plain(spark, inks):
    from quoin.operators.joins import swatch_match

    r = random.Random(len(inks))
    some = lambda: [r.choice([0.0, 0.0, 0.3, 100.0, float(r.randint(0, 100)), round(r.uniform(0, 100), 1)]) for _ in inks]
    swatches = [some() for _ in range(60)] + [[0.0] * len(inks)] + [[100.0] + [0.0] * (len(inks) - 1)] * 3
    colours = [(k, *some()) for k in range(250)] + [(1000 + k, *[v * r.uniform(0, 1.1) for v in r.choice(swatches)]) for k in range(250)]
    cols = ", ".join(f"{c} double" for c in inks)
    got = swatch_match(spark.createDataFrame(colours, f"key long, {cols}"), spark.createDataFrame(swatches, cols), list(inks), key="key")
    want = plain(colours, swatches)
    assert {x.key: x.match for x in got.collect()} == want and set(want.values()) == {"exact", "tint", "other"}


def test_large_palettes(spark):
    """A hundred thousand colours and swatches, a third of them of one ink: no pairs of all with all."""
    from quoin.operators.joins import swatch_match

    n = 100_000
    value = lambda seed: (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1000)) / 10).cast("double")
    one = F.col("id") % 3 == 0
    colour = lambda seed: spark.range(n).select(F.col("id").alias("key"), (value(seed) + 0.1).alias("c"), *[F.when(one, 0.0).otherwise(value(seed + i)).alias(x) for i, x in enumerate("myk", 1)])
    began = time.time()
    found = {r.match: r["count"] for r in swatch_match(colour(1), colour(100).drop("key"), list("cmyk"), key="key").groupBy("match").count().collect()}
    assert sum(found.values()) == n and found["exact"] + found["tint"] >= n // 3
    assert time.time() - began < 240
