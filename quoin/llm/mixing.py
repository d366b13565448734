"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm._spark import materialise, n_words, prefix_sums

WEIGHTS = (5, 2, 1)
LIMIT = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Add target to a table (source, source_size) with one row for each source.

    Sources in code point order, null last, weigh `weights`, repeating. All sizes are
    shared by weight; a target stops at `limit` times its source's size and what is over
    is shared again by weight until none is above. That fixed point fills sources in the
    order of size to weight, so it needs one ordered pass instead of rounds: a source is
    full if, with all before it full, an equal share for its weight would pass its limit.
    The windows see one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (place + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("full", F.col("source_size") * limit)
    line = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = line.rowsBetween(Window.unboundedPreceding, -1), line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("rest", F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("full").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(after))
    # the level of the first source that is not full holds for it and all that follow
    level = F.when(F.col("full") * F.col("open") > F.col("rest") * F.col("weight"), F.col("rest").cast("double") / F.col("open"))
    t = t.withColumn("level", F.first(level, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return t.select("source", "source_size", F.when(F.col("level").isNull(), F.col("full").cast("double")).otherwise(F.least(F.col("full").cast("double"), F.col("level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """How often each document goes into the mix.

    A source whose target is f times its size takes floor(f) whole copies of every
    document. The rest of the target is a Pareto order sample: a document with inclusion
    probability p, proportional to floor(sqrt(size)), gets the rank q = odds(u) / odds(p),
    u a uniform number from a hash of its id; documents are taken in the order of q while
    the middle of a document still lies within the rest, so the sample's size in words is
    fixed and misses the target by half of one document at most.

    Returns id_col, source, size (words), source_size, target (its source's), copies,
    taken (copies times size). Documents without words have size 0 and take 0. Null
    sources form one source, the last. Repeated rows (same id and text) count one by one
    and share u. An empty table gives no rows. Ties in q go by id.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    # words are counted once: the sums, the bounds of the ranges and the rows all need them
    rows = materialise(rows.withColumn("pull", F.greatest(F.lit(1), F.floor(F.sqrt("size"))).cast("long")), "sizes")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("pull")).alias("pulled"))
    targets = source_targets(sums.select("source", "source_size"), weights, limit).withColumnRenamed("source", "t_source")
    sums = sums.drop("source_size").join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sums = sums.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # the sources keep their global order, so one line of prefix sums serves all of them
    by_name = Window.orderBy(F.col("source").asc_nulls_first())
    sums = sums.withColumn("s", F.row_number().over(by_name)).withColumn("s_before", F.coalesce(F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    right = sums.withColumnRenamed("source", "s_source")
    rows = rows.join(right, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    p = F.least(F.lit(0.999999), F.greatest(F.lit(1e-12), F.col("rest") * F.col("pull") / F.greatest(F.col("pulled"), F.lit(1))))
    rows = rows.withColumn("q", (u / (1 - u)) * ((1 - p) / p))
    line = prefix_sums(rows.drop("pull", "pulled"), ["s", "q", "id"], ["size"])
    inside = (F.col("before_size") - F.col("s_before")) * 2 + F.col("size") <= F.col("rest") * 2
    copies = F.col("whole") + F.when(inside & (F.col("rest") > 0), 1).otherwise(0)
    return line.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The documents with their own columns, each as many times as the mix takes it.

    Rows that repeat an id are matched one to one with their numbers of copies: those of
    equal id and size have equal ranks but for ties, so the copies are summed and dealt to
    the rows in turn. Documents without words are taken with their whole copies. Null texts
    have no words, null sources are one source and null ids are ids like others; an empty table gives no rows.
    """
    taken = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed, weights=weights, limit=limit)
    taken = taken.groupBy(F.col(id_col).alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size")).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    rows = docs.withColumn("__words", n_words(text_col))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    both = rows.join(taken.where("__copies > 0"), same)
    alone = both.where("__rows = 1").withColumn("__n", F.col("__copies"))
    turn = F.row_number().over(Window.partitionBy(id_col, source_col, "__words").orderBy(text_col)) - 1
    several = both.where("__rows > 1").withColumn("__turn", turn)
    several = several.withColumn("__n", F.floor(F.col("__copies") / F.col("__rows")) + F.when(F.col("__turn") < F.col("__copies") % F.col("__rows"), 1).otherwise(0)).drop("__turn")
    out = alone.unionByName(several).where("__n > 0").withColumn("__n", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int"))))
    return out.select(*docs.columns)
