"""Computations over an order: lines from runs, words of a frame in a page, page hierarchy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.numbers import half_up
from quoin.functions.text import GAPS, in_capitals, trimmed
from quoin.lineage import cut


def islands(rows: DataFrame, by: list[str], order: list[str], value: Column, gap: float) -> DataFrame:
    """rows with island, a number that grows by one where value moves by more than gap."""
    w = Window.partitionBy(*by).orderBy(*order)
    moved = F.coalesce((F.abs(value - F.lag(value).over(w)) > gap).cast("int"), F.lit(0))
    return rows.withColumn("__moved", moved).withColumn("island", F.sum("__moved").over(w).cast("int")).drop("__moved")


def text_lines(runs: DataFrame, by: list[str], *, seq: str, text: str, y: str, gap: float = 4) -> DataFrame:
    """Runs joined into lines: a run starts a new one where its rounded height differs by
    more than gap from the run before. Blank runs and blank lines are left out."""
    runs = runs.where(F.trim(text) != "")
    placed = islands(runs, by, [seq], half_up(F.coalesce(F.col(y), F.lit(0.0))), gap)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(seq, text))), lambda x: x[text])
    line = F.trim(F.regexp_replace(F.array_join(parts, " "), r"\s+", " "))
    return placed.groupBy(*by, "island").agg(line.alias("line")).where("line != ''")


BITS = 1 << 22  #: of the filter that runs are tried on; it is broadcast and has this size for any number of runs


def _runs(sizes: list[int], known: np.ndarray | None):
    """(key, n, run, place) of each run of n words of a row, for n in sizes: its words and its bit of
    the filter. With a filter only runs whose bit is set; without one, of a row with fewer words than the longest, all its words as one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["ws"]
            lengths = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            starts = np.cumsum(lengths) - lengths
            coded = lists.flatten().dictionary_encode()
            vocabulary, word = coded.dictionary.to_pylist(), np.asarray(coded.indices, np.int64)
            hashed = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in vocabulary], np.uint64)[word]
            owner = np.repeat(np.arange(len(lengths)), lengths)
            for n in sizes:
                at = np.arange(len(word) - n + 1) if len(word) >= n else np.zeros(0, np.int64)
                at = at[owner[at] == owner[at + n - 1]]
                place = np.full(len(at), n, np.uint64)
                for k in range(n):
                    place = (place ^ hashed[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                    place ^= place >> np.uint64(29)
                place %= np.uint64(BITS)
                if known is None:  # rows of fewer words than the longest run have one run of all of them
                    keep = (n == sizes[-1]) | (lengths[owner[at]] == n)
                else:
                    keep = known[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
                at, place = at[keep], place[keep].astype(np.int64)
                runs = [" ".join([vocabulary[word[i + k]] for k in range(n)]) for i in at.tolist()]
                yield pa.RecordBatch.from_arrays([batch["key"].take(pa.array(owner[at])), pa.array(np.full(len(at), n, np.int32)), pa.array(runs, pa.string()), pa.array(place)], ["key", "n", "run", "place"])

    return rows


def shared_runs(docs: DataFrame, items: DataFrame, doc: str, item: str, words: str = "ws", length: int = 3) -> DataFrame:
    """The pairs (doc, item) that share `length` words in a row; an item of fewer words, but not none,
    must be there as a whole.

    The runs of all items set bits of a filter of fixed size. Each document tries its runs on the filter
    where its words are, so that only those that some item may have become rows; these
    then meet the items' runs word for word. Null lists and empty ones share nothing;
    rows with equal keys count as one."""
    told = lambda df, key: df.select(F.col(key).alias("key"), F.col(words).alias("ws"))
    kind = lambda df, key: f"key {df.schema[key].dataType.simpleString()}, n int, run string, place long"
    known = cut(told(items, item).mapInArrow(_runs(list(range(1, length + 1)), None), kind(items, item)).distinct())
    bits, sizes = bytearray(BITS // 8), set()
    marks = known.groupBy(F.expr("place div 8").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1, cast(place % 8 as int))")).alias("bits"), F.collect_set("n").alias("sizes"))
    for r in marks.collect():  # BITS / 8 rows at most
        bits[r.cell] = r.bits
        sizes.update(r.sizes)
    maybe = told(docs, doc).mapInArrow(_runs(sorted(sizes), np.frombuffer(bytes(bits), np.uint8)), kind(docs, doc)).select(F.col("key").alias(doc), "n", "run").distinct()
    return maybe.join(known.select(F.col("key").alias(item), "n", "run"), ["n", "run"]).select(doc, item).distinct()


def contained_words(words: DataFrame, page_words: DataFrame, page: list[str], frame: list[str], *, pos: str = "pos", word: str = "word") -> DataFrame:
    """For each word of each frame whether its page has it.

    A page's words are a bag, and each frame has the whole bag to itself: the k-th time
    that a word comes in a frame it is there if the page has it k times or more. A word
    of five letters or more that the page lacks is there too if the page's words, written
    without gaps, contain it (a word broken over two lines). Counting by row_number makes
    this one window and equi-joins. Only long words that the bag lacks, once for each page,
    meet the joined text, and that is built only for the pages that have such words.
    """
    bag = page_words.groupBy(*page, word).agg(F.count("*").alias("__have"))
    ordered = F.array_sort(F.collect_list(F.struct(pos, word)))
    nth = F.row_number().over(Window.partitionBy(*page, *frame, word).orderBy(pos))
    both = words.withColumn("__nth", nth).join(bag, [*page, word], "left")
    lost = both.where(F.col("__have").isNull() & (F.length(word) >= 5)).select(*page, word).distinct()
    compact = page_words.join(lost.select(*page).distinct(), page, "left_semi").groupBy(*page).agg(F.array_join(F.transform(ordered, lambda x: x[word]), "").alias("__compact"))
    within = lost.join(compact, page).where(F.contains(F.col("__compact"), F.col(word))).select(*page, word, F.lit(True).alias("__within"))
    both = both.join(within, [*page, word], "left")
    ok = F.when(F.col("__have").isNotNull(), F.col("__nth") <= F.col("__have")).otherwise(F.coalesce("__within", F.lit(False)))
    return both.withColumn("ok", ok).drop("__nth", "__have", "__within")


def frame_verdicts(words: DataFrame, page: list[str], frame: list[str], *, pos: str = "pos", word: str = "word") -> DataFrame:
    """For each frame: words, missing, first_missing, trailing, last_kept.

    trailing says that the missing words look like the end of a text cut off: after the
    first, no more than a quarter of the words (or one) are present.
    """
    first = F.min(F.when(~F.col("ok"), F.col(pos)))
    out = words.groupBy(*page, *frame).agg(F.count("*").alias("words"), F.count_if(~F.col("ok")).alias("missing"), first.alias("first_missing"), F.array_sort(F.collect_list(F.struct(pos, word))).alias("__all"))
    tail = F.col("words") - F.col("first_missing")
    trailing = (tail - F.col("missing")) <= F.greatest(F.lit(1), F.floor(tail * 0.25))
    start = F.greatest(F.lit(0), F.col("first_missing") - 4)
    kept = F.transform(F.slice("__all", (start + 1).cast("int"), (F.col("first_missing") - start).cast("int")), lambda x: x[word])
    return out.withColumn("trailing", F.when(F.col("missing") > 0, trailing)).withColumn("last_kept", F.when(F.col("missing") > 0, F.array_join(kept, " "))).drop("__all")


def page_verdicts(frames: DataFrame, pages: DataFrame, page: list[str], has_page: Column | None = None) -> DataFrame:
    """The status of each page, from its frames' verdicts: no-pdf-page, no-text, mismatch,
    overset, differs or ok."""
    sums = frames.groupBy(*page).agg(F.sum("words").alias("words"), F.sum("missing").alias("missing"), F.coalesce(F.bool_or("trailing"), F.lit(False)).alias("__trailing"))
    out = pages.join(sums, page, "left")
    words, missing = F.coalesce("words", F.lit(0)), F.coalesce("missing", F.lit(0))
    status = (
        F.when(~(has_page if has_page is not None else F.lit(True)), "no-pdf-page")
        .when(words == 0, "no-text")
        .when((words >= 6) & (missing / F.greatest(words, F.lit(1)) > 0.6), "mismatch")
        .when(F.col("__trailing"), "overset")
        .when(missing > 0, "differs")
        .otherwise("ok")
    )
    return out.withColumn("status", status).withColumn("words", words).withColumn("missing", missing).drop("__trailing")


def ordinals(rows: DataFrame, by: list[str], order: list[str], name: str = "index") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


# What is shown of a page without text.
NO_HEADLINE, NO_BODY = "No text detected", "This PDF page may contain outlined text or image-only artwork."


def page_hierarchy(pages: DataFrame, lines: str) -> DataFrame:
    """pages with kicker, headline and body from a column of lines.

    Headline: the first line of 3 to 90 characters and up to 12 words, else the first.
    Kicker: the first other line in capitals, shorter than 45. Body: the rest, up to 700
    characters; if nothing rests, all lines after the first. Each step is a column of its
    own, so that no list is built twice.
    """
    # a function alone would get the line's number too, as the characters to trim
    out = pages.withColumn("__l", F.filter(F.transform(lines, lambda x: trimmed(x)), lambda x: x != ""))
    fits = F.filter("__l", lambda x: (F.length(x) >= 3) & (F.length(x) <= 90) & (F.size(F.split(x, GAPS)) <= 12))
    out = out.withColumn("headline", F.coalesce(F.get(fits, F.lit(0)), F.get("__l", F.lit(0))))
    loud = F.filter("__l", lambda x: (x != F.col("headline")) & (F.length(x) < 45) & in_capitals(x) & x.rlike("[A-Z]"))
    out = out.withColumn("kicker", F.coalesce(F.get(loud, F.lit(0)), F.lit("PAGE")))
    rest = F.filter("__l", lambda x: (x != F.col("headline")) & (x != F.col("kicker")))
    out = out.withColumn("body", F.substring(trimmed(F.regexp_replace(F.array_join(rest, " "), GAPS, " ")), 1, 700))
    after = F.substring(F.array_join(F.slice("__l", 2, F.greatest(F.size("__l") - 1, F.lit(0))), " "), 1, 700)
    empty = F.size("__l") == 0
    body = F.when(empty, NO_BODY).when(F.col("body") == "", after).otherwise(F.col("body"))
    return out.withColumn("body", body).withColumn("headline", F.when(empty, NO_HEADLINE).otherwise(F.col("headline"))).drop("__l")


def sample_run(runs: DataFrame, by: list[str], *, text: str, size: str, upright: Column, order: list[str]) -> DataFrame:
    """The run of each group that shows its font best: upright, short, of a length near 12
    for large sizes and near 32 else; the earliest of equals."""
    n = F.length(text)
    score = F.when(upright, 500).otherwise(0) + F.when(n <= 65, 100).otherwise(0) - F.abs(n - F.when(F.col(size) >= 16, 12).otherwise(32))
    w = Window.partitionBy(*by).orderBy(score.desc(), *order)
    return runs.where(F.trim(text) != "").withColumn("score", score).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ranked(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """rows numbered from 1 in one order over all: numbered inside ranges of the order, plus
    the rows of the ranges before, of which there is one total each. The order must break ties."""
    ranges = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    totals = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    earlier = totals.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    # a row for each range: bounded by the number of partitions
    out = ranges.withColumn(name, inside).join(F.broadcast(earlier), "__range")
    return out.withColumn(name, (F.col(name) + F.col("__before")).cast("int")).drop("__range", "__before")
