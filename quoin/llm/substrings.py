"""Exact removal of repeated word sequences, found through difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm._words import BASES, Texts, chunks, lists, signed, within

SALTS = 16  #: parts of a group of equal texts
#: Difference covers: any two offsets modulo the period meet the cover at a common shift.
COVERS = {1: (0,), 3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}


def cover_of(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, words in an anchor) for a window: an anchor starts within the first
    `period` words of the window and must end inside it."""
    period = max(p for p in COVERS if p == 1 or 5 * p <= 3 * window)
    return period, COVERS[period], window - period + 1


def counted(ids: pa.Array, text: np.ndarray, names: list[str], *hashes: np.ndarray) -> pa.RecordBatch:
    """A row for each (text, hash): the hashes, the text's id and how often it has them."""
    key = within(text, hashes[0])
    _, at, n = np.unique(key, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([*[signed(h[at]) for h in hashes], ids.take(pa.array(text[at])), pa.array(n.astype(np.int32))], [*names, "id", "n"])


def anchor_rows(window: int):
    period, cover, width = cover_of(window)
    on_cover = np.isin(np.arange(period), cover)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, t in chunks(b["text"]):
                at, h = anchors(t, width, on_cover)
                yield counted(b["id"].slice(row, t.n), t.text[at], ["h"], h)

    return rows


def anchors(t: Texts, width: int, on_cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, h = t.windows(width)
    on = on_cover[(at - t.first[t.text[at]]) % len(on_cover)]
    return at[on], h[on]


def candidate_rows(window: int):
    """Windows that hold an anchor found elsewhere too, with two independent hashes."""
    period, cover, width = cover_of(window)
    on_cover = np.isin(np.arange(period), cover)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, shared = lists(b["found"])
            for row, t in chunks(b["text"]):
                at, h = anchors(t, width, on_cover)
                own = shared[bounds[row] : bounds[row + t.n]]
                of = np.repeat(np.arange(t.n), np.diff(bounds[row : row + t.n + 1]))
                hit = np.isin(within(t.text[at], h), within(of, own))
                marks = np.zeros(len(t.starts) + 1, np.int64)
                marks[at[hit] + 1] = 1
                marks = np.cumsum(marks)
                start, h1 = t.windows(window)
                _, h2 = t.windows(window, BASES[2])
                keep = marks[start + period] > marks[start]
                yield counted(b["id"].slice(row, t.n), t.text[start[keep]], ["h1", "h2"], h1[keep], h2[keep])

    return rows


def removed_rows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bounds, repeated = lists(b["found"])
            for row, t in chunks(b["text"]):
                own = repeated[bounds[row] : bounds[row + t.n]]
                n = np.diff(t.first)
                copied = np.asarray(b["copied"].slice(row, t.n).to_pylist(), bool) & (n >= window)
                gone = copied[t.text]
                if len(own):
                    of = np.repeat(np.arange(t.n), np.diff(bounds[row : row + t.n + 1]))
                    start, h = t.windows(window)
                    hit = start[np.isin(within(t.text[start], h), within(of, own))]
                    step = np.zeros(len(t.starts) + 1, np.int64)
                    step[hit] += 1
                    np.subtract.at(step, hit + window, 1)
                    gone = gone | (np.cumsum(step)[:-1] > 0)
                sums = np.concatenate([[0], np.cumsum(gone)])
                n_removed = np.diff(sums[t.first])
                kept = []
                for i in range(t.n):
                    words = t.words(i)
                    if n_removed[i]:
                        words = list(compress(words, ~gone[t.first[i] : t.first[i + 1]]))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [b["id"].slice(row, t.n), pa.array(n.astype(np.int64)), pa.array(n_removed.astype(np.int64)), pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                    ["id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    return rows


def remove_repeats(docs: DataFrame, window: int = 35, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every word that lies in a window of `window` consecutive words whose word
    sequence also starts anywhere else in the table, the same document included.

    Windows are never paired. Anchors, shorter windows, are hashed only at places whose
    index modulo a period lies in a difference cover: two equal windows share an anchor at
    one common shift, whatever their alignments. Anchors met twice mark the windows
    around them as candidates; candidates extend to full windows, counted under 128 bits
    of hash, so the result is exact. Each text counts its own anchors and windows before
    the shuffle, and one key has a row for each document at most, so a passage in a third
    of all documents is a small part of all anchors. Both joins with the texts use one
    exchange.

    Returns id_col, n_words, n_removed, kept_text, kept_sha256. Null and empty texts have
    no words; texts shorter than a window keep all. Repeated rows and equal texts remove
    each other. Null ids work; rows that share an id are judged each by its own words, as
    hashes are carried back by a 64-bit hash of id and text. Empty
    tables give no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    # hashes are carried back by id and text together: rows that share an id don't get each other's
    rows = rows.withColumn("key", F.xxhash64("id", "text"))
    keyed = rows.select(F.col("key").alias("id"), "text")

    # of texts that occur several times one row alone looks for windows: the others lose all
    # their windows anyway, and what they share with other texts that one row shares too
    marks = rows.select("key", F.md5(F.col("text").cast("binary")).alias("sum"), F.pmod("key", F.lit(SALTS)).alias("salt")).where("text is not null")
    groups = marks.groupBy("sum").agg(F.count("*").alias("copies"), F.min("key").alias("lead")).where("copies > 1")
    groups = groups.select("sum", "lead", F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])).alias("salt"))
    copies = marks.join(groups, ["sum", "salt"]).groupBy(F.col("key").alias("c_key")).agg(F.lit(True).alias("is_copy"), F.bool_or(F.col("key") != F.col("lead")).alias("is_led"))

    def shared(found: DataFrame, *keys: str) -> DataFrame:
        """For each key of a row, the first hash of all that are found twice or more."""
        often = found.withColumn("n", F.sum("n").over(Window.partitionBy(*keys))).where("n > 1")
        return often.groupBy(F.col("id").alias("f_key")).agg(F.collect_set(keys[0]).alias("found"))

    def beside(found: DataFrame) -> DataFrame:
        both = rows.join(found, F.col("key") == F.col("f_key"), "left").join(copies, F.col("key") == F.col("c_key"), "left")
        no = F.lit(False)
        return both.select("id", "key", "text", "found", F.coalesce("is_copy", no).alias("copied"), F.coalesce("is_led", no).alias("led"))

    met = keyed.mapInArrow(anchor_rows(window), "h long, id long, n int")
    # the rows' own ids are read here too: so both joins with the texts ask for the same columns and use one exchange
    open_ = beside(shared(met, "h")).where("found is not null and not led").select(F.col("key").alias("id"), "text", "found", F.col("id").alias("own_id"))
    candidates = open_.mapInArrow(candidate_rows(window), "h1 long, h2 long, id long, n int")
    out = beside(shared(candidates, "h1", "h2")).select("id", "text", "found", "copied").mapInArrow(removed_rows(window), f"id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)
