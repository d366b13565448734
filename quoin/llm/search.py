"""Ranked lexical search by dual trees: two hierarchies of maxima, pairs of nodes pruned exactly.

A document's coordinate for a term is its impact, an item's is the term's weight; a score
is the sum over terms of their products. A node of either hierarchy holds, for each term,
the greatest coordinate below it, so the product of two nodes bounds every score between
them. A pair of nodes is opened only if that bound reaches the weakest kth score among the
items below the node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm._spark import materialise
from quoin.llm._words import chunks, lists, signed

BLOCK_BYTES = 1 << 20  #: of items' text that are searched for in one pass
MATRIX = 12 << 20  #: coordinates of documents that a task holds at once
LEAF, FAN = 8, 4  #: documents in a lowest node; nodes in a node above
SEEDS = 64  #: one document of so many gives the first bounds
IMPACT = 1_000_000_000
#: A-Z to a-z, ASCII that belongs to no term to a space
TERMS = np.array([b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)], np.uint8)
LAST = (1 << 63) - 1  #: stands for a null id


def term_rows(vocabulary: Broadcast | None):
    """(id, n, terms, counts) of each text: its number of terms, and those of the vocabulary
    (their places in it) with their occurrences; without a vocabulary the hashes of all."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if vocabulary is None else vocabulary.value
        for batch in batches:
            for row, t in chunks(batch["text"], TERMS):
                if known is None:
                    order = np.lexsort((t.hash, t.text))
                    text, term = t.text[order], t.hash[order]
                else:
                    at = np.searchsorted(known, t.hash)
                    met = known[np.minimum(at, len(known) - 1)] == t.hash if len(known) else np.zeros(len(at), bool)
                    key = np.sort(t.text[met] * max(len(known), 1) + at[met])
                    text, term = key // max(len(known), 1), key % max(len(known), 1)
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (term[1:] != term[:-1])
                first = np.flatnonzero(new)
                offsets = np.searchsorted(text[first], np.arange(t.n + 1)).astype(np.int32)
                counts = np.diff(np.append(first, len(text))).astype(np.int32)
                terms = signed(term[first]) if known is None else pa.array(term[first].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(row, t.n), pa.array(np.diff(t.first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), terms), pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts))],
                    ["id", "n", "terms", "counts"],
                )

    return rows


class Level:
    """Nodes of the items' hierarchy: the terms below each, the greatest weights, the items."""

    def __init__(self, terms: list[np.ndarray], weights: list[np.ndarray], starts: np.ndarray):
        self.terms, self.weights, self.starts = terms, weights, starts


class Items:
    """The hierarchy over items, lowest level first, in an order in which items that share
    their heaviest terms stand together."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        heavy = [tuple(sorted(t.tolist(), key=lambda k: (-weights[k], k))[:4]) for t in terms]
        self.order = np.array(sorted(range(len(terms)), key=lambda i: heavy[i]), np.int64)
        sets = [np.asarray(terms[i], np.int64) for i in self.order]
        self.levels = [Level(sets, [weights[s] for s in sets], np.arange(len(sets)))]
        while len(self.levels[-1].terms) > 1:
            below = self.levels[-1].terms
            sets = [np.unique(np.concatenate(below[k : k + FAN])) for k in range(0, len(below), FAN)]
            self.levels.append(Level(sets, [weights[s] for s in sets], np.arange(0, len(terms), FAN ** len(self.levels))))


class Best:
    """The k highest (score, then smallest id) of each item so far, and a floor known beforehand."""

    def __init__(self, n: int, k: int, floors: np.ndarray | None):
        self.k = k
        self.scores, self.ids = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.least = np.ones(n, np.int64) if floors is None else np.maximum(floors, 1)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        fit = scores >= self.least[item]
        if not fit.any():
            return
        scores, ids = np.concatenate([self.scores[item], scores[fit]]), np.concatenate([self.ids[item], ids[fit]])
        if len(scores) > self.k:
            keep = np.lexsort((ids, -scores))[: self.k]
            scores, ids = scores[keep], ids[keep]
        if len(scores) == self.k:
            self.least[item] = max(self.least[item], int(scores.min()))
        self.scores[item], self.ids[item] = scores, ids


def bounds(maxima: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The greatest score that each row of maxima can give. Doubles hold all whole numbers
    up to 2**53 exactly; where a sum could pass that, whole numbers are used throughout."""
    if int(weights.sum()) * IMPACT // 1000 < 1 << 53:
        return (maxima[:, terms].astype(np.float64) @ weights.astype(np.float64)).astype(np.int64)
    return maxima[:, terms].astype(np.int64) @ weights


def documents_tree(impacts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """[(maxima, documents below a node)] from single documents to one node."""
    levels, below = [(impacts, 1)], LEAF
    while len(levels[-1][0]) > 1:
        rows, size = levels[-1]
        levels.append((np.maximum.reduceat(rows, np.arange(0, len(rows), below), axis=0), size * below))
        below = FAN
    return levels


def descend(items: Items, tree: list[tuple[np.ndarray, int]], ids: np.ndarray, best: Best, opened: np.ndarray) -> None:
    """Both hierarchies from their roots down, a level of each at a time, to single documents
    for single items. opened counts the pairs of nodes that were looked at, and documents scored."""
    n = len(items.order)
    level, height = len(items.levels) - 1, len(tree) - 1
    alive = np.ones((len(items.levels[level].terms), len(tree[height][0])), bool)
    while True:
        now, (maxima, _) = items.levels[level], tree[height]
        least = np.minimum.reduceat(best.least[items.order], now.starts) if n else best.least
        for a in np.flatnonzero(alive.any(axis=1)):
            nodes = np.flatnonzero(alive[a])
            most = bounds(maxima[nodes], now.terms[a], now.weights[a])
            opened[height == 0 and level == 0] += len(nodes)
            if height == 0 and level == 0:
                best.add(int(items.order[a]), most, ids[nodes])
            else:
                alive[a, nodes[most < least[a]]] = False
        if height == 0 and level == 0:
            return
        if level and (level >= height or height == 0):
            level -= 1
            alive = np.repeat(alive, FAN, axis=0)[: len(items.levels[level].terms)]
        else:
            below = LEAF if height == 1 else FAN
            height -= 1
            alive = np.repeat(alive, below, axis=1)[:, : len(tree[height][0])]


def search_rows(query: Broadcast, k: int):
    """(item, id, score): the k best of a partition's documents for each item, of those
    that reach its floor. Documents come as (id, m, terms, counts)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights, floors = query.value
        best, opened = Best(len(items.order), k, floors), np.zeros(2, np.int64)
        for batch in batches:
            step = max(LEAF, MATRIX // max(len(weights), 1))
            for at in range(0, len(batch), step):
                some = batch.slice(at, step)
                (offsets, terms), (_, counts) = lists(some["terms"]), lists(some["counts"])
                terms, counts = terms.view(np.int64), counts.view(np.int64)
                sizes = np.diff(offsets)
                m = np.repeat(np.asarray(some["m"], np.int64), sizes)
                value = IMPACT * counts // (1000 * counts + 8 * m)
                # documents that share their heaviest coordinates stand together
                row = np.repeat(np.arange(len(some)), sizes)
                gain = np.lexsort((-(value * weights[terms]), row))
                top = np.full((len(some), 3), -1, np.int64)
                for j in range(3):
                    has = np.flatnonzero(sizes > j)
                    top[has, j] = terms[gain[offsets[has] + j]]
                order = np.lexsort((top[:, 2], top[:, 1], top[:, 0]))
                place = np.empty(len(some), np.int64)
                place[order] = np.arange(len(some))
                impacts = np.zeros((len(some), len(weights)), np.float32)  # whole numbers below 2**24 are exact
                impacts[place[row], terms] = value
                ids = np.asarray(some["at"], np.int64)[order]
                descend(items, documents_tree(impacts), ids, best, opened)
        found = [i for i in range(len(items.order)) if len(best.scores[i])]
        sizes = [len(best.scores[i]) for i in found]
        flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(found, np.int64), sizes)), flat([best.ids[i] for i in found]), flat([best.scores[i] for i in found])], ["item", "at", "score"])

    return rows


def floors_of(found: DataFrame, n: int, k: int) -> np.ndarray:
    """For each of n items the kth score found, 1 if there are fewer."""
    out = np.ones(n, np.int64)
    for r in ranked(found, k).where(F.col("rank") == k).select("item", "score").collect():  # a row for each item at most
        out[r.item] = r.score
    return out


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), "at")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def weight(n: int, df: int) -> int:
    """floor(1000 * ln((2n + 2) / (2df + 1)))"""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search_block(texts: DataFrame, items: list, k: int) -> DataFrame:
    """(item, at, score, rank) of the items of one block: (their place in it, hashes of their terms)."""
    spark, hashes = texts.sparkSession, [np.array(t, np.int64).view(np.uint64) for t in items]
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]))
    vocabulary = spark.sparkContext.broadcast(known)
    vectors = materialise(texts.mapInArrow(term_rows(vocabulary), "id long, n long, terms array<int>, counts array<int>"), "vectors")
    total = vectors.agg(F.coalesce(F.sum(F.when(F.col("n") > 0, 1)), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    weights = np.zeros(len(known), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the block at most
        weights[r.term] = weight(total.docs, r["count"])
    m = F.expr(f"cast(10 + (cast(90 * n as decimal(38,0)) * {total.docs}) div {max(total.terms, 1)} as long)")
    open_ = vectors.where("size(terms) > 0").select(F.col("id").alias("at"), m.alias("m"), "terms", "counts")
    tree = Items([np.searchsorted(known, h) for h in hashes], weights)
    schema = "item long, at long, score long"
    sample = open_.where(F.pmod(F.xxhash64("at", "m"), F.lit(SEEDS)) == 0)
    floors = floors_of(sample.mapInArrow(search_rows(spark.sparkContext.broadcast((tree, weights, None)), k), schema), len(items), k)
    return ranked(open_.mapInArrow(search_rows(spark.sparkContext.broadcast((tree, weights, floors)), k), schema), k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k highest-scoring documents of each item: item_col, rank (from 1), id_col, score.

    Terms are runs of ASCII letters, digits and non-ASCII characters of the whole text, A-Z
    lower-cased. A score sums, over an item's distinct terms, the term's weight times the
    document's impact, which saturates with its occurrences and falls with the document's
    length; only documents with a score above 0 are ranked, equal scores by ascending id.

    Texts are read once into vectors of the terms that items have. Each task builds
    hierarchies over its documents, some thousands at a time, and walks them together with the hierarchy of items. A
    sample of documents (one of SEEDS by hash) is searched first: the kth score there is a floor under
    the final one, so it prunes and decides nothing; all documents are searched. The
    stated items are taken in blocks of about block_bytes of text, a pass over the
    documents for each. Terms are compared by 64-bit hashes.

    Ids are whole numbers; a null id comes after all others. Null and empty texts have no
    terms: such a document is never ranked, such an item has no rows. Rows that share an id are ranked each; of
    repeated items each has its own rows. Empty tables give no rows. Other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("own"), F.col(item_text).alias("text"))
    n = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes) or 1
    asked = asked.withColumn("b", F.pmod(F.xxhash64("own", "text"), F.lit(n)))
    spark, kind, parts = docs.sparkSession, asked.schema["own"].dataType, []
    for b in range(n):
        hashed = asked.where(F.col("b") == b).select(F.lit(0).cast("long").alias("id"), "own", "text")
        block = [(r.own, r.terms) for r in hashed.mapInArrow(own_rows, f"own {kind.simpleString()}, terms array<long>").collect()]  # about block_bytes of text
        names = F.broadcast(spark.createDataFrame([(i, own) for i, (own, _) in enumerate(block)], f"item long, own {kind.simpleString()}"))
        found = search_block(texts, [t for _, t in block], k)
        found = found.join(names, "item").select(F.col("own").alias(item_col), "rank", F.nullif("at", F.lit(LAST)).alias(id_col), "score")
        parts.append(found if n == 1 else materialise(found, "ranked"))
    return reduce(DataFrame.unionByName, parts)


def own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, hashes of the distinct terms) of each item."""
    for batch in batches:
        told = [r["terms"] for part in term_rows(None)(iter([batch])) for r in part.select(["terms"]).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["own"], pa.array(told, pa.list_(pa.int64()))], ["own", "terms"])
