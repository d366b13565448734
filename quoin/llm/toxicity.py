"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm._words import chunks
from quoin.llm.decontaminate import FOLD

BITS = 18  #: of a term's hash
TERMS = 4096  #: that the machine weighs, the most telling of the sample; others count nothing
FACTORS = 8
SAMPLE = 20_000  #: labelled rows to learn from, at most
TABLE = np.frombuffer(FOLD, np.uint8)


def terms(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row in the stretch, term) for stretches of texts; each term of a text once."""
    for row, t in chunks(column, fold=TABLE):
        pair = np.unique(t.text.astype(np.int64) << BITS | (t.hash >> np.uint64(64 - BITS)).astype(np.int64))
        yield row, t.n, pair >> BITS, pair & ((1 << BITS) - 1)


@dataclass
class Machine:
    """score = sigmoid(bias + sum of w + pairwise products of v), over the known terms of a text."""

    place: np.ndarray  # term -> row of w and v, the last row is all zero
    bias: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, n: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        at = self.place[term]
        known = at < len(self.w) - 1
        row, at = row[known], at[known]
        linear = np.bincount(row, self.w[at], minlength=n)
        pairs = np.zeros(n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            pairs += np.bincount(row, x, minlength=n) ** 2 - np.bincount(row, x * x, minlength=n)
        return self.bias + linear + 0.5 * pairs


def fit(labels: np.ndarray, row: np.ndarray, term: np.ndarray, *, factors: int = FACTORS, terms_kept: int = TERMS, epochs: int = 30, rate: float = 0.1, decay: float = 2e-4, seed: int = 7) -> Machine:
    """Learn from texts given by their (row, term) pairs, sorted by row, by AdaGrad on the log loss."""
    n, total = len(labels), 1 << BITS
    pos = np.bincount(term, labels[row], minlength=total)
    df = np.bincount(term, minlength=total)
    share = labels.mean() if n else 0.0
    bias = float(np.log((share * n + 0.5) / ((1 - share) * n + 0.5)))
    telling = np.abs(pos - df * share) / np.sqrt(df * share * (1 - share) + 1.0)
    kept = np.flatnonzero((df >= 3) & (df <= 0.5 * n))
    kept = np.sort(kept[np.argsort(-telling[kept], kind="stable")[:terms_kept]])
    k = len(kept)
    place = np.full(total, k, np.int32)
    place[kept] = np.arange(k)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(k + 1), rng.normal(0, 0.01, (k + 1, factors))
    v[k] = 0
    gw, gv, gb = np.full(k + 1, 1e-2), np.full((k + 1, factors), 1e-2), 1e-2
    at = place[term]
    row, at = row[at < k], at[at < k]
    bounds = np.searchsorted(row, np.arange(n + 1))
    for _ in range(epochs if k else 0):
        order = rng.permutation(n)
        for s in range(0, n, 256):
            batch = order[s : s + 256]
            size = bounds[batch + 1] - bounds[batch]
            own = np.repeat(np.arange(len(batch)), size)
            a = at[np.repeat(bounds[batch] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
            va = v[a]
            sums = np.zeros((len(batch), factors))
            np.add.at(sums, own, va)
            squares = np.bincount(own, (va * va).sum(1), minlength=len(batch))
            z = bias + np.bincount(own, w[a], minlength=len(batch)) + 0.5 * ((sums * sums).sum(1) - squares)
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            used, back = np.unique(a, return_inverse=True)
            dw = np.bincount(back, e[own], minlength=len(used)) + decay * w[used]
            dv = np.zeros((len(used), factors))
            np.add.at(dv, back, e[own, None] * (sums[own] - va))
            dv += decay * v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            gb += e.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            bias -= rate * e.sum() / np.sqrt(gb)
    return Machine(place, float(bias), w, v)


def sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, n, of, term in terms(b["text"]):
            bounds = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b["order"].slice(row, n), b["label"].slice(row, n), pa.ListArray.from_arrays(pa.array(bounds), pa.array(term.astype(np.int32)))], ["order", "label", "terms"])


def score_rows(machine):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, n, of, term in terms(b["text"]):
                z = machine.value.logits(n, of, term)
                yield pa.RecordBatch.from_arrays([b["id"].slice(row, n), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["id", "score"])

    return rows


def held_out(id_col: str):
    """Whether crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine fitted on at most `sample` labelled rows that are not held out, those of
    least hash of the id; only their terms reach the driver."""
    order = F.xxhash64(F.col(id_col).cast("string"))
    picked = labels.where(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("l_id"), F.col(label_col).cast("double").alias("label"), order.alias("order"))
    picked = picked.groupBy("l_id", "order").agg(F.max("label").alias("label")).orderBy("order", "l_id").limit(sample)  # of several labels the highest
    # `sample` rows of an id and a label: a bound that doesn't grow with the data
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(picked), F.col("id") == F.col("l_id")).select("order", "label", "text")
    got = rows.mapInArrow(sample_rows, "order long, label double, terms array<int>").orderBy("order").toArrow().combine_chunks()
    y = np.asarray(got["label"], np.float64)
    lists = got["terms"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    size = np.asarray(lists.value_lengths(), np.int64)
    return fit(y, np.repeat(np.arange(len(y)), size), np.asarray(lists.flatten(), np.int64))


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """id_col, held_out, score (0 to 1) and predicted (score >= 0.5) for every whole text.

    A text is the set of its folded words, hashed to BITS bits. A factorization machine
    weighs the TERMS most telling terms and, by inner products of their factors, all their
    pairs; it is fitted on the driver on a bounded sample and broadcast (about 2 MB, fixed).
    Null and empty texts score the bias alone, near the base rate; without any labelled
    row every score is 0.5. Repeated rows score alike; of several labels of an id the highest counts, once; an
    empty table gives no rows. Nothing but the text enters a score.
    """
    machine = learn(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, sample=sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(score_rows(docs.sparkSession.sparkContext.broadcast(machine)), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
