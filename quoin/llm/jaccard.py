"""Exact Jaccard self-join of word shingle sets: universe partition and pigeonhole."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm._spark import drop, materialise
from quoin.llm._words import BASES, Texts, chunks, lists, run_hashes, scramble, signed
from quoin.llm.components import components

SHINGLE = 5  #: words
PERCENT = 75  #: similarity that links
BAND = 4  #: sizes of a band differ by less than this factor
FILL = 0.45  #: segments of a band, to its largest size; a third is needed, the rest is slack for empty ones
SMALL = 5  #: sets up to this size differ in one element at most and are found by one-deletion neighbourhoods
HOT = 24  #: classes of a key that are compared in blocks
MANY = 4  #: classes of a component that is compared in blocks
BLOCK = 32
PASSES = 2  #: parts of the keys that are exchanged one after the other, so that a part alone lies on disks
ROUNDS = 3  #: partners that each class is compared with first
COUNTER_BITS = 18  #: of key frequencies: a fixed size, whatever the corpus
MAP_BITS = 1 << 23  #: of the map that spares sets without a candidate; also fixed
PAIRS = "a array<long>, b array<long>, classes array<long>, level int"  #: pairs of two blocks, and when they are verified


def shingles(t: Texts, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, sorted by text. A text of fewer
    words, but not none, has all its words as its one shingle."""
    at, h = t.windows(width)
    few = np.flatnonzero((np.diff(t.first) > 0) & (np.diff(t.first) < width))
    text = np.concatenate([t.text[at], few])
    h = np.concatenate([h, run_hashes(t.hash, t.first[few], t.first[few + 1], BASES[1])]) if len(few) else h
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[new], h[new]


def sums(text: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2**64 by text; text is sorted."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    bounds = np.searchsorted(text, np.arange(n + 1))
    return total[bounds[1:]] - total[bounds[:-1]]


def set_hashes(text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, hash) of the shingle set of each text."""
    return np.bincount(text, minlength=n).astype(np.int64), scramble(sums(text, scramble(h, 0x5851F42D4C957F2D), n))


def largest_partner(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return 100 * size // percent


def most_apart(size: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The largest symmetric difference of a set of this size and any set it links with."""
    return (100 - percent) * (size + largest_partner(size, percent)) // (100 + percent)


TOPS = SMALL * BAND ** np.arange(1, 26, dtype=np.int64)  #: the largest size of each band
SEGMENT, ELEMENT, DELETION = 0, 2, 3  #: parts of an allocation; SEGMENT + 1 is the next band's


def keys_of(text: np.ndarray, h: np.ndarray, size: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, ...]:
    """(text, part, key, elements, quota) of all keys of all sets, before allocation.

    Band b holds the sizes up to TOPS[b] that are above the band before. A set is indexed
    in its own band, and in the next one too if its largest partner lies there, so that
    every linked pair meets in the band of its larger set. In a band, elements fall into
    segments by their hash, and a key is the content of one non-empty segment. Sets that
    link differ in no more than `most_apart` segments; so the first quota = most_apart + 1
    keys of each, in one order common to all, share a key. This holds as soon as one of
    the two sets fills more segments than that; sets that don't are indexed by their
    single elements as well, which always are enough. Sets of up to SMALL elements are
    indexed by their whole content and by what is left of it after one deletion.
    """
    n, out = len(size), []
    own = np.searchsorted(TOPS, size) - (size <= SMALL)
    spills = largest_partner(size, percent) > np.where(size <= SMALL, SMALL, TOPS[np.maximum(own, 0)])
    quota = most_apart(size, percent) + 1
    short = np.zeros(n, bool)
    for shift in (0, 1):
        band = own + shift
        use = (size > 0) & (band >= 0) & (spills if shift else True)
        pick = use[text]
        if not pick.any():
            continue
        t, e = text[pick], h[pick]
        segments = np.maximum(np.ceil(FILL * TOPS[band[t]]), 64).astype(np.uint64)
        segment = ((scramble(e, 0x2545F4914F6CDD1D) >> np.uint64(32)) * segments) >> np.uint64(32)
        order = np.lexsort((segment, t))
        t, e, segment = t[order], e[order], segment[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (segment[1:] != segment[:-1])
        at = np.flatnonzero(new)
        content = np.add.reduceat(scramble(e, 0x9E6C63D0676A9A99), at)
        elements = np.diff(np.append(at, len(t)))
        t, segment = t[at], segment[at]
        key = scramble(content ^ scramble(segment << np.uint64(8) | (band[t] + 1).astype(np.uint64)))
        out.append((t, np.full(len(t), SEGMENT + shift), key, elements, quota[t]))
        short |= use & (np.bincount(t, minlength=n) < quota)
    pick = short[text]
    if pick.any():
        t = text[pick]
        out.append((t, np.full(len(t), ELEMENT), scramble(h[pick], 0xA0761D6478BD642F), np.ones(len(t), np.int64), quota[t]))
    pick = (size <= SMALL)[text]
    if pick.any():
        t, e = text[pick], scramble(h[pick], 0xE7037ED1A0B428DB)
        total, who, some = sums(t, e, n), np.unique(t), size[t] > 1
        t, left = np.concatenate([who, t[some]]), np.concatenate([total[who], (total[t] - e)[some]])
        out.append((t, np.full(len(t), DELETION), scramble(left, 0x8EBC6AF09C88C6E3), size[t], np.full(len(t), SMALL + 1)))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64), z, z
    return tuple(np.concatenate(c) for c in zip(*out))


def counter_of(key: np.ndarray) -> np.ndarray:
    return (key >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def allocate(keys: tuple[np.ndarray, ...], count: np.ndarray) -> np.ndarray:
    """Which keys to index: in each part of each set, the quota of the cheapest, that is
    of the rarest by the counters, then those with most elements."""
    text, part, key, elements, quota = keys
    order = np.lexsort((key, -elements, count[counter_of(key)], part, text))
    t, p = text[order], part[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
    start = np.flatnonzero(new)
    rank = np.arange(len(t)) - np.repeat(start, np.diff(np.append(start, len(t))))
    return order[rank < quota[order]]


def sketches(text: np.ndarray, h: np.ndarray, size: np.ndarray) -> pa.Array:
    """A histogram of each set: elements by the top bits of a hash, a bucket for two to
    four elements, counts up to 255 in a byte. Folding neighbouring buckets gives the
    coarser histogram of a smaller set."""
    bits = np.maximum(np.ceil(np.log2(np.maximum(size, 1) / 4)), 3).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(1 << bits)])
    bucket = (scramble(h, 0x1D8E4E27C47D124F) >> (64 - bits[text]).astype(np.uint64)).astype(np.int64)
    count = np.minimum(np.bincount(base[text] + bucket, minlength=base[-1]), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(base.astype(np.int32)), pa.py_buffer(count)])


def close_rows(percent: int):
    """Of pairs with their sketches, those whose sets may link: histograms of linked sets
    differ by no more than the sets do."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(len(b), bool)
            if not len(b):
                continue
            n = np.asarray(b["size_a"]) + np.asarray(b["size_b"])
            parts = []
            for c in ("sketch_a", "sketch_b"):
                _, where, raw = b[c].buffers()
                at = np.frombuffer(where, np.int32)[b[c].offset : b[c].offset + len(b) + 1].astype(np.int64)
                parts.append((at[:-1], np.diff(at), np.frombuffer(raw, np.uint8)))
            (at_a, of_a, raw_a), (at_b, of_b, raw_b) = parts
            shape = of_a << 32 | of_b
            for s in np.unique(shape):
                every = np.flatnonzero(shape == s)
                x, y = int(s >> 32), int(s & 0xFFFFFFFF)
                for k in range(0, len(every), max(1, (1 << 22) // max(x, y))):
                    at = every[k : k + max(1, (1 << 22) // max(x, y))]
                    z = min(x, y)
                    p = raw_a[at_a[at][:, None] + np.arange(x)].reshape(len(at), z, x // z).sum(2, dtype=np.int32)
                    q = raw_b[at_b[at][:, None] + np.arange(y)].reshape(len(at), z, y // z).sum(2, dtype=np.int32)
                    keep[at] = np.abs(p - q).sum(1) * (100 + percent) <= (100 - percent) * n[at]
            yield b.select([c for c in b.schema.names if c[:4] not in ("size", "sket")]).filter(pa.array(keep))

    return rows


class Classes:
    """Sets that a task has met, so that copies of a text are indexed once in a task."""

    def __init__(self) -> None:
        self.met: set[int] = set()

    def fresh(self, classes: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(classes), bool)
        for i, c in enumerate(classes.tolist()):
            if size[i] and c not in self.met:
                self.met.add(c)
                out[i] = True
        return out


def scan_rows(percent: int):
    """A row for each text (kind 0), and at a task's end one for each counter in use (kind 1)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, classes, names = np.zeros(1 << COUNTER_BITS, np.int64), Classes(), ["kind", "id", "size", "class", "sketch", "counter", "n"]
        kind_of_id = None
        for b in batches:
            kind_of_id = b["id"].type
            for row, t in chunks(b["text"], fold=True):
                text, h = shingles(t)
                size, cls = set_hashes(text, h, t.n)
                pick = classes.fresh(cls, size)[text]
                key = keys_of(text[pick], h[pick], size, percent)[2]
                count += np.bincount(counter_of(key), minlength=1 << COUNTER_BITS)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(t.n, np.int32)), b["id"].slice(row, t.n), pa.array(size), signed(cls), sketches(text, h, size), pa.nulls(t.n, pa.int32()), pa.nulls(t.n, pa.int64())], names)
        at = np.flatnonzero(count)
        if len(at):
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, kind_of_id), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(at.astype(np.int32)), pa.array(count[at])], names)

    return rows


def key_rows(percent: int, counters, turn: int):
    """The keys of one of PASSES parts, told apart by their hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, count = Classes(), counters.value
        for b in batches:
            for _, t in chunks(b["text"], fold=True):
                text, h = shingles(t)
                size, cls = set_hashes(text, h, t.n)
                pick = classes.fresh(cls, size)[text]
                keys = keys_of(text[pick], h[pick], size, percent)
                at = allocate(keys, count)
                at = at[keys[2][at] % np.uint64(PASSES) == turn]
                of = keys[0][at]
                yield pa.RecordBatch.from_arrays([signed(keys[2][at]), signed(cls[of]), pa.array(size[of])], ["key", "class", "size"])

    return rows


def set_rows(wanted):
    """The sets of those texts whose id is marked in a map of bits; others may slip in."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, bits = Classes(), wanted.value
        for b in batches:
            bit = (np.asarray(b["mark"]).view(np.uint64) % np.uint64(MAP_BITS)).astype(np.int64)
            b = b.filter(pa.array((bits[bit >> 3] >> (bit & 7)) & 1 == 1))
            for _, t in chunks(b["text"], fold=True):
                text, h = shingles(t)
                size, cls = set_hashes(text, h, t.n)
                keep = classes.fresh(cls, size)
                at = np.flatnonzero(keep)
                bounds = np.concatenate([[0], np.cumsum(size[at])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([signed(cls[at]), pa.ListArray.from_arrays(pa.array(bounds), signed(h[keep[text]]))], ["class", "elements"])

    return rows


def close(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) that their sketches allow to link; exact, as no linked pair fails."""
    more = [f for f in pairs.schema.fields if f.name not in ("a", "b")]
    for s in "ab":
        pairs = pairs.join(nodes.select(F.col("class").alias(s), F.col("size").alias(f"size_{s}"), F.col("sketch").alias(f"sketch_{s}")), s)
    schema = ", ".join(["a long", "b long", *[f"{f.name} {f.dataType.simpleString()}" for f in more]])
    return pairs.select("a", "b", *[f.name for f in more], "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(close_rows(percent), schema)


def set_table(classes: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(class, elements) of at least the classes asked for, as a table. A class is read off
    the text of its least id. A map of bits of fixed size tells which ids those are before
    a text is looked at; others that pass fall out in the joins that follow."""
    spark = rows.sparkSession
    mark = F.xxhash64("least")
    ids = classes.distinct().join(nodes.select("class", "least"), "class").select(F.when(mark % MAP_BITS < 0, mark % MAP_BITS + MAP_BITS).otherwise(mark % MAP_BITS).alias("bit"))  # 2**64 is a multiple of MAP_BITS
    found = ids.groupBy(F.shiftright("bit", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, cast(bit % 8 as int))")).alias("bits")).toPandas()
    wanted = np.zeros(MAP_BITS >> 3, np.uint8)  # 1 MB at most, however many classes
    wanted[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).astype(np.uint8)
    marked = rows.select(F.xxhash64("id").alias("mark"), "text")
    return materialise(marked.mapInArrow(set_rows(spark.sparkContext.broadcast(wanted)), "class long, elements array<long>"), "elements")


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, by the overlap of their whole sets. Tasks may
    have written a set more than once, so links may repeat."""
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("elements").alias("of_a")), "a")
    both = both.join(sets.select(F.col("class").alias("b"), F.col("elements").alias("of_b")), "b")
    met = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * met >= percent * (F.size("of_a") + F.size("of_b") - met)).select("a", "b")


def dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """(of, block, class): the classes of each group `of` in blocks of about BLOCK."""
    block = F.pmod(F.xxhash64("class"), F.ceil(F.col("n") / BLOCK)).cast("int")
    return rows.join(sizes, "of").select("of", block.alias("block"), "class")


def sides(named: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Large components and the classes outside that share a key with them, in blocks. A
    class and a component are one candidate, however many members the component has."""
    large = named.where("large").select("key", F.col("label").alias("of")).distinct()
    asks = named.where("beside").join(large, "key").where("label != of and (large is null or label < of)").select("class", "of").distinct()
    asks = materialise(asks, "asks")  # both sides read it
    told = named.where("large").select("class", F.col("label").alias("of")).distinct()
    told = told.join(asks.select("of").distinct(), "of", "left_semi")
    return tuple(dealt(x, x.groupBy("of").agg(F.count("*").alias("n"))) for x in (asks, told))


def level_of(apart: Column) -> Column:
    """When the pairs of two blocks so many blocks apart are verified: 0, then those up to 3
    apart, up to 15, up to 63. Each level has about four times the pairs of all before, so
    what a level links once lies in one component before many more pairs are read."""
    return F.ceil(F.log(4.0, apart + 1)).cast("int")


def hot_pairs(hot: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Lists a, b of classes (and each class once), packed by blocks of each key: of the classes of keys with HOT
    classes or more those pairs whose histograms allow a link. A pair counts at its first
    common hot key alone."""
    keys = hot.groupBy("class").agg(F.sort_array(F.collect_set("key")).alias("keys"))
    whole = hot.select("key", F.pmod(F.xxhash64("class"), F.ceil(F.col("g") / BLOCK)).cast("int").alias("block"), "class", "label").join(keys, "class").join(nodes.select("class", "size", "sketch"), "class")
    whole = whole.groupBy("key", "block").agg(F.collect_list(F.struct("class", "label", "keys", "sketch", "size")).alias("a"))
    pairs = whole.join(whole.select("key", F.col("block").alias("other"), F.col("a").alias("b")), "key").where("block <= other")
    return pairs.select("key", "a", "b", level_of(F.col("other") - F.col("block")).alias("level")).mapInArrow(hot_rows(percent), PAIRS)


def named_by(label: DataFrame, c: str, rows: DataFrame) -> DataFrame:
    """rows with the label of class c instead of it; a class without one is its own."""
    own = label.select(F.col("node").alias(c), F.col("label").alias("__label"))
    return rows.join(own, c, "left").withColumn(c, F.coalesce("__label", c)).drop("__label")


def hot_links(near: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Links among the pairs of ask_pairs and hot_pairs, by their whole sets, as links of the
    labels of their classes: each row of pairs meets the sets of its classes once. Only links
    that join what a row and the labels have not joined yet are told, fewer than a row has
    labels, since more would not change a component."""
    of = near.select("k", F.explode("classes").alias("class")).withColumn("label", F.col("class"))
    of = named_by(label, "label", of).join(sets, "class")
    of = of.groupBy("k").agg(F.collect_list(F.struct("class", "label", "elements")).alias("sets"))
    return near.join(of, "k").select("a", "b", "sets").mapInArrow(near_rows(percent), "a long, b long").distinct()


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of all classes after further links between labels."""
    new = components(links)
    moved = named_by(new, "label", label)
    alone = new.join(label.select("node"), "node", "left_anti")
    out = materialise(moved.select("node", "label").unionByName(alone.select("node", "label")), "labels")
    drop(label, new)
    return out


def folded(sketch: list[np.ndarray], to: int) -> np.ndarray:
    return np.stack([x.reshape(to, -1).sum(1, dtype=np.int32) for x in sketch])


def hot_rows(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                key, found = batch["key"][k].as_py(), []
                a, b = (batch[c].slice(k, 1).flatten() for c in "ab")
                (ids_a, (sk_a, _, n_a)), (ids_b, others) = sketched(a), sketched(b)
                (of_a, (ka, keys_a)), (of_b, (kb, keys_b)) = ((np.asarray(x.field("label"), np.int64), lists(x.field("keys"))) for x in (a, b))
                every = np.unique(np.concatenate([keys_a, keys_b]).view(np.int64))
                has = []
                for bounds, keys in ((ka, keys_a), (kb, keys_b)):
                    m = np.zeros((len(bounds) - 1, len(every)), bool)
                    m[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), np.searchsorted(every, keys.view(np.int64))] = True
                    has.append(m)
                here = int(np.searchsorted(every, key))
                same = len(ids_a) == len(ids_b) and set(ids_a) == set(ids_b)
                for i in range(len(ids_a)):
                    first = np.argmax(has[0][i] & has[1], axis=1) == here
                    ask = np.flatnonzero(first & (of_b != of_a[i]) & ((ids_b > ids_a[i]) | (not same)))
                    found += [(int(ids_a[i]), int(ids_b[j])) for j in near_of(sk_a[i], n_a[i], others, ask, percent)]
                if found:
                    yield packed(found, batch["level"][k].as_py())

    return rows


def near_rows(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                own, out = batch["sets"].slice(k, 1).flatten(), []
                at, values = lists(own.field("elements"))
                place = {c: n for n, c in enumerate(own.field("class").to_pylist())}
                labels, part = np.unique(np.asarray(own.field("label"), np.int64), return_inverse=True)
                labels, part = labels.tolist(), part.tolist()
                up = list(range(len(labels)))
                for x, y in zip(batch["a"][k].as_py(), batch["b"][k].as_py()):
                    i, j = place[x], place[y]
                    tops = [part[i], part[j]]
                    for n in (0, 1):
                        while up[tops[n]] != tops[n]:
                            up[tops[n]] = tops[n] = up[up[tops[n]]]
                    if tops[0] == tops[1]:
                        continue
                    p, q = values[at[i] : at[i + 1]], values[at[j] : at[j + 1]]
                    met = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * met >= percent * (len(p) + len(q) - met):
                        out.append((labels[part[i]], labels[part[j]]))
                        up[tops[0]] = tops[1]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return rows


def ask_pairs(asks: DataFrame, told: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Lists a, b of classes (and each class once): pairs of asks and of told with the same `of` whose histograms
    allow a link. A row that is compared holds two blocks of histograms, not of sets."""
    sketch = nodes.select("class", "size", "sketch")
    a, b = (side.join(sketch, "class").groupBy("of", "block").agg(F.collect_list(F.struct("class", "sketch", "size")).alias("some")) for side in (asks, told))
    pairs = a.select("of", F.col("some").alias("a")).join(b.select("of", F.col("block"), F.col("some").alias("b")), "of")
    return pairs.select("a", "b", level_of(F.col("block")).alias("level")).mapInArrow(ask_rows(percent), PAIRS)


def near_of(sketch: list[np.ndarray], size: int, others: list[list[np.ndarray] | np.ndarray], some: np.ndarray, percent: int) -> list[int]:
    """Which of `some` of the others (histograms, lengths, sizes) may link with a set."""
    histograms, width, sizes = others
    out, shape = [], np.minimum(width[some], len(sketch))
    for z in np.unique(shape):
        at = some[shape == z]
        apart = np.abs(folded([histograms[j] for j in at], z) - folded([sketch], z)).sum(1)
        out += at[apart * (100 + percent) <= (100 - percent) * (size + sizes[at])].tolist()
    return out


def sketched(own: pa.Array) -> tuple[np.ndarray, list]:
    """(classes, [histograms, their lengths, sizes]) of a list of structs."""
    sketch = [np.frombuffer(x.as_buffer(), np.uint8) for x in own.field("sketch")]
    return np.asarray(own.field("class"), np.int64), [sketch, np.array([len(x) for x in sketch]), np.asarray(own.field("size"), np.int64)]


def packed(found: list[tuple[int, int]], level: int) -> pa.RecordBatch:
    """The pairs of two blocks, and each class among them once: two blocks at most."""
    a, b = (list(side) for side in zip(*found))
    return pa.RecordBatch.from_arrays([*(pa.array([x], pa.list_(pa.int64())) for x in (a, b, sorted({*a, *b}))), pa.array([level], pa.int32())], ["a", "b", "classes", "level"])


def ask_rows(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                (ids_a, (sk_a, _, n_a)), (ids_b, others) = (sketched(batch[c].slice(k, 1).flatten()) for c in "ab")
                every = np.arange(len(ids_b))
                found = [(int(ids_a[i]), int(ids_b[j])) for i in range(len(ids_a)) for j in near_of(sk_a[i], n_a[i], others, every, percent)]
                if found:
                    yield packed(found, batch["level"][k].as_py())

    return rows


def open_keys(shared: DataFrame, label: DataFrame | None) -> DataFrame:
    """The keys whose classes lie in several components, with the label of each class."""
    group = Window.partitionBy("key")
    if label is None:
        return shared.withColumn("label", F.col("class"))
    named = shared.join(label.select(F.col("node").alias("class"), "label"), "class", "left").withColumn("label", F.coalesce("label", "class"))
    return named.withColumn("lo", F.min("label").over(group)).withColumn("hi", F.max("label").over(group)).where("lo != hi").select("key", "class", "size", "label")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The exact similarity join of all texts with all others, as classes and components.

    Words are lower-cased in A-Z and cut at ASCII white space; a text's set is its distinct
    5-word shingles, or all of a shorter text as one. Two texts link if their sets'
    Jaccard similarity is percent/100 or more. Texts with equal sets form a class, and only
    classes are joined. Candidates share a key (keys_of): sets of a size band are cut into
    segments of a partitioned universe, and by the pigeonhole principle linked sets agree
    in a segment among those that each is allocated (allocate, by cost: a table of fixed
    size counts keys over the whole corpus, so that frequent segments are passed over).
    Candidates whose histograms differ by more than linked sets can are dropped (close), the
    others are verified on whole sets: first each class with up to ROUNDS partners, which it
    shares most keys with; then, where a key's group still has several components, all pairs
    across, those with large components and of hot keys in blocks (sides, ask_pairs, hot_pairs), near
    blocks before others (level_of). Pairs inside one component can't change the result and are left out; none is dropped otherwise.

    Returns id_col, n_shingles, class (a hash of the set), component (a class of those that
    links join), component_id: the smallest id that links reach, by the id's own order. Null and empty texts have no shingles, a class
    of their own and no links. Repeated rows and equal sets are linked; rows that share an
    id are one node of the graph only where their sets link. Null ids come last when a
    smallest id is sought. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    scan = materialise(rows.mapInArrow(scan_rows(percent), f"kind int, id {kind}, size long, class long, sketch binary, counter int, n long"), "sets")
    texts = scan.where("kind = 0").select("id", "size", "class", "sketch")
    heavy = scan.where("kind = 1").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()  # a row for each counter at most
    count = np.zeros(1 << COUNTER_BITS, np.int64)
    count[heavy["counter"].to_numpy(np.int64)] = heavy["n"].to_numpy(np.int64)
    # what chance alone puts into a counter tells nothing of its keys
    count[count <= count.mean() + 6 * np.sqrt(count.mean()) + 2] = 0

    counters = spark.sparkContext.broadcast(count.astype(np.int32) if count.max(initial=0) < 1 << 31 else count)
    group = Window.partitionBy("key")
    nodes = materialise(texts.where("size > 0").groupBy("class").agg(F.first("size").alias("size"), F.any_value("sketch").alias("sketch"), F.min("id").alias("least")), "nodes")
    # keys of several classes; a class that several tasks met stands in a group once. With
    # them, from the same exchange, for each of ROUNDS orders the class that comes first
    head = lambda k: F.min(F.struct(F.xxhash64("class", F.lit(k)).alias("h"), "size", "class")).over(group)
    first = {f"head{k}": F.struct(head(k)["size"].alias("size"), head(k)["class"].alias("class"), F.lit(k).alias("k")) for k in range(ROUNDS)}
    parts = []
    for turn in range(PASSES):
        keys = rows.mapInArrow(key_rows(percent, counters, turn), "key long, class long, size long")
        ends = keys.withColumn("lo", F.min("class").over(group)).withColumn("hi", F.max("class").over(group)).where("lo != hi")
        parts.append(materialise(ends.select("key", "class", "size").distinct().withColumns(first), "keys"))
    shared = reduce(DataFrame.unionByName, parts)

    # each class with one partner for each order: of the classes that come first
    # in the groups of its keys, the one it shares most keys with
    heads = shared.select("class", "size", F.explode(F.array(*first)).alias("head")).where("class != head.class")
    heads = heads.where(f"100 * least(size, head.size) >= {percent} * greatest(size, head.size)").groupBy(F.col("class").alias("a"), F.col("head.class").alias("b"), "head.k").agg(F.count("*").alias("keys"))
    best = heads.groupBy("a", "k").agg(F.max_by("b", F.struct("keys", "b")).alias("b")).select("a", "b")
    tried = materialise(close(best.distinct(), nodes, percent), "pairs")
    sets = set_table(tried.select(F.explode(F.array("a", "b")).alias("class")), nodes, rows)
    met = materialise(links(tried, sets, percent), "links")
    drop(sets)
    label = components(met)
    drop(met)

    # what is left lies across components: with large ones and in hot keys by blocks, else by pairs
    many = label.groupBy("label").agg(F.count("*").alias("members")).where(F.col("members") >= MANY).select("label", F.lit(True).alias("large"))
    named = open_keys(shared.select("key", "class", "size"), label).join(many, "label", "left")
    beside = F.coalesce(F.max("large").over(group), F.lit(False))  # a large component shares the key
    named = materialise(named.withColumns({"g": F.count(F.when(F.col("large").isNull(), 1)).over(group), "beside": beside}), "open")
    drop(*parts)
    few = named.where("large is null")
    a, b = (few.where(F.col("g") < HOT).select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "size", "label")]) for s in "ab")
    across = a.join(b, "key").where(f"label_a != label_b and (size_a, class_a) < (size_b, class_b) and 100 * size_a >= {percent} * size_b")
    across = across.select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).distinct()
    for pair in (["a", "b"], ["b", "a"]):
        across = across.join(tried.toDF(*pair), ["a", "b"], "left_anti")
    across = materialise(close(across, nodes, percent), "pairs")
    drop(tried)
    asks, told = (materialise(x, "side") for x in sides(named))
    near = ask_pairs(asks, told, nodes, percent).unionByName(hot_pairs(few.where(F.col("g") >= HOT), nodes, percent))
    near = materialise(near.withColumn("k", F.monotonically_increasing_id()), "near")
    drop(asks, told, named)
    wanted = near.select(F.explode("classes").alias("class")).unionByName(across.select(F.explode(F.array("a", "b")).alias("class")))
    sets = set_table(wanted, nodes, rows)
    # near blocks first: what they link is one component when the others are verified
    more = [named_by(label, "b", named_by(label, "a", links(across, sets, percent))).select("a", "b")]
    for level in sorted(x.level for x in near.select("level").distinct().collect()) or [0]:  # a few numbers
        more.append(hot_links(near.where(F.col("level") == level), sets, label, percent))
        found = materialise(reduce(DataFrame.unionByName, more), "links")
        label = merged(label, found)
        drop(found)
        more = []
    drop(sets, near, across)

    # the least id of a component comes from its classes; each table is written before it is
    # joined, so that the rows of one component or of one class can be dealt to several tasks
    linked = materialise(nodes.select("class", "least").join(label.withColumnRenamed("node", "class"), "class"), "linked")
    least = materialise(linked.groupBy("label").agg(F.min("least").alias("of_all")), "least")
    linked = materialise(linked.select("class", "label").join(least, "label"), "linked")
    named = nodes.select("class", "least").join(linked, "class", "left")
    named = materialise(named.select("class", F.coalesce("label", "class").alias("component"), F.when(F.col("label").isNull(), F.col("least")).otherwise(F.col("of_all")).alias("component_id")), "named")
    texts = texts.drop("sketch").join(named, "class", "left")
    alone = F.col("size") == 0
    return texts.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "class", "component", F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def class_rows(text_col: str):
    """Rows as they come, with the class of their text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, t in chunks(b[text_col], fold=True):
                text, h = shingles(t)
                yield b.slice(row, t.n).append_column("__class", signed(set_hashes(text, h, t.n)[1]))

    return rows


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents with their own columns, one of each component: that of the smallest id.

    Documents without shingles link with nothing and stay. Rows that repeat an id are told
    apart by their sets: of those in one component whose smallest id is theirs one stays,
    the first by set, text and the other columns (of types that have an order).
    """
    found = materialise(near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent), "found")
    own = F.col(id_col).eqNullSafe(F.col("component_id"))
    ids = materialise(found.groupBy(F.col(id_col).alias("__id")).agg(F.count("*").alias("__rows"), F.count_if(own).alias("__own")), "ids")
    once = docs.join(ids.where("__rows = 1 and __own = 1").select("__id"), F.col(id_col).eqNullSafe(F.col("__id"))).select(*docs.columns)
    often = ids.where("__rows > 1 and __own > 0").select("__id")
    if often.isEmpty():
        return once
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "__class long"])
    several = docs.join(often, F.col(id_col).eqNullSafe(F.col("__id")), "left_semi").mapInArrow(class_rows(text_col), schema)
    first = found.where(own & (F.col("n_shingles") > 0)).groupBy(F.col(id_col).alias("__id"), "component").agg(F.min("class").alias("__first"))
    kept = several.join(first, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__class") == F.col("__first")))
    order = [c.name for c in docs.schema if "map<" not in c.dataType.simpleString() and "variant" not in c.dataType.simpleString()]
    kept = kept.withColumn("__n", F.row_number().over(Window.partitionBy(id_col, "__class").orderBy(*order))).where("__n = 1").select(*docs.columns)
    bare = set_hashes(np.zeros(0, np.int64), np.zeros(0, np.uint64), 1)[1].view(np.int64)[0]  # the class of texts without words
    return once.unionByName(kept).unionByName(several.where(F.col("__class") == int(bare)).select(*docs.columns))
