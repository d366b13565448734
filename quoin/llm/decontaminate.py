"""Benchmark decontamination by one Aho-Corasick scan of each text."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm._spark import materialise
from quoin.llm._words import slices

WINDOW = 13  #: words
MANY = 8  #: places of an anchor that are extended one by one
BLOCK_BYTES = 4 << 20  #: benchmark text in one automaton, which takes some forty times as much in each worker

#: A-Z to a-z; what separates words to a space; all else stays, byte for byte
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
FOUND = "n_words long, hits array<int>, items array<string>, spans array<int>"
DIGESTS = "n_hit long, n_items long, items_sha256 string, contaminated boolean"


def fold(text: bytes) -> bytes:
    """A text in UTF-8 with separators as spaces, of the same length, so that offsets hold."""
    return text.translate(FOLD)


class Scanner:
    """One automaton over items (id, text), each text scanned once.

    The automaton holds anchors: a window of an item of 13 words or more contains exactly one
    of the item's runs of 7 words that start at a multiple of 7. Where an anchor comes in a
    text, the match is extended to both sides word by word, and 13 words or more are hit.
    Of an anchor with many places the windows around all places stand in a table, in which the few windows
    of the text around it are looked up, so that a step serves all items at once.
    Shorter items are anchors as a whole.
    """

    def __init__(self, items: list[tuple[str, str | None]], width: int = WINDOW):
        self.width, self.ids = width, [i for i, _ in items]
        self.words = [fold((t or "").encode("utf-8", "surrogatepass")).split() for _, t in items]
        step = (width + 1) // 2
        anchors: dict[bytes, list[tuple[int, int]]] = {}
        short: dict[bytes, set[str]] = {}
        for k, words in enumerate(self.words):
            if 0 < len(words) < width:
                short.setdefault(b" ".join(words), set()).add(self.ids[k])
            for at in range(0, len(words) - step + 1, step) if len(words) >= width else ():
                anchors.setdefault(b" ".join(words[at : at + step]), []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for run in anchors.keys() | short.keys():
            places, around = anchors.get(run, []), None
            if len(places) > MANY:
                around, places = self.windows(places, step), []
            self.automaton.add_word(f" {run.decode('latin-1')} ", (len(run) + 2, run.count(b" ") + 1, places, around, short.get(run)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def windows(self, places: list[tuple[int, int]], step: int) -> dict[bytes, set[str]]:
        """The windows that hold an anchor at some places, and the items that have them."""
        out: dict[bytes, set[str]] = {}
        for k, p in places:
            own = self.words[k]
            for s in range(max(0, p + step - self.width), min(p, len(own) - self.width) + 1):
                out.setdefault(b" ".join(own[s : s + self.width]), set()).add(self.ids[k])
        return out

    def runs(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """(the hit words as [start, end), in order and apart; the items found)."""
        if not words or not len(self.automaton):
            return [], set()
        found = list(self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "))
        if not found:
            return [], set()
        first = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])  # the space before each word
        starts = np.searchsorted(first, [end - size + 1 for end, (size, *_) in found])
        done: dict[tuple[int, int], int] = {}  # of an item laid along the text: where its last match ends
        told: set[int] = set()  # sets of items that are in already
        hits, items = [], set()

        def meet(a: int, b: int, ids: set[str]) -> None:
            hits.append((a, b))
            if id(ids) not in told:
                told.add(id(ids))
                items.update(ids)

        for s, (_, (_, n, places, around, short)) in zip(starts.tolist(), found):
            if short:
                meet(s, s + n, short)
            for a in range(max(0, s + n - self.width), min(s, len(words) - self.width) + 1) if around else ():
                if ids := around.get(b" ".join(words[a : a + self.width])):
                    meet(a, a + self.width, ids)
            for k, p in places:
                own, offset = self.words[k], s - p
                if s < done.get((k, offset), 0):
                    continue
                a = b = s
                while a > 0 and a > offset and words[a - 1] == own[a - 1 - offset]:
                    a -= 1
                while b < len(words) and b - offset < len(own) and words[b] == own[b - offset]:
                    b += 1
                done[k, offset] = b
                if b - a >= self.width:
                    hits.append((a, b))
                    items.add(self.ids[k])
        return united(hits), items

    def scan(self, text: bytes) -> tuple[int, list[int], list[str], list[int]]:
        """Words; the hit words as flat [start, end) pairs; items; their code point spans in the text."""
        data = fold(text)
        words = data.split()
        runs, items = self.runs(words)
        if not runs:
            return len(words), [], [], []
        at = [m.span() for m in re.finditer(rb"[^ ]+", data)]
        point = lambda b: len(text[:b].decode("utf-8", "surrogatepass"))
        spans = [p for s, e in runs for p in (point(at[s][0]), point(at[e - 1][1]))]
        return len(words), [x for r in runs for x in r], sorted(items), spans


def united(runs: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def digest(n_words: int, hits: list[int], items: list[str], share: int) -> tuple[int, int, str, bool]:
    n_hit = sum(hits[1::2]) - sum(hits[::2])
    return n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0 and share * n_hit >= n_words


class Block:
    """A block of the benchmark as a broadcast; each worker builds its automaton once and
    forgets that of the block before, so it holds one."""

    held: tuple[str, Scanner] | None = None
    built = 0

    def __init__(self, items: Broadcast, width: int = WINDOW):
        self.items, self.width, self.key = items, width, uuid.uuid4().hex

    def scanner(self) -> Scanner:
        if Block.held is None or Block.held[0] != self.key:
            Block.held = self.key, Scanner(self.items.value, self.width)
            Block.built += 1
        return Block.held[1]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[int, Iterator[list[tuple[str, str | None]]]]:
    """(how many, the items block by block, each of about block_bytes of text); the driver holds one."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    dealt = items.withColumn("b", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    return n, (sorted((r.id, r.text or "") for r in dealt.where(F.col("b") == b).collect()) for b in range(n))


def scan_rows(block: Block, share: int, keep_clean: bool):
    """(id, sum, FOUND, DIGESTS) of each text, or of those with hits alone."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or b"" for t in part["text"].cast(pa.binary()).to_pylist()]
                found = [block.scanner().scan(t) for t in texts]
                at = [i for i, f in enumerate(found) if keep_clean or f[1]]
                told = [(*found[i], *digest(found[i][0], found[i][1], found[i][2], share)) for i in at]
                columns = list(zip(*told)) if told else [()] * 8
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
                sums = [] if keep_clean else [pa.array([hashlib.md5(texts[i]).hexdigest() for i in at], pa.string())]
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(at, pa.int32())), *sums, *arrays], ["id", *["sum"] * (not keep_clean), *(c.split()[0] for c in f"{FOUND}, {DIGESTS}".split(", "))])

    return rows


def union_rows(share: int):
    """Several blocks' findings of a text as one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for n, hits, items, spans in zip(*(batch[c].to_pylist() for c in ("n_words", "hits", "items", "spans"))):
                pairs = lambda flat: [x for r in united([p for f in flat for p in zip(f[::2], f[1::2])]) for x in r]
                one, ids = pairs(hits), sorted({i for some in items for i in some})
                told.append((one, ids, pairs(spans), *digest(n, one, ids, share)))
            columns = list(zip(*told)) if told else [()] * 7
            kinds = (pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch["id"], batch["sum"], batch["n_words"], *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", "sum", *(c.split()[0] for c in f"{FOUND}, {DIGESTS}".split(", "))])

    return rows


NO_ITEMS = hashlib.sha256(b"").hexdigest()


def hits_of_blocks(rows: DataFrame, blocks: Iterator[list[tuple[str, str | None]]], share: int) -> DataFrame:
    """(id, sum, FOUND, DIGESTS) of the texts with hits: a pass over rows (id, text) for each
    block, then the blocks' findings of a text together. sum is the text's MD5."""
    kind, parts = rows.schema["id"].dataType.simpleString(), []
    for items in blocks:
        block = Block(rows.sparkSession.sparkContext.broadcast(items))
        parts.append(materialise(rows.mapInArrow(scan_rows(block, share, False), f"id {kind}, sum string, {FOUND}, {DIGESTS}"), "hits"))
        block.items.unpersist()
    # rows with one id and text have the same hits in a block, so a text has a row for each block at most
    hits = reduce(DataFrame.unionByName, parts).select("id", "sum", "n_words", "hits", "items", "spans").distinct().groupBy("id", "sum", "n_words")
    return hits.agg(*[F.collect_list(c).alias(c) for c in ("hits", "items", "spans")]).mapInArrow(union_rows(share), f"id {kind}, sum string, {FOUND}, {DIGESTS}")


def text_sum(text: str):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: its words, those inside any benchmark window, the
    items found, their spans in the original text, and whether it is contaminated.

    Texts and items are folded alike (A-Z lower-cased, words of ASCII letters, digits and
    all non-ASCII characters). Every 13-word window of an item, or a shorter item as a
    whole, is found by one Aho-Corasick automaton (Scanner), and each text is scanned once, without a
    shuffle. Folding keeps byte offsets, so hits map back to code points of the original.
    A document is contaminated if it has hit words and they are 1/share of all or more.

    A benchmark above block_bytes is taken in blocks, one pass over the texts for each, so
    that neither the driver nor a worker ever holds more than a block; a pass writes its
    hits alone, and those of a text are united. The result is the same, spans included.

    Null or empty texts: no words, not contaminated. Items without words match nothing;
    items with equal texts are all reported; a null item_id reads as '', and items that
    share an id count once. Repeated rows are judged each. Empty tables work on either
    side. Other columns are not read, so none of them can clash.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n, blocks = blocks_of(benchmark, "item_id", "text", block_bytes)
    if n == 1:
        block = Block(docs.sparkSession.sparkContext.broadcast(next(blocks)))
        out = rows.mapInArrow(scan_rows(block, share, True), f"id {rows.schema['id'].dataType.simpleString()}, {FOUND}, {DIGESTS}")
        return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hits", "items", "spans")
    hits = hits_of_blocks(rows, blocks, share).withColumnRenamed("id", "h_id").drop("n_words")
    own = rows.select("id", text_sum("text").alias("own"), folded_words("text").alias("n_words"))
    both = own.join(hits, F.col("own").eqNullSafe(F.col("sum")) & F.col("id").eqNullSafe(F.col("h_id")), "left")
    none = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return both.select(F.col("id").alias(id_col), "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.lit(NO_ITEMS)).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"), none("hits"), none("items"), none("spans"))


def folded_words(text: str):
    """The number of folded words of a text column."""
    runs = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    return F.when(runs == "", 0).otherwise(F.length(runs) - F.length(F.replace(runs, F.lit(" "), F.lit(""))) + 1).cast("long")


def clean_rows(block: Block, text_col: str, share: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                keep = []
                for i, t in enumerate(part[text_col].cast(pa.binary()).to_pylist()):
                    n, hits, items, _ = block.scanner().scan(t or b"")
                    if not digest(n, hits, items, share)[3]:
                        keep.append(i)
                yield part if len(keep) == len(part) else part.take(pa.array(keep, pa.int32()))

    return rows


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their own columns. The hits of several
    blocks count together, so they are united before a text is judged.

    Null and empty texts stay, as they have no hits; rows that share an id, and repeated
    rows, are judged each by its own text. An empty benchmark keeps all; an empty table gives no rows."""
    n, blocks = blocks_of(benchmark, "item_id", "text", block_bytes)
    if n == 1:
        return docs.mapInArrow(clean_rows(Block(docs.sparkSession.sparkContext.broadcast(next(blocks))), text_col, share), docs.schema)
    hits = hits_of_blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), blocks, share)
    bad = hits.where("contaminated").select(F.col("id").alias("__id"), F.col("sum").alias("__bad"))
    texts = docs.withColumn("__sum", text_sum(text_col))
    return texts.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sum") == F.col("__bad")), "left_anti").drop("__sum")
