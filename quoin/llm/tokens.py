"""Token ids in Re-Pair compressed blocks with random access."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quoin.llm._spark import materialise

END = 2  #: appended to each document
BLOCK = 1 << 17  #: ids of a block, which has a grammar of its own; a longer document is a block by itself
PAIRS = 5000  #: replaced in a round at most
LEAST = 2  #: occurrences of a pair that get it a rule
CACHE = 600_000  #: pieces of text whose ids a worker remembers before it drops the rarer
TEXT = pa.large_string()  #: no limit of 2 GB
CHUNK = 1 << 23  #: bytes of text that are encoded together, about, or one longer document

#: A piece of letters and marks. Below U+0250 Arrow and the pre-tokenizer agree on what a letter is.
LETTERS, MARKS = r"\n?[A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+", r"[!-/:-@\[-`{-~]{1,3}"

#: Texts whose white space is single spaces and newlines can be cut there: the byte-level
#: pre-tokenizer starts a new piece at each such place whatever stands around it.
UNEVEN = r"^ | $|  |\n\n|\n | \n|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of runs that begin at `start`, one run after another."""
    out = np.repeat(start - np.cumsum(size) + size, size)
    out += np.arange(len(out))
    return out


def spread(ids: np.ndarray, at: np.ndarray, put: np.ndarray | int) -> np.ndarray:
    """The ids with others put among them, which are to stand at the places `at`."""
    out, kept = np.empty(len(ids) + len(at), np.int32), np.ones(len(ids) + len(at), bool)
    kept[at] = False
    out[kept], out[at] = ids, put
    return out


class Encoder:
    """Encodes texts by the pieces between their spaces, each distinct piece once.

    Arrow splits the texts, numbers the distinct pieces of a call and finds those that are
    remembered; the tokenizers library encodes the others. A piece that starts a line has its
    newline before it. Letters with marks behind them are the ids of the letters and of the
    marks, which the pre-tokenizer parts. Texts with other white space than single spaces and
    newlines are encoded whole. Beyond CACHE only short pieces that were met again stay remembered.
    """

    loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that begin with a space, and the newline
        self.opens[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        self.opens[self.whole(["\n"])[0]] = True
        self.known = pa.array(["\n"], TEXT)  # after a space, without it; at the start of a line, with the newline; marks after letters, with a space
        self.pool = np.array(self.whole(["\n"])[0], np.int32)  # their ids one after another
        self.size, self.again = np.ones(1, np.int64), np.ones(1, bool)  # met again since it was learnt or kept

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text), about a MB of text at a time, as the library's results are large."""
        ids, sizes, start, held = [np.zeros(0, np.int32)], [], 0, 0
        for k, t in enumerate(texts, 1):
            held += len(t)
            if held >= 1 << 20 or k == len(texts):
                got, start, held = self.whole(texts[start:k]), k, 0
                sizes += map(len, got)
                ids.append(np.fromiter(chain.from_iterable(got), np.int32))
        return np.concatenate(ids), np.array(sizes, np.int64)

    def spell(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece), many pieces to a call of the library: a newline, or a token
        that begins with the space, begins a piece."""
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        spelt = pc.if_else(pc.starts_with(pieces, "\n"), pieces, pc.binary_join_element_wise(pa.scalar(" ", TEXT), pieces, pa.scalar("", TEXT)))
        bounds = pa.array([*range(0, len(pieces), 200), len(pieces)], pa.int32())
        ids, _ = self.flat(pc.binary_join(pa.ListArray.from_arrays(bounds, spelt), pa.scalar("", TEXT)).to_pylist())
        return ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))

    def learn(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of distinct pieces; new ones are encoded and remembered."""
        number = pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(number < 0)
        self.again[number[number >= 0]] = True
        found = pieces.take(pa.array(new))
        marks = pc.starts_with(found, " ")
        words, marks, last = found.filter(pc.invert(marks)), found.filter(marks), marks.to_numpy(zero_copy_only=False)
        number[np.concatenate([new[~last], new[last]])] = len(self.known) + np.arange(len(new))
        ids, size = self.spell(words)
        own, own_size = self.flat([m[1:] for m in marks.to_pylist()])
        self.pool, self.size = np.concatenate([self.pool, ids, own]), np.concatenate([self.size, size, own_size])
        self.again = np.append(self.again, np.zeros(len(new), bool))
        self.known = pa.concat_arrays([self.known, words, marks])
        return number

    def parts(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each piece) of distinct pieces."""
        parted = pc.match_substring_regex(pieces, f"^{LETTERS}{MARKS}$")
        both = pieces.filter(parted)
        units = pa.concat_arrays([pieces.filter(pc.invert(parted)), pc.replace_substring_regex(both, f"{MARKS}$", ""), pc.replace_substring_regex(both, f"^{LETTERS}", " ")]).dictionary_encode()
        number = self.learn(units.dictionary)
        n = number[units.indices.to_numpy()]
        parted = parted.to_numpy(zero_copy_only=False)
        at = np.cumsum(1 + parted) - 1 - parted
        part, plain = np.zeros(len(n), np.int64), len(n) - 2 * len(both)
        part[at[~parted]], part[at[parted]], part[at[parted] + 1] = n[:plain], n[plain : plain + len(both)], n[plain + len(both) :]
        size = self.size[part]
        start = np.cumsum(self.size) - self.size
        ids = self.pool[runs(start[part], size)]
        if len(self.known) > CACHE or self.known.nbytes > 100 * CACHE:
            self.again &= pc.less(pc.binary_length(self.known), 50).to_numpy(zero_copy_only=False)
            self.again[0] = True
            keep = np.flatnonzero(self.again) if 2 * self.again.sum() < CACHE else np.arange(1)
            self.known, self.pool, self.size = self.known.take(pa.array(keep)), self.pool[runs(start[keep], self.size[keep])], self.size[keep]
            self.again = np.zeros(len(keep), bool)
        return ids, np.add.reduceat(size, at)

    def encode(self, texts: list[str] | pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids of each text), end included."""
        if not len(texts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        texts = pc.fill_null(pa.array(texts, TEXT) if isinstance(texts, list) else texts.cast(TEXT), "")
        uneven = pc.match_substring_regex(texts, UNEVEN)
        odd = texts.filter(uneven).to_pylist()
        even = pc.if_else(uneven, pa.scalar("", TEXT), texts) if odd else texts
        lines = pc.binary_join_element_wise(pa.scalar("\n", TEXT), pc.replace_substring(even, "\n", " \n"), pa.scalar("", TEXT))
        del texts, even  # a call holds some copies of its texts
        split = pc.split_pattern(lines, " ")
        counts = pc.list_value_length(split).to_numpy()
        found = split.flatten().dictionary_encode()
        del lines, split
        pool, size = self.parts(found.dictionary)
        start, p = np.cumsum(size) - size, found.indices.to_numpy()
        start, size = start[p], size[p]
        starts = np.cumsum(counts) - counts
        start[starts] += 1  # the newline put before the text
        size[starts] -= 1
        ids, sizes = pool[runs(start, size)], np.add.reduceat(size, starts)
        if odd:  # they have no ids so far
            at = np.flatnonzero(uneven.to_numpy(zero_copy_only=False))
            own, sizes[at] = self.flat(odd)
            ids = spread(ids, runs((np.cumsum(sizes) - sizes)[at], sizes[at]), own)
        sizes += 1
        return spread(ids, np.cumsum(sizes) - 1, end), sizes


def compress(ids: np.ndarray, sizes: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, symbols of each document, rules, first rule of each round) of a block.

    Rounds go on until no pair inside documents comes LEAST times without overlap. A round gives the most frequent pairs, counted exactly, a
    nonterminal each and replaces their occurrences; where pairs overlap the more frequent
    one wins, and a pair that keeps fewer than LEAST waits. Pairs are taken down to a
    quarter of the best count; then that floor falls, so that rules go by frequency over
    the whole block. A pair of old symbols can only get rarer: what fell below LEAST is not
    counted again until a neighbour is replaced, and what is below the floor not until that falls.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    place_bits = n.bit_length()
    seq = np.append(ids, -1).astype(np.int32)  # position n stands for no neighbour
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    ends = np.cumsum(sizes)
    after[ends - 1], before[ends - sizes], after[n], before[n] = n, n, n, n
    there, level = np.ones(n + 1, bool), np.zeros(n + 1, np.uint8)  # bits of the count that the pair at a waiting position has at most
    there[n], mark = False, np.zeros(n + 1, bool)
    none = np.iinfo(np.int32).max
    rank_at = np.full(n + 1, none, np.int32)
    rules, rounds, made = [], [], 0
    floor, at = 0, np.flatnonzero(after < n)
    while True:
        bits = (vocabulary + made).bit_length()
        key = seq[at].astype(np.int64) << bits | seq[after[at]]
        if 2 * bits + place_bits < 64:  # places in order, pair by pair
            key = np.sort(key << place_bits | at)
            at = key & ((1 << place_bits) - 1)
            key >>= place_bits
        else:
            order = np.lexsort((at, key))
            at, key = at[order], key[order]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(key)))
        pairs, count = key[edge], size.copy()
        twin = np.flatnonzero(pairs >> bits == pairs & ((1 << bits) - 1))
        twin = twin[size[twin] > 1]
        if len(twin):  # of x x x, one pair of x
            own = at[runs(edge[twin], size[twin])]
            first = np.append(True, before[own[1:]] != own[:-1])
            run = np.maximum.accumulate(np.where(first, np.arange(len(own)), 0))
            count[twin] -= np.add.reduceat((np.arange(len(own)) - run) % 2, np.cumsum(size[twin]) - size[twin])
        if not floor and len(count):
            floor = max(LEAST, int(count.max()) // 4)
        best = np.flatnonzero(count >= max(LEAST, floor))
        wait = np.flatnonzero((count >= LEAST) & (count < floor))
        level[at[runs(edge[wait], size[wait])]] = np.repeat(np.frexp(count[wait].astype(np.float32))[1].astype(np.uint8), size[wait])
        if not len(best):
            if floor <= LEAST:
                break
            floor = max(LEAST, floor // 4)
            at = np.flatnonzero(level >= floor.bit_length())
            level[at] = 0
            continue
        order = np.argsort(-count[best], kind="stable")[:PAIRS]
        rank = np.full(len(best), none, np.int32)
        rank[order] = np.arange(len(order))
        at, rank = at[runs(edge[best], size[best])], np.repeat(rank, size[best])  # what is not replaced now is counted again
        spot = at
        if len(best) > PAIRS:
            spot, rank = at[rank < none], rank[rank < none]
        pairs = pairs[best[order]]
        rank_at[spot] = rank
        wins = (rank <= rank_at[before[spot]]) & (rank <= rank_at[after[spot]])
        rank_at[spot] = none
        spot, rank = spot[wins], rank[wins]
        first = np.ones(len(spot), bool)
        first[1:] = (before[spot[1:]] != spot[:-1]) | (rank[1:] != rank[:-1])
        run = np.maximum.accumulate(np.where(first, np.arange(len(spot)), 0))
        take = (np.arange(len(spot)) - run) % 2 == 0
        spot, rank = spot[take], rank[take]
        good = np.bincount(rank, minlength=len(pairs)) >= LEAST
        take = good[rank]
        spot, rank, pairs = spot[take], (np.cumsum(good) - 1)[rank[take]], pairs[good]
        rules.append(np.stack([pairs >> bits, pairs & ((1 << bits) - 1)], 1))
        rounds.append(made)
        right = after[spot]
        seq[spot] = vocabulary + made + rank
        made += len(pairs)
        there[right] = False
        level[right] = 0
        follow = after[right]
        after[spot] = follow
        before[follow] = spot
        left = before[spot]
        mark[spot] = mark[n] = True
        left = left[~mark[left]]
        mark[left] = True
        level[spot] = level[left] = 0
        rest = at[there[at] & ~mark[at]]
        mark[spot] = mark[left] = False
        at = np.concatenate([rest, spot[follow < n], left])
        if floor > LEAST and len(spot) < n >> 8:  # what is left above the floor goes on among the next
            floor = max(LEAST, floor // 4)
            more = np.flatnonzero(level >= floor.bit_length())
            level[more] = 0
            at = np.concatenate([at, more])
    per = np.add.reduceat(there[:n], ends - sizes, dtype=np.int64)
    return seq[there].astype(np.int64), per, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), np.array(rounds, np.int64)


def expansion_lengths(rules: np.ndarray, rounds: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids that each rule stands for."""
    length = np.ones(vocabulary + len(rules), np.int64)
    for s, e in zip(rounds, [*rounds[1:], len(rules)]):
        length[vocabulary + s : vocabulary + e] = length[rules[s:e, 0]] + length[rules[s:e, 1]]
    return length[vocabulary:]


def expand(symbols: np.ndarray, rules: np.ndarray, rounds: np.ndarray, vocabulary: int) -> np.ndarray:
    """The ids of any stretch of symbols, so also of one document alone."""
    length = np.concatenate([np.ones(vocabulary, np.int64), expansion_lengths(rules, rounds, vocabulary)])
    seq = symbols.astype(np.int64)
    size = length[seq]
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.int64)
    one, two = rules[:, 0].copy(), rules[:, 1].copy()
    while len(seq):  # each symbol is written and, if it stands for two, written over by them: they start where it starts and after the first
        out[at] = seq
        ruled = np.flatnonzero(seq >= vocabulary)
        rule, at = seq[ruled] - vocabulary, at[ruled]
        seq = one[rule]
        seq, at = np.concatenate([seq, two[rule]]), np.concatenate([at, at + length[seq]])
    return out


def parted(width: np.ndarray) -> list[int]:
    """Where to cut texts of a summed width into even parts of about CHUNK bytes, both ends included."""
    parts = max(1, round(int(width[-1]) / CHUNK)) if len(width) else 0
    inner = np.searchsorted(width, width[-1] / parts * np.arange(1, parts)) if parts else []
    return np.unique(np.concatenate([[0], inner, [len(width)]])).astype(int).tolist()


SCHEMA = "shard int, block int, ids array<{id}>, sizes binary, symbols binary, symbol_sizes binary, rules binary, rounds binary, lengths binary, width int, n_ids long"


def block_rows(path: str, end: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        encoder = Encoder.of(path)
        vocabulary = max(encoder.tokenizer.get_vocab_size(), end + 1)
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal block
            if held:
                keys = pa.concat_arrays([k for k, _, _ in held])
                ids, sizes = np.concatenate([i for _, i, _ in held]), np.concatenate([s for _, _, s in held])
                held.clear()
                symbols, per, rules, rounds = compress(ids, sizes, vocabulary)
                kind = np.uint16 if vocabulary + len(rules) <= 1 << 16 else np.uint32
                one = lambda x, t: pa.array([np.ascontiguousarray(x, t).tobytes()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), one(sizes, np.uint32), one(symbols, kind), one(per, np.uint32), one(rules, kind)]
                    + [one(rounds, np.uint32), one(expansion_lengths(rules, rounds, vocabulary), np.uint32), pa.array([kind().itemsize], pa.int32()), pa.array([len(ids)], pa.int64())],
                    names,
                )
                block += 1

        for b in batches:
            width = np.cumsum(pc.fill_null(pc.binary_length(b["text"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for k, upto in pairwise(parted(width)):
                part = b.slice(k, upto - k)
                ids, sizes = encoder.encode(part["text"], end)
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                s = 0
                while s < len(sizes):  # documents up to the end of the block
                    have = sum(len(i) for _, i, _ in held)
                    e = int(np.searchsorted(bounds, bounds[s] + BLOCK - have, "right")) - 1
                    if e <= s:
                        if held:
                            yield from flush()
                            continue
                        e = s + 1
                    held.append((part["id"].slice(s, e - s), ids[bounds[s] : bounds[e]], sizes[s:e]))
                    s = e
        yield from flush()

    return rows


def read_block(row: dict, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids of each document) of a block as stored."""
    kind = np.uint16 if row["width"] == 2 else np.uint32
    get = lambda c, t: np.frombuffer(row[c], t).astype(np.int64)
    return expand(get("symbols", kind), get("rules", kind).reshape(-1, 2), get("rounds", np.uint32), vocabulary), get("sizes", np.uint32)


def read_document(row: dict, vocabulary: int, k: int) -> np.ndarray:
    """The ids of document k of a block, without expanding the others."""
    kind = np.uint16 if row["width"] == 2 else np.uint32
    per = np.cumsum(np.concatenate([[0], np.frombuffer(row["symbol_sizes"], np.uint32).astype(np.int64)]))
    own = np.frombuffer(row["symbols"], kind)[per[k] : per[k + 1]]
    return expand(own, np.frombuffer(row["rules"], kind).astype(np.int64).reshape(-1, 2), np.frombuffer(row["rounds"], np.uint32).astype(np.int64), vocabulary)


def read_slice(row: dict, vocabulary: int, k: int, start: int, stop: int) -> np.ndarray:
    """The ids from start to stop of document k of a block: the stored lengths tell which
    symbols they lie in, and only those are expanded."""
    kind = np.uint16 if row["width"] == 2 else np.uint32
    per = np.cumsum(np.concatenate([[0], np.frombuffer(row["symbol_sizes"], np.uint32).astype(np.int64)]))
    own = np.frombuffer(row["symbols"], kind)[per[k] : per[k + 1]].astype(np.int64)
    length, ruled = np.ones(len(own), np.int64), own >= vocabulary
    length[ruled] = np.frombuffer(row["lengths"], np.uint32)[own[ruled] - vocabulary]
    ends = np.cumsum(length)
    start, stop = max(0, start), min(stop, int(ends[-1]) if len(ends) else 0)
    if start >= stop:
        return np.zeros(0, np.int64)
    a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
    ids = expand(own[a:b], np.frombuffer(row["rules"], kind).astype(np.int64).reshape(-1, 2), np.frombuffer(row["rounds"], np.uint32).astype(np.int64), vocabulary)
    skip = start - int(ends[a] - length[a])
    return ids[skip : skip + stop - start]


def digest_rows(path: str, end: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = max(Encoder.of(path).tokenizer.get_vocab_size(), end + 1)
        for b in batches:
            for k in range(len(b)):
                row = {c: b[c][k].as_py() for c in b.schema.names if c != "ids"}
                ids, sizes = read_block(row, vocabulary)
                data, bounds = memoryview(ids.astype("<u4").tobytes()), np.concatenate([[0], np.cumsum(sizes)])
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                keys = b["ids"].slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([keys, pa.array(bounds[:-1] + row["before"]), pa.array(sizes), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    return rows


def write_blocks(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """Encode every whole text, in ascending order of ids, into a table of compressed blocks.

    Texts are dealt into ranges of ids and sorted; each task (a shard) encodes its range
    with the tokenizer file at `path` and appends `end` to each document. Runs of up to
    BLOCK ids become a row: the document ids, their lengths, the symbols left after
    Re-Pair, its rules with the length that each expands to, and where each document's
    symbols lie. Spark's writer commits the rows as Parquet in the shared folder, so a lost
    executor loses nothing that was committed.

    Null and empty texts hold `end` alone. Null ids come first; rows with equal ids stand
    side by side in any order. An empty table gives no blocks.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ranged = rows.repartitionByRange(F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"))
    return materialise(ranged.mapInArrow(block_rows(path, end), SCHEMA.format(id=kind)), "blocks")


def read_blocks(blocks: DataFrame, path: str, *, id_col: str = "doc_id", end: int = END) -> DataFrame:
    """id_col, start (ids before the document in all shards), n_tokens and ids_crc32 (of the
    ids as little-endian unsigned 32-bit integers), decoded from a table of blocks."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # a row for each shard
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("of_shards"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # offsets are computed on two numbers a block, and meet the blocks by (shard, block)
    offsets = blocks.select("shard", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("in_shard")).join(shards, "shard")
    offsets = offsets.select(F.col("shard").alias("o_shard"), F.col("block").alias("o_block"), (F.col("in_shard") + F.col("of_shards")).alias("before"))
    placed = blocks.join(offsets, (F.col("shard") == F.col("o_shard")) & (F.col("block") == F.col("o_block")))
    placed = placed.select("ids", "sizes", "symbols", "rules", "rounds", "width", "before")
    return placed.mapInArrow(digest_rows(path, end), f"id {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
