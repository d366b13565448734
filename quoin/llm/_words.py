"""Vectorised words, word hashes and window hashes over Arrow string columns.

Texts are taken as UTF-8 bytes. Words are maximal runs of bytes other than \\x20 and
\\x09-\\x0D. A hash of a run of symbols is a polynomial in an odd base modulo 2**64, read
off prefix sums, and then scrambled, so that one pass serves windows of every length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19  #: of text that is worked on at once: the arrays beside it take some fifty times as much


def release() -> None:
    """Give back what Arrow's pool holds unused: workers are kept for later stages."""
    pa.default_memory_pool().release_unused()


def slices(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in stretches of about `size` bytes of a string column, a row at least."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), np.int64)
    ends, row = np.cumsum(lengths), 0
    while row < len(batch):
        before = ends[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(row, stop - row)
        row = stop
    release()


def scramble(z: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    z = z + np.uint64(salt & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xDA942042E4DD58B5)


class Powers:
    """Powers of a base and of its inverse, as long as needed."""

    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls.known.get(base)
        if have is None or len(have[0]) < n:
            size = max(n, CHUNK_BYTES + 1)
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            have = (both[0], both[1])
            if size <= 4 * CHUNK_BYTES:
                cls.known[base] = have
        return have


def run_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of symbols[s:e] for all pairs of starts and ends."""
    power, inverse = Powers.of(base, len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * power[: len(symbols)], out=total[1:])
    return scramble((total[ends] - total[starts]) * inverse[starts])


class Texts:
    """Some texts side by side: words with their text, place, bytes and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool | np.ndarray):
        """fold: lower-case A-Z for the hashes; or a table of bytes to translate the texts by."""
        self.n = len(offsets) - 1
        if fold is not True and fold is not False:
            data, fold = fold[data], False
        self.data, self.offsets = data, offsets
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty_like(inside)
        if len(data):
            before[0] = False
            before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros_like(inside)
        after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)  # the words of text i: first[i] to first[i + 1]
        self.text = np.repeat(np.arange(self.n), np.diff(self.first))
        self.hash = run_hashes(BYTE[LOWER[data] if fold else data], self.starts, self.ends, BASES[0])

    def windows(self, width: int, base: int = BASES[1]) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of all windows of so many consecutive words of one text."""
        count = len(self.starts) - width + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[:count] == self.text[width - 1 :])
        return at, run_hashes(self.hash, at, at + width, base)

    def words(self, i: int) -> list[bytes]:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes().split()


def chunks(column: pa.Array | pa.ChunkedArray, fold: bool | np.ndarray = False) -> Iterator[tuple[int, Texts]]:
    """(first row, texts) for stretches of about CHUNK_BYTES of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1)
        stop = min(stop, len(column))
        yield row, Texts(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], fold)
        row = stop
    release()


def lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of lists of longs; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), np.asarray(column.flatten(), np.int64).view(np.uint64)


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def within(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of (text, h), so that the sets of several texts can be held side by side."""
    return scramble(h ^ scramble(text.astype(np.uint64) + np.uint64(1)))
