"""Bytes of a file held in memory, or read from any file system by ranges as they are asked for."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

from pyarrow import fs

BLOCK = 1 << 18  #: bytes read at once
HELD = 64  #: blocks kept


class Held:
    """A file in memory."""

    def __init__(self, data: bytes):
        self.data, self.size = data, len(data)

    def read(self, start: int, end: int) -> bytes:
        return self.data[max(0, start) : max(0, end)]

    def matches(self, pattern: re.Pattern[bytes], reach: int = 64) -> Iterator[tuple[int, re.Match[bytes]]]:
        """(place, match) of all matches of up to `reach` bytes, which don't overlap."""
        at = 0
        while at < self.size:
            stop = at + (1 << 20)
            part, after = self.read(at, stop + reach), stop
            for m in pattern.finditer(part):
                if at + m.start() >= stop:
                    break
                yield at + m.start(), m
                after = max(after, at + m.end())
            at = after

    def find(self, what: bytes, start: int) -> int:
        """Where `what` comes first at or after start; -1 if nowhere."""
        while start < self.size:
            part = self.read(start, start + (1 << 20))
            if (i := part.find(what)) >= 0:
                return start + i
            start += max(1, len(part) - len(what) + 1)
        return -1

    def close(self) -> None:
        pass


class Opened(Held):
    """A file by its path; some blocks of it are kept."""

    def __init__(self, path: str):
        scheme, _, rest = path.partition(":")
        local = scheme == "file" or not rest  # Spark writes file:/a for file:///a
        files, name = (fs.LocalFileSystem(), "/" + rest.lstrip("/") if rest else path) if local else fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(name)
        self.size, self.blocks = self.file.size(), OrderedDict()

    def block(self, k: int) -> bytes:
        if k not in self.blocks:
            self.file.seek(k * BLOCK)
            self.blocks[k] = self.file.read(BLOCK)
            if len(self.blocks) > HELD:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(k)
        return self.blocks[k]

    def read(self, start: int, end: int) -> bytes:
        start, end = max(0, start), min(end, self.size)
        if start >= end:
            return b""
        first = start // BLOCK
        if end <= (first + 1) * BLOCK:
            return self.block(first)[start - first * BLOCK : end - first * BLOCK]
        self.file.seek(start)
        return self.file.read(end - start)

    def close(self) -> None:
        self.file.close()
