"""WARC archives: a writer through Spark's committed files and a splittable reader.

An archive is a chain of gzip members, one for each record. A member ends in the four
bytes of its length, the last of which is zero below 16 MiB; so Spark's text writer, told
that lines end in a zero byte, writes members end to end, on any file system that it
reaches and with its own commit of finished tasks. The reader deals byte ranges to tasks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm._spark import join_counted, materialise, shared_dir

MAGIC = b"\x1f\x8b\x08"  #: of a gzip member
VERSION = b"WARC/"
LEVEL = 5  #: of compression
CHUNK = 1 << 20  #: bytes that a reader asks for at once
HEAD = 1 << 20  #: bytes in which the headers of a record end
ROW = "X-Row-Id"  #: extension field: the id of the row that a record was made of
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


EMPTY = member(b"")


def sha1_32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def lines(first: str, fields: dict[str, Any]) -> bytes:
    """A block of headers. Line ends inside a value would end its field, so they turn into spaces."""
    clean = lambda v: " ".join(str(v).splitlines()) if isinstance(v, str) else v
    return "\r\n".join([first, *(f"{k}: {clean(v)}" for k, v in fields.items() if v is not None), "", ""]).encode("utf-8", "surrogatepass")


def record(fields: dict[str, Any], block: bytes) -> bytes:
    return lines("WARC/1.1", fields | {"Content-Length": len(block)}) + block + b"\r\n\r\n"


def record_id(archive: str, n: int) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/{n}').urn}>"


def record_rows(archive: str):
    """The members of a partition's rows behind one that tells of the archive."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for batch in batches:
            for at in range(0, len(batch), 256):
                out = []
                for r in batch.slice(at, 256).to_pylist():
                    if not begun:
                        told = b"software: quoin\r\nformat: WARC File Format 1.1\r\n"
                        out.append(member(record({"WARC-Type": "warcinfo", "WARC-Date": DATE, "WARC-Record-ID": f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}/info/{r["uid"]}').urn}>", "Content-Type": "application/warc-fields"}, told)))
                        begun = True
                    payload = r["payload"]
                    again = r["first_uid"] is not None
                    http = lines("HTTP/1.1 200 OK", {"Content-Type": "text/html; charset=UTF-8", "Content-Length": len(payload)})
                    fields = {"WARC-Type": "revisit" if again else "response", "WARC-Target-URI": r["url"], "WARC-Date": DATE, "WARC-Record-ID": record_id(archive, r["uid"]), ROW: r["id"], "WARC-Payload-Digest": f"sha1:{sha1_32(r['sha1'])}", "Content-Type": "application/http; msgtype=response"}
                    if again:
                        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(archive, r["first_uid"])}
                    out.append(member(record(fields, http if again else http + payload)))
                # the last byte of a member is the writer's line end; an empty member gives a long one a zero there
                yield pa.RecordBatch.from_arrays([pa.array([m[:-1] if m[-1] == 0 else m + EMPTY[:-1] for m in out], pa.binary())], ["member"])

    return rows


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> None:
    """Write a record for each row into a new folder of archives (part-*.warc.gz).

    Of rows with equal payloads of `least` bytes or more, that with the smallest id (of
    equal ids any one) is a response, the others are revisits, which hold its record's id
    and no payload; a payload's length and digest stand in every record. Finished tasks are committed
    by Spark; what a lost one has written is not seen.

    A null text is an empty payload. A null id or url has no field in the record; a null id
    counts as larger than all others. An empty table gives no archive. Other columns are not read.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.monotonically_increasing_id().alias("uid"))
    # numbers of rows and payloads are written once: both readings below must see the same
    rows = materialise(rows.withColumns({"sha1": F.unhex(F.sha1("payload")), "sum": F.sha2("payload", 256)}), "payloads")
    order = F.struct(F.col("id").isNull().alias("no"), "id", "uid")
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("sum").agg(F.min(order).getField("uid").alias("lead"), F.count("*").alias("n")).where("n > 1")
    dealt = join_counted(rows, materialise(firsts, "firsts"), "sum", "n", rows.count())
    dealt = dealt.select("id", "url", "payload", "uid", "sha1", F.when(F.col("lead") != F.col("uid"), F.col("lead")).alias("first_uid"))
    members = dealt.mapInArrow(record_rows(path.rstrip("/").rsplit("/", 1)[-1]), "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none").text(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in files.listStatus(where):
        name = found.getPath().getName()
        if name.startswith("part-"):
            files.rename(found.getPath(), spark._jvm.org.apache.hadoop.fs.Path(where, name.removesuffix(".txt") + ".warc.gz"))


class Found(NamedTuple):
    start: int
    end: int
    fields: dict[str, str]
    block: bytes


class Bytes:
    """A file read forward from any place, a chunk at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.held = file, size, 0, b""

    def at(self, start: int, least: int = 1) -> memoryview:
        """What lies at `start`: `least` bytes, or what the file has."""
        if not self.base <= start <= self.base + len(self.held):
            self.base, self.held = start, b""
        while self.base + len(self.held) < min(start + least, self.size):
            self.held = self.held[start - self.base :]
            self.base = start
            self.file.seek(start + len(self.held))
            self.held += self.file.read(CHUNK)
        return memoryview(self.held)[start - self.base :]

    def find(self, start: int, stop: int) -> int:
        """Where the next magic begins, before `stop`; or -1."""
        while start < stop:
            view = self.at(start, len(MAGIC))[: stop - start + len(MAGIC) - 1]
            if view[: len(MAGIC)] == MAGIC:  # the usual case, behind the end of a record
                return start
            if (i := bytes(view).find(MAGIC)) >= 0:
                return start + i
            if len(view) < len(MAGIC):
                return -1
            start += len(view) - len(MAGIC) + 1
        return -1


def parsed(text: bytes) -> dict[str, str]:
    """The fields of a block of headers, names in lower case; a line that begins with a space continues a field."""
    out, name = {}, ""
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t"):
            out[name] = f"{out.get(name, '')} {line.strip()}"
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def decode(data: Bytes, start: int) -> Found | int | None:
    """The record whose member begins at `start`; where an empty member ends; or None, if
    what is there is no member, is damaged, or holds no record. A wrong candidate
    fails at its first bytes: a member's text must begin with WARC headers."""
    unpacker, at, parts, size, head, ask = zlib.decompressobj(31), start, [], 0, False, 512
    while not unpacker.eof:
        some, ask = bytes(data.at(at)[:ask]), min(4 * ask, CHUNK)
        if not some:
            return None
        try:
            text = unpacker.decompress(some)
        except zlib.error:
            return None
        at += len(some)
        parts.append(text)
        size += len(text)
        if not head and size:
            begun = b"".join(parts)
            if begun[: len(VERSION)] != VERSION[: len(begun)] or (b"\r\n\r\n" not in begun and size > HEAD):
                return None
            head, parts = b"\r\n\r\n" in begun, [begun]
    end = at - len(unpacker.unused_data)
    if not size:
        return end
    top, _, rest = b"".join(parts).partition(b"\r\n\r\n")
    fields = parsed(top)
    length = fields.get("content-length", "")
    if not length.isdecimal() or rest[int(length) :] != b"\r\n\r\n" or "warc-type" not in fields:
        return None
    return Found(start, end, fields, rest[: int(length)])


def owned(data: Bytes, start: int, stop: int) -> Iterator[Found]:
    """The records whose members begin in [start, stop)."""
    while (start := data.find(start, stop)) >= 0:
        found = decode(data, start)
        if isinstance(found, Found):
            yield found
            start = found.end
        else:
            start = found if found is not None else start + 1


INDEX = "path string, file_bytes long, range_start long, start long, end long, record_type string, record_id string, refers_to string, target_uri string, row_id string, payload_bytes long, payload_digest string, sound boolean"


def told(found: Found) -> tuple:
    """What the index says of a record. A revisit's payload is told by its headers alone."""
    kind, block, stated = found.fields["warc-type"], found.block, found.fields.get("warc-payload-digest")
    payload, length = block, None
    if found.fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = parsed(http).get("content-length")
    if kind == "revisit":
        n, digest, sound = int(length) if length and length.isdecimal() else None, (stated or "").removeprefix("sha1:") or None, True
    else:
        n, digest = len(payload), sha1_32(hashlib.sha1(payload).digest())
        sound = stated is None or not stated.startswith("sha1:") or stated == f"sha1:{digest}"
    return kind, found.fields.get("warc-record-id"), found.fields.get("warc-refers-to"), found.fields.get("warc-target-uri"), found.fields.get(ROW.lower()), n, digest, sound


def opened(path: str, size: int) -> Bytes:
    """A file by any path that Arrow's file systems know."""
    scheme, _, rest = path.partition(":")
    files, name = fs.FileSystem.from_uri(f"{scheme}://{'/' + rest.lstrip('/')}" if scheme == "file" else path)
    return Bytes(files.open_input_file(name), size)


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in INDEX.split(", ")]
    for batch in batches:
        for r in batch.to_pylist():
            data, rows = opened(r["path"], r["file_bytes"]), []
            with data.file:
                for found in owned(data, r["start"], r["stop"]):
                    after = found.end
                    while isinstance(beyond := decode(data, after), int):  # empty members belong to the record before them
                        after = beyond
                    rows.append((r["path"], r["file_bytes"], r["start"], found.start, after, *told(found)))
                    if len(rows) == 4096:
                        yield table_of(rows, names)
                        rows = []
            yield table_of(rows, names)


def table_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)


def ranges(spark: SparkSession, path: str, split: int) -> DataFrame:
    """(path, file_bytes, start, stop): byte ranges of the archives, one to a partition."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("path", F.col("length").alias("file_bytes")).where("file_bytes > 0")
    cut = files.withColumn("start", F.explode(F.expr(f"sequence(0L, file_bytes - 1, {int(split)}L)"))).withColumn("stop", F.least(F.col("start") + split, "file_bytes"))
    return cut.repartitionByRange(max(1, cut.count()), "path", "start")


def read_warc(spark: SparkSession, path: str, *, split: int | None = None) -> DataFrame:
    """An index of all records in a folder of archives: where each lies, its fields, and the
    length and SHA-1 (base 32) of its payload, counted from the decoded member.

    A task takes a byte range of `split` bytes (spark.sql.files.maxPartitionBytes, if none is
    given), looks for the magic of a gzip member, decodes what may be one until its text
    shows no WARC headers, and owns the records that begin inside its range, whose ends may lie beyond it.
    A member kept inside another's payload can look like a record to a task that
    begins in its midst; such rows lie inside the span of an earlier record and are
    taken out by the furthest end in the ranges before.

    Bytes that belong to no record (damage) are rows of record_type 'damaged', whose start and end
    tell where. sound: whether a stated digest fits the payload. Empty files and folders
    without archives have no rows. refers_to is the id of the record that a revisit repeats.
    """
    split = split or size_of(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    found = ranges(spark, path, split).mapInArrow(index_rows, INDEX)
    found = materialise(found, "warc-index")
    whole = Window.partitionBy("path").orderBy("range_start").rowsBetween(Window.unboundedPreceding, -1)
    reach = found.groupBy("path", "range_start").agg(F.max("end").alias("far"))  # a row for each range
    reach = reach.withColumn("reach", F.coalesce(F.max("far").over(whole), F.lit(0))).drop("far")
    true = found.join(reach, ["path", "range_start"]).where("start >= reach")
    inside = Window.partitionBy("path", "range_start").orderBy("start")
    gap = true.withColumn("since", F.coalesce(F.lag("end").over(inside), "reach")).where("start > since")
    gap = gap.select("path", "file_bytes", "range_start", F.col("since").alias("start"), F.col("start").alias("end"))
    last = true.groupBy("path", "file_bytes").agg(F.max("end").alias("start")).where("start < file_bytes")
    last = last.select("path", "file_bytes", F.col("start").alias("range_start"), "start", F.col("file_bytes").alias("end"))
    damage = gap.unionByName(last).withColumn("record_type", F.lit("damaged"))
    return true.drop("reach").unionByName(damage, allowMissingColumns=True).drop("range_start", "file_bytes")


def size_of(text: str) -> int:
    """Bytes of a size as Spark writes it: 128m, 16MB, 4096b."""
    text = text.strip().lower().removesuffix("b")
    return int(text[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[text[-1]] if text[-1] in "kmgt" else int(text)


def payload_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    data = path = None
    for batch in batches:
        for r in batch.to_pylist():
            if r["path"] != path:
                path, data = r["path"], opened(r["path"], r["end"])
            data.size = max(data.size, r["end"])
            found = decode(data, r["start"])
            block = found.block.partition(b"\r\n\r\n")[2] if found.fields.get("content-type", "").startswith("application/http") else found.block
            yield pa.RecordBatch.from_arrays([pa.array([r["record_id"]], pa.string()), pa.array([block], pa.binary())], ["record_id", "payload"])


def payloads(index: DataFrame) -> DataFrame:
    """(record_id, payload) of records in an index, each read at its place; revisits have none of their own."""
    places = index.where("record_type not in ('revisit', 'damaged')").select("path", "start", "end", "record_id")
    return places.repartitionByRange("path", "start").sortWithinPartitions("path", "start").mapInArrow(payload_rows, "record_id string, payload binary")


def resolved(index: DataFrame) -> DataFrame:
    """The index with refers_row, the row id of the record that a revisit repeats (null for others)."""
    asked = index.where("refers_to is not null").groupBy(F.col("refers_to").alias("record_id")).agg(F.count("*").alias("n"))
    known = index.where("record_type = 'response'").select("record_id", F.col("row_id").alias("refers_row"))
    lookup = materialise(asked.join(known, "record_id").select(F.col("record_id").alias("refers_to"), "refers_row", "n"), "referred")
    return join_counted(index, lookup, "refers_to", "n", index.count()).drop("n")


def round_trip(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, path: str | None = None, split: int | None = None) -> DataFrame:
    """Write the rows as archives and read these back: one row for each record of a row, with
    id_col, payload_bytes, payload_digest, record_type, refers_to (a row's id), sound."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/tables/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, id_col=id_col, url_col=url_col, html_col=html_col, least=least)
    kind = pages.schema[id_col].dataType
    index = resolved(read_warc(spark, path, split=split)).where("record_type in ('response', 'revisit', 'damaged')")
    as_id: Column = F.col("refers_row").cast(kind)
    return index.select(F.col("row_id").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", as_id.alias("refers_to"), "sound")
