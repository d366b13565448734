"""Merkle manifest of a table: trees by appends, with a witness for each row.

Nodes of a tree come in order and are appended to open subtrees. When a run of siblings is
complete, each of them is told its siblings, that is, the witness of every leaf below it
grows by a level, and their parent is appended one level up. Aligned blocks of
FAN ** HEIGHT nodes are appended in tasks of their own; the roots of the blocks are nodes
of the next, shorter table, and so on until each tree has one node. Witnesses are then
handed down the same tables, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.llm._spark import materialise

FAN = 16
HEIGHT = 2  #: levels of a block
BLOCK = FAN**HEIGHT
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Node:
    """A digest and, once its run is complete, its siblings' digests and its parent."""

    __slots__ = ("digest", "left", "right", "parent")

    def __init__(self, digest: str):
        self.digest, self.left, self.right, self.parent = digest, "", "", None

    def path(self) -> list[dict[str, str]]:
        """The siblings on each level from here up to the last complete run."""
        node, out = self, []
        while node.parent is not None:
            out.append({"left": node.left, "right": node.right})
            node = node.parent
        return out


class Appends:
    """A tree that grows at its right end. Only the open runs are held, one on each level."""

    def __init__(self, fan: int = FAN):
        self.fan, self.runs = fan, [[]]

    def append(self, digest: str, level: int = 0) -> Node:
        node = Node(digest)
        if level == len(self.runs):
            self.runs.append([])
        self.runs[level].append(node)
        if len(self.runs[level]) == self.fan:
            self.complete(level)
        return node

    def complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        parent = self.append(hashlib.sha256("".join(n.digest for n in run).encode()).hexdigest(), level + 1)
        for i, node in enumerate(run):
            node.left, node.right, node.parent = "".join(n.digest for n in run[:i]), "".join(n.digest for n in run[i + 1 :]), parent

    def close(self, height: int = 0) -> Node:
        """Complete what is open: until one node remains, at `height` levels or above."""
        level = 0
        while level < height or len(self.runs[level]) != 1 or any(self.runs[level + 1 :]):
            if self.runs[level]:
                self.complete(level)
            level += 1
        return self.runs[level][0]


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(number, rows) of each block; its rows come one after the other."""
    key, parts = None, []
    for batch in batches:
        keys = list(zip(batch["tree"].to_pylist(), batch["block"].to_pylist()))
        begin = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[begin]:
                continue
            if parts and keys[begin] != key:
                yield key[1], pa.Table.from_batches(parts)
                parts = []
            key, begin, piece = keys[begin], i, batch.slice(begin, i - begin)
            parts.append(piece)
    if parts:
        yield key[1], pa.Table.from_batches(parts)


def closed(block: int, digests: list[str]) -> tuple[Node, list[Node]]:
    """(root, leaves) of a block. A first block that is not full is the only one of its tree,
    so it ends where one node remains; all others have the same height."""
    tree = Appends()
    leaves = [tree.append(d) for d in digests]
    return tree.close(0 if block == 0 and len(digests) < BLOCK else HEIGHT), leaves


def root_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, rows in whole_blocks(batches):
        root, _ = closed(block, rows["digest"].to_pylist())
        yield pa.RecordBatch.from_arrays([rows["tree"].slice(0, 1).combine_chunks(), pa.array([block], pa.int64()), pa.array([root.digest])], ["tree", "at", "digest"])


def path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block behind the row of its own witness, each with a witness of its own."""
    entries = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    for block, rows in whole_blocks(batches):
        above = rows["path"][0].as_py()
        nodes = rows.slice(1).combine_chunks()
        _, leaves = closed(block, nodes["digest"].to_pylist())
        top = rows["top"].combine_chunks().take(pa.array([0] * len(leaves)))
        one = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (nodes["tree"], nodes["at"], nodes["digest"], nodes["own"])]
        yield pa.RecordBatch.from_arrays([*one, pa.array([n.path() + above for n in leaves], entries), top], ["tree", "at", "digest", "own", "path", "top"])


def in_blocks(nodes: DataFrame) -> DataFrame:
    """Every block's rows in one partition, one after the other."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "at")


def grow(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The tables (tree, at, digest) from the nodes to one root for each tree."""
    levels = [nodes]
    while True:
        kind = nodes.schema["tree"].dataType.simpleString()
        below = levels[-1].select("tree", "at", "digest", F.expr(f"at div {BLOCK}").alias("block"))
        levels.append(materialise(in_blocks(below).mapInArrow(root_rows, f"tree {kind}, at long, digest string"), name))
        if levels[-1].where("at > 0").isEmpty():
            return levels


def descend(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The nodes of the lowest table with path, their siblings from the lowest level to
    the highest. top: the path of each tree's root and a column `top` that all inherit."""
    for nodes in reversed(levels[:-1]):
        own = nodes.schema["own"].dataType.simpleString() if "own" in nodes.columns else "int"
        nodes = nodes if "own" in nodes.columns else nodes.withColumn("own", F.lit(None).cast("int"))
        kind, inherits = nodes.schema["tree"].dataType.simpleString(), top.schema["top"].dataType.simpleString()
        first = top.select("tree", F.col("at").alias("block"), F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast(own).alias("own"), "path", "top")
        rest = nodes.select("tree", F.expr(f"at div {BLOCK}").alias("block"), "at", "digest", "own", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast(inherits).alias("top"))
        top = in_blocks(first.unionByName(rest)).mapInArrow(path_rows, f"tree {kind}, at long, digest string, own {own}, path {PATH}, top {inherits}")
    return top


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with at, their position inside their tree in the order of the named columns.

    Range partitions hold consecutive rows; of each only its first tree can have begun in
    an earlier one, so the corrections are one row for each partition."""
    by = [F.asc_nulls_first(c) for c in ("tree", *order)]
    ranged = materialise(rows.repartitionByRange(*by).withColumn("__part", F.spark_partition_id()), "leaves")
    counts = ranged.groupBy("__part", "tree").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.sum("n").over(earlier)).where("before > 0")
    counts = counts.select("__part", F.col("tree").alias("__tree"), "before")  # a row for each partition at most
    inside = Window.partitionBy("__part", "tree").orderBy(*by[1:])
    rows = ranged.withColumn("at", F.row_number().over(inside).cast("long") - 1)
    rows = rows.join(F.broadcast(counts.withColumnRenamed("__part", "__p")), (F.col("__part") == F.col("__p")) & F.col("tree").eqNullSafe(F.col("__tree")), "left")
    return rows.withColumn("at", F.col("at") + F.coalesce("before", F.lit(0))).drop("__part", "__p", "__tree", "before")


def leaf(fields: list[Column]) -> Column:
    """The digest of a row: each value as UTF-8 bytes behind their count, null as -."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said).cast("binary"), 256)


def proof_digest(path: Column) -> Column:
    """The digest of a witness: its siblings in order."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda p: F.array(p["left"], p["right"]))), "").cast("binary"), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf and its witness give."""
    return F.aggregate(path, digest, lambda acc, p: F.sha2(F.concat(p["left"], acc, p["right"]).cast("binary"), 256))


def tampered(id_col: str, text_col: str) -> tuple[Column, Column]:
    """(which rows a test of the manifest tampers with, their text): A-Z lower-cased where 5 divides the CRC-32 of the id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False)), F.translate(text_col, UPPER, LOWER)


def manifest(docs: DataFrame, *, id_col: str = "doc_id", tree_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """Every row's leaf, its witness and the roots above it.

    Leaves are digests of `fields`; those of one tree_col ascend by id and are hashed
    upwards, FAN consecutive ones at a time, until one node remains, the subroot. Subroots,
    null first, then by bytes, are hashed upwards likewise and give the root.

    Returns id_col, leaf, forged (the leaf of the row as tampered() changes it, for rows that it
    chooses, else null), path (the siblings left and right on each level, leaf to root), subroot, root.
    Nulls: a null value is hashed as -; a null tree_col is a tree, a null id comes first and
    is not tampered with. Empty and very long texts are hashed whole. Rows that share an id
    are leaves each, ordered by their digests; equal rows may change places. A tree of one leaf has that leaf as subroot, a
    table of one tree has its subroot as root. An empty table gives no rows. Other columns are not read.
    """
    chosen, changed = tampered(id_col, text_col)
    rows = docs.select(
        F.col(tree_col).alias("tree"),
        F.col(id_col).alias("id"),
        leaf([F.col(c) for c in fields]).alias("digest"),
        F.when(chosen, leaf([changed if c == text_col else F.col(c) for c in fields])).alias("forged"),
    )
    nodes = placed(rows, ["id", "digest"]).select("tree", "at", "digest", F.struct("id", "forged").alias("own"))
    levels = grow(nodes, "blocks")
    subroots = levels[-1].select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "digest")
    subroots = placed(subroots, ["source"]).select("tree", "at", "digest", F.struct("source").alias("own"))
    upper = grow(subroots, "tops")
    summit = upper[-1].select("tree", "at", F.array().cast(PATH).alias("path"), F.col("digest").alias("top"))
    tops = descend(upper, summit)
    tops = tops.select(F.col("own.source").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top"))
    out = descend(levels, tops)
    return out.select(F.col("own.id").alias(id_col), F.col("digest").alias("leaf"), "own.forged", "path", "top.subroot", "top.root")
