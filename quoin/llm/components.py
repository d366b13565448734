"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm._spark import drop, materialise


def between(links: DataFrame) -> DataFrame:
    return links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) of all ends of links (a, b); label is the least node of the component.

    Each round hangs every root below its least neighbour, gives every node the label of its
    label, so that long chains shorten by half, and moves the links to the labels of their
    ends: those inside a label fall out and those between the same two become one, so the
    links of a dense component are joined in the first round alone. Rounds end when no link
    is left and no label changes, which the driver learns as one row each; the tables of a
    round go when the next are written.
    Links may repeat and stand in either direction; one with a null end or from a node to
    itself joins nothing and names no node. No links give no rows.
    """
    edges = materialise(between(links), "edges")
    first = edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")))
    hung, held, done = first.groupBy("node").agg(F.min("label").alias("label")), (), False
    while True:
        up = hung.select(F.col("node").alias("label"), F.col("label").alias("above"))
        step = materialise(hung.join(up, "label").select("node", F.col("label").alias("was"), F.col("above").alias("label")), "labels")
        drop(*held)
        label = step.select("node", "label")
        if done:  # no link is left
            if step.where("was != label").isEmpty():
                drop(edges)
                return label
            hung, held = label, (step,)
            continue
        a, b = (label.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}")) for c in "ab")
        moved = edges.join(a, "a").join(b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        moved = materialise(between(moved), "edges")
        drop(edges)
        edges, done = moved, moved.isEmpty()
        heard = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("heard"))
        root = F.col("label") == F.col("node")
        hung = label if done else label.join(heard, "node", "left").select("node", F.when(root, F.least("label", "heard")).otherwise(F.col("label")).alias("label"))
        held = (step,)
