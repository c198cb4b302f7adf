"""Connected components of a distributed link table by alternating stars.

Each round joins every node's larger neighbours to its smallest one (large star)
and its smaller neighbours to their smallest (small star) until nothing changes.
Tables of a round are written to the shared folder, so a lost executor costs one
round's task, and nothing is collected but row counts and checksums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import materialize


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: src > dst, distinct.  One star operation, with the result written."""
    if large:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m"))
        low = materialize(low.select("src", F.least("src", "m").alias("m")), "star-min")
        out = both.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    else:
        low = materialize(edges.groupBy("src").agg(F.min("dst").alias("m")), "star-min")
        out = edges.join(low, "src").filter("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        out = out.unionByName(low.select("src", F.col("m").alias("dst")))
    return materialize(out.filter("src <> dst").distinct(), "star")


def connected_components(links: DataFrame) -> DataFrame:
    """links: (a, b) of any order, repeats allowed.  Returns (node, component).

    Only nodes with a link to another appear; component is the smallest node.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct()
    edges = materialize(edges, "links")
    before = _mark(edges)
    while before[0]:
        edges = _star(_star(edges, True), False)
        after = _mark(edges)
        if after == before:
            break
        before = after
    pairs = edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return pairs.unionByName(edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())


def forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (x, y) of one task, few that connect the same nodes: a node and its group's smallest."""
    nodes, at = np.unique(np.r_[x, y], return_inverse=True)
    a, b = at[: len(x)], at[len(x) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]
