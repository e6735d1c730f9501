"""Connected components of an edge list by randomised contraction.

Each round, every node joins its neighbour of least random rank (or stays); the edges are renamed and those inside a
node go. A constant share of the nodes is expected to vanish per round, so the number of rounds is logarithmic and the
data of a round linear. No edge list or component is held by the driver or by one task: a node with very many edges is
aggregated with partial sums, and the joins can be split by the engine where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspan.session import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the label is one node of the component. Nodes without an edge to another do not occur."""
    edges = materialise(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    labels, number = None, 0
    while not edges.isEmpty():
        rank = lambda name: F.struct(F.xxhash64(F.lit(number), name).alias("rank"), F.col(name).alias("node"))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Least of the neighbours and the node itself.
        steps = both.groupBy(F.col("a").alias("node")).agg(F.min(rank("b")).alias("least"))
        steps = steps.select("node", F.least("least", rank("node")).getField("node").alias("to"))
        steps = materialise(steps, "steps")
        left = steps.select(F.col("node").alias("a"), F.col("to").alias("x"))
        right = steps.select(F.col("node").alias("b"), F.col("to").alias("y"))
        renamed = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = materialise(
            renamed.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
        if labels is None:
            labels = steps.select("node", F.col("to").alias("label"))
        else:
            follow = steps.select(F.col("node").alias("label"), "to")
            labels = labels.join(follow, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = materialise(labels, "labels")
        number += 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
