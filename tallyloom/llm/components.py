"""Connected components of an edge table, as tables throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.runtime import materialise


def _to_roots(parent: DataFrame) -> DataFrame:
    """Let each node point to the root of its tree, doubling the step in each round."""
    while True:
        above = parent.select(F.col("node").alias("parent"), F.col("parent").alias("_above"))
        jumped = materialise(parent.join(above, "parent", "left").select("node", F.coalesce("_above", "parent").alias("parent"), F.col("_above").isNotNull().alias("_moved")), "jump")
        parent = jumped.drop("_moved")
        if jumped.where("_moved").isEmpty():
            return parent


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for each node of ``edges``.

    Each node hooks to its smallest neighbour below it, trees are flattened, and edges between trees
    that are left are contracted and hooked again. Repeated edges and loops do no harm; edges with a null end are left out.
    """
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nodes = ends.select(F.col(a).alias("node")).union(ends.select(F.col(b).alias("node"))).distinct()
    labels = materialise(nodes.select("node", F.col("node").alias("label")), "labels")
    current = materialise(ends.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "edges")
    while not current.isEmpty():
        root = _to_roots(materialise(current.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), "hook"))
        lead = root.select(F.col("node").alias("label"), F.col("parent").alias("_lead"))
        labels = materialise(labels.join(lead, "label", "left").select("node", F.coalesce("_lead", "label").alias("label")), "labels")
        left = root.select(F.col("node").alias("a"), F.col("parent").alias("_a"))
        right = root.select(F.col("node").alias("b"), F.col("parent").alias("_b"))
        moved = current.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        current = materialise(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return labels
