"""Connected components of an edge table, wholly in Spark.

Roots hook onto their smallest neighbour, the forest is flattened by pointer jumping, edges are contracted to roots, and so
on until no edge is left. Each round is a table in the shared folder; nothing of the graph comes to the driver but counts.
A root with very many edges is no hot group: its neighbours are reduced by a partial minimum, and joins on it are split by
Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _flat(parent: DataFrame) -> DataFrame:
    """(v, p), p < v -> (v, root)."""
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = materialize(parent.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "cc-jump")
        parent = jumped.select("v", "p")
        if jumped.filter("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (v, component): each vertex that is not the smallest of its component, and that smallest vertex.

    Vertices without an edge, and the smallest ones, are left out. Loops and repeated edges do no harm.
    """
    edges = edges.filter("a <> b")
    labels = None
    while True:
        hooks = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p")).groupBy("v").agg(F.min("p").alias("p"))
        hooks = materialize(hooks, "cc-hook")
        if hooks.isEmpty():
            return labels if labels is not None else hooks.select("v", F.col("p").alias("component"))
        roots = _flat(hooks)
        if labels is None:
            labels = roots.select("v", F.col("p").alias("component"))
        else:
            moved = roots.select(F.col("v").alias("component"), F.col("p").alias("root"))
            old = labels.join(moved, "component", "left").select("v", F.coalesce("root", "component").alias("component"))
            labels = old.unionByName(roots.select("v", F.col("p").alias("component")).join(labels, "v", "left_anti"))
            labels = materialize(labels, "cc-labels")
        to = roots.select(F.col("v").alias("x"), F.col("p").alias("r"))
        edges = (
            edges.join(to.withColumnRenamed("x", "a").withColumnRenamed("r", "ra"), "a", "left")
            .join(to.withColumnRenamed("x", "b").withColumnRenamed("r", "rb"), "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            .filter("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
        edges = materialize(edges, "cc-edges")
        if edges.isEmpty():
            return labels
