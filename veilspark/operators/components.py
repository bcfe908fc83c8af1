"""Connected components on an edge DataFrame by contraction and pointer jumping.

Each round every vertex points to the smallest vertex of its closed
neighbourhood; the pointers form a forest, which pointer jumping flattens in a
logarithmic number of joins; the edges are then rewritten between roots and
loops dropped.  A vertex with an edge always merges with another one, so the
number of roots with edges at least halves each round, and a path of any
length needs no more rounds than its logarithm.  The loop ends when no edge is
left, never at a fixed number of rounds.

Every step is written to a table in the folder of ``spark.checkpoint.dir``: a
lost executor recomputes a step, not the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _flatten(parent: DataFrame) -> DataFrame:
    """``(v, root)`` of a forest ``(v, p)`` whose roots point to themselves."""
    while True:
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        jumped = materialize(parent.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")), "jump")
        parent = jumped.select("v", "p")
        if jumped.where("moved").limit(1).count() == 0:
            return parent.select("v", F.col("p").alias("root"))


def connected_components(edges: DataFrame, vertices: DataFrame | None = None, src: str = "src",
                         dst: str = "dst") -> DataFrame:
    """Return ``(vertex, component)`` where ``component`` is the smallest
    vertex id reachable from ``vertex``.  Vertex ids must be orderable; null
    ends and loops are ignored as edges."""
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a <> b")
    own = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v")))
    if vertices is not None:
        own = own.unionByName(vertices.select(F.col(vertices.columns[0]).alias("v")).where("v IS NOT NULL"))
    labels = materialize(own.distinct().select("v", F.col("v").alias("root")), "labels")
    left = materialize(pairs.select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("v"), F.least("a", "m").alias("p"))
        roots = _flatten(materialize(parent, "parents"))
        to = roots.withColumnRenamed("root", "r")
        left = materialize(
            left.join(to.withColumnRenamed("v", "a"), "a").select(F.col("r").alias("ra"), "b")
            .join(to.withColumnRenamed("v", "b"), "b").select("ra", F.col("r").alias("rb"))
            .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges")
        labels = materialize(labels.join(to.withColumnRenamed("v", "root"), "root", "left").select(
            "v", F.coalesce("r", "root").alias("root")), "labels")
    return labels.select(F.col("v").alias("vertex"), F.col("root").alias("component"))
