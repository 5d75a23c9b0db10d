"""Connected components over an edge table of any size, by contraction.

Each round points every node at its smallest neighbour if that is smaller, shortens the pointers to roots by doubling, and
replaces the edges by those between different roots. Every node but local minima goes in a round, so rounds are logarithmic.
Minima are aggregates with partial sums, so a node with very many neighbours isn't one task's work; each round is written to the
shared folder, so a lost executor doesn't replay the rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import materialize, release


ROWS_PER_FILE = 500_000


def _flatten(parent: DataFrame, parts: int) -> DataFrame:
    """(node, root) from (node, root) pointers to smaller nodes; root nodes have no row."""
    while True:
        up = parent.select(F.col("node").alias("root"), F.col("root").alias("above"))
        step = parent.select("node", "root").join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        step = materialize(step.coalesce(parts), "pointers")
        release(parent)
        if not step.where("moved").limit(1).count():
            return step
        parent = step


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id that occurs in the edges (a, b): label is the smallest id of its component. Materialized."""
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels, parts = None, 1 + edges.count() // ROWS_PER_FILE
    while True:
        both = edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("root"))
        parent = _flatten(materialize(least.where("root < node").coalesce(parts), "parents"), parts)
        pointer = parent.select("node", "root")
        if labels is None:
            new = least.select(F.col("node").alias("id")).join(pointer.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("label"))
        else:
            new = labels.select("id", F.col("label").alias("node")).join(pointer, "node", "left").select("id", F.coalesce("root", "node").alias("label"))
        new = materialize(new.coalesce(parts), "labels")
        low = edges.join(pointer.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
        low = low.join(pointer.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left").select("a", F.coalesce("rb", "b").alias("b"))
        low = low.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rest = materialize(low.coalesce(parts), "edges")
        release(edges, parent, labels)
        edges, labels = rest, new
        if not edges.limit(1).count():
            release(edges)
            return labels
