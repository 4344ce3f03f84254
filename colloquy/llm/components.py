"""Connected components by repeated contraction.

Each round, every node moves to the neighbour (or itself) that comes first in a hashed order, and edges move with
their ends; edges whose ends have met go. Hashed order keeps chains short, so the rounds are logarithmic. Every round is
grouped minima (partial before the shuffle) and joins of written tables (split where one node is very common), and no
node's neighbours are ever gathered. A round's tables go when the next round's are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any one type -> (node, component): one row per node of an edge, the component being its least node."""
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    both = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    labels = materialize(both.distinct().withColumn("label", F.col("node")), "labels")
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))
        to = ends.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("label"), F.least(rank("a"), F.col("m"))["v"].alias("to"))
        to = materialize(to, "moves")
        moved = edges.join(to.select(F.col("label").alias("a"), F.col("to").alias("a2")), "a").join(to.select(F.col("label").alias("b"), F.col("to").alias("b2")), "b")
        old = edges, labels, to
        edges = materialize(moved.filter("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        labels = materialize(labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        for table in old:
            discard(table)
    least = materialize(labels.groupBy("label").agg(F.min("node").alias("component")), "least")
    return labels.join(least, "label").select("node", "component")
