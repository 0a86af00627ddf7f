"""Connected components by randomised contraction, in a logarithmic number of rounds.

Each round every vertex of the graph that is left points to the neighbour (or itself) of least random
rank, two pointers are followed, and edges move to where their ends point. The image of a connected
graph under a vertex map is connected, so components stay whole; a component is done when no edge is
left of it. Rounds work on tables in the shared folder; the driver sees one count a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each end of the edges (a, b): root is the same, and one vertex of it, throughout a component."""
    pair = edges.where("a <> b").select("a", "b")
    both = written(pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = both.select(F.col("a").alias("v"), F.col("a").alias("root")).distinct()
    if both.isEmpty():
        return labels
    turn = 0
    while True:
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(turn)), F.col(c).alias("at"))  # noqa: B023, E731
        first = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select("a", F.least("least", rank("a"))["at"].alias("to"))
        first = written(first, "pointers")
        second = first.select(F.col("a").alias("to"), F.col("to").alias("to2"))
        jump = written(first.join(second, "to").select("a", F.col("to2").alias("to")), "pointers")
        labels = written(labels.join(jump.select(F.col("a").alias("root"), "to"), "root", "left").select("v", F.coalesce("to", "root").alias("root")), "labels")
        moved = both.join(jump, "a").select(F.col("to").alias("a"), "b").distinct().join(jump.select(F.col("a").alias("b"), F.col("to").alias("to2")), "b").select("a", F.col("to2").alias("b"))
        both = written(moved.where("a <> b").distinct(), "edges")
        if both.isEmpty():
            return labels
        turn += 1
