"""Connected components of a link table by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternwatch.llm.common import materialize


def contract(edges: DataFrame) -> DataFrame:
    """``node, root``: a root for every node that occurs in ``edges`` (columns ``a, b``), the same within a component.

    Each round every node moves to its neighbour (or itself) of the least
    random priority, and the links move with it; links inside one node go.
    The nodes left shrink by a constant factor a round whatever the shape of
    the graph, since the priorities are drawn anew. Each round is written to
    the shared folder, which cuts the lineage. Empty input gives no rows.
    """
    links = materialize(edges.where("a != b").select("a", "b").distinct(), "links")
    roots, turn = None, 0
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v"))
        moved = both.groupBy("a").agg(F.least(F.min(rank("b")), F.first(rank("a"))).alias("r"))
        moved = materialize(moved.select(F.col("a").alias("node"), F.col("r.v").alias("to")), "moved")
        if roots is None:
            roots = moved.withColumnRenamed("to", "root")
        else:
            roots = materialize(roots.join(moved.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        to_a, to_b = moved.select(F.col("node").alias("a"), F.col("to").alias("x")), moved.select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = links.join(to_a, "a").join(to_b, "b").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        links, turn = materialize(links, "links"), turn + 1
    return roots if roots is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
