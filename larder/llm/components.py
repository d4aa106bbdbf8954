"""Connected components of an edge table by alternating large-star and small-star steps.

Edges never reach the driver; each step ends in a table in the shared folder.  The steps
need a number of rounds that grows with the logarithm of the number of nodes.

Defined results: edges of a node to itself and edges with a null end say nothing; repeated edges count once; an empty table
gives an empty result; nodes are 64-bit integers, further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import table

_SALTS = 16


def _neighbours_to_least(edges: DataFrame, keep) -> DataFrame:
    """For each node u of (u, v): (v, least of u and its neighbours) for the kept neighbours v.

    The minima come from partial aggregates; they are copied to salts before they meet the edges, so
    a node with a third of all edges is spread.  The copies are never broadcast: their number is not in Spark's estimate.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(_SALTS)).cast("int"))
    return salted.join(least.hint("merge"), ["u", "salt"]).filter(keep)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node of the component of every node of edges (columns a and b)."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = table(e, "edges"), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _neighbours_to_least(both, F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = _neighbours_to_least(large, F.lit(True))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        e = table(small, "edges")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
