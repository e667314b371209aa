"""Connected components of an edge table by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trajmill.llm.common import stored


def _toward_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge beside the least node among u and its neighbours."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return edges.join(least, "u")


def _either(edges: DataFrame, one, other) -> DataFrame:
    """Two rows for each edge, from one reading of it: a union would put the whole plan of ``edges`` into the plan twice."""
    return edges.select(F.explode(F.array(F.struct(*one), F.struct(*other))).alias("_e")).select("_e.*")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _either(edges, ["u", "v"], [F.col("v").alias("u"), F.col("u").alias("v")])
    return _toward_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = F.col("m").alias("v")
    return _either(_toward_least(down), [F.col("v").alias("u"), least], ["u", least]).where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge but the roots: root is the least node of the component.

    Self-loops, repeated edges and nulls are ignored. Each round is a few joins on nodes; rounds are logarithmic in the
    length of chains and end when all edges lead to roots.
    """
    now = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v")
    while True:
        now = stored(_small_star(stored(_large_star(now), "stars")), "stars")
        # Done when every node has one edge and no root has an edge itself.
        nodes = _either(now, ["u", F.lit(1).alias("n")], [F.col("v").alias("u"), F.lit(0).alias("n")])
        unfinished = nodes.groupBy("u").agg(F.sum("n").alias("n"), F.min("n").alias("least")).where("n > 1 or (n = 1 and least = 0)")
        if unfinished.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
