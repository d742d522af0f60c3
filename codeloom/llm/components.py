"""Connected components by alternating large-star and small-star steps; every step is a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, root: of the columns ``a`` and ``b`` (of one sortable type), each node that has an edge to another node.

    The root is the smallest node reachable.  Loops and nulls are ignored, repeated edges count once.  Each round is
    written to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    kind = edges.schema["a"].dataType
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stored(e, "edges")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges", e)
    return e.select(F.col("u").cast(kind).alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """Whether each node with a smaller neighbour has just one, which has none itself."""
    seen = e.groupBy("u").agg(F.count("*").alias("n")).select("u", (F.col("n") > 1).alias("bad"))
    inner = e.select(F.col("v").alias("u")).distinct().withColumn("bad", F.lit(True))
    return seen.where("bad").unionByName(seen.select("u").join(inner, "u")).isEmpty()
