"""Question-graph counters: degree, neighbours in common, and second order, by joins on edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.operators.durable import durable


def edges(pairs: DataFrame) -> DataFrame:
    """Both directions of each (u, v), once."""
    return pairs.select("u", "v").union(pairs.select("v", "u")).distinct()


def degree(pairs: DataFrame) -> DataFrame:
    return edges(pairs).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"))


def common_neighbours(pairs: DataFrame) -> DataFrame:
    """(id, u, v, common): by joining each pair's edges, not by comparing sets held in memory."""
    e = edges(pairs)
    one = pairs.join(e.select("u", F.col("v").alias("x")), "u")
    both = one.join(e.select(F.col("u").alias("v"), F.col("v").alias("x")), ["v", "x"])
    found = both.groupBy("id", "u", "v").agg(F.count("*").alias("common"))
    return pairs.join(found, ["id", "u", "v"], "left").select("id", "u", "v", F.coalesce("common", F.lit(0)).alias("common"))


def second_order(pairs: DataFrame) -> DataFrame:
    """(id, u, v, common2): neighbours of neighbours in common, without u and v themselves."""
    e = durable(edges(pairs))
    hop = e.select("u", F.col("v").alias("m")).join(e.select(F.col("u").alias("m"), F.col("v").alias("x")), "m").select("u", "x").distinct()
    hop = durable(hop)
    one = pairs.join(hop, "u")
    both = one.join(hop.select(F.col("u").alias("v"), "x"), ["v", "x"]).filter("x <> u AND x <> v")
    found = both.groupBy("id", "u", "v").agg(F.count("*").alias("common2"))
    return pairs.join(found, ["id", "u", "v"], "left").select("id", "u", "v", F.coalesce("common2", F.lit(0)).alias("common2"))
