"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of edges (a, b): component is the smallest id that it reaches.

    Alternates two steps until the edges don't change: each node links its larger neighbours to the least of all, then its
    smaller ones. Both keep the components and shorten the paths, in about log(n) rounds; no group is gathered.
    """
    now = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        new = written(large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).where("u <> v").select(F.col("v").alias("a"), F.col("u").alias("b")).distinct(), "edges")
        # both are sets: they are equal if they are as many and none is new
        if new.count() == now.count() and new.join(now, ["a", "b"], "left_anti").isEmpty():
            return new.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).union(new.select("a", "a").distinct())
        now = new
