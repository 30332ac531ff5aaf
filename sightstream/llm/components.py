"""Connected components of a graph given by its edges, by alternating large-star and small-star rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightstream.llm.common import new_path, remove


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long), any order, loops and repeats allowed -> (node, root), root being the smallest node reachable.

    Each round points nodes at smaller nodes of their neighbourhood, so depth shrinks geometrically; every round is a
    groupBy and a join, written to the shared folder. It ends when a round changes no edge.
    """
    spark = edges.sparkSession

    def save(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = new_path(spark, "edges")
        df.write.parquet(path)
        df = spark.read.schema("a long, b long").parquet(path)
        return df, path, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def star(both: DataFrame, larger: bool) -> DataFrame:
        """Each node's neighbours on one side, and the node itself in a small star, go to the smallest of all."""
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        side = both.where("b > a") if larger else both
        moved = side.join(least, "a").select(F.col("b").alias("x"), "m")
        if not larger:
            moved = moved.union(least.select("a", "m"))
        return moved.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()

    cur, path, seen = save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while seen[0]:
        large = star(cur.union(cur.select("b", "a")), larger=True)
        nxt, nxt_path, now = save(star(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), larger=False))
        remove(spark, path)
        cur, path, done, seen = nxt, nxt_path, now == seen, now
        if done:
            break
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select("b", "b").distinct())
