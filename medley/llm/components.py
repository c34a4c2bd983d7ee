"""Connected parts of a link table by alternating large and small stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from medley.llm.common import written


def _stars(links: DataFrame) -> bool:
    """Whether every vertex that hangs on another (a on b) hangs on that one only, and nothing hangs on it."""
    sides = F.explode(F.array(F.struct(F.col("a").alias("v"), F.lit(1).alias("up")), F.struct(F.col("b").alias("v"), F.lit(0).alias("up")))).alias("x")
    seen = links.select(sides).groupBy("x.v").agg(F.sum("x.up").alias("ups"), F.min("x.up").alias("least"))
    return seen.where("ups > 1 or (ups = 1 and least = 0)").isEmpty()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(v, root) for every vertex of the links (a, b): root is the smallest vertex reachable.

    Minima are combined before the shuffle and joins stand directly above their shuffles, where adaptive
    execution splits a hot vertex. Links between equal vertices and repeated links do no harm. Rounds end when only stars
    are left. `rows` is a bound of the links, where one is known.
    """
    spark = edges.sparkSession
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), rows)
    size = now.count()
    while size and not _stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = written(small.select("e.a", "e.b").where("a != b").distinct(), size)
        size = now.count()
    # Every vertex now hangs on its root by one link; roots are added as their own.
    stars = now.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return stars.unionByName(roots) if size else spark.createDataFrame([], "v long, root long")
