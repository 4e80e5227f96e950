"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stored


def union_find(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): connected components of (a, b), the root being the smallest node, by alternating large-star and
    small-star passes (Kiveris et al.): each pass is one shuffle, all state stays in tables, the number of passes grows
    with the logarithm of the longest chain. Nulls and loops have no rows; an empty table gives an empty result."""
    real = links.where("a is not null and b is not null and a <> b")
    edges = stored(real.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    previous = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = stored(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == previous:
            break
        previous = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
