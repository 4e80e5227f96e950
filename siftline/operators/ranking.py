"""Ranks, fusion and ordering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sets import ranked

RANK_CONSTANT = 60
#: Places of the levels of seniority.
SENIORITY = {"intern": 0, "junior": 1, "mid": 2, "senior": 3, "lead": 4, "principal": 5, "manager": 5, "director": 6, "executive": 7}
#: Distinct scores that the driver ranks; more are ranked by ranges of scores.
FEW_SCORES = 20_000


def competition_ranks(df: DataFrame, scores: dict[str, str]) -> tuple[DataFrame, int | None]:
    """(df with a rank for each score, rows or null): 1, 2, 2, 4 by falling score; rows without a score share the last
    rank. scores: {column: name of its rank}. Ranks come from the counts of distinct scores of all lists in one pass. Up
    to FEW_SCORES of them are ranked on the driver, which then also knows the number of rows; else each list is ranked
    by ranges. The ranks are the same."""
    lists = list(scores)
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("list"), F.col(c).cast("double").alias("v")) for i, c in enumerate(lists)]))
    counts = df.select(values.alias("x")).groupBy("x.list", "x.v").agg(F.count("*").alias("n"))
    few = counts.limit(FEW_SCORES + 1).collect()
    if len(few) > FEW_SCORES:
        for c, name in scores.items():
            df = competition_rank(df, c, name)
        return df, None
    rows = sum(r["n"] for r in few if r["list"] == 0)
    for i, (c, name) in enumerate(scores.items()):
        place, laid = 1, []
        for r in sorted((r for r in few if r["list"] == i), key=lambda r: (r["v"] is None, -(r["v"] or 0.0))):
            laid.append((r["v"], place))
            place += r["n"]
        ranks = df.sparkSession.createDataFrame(laid, f"__v double, `{name}` bigint")
        df = df.join(F.broadcast(ranks), F.col(c).cast("double").eqNullSafe(F.col("__v"))).drop("__v")  # FEW_SCORES rows at most
    return df, rows


def competition_rank(df: DataFrame, score: str, name: str) -> DataFrame:
    """competition_ranks of one score, by ranges: no task sees more than a range of the distinct scores."""
    counts = df.groupBy(F.col(score).alias("__score")).agg(F.count("*").alias("__n"))
    places = ranked(counts, [F.col("__score").desc_nulls_last()], name=name, weight="__n").select("__score", name)
    return df.join(places, df[score].eqNullSafe(places["__score"]), "inner").drop("__score")


def fused(ranks: list[Column], constant: int = RANK_CONSTANT) -> Column:
    """Reciprocal rank fusion over the lists that have entries."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.coalesce(1.0 / (constant + r), F.lit(0.0))
    return total


def seniority_order(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in SENIORITY.items() for x in kv]), F.lower(F.trim(c)))


def page(df: DataFrame, number: int, size: int = 10, pos: str = "pos") -> DataFrame:
    return df.where((F.col(pos) > (number - 1) * size) & (F.col(pos) <= number * size))


def top_page(df: DataFrame, order: list[Column], number: int, size: int = 10, pos: str = "pos") -> DataFrame:
    """One page of an order with its positions, without ordering the rest: each task keeps the rows up to the page's end."""
    from pyspark.sql import Window

    first = (number - 1) * size
    shown = df.orderBy(*order).limit(first + size)
    return page(shown.withColumn(pos, F.row_number().over(Window.orderBy(*order)).cast("bigint")), number, size, pos)  # a page and those before it
