"""Sets of documents: named filters, set algebra, people and versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored


def combined(members: DataFrame, need: int, group: str = "term_id", item: str = "doc_no") -> DataFrame:
    """(item, coverage): items in at least ``need`` of the sets; 1 is their union, the number of sets their intersection.
    One aggregation, whatever the number of sets."""
    return members.groupBy(item).agg(F.count_distinct(group).alias("coverage")).where(F.col("coverage") >= need)


def intersected(parts: list[DataFrame], item: str = "doc_no") -> DataFrame:
    return reduce(lambda a, b: a.join(b.select(item).distinct(), item, "left_semi"), parts)


def ordered_union(a: DataFrame, b: DataFrame, item: str = "doc_no", pos: str = "pos") -> DataFrame:
    """Rows of a in its order, then the new rows of b in its order."""
    both = a.select(item, F.lit(0).alias("src"), pos).union(b.select(item, F.lit(1), pos))
    first = both.groupBy(item).agg(F.min(F.struct("src", pos)).alias("at"))
    return ranked(first, [F.col("at.src"), F.col(f"at.{pos}")], item).select(item, "pos")


def ordered_minus(a: DataFrame, b: DataFrame, item: str = "doc_no", pos: str = "pos") -> DataFrame:
    return ranked(a.join(b.select(item), item, "left_anti"), [F.col(pos)], item).select(item, "pos")


#: Rows that one task may number, where the caller knows their number.
ONE_TASK = 500_000


def ranked(df: DataFrame, order: list[Column], *keep: str, name: str = "pos", rows: int | None = None, weight: str | None = None) -> DataFrame:
    """Positions from 1 over the whole set, without a single-partition window: rows are range-partitioned, numbered in
    their partition, and shifted by the counts of the partitions before. With a ``weight`` the position is 1 plus the
    weights of all rows before. ``rows``, where known to be ONE_TASK at most, lets one task do it; the result is the same."""
    size = F.col(weight) if weight else F.lit(1)
    if rows is not None and rows <= ONE_TASK:
        before = F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn(name, (F.coalesce(before, F.lit(0)) + 1).cast("bigint"))
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__id", F.monotonically_increasing_id())
    laid = stored(laid)  # range bounds come from a sample: both uses below must see the same partitions
    inner = F.sum(size).over(Window.partitionBy("__part").orderBy("__id").rowsBetween(Window.unboundedPreceding, -1))
    laid = laid.withColumn("__in", F.coalesce(inner, F.lit(0)) + 1)
    sizes = laid.groupBy("__part").agg(F.sum(size).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return laid.join(F.broadcast(before.select("__part", "__before")), "__part").withColumn(name, (F.col("__before") + F.col("__in")).cast("bigint")).drop("__part", "__id", "__in", "__before")


def representatives(docs: DataFrame, item: str = "doc_no", group: str = "dup_group") -> DataFrame:
    """The newest live version of each person: the largest number of each group, and all without a group."""
    live = docs.where(~F.coalesce("deleted", F.lit(False)))
    grouped = live.where(F.col(group).isNotNull()).groupBy(group).agg(F.max(item).alias(item)).select(item)
    return grouped.union(live.where(F.col(group).isNull()).select(item))


def collapsed(matches: DataFrame, docs: DataFrame, item: str = "doc_no", group: str = "dup_group") -> DataFrame:
    """(item, versions): of each person the newest version among the matches, with the number of its versions."""
    keyed = matches.join(docs.select(item, group), item).withColumn("person", person(group, item))
    return keyed.groupBy("person").agg(F.max(item).alias(item), F.count("*").alias("versions")).select(item, "versions")


def person(group: str = "dup_group", item: str = "doc_no") -> Column:
    return F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.concat(F.lit("d"), F.col(item).cast("string")))


def flags(members: dict[str, DataFrame], item: str = "doc_no") -> DataFrame:
    """(item, mask): bit i for the i-th filter, so that alone and leave-one-out counts of all come from one table."""
    marked = reduce(DataFrame.union, [m.select(item, F.lit(1 << i).alias("bit")) for i, m in enumerate(members.values())])
    return marked.distinct().groupBy(item).agg(F.sum("bit").cast("int").alias("mask"))


def diagnosis(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(condition, n, culprit): of an empty intersection the condition added last, and every one without which something
    would be found, with how many; no rows if the intersection isn't empty. One scan counts everything."""
    held = {n: F.coalesce(c, F.lit(False)) for n, c in conditions.items()}
    every = lambda skip: reduce(lambda a, b: a & b, [c for n, c in held.items() if n != skip], F.lit(True))
    counts = rows.agg(F.count_if(every(None)).alias("__all"), *[F.count_if(every(n)).alias(n) for n in held]).where("__all = 0")
    last = list(held)[-1]
    each = F.array(*[F.struct(F.lit(n).alias("condition"), F.col(n).alias("n"), F.lit(n == last).alias("culprit")) for n in held])
    return counts.select(F.explode(each).alias("x")).select("x.*").where("n > 0 or culprit")
