"""What would narrow a result, counted in people as the filters themselves count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import ranking

#: Candidates, fewest people, and how many of each group are shown.
SKILLS, PLACES, LEAST = 80, 12, 2
SHOWN = {"skill": 4, "seniority": 3, "where": 3, "remote": 1, "avail": 2}
LABELS = {"now": 0, "1w": 1, "2w": 2, "1m": 3, "3m": 4}


def suggestions(members: DataFrame, profile: DataFrame, postings: DataFrame, doc_terms: DataFrame, terms: DataFrame, taken: list[int], limit: int) -> DataFrame:
    """(grp, value, n, pos): for skills, levels, places, remote, availability, rate and years the values that would leave
    LEAST to ``limit`` people and fewer than now, the best of each group.

    members: (doc_no, person). Candidates are the SKILLS most frequent skills not in ``taken``, counted again on strong
    postings, and the PLACES most frequent places, counted again as whole words. Every count is of distinct people by one
    aggregation; only candidates and totals reach the driver."""
    total = members.select("person").distinct().count()
    most = min(limit, total - 1)
    rows = members.join(profile.drop("person"), "doc_no")
    skills = terms.where(F.col("kind") == "skill").where(~F.col("term_id").isin(taken)).select("term_id", "slug")
    asked = doc_terms.join(members.select("doc_no"), "doc_no", "left_semi").groupBy("term_id").agg(F.count("*").alias("c")).join(skills, "term_id").orderBy(F.col("c").desc(), "slug").limit(SKILLS)
    strong = postings.where("strong").select("term_id", "doc_no").join(F.broadcast(asked.select("term_id", "slug")), "term_id")  # SKILLS rows
    cities = [r["city"] for r in rows.where("city <> ''").groupBy("city").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "city").limit(PLACES).collect()]
    place = F.array_compact(F.array(*[F.when(F.lower("location").rlike(T.place_pattern([c])), F.lit(c)) for c in cities])) if cities else F.array().cast("array<string>")
    item = lambda group, value, order: F.struct(F.lit(group).alias("grp"), value.cast("string").alias("value"), order.cast("bigint").alias("ord"))
    level = F.coalesce(ranking.seniority_order(F.col("level")), F.lit(9))
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.coalesce("label", F.lit("")))
    one = F.array_compact(F.array(F.when(F.col("level").isNotNull(), item("seniority", F.col("level"), level)), F.when(F.col("remote"), item("remote", F.lit(None), F.lit(0))), F.when(label.isNotNull(), item("avail", F.col("label"), label))))
    many = F.transform(place, lambda c: item("where", c, F.lit(0)))
    plain = rows.select("person", F.explode(F.concat(one, many)).alias("x")).select("person", "x.*")
    named = strong.join(members, "doc_no").select("person", F.lit("skill").alias("grp"), F.col("slug").alias("value"), F.lit(0).cast("bigint").alias("ord"))
    counts = plain.union(named).distinct().groupBy("grp", "value", "ord").agg(F.count("*").alias("n")).where(F.col("n").between(LEAST, most))
    by_label = F.col("grp") == "avail"
    order = Window.partitionBy("grp").orderBy(F.when(by_label, F.col("ord")).otherwise(-F.col("n")), F.when(by_label, -F.col("n")).otherwise(F.col("ord")), "value")  # candidates only
    shown = F.coalesce(*[F.when(F.col("grp") == g, n) for g, n in SHOWN.items()])
    placed = counts.withColumn("pos", F.row_number().over(order).cast("bigint")).where(F.col("pos") <= shown).select("grp", "value", "n", "pos")
    return placed.union(thresholds(rows, total, limit).withColumn("pos", F.lit(1).cast("bigint")))


def thresholds(rows: DataFrame, total: int, limit: int) -> DataFrame:
    """(grp, value, n): the largest limit of rate and the smallest floor of years, in whole numbers, that leave LEAST to
    ``limit`` people and fewer than ``total``. A person counts from the lowest rate and the most years of all versions;
    the sums run over distinct whole numbers, not over people."""
    most = min(limit, total - 1)
    out = None
    for group, field, best, bound, edge, wanted in (("rate", "rate", F.min, F.ceil, F.floor, F.max), ("years", "years", F.max, F.floor, F.ceil, F.min)):
        known = rows.where(F.col(field).isNotNull())
        people = known.groupBy("person").agg(bound(best(field)).cast("bigint").alias("t")).groupBy("t").agg(F.count("*").alias("k"))
        places = known.select(edge(field).cast("bigint").alias("t")).distinct()
        both = people.select("t", "k", F.lit(False).alias("edge")).union(places.select("t", F.lit(0).cast("bigint"), F.lit(True))).groupBy("t").agg(F.sum("k").alias("k"), F.max("edge").alias("edge"))
        order = F.col("t") if group == "rate" else F.col("t").desc()
        upto = both.withColumn("n", F.sum("k").over(Window.orderBy(order))).where("edge").where(F.col("n").between(LEAST, most))  # a row for each whole number
        chosen = wanted(F.struct(F.col("t"), F.col("n"))).alias("m")
        part = upto.agg(chosen).where("m is not null").select(F.lit(group).alias("grp"), F.col("m.t").cast("string").alias("value"), F.col("m.n").alias("n"))
        out = part if out is None else out.union(part)
    return out
