"""Edits of a vocabulary; problems() after each says what an edit broke."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .extract import vocabulary_problems as problems

__all__ = ["added", "aliased", "merged", "problems"]


def added(terms: DataFrame, slug: str, canonical: str, kind: str, aliases: list[str], implies: list[str]) -> DataFrame:
    """With one more term, numbered after the largest; a slug in use is an error."""
    if not terms.where(F.col("slug") == slug).isEmpty():
        raise ValueError(f"SLUG_IN_USE: {slug}")
    number = terms.agg(F.coalesce(F.max("term_id"), F.lit(0)) + 1).first()[0]
    new = terms.sparkSession.createDataFrame([(number, kind, slug, canonical, aliases, implies)], "term_id int, kind string, slug string, canonical string, aliases array<string>, implies array<string>")
    return terms.unionByName(new, allowMissingColumns=True)


def aliased(terms: DataFrame, slug: str, form: str) -> DataFrame:
    """With one more form of a term, once."""
    return terms.withColumn("aliases", F.when(F.col("slug") == slug, F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.lit(form)))).otherwise(F.col("aliases")))


def merged(terms: DataFrame, gone: str, kept: str) -> DataFrame:
    """(slug, canonical, forms, implied) with ``gone`` merged into ``kept``: its forms move, references to it are turned,
    and no term implies itself. Null lists are empty."""
    none = F.array().cast("array<string>")
    slug = F.when(F.col("slug") == gone, kept).otherwise(F.col("slug"))
    forms = F.concat(F.coalesce("aliases", none), F.when(F.col("slug") == gone, F.array("canonical")).otherwise(none))
    turned = F.transform(F.coalesce("implies", none), lambda x: F.when(x == gone, F.lit(kept)).otherwise(x))
    rows = terms.select(slug.alias("slug"), F.when(F.col("slug") != gone, F.col("canonical")).alias("canonical"), forms.alias("f"), turned.alias("i"))
    flat = lambda c: F.sort_array(F.array_distinct(F.flatten(F.collect_list(c))))  # noqa: E731  of two terms at most
    return rows.groupBy("slug").agg(F.max("canonical").alias("canonical"), flat("f").alias("forms"), flat("i").alias("i")).select("slug", "canonical", "forms", F.array_remove("i", F.col("slug")).alias("implied"))
