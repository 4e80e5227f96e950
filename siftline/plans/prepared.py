"""Tables of the index that searches read: built once for each version of the source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, sets
from ..operators import index as I
from ..runtime import prepared, table, texts

TAU = 0.35


def _profile(spark: SparkSession, d: str) -> DataFrame:
    """One row for each document: repeated rows are one, of differing ones each field's largest value counts."""
    p = table(spark, d, "profile")
    one = p.groupBy("doc_no").agg(*[F.max(c).alias(c) for c in p.columns if c != "doc_no"])
    docs = table(spark, d, "docs").select("doc_no", "id", "source", F.coalesce("deleted", F.lit(False)).alias("deleted"), sets.person().alias("person"))
    part = lambda i: F.trim(F.split_part("location", F.lit(","), F.lit(i)))
    return one.join(docs, "doc_no", "left").withColumns({"level": F.lower(F.trim("seniority")), "label": T.availability_label(F.col("availability")), "city": part(1), "country": part(-1), "live": F.coalesce(~F.col("deleted"), F.lit(False))}).drop("deleted").coalesce(8)


def profile(spark: SparkSession, d: str) -> DataFrame:
    return prepared(spark, d, "profile", _profile)


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """(chunk, doc_no, idx, kind, text, vec): the vectors of emb stand in for those of the chunks, by the first two digits
    of the hash of the text."""
    c = texts(spark, d, "build_docs").select("doc_no", F.explode("chunks").alias("c")).select("doc_no", "c.idx", extract.section_kind(F.col("c.section")).alias("kind"), "c.text")
    v = table(spark, d, "emb").where("model = 'hash-embed-96' and size(vec) = 96").where(F.exists("vec", lambda x: x != 0))
    v = v.groupBy(F.substring("key", 1, 2).alias("pre")).agg(F.min_by("vec", "key").alias("vec"))
    c = c.select(F.concat_ws(":", "doc_no", "idx").alias("chunk"), "doc_no", "idx", "kind", "text", F.substring(F.sha2("text", 256), 1, 2).alias("pre"))
    return c.join(v, "pre", "left").drop("pre")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return prepared(spark, d, "chunks", _chunks)


def _postings(spark: SparkSession, d: str) -> DataFrame:
    """Postings with the kind of the term, by term, so that a search reads the row groups of its terms only."""
    terms = table(spark, d, "terms")
    p = I.postings(table(spark, d, "doc_terms"), terms.where("kind <> 'title'"), chunks(spark, d), TAU)
    live = table(spark, d, "docs").where("not coalesce(deleted, false)").select("doc_no", sets.person().alias("person"))
    p = p.join(terms.select(F.col("term_id").cast("bigint").alias("term_id"), "kind"), "term_id").join(live, "doc_no")
    return p.repartitionByRange(F.col("term_id")).sortWithinPartitions("term_id", "doc_no")


def postings(spark: SparkSession, d: str) -> DataFrame:
    """(term_id, kind, doc_no, person, evidence, bm25, cosine, strong, used, weak) of live documents."""
    return prepared(spark, d, "postings", _postings)


def _words(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d, "docs").where("not coalesce(deleted, false) and markdown is not null").select("doc_no", T.words(F.col("markdown")).alias("ws"))
    f = docs.select("doc_no", F.size("ws").alias("len"), F.explode("ws").alias("word")).groupBy("doc_no", "len", "word").agg(F.count("*").alias("tf"))
    return f.repartitionByRange(F.col("word")).sortWithinPartitions("word", "doc_no")


def words(spark: SparkSession, d: str) -> DataFrame:
    """(doc_no, len, word, tf) of live documents, by word."""
    return prepared(spark, d, "words", _words)


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    w = texts(spark, d, "docs").where("not coalesce(deleted, false) and markdown is not null").select(F.size(T.words(F.col("markdown"))).alias("n"))
    return w.agg(F.count("*").alias("docs"), F.avg("n").alias("avg"))


def sizes(spark: SparkSession, d: str) -> DataFrame:
    """One row: documents and their mean length."""
    return prepared(spark, d, "sizes", _sizes)


def build(spark: SparkSession, d: str) -> None:
    for part in (profile, chunks, postings, words, sizes):
        part(spark, d)
