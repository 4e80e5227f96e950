"""Documents like a query document: its lines, their terms, and how well documents cover them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan

MOST_LINES = 40
#: Weight of the best evidence that a document has for a line; a vector alone counts for topics only.
USED, STRONG, WEAK = 1.0, 0.8, 0.5


def requirements(docs: DataFrame, key: str, text: str, most: int = MOST_LINES) -> DataFrame:
    """(key, line_no, requirement): the first ``most`` lines of each text that ask for something: without bullets, marks at
    the ends, headings, rules and captions that end in a colon. The feature is bounded by the number of lines."""
    raw = F.transform(F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x))
    numbered = F.transform(raw, lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), x.alias("raw")))
    kept = F.filter(numbered, lambda x: (x["raw"] != "") & ~x["raw"].startswith("#") & ~x["raw"].startswith("---"))
    bare = F.transform(kept, lambda x: F.struct(x["line_no"].alias("line_no"), F.trim(F.regexp_replace(x["raw"], r"^([-*•]|[0-9]+[.)]) +", ""), F.lit(" .;")).alias("requirement")))
    asked = F.slice(F.filter(bare, lambda x: (x["requirement"] != "") & ~x["requirement"].endswith(":")), 1, most)
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(asked).alias("x")).select(key, "x.*")


def resolved(lines: DataFrame, key: str, terms: DataFrame) -> DataFrame:
    """(key, line_no, term_id) of the terms that requirement lines name; forms that are ambiguous count if the document
    also holds a sure form of the term. Lines of fewer than three words that name nothing are left out by covered()."""
    texts = lines.withColumn("__id", F.struct(key, "line_no")).select(F.concat_ws("\x1f", F.col(key).cast("string"), F.col("line_no").cast("string")).alias("__k"), "requirement")
    found = scan.scan(texts, "__k", "requirement", terms, sure_only=False)
    whole = scan.scan(lines.groupBy(key).agg(F.array_join(F.collect_list("requirement"), "\n").alias("t")), key, "t", terms)  # MOST_LINES lines of one document
    split = found.select(F.split("key", "\x1f").alias("p"), "term_id", "sure").select(F.col("p")[0].alias("k"), F.col("p")[1].cast("bigint").alias("line_no"), "term_id", "sure")
    sure = whole.select(F.col("key").cast("string").alias("k"), "term_id", F.lit(True).alias("there"))
    return split.join(sure, ["k", "term_id"], "left").where("sure > 0 or there").select(F.col("k").alias(key), "line_no", "term_id").distinct()


def covered(postings: DataFrame, lines: DataFrame, least: float = 0.4) -> DataFrame:
    """(doc_no, covered, cover): documents that cover a share of ``least`` of the lines. A line is covered by its best term:
    used, strong or, of topics, weak; cover is the mean weight over all lines, covered counts lines whatever the weight.

    postings: (term_id, kind, doc_no, strong, used); lines: (line, term_id), one query document."""
    n = lines.select("line").distinct()
    total = n.agg(F.count("*").alias("__n"))
    weight = F.when(F.col("used"), USED).when(F.col("strong"), STRONG).when(F.col("kind") == "topic", WEAK)
    best = postings.join(F.broadcast(lines), "term_id").where(weight.isNotNull()).groupBy("line", "doc_no").agg(F.max(weight).alias("w"))  # lines of one document, MOST_LINES at most
    each = best.groupBy("doc_no").agg(F.count("*").alias("covered"), F.sum("w").alias("w")).crossJoin(F.broadcast(total))  # one row
    return each.where(F.col("covered") / F.col("__n") >= least).select("doc_no", "covered", (F.col("w") / F.col("__n")).alias("cover"))
