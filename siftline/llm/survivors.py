"""One surviving record for each duplicate group, field by field, with a latent two-sided quality model of sources.

A multi-valued field (terms of a resume) is a set of claims. Each source has a sensitivity (how often it states a true
value) and a specificity (how often it leaves out a false one); whether a value of a group is true is latent. Both are
found by expectation-maximisation (the two-sided model of Zhao et al.), and every value judged true is retained, so that
a group keeps several. Facts stated and left out by the same sources have the same posterior, so EM runs on the counts
of such patterns, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import shipped, stored

#: Patterns of sources that EM holds on the driver; more stay in a table that each round passes over.
PATTERN_LIMIT = 200_000

Pattern = tuple[tuple[str, ...], tuple[str, ...], int]  # stating sources, silent sources, facts
Quality = dict[str, tuple[float, float]]  # sensitivity, specificity


def posterior(pattern: Pattern, quality: Quality, prior: float) -> float:
    a, b, _ = pattern
    x = math.log(prior / (1 - prior)) + sum(math.log(quality[s][0] / (1 - quality[s][1])) for s in a) + sum(math.log((1 - quality[s][0]) / quality[s][1]) for s in b)
    return 1 / (1 + math.exp(-max(-50.0, min(50.0, x))))


def expected(patterns: Iterable[Pattern], quality: Quality | None, prior: float) -> dict[str | None, list[float]]:
    """Sums of one round over some patterns: of each source the expected facts that are true and stated, true and not
    stated, false and stated, false and not stated; of None the true ones and all. Without a quality, the first round, the
    share of stating sources stands for the posterior. A fact that no source states is never seen: such facts are added
    in the number to be expected from those that the same sources could have stated."""
    sums: dict[str | None, list[float]] = {}

    def add(source: str | None, *numbers: float) -> None:
        have = sums.setdefault(source, [0.0] * 4)
        for i, x in enumerate(numbers):
            have[i] += x

    first = quality is None
    for a, b, n in patterns:
        p = (len(a) + 0.5) / (len(a) + len(b) + 1) if first else posterior((a, b, n), quality, prior)
        known = lambda s: (0.7, 0.9) if first else quality[s]
        unseen_true = prior * math.prod(1 - known(s)[0] for s in (*a, *b))
        unseen_false = (1 - prior) * math.prod(known(s)[1] for s in (*a, *b))
        unseen = min(0.75, unseen_true + unseen_false)
        extra = n * unseen / (1 - unseen)
        q = unseen_true / (unseen_true + unseen_false)
        add(None, n * p + extra * q, n + extra)
        for s in a:
            add(s, n * p, extra * q, n * (1 - p), extra * (1 - q))
        for s in b:
            add(s, 0.0, n * p + extra * q, 0.0, n * (1 - p) + extra * (1 - q))
    return sums


def source_quality(patterns: list[Pattern] | DataFrame, rounds: int = 60) -> tuple[Quality, float]:
    """({source: (sensitivity, specificity)}, share of true facts) by EM. A list is summed here, a table (yes, no, count)
    by the tasks that hold it, one row for each source and task; both give the same."""
    quality: Quality | None = None
    prior = 0.5
    for _ in range(rounds):
        sums = expected(patterns, quality, prior) if isinstance(patterns, list) else _expected_of_table(patterns, quality, prior)
        true, total = sums.pop(None, [0.0, 0.0])[:2]
        # pseudo-counts: a source is held to state most true values and few false ones until its claims say otherwise
        new = {s: ((t1 + 7) / (t1 + t0 + 10), (f0 + 9) / (f1 + f0 + 10)) for s, (t1, t0, f1, f0) in sums.items()}
        prior = min(0.95, max(0.05, (true + 1e-9) / (total + 1e-9)))
        moved = 1.0 if quality is None else max((abs(x - y) for s in new for x, y in zip(new[s], quality[s], strict=True)), default=0.0)
        quality = new
        if moved < 1e-9:
            break
    return quality or {}, prior


def _expected_of_table(patterns: DataFrame, quality: Quality | None, prior: float) -> dict[str | None, list[float]]:
    shared = patterns.sparkSession.sparkContext.broadcast((quality, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((tuple(a), tuple(b), n) for batch in batches for a, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        sums = expected(rows, *shared.value)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array([x[i] for x in sums.values()], pa.float64()) for i in range(4))], names=["source", "a", "b", "c", "d"])

    parts = patterns.select("yes", "no", "count").mapInArrow(run, "source string, a double, b double, c double, d double")
    return {r["source"]: [r[x] for x in "abcd"] for r in parts.groupBy("source").agg(*[F.sum(x).alias(x) for x in "abcd"]).collect()}  # a row for each source


def true_values(claims: DataFrame, members: DataFrame, threshold: float = 0.5, pattern_limit: int = PATTERN_LIMIT) -> tuple[DataFrame, DataFrame]:
    """((grp, value, posterior), (source, sensitivity, specificity)).

    claims: (grp, source, value); members: (grp, source) of all records, so that silence counts. A source is silent on a
    value if it has a record in the group and none of them states it. Rows are reduced to distinct (grp, source, value)
    before they meet; a group then has at most sources x values rows, however many records. Null values state nothing.
    Up to pattern_limit patterns of sources are fitted on the driver, more in their table, with the same result.
    """
    spark = claims.sparkSession
    shipped(spark)
    stating = claims.where("value is not null and grp is not null").groupBy("grp", "value").agg(F.sort_array(F.collect_set("source")).alias("yes"))
    present = members.where("grp is not null").groupBy("grp").agg(F.sort_array(F.collect_set("source")).alias("all"))
    facts = stored(stating.join(present, "grp", "left").select("grp", "value", "yes", F.array_except(F.coalesce("all", F.array().cast("array<string>")), "yes").alias("no")))
    patterns = stored(facts.groupBy("yes", "no").count())
    few = patterns.limit(pattern_limit + 1).collect()
    quality, prior = source_quality([(tuple(r["yes"]), tuple(r["no"]), r["count"]) for r in few] if len(few) <= pattern_limit else patterns)
    shared = spark.sparkContext.broadcast((quality, prior))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            post = [posterior((a, b, 1), *shared.value) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(post, pa.float64())], names=["yes", "no", "posterior"])

    judged = patterns.select("yes", "no").mapInArrow(judge, "yes array<string>, no array<string>, posterior double")
    kept = facts.join(judged, ["yes", "no"]).where(F.col("posterior") >= threshold).select("grp", "value", "posterior")
    return kept, spark.createDataFrame([(s, a, b) for s, (a, b) in quality.items()], "source string, sensitivity double, specificity double")


def best(order: list[Column], result: Column, where: Column | None = None) -> Column:
    """The result of the row that is largest in ``order``, nulls lowest; null if no row qualifies. One partial maximum
    for each map task, so a group of any size needs no sort and no collection."""
    pick = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], result.alias("r"))
    return F.max(pick if where is None else F.when(where, pick))["r"]


def survivors(docs: DataFrame, facts: DataFrame, claims: DataFrame, group: str = "dup_group") -> DataFrame:
    """(grp, members, text_doc_no, date_doc_no, rate_doc_no, rate, terms): one record for each group with at least two
    records that are not deleted.

    docs: (doc_no, group, source, words, added_at, deleted); facts: (doc_no, rate, rate_source); claims: (doc_no,
    term_id). The text comes from the fullest member (words, then the latest, then the largest number; nulls lowest),
    the date from the latest, the rate from the latest member with a stated rate, else from the latest with any; null
    where no member has one. terms are all values the quality model judges true, with sources of null named ''.
    Records without a group, deleted ones and repeated rows don't count; several facts of one record compete in the
    order of the rate itself when all else ties. Empty tables give an empty result.
    """
    live = docs.where(F.col(group).isNotNull() & ~F.coalesce("deleted", F.lit(False)) & F.col("doc_no").isNotNull()).select("doc_no", F.col(group).alias("grp"), F.coalesce("source", F.lit("")).alias("source"), "words", "added_at").distinct()
    several = live.groupBy("grp").agg(F.countDistinct("doc_no").alias("members")).where("members > 1")
    live = stored(live.join(several.select("grp"), "grp", "left_semi"))
    doc = F.col("doc_no")
    plain = live.groupBy("grp").agg(
        F.countDistinct("doc_no").alias("members"),
        best([F.col("words"), F.col("added_at"), doc], doc).alias("text_doc_no"),
        best([F.col("added_at"), doc], doc, F.col("added_at").isNotNull()).alias("date_doc_no"),
    )
    rated = facts.where("rate is not null").select("doc_no", "rate", "rate_source").distinct().join(live, "doc_no")
    stated = F.coalesce(~F.contains(F.lower("rate_source"), F.lit("synthetic")), F.lit(False))
    pick = F.max(F.struct(stated.alias("s"), F.col("added_at"), doc, F.col("rate"))).alias("b")
    rates = rated.groupBy("grp").agg(pick).select("grp", F.col("b.doc_no").alias("rate_doc_no"), F.col("b.rate").alias("rate"))
    said = claims.where("term_id is not null").select("doc_no", F.col("term_id").alias("value")).distinct().join(live.select("doc_no", "grp", "source"), "doc_no").select("grp", "source", "value").distinct()
    kept, _ = true_values(said, live.select("grp", "source").distinct())
    terms = kept.groupBy("grp").agg(F.sort_array(F.collect_list("value")).alias("terms"))
    return plain.join(rates, "grp", "left").join(terms, "grp", "left").select("grp", "members", "text_doc_no", "date_doc_no", "rate_doc_no", "rate", F.coalesce("terms", F.array().cast(terms.schema["terms"].dataType)).alias("terms"))
