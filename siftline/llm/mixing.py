"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums, complete epochs before fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored
from . import tokens as T

#: Ranges for each e-fold of the (negative) keys, whose sizes are summed before any rows are sorted; only the range a
#: budget ends in is sorted. Keys are exponential, so whatever the weights a range has less than 1/2000 of a source.
RANGES = 1024


def size_in_tokens(text: Column) -> Column:
    """The size of TESTDATA.md, where a token is four characters; null for a null text, which greatest would skip."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("bigint")


def quality(text: Column) -> Column:
    """A weight from 0.05 to 1: the share of letters among the characters of the whole text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    return F.greatest(F.lit(0.05), letters / F.greatest(F.lit(1), F.length(text)))


def draw(key: Column, seed: int = 0) -> Column:
    """A number in (0, 1) fixed by the key and the seed."""
    return (F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def mixed(docs: DataFrame, key: str, source: str, text: str, targets: DataFrame, total: float | None = None, seed: int = 0, ranks: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    """((key, source, tokens, copies), shares).

    ranks: the content of a tokenizer's rank file, in whose tokens all sizes, budgets and shares are (tokens.sized; one at
    least for a document); without it a token is four characters (size_in_tokens).

    targets: (source, target_share, max_repeats). Each source gets target_share x total tokens: first whole epochs, at
    most max_repeats, then a weighted sample without replacement. By the method of Efraimidis and Spirakis a document of
    weight w has the key ln(u) / w; those with the largest keys are taken as long as their tokens fit. total defaults to
    the most for which every source that has documents reaches its share within its repeats.
    shares: (source, target_share, max_repeats, documents, available, budget, tokens, actual_share, reached), one row for
    each target; actual_share is of the tokens of the mix.

    No source is sorted whole: tokens are summed for ranges of keys (RANGES), the sums are accumulated, and only
    the one range in which a budget ends is put in order. Documents of sources without a target, null keys, texts and
    sources are not used; repeated rows count once, and of different rows with one key the one with the most tokens;
    a target without documents has a budget but no tokens; no document of an empty table is used. A null share counts
    as 0, null repeats as 1.
    """
    aims = targets.where("source is not null").groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).cast("bigint").alias("max_repeats"))
    aims = stored(aims)
    whole = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text"), quality(F.col(text)).alias("weight")).where("key is not null and source is not null and text is not null")
    size = F.greatest(F.lit(1), F.col("tokens")).cast("bigint") if ranks else size_in_tokens(F.col("text"))
    small = (T.sized(whole, "text", ranks) if ranks else whole).select("key", "source", size.alias("tokens"), "weight")
    small = small.groupBy("key").agg(F.max(F.struct("tokens", "weight", "source")).alias("d")).select("key", "d.source", "d.tokens", "d.weight")
    rank = F.log(draw(F.col("key"), seed)) / F.col("weight")
    pool = small.join(aims.select("source"), "source", "left_semi").select("key", "source", "tokens", rank.alias("rank"))
    pool = stored(pool.withColumn("range", F.floor(F.log(-F.col("rank")) * RANGES).cast("int")))
    sums = stored(pool.groupBy("source", "range").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")))
    have = sums.groupBy("source").agg(F.sum("tokens").alias("available"), F.sum("n").alias("documents"))
    plan = aims.join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("available", F.lit(0)).alias("available"))
    if total is None:
        fits = plan.where("available > 0 and target_share > 0").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("t"))
        plan = plan.crossJoin(fits).withColumn("budget", F.col("target_share") * F.coalesce("t", F.lit(0.0))).drop("t")  # one row of one number
    else:
        plan = plan.withColumn("budget", F.col("target_share") * F.lit(float(total)))
    epochs = F.when(F.col("available") > 0, F.least(F.col("max_repeats"), F.floor(F.col("budget") / F.col("available")))).otherwise(0)
    plan = plan.withColumn("epochs", epochs.cast("bigint"))
    plan = stored(plan.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0.0)))
    before = F.sum("tokens").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = sums.select("source", "range", F.coalesce(before, F.lit(0)).alias("before"), F.col("tokens").alias("here")).join(plan.select("source", "epochs", "rest"), "source")
    state = F.when(F.col("before") + F.col("here") <= F.col("rest"), 1).when(F.col("before") >= F.col("rest"), 0).otherwise(-1)
    marked = pool.join(ranges.select("source", "range", "before", "epochs", "rest", state.alias("state")), ["source", "range"])
    running = F.sum("tokens").over(Window.partitionBy("source", "range").orderBy(F.col("rank").desc(), "key").rowsBetween(Window.unboundedPreceding, 0))
    edge = marked.where("state = -1").withColumn("state", (F.col("before") + running <= F.col("rest")).cast("int"))
    taken = marked.where("state >= 0").select("key", "source", "tokens", "epochs", "state").union(edge.select("key", "source", "tokens", "epochs", "state"))
    taken = stored(taken.select("key", "source", "tokens", (F.col("epochs") + F.col("state")).cast("bigint").alias("copies")).where("copies > 0"))
    used = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"))
    every = used.agg(F.sum("used").alias("every"))
    shares = plan.join(used, "source", "left").crossJoin(every).select(  # every is one row of one number
        "source",
        "target_share",
        "max_repeats",
        "documents",
        "available",
        "budget",
        F.coalesce("used", F.lit(0)).alias("tokens"),
        F.coalesce(F.col("used") / F.col("every"), F.lit(0.0)).alias("actual_share"),
        (F.coalesce("used", F.lit(0)) >= F.col("budget") * 0.99).alias("reached"),
    )
    return taken, shares
