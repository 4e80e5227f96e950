"""State of sessions: judgments, lineage, usage and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import stored
from .components import union_find
from .sets import ranked


def clean_scores(scores: DataFrame, known: DataFrame, item: str = "doc_no", score: str = "score", note: str = "note") -> DataFrame:
    """(item, score, note, problem): scores clamped to 0 to 100 and rounded, notes cut at 120 characters; problem is
    'unknown' for items not in ``known``, 'duplicate' for items given twice, 'missing' without a score, else null."""
    counts = scores.groupBy(item).agg(F.count("*").alias("__n"))
    there = known.select(item).distinct().withColumn("__known", F.lit(True))
    rows = scores.join(counts, item).join(there, item, "left")
    text = F.when(F.length(note) > 120, F.concat(F.substring(note, 1, 119), F.lit("…"))).otherwise(F.col(note))
    problem = F.when(F.col("__known").isNull(), "unknown").when(F.col("__n") > 1, "duplicate").when(F.col(score).isNull(), "missing")
    return rows.select(item, F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col(score).cast("double"))), 0).cast("int").alias(score), text.alias(note), problem.alias("problem"))


def merged_scores(old: DataFrame, new: DataFrame, item: str = "doc_no", score: str = "score") -> DataFrame:
    """Existing scores stand; only items without one take the new."""
    a = old.select(item, F.col(score).alias("__old"))
    b = new.select(item, F.col(score).alias("__new"))
    return a.join(b, item, "full").select(item, F.coalesce("__old", "__new").alias(score))


def lineage(steps: DataFrame, node: str = "id", parent: str = "parent", rounds: int = 30) -> DataFrame:
    """(node, root, depth): each step walked up to its first ancestor by pointer doubling, a join for each power of two."""
    at = stored(steps.select(F.col(node).alias("node"), F.coalesce(parent, node).alias("up"), (F.col(parent).isNotNull()).cast("int").alias("depth")))
    for _ in range(rounds):
        above = at.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        hopped = stored(at.join(above, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")))
        moved = hopped.join(at.select("node", F.col("up").alias("was")), "node").where("up <> was").limit(1).count()
        at = hopped
        if not moved:
            break
    return at.select("node", F.col("up").alias("root"), "depth")


def trailing(events: DataFrame, user: str, ts: str, seconds: int, value: Column, count: str = "recent", total: str = "recent_sum") -> DataFrame:
    """Every event with count and sum of its user over the seconds up to it.

    Time is cut into spans of that length; an event is also seen by the span after its own, so a span sees all that its
    events reach back to, and the events of one user are spread over as many tasks as there are spans."""
    secs = F.unix_seconds(F.col(ts).cast("timestamp"))
    span = F.floor(secs / seconds)
    rows = events.withColumn("__s", secs).withColumn("__v", value).withColumn("__span", F.explode(F.array(span, span + 1)))
    w = Window.partitionBy(user, "__span").orderBy("__s").rangeBetween(-seconds, 0)
    seen = rows.withColumn(count, F.count("*").over(w)).withColumn(total, F.sum("__v").over(w))
    return seen.where(F.col("__span") == F.floor(F.col("__s") / seconds)).drop("__s", "__v", "__span")


def reopens(events: DataFrame, user: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """(user, at): when a user whose last ``limit`` events fall into one window may act again."""
    last = events.withColumn("rn", F.row_number().over(Window.partitionBy(user).orderBy(F.col(ts).desc()))).where(F.col("rn") <= limit)
    full = last.groupBy(user).agg(F.count("*").alias("n"), F.min(ts).alias("oldest"), F.max(ts).alias("newest")).where(F.col("n") == limit)
    due = F.col("oldest") + F.expr(f"interval {seconds} seconds")
    return full.where(due > F.col("newest")).select(user, due.alias("at"))


def within_budget(turns: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """The newest turns whose sizes add up to the budget at most. A turn has one token at least, so no more than
    ``budget`` turns of a session are looked at: each task keeps those before the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = turns.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= budget).drop("__n")
    return last.withColumn("upto", F.sum(F.greatest(F.lit(1), F.col(size))).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") <= budget)


def numbered(rows: DataFrame, session: str, order: list[Column], name: str = "step") -> DataFrame:
    """The rows with their number in their session and whether it is the last, as ``last``. Numbers come from ranges of
    session and order, so a session with most of the rows is split over tasks."""
    laid = stored(ranked(rows, [F.col(session), *order], name="__pos"))
    ends = laid.groupBy(F.col(session).alias("__session")).agg(F.min("__pos").alias("__first"), F.max("__pos").alias("__last"))
    both = laid.join(ends, F.col(session).eqNullSafe(F.col("__session")))
    return both.withColumn(name, F.col("__pos") - F.col("__first") + 1).withColumn("last", F.col("__pos") == F.col("__last")).drop("__pos", "__session", "__first", "__last")


def shared(users: DataFrame, links: DataFrame) -> DataFrame:
    """(leader, people, total): users (user, value) linked by (a, b), over any number of links, with one allowance; the
    smallest user leads. Users without links are alone."""
    roots = union_find(links)
    led = users.join(roots, F.col("user") == F.col("node"), "left").select(F.coalesce("root", "user").alias("leader"), "value")
    return led.groupBy("leader").agg(F.count("*").alias("people"), F.sum("value").alias("total"))


def deltas(events: DataFrame, session: str, at: str, item: str, value: str) -> DataFrame:
    """(session, step, item, delta): change from step to step of every session. Positions come from ranges of session and
    time, and the row before is joined by its position, so a session with most of the events is split over tasks."""
    laid = stored(ranked(events.select(session, at, item, value), [F.col(session), F.col(at), F.col(item)], name="__pos"))
    first = laid.groupBy(F.col(session).alias("__session")).agg(F.min("__pos").alias("__first"))
    before = laid.select(F.col(session).alias("__of"), (F.col("__pos") + 1).alias("__next"), F.col(value).alias("__was"))
    rows = laid.join(before, (F.col("__pos") == F.col("__next")) & F.col(session).eqNullSafe(F.col("__of")), "left").join(first, F.col(session).eqNullSafe(F.col("__session")))
    return rows.select(session, (F.col("__pos") - F.col("__first") + 1).alias("step"), item, (F.col(value) - F.col("__was")).alias("delta"))


def newest_on_lineage(steps: DataFrame, judgments: DataFrame, criterion: str, node: str = "id", parent: str = "parent", rounds: int = 30) -> DataFrame:
    """(node, judgment_id, at): for each step the newest judgment by a criterion on it or any step before it, by pointer
    doubling. Criteria are the same whatever their case and spacing. judgments: (step, judgment_id, criterion, at);
    steps without one have no row."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    own = judgments.where(plain(F.col("criterion")) == plain(F.lit(criterion))).groupBy("step").agg(F.max(F.struct("at", "judgment_id")).alias("best"))
    there = steps.select(F.col(node).alias("__there")).distinct()
    at = steps.join(own, F.col(node) == F.col("step"), "left").join(there, F.col(parent) == F.col("__there"), "left")  # a parent that is no step is none
    at = stored(at.select(F.col(node).alias("node"), F.coalesce("__there", node).alias("up"), "best"))
    for _ in range(rounds):
        above = at.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("best").alias("other"))
        hopped = stored(at.join(above, "up").select("node", F.col("next").alias("up"), F.greatest("best", "other").alias("best"), (F.col("next") != F.col("up")).alias("moved")))
        at = hopped.drop("moved")
        if hopped.where("moved").isEmpty():
            break
    return at.where("best is not null").select("node", "best.judgment_id", "best.at")


#: People that one ranking may judge, and of one call of the judge.
MOST_JUDGED, BATCH = 50, 25


def rank_job(members: DataFrame, judgments: DataFrame, judgment: str, limit: int = MOST_JUDGED) -> DataFrame:
    """(doc_no, batch): what a ranking has still to judge, in batches: members without a score in the judgment, by number.
    More members than ``limit`` are refused, since a judge reads them all."""
    n = members.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"TOO_MANY: more than {limit} members; narrow first")
    done = judgments.where((F.col("judgment_id") == judgment) & F.col("score").isNotNull()).select("doc_no")
    rest = members.select("doc_no").distinct().join(done, "doc_no", "left_anti")
    return rest.withColumn("batch", F.floor((F.row_number().over(Window.orderBy("doc_no")) - 1) / BATCH).cast("int"))  # limit rows


def landed(judgments: DataFrame, judgment: str, members: DataFrame) -> DataFrame:
    """One row (members, scored, missing, finished) of a ranking that may have been stopped half-way."""
    s = members.select("doc_no").distinct().join(judgments.where(F.col("judgment_id") == judgment).groupBy("doc_no").agg(F.max("score").alias("score")), "doc_no", "left")
    return s.agg(F.count("*").alias("members"), F.count("score").alias("scored"), F.count_if(F.col("score").isNull()).alias("missing")).withColumn("finished", F.col("missing") == 0)


def lockouts(events: DataFrame, user: str, at: str, failed: Column, seconds: int, limit: int) -> DataFrame:
    """(user, at, until): failures that make ``limit`` or more within the seconds up to them, and when the user may try
    again: once the last of them is as many seconds old."""
    rows = trailing(events.where(failed), user, at, seconds, F.lit(1))
    return rows.where(F.col("recent") >= limit).select(user, at, (F.col(at) + F.expr(f"interval {seconds} seconds")).alias("until")).distinct()


def nearest_rank(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, a column for each share): the value at place round(share x (n - 1)) of the sorted values, halves to the even
    place, from the counts of distinct values."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.partitionBy(group).orderBy(value)))
    n = counts.groupBy(group).agg(F.sum("k").alias("n"))
    both = upto.join(n, group)
    return both.groupBy(group).agg(*[F.min(F.when(F.col("upto") > F.bround(F.lit(q) * (F.col("n") - 1), 0), F.col(value))).alias(name) for name, q in shares.items()])
