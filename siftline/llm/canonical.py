"""Mapping freely typed values to a canonical list: a partition-based pigeonhole join, in SQL expressions only.

A reference string of L characters within k edits of a typed one keeps at least one of its k + 1 segments unchanged, at a
position shifted by at most k. Segments of the reference list and the fitting substrings of the typed values meet in an
equality join; built-in levenshtein verifies; values without a partner come out of an anti-join.

What people write around a name is learned from the values themselves: what stands before or behind names of several
terms says nothing about any of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import stored

#: Edits that candidates may differ by: two swaps of neighbours are four.
EDITS = 4


#: Terms that a wording must surround before it is one, and words of a name that are looked for inside a value.
TERMS, WORDS = 3, 6
#: Words, with the marks of names inside them, and single marks.
TOKEN = r"[\p{L}\p{N}](?:[\p{L}\p{N}_+#&'’.]*[\p{L}\p{N}+#])?|[^\p{L}\p{N}\s_]"
#: Two parts of a name in the other order, with marks between.
TURNED = (r"^(.+) \( (.+) \)$", r"^(.+) [-/] (.+)$", r"^(.+) , (.+)$")


def _tidy(value: Column) -> Column:
    """Lower case, plain single spaces, hyphens between words as spaces."""
    plain = F.regexp_replace(value, r"[​-‍⁠﻿­]", "")
    return F.trim(F.regexp_replace(F.lower(plain), r"[\s _]+", " "))


def _key(value: Column) -> Column:
    """Letters and digits only, with the signs that tell names of languages apart."""
    return F.regexp_replace(value, r"[^\p{L}\p{N}+#]", "")


def _tokens(value: Column) -> Column:
    """Words and marks of a value; hyphens between words are none."""
    return F.regexp_extract_all(F.regexp_replace(_tidy(value), r"(?<=\p{L})-(?=[\p{L}(])", " "), F.lit(TOKEN), F.lit(0))


def _said(tokens: Column) -> Column:
    return F.regexp_replace(F.array_join(tokens, " "), r"\d+", "#")


def wordings(split: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((before), (behind), (opening)): what stands in front of names of TERMS terms or more, what stands behind them, and
    words or marks that open something behind them that is ever another. Names are looked for as they are, the longest
    and first in a value; numbers are alike. split: (value, ts)."""
    places = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(WORDS)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ts") - n + 1)), lambda i: F.struct(n.alias("n"), i.alias("i")))))
    spans = split.where("size(ts) > 1").select("value", "ts", F.explode(places).alias("x")).where("x.i + x.n - 1 <= size(ts)").select("value", "ts", "x.n", "x.i", _key(F.array_join(F.slice("ts", F.col("x.i"), F.col("x.n")), "")).alias("key"))
    spans = spans.where(F.element_at("ts", F.col("i")).rlike(r"^[\p{L}\p{N}]") & F.element_at("ts", F.col("i") + F.col("n") - 1).rlike(r"[\p{L}\p{N}+#]$"))
    best = spans.join(known, "key").groupBy("value").agg(F.max(F.struct("n", (-F.col("i")).alias("i"), "ts", "term")).alias("b"))
    at, end = -F.col("b.i"), -F.col("b.i") + F.col("b.n")
    around = best.select(F.col("b.term").alias("term"), _said(F.slice("b.ts", F.lit(1), at - 1)).alias("before"), _said(F.slice("b.ts", end, F.size("b.ts"))).alias("behind"), F.try_element_at("b.ts", end).alias("opening"))
    each = around.select("term", "behind", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("said")) for c in ("before", "behind", "opening")])).alias("x")).where("x.said <> ''")
    terms, kinds = F.count_distinct("term"), F.count_distinct("behind")
    found = stored(each.groupBy("x.kind", "x.said").agg(terms.alias("terms"), kinds.alias("kinds")).where((F.col("terms") >= TERMS) & ((F.col("kind") != "opening") | (F.col("kinds") >= TERMS))).select("kind", "said"))
    return tuple(found.where(F.col("kind") == c).select(F.col("said").alias(c)) for c in ("before", "behind", "opening"))


def _without_front(rows: DataFrame, before: DataFrame, slips_too: bool) -> DataFrame:
    """(value, ts) less the longest wording in front, on request one with slips of typing in it; never all of it."""
    fronts = rows.where("size(ts) > 1").select("value", "ts", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(WORDS), F.size("ts") - 1)), lambda n: F.struct(n.alias("n"), _said(F.slice("ts", F.lit(1), n)).alias("said")))).alias("x")).select("value", "ts", "x.n", "x.said")
    exact = fronts.join(before.select(F.col("before").alias("said")), "said").select("value", "ts", "n")
    if not slips_too:
        cut = exact.groupBy("value").agg(F.max(F.struct("n", "ts")).alias("m"))
        return cut.select("value", F.slice("m.ts", F.col("m.n") + 1, F.size("m.ts")).alias("ts"))
    long_ = before.where(F.length("before") >= 5).select(F.lit(0).alias("term"), F.col("before").alias("key"), (F.size(F.split("before", " "))).alias("many"))
    keyed = fronts.join(exact.select("value").distinct(), "value", "left_anti").select("value", "ts", "n", F.col("said").alias("key"))
    marks = probes(keyed.select("key").distinct()).join(segments(long_), "probe").select("key", "form").distinct()
    slips = marks.where((F.levenshtein("key", "form", 2) >= 0) & (F.size(F.split("key", " ")) == F.size(F.split("form", " ")))).select("key").distinct()
    near = keyed.join(slips, "key").select("value", "ts", "n")
    cut = exact.union(near).groupBy("value").agg(F.max(F.struct("n", "ts")).alias("m"))
    return cut.select("value", F.slice("m.ts", F.col("m.n") + 1, F.size("m.ts")).alias("ts"))


def _without_back(rows: DataFrame, behind: DataFrame, opening: DataFrame) -> DataFrame:
    """(value, ts) less what stands behind, for each place where a wording or something opened by a learned mark begins."""
    ends = rows.where("size(ts) > 1").select("value", "ts", F.explode(F.transform(F.sequence(F.lit(2), F.size("ts")), lambda i: F.struct(i.alias("i"), _said(F.slice("ts", i, F.size("ts"))).alias("said"), F.element_at("ts", i).alias("opening")))).alias("x")).select("value", "ts", "x.i", "x.said", "x.opening")
    cut = ends.join(behind.select(F.col("behind").alias("said")), "said").select("value", "ts", "i").union(ends.join(opening, "opening").select("value", "ts", "i"))
    return cut.distinct().select("value", F.slice("ts", F.lit(1), F.col("i") - 1).alias("ts"))


def read(typed: DataFrame, known: DataFrame, rounds: int = 2) -> DataFrame:
    """(value, order, key): each value as typed, less what is written before and behind the name in it, and with its parts
    in the other order. A smaller order is a reading that is closer to what was typed."""
    split = stored(typed.select("value", _tokens(F.col("value")).alias("ts")).where("size(ts) > 0"))
    before, behind, opening = wordings(split, known)
    ways = [split.withColumn("order", F.lit(0))]
    front = split
    for n in range(1, rounds + 1):  # wordings may stand before one another
        front = stored(_without_front(front, before, slips_too=n == 1))
        ways.append(front.withColumn("order", F.lit(n)))
    fronts = reduce(DataFrame.union, ways)
    bare = fronts.select("value", F.struct("value", "order").alias("v"), "ts")
    cut = _without_back(bare.select(F.col("v").alias("value"), "ts"), behind, opening).select("value.value", "ts", (F.col("value.order") + 10 + F.greatest(F.lit(0), 20 - F.size("ts"))).alias("order"))
    both = stored(fronts.union(cut.select("value", "ts", "order")))
    text = F.array_join("ts", " ")
    turned = reduce(DataFrame.union, [both.where(text.rlike(p)).select("value", F.regexp_replace(text, p, "$2 $1").alias("t"), (F.col("order") + 100).alias("order")) for p in TURNED])
    plain = typed.select("value", _tidy(F.col("value")).alias("t"), F.lit(-1).alias("order"))
    every = plain.union(both.select("value", text, "order")).union(turned)
    return every.select("value", "order", _key(F.col("t")).alias("key"), F.trim(F.regexp_replace("t", r"[^\p{L}\p{N}+#]+", " ")).alias("words")).where("key is not null and key <> ''").groupBy("value", "key").agg(F.min(F.struct("order", "words")).alias("m")).select("value", "m.order", "key", "m.words")


def forms(reference: DataFrame, ident: str, name: str, aliases: str) -> DataFrame:
    """(term, key): canonical names and aliases as keys; a key that means several terms goes to the one whose canonical
    name it is, else to the smallest."""
    names = reference.select(F.col(ident).cast("bigint").alias("term"), F.explode(F.concat(F.array(F.struct(F.col(name).alias("form"), F.lit(0).alias("alias"))), F.transform(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: F.struct(a.alias("form"), F.lit(1).alias("alias"))))).alias("f"))
    keyed = names.select("term", _key(_tidy(F.col("f.form"))).alias("key"), "f.alias").where("key is not null and key <> '' and term is not null")
    return keyed.groupBy("key").agg(F.min(F.struct("alias", "term")).alias("m")).select("key", F.col("m.term").alias("term"))


def spelt(reference: DataFrame, ident: str, name: str, aliases: str) -> DataFrame:
    """(term, words): names and aliases as words."""
    names = reference.select(F.col(ident).cast("bigint").alias("term"), F.explode(F.concat(F.array(F.col(name)), F.coalesce(aliases, F.array().cast("array<string>")))).alias("form"))
    return names.select("term", F.trim(F.regexp_replace(_tidy(F.col("form")), r"[^\p{L}\p{N}+#]+", " ")).alias("words")).where("words is not null and term is not null").distinct()


def shortened(ways: DataFrame, names: DataFrame) -> DataFrame:
    """(value, order, term, w, whole): readings that are a name with one word of six letters or more shortened: the first
    letter and some of the others, in their order, two at least. All other words meet in an equality join; a reading that
    shortens names of several terms means none."""
    left = lambda n: F.concat_ws(" ", F.slice("ws", F.lit(1), n - 1), F.lit("*"), F.slice("ws", n + 1, F.size("ws")))
    open_ = lambda df, keep: df.select(*keep, F.split("words", " ").alias("ws")).where("size(ws) between 2 and 8").select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.size("ws")), lambda n: F.struct(left(n).alias("rest"), F.element_at("ws", n).alias("w")))).alias("x")).select(*keep, "x.rest", "x.w")
    full = open_(names, ["term"]).where("w rlike '^[\\\\p{L}]{6,}$'").withColumnRenamed("w", "whole")
    cut = open_(ways.select("value", "order", "words"), ["value", "order"]).where("w rlike '^[\\\\p{L}]{2,}$'")
    parts = F.array_join(F.transform(F.split("w", ""), lambda c: F.concat(c, F.lit(r"\p{L}*"))), "")
    met = cut.join(full, "rest").where(F.length("w") < F.length("whole") - 1).where(F.expr("left(w, 1) = left(whole, 1)")).where(F.rlike("whole", F.concat(F.lit("^"), parts, F.lit("$"))))
    one = met.groupBy("value", "order").agg(F.count_distinct("term").alias("n"), F.min(F.struct("term", "w", "whole")).alias("m")).where("n = 1")
    return one.select("value", "order", "m.term", "m.w", "m.whole")


def written_out(ways: DataFrame, short: DataFrame) -> DataFrame:
    """(value, order, key): readings with every word written out that is short for the same one in two values or more;
    short: what shortened() found. Of several meanings the one in most values counts."""
    uses = short.groupBy("w", "whole").agg(F.count_distinct("value").alias("n")).where("n >= 2").groupBy("w").agg(F.max(F.struct("n", "whole"))["whole"].alias("whole"))
    each = ways.select("value", "order", F.posexplode(F.split("words", " ")).alias("i", "w")).join(uses, "w", "left")
    again = each.groupBy("value", "order").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("whole", "w").alias("x")))).alias("ws"), F.count("whole").alias("n")).where("n > 0")  # the words of one reading
    return again.select("value", (F.col("order") + 200).alias("order"), F.array_join(F.transform("ws", lambda x: x["x"]), "").alias("key"))


def _allowed(length: Column) -> Column:
    return F.when(length >= 9, 2).when(length >= 4, 1).otherwise(0)


def _cost(apart: Column, a: Column, b: Column) -> Column:
    """Slips of typing: edits, where two swapped letters are one; null beyond what the length of the form allows. Undoing
    one swap must take off two edits; sorted letters tell cheaply where that is possible."""
    letters = F.levenshtein(F.array_join(F.array_sort(F.split(a, "")), ""), F.array_join(F.array_sort(F.split(b, "")), ""))
    n = F.length(b)

    def swapped(i: Column) -> Column:
        return F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))

    def once(most: int) -> Column:
        return F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(a) - 1)), lambda i: F.levenshtein(swapped(i), b) <= most)

    slips = (
        F.when(apart <= 1, apart)
        .when((apart == 2) & (n >= 5) & (letters == 0), 1)
        .when(apart == 2, 2)
        .when((apart == 3) & (letters <= 2) & (n >= 9), F.when(once(1), 2))
        .when((apart == 4) & (letters == 0) & (n >= 9), F.when(once(2), 2))
    )
    return F.when(slips <= _allowed(n), slips)


def segments(forms_: DataFrame) -> DataFrame:
    """(term, form, probe): each form in EDITS + 1 segments; probe names its length, the segment and its text."""
    n, k = F.length("key"), EDITS + 1
    cut = F.array(*[F.struct((F.lit(i)).alias("i"), F.floor(n * i / k).cast("int").alias("p"), (F.floor(n * (i + 1) / k) - F.floor(n * i / k)).cast("int").alias("l")) for i in range(k)])
    pieces = forms_.where(n >= 4).select("term", F.col("key").alias("form"), n.alias("n"), F.explode(cut).alias("s"))
    return pieces.select("term", "form", F.concat_ws(":", "n", "s.i", F.substring(F.col("form"), F.col("s.p") + 1, F.col("s.l"))).alias("probe"))


def probes(keys: DataFrame) -> DataFrame:
    """(..., probe): the substrings of a key that a segment of a form within EDITS edits can be. Of a form longer by d, the
    i-th segment lies at most i places from its own place, and at most EDITS - i places from there plus d (i counted
    from 0 in either direction)."""
    k = EDITS
    places = [(d, i, shift) for d in range(-k, k + 1) for i in range(k + 1) for shift in range(max(-i, d - (k - i)), min(i, d + (k - i)) + 1)]
    listed = ", ".join(f"named_struct('d', {d}, 'i', {i}, 'shift', {shift})" for d, i, shift in places)  # one expression: quicker to build than its parts
    step = keys.where(F.length("key") >= 3).select("*", F.expr(f"explode(array({listed}))").alias("s"))
    step = step.select(*keys.columns, "s.i", "s.shift", (F.length("key") - F.col("s.d")).alias("n")).where("n >= 4")
    begin = lambda i: F.floor(F.col("n") * i / (k + 1)).cast("int")
    step = step.select(*keys.columns, "i", "n", (begin(F.col("i")) + F.col("shift")).alias("p"), (begin(F.col("i") + 1) - begin(F.col("i"))).alias("l"))
    step = step.where((F.col("p") >= 0) & (F.col("l") > 0) & (F.col("p") + F.col("l") <= F.length("key")))
    return step.select(*keys.columns, F.concat_ws(":", "n", "i", F.substring(F.col("key"), F.col("p") + 1, F.col("l"))).alias("probe")).distinct()


def canonical(values: DataFrame, value: str, reference: DataFrame, ident: str, name: str, aliases: str) -> DataFrame:
    """(value, term, edits): each distinct value with the entry of the reference list it means; term and edits are null
    for values that mean none.

    A value is read in several ways (see read), without wordings that the values themselves show. A reading that is a
    name or alias wins over one that is a name with a shortened word, that over one (with short words written out) within one slip of typing (names of
    four characters or more; a changed, added, lost letter or two swapped ones) or two (nine or more); then the reading
    closer to what was typed, then the smaller term. Typed values are reduced to distinct ones before they meet the list,
    so a value that a third of all rows share is looked up once; intermediate results are small and stored, which keeps
    the plan short. Null values have no row; values without letters or digits mean none; a list that is null or empty
    matches nothing; clashing column names don't matter.
    """
    typed = stored(values.select(F.col(value).cast("string").alias("value")).where("value is not null").distinct())
    known = stored(forms(reference, ident, name, aliases))
    ways = stored(read(typed, known))
    exact = ways.join(known, "key").select("value", F.lit(0).alias("rank"), "order", "term")
    short = stored(shortened(ways, spelt(reference, ident, name, aliases)))
    sure = stored(exact.union(short.select("value", F.lit(1).alias("rank"), "order", "term")).groupBy("value").agg(F.min(F.struct("rank", "order", "term")).alias("m")).select("value", F.col("m.term").alias("term"), F.lit(0).alias("edits")))
    rest = ways.join(sure.select("value"), "value", "left_anti")
    rest = stored(rest.select("value", "order", "key").union(written_out(rest, short)))
    met = probes(rest.groupBy("value", "key").agg(F.min("order").alias("order"))).join(segments(known), "probe").select("value", "order", "key", "term", "form").distinct()
    near = met.select("*", F.levenshtein("key", "form", EDITS).alias("apart")).where("apart >= 0").select("*", _cost(F.col("apart"), F.col("key"), F.col("form")).alias("edits")).where("edits is not null")
    fuzzy = near.groupBy("value").agg(F.min(F.struct("edits", "order", "term")).alias("m")).select("value", "m.term", "m.edits")
    found = stored(sure.union(fuzzy))
    none = typed.join(found.select("value"), "value", "left_anti").select("value", F.lit(None).cast("bigint").alias("term"), F.lit(None).cast("int").alias("edits"))
    return found.union(none)
