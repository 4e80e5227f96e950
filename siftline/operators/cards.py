"""Result cards within a budget of tokens, and their parts read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import once

#: Tokens of a card, and characters of a token.
BUDGET, CHARS = 110, 4
#: Terms in use that stay as long as the line about the work can still be cut, and characters that stay of it.
KEPT, KEPT_DID, CUT = 4, 41, 20
SIGNS = {"EUR": "€", "USD": "$", "GBP": "£"}


def facts(c: dict[str, Column]) -> Column:
    """The first line from id, title, years, rate, currency, location, remote and availability; what is null is left out."""
    years = F.when(c["years"] >= 2, F.concat(F.format_string("%.0f", F.bround(c["years"], 0)), F.lit("y"))).when(c["years"].isNotNull(), F.concat(F.format_string("%.1f", c["years"]), F.lit("y")))
    sign = F.lit("")
    for code, mark in SIGNS.items():
        sign = F.when(c["currency"] == code, mark).otherwise(sign)
    money = F.when(sign != "", sign).otherwise(F.concat(c["currency"], F.lit(" ")))
    rate = F.when(c["rate"].isNotNull(), F.concat(F.coalesce(money, F.lit("€")), F.format_string("%.0f", F.bround(c["rate"], 0)), F.lit("/h")))
    place = F.trim(F.split_part(c["location"], F.lit(","), F.lit(1)))
    where = F.when(place.isNotNull() & c["remote"], F.concat(place, F.lit(" (remote ok)"))).when(place.isNotNull(), place).when(c["remote"], "remote ok")
    return F.concat_ws(" · ", c["id"], F.substring(T.title_case_if_upper(c["title"]), 1, 60), years, rate, where, F.concat(F.lit("avail "), T.availability_label(c["availability"])))


def rendered(parts: DataFrame) -> DataFrame:
    """parts (…, facts, used array, listed array, did) with text and tokens, at most BUDGET of them where the facts allow.

    What is over the budget goes in this order: listed terms from the last, used ones down to KEPT, the line about the work
    in steps of CUT characters down to KEPT_DID, then the other used ones. All steps are numbered and the first that fits
    is taken, so there is no loop. Null lists are empty, a null or blank line is left out."""
    none = F.array().cast("array<string>")
    rows = once(parts, used=F.coalesce("used", none), listed=F.coalesce("listed", none), did=F.rtrim(F.regexp_replace(F.trim(F.coalesce("did", F.lit(""))), r"\.+$", "")), facts=F.coalesce("facts", F.lit("")))
    a, b, cuts = F.size("listed"), F.greatest(F.size("used") - KEPT, F.lit(0)), F.greatest(F.lit(0), F.ceil((F.length("did") - KEPT_DID) / CUT)).cast("int")

    def card(k: Column) -> Column:
        rest = lambda upto: F.greatest(F.lit(0), k - upto)
        used = F.size("used") - F.least(rest(a), b) - rest(a + b + cuts)
        n = F.least(rest(a + b), cuts)
        did = F.when(n > 0, F.concat(F.rtrim(F.substring("did", F.lit(1), F.greatest(F.lit(KEPT_DID - 1), F.length("did") - n * CUT - 1))), F.lit("…"))).otherwise(F.col("did"))
        skills = F.array_join(F.slice("used", F.lit(1), F.greatest(used, F.lit(0))), ", ")
        listed = F.array_join(F.slice("listed", F.lit(1), a - F.least(k, a)), ", ")
        said = F.concat_ws(" · ", F.nullif(skills, F.lit("")), F.when(listed != "", F.concat(F.lit("listed only: "), listed)))
        return F.concat_ws("\n", "facts", F.when(said != "", F.concat(F.lit("skills: "), said)), F.when(did != "", F.concat(F.lit("did: "), did)))

    last = a + F.size("used") + cuts
    fits = F.filter(F.transform(F.sequence(F.lit(0), last), card), lambda t: F.floor(F.length(t) / CHARS) <= BUDGET)
    rows = once(rows, text=F.coalesce(F.get(fits, F.lit(0)), card(last)))
    return rows.withColumn("tokens", F.greatest(F.lit(1), F.floor(F.length("text") / CHARS)).cast("bigint"))


def read_back(cards: DataFrame, text: str) -> DataFrame:
    """The rows with used, listed and did as a card shows them; lists without entries are empty, a missing line is null."""
    line = lambda mark: F.regexp_extract(text, rf"(?m)^{mark}: (.*)$", 1)
    skills = line("skills")
    listed = F.regexp_extract(skills, "listed only: (.*)$", 1)
    used = F.regexp_replace(skills, "( · )?listed only: .*$", "")
    names = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ", "))
    return cards.select("*", names(used).alias("used_shown"), names(listed).alias("listed_shown"), F.nullif(line("did"), F.lit("")).alias("did_shown"))
