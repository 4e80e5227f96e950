"""Scalar functions on text, as column expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ZERO_WIDTH = "[\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}\\x{00AD}]"
#: UTF-8 read as a Western code page: a lead byte and one or two others.
BROKEN = re.compile("[ÂÃâ][\u0080-\u00bf€™œžšŸ†‡•–—˜›‹“”‘’„‚…‰Š]{1,2}")
#: Runs start at their first character and are not given back, so a long run without a sign is read once.
EMAIL = r"(?<![\p{L}\p{N}_.+-])[\p{L}\p{N}_.+-]++@[\p{L}\p{N}_-]+(?:\.[\p{L}\p{N}_-]+)+"
#: Hosts whose addresses are redacted without a scheme.
HOSTS = ("linkedin.com", "github.com", "gitlab.com", "bitbucket.org", "twitter.com", "x.com", "medium.com", "stackoverflow.com", "behance.net", "dribbble.com")
URL = r"(?i)(?:https?://|www\.)[^\s)<>\]]+|\b(?:" + "|".join(h.replace(".", r"\.") for h in HOSTS) + r")/[^\s)<>\]]+"
PHONE_RUN = r"(?<![\p{L}\p{N}_/])(\(?\+?\d[\d\s().\-]{7,}\d)(?![\p{L}\p{N}_/])"
#: What, right before a number, says that it is no phone number.
NOT_PHONE = r"(?i)(?:isbn|issn|doi|patent|us|no\.?|#|id|pi)\s*:?\s*$"
CITED_YEAR = r"\(\s*(?:19|20)\d{2}\s*\)"
DATE_GROUPS = r"^[^0-9]*(?:(?:[0-9]{1,2}|19[0-9]{2}|20[0-9]{2})(?:[^0-9]+|$))+$"
WORD = "[a-z0-9]+"
#: Words that a search for all words leaves out.
STOP_WORDS = frozenset(
    """a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing down during each few
    for from further had has have having he her here hers him his how i if in into is it its just me more most my no nor not now of off on once only or other our out
    over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where
    which while who whom why will with you your yours""".split()
)
TOKEN = r"[a-z0-9][a-z0-9+#./&'-]*[a-z0-9+#]|[a-z0-9]"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _repaired_text(text: str | None) -> str | None:
    if text is None:
        return None

    def fix(m: re.Match) -> str:
        try:
            return m.group().encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return m.group()

    return unicodedata.normalize("NFC", BROKEN.sub(fix, text))


@F.pandas_udf(StringType())
def _repaired(values: pd.Series) -> pd.Series:
    return values.map(_repaired_text)


def repaired(c: Column) -> Column:
    """Composed characters and repaired encoding; only texts outside ASCII leave the JVM."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _repaired(c)).otherwise(c)


def tidied(c: Column) -> Column:
    """Line ends, invisible characters and spaces made regular; indents stay, empty and punctuation-only lines go."""
    c = F.regexp_replace(c, ZERO_WIDTH, "")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\t\x{00A0}]", " ")
    c = F.regexp_replace(c, r"([^ \n])  +", "$1 ")
    c = F.regexp_replace(c, r"(?m) +$", "")
    c = F.regexp_replace(c, r"(?m)^[ .,;:|_*~-]+$", "")
    c = F.regexp_replace(c, r"\n\n\n+", "\n\n")
    return F.concat(F.regexp_replace(F.regexp_replace(c, r"^\n+", ""), r"\n+$", ""), F.lit("\n"))


def normalised(c: Column) -> Column:
    return tidied(repaired(c))


def words(c: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def word_count(c: Column) -> Column:
    return F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0)))


def tokens(c: Column) -> Column:
    """Tokens that keep the signs of names such as c++, ci/cd or node.js."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def valid_phone(run: Column, before: Column) -> Column:
    """A run of 10 to 15 digits whose groups aren't all years or other dates, without a year in brackets as in a citation
    and without a word before it that says what else the number is."""
    digits = F.length(F.regexp_replace(run, "[^0-9]", ""))
    return digits.between(10, 15) & ~run.rlike(DATE_GROUPS) & ~run.rlike(CITED_YEAR) & ~F.right(before, F.lit(8)).rlike(NOT_PHONE)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """The rows with further columns, worked out in a step of their own: what comes later reads their values instead of
    repeating their expressions."""
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], made.alias("__once")).select(*[F.col(f"`{c}`") for c in df.columns if c not in columns], "__once.*")


def redaction(df: DataFrame, text: str) -> DataFrame:
    """The rows with emails, then URLs, then phone numbers of the text replaced by placeholders, and their numbers as
    emails, urls and phones. Candidates for phone numbers are marked first, so that each can be judged by what stands
    before it; a null text stays null."""
    count = lambda mark, c: F.regexp_count(c, F.lit(mark))
    df = once(df, __e=F.regexp_replace(text, EMAIL, "[email]"))
    df = once(df, __u=F.regexp_replace("__e", URL, "[url]"))
    df = once(df, __p=F.split(F.regexp_replace("__u", PHONE_RUN, "\x01$1\x02"), "\x01"))
    parts = F.col("__p")
    judged = F.zip_with(
        F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda now, last: F.when(valid_phone(F.substring_index(now, "\x02", 1), F.replace(last, F.lit("\x02"), F.lit(""))), F.concat(F.lit("[phone]\x02"), F.substring_index(now, "\x02", -1))).otherwise(now),
    )
    df = once(df, __o=F.when(F.size(parts) == 1, parts[0]).otherwise(F.concat(parts[0], F.array_join(judged, ""))))
    emails, urls = count(r"\[email\]", F.col("__e")) - count(r"\[email\]", F.col(text)), count(r"\[url\]", F.col("__u")) - count(r"\[url\]", F.col("__e"))
    df = once(df, emails=emails, urls=urls, phones=count("\\[phone\\]\x02", F.col("__o")), **{text: F.replace("__o", F.lit("\x02"), F.lit(""))})
    return df.drop("__e", "__u", "__p", "__o")


def redacted(c: Column) -> Column:
    """The text of redaction() as one expression, for a single value; for tables redaction() works each step out once."""
    c = F.regexp_replace(F.regexp_replace(c, EMAIL, "[email]"), URL, "[url]")
    parts = F.split(F.regexp_replace(c, PHONE_RUN, "\x01$1\x02"), "\x01")
    judged = F.transform(parts, lambda x, i: F.when((i > 0) & valid_phone(F.substring_index(x, "\x02", 1), F.replace(F.get(parts, i - 1), F.lit("\x02"), F.lit(""))), F.concat(F.lit("[phone]"), F.substring_index(x, "\x02", -1))).otherwise(F.replace(x, F.lit("\x02"), F.lit(""))))
    return F.when(c.isNotNull(), F.array_join(judged, ""))


def availability_label(c: Column) -> Column:
    """'2w', '1m', '10d' for a notice that starts with a number, 'now' for immediate ones, else the first 14 characters of
    the lower-cased text; null for blanks. A label is its own label."""
    low = F.lower(F.trim(c))
    notice = r"^(?:notice |avail )?(\d+)\s*(w|m|d)(?:eeks?|onths?|ays?)?$"
    return F.when(F.coalesce(low, F.lit("")) == "", None).when(low.rlike(r"^(?:avail )?(?:immediate|now$)"), "now").when(low.rlike(notice), F.concat(F.regexp_extract(low, notice, 1), F.regexp_extract(low, notice, 2))).otherwise(F.substring(low, 1, 14))


def title_case_if_upper(c: Column) -> Column:
    return F.when((c == F.upper(c)) & (c != F.lower(c)), F.initcap(F.lower(c))).otherwise(c)


def place_pattern(places: list[str]) -> str:
    """Any of the places as whole words in lower-cased text."""
    clean = list(dict.fromkeys(" ".join(p.split()).lower() for p in places if p and p.strip()))
    return "(^|[^a-z0-9])(" + "|".join(re.escape(p) for p in clean) + ")([^a-z0-9]|$)"


#: Words of a headline that tell the level, the first that fits counts.
SENIORITY_HINTS = {
    "intern": r"\b(intern|trainee|apprentice)\b",
    "executive": r"\b(chief|ceo|cfo|cto|coo|cio|vp|vice president|president|owner|founder|partner)\b",
    "director": r"\bdirector\b",
    "manager": r"\b(manager|head of|supervisor)\b",
    "principal": r"\b(principal|architect|staff)\b",
    "lead": r"\b(lead|team lead|sr\.? lead)\b",
    "senior": r"\b(senior|sr\.?)\b",
    "junior": r"\b(junior|jr\.?|associate|assistant|entry)\b",
}


def seniority_hint(c: Column) -> Column:
    out = F.lit("mid")
    for name, pattern in reversed(SENIORITY_HINTS.items()):
        out = F.when(c.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def without_repeats(df: DataFrame, text: str) -> DataFrame:
    """The rows with the text less each line that equals the last line with content before it, and their number as dropped.
    All inside the array of lines: nothing is shuffled."""
    lines = once(df, __l=F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n"))
    full = once(lines, __f=F.filter(F.transform("__l", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda s: F.trim(s["x"]) != ""))
    again = F.filter(F.zip_with(F.slice("__f", F.lit(2), F.greatest(F.size("__f") - 1, F.lit(0))), F.slice("__f", F.lit(1), F.greatest(F.size("__f") - 1, F.lit(0))), lambda a, b: F.when(a["x"] == b["x"], a["i"])), lambda i: i.isNotNull())
    gone = once(full, __g=again)
    kept = F.filter("__l", lambda x, i: ~F.array_contains("__g", i))
    return gone.withColumn(text, F.array_join(kept, "\n")).withColumn("dropped", F.size("__g").cast("bigint")).drop("__l", "__f", "__g")
