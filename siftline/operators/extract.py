"""Parsing of documents and extraction of fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import once
from .sets import ranked

LEVELS = {"listed": 1, "used": 2, "led": 3}
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
MONTH = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?"
#: Month and year, yyyy-mm, m/d/yy, mm/yyyy, year.
DATE = rf"(?i){MONTH}\s+\d{{4}}|\d{{4}}-\d{{1,2}}|\d{{1,2}}/\d{{1,2}}/\d{{2,4}}|\d{{1,2}}/\d{{4}}|(?<!\d)(?:19|20)\d{{2}}(?!\d)"
OPEN = r"(?i)\b(current|present|now|to date|today|ongoing)\b"
SEPARATOR = r"(?i)to|-|–|—|through|until|till"
#: Month that open-ended jobs are counted to, where the caller names none.
UNTIL = 2026 * 12
#: Months of the longest job that counts, and the first year.
LONGEST, FIRST_YEAR = 600, 1950

#: Words in titles that tell the kind of a section, the first kind that fits counts.
SECTION_KINDS = {
    "education": "education|academic|degree|coursework|training and|schooling",
    "experience": "experience|employment|work history|professional background|career|positions|projects|accomplishments|achievements|internship|history",
    "skills": "skill|highlight|qualification|competenc|expertise|technical|technolog|tools|proficien|strength|certification|licens|languages|software",
    "summary": "summary|profile|objective|about|overview|focus|introduction",
    "skip": "interest|hobbies|personal|references|affiliation|additional|activities|awards|honors|military|volunteer|publications|presentations",
}
#: Verbs that open a line about leading.
LEADING = r"(?i)^\W*(led|lead|managed|owned|architected|directed|headed|spearheaded|drove|oversaw|founded|established|supervised|coordinated a team|built and led|mentored)\b"
#: Levels of education, the highest first, in the education section and, stricter, anywhere.
EDUCATION = {
    "phd": r"\b(ph\.?\s?d\.?|doctor of|doctorate|d\.?phil|dr\.? of)\b",
    "master": r"\b(master('s|s)?( of| in| degree)?|m\.?s\.?c?\.?|m\.?a\.?|mba|m\.?eng\.?|m\.?ed\.?|ll\.?m\.?|m\.?phil|msc|meng)\b",
    "bachelor": r"\b(bachelor('s|s)?( of| in| degree)?|b\.?s\.?c?\.?|b\.?a\.?|b\.?e\.?|b\.?tech\.?|b\.?eng\.?|bba|bsn|ll\.?b\.?|bsc|beng|b\.?com)\b",
    "associate": r"\b(associate('s|s)? (degree|of|in)|a\.?a\.?s?\.?|a\.?s\.?)\b",
    "high_school": r"\b(high school|ged|secondary school|hs diploma|diploma)\b",
}
EDUCATION_ANYWHERE = {"phd": r"\b(ph\.?d|doctorate)\b", "master": r"\b(master('s|s)? (of|in|degree)|mba)\b", "bachelor": r"\b(bachelor('s|s)? (of|in|degree))\b"}


def first_match(text: Column, patterns: dict[str, str], otherwise: str | None = None) -> Column:
    """The name of the first pattern found in the text, whatever the case."""
    out = F.lit(otherwise).cast("string")
    for name, pattern in reversed(patterns.items()):
        out = F.when(text.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def section_kind(c: Column) -> Column:
    return first_match(c, SECTION_KINDS, "other")


def parsed_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, role, text, section, kind, entry, entry_no) of all lines that aren't blank.

    role: headline (a first line '# x'), section ('## x'), entry ('### x'), meta (a line in single asterisks), else line;
    text is without marks of headings, asterisks and bullets. section is the last title above, 'Preamble' (a summary)
    before the first; kind its kind; entry the last '### ' title above in the section, null without one; entry_no the
    line it stands in, or the one of the section. Places of headings are found in arrays, so nothing is shuffled."""
    lines = F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")
    rows = docs.where(F.col(text).isNotNull()).select(key, F.transform(lines, lambda x: F.rtrim(x)).alias("ls"))
    numbers = F.sequence(F.lit(1), F.size("ls"))
    at = lambda test: F.filter(numbers, lambda i: test(F.element_at("ls", i)))
    rows = rows.select(key, "ls", at(lambda x: x.startswith("## ")).alias("tops"), at(lambda x: x.startswith("### ")).alias("subs"), at(lambda x: F.trim(x) != "").alias("full"))
    rows = rows.select(key, F.get("full", F.lit(0)).alias("first"), "tops", "subs", F.explode(F.transform("full", lambda i: F.struct(i.alias("n"), F.element_at("ls", i).alias("line")))).alias("x"), "ls")
    last = lambda places: F.array_max(F.filter(places, lambda p: p <= F.col("x.n")))
    rows = rows.select(key, "first", "ls", F.col("x.n").alias("n"), F.col("x.line").alias("line"), last("tops").alias("top"), last("subs").alias("sub"))
    line, top, sub = F.col("line"), F.col("top"), F.when(F.coalesce(F.col("sub") > F.coalesce("top", F.lit(0)), F.lit(False)), F.col("sub"))
    role = (
        F.when((F.col("n") == F.col("first")) & line.startswith("# "), "headline")
        .when(line.startswith("## "), "section")
        .when(line.startswith("### "), "entry")
        .when(line.rlike(r"^\*(?!\*).+\*$"), "meta")
        .otherwise("line")
    )
    plain = F.when(role.isin("headline", "section", "entry"), F.trim(F.regexp_replace(line, "^#+ ", ""))).when(role == "meta", F.trim(F.regexp_replace(line, r"^\*|\*$", ""))).otherwise(F.trim(F.regexp_replace(F.trim(line), "^[-*•] +", "")))
    title = lambda i, marks: F.trim(F.substring(F.element_at("ls", i), F.lit(marks + 2), F.length(F.element_at("ls", i))))
    parsed = rows.select(key, F.col("n").cast("bigint").alias("line_no"), role.alias("role"), plain.alias("text"), F.when(role == "headline", None).when(top.isNull(), "Preamble").otherwise(title(top, 2)).alias("section"), F.when(sub.isNotNull(), title(sub, 3)).alias("entry"), F.coalesce(sub, top, F.lit(0)).cast("bigint").alias("entry_no"), "top")
    kind = F.when(F.col("role") == "headline", None).when(F.col("top").isNull(), "summary").otherwise(section_kind(F.col("section")))
    return parsed.select(key, "line_no", "role", "text", "section", kind.alias("kind"), "entry", "entry_no")


def section_sizes(docs: DataFrame, key: str, text: str) -> DataFrame:
    rows = parsed_lines(docs, key, text).where("section is not null")
    return rows.groupBy(key, "section", "kind").agg(F.count_if(F.col("role") == "line").alias("lines"), F.count_if(F.col("role") == "entry").alias("entries"))


def meta_lines(lines: DataFrame, key: str) -> DataFrame:
    """(key, line_no, kind, entry, entry_no, company, location, dates_text) of the meta lines of parsed_lines: 'company —
    location · dates', any part of which may be missing. Dates alone are no company."""
    head, tail = F.trim(F.substring_index("text", "·", 1)), F.trim(F.regexp_extract("text", "^[^·]*·(.*)$", 1))
    tail = F.array_join(F.transform(F.split(tail, "·"), lambda x: F.trim(x)), " · ")
    rows = lines.where("role = 'meta'").select(key, "line_no", "kind", "entry", "entry_no", head.alias("head"), tail.alias("tail"))
    dated = ~F.col("head").contains(" — ") & F.col("head").rlike(DATE) & (F.col("tail") == "")
    empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    company = F.when(dated, None).when(F.col("head").contains(" — "), empty(F.regexp_extract("head", "^(.*?) — ", 1))).otherwise(empty(F.col("head")))
    return rows.select(key, "line_no", "kind", "entry", "entry_no", company.alias("company"), F.when(F.col("head").contains(" — "), empty(F.regexp_extract("head", "^.*? — (.*)$", 1))).alias("location"), F.when(dated, F.col("head")).otherwise(empty(F.col("tail"))).alias("dates_text"))


def _date(name: str, end: bool = False) -> Column:
    """Months since year 0 of a lower-cased date in any of the forms of DATE, from a column by name; a year alone is its
    January, as an end its December. One SQL expression, which is quicker to build than its parts."""
    c = f"`{name}`"
    part = lambda pattern, i: f"try_cast(regexp_extract({c}, r'{pattern}', {i}) as int)"
    month = lambda m: f"greatest(1, least(12, {m})) - 1"
    day, two = r"^(\d{1,2})/\d{1,2}/(\d{2,4})$", r"^(\d{1,2})/(\d{4})$"
    year = part(day, 2)
    return F.expr(
        f"""cast(case when {c} rlike r'^{MONTH}\\s+\\d{{4}}$' then {part(r"(\d{4})$", 1)} * 12 + floor((instr('{MONTHS.lower()}', left({c}, 3)) + 2) / 3) - 1
        when {c} rlike r'^\\d{{4}}-\\d{{1,2}}$' then {part(r"^(\d{4})", 1)} * 12 + {month(part(r"-(\d{1,2})$", 1))}
        when {c} rlike r'{day}' then (case when {year} < 50 then 2000 when {year} < 100 then 1900 else 0 end + {year}) * 12 + {month(part(day, 1))}
        when {c} rlike r'{two}' then {part(two, 2)} * 12 + {month(part(two, 1))}
        when {c} rlike r'^\\d{{4}}$' then try_cast({c} as int) * 12 + {11 if end else 0} end as bigint)"""
    )


def with_months(rows: DataFrame, text: str = "dates_text", until: int = UNTIL) -> DataFrame:
    """The rows with start_month, end_month (months since year 0) and open from a text of dates: two dates in any of the
    forms with any words between them, one with a word for an open end, which ``until`` stands for, or one alone. Null
    where there is no range, or one that ends before it starts."""
    found = once(rows, __d=F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), __r=F.regexp_replace(text, rf"(?is)^.*?(?:{DATE})", ""))
    low = lambda i: F.replace(F.lower(F.trim(F.get("__d", F.lit(i)))), F.lit("sept"), F.lit("sep"))
    found = once(found, __1=low(0), __2=low(1), __one=F.size("__d") == 1)
    alone = F.when(F.col("__one") & ~F.col("__r").rlike(SEPARATOR), _date("__1", True))
    found = once(found, __s=_date("__1"), __b=_date("__2", True), __a=alone, __o=F.col("__one") & F.col("__r").rlike(OPEN))
    found = once(found, __e=F.coalesce("__b", F.when(F.col("__o"), F.lit(until)), "__a").cast("bigint"))
    fits = F.coalesce(F.col("__e") >= F.col("__s"), F.lit(False)) | (F.col("__o") & F.col("__s").isNotNull())
    months = [F.when(fits, F.col(a)).alias(b) for a, b in (("__s", "start_month"), ("__e", "end_month"), ("__o", "open"))]
    return found.select(*rows.columns, *months)


def date_ranges(docs: DataFrame, key: str, text: str, until: int = UNTIL, kind: str | None = None) -> DataFrame:
    """(key, start_month, end_month) of the jobs that count towards years, of one kind of section or of all: they start
    between FIRST_YEAR and the year of ``until`` and last LONGEST months at most."""
    lines = parsed_lines(docs, key, text)
    jobs = with_months(meta_lines(lines if kind is None else lines.where(F.col("kind") == kind), key), until=until)
    length = F.col("end_month") - F.col("start_month") + 1
    kept = jobs.where(F.col("start_month").between(FIRST_YEAR * 12, until // 12 * 12 + 11) & length.between(1, LONGEST))
    return kept.select(key, "start_month", "end_month").distinct()


def education(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, level): the highest level named in sections of education, else what the whole text says more clearly."""
    lines = parsed_lines(docs, key, text).where("kind = 'education' and role in ('entry', 'line')")
    level = F.min(F.when(first_match(F.col("text"), EDUCATION).isNotNull(), F.array_position(F.array(*map(F.lit, EDUCATION)), first_match(F.col("text"), EDUCATION))))
    named = lines.groupBy(key).agg(level.alias("place")).where("place is not null").select(key, F.element_at(F.array(*map(F.lit, EDUCATION)), F.col("place").cast("int")).alias("level"))
    other = docs.join(named.select(key), key, "left_anti").select(key, first_match(F.col(text), EDUCATION_ANYWHERE).alias("level")).where("level is not null")
    return named.union(other)


def current_title(lines: DataFrame, key: str) -> DataFrame:
    """(key, title) from parsed_lines: the first entry of experience that has a meta line, else the headline."""
    job = F.min(F.when((F.col("role") == "meta") & (F.col("kind") == "experience") & (F.coalesce("entry", F.lit("")) != ""), F.struct("line_no", "entry")))["entry"]
    head = F.max(F.when(F.col("role") == "headline", F.col("text")))
    return lines.groupBy(key).agg(F.coalesce(job, head).alias("title")).where("title is not null")


def registered(deliveries: DataFrame, registry: DataFrame) -> DataFrame:
    """(source, source_id, doc_no, fresh): numbers of deliveries; new keys are numbered after the largest in use."""
    known = registry.groupBy("source", "source_id").agg(F.min("doc_no").alias("doc_no"))
    keys = deliveries.select("source", "source_id").distinct()
    old = keys.join(known, ["source", "source_id"]).select("source", "source_id", F.col("doc_no").cast("bigint").alias("doc_no"), F.lit(False).alias("fresh"))
    top = registry.agg(F.max("doc_no")).first()[0] or 0
    new = ranked(keys.join(known, ["source", "source_id"], "left_anti"), [F.col("source"), F.col("source_id")], name="k")
    return old.union(new.select("source", "source_id", (F.lit(top) + F.col("k")).cast("bigint").alias("doc_no"), F.lit(True).alias("fresh")))


def quality_stats(rows: DataFrame) -> DataFrame:
    """(source, ...) from (source, n words, h, t, s). The 90 % value is the one at that place of the sorted list; it comes
    from the counts of distinct lengths, so no list of all lengths is built."""
    base = rows.groupBy("source").agg(F.count("*").alias("docs"), F.count_if("h").alias("no_headline"), F.count_if(F.col("n") < 50).alias("short"), F.count_if("t").alias("tags"), F.count_if("s").alias("no_section"), F.percentile("n", 0.5).alias("p50"), F.max("n").alias("longest"), F.min("n").alias("shortest"))
    sizes = rows.groupBy("source", "n").agg(F.count("*").alias("k"))
    upto = sizes.withColumn("upto", F.sum("k").over(Window.partitionBy("source").orderBy("n")))
    p90 = upto.join(base.select("source", "docs"), "source").where(F.col("upto") > F.floor(F.col("docs") * 0.9)).groupBy("source").agg(F.min("n").alias("p90"))
    return base.join(p90, "source")


def vocabulary_problems(terms: DataFrame) -> DataFrame:
    forms = terms.where("kind <> 'title'").select("slug", F.explode(F.concat(F.array("canonical"), "aliases")).alias("form")).select("slug", F.lower("form").alias("form"))
    twice = forms.groupBy("form").agg(F.count_distinct("slug").alias("terms")).where("terms > 1")
    implied = terms.select(F.explode("implies").alias("i"))
    gone = implied.join(terms.select(F.col("slug").alias("i")), "i", "left_anti").groupBy(F.concat(F.lit("missing: "), "i").alias("form")).agg(F.count("*").alias("terms"))
    return twice.union(gone)


def closure(terms: DataFrame, depth: int = 5) -> DataFrame:
    """(slug, implied, depth): a join for each step; the vocabulary is small, documents don't take part."""
    step = edges = terms.select("slug", F.explode("implies").alias("implied")).distinct()
    out = step.withColumn("depth", F.lit(1))
    for i in range(2, depth + 1):
        step = step.join(edges.select(F.col("slug").alias("implied"), F.col("implied").alias("next")), "implied").select("slug", F.col("next").alias("implied")).distinct()
        out = out.union(step.withColumn("depth", F.lit(i)))
    return out.groupBy("slug", "implied").agg(F.min("depth").alias("depth"))


def level_rank(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), c), F.lit(0))


def best_level(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc_no", "term_id").agg(F.max(level_rank(F.col("level"))).alias("level_rank"))
