"""Cleaning, identity and extraction: corpus build."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import components, extract, intervals, rates
from ..runtime import stored, table, texts

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(r"""with a as (select raw_no, regexp_replace(regexp_replace(regexp_replace(markdown, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}]', '', 'g'), '\r\n?', chr(10), 'g'), '[\t\x{00A0}]', ' ', 'g') as t from raw_docs where markdown is not null),
    b as (select raw_no, regexp_replace(regexp_replace(regexp_replace(t, '([^ \n])  +', '\1 ', 'g'), '(?m) +$', '', 'g'), '(?m)^[ .,;:|_*~-]+$', '', 'g') as t from a)
    select raw_no, regexp_replace(regexp_replace(regexp_replace(t, '\n\n\n+', chr(10) || chr(10), 'g'), '^\n+', ''), '\n+$', '') || chr(10) as text from b""")
def clean_tidied(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, "raw_docs").where("markdown is not null").select("raw_no", T.tidied(F.col("markdown")).alias("text"))


@query()
def clean_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Tidied texts with repaired encoding and composed characters."""
    return texts(spark, d, "raw_docs").where("markdown is not null").select("raw_no", T.normalised(F.col("markdown")).alias("text"))


@query(r"""select doc_no, trim(regexp_replace(markdown, '\s+', ' ', 'g')) as text from docs where markdown is not null""")
def clean_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d, "docs").where("markdown is not null").select("doc_no", T.collapse(F.col("markdown")).alias("text"))


_TIDIED = r"""a as (select *, regexp_replace(regexp_replace(regexp_replace(markdown, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{00AD}]', '', 'g'), '\r\n?', chr(10), 'g'), '[\t\x{00A0}]', ' ', 'g') as t1 from src where markdown is not null),
    b as (select * exclude (t1), regexp_replace(regexp_replace(regexp_replace(t1, '([^ \n])  +', '\1 ', 'g'), '(?m) +$', '', 'g'), '(?m)^[ .,;:|_*~-]+$', '', 'g') as t2 from a),
    tidy as (select * exclude (t2), regexp_replace(regexp_replace(regexp_replace(t2, '\n\n\n+', chr(10) || chr(10), 'g'), '^\n+', ''), '\n+$', '') || chr(10) as t from b)"""


def _redacted_sql(source: str) -> str:
    hosts = "|".join(h.replace(".", "\\.") for h in T.HOSTS)
    return rf"""e as (select *, regexp_replace(t, '[\p{{L}}\p{{N}}_.+-]+@[\p{{L}}\p{{N}}_-]+(\.[\p{{L}}\p{{N}}_-]+)+', '[email]', 'g') as te from {source}),
    u as (select *, regexp_replace(te, '(?i)(?:https?://|www\.)[^\s)<>\]]+|\b(?:{hosts})/[^\s)<>\]]+', '[url]', 'g') as tu from e),
    k as (select *, string_split(regexp_replace(tu, '(^|[^\p{{L}}\p{{N}}_/])(\(?\+?[0-9][0-9\s().-]{{7,}}[0-9])([^\p{{L}}\p{{N}}_/]|$)', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1)) as ps from u),
    f as (select * exclude (ps), ps[1] as p0, list_transform(range(2, len(ps) + 1), lambda i: struct_pack(run := string_split(ps[i], chr(2))[1], rest := string_split(ps[i], chr(2))[2], before := replace(ps[i - 1], chr(2), ''))) as cs from k),
    g as (select * exclude (cs), p0 || list_aggregate(list_prepend('', list_transform(cs, lambda c: case when length(regexp_replace(c.run, '[^0-9]', '', 'g')) between 10 and 15 and len(list_filter(regexp_extract_all(c.run, '[0-9]+'), lambda d: length(d) > 2 and not regexp_matches(d, '^(19|20)[0-9][0-9]$'))) > 0
        and not regexp_matches(c.run, '\(\s*(19|20)[0-9][0-9]\s*\)') and not regexp_matches(right(c.before, 8), '(?i)(isbn|issn|doi|patent|us|no\.?|#|id|pi)\s*:?\s*$') then '[phone]' || chr(2) else c.run end || c.rest)), 'string_agg', '') as tp from f),
    clean as (select *, replace(tp, chr(2), '') as text, (len(string_split(te, '[email]')) - len(string_split(t, '[email]')))::int as emails, (len(string_split(tu, '[url]')) - len(string_split(te, '[url]')))::int as urls, (len(string_split(tp, chr(2))) - 1)::int as phones from g)"""


@query(f"with src as (select doc_no, markdown from docs where markdown is not null), tidy as (select *, markdown as t from src), {_redacted_sql('tidy')} select doc_no, text, emails, urls, phones from clean")
def clean_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Texts without contact details, with the numbers of those taken out."""
    return T.redaction(texts(spark, d, "docs").where("markdown is not null").select("doc_no", F.col("markdown").alias("text")), "text")


_HASHED = rf"src as (select raw_no, source, source_id, markdown from raw_docs), {_TIDIED}, {_redacted_sql('tidy')}, hashed as (select *, substr(sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))), 1, 16) as hash, len(regexp_extract_all(text, '\S+'))::int as words from clean)"


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries tidied, then redacted, then hashed; those with fewer than five words are left out."""
    raw = texts(spark, d, "raw_docs").where("markdown is not null").select("raw_no", "source", "source_id", T.tidied(F.col("markdown")).alias("t"))
    return T.redaction(raw, "t").select("raw_no", "source", "source_id", T.content_hash(T.collapse(F.col("t"))).alias("hash"), T.word_count(F.col("t")).alias("words")).where("words >= 5")


@query(f"with {_HASHED} select raw_no, hash, words from hashed where words >= 5")
def corpus_hashed(spark: SparkSession, d: str) -> DataFrame:
    return _hashed(spark, d).select("raw_no", "hash", "words")


#: Which source's copy stands for a content that several deliver; sources not listed come after.
SOURCE_ORDER = ("livedesk", "archive", "inbox")


@query(f"""with {_HASHED}, o as (select raw_no, source, hash, coalesce(list_position({list(SOURCE_ORDER)}, source), 99) as place from hashed where words >= 5),
    w as (select *, row_number() over (partition by hash order by place, raw_no) as k, first_value(raw_no) over (partition by hash order by place, raw_no) as first_no, count(*) over (partition by hash) as copies from o) select raw_no, hash, first_no, copies, k > 1 as duplicate from w""")
def corpus_exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery with the first copy of its content, in the order of the sources: the others are its provenance. The
    first copy is a partial minimum, so a content that a third of all rows share is no list."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source")), F.lit(0)), F.lit(99))
    k = stored(_hashed(spark, d).select("raw_no", "hash", "source")).select("raw_no", "hash", place.alias("place"))
    first = k.groupBy("hash").agg(F.min(F.struct("place", "raw_no"))["raw_no"].alias("first_no"), F.count("*").alias("copies"))
    return k.join(first, "hash").select("raw_no", "hash", "first_no", "copies", (F.col("raw_no") != F.col("first_no")).alias("duplicate"))


@query(r"""with r as (select source, source_id, min(doc_no) as doc_no from docs group by 1, 2), i as (select distinct source, source_id from raw_docs),
    n as (select i.source, i.source_id, row_number() over (order by i.source, i.source_id) as k from i left join r on r.source = i.source and r.source_id = i.source_id where r.doc_no is null)
    select source, source_id, ((select max(doc_no) from docs) + k)::bigint as doc_no, true as fresh from n
    union all select i.source, i.source_id, r.doc_no::bigint, false from i join r on r.source = i.source and r.source_id = i.source_id""")
def corpus_registry(spark: SparkSession, d: str) -> DataFrame:
    """Stable numbers: known deliveries keep theirs, new ones get the next, none is used twice."""
    return extract.registered(table(spark, d, "raw_docs"), table(spark, d, "docs"))


@query("""select doc_no, source, source_id from docs where not exists (select 1 from raw_docs r where r.source = docs.source and r.source_id = docs.source_id)""")
def corpus_missing(spark: SparkSession, d: str) -> DataFrame:
    """Registered documents that were not delivered again."""
    return table(spark, d, "docs").join(table(spark, d, "raw_docs").select("source", "source_id"), ["source", "source_id"], "left_anti").select("doc_no", "source", "source_id")


@query(f"""with {_HASHED} select raw_no, hash, words from hashed k where words >= 5 and not exists (select 1 from docs e where e.source = k.source and e.source_id = k.source_id) and not exists (select 1 from docs e where e.hash = k.hash)""")
def corpus_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries with neither a known key nor a known content, cleaned as the first build cleans them."""
    known = table(spark, d, "docs")
    return _hashed(spark, d).join(known.select("source", "source_id"), ["source", "source_id"], "left_anti").join(known.select("hash"), "hash", "left_anti").select("raw_no", "hash", "words")


@query(r"""select source, count(*) as docs, count(*) filter (where not regexp_matches(markdown, '(?m)^# ')) as no_headline, count(*) filter (where len(regexp_extract_all(markdown, '\S+')) < 50) as short,
    count(*) filter (where regexp_matches(markdown, '</?[a-z]+[^>]*>')) as tags, count(*) filter (where not regexp_matches(markdown, '(?m)^## ')) as no_section, quantile_cont(len(regexp_extract_all(markdown, '\S+')), 0.5) as p50,
    list_sort(list(len(regexp_extract_all(markdown, '\S+'))))[floor(count(*) * 0.9)::int + 1]::int as p90, max(len(regexp_extract_all(markdown, '\S+')))::int as longest, min(len(regexp_extract_all(markdown, '\S+')))::int as shortest from docs where markdown is not null group by source""")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("markdown")
    rows = texts(spark, d, "docs").where("markdown is not null").select("source", T.word_count(m).alias("n"), (~m.rlike(r"(?m)^# ")).alias("h"), m.rlike(r"</?[a-z]+[^>]*>").alias("t"), (~m.rlike(r"(?m)^## ")).alias("s"))
    return extract.quality_stats(rows)


_HINT = "case " + " ".join(f"when regexp_matches({{0}}, '(?i){p}') then '{k}'" for k, p in T.SENIORITY_HINTS.items()) + " else 'mid' end"


@query(f"select distinct doc_no, {_HINT.format('headline')} as hint from profile where headline is not null")
def extract_seniority(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "profile").where("headline is not null").select("doc_no", T.seniority_hint(F.col("headline")).alias("hint")).distinct()


@query(f"""with h as (select distinct d.doc_no, id, category, {_HINT.format("coalesce(headline, '')")} as hint from docs d left join profile p using (doc_no) where id is not null)
    select doc_no, hint, greatest(15, least(250, round_even({rates.base_sql("category")} * {rates.multiplier_sql("hint")} * (0.8::double + 0.4::double * (('0x' || substr(sha256('rate:' || id), 1, 8))::bigint / 4294967295.0::double)), 0)))::bigint as rate from h""")
def synthetic_rates(spark: SparkSession, d: str) -> DataFrame:
    """A rate for records that state none: base of the category, level, and a draw fixed by the name of the record."""
    h = table(spark, d, "docs").where("id is not null").join(table(spark, d, "profile").select("doc_no", "headline"), "doc_no", "left")
    h = h.select("doc_no", "id", "category", T.seniority_hint(F.coalesce("headline", F.lit(""))).alias("hint")).distinct()
    return h.select("doc_no", "hint", rates.synthetic(F.col("category"), F.col("id"), F.col("hint")).alias("rate"))


@query(f"""with p as (select distinct doc_no, rate, rate_source, headline from profile), h as (select p.*, id, category, {_HINT.format("coalesce(headline, '')")} as hint from p join docs using (doc_no) where id is not null)
    select doc_no, coalesce(rate, greatest(15, least(250, round_even({rates.base_sql("category")} * {rates.multiplier_sql("hint")} * (0.8::double + 0.4::double * (('0x' || substr(sha256('rate:' || id), 1, 8))::bigint / 4294967295.0::double)), 0)))) as rate, case when rate is null then 'synthetic' else coalesce(rate_source, 'document') end as rate_source from h""")
def rate_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The stated rate wins over the synthetic one, and the source says which it is."""
    p = table(spark, d, "profile").select("doc_no", "rate", "rate_source", "headline").distinct().join(table(spark, d, "docs").where("id is not null").select("doc_no", "id", "category"), "doc_no")
    made = rates.synthetic(F.col("category"), F.col("id"), T.seniority_hint(F.coalesce("headline", F.lit("")))).cast("double")
    return p.select("doc_no", F.coalesce("rate", made).alias("rate"), F.when(F.col("rate").isNull(), "synthetic").otherwise(F.coalesce("rate_source", F.lit("document"))).alias("rate_source"))


_KINDS = "case " + " ".join(f"when regexp_matches({{0}}, '(?i){p}') then '{k}'" for k, p in extract.SECTION_KINDS.items()) + " else 'other' end"
_LINES = rf"""l as (select doc_no, i::bigint as line_no, rtrim(ls[i], ' ') as line from (select doc_no, string_split(replace(markdown, chr(13), ''), chr(10)) as ls from docs where markdown is not null), unnest(range(1, len(ls) + 1)) as r(i) where trim(ls[i]) <> ''),
    m as (select *, min(line_no) over (partition by doc_no) = line_no and starts_with(line, '# ') as is_head, max(case when starts_with(line, '## ') then line_no end) over w as top, max(case when starts_with(line, '### ') then line_no end) over w as sub from l window w as (partition by doc_no order by line_no rows unbounded preceding)),
    o as (select *, case when is_head then 'headline' when starts_with(line, '## ') then 'section' when starts_with(line, '### ') then 'entry' when regexp_matches(line, '^\*[^*].*\*$') then 'meta' else 'line' end as role from m),
    t as (select doc_no, line_no, role, case when role in ('headline', 'section', 'entry') then trim(regexp_replace(line, '^#+ ', '')) when role = 'meta' then trim(regexp_replace(line, '^\*|\*$', '', 'g')) else trim(regexp_replace(trim(line), '^[-*•] +', '')) end as text, top, case when sub > coalesce(top, 0) then sub end as sub from o),
    s as (select t.doc_no, t.line_no, t.role, t.text, case when t.role = 'headline' then null when t.top is null then 'Preamble' else a.text end as section, case when t.role = 'headline' then null when t.top is null then 'summary' else {_KINDS.format("a.text")} end as kind, b.text as entry, coalesce(t.sub, t.top, 0)::bigint as entry_no
        from t left join t a on a.doc_no = t.doc_no and a.line_no = t.top left join t b on b.doc_no = t.doc_no and b.line_no = t.sub)"""


@query(f"with {_LINES} select * from s")
def extract_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every line with its role, section, kind of section and entry."""
    return extract.parsed_lines(texts(spark, d, "docs"), "doc_no", "markdown")


@query(f"with {_LINES} select doc_no, section, kind, count(*) filter (where role = 'line') as lines, count(*) filter (where role = 'entry') as entries from s where section is not null group by all")
def extract_section_sizes(spark: SparkSession, d: str) -> DataFrame:
    return extract.section_sizes(texts(spark, d, "docs"), "doc_no", "markdown")


_MONTH_NAME = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?"
_DATES = rf"{_MONTH_NAME}\s+[0-9]{{4}}|[0-9]{{4}}-[0-9]{{1,2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[0-9]{{1,2}}/[0-9]{{4}}"
_META = rf"""h as (select *, trim(string_split(text, '·')[1]) as head, array_to_string(list_transform(string_split(text, '·')[2:], lambda x: trim(x)), ' · ') as tail from s where role = 'meta'),
    e as (select doc_no, line_no, kind, entry, entry_no, head, tail, not contains(head, ' — ') and tail = '' and regexp_matches(lower(head), '{_DATES}|(^|[^0-9])(19|20)[0-9][0-9]([^0-9]|$)') as dated from h),
    meta as (select doc_no, line_no, kind, entry, entry_no, case when dated then null when contains(head, ' — ') then nullif(trim(string_split(head, ' — ')[1]), '') else nullif(head, '') end as company,
        case when contains(head, ' — ') then nullif(trim(array_to_string(string_split(head, ' — ')[2:], ' — ')), '') end as location, case when dated then head else nullif(tail, '') end as dates_text from e)"""


@query(f"with {_LINES}, {_META} select * from meta")
def extract_meta(spark: SparkSession, d: str) -> DataFrame:
    """Company, place and dates of each line about a job or a school."""
    return extract.meta_lines(extract.parsed_lines(texts(spark, d, "docs"), "doc_no", "markdown"), "doc_no")


def _month_sql(x: str, end: bool) -> str:
    m = f"(instr('janfebmaraprmayjunjulaugsepoctnovdec', {x}[1:3]) + 2) // 3 - 1"
    part = lambda i, sep: f"string_split({x}, '{sep}')[{i}]::int"
    return f"""case when regexp_matches({x}, '^[a-z]') then {x}[-4:]::int * 12 + {m} when contains({x}, '-') then {part(1, "-")} * 12 + greatest(1, least(12, {part(2, "-")})) - 1
        when len(string_split({x}, '/')) = 3 then (case when {part(3, "/")} < 50 then 2000 when {part(3, "/")} < 100 then 1900 else 0 end + {part(3, "/")}) * 12 + greatest(1, least(12, {part(1, "/")})) - 1
        when contains({x}, '/') then {part(2, "/")} * 12 + greatest(1, least(12, {part(1, "/")})) - 1 else {x}::int * 12 + {11 if end else 0} end"""


#: Dates by their places: DuckDB has no look-around, so runs of digits are taken whole and all but years dropped.
_RANGES = rf"""x as (select *, list_filter(regexp_extract_all(lower(dates_text), '{_DATES}|[0-9]+'), lambda x: not regexp_matches(x, '^[0-9]+$') or regexp_matches(x, '^(19|20)[0-9][0-9]$')) as ds from meta),
    y as (select *, case when len(ds) > 0 then substr(lower(dates_text), instr(lower(dates_text), ds[1]) + length(ds[1])) end as rest from x),
    z as (select *, {_month_sql("ds[1]", False)} as s0, case when len(ds) > 1 then {_month_sql("ds[2]", True)} when regexp_matches(rest, '\b(current|present|now|to date|today|ongoing)\b') then {extract.UNTIL} when not regexp_matches(rest, 'to|-|–|—|through|until|till') then {_month_sql("ds[1]", True)} end as e0,
        len(ds) = 1 and regexp_matches(rest, '\b(current|present|now|to date|today|ongoing)\b') as open0 from y where len(ds) > 0),
    ranges as (select doc_no, line_no, kind, s0::bigint as start_month, e0::bigint as end_month, open0 as open from z where e0 >= s0 or open0),
    v as (select distinct doc_no, start_month as s, end_month as e from ranges where kind = 'experience' and start_month >= {extract.FIRST_YEAR * 12} and start_month <= {extract.UNTIL // 12 * 12 + 11} and end_month - start_month + 1 between 1 and {extract.LONGEST})"""


@query(f"with {_LINES}, {_META}, {_RANGES} select doc_no, line_no, start_month, end_month, open from ranges")
def extract_date_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The ranges of dates of all lines about jobs and schools, in any of the five forms."""
    meta = extract.meta_lines(extract.parsed_lines(texts(spark, d, "docs"), "doc_no", "markdown"), "doc_no")
    return extract.with_months(meta).where("start_month is not null").select("doc_no", "line_no", "start_month", "end_month", "open")


@query(f"""with {_LINES}, {_META}, {_RANGES}, p as (select *, max(e) over (partition by doc_no order by s, e rows between unbounded preceding and 1 preceding) as before from v),
    g as (select *, sum(case when before is null or s > before + 1 then 1 else 0 end) over (partition by doc_no order by s, e rows unbounded preceding) as island from p),
    u as (select doc_no, island, max(e) - min(s) + 1 as months from g group by 1, 2) select doc_no, round_even(sum(months)::double / 12, 1) as years, count(*) as islands from u group by 1""")
def extract_years(spark: SparkSession, d: str) -> DataFrame:
    """Years of experience: the union of overlapping jobs in months."""
    return intervals.years(extract.date_ranges(texts(spark, d, "docs"), "doc_no", "markdown", kind="experience"), "doc_no")


@query(f"""with {_LINES} select doc_no, count(*) filter (where regexp_matches(text, '{extract.LEADING}')) as led, count(*) as lines from s where role = 'line' and kind = 'experience' group by 1""")
def extract_led(spark: SparkSession, d: str) -> DataFrame:
    lines = extract.parsed_lines(texts(spark, d, "docs"), "doc_no", "markdown").where("kind = 'experience' and role = 'line'")
    return lines.groupBy("doc_no").agg(F.count_if(F.col("text").rlike(extract.LEADING)).alias("led"), F.count("*").alias("lines"))


def _levels_sql(text: str, patterns: dict[str, str]) -> str:
    quoted = {k: p.replace("'", "''") for k, p in patterns.items()}
    return "case " + " ".join(f"when bool_or(regexp_matches({text}, '(?i){p}')) then '{k}'" for k, p in quoted.items()) + " end"


@query(f"""with {_LINES}, n as (select doc_no, {_levels_sql("text", extract.EDUCATION)} as level from s where kind = 'education' and role in ('entry', 'line') group by 1),
    a as (select doc_no, {_levels_sql("markdown", extract.EDUCATION_ANYWHERE)} as level from docs where markdown is not null group by 1)
    select doc_no, coalesce(n.level, a.level) as level from a left join n using (doc_no) where coalesce(n.level, a.level) is not null""")
def extract_education(spark: SparkSession, d: str) -> DataFrame:
    """Highest level named in the education section, else in the whole text."""
    return extract.education(texts(spark, d, "docs"), "doc_no", "markdown")


@query(f"""with {_LINES}, {_META}, f as (select doc_no, arg_min(entry, line_no) as title from meta where kind = 'experience' and coalesce(entry, '') <> '' group by 1), hd as (select doc_no, text from s where role = 'headline')
    select doc_no, coalesce(f.title, hd.text) as title from f full join hd using (doc_no)""")
def extract_current_title(spark: SparkSession, d: str) -> DataFrame:
    """Title of the first job with a line about it, else the headline."""
    return extract.current_title(extract.parsed_lines(texts(spark, d, "docs"), "doc_no", "markdown"), "doc_no")


@query(r"""select token, count(*) as n, count(distinct doc_no) as docs from (select doc_no, unnest(regexp_extract_all(lower(markdown), '[a-z0-9][a-z0-9+#./&''-]*[a-z0-9+#]|[a-z0-9]')) as token from docs) group by 1""")
def extract_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of tokens, with names such as c++ or ci/cd kept whole."""
    t = texts(spark, d, "docs").select("doc_no", F.explode(T.tokens(F.col("markdown"))).alias("token")).groupBy("token", "doc_no").agg(F.count("*").alias("k"))
    return t.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


@query("""with f as (select term_id, kind, slug, lower(unnest(list_prepend(canonical, aliases))) as form from terms) select form, count(distinct slug) as terms from f where kind <> 'title' group by 1 having count(distinct slug) > 1
    union all select 'missing: ' || i, count(*) from (select unnest(implies) as i from terms) where i not in (select slug from terms) group by 1""")
def vocab_problems(spark: SparkSession, d: str) -> DataFrame:
    """Forms that belong to several terms, and implied terms that don't exist."""
    return extract.vocabulary_problems(table(spark, d, "terms"))


@query("""with recursive c as (select slug, unnest(implies) as implied, 1 as depth from terms union all select c.slug, unnest(t.implies), depth + 1 from c join terms t on t.slug = c.implied where depth < 5)
    select slug, implied, min(depth)::int as depth from c where implied is not null group by 1, 2""")
def vocab_closure(spark: SparkSession, d: str) -> DataFrame:
    """All implied terms, over any number of steps up to five."""
    return extract.closure(table(spark, d, "terms"))


@query("""with recursive c as (select slug, unnest(implies) as implied, 1 as depth from terms union all select c.slug, unnest(t.implies), depth + 1 from c join terms t on t.slug = c.implied where depth < 5),
    k as (select distinct x.term_id as a, y.term_id as b from c join terms x on x.slug = c.slug join terms y on y.slug = c.implied),
    e as (select doc_no, term_id, level from doc_terms where term_id is not null union all select doc_no, k.b, level from doc_terms join k on k.a = term_id)
    select doc_no, term_id, max(case level when 'led' then 3 when 'used' then 2 when 'listed' then 1 else 0 end)::int as level_rank from e group by 1, 2""")
def terms_with_implied(spark: SparkSession, d: str) -> DataFrame:
    """Best level of each term of a document, implied terms included."""
    terms = table(spark, d, "terms")
    k = extract.closure(terms).join(terms.select("slug", F.col("term_id").alias("a")), "slug").join(terms.select(F.col("slug").alias("implied"), F.col("term_id").alias("b")), "implied").select("a", "b").distinct()
    dt = table(spark, d, "doc_terms").where("term_id is not null").select("doc_no", "term_id", "level")
    return extract.best_level(dt.union(dt.join(k, F.col("a") == F.col("term_id")).select("doc_no", F.col("b"), "level")))


@query("""select evidence as name, count(distinct doc_no) as docs from doc_terms where term_id is null and evidence is not null group by 1""")
def unresolved_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_terms").where("term_id is null and evidence is not null").groupBy(F.col("evidence").alias("name")).agg(F.count_distinct("doc_no").alias("docs"))


@query(r"""with e as (select distinct doc_no, term_id, evidence from doc_terms where evidence is not null) select count(*) as claims, count(*) filter (where instr(lower(trim(regexp_replace(markdown, '\s+', ' ', 'g'))), lower(trim(regexp_replace(evidence, '\s+', ' ', 'g')))) > 0) as verbatim from e join docs using (doc_no)""")
def evidence_check(spark: SparkSession, d: str) -> DataFrame:
    """How many pieces of evidence stand word for word in their document."""
    e = table(spark, d, "doc_terms").where("evidence is not null").select("doc_no", "term_id", "evidence").distinct().join(table(spark, d, "docs").select("doc_no", "markdown"), "doc_no")
    hit = F.contains(F.lower(T.collapse(F.col("markdown"))), F.lower(T.collapse(F.col("evidence"))))
    return e.agg(F.count("*").alias("claims"), F.count_if(hit).alias("verbatim"))


@query("""with p as (select doc_no, max(current_title) as current_title, max(headline) as headline, max(did) as did, max(did_source) as did_source from profile group by 1) select doc_no, coalesce(current_title, headline) as title, case when current_title is not null then 'rules' when headline is not null then 'headline' else 'none' end as title_from, coalesce(did_source, case when did is not null then 'unknown' end) as did_from from p""")
def field_precedence(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "profile").groupBy("doc_no").agg(*[F.max(c).alias(c) for c in ("current_title", "headline", "did", "did_source")])
    return p.select("doc_no", F.coalesce("current_title", "headline").alias("title"), F.when(F.col("current_title").isNotNull(), "rules").when(F.col("headline").isNotNull(), "headline").otherwise("none").alias("title_from"), F.coalesce("did_source", F.when(F.col("did").isNotNull(), "unknown")).alias("did_from"))


@query(r"""with w as (select doc_no, regexp_extract_all(lower(markdown), '[a-z0-9]+') as ws from docs) select doc_no, count(distinct list_aggregate(ws[i:i + 2], 'string_agg', ' ')) as shingles from w, unnest(range(1, len(ws) - 1)) as r(i) group by 1""")
def shingle_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of distinct runs of three words."""
    w = texts(spark, d, "docs").select("doc_no", T.words(F.col("markdown")).alias("ws")).where("size(ws) >= 3")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ws") - 2), lambda i: F.array_join(F.slice("ws", i, F.lit(3)), " ")))
    return w.select("doc_no", F.size(grams).cast("bigint").alias("shingles"))




@query("""with recursive g as (select doc_no as n, lag(doc_no) over (partition by dup_group order by doc_no) as p from docs where dup_group is not null), h as (select doc_no as n, min(doc_no) over (partition by hash) as p from docs where hash is not null),
    e as (select distinct n as a, p as b from g where p is not null union select n, p from h where p <> n), e2 as (select a, b from e union select b, a from e), r as (select a as node, a as root from e2 union select e2.b, r.root from r join e2 on e2.a = r.node)
    select node, min(root)::int as root from r group by 1""")
def dup_components(spark: SparkSession, d: str) -> DataFrame:
    """Groups of documents linked by an old group or by equal content, each named by its smallest number. A group or a
    content links its members to its smallest one, so it makes as many links as it has members."""
    docs = table(spark, d, "docs")
    parts = []
    for key in ("dup_group", "hash"):
        rows = docs.where(F.col(key).isNotNull()).select("doc_no", key)
        parts.append(rows.join(rows.groupBy(key).agg(F.min("doc_no").alias("b")), key).select(F.col("doc_no").alias("a"), "b"))
    return components.union_find(parts[0].union(parts[1]))


@query(r"""with f as (select dup_group, min(doc_no) as first_no from docs where dup_group is not null group by 1), p as (select first_no, doc_no from docs join f using (dup_group) where doc_no <> first_no),
    s as (select doc_no, list_distinct(list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as g from (select doc_no, regexp_extract_all(lower(markdown), '[a-z0-9]+') as ws from docs))
    select p.first_no, p.doc_no, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g)))::double, 6) as jaccard from p join s a on a.doc_no = p.first_no join s b on b.doc_no = p.doc_no where len(a.g) + len(b.g) > 0""")
def version_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard similarity of each version to the first of its group, on runs of three words."""
    docs = table(spark, d, "docs")
    grouped = docs.where("dup_group is not null").select("doc_no", "dup_group")
    pairs = grouped.join(grouped.groupBy("dup_group").agg(F.min("doc_no").alias("first_no")), "dup_group").where("doc_no <> first_no").select("first_no", "doc_no")
    ws = docs.join(grouped.select("doc_no"), "doc_no", "left_semi").select("doc_no", T.words(F.col("markdown")).alias("ws")).where("size(ws) >= 3")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("ws") - 2), lambda i: F.xxhash64(F.array_join(F.slice("ws", i, F.lit(3)), " "))))
    s = ws.select("doc_no", grams.alias("g"))
    both = pairs.join(s, "doc_no").withColumnRenamed("g", "y").join(s.select(F.col("doc_no").alias("first_no"), F.col("g").alias("x")), "first_no")
    return both.select("first_no", "doc_no", F.round(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")), 6).alias("jaccard"))
