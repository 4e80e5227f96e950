"""Filters, set algebra, facets, ranking: answering a search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import like, narrow, ranking, scan, sets
from ..runtime import table
from . import prepared
from .index import AVAILABILITY_SQL, POSTINGS_SQL

QUERIES: dict = {}
SQL: dict = {}
TERMS = (25, 44, 119)
#: Places of the labels of availability.
AVAILABILITY_PLACES = {"now": 0, "1w": 1, "2w": 2, "1m": 3, "3m": 4}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return prepared.profile(spark, d)


_P = "p as (select doc_no, max(current_title) as current_title, max(headline) as headline, max(seniority) as seniority, max(years) as years, max(rate) as rate, max(location) as location, bool_or(remote) as remote, max(availability) as availability from profile group by 1)"


@query(f"with {_P} select doc_no from p where lower(seniority) in ('senior', 'lead')")
def filter_seniority(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d).where(F.lower("seniority").isin("senior", "lead")).select("doc_no")


@query(f"with {_P} select doc_no from p where regexp_matches(lower(location), '(^|[^a-z0-9])(leipzig|spain)([^a-z0-9]|$)')")
def filter_place(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d).where(F.lower("location").rlike(T.place_pattern(["Leipzig", " spain ", "Leipzig"]))).select("doc_no")


@query(f"with {_P} select doc_no, case when remote then 'remote' when remote is null then 'unknown' else 'on site' end as state, not coalesce(remote, false) as not_remote from p")
def filter_remote(spark: SparkSession, d: str) -> DataFrame:
    """Three-valued: unknown is neither remote nor not."""
    r = F.col("remote")
    return _profile(spark, d).select("doc_no", F.when(r, "remote").when(r.isNull(), "unknown").otherwise("on site").alias("state"), (~F.coalesce(r, F.lit(False))).alias("not_remote"))


@query(f"with {_P} select doc_no, years >= 5 and rate <= 100 as pass, years is null and coalesce(rate <= 100, true) as years_unknown, rate is null and coalesce(years >= 5, true) as rate_unknown from p where coalesce(years >= 5, true) and coalesce(rate <= 100, true)")
def filter_range_unknown(spark: SparkSession, d: str) -> DataFrame:
    """Range conditions with the rows that only an unknown value keeps out."""
    y, r = F.col("years") >= 5, F.col("rate") <= 100
    kept = _profile(spark, d).where(F.coalesce(y, F.lit(True)) & F.coalesce(r, F.lit(True)))
    return kept.select("doc_no", (y & r).alias("pass"), (F.col("years").isNull() & F.coalesce(r, F.lit(True))).alias("years_unknown"), (F.col("rate").isNull() & F.coalesce(y, F.lit(True))).alias("rate_unknown"))


@query("""with f as (select 'years' as field, years_source as source, years::double as value from profile union all select 'rate', rate_source, rate from profile)
    select field, count(*) filter (where value is not null and lower(coalesce(source, '')) not like '%synthetic%') as stated, count(*) filter (where value is not null and lower(source) like '%synthetic%') as estimated, count(*) filter (where value is null) as unknown from f group by 1""")
def field_facts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "profile")
    f = p.select(F.lit("years").alias("field"), F.col("years_source").alias("source"), F.col("years").alias("value")).union(p.select(F.lit("rate"), "rate_source", "rate"))
    guess = F.coalesce(F.lower("source").contains("synthetic"), F.lit(False))
    has = F.col("value").isNotNull()
    return f.groupBy("field").agg(F.count_if(has & ~guess).alias("stated"), F.count_if(has & guess).alias("estimated"), F.count_if(~has).alias("unknown"))


#: Members of three terms: strong evidence for skills, weak too for topics.
_M = f"{POSTINGS_SQL}, m as (select doc_no, term_id, person, evidence, bm25, cosine from po where term_id in {TERMS} and (strong or kind = 'topic'))"


def _members(spark: SparkSession, d: str) -> DataFrame:
    p = prepared.postings(spark, d)
    return p.where(F.col("term_id").isin(*TERMS) & (F.col("strong") | (F.col("kind") == "topic"))).select("doc_no", "term_id", "person", "evidence", "bm25", "cosine")


def _need(name: str, need: int, what: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return sets.combined(_members(spark, d), need)

    run.__name__, run.__doc__ = name, what
    QUERIES[name] = run
    SQL[name] = f"with {_M} select doc_no, count(distinct term_id) as coverage from m group by 1 having count(distinct term_id) >= {need}"


_need("sets_all", 3, "Documents in all sets.")
_need("sets_any", 1, "Documents in any set.")
_need("sets_min_cover", 2, "Documents in two of three sets at least.")


@query(f"with {_M}, {_P} select distinct doc_no from m where doc_no in (select doc_no from p where lower(seniority) in ('senior', 'lead')) and doc_no in (select doc_no from p where coalesce(years >= 5, true))")
def sets_filters(spark: SparkSession, d: str) -> DataFrame:
    """Intersection of saved conditions."""
    p = _profile(spark, d)
    return sets.intersected([_members(spark, d).select("doc_no").distinct(), p.where(F.lower("seniority").isin("senior", "lead")), p.where(F.coalesce(F.col("years") >= 5, F.lit(True)))])


_AB = "a as (select doc_no, row_number() over (order by doc_no desc) as pos from (select distinct doc_no from doc_terms where term_id = 25)), b as (select doc_no, row_number() over (order by doc_no) as pos from (select distinct doc_no from doc_terms where term_id = 44))"


def _ab(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dt = table(spark, d, "doc_terms")
    one = lambda t, o: sets.ranked(dt.where(F.col("term_id") == t).select("doc_no").distinct(), [o])
    return one(25, F.col("doc_no").desc()), one(44, F.col("doc_no"))


@query(f"with {_AB}, u as (select doc_no, min((case src when 'a' then 0 else 1 end) * 1000000000 + pos) as k from (select 'a' as src, * from a union all select 'b', * from b) group by 1) select doc_no, row_number() over (order by k) as pos from u")
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    return sets.ordered_union(*_ab(spark, d))


@query(f"with {_AB} select doc_no, row_number() over (order by pos) as pos from a where doc_no not in (select doc_no from b)")
def ordered_minus(spark: SparkSession, d: str) -> DataFrame:
    return sets.ordered_minus(*_ab(spark, d))


@query("select max(doc_no) as doc_no from docs where not coalesce(deleted, false) and dup_group is not null group by dup_group union all select doc_no from docs where not coalesce(deleted, false) and dup_group is null")
def people(spark: SparkSession, d: str) -> DataFrame:
    """The newest live version of each person."""
    return sets.representatives(table(spark, d, "docs"))


@query(f"with {_M}, x as (select distinct doc_no, person from m) select max(doc_no) as doc_no, count(*) as versions from x group by person")
def versions_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """The newest matching version of each person."""
    return sets.collapsed(_members(spark, d).select("doc_no").distinct(), table(spark, d, "docs"))


_F3 = f"{_P}, f as (select doc_no, (lower(seniority) in ('senior', 'lead'))::int as a, (years >= 5)::int as b, (remote)::int as c from p)"


@query(f"with {_F3} select coalesce(sum(a), 0)::bigint as seniority_alone, coalesce(sum(b), 0)::bigint as years_alone, coalesce(sum(c), 0)::bigint as remote_alone, count(*) filter (where b = 1 and c = 1) as without_seniority, count(*) filter (where a = 1 and c = 1) as without_years, count(*) filter (where a = 1 and b = 1) as without_remote, count(*) filter (where a = 1 and b = 1 and c = 1) as together from f")
def filter_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each filter alone, and the result with each left out: conditional counts of one scan."""
    tests = {"seniority": F.coalesce(F.col("level").isin("senior", "lead"), F.lit(False)), "years": F.coalesce(F.col("years") >= 5, F.lit(False)), "remote": F.coalesce("remote", F.lit(False))}
    every = lambda skip=None: reduce(lambda a, b: a & b, [t for n, t in tests.items() if n != skip])
    return _profile(spark, d).agg(*[F.count_if(t).alias(f"{n}_alone") for n, t in tests.items()], *[F.count_if(every(n)).alias(f"without_{n}") for n in tests], F.count_if(every()).alias("together"))


@query(f"""with {_P}, n as (select count(*) filter (where lower(seniority) in ('senior', 'lead') and remote and years >= 60) as n, count(*) filter (where remote and years >= 60) as a, count(*) filter (where lower(seniority) in ('senior', 'lead') and years >= 60) as b, count(*) filter (where lower(seniority) in ('senior', 'lead') and remote) as c from p),
    o as (select unnest([{{'condition': 'seniority', 'n': a}}, {{'condition': 'remote', 'n': b}}, {{'condition': 'years', 'n': c}}], recursive := true) from n where n = 0) select condition, n, condition = 'years' as culprit from o where n > 0 or condition = 'years'""")
def zero_result(spark: SparkSession, d: str) -> DataFrame:
    """Why a result is empty: the condition added last, and what would be found without each."""
    p = _profile(spark, d)
    conditions = {"seniority": F.col("level").isin("senior", "lead"), "remote": F.col("remote"), "years": F.col("years") >= 60}
    return sets.diagnosis(p, conditions)


@query(f"""with {_P}, x as (select {AVAILABILITY_SQL} as label from p where availability is not null), y as (select case when label = 'now' or regexp_matches(label, '^[0-9]+[wmd]$') then label else 'other' end as label, count(*) as n from x where label is not null group by 1)
    select label, n, row_number() over (order by case label when 'now' then 0 when '1w' then 1 when '2w' then 2 when '1m' then 3 when '3m' then 4 else 8 end, label) as pos from y""")
def facet_availability(spark: SparkSession, d: str) -> DataFrame:
    """Availabilities by label in their usual order; what is no notice is 'other'."""
    label = F.when((F.col("label") == "now") | F.col("label").rlike(r"^\d+[wmd]$"), F.col("label")).otherwise("other")
    g = _profile(spark, d).where("label is not null").groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    place = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in AVAILABILITY_PLACES.items() for x in kv]), F.col("label")), F.lit(8))
    return g.withColumn("pos", F.row_number().over(Window.orderBy(place, "label")).cast("bigint"))  # a row for each label


@query("""with p as (select doc_no, max(years) as years, max(rate) as rate, max(rate_source) as rate_source from profile group by 1), q as (select 'years' as field, quantile_cont(years, [0.25, 0.5, 0.75]) as q, min(years) as lo, max(years) as hi, count(*) filter (where years is null) as unknown, 0::bigint as synthetic from p
    union all select 'rate', quantile_cont(rate, [0.25, 0.5, 0.75]), min(rate), max(rate), count(*) filter (where rate is null), count(*) filter (where rate_source = 'synthetic') from p) select field, round_even(q[1], 0) as p25, round_even(q[2], 0) as p50, round_even(q[3], 0) as p75, lo, hi, unknown, synthetic from q""")
def facet_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quartiles of years and rate in whole numbers, with their limits."""
    part = lambda c: F.struct(F.lit(c).alias("field"), F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.count_if(F.col(c).isNull()).alias("unknown"), F.count_if((F.col("rate_source") == "synthetic") if c == "rate" else F.lit(False)).alias("synthetic"))
    a = _profile(spark, d).agg(F.array(part("years"), part("rate")).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return a.select("field", *[F.bround(F.col("q")[i], 0).alias(n) for i, n in enumerate(("p25", "p50", "p75"))], "lo", "hi", "unknown", "synthetic")


_LEVELS = "case lower(trim(seniority)) when 'intern' then 0 when 'junior' then 1 when 'mid' then 2 when 'senior' then 3 when 'lead' then 4 when 'principal' then 5 when 'manager' then 5 when 'director' then 6 when 'executive' then 7 end"


@query(f"with {_P}, g as (select lower(trim(seniority)) as seniority, count(*) as n from p where seniority is not null group by all) select seniority, n, row_number() over (order by coalesce({_LEVELS}, 9), n desc, seniority) as pos from g")
def facet_seniority(spark: SparkSession, d: str) -> DataFrame:
    g = _profile(spark, d).where("level is not null").groupBy(F.col("level").alias("seniority")).agg(F.count("*").alias("n"))
    return g.withColumn("pos", F.row_number().over(Window.orderBy(F.coalesce(ranking.seniority_order(F.col("seniority")), F.lit(9)), F.col("n").desc(), "seniority")).cast("bigint"))  # a row for each level


@query("select canonical, count(distinct doc_no) as n from doc_terms join terms using (term_id) where kind = 'skill' and via <> 'implied' group by 1 order by n desc, canonical limit 8")
def facet_skills(spark: SparkSession, d: str) -> DataFrame:
    """The eight most frequent skills, implied ones aside."""
    dt = table(spark, d, "doc_terms").where("via <> 'implied'").select("term_id", "doc_no").distinct()
    skills = table(spark, d, "terms").where("kind = 'skill'").select("term_id", "canonical")
    return dt.groupBy("term_id").agg(F.count("*").alias("k")).join(skills, "term_id").groupBy("canonical").agg(F.sum("k").alias("n")).orderBy(F.col("n").desc(), "canonical").limit(8)


@query(f"""with {_P}, x as (select unnest([{{'part': 'city', 'place': trim(split_part(location, ',', 1))}}, {{'part': 'country', 'place': trim(split_part(location, ',', -1))}}], recursive := true) from p where location is not null), g as (select part, place, count(*) as n from x group by 1, 2),
    r as (select *, row_number() over (partition by part order by n desc, place) as pos from g) select part, place, n, pos from r where pos <= case part when 'city' then 5 else 40 end and (part = 'city' or place <> '')""")
def facet_places(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent places and forty most frequent countries."""
    both = F.array(F.struct(F.lit("city").alias("part"), F.col("city").alias("place")), F.struct(F.lit("country").alias("part"), F.col("country").alias("place")))
    g = _profile(spark, d).where("location is not null").select(F.explode(both).alias("x")).groupBy("x.part", "x.place").agg(F.count("*").alias("n"))
    r = g.withColumn("pos", F.row_number().over(Window.partitionBy("part").orderBy(F.col("n").desc(), "place")).cast("bigint"))
    return r.where(F.col("pos") <= F.when(F.col("part") == "city", 5).otherwise(40)).where("part = 'city' or place <> ''")


_NARROW = f"""base as (select distinct doc_no, person from m where term_id = {TERMS[0]}), tot as (select count(distinct person) as total from base),
    pp as (select base.person, base.doc_no, p.* exclude (doc_no), {AVAILABILITY_SQL} as label from base join p using (doc_no)),
    cs as (select t.slug, dt.term_id, count(*) as c from doc_terms dt join terms t using (term_id) join base using (doc_no) where t.kind = 'skill' and dt.term_id <> {TERMS[0]} group by 1, 2 order by c desc, 1 limit 80),
    sk as (select 'skill' as grp, cs.slug as value, count(distinct base.person) as n, 0::bigint as ord from cs join po on po.term_id = cs.term_id and po.strong join base using (doc_no) group by 2),
    se as (select 'seniority' as grp, lower(trim(seniority)) as value, count(distinct person) as n, coalesce({_LEVELS}, 9)::bigint as ord from pp where seniority is not null group by all),
    ci as (select trim(split_part(location, ',', 1)) as city, count(*) as c from pp where location is not null and trim(split_part(location, ',', 1)) <> '' group by 1 order by c desc, 1 limit 12),
    wh as (select 'where' as grp, city as value, count(distinct person) as n, 0::bigint as ord from ci join pp on regexp_matches(lower(location), '(^|[^a-z0-9])' || lower(city) || '([^a-z0-9]|$)') group by 2),
    re as (select 'remote' as grp, null as value, count(distinct person) as n, 0::bigint as ord from pp where remote having count(*) > 0),
    av as (select 'avail' as grp, label as value, count(distinct person) as n, (case label when 'now' then 0 when '1w' then 1 when '2w' then 2 when '1m' then 3 when '3m' then 4 end)::bigint as ord from pp where label in ('now', '1w', '2w', '1m', '3m') group by 2, 4),
    un as (select * from sk union all select * from se union all select * from wh union all select * from re union all select * from av),
    ok as (select un.* from un, tot where n between 2 and least(1000, total - 1)),
    pl as (select grp, value, n, row_number() over (partition by grp order by case when grp = 'avail' then ord else -n end, case when grp = 'avail' then -n else ord end, value) as pos from ok),
    rp as (select person, ceil(min(rate)) as lo from pp where rate is not null group by 1), rt as (select distinct floor(rate) as t from pp where rate is not null), rn as (select t, (select count(*) from rp where lo <= t) as n from rt),
    yp as (select person, floor(max(years)) as hi from pp where years is not null group by 1), yt as (select distinct ceil(years) as t from pp where years is not null), yn as (select t, (select count(*) from yp where hi >= t) as n from yt),
    th as (select 'rate' as grp, max(t)::bigint::varchar as value, arg_max(n, t) as n from rn, tot where n between 2 and least(1000, total - 1) having count(*) > 0 union all select 'years', min(t)::bigint::varchar, arg_min(n, t) from yn, tot where n between 2 and least(1000, total - 1) having count(*) > 0)"""


@query(f"with {_M}, {_P}, {_NARROW} select grp, value, n, pos from pl where pos <= case grp when 'skill' then 4 when 'seniority' then 3 when 'where' then 3 when 'avail' then 2 else 1 end union all select grp, value, n, 1 from th")
def narrowing(spark: SparkSession, d: str) -> DataFrame:
    """What would narrow a result, by the number of people left: skills, levels, places, remote, availability, rate, years."""
    return narrow.suggestions(_members(spark, d).where(F.col("term_id") == TERMS[0]).select("doc_no", "person").distinct(), _profile(spark, d), prepared.postings(spark, d), table(spark, d, "doc_terms"), table(spark, d, "terms"), taken=[TERMS[0]], limit=1000)


@query(f"with {_M}, {_P}, {_NARROW} select grp, value, n from th")
def threshold_suggestion(spark: SparkSession, d: str) -> DataFrame:
    """The largest limit of rate and the smallest floor of years that leave few enough people."""
    base = _members(spark, d).where(F.col("term_id") == TERMS[0]).select("doc_no", "person").distinct()
    return narrow.thresholds(base.join(_profile(spark, d).drop("person"), "doc_no"), base.select("person").distinct().count(), 1000)


_SCORED = f"""with {_M}, s as (select doc_no, max(evidence) as evidence, max(bm25) as bm25, max(cosine) as cosine, count(distinct term_id) as coverage from m group by 1),
    r as (select *, rank() over (order by evidence desc) as r1, rank() over (order by round(bm25, 9) desc) as r2, rank() over (order by round(cosine, 9) desc) as r3 from s)"""


@query(f"{_SCORED} select doc_no, r1, r2, r3 from r")
def competition_ranks(spark: SparkSession, d: str) -> DataFrame:
    """1, 2, 2, 4 ranks of the three lists of scores; documents without a value share the last."""
    return _ranks(spark, d)[0].select("doc_no", "r1", "r2", "r3")


def _ranks(spark: SparkSession, d: str) -> tuple[DataFrame, int | None]:
    s = _members(spark, d).groupBy("doc_no").agg(F.max("evidence").alias("evidence"), F.round(F.max("bm25"), 9).alias("bm25"), F.round(F.max("cosine"), 9).alias("cosine"), F.count_distinct("term_id").alias("coverage"))
    return ranking.competition_ranks(s, {"evidence": "r1", "bm25": "r2", "cosine": "r3"})


_FUSED = " + ".join(f"1.0::double / (60 + r{i})" for i in (1, 2, 3))


@query(f"{_SCORED} select doc_no, coverage, round({_FUSED}, 9) as fused, row_number() over (order by coverage desc, round({_FUSED}, 12) desc, doc_no) as pos from r")
def flagship_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents of any of three terms, ordered by coverage, fused ranks of evidence, full text and vectors, and number."""
    ranks, rows = _ranks(spark, d)
    f = ranks.withColumn("f", F.round(ranking.fused([F.col("r1"), F.col("r2"), F.col("r3")]), 12))
    return sets.ranked(f, [F.col("coverage").desc(), F.col("f").desc(), F.col("doc_no")], rows=rows).select("doc_no", "coverage", F.round("f", 9).alias("fused"), "pos")


@query(f"with {_P}, o as (select doc_no, row_number() over (order by rate asc nulls last, years desc nulls last, {_LEVELS} desc nulls last, doc_no) as pos from p) select doc_no, pos from o where pos > 20 and pos <= 30")
def sorted_page(spark: SparkSession, d: str) -> DataFrame:
    """Third page of ten by several keys, nulls last in either direction."""
    order = [F.col("rate").asc_nulls_last(), F.col("years").desc_nulls_last(), ranking.seniority_order(F.col("seniority")).desc_nulls_last(), F.col("doc_no")]
    return ranking.top_page(_profile(spark, d).select("doc_no", "rate", "years", "seniority"), order, 3).select("doc_no", "pos")


@query(f"with {_P}, o as (select doc_no, row_number() over (order by years desc nulls last, doc_no) as pos from p) select doc_no, lag(doc_no) over (order by pos) as prev, lead(doc_no) over (order by pos) as next from o")
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The documents before and after each in an order; joined by position, no window over all rows."""
    o = sets.ranked(_profile(spark, d).select("doc_no", "years"), [F.col("years").desc_nulls_last(), F.col("doc_no")]).select("doc_no", "pos")
    at = lambda n, shift: o.select(F.col("doc_no").alias(n), (F.col("pos") + shift).alias("pos"))
    return o.join(at("prev", 1), "pos", "left").join(at("next", -1), "pos", "left").select("doc_no", "prev", "next")




#: Lines of a query document with the terms that each names.
LINES = ((0, 25), (0, 44), (1, 119), (2, 60), (2, 61), (3, 3))


@query(f"""with {POSTINGS_SQL}, l(line, term_id) as (values {", ".join(map(str, LINES))}), w as (select line, doc_no, max(case when used then 1.0 when strong then 0.8 when kind = 'topic' then 0.5 end)::double as weight from po join l using (term_id) where strong or kind = 'topic' group by 1, 2)
    select doc_no, count(*) as covered, round(sum(weight) / 4, 6) as cover from w group by 1 having count(*) / 4.0 >= 0.4""")
def query_document(spark: SparkSession, d: str) -> DataFrame:
    """Documents that cover enough lines of a query document, with the mean weight of their evidence."""
    lines = spark.createDataFrame(LINES, "line int, term_id bigint")
    return like.covered(prepared.postings(spark, d), lines, 0.4).withColumn("cover", F.round("cover", 6))


@query(r"""with l as (select doc_no, i::bigint as line_no, trim(ls[i]) as raw from (select doc_no, string_split(replace(markdown, chr(13), ''), chr(10)) as ls from docs where markdown is not null), unnest(range(1, len(ls) + 1)) as r(i)), t as (select doc_no, line_no, trim(regexp_replace(raw, '^([-*•]|[0-9]+[.)]) +', ''), ' .;') as requirement from l where raw <> '' and not starts_with(raw, '#') and not starts_with(raw, '---')),
    k as (select *, row_number() over (partition by doc_no order by line_no) as n from t where requirement <> '' and not ends_with(requirement, ':')) select doc_no, line_no, requirement from k where n <= 40""")
def requirement_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first forty lines of each query document without bullets, headings and captions."""
    return like.requirements(table(spark, d, "docs"), "doc_no", "markdown")


@query("""with t as (select slug, lower(canonical) as n from terms), p as (select a.slug, b.slug as near, levenshtein(a.n, b.n) as edits, length(a.n) as x, length(b.n) as y from t a join t b on a.slug < b.slug) select slug, near, edits::int as edits, round(1 - edits / greatest(x, y)::double, 6) as alike from p where 1 - edits / greatest(x, y)::double >= 0.7""")
def near_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of the vocabulary that slips could turn into each other: seven of ten characters alike or more. Pairs meet by a
    segment that so few edits must leave whole, so no name is compared with all of its length."""
    return scan.near_names(table(spark, d, "terms").select("slug", F.lower("canonical").alias("n")), "slug", "n", 0.7)
