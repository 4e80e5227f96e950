"""Sessions, judgments, usage: stateful operators on the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import without_repeats
from ..operators import sessions as S
from ..runtime import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with s as (select o_orderkey as doc_no, o_totalprice / 1000.0 - 50 as score, repeat(o_orderpriority, 12) as note from orders) select s.doc_no, round_even(greatest(0.0, least(100.0, score)), 0)::int as score,
    case when length(note) > 120 then substr(note, 1, 119) || '…' else note end as note, case when c.c_custkey is null then 'unknown' end as problem from s left join customer c on c.c_custkey = s.doc_no""")
def scores_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Clamped and rounded scores with their problems; orders stand for scores, customers for known items."""
    s = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_no"), (F.col("o_totalprice") / 1000 - 50).alias("score"), F.repeat("o_orderpriority", F.lit(12)).alias("note"))
    return S.clean_scores(s, table(spark, d, "customer").select(F.col("c_custkey").alias("doc_no")))


@query("""with a as (select doc_no, max(years) as score from profile group by 1), b as (select doc_no, max(rate) as score from profile group by 1) select coalesce(a.doc_no, b.doc_no) as doc_no, coalesce(a.score, b.score) as score from a full join b on a.doc_no = b.doc_no""")
def scores_merged(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "profile")
    return S.merged_scores(p.groupBy("doc_no").agg(F.max("years").alias("score")), p.groupBy("doc_no").agg(F.max("rate").alias("score")))


@query("""select source, count(*) as n, count(words) as scored, median(words) as middle, max(words)::int as best, arg_min(doc_no, (-words::bigint) * 10000000000 + doc_no)::int as best_doc from docs group by 1""")
def judgment_list(spark: SparkSession, d: str) -> DataFrame:
    """Count, scored, median and best (smallest number on a tie) of each group."""
    best = F.max(F.when(F.col("words").isNotNull(), F.struct("words", (-F.col("doc_no")).alias("k"))))
    g = table(spark, d, "docs").groupBy("source").agg(F.count("*").alias("n"), F.count("words").alias("scored"), F.percentile("words", 0.5).alias("middle"), best.alias("b"))
    return g.select("source", "n", "scored", "middle", F.col("b.words").alias("best"), (-F.col("b.k")).alias("best_doc"))


@query("""with r as (select source, doc_no, words, row_number() over (partition by source order by words desc, doc_no) as hi, row_number() over (partition by source order by words, doc_no) as lo from docs where words is not null) select source, doc_no, words, case when hi <= 3 then 'high' else 'low' end as side from r where hi <= 3 or lo <= 3""")
def anchors(spark: SparkSession, d: str) -> DataFrame:
    """The three highest and three lowest of each group; only group limits are shuffled."""
    base = table(spark, d, "docs").where("words is not null").select("source", "doc_no", "words")
    pick = lambda order, side: base.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(order, "doc_no"))).where("k <= 3").select("source", "doc_no", "words", F.lit(side).alias("side"))
    high, low = pick(F.col("words").desc(), "high"), pick(F.col("words"), "low")
    return high.union(low.join(high.select("doc_no"), "doc_no", "left_anti").select("source", "doc_no", "words", "side"))


@query("""with recursive e as (select s_suppkey as id, case when s_suppkey % 7 = 1 then null else s_suppkey - 1 end as parent from supplier), w as (select id as node, id as up, 0 as depth from e where parent is null union all select e.id, w.up, w.depth + 1 from w join e on e.parent = w.node) select node, up as root, depth::int as depth from w""")
def lineage_roots(spark: SparkSession, d: str) -> DataFrame:
    """First ancestor and depth of each step; suppliers stand for steps."""
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 != 1, F.col("s_suppkey") - 1).alias("parent"))
    return S.lineage(e)


@query("""select event_id, count(*) over d as day, round(sum(value) over d, 4) as day_cost, count(*) over m as month, round(sum(value) over m, 4) as month_cost from events window d as (partition by user_id order by epoch(ts)::bigint range between 86400 preceding and current row), m as (partition by user_id order by epoch(ts)::bigint range between 2592000 preceding and current row)""")
def usage_day(spark: SparkSession, d: str) -> DataFrame:
    """Count and cost of each user over the 24 hours and the 30 days up to each event."""
    day = S.trailing(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), "user_id", "ts", 86_400, F.col("value"), "day", "day_cost")
    both = S.trailing(day, "user_id", "ts", 2_592_000, F.col("value"), "month", "month_cost")
    return both.select("event_id", "day", F.round("day_cost", 4).alias("day_cost"), "month", F.round("month_cost", 4).alias("month_cost"))


@query("""with f as (select user_id, ts, count(*) over (partition by user_id order by epoch(ts)::bigint range between 43200 preceding and current row) as n from events where event_type = 'error') select distinct user_id, ts, ts + interval 43200 seconds as until from f where n >= 2""")
def lockouts(spark: SparkSession, d: str) -> DataFrame:
    """Two failures in twelve hours lock a user out until the second is as old."""
    return S.lockouts(table(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", 43_200, 2)


@query("""with r as (select user_id, ts, row_number() over (partition by user_id order by ts desc) as rn from events), f as (select user_id, count(*) as n, min(ts) as oldest, max(ts) as newest from r where rn <= 3 group by 1) select user_id, oldest + interval 43200 seconds as at from f where n = 3 and oldest + interval 43200 seconds > newest""")
def limit_reopens(spark: SparkSession, d: str) -> DataFrame:
    return S.reopens(table(spark, d, "events"), "user_id", "ts", 43_200, 3)


@query("""with c as (select user_id, event_type, count(*) over (partition by user_id, event_type order by epoch(ts)::bigint range between 3600 preceding and current row) as k from events) select user_id, event_type, count(*) as over_limit from c where k >= 2 group by 1, 2""")
def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """Events at or over a limit of two an hour, by user and kind."""
    e = table(spark, d, "events").select(F.struct("user_id", "event_type").alias("key"), "ts")
    return S.trailing(e, "key", "ts", 3600, F.lit(1)).where("recent >= 2").groupBy("key.user_id", "key.event_type").agg(F.count("*").alias("over_limit"))


@query("""with t as (select doc_no, c.idx as idx, greatest(1, length(c.text) // 4) as size from (select doc_no, unnest(chunks) as c from build_docs)), u as (select *, sum(size) over (partition by doc_no order by idx desc rows unbounded preceding) as upto from t) select doc_no, idx, upto::bigint as upto from u where upto <= 200""")
def history_budget(spark: SparkSession, d: str) -> DataFrame:
    """The last parts of a history that fit a token budget; chunks stand for turns."""
    t = table(spark, d, "build_docs").select("doc_no", F.explode("chunks").alias("c")).select("doc_no", "c.idx", F.greatest(F.lit(1), F.floor(F.length("c.text") / 4)).cast("bigint").alias("size"))
    return S.within_budget(t, "doc_no", "idx", "size", 200).select("doc_no", "idx", "upto")


@query("""with r as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null) select event_type, max(case when i = round_even(0.5 * (n - 1), 0) then value end) as p50, max(case when i = round_even(0.95 * (n - 1), 0) then value end) as p95, max(value) as longest from r group by 1""")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of each kind."""
    return S.nearest_rank(table(spark, d, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "longest": 1.0})


@query("""with t as (select doc_id, lang, source, coalesce(lower(lang), '?') as l from documents) select l as lang, count(*) as pages, count(distinct source) as sources, count(*) filter (where lang is null) as unknown from t group by 1""")
def corpus_languages(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("lang", "source", F.coalesce(F.lower("lang"), F.lit("?")).alias("l"))
    return t.groupBy(F.col("l").alias("lang")).agg(F.count("*").alias("pages"), F.count_distinct("source").alias("sources"), F.count_if(F.col("lang").isNull()).alias("unknown"))


@query(r"""with l as (select distinct lower(source) as name from mix_targets union select unnest(['tallyboard.example', 'test'])), h as (select distinct regexp_extract(url, '^https?://([^/]+)', 1) as host from documents where url is not null), s as (select host, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) as suffix from h)
    select host, bool_or(l.name is not null) as listed from s left join l on l.name = suffix group by 1""")
def domain_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """Hosts for which the host or a parent domain is in a list: suffixes and list meet in a join, whatever their number."""
    listed = table(spark, d, "mix_targets").select(F.lower("source").alias("suffix")).union(spark.createDataFrame([("tallyboard.example",), ("test",)], "suffix string")).distinct().withColumn("hit", F.lit(True))
    h = table(spark, d, "documents").where("url is not null").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host")).distinct()
    parts = F.split("host", r"\.")
    s = h.select("host", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("suffix"))
    return s.join(listed, "suffix", "left").groupBy("host").agg(F.max(F.coalesce("hit", F.lit(False))).alias("listed"))


@query(r"""with l as (select doc_no, i, ls[i] as line from (select doc_no, string_split(replace(markdown, chr(13), ''), chr(10)) as ls from docs where markdown is not null), unnest(range(1, len(ls) + 1)) as r(i)), p as (select *, case when trim(line) <> '' then max(case when trim(line) <> '' then i end) over (partition by doc_no order by i rows between unbounded preceding and 1 preceding) end as b from l),
    q as (select p.doc_no, p.i, p.line, coalesce(p.line = x.line, false) as again from p left join l x on x.doc_no = p.doc_no and x.i = p.b) select doc_no, coalesce(string_agg(line, chr(10) order by i) filter (where not again), '') as text, count(*) filter (where again) as dropped from q group by 1""")
def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Texts without lines equal to the last one with content before them."""
    return without_repeats(table(spark, d, "docs").where("markdown is not null").select("doc_no", F.col("markdown").alias("text")), "text")


@query(r"""select doc_no, length(markdown) >= 400 and len(list_filter(string_split(replace(markdown, chr(13), ''), chr(10)), lambda x: trim(x) <> '')) >= 5 as is_query, substr(trim(regexp_replace(list_filter(string_split(replace(markdown, chr(13), ''), chr(10)), lambda x: length(trim(x)) >= 3)[1], '^#+ *', '')), 1, 40) as title from docs""")
def query_titles(spark: SparkSession, d: str) -> DataFrame:
    """Whether a text is a query document, and its title."""
    ls = F.split(F.replace(F.col("markdown"), F.lit("\r"), F.lit("")), "\n")
    first = F.try_element_at(F.filter(ls, lambda x: F.length(F.trim(x)) >= 3), F.lit(1))
    long_ = (F.length("markdown") >= 400) & (F.size(F.filter(ls, lambda x: F.trim(x) != "")) >= 5)
    return table(spark, d, "docs").select("doc_no", long_.alias("is_query"), F.substring(F.trim(F.regexp_replace(first, "^#+ *", "")), 1, 40).alias("title"))


@query("""with recursive l as (select c_custkey as a, min(c_custkey) over (partition by c_nationkey, c_custkey % 97) as b from customer), e as (select a, b from l where a <> b union select b, a from l where a <> b), g as (select a as node, a as root from e union select e.b, g.root from g join e on e.a = g.node), m as (select node, min(root) as leader from g group by 1),
    c as (select coalesce(m.leader, c_custkey) as leader, c_acctbal from customer left join m on node = c_custkey) select leader, count(*) as people, round(sum(c_acctbal), 2) as allowance from c group by 1""")
def shared_allowance(spark: SparkSession, d: str) -> DataFrame:
    """Users linked by a shared number, over any number of links, form a group led by the smallest, with one allowance."""
    c = table(spark, d, "customer")
    number = c.select("c_custkey", F.col("c_nationkey").alias("x"), (F.col("c_custkey") % 97).alias("y"))
    links = number.join(number.groupBy("x", "y").agg(F.min("c_custkey").alias("b")), ["x", "y"]).select(F.col("c_custkey").alias("a"), "b")
    return S.shared(c.select(F.col("c_custkey").alias("user"), F.col("c_acctbal").alias("value")), links).select("leader", "people", F.round("total", 2).alias("allowance"))


@query("""with recursive e as (select s_suppkey as id, case when s_suppkey % 7 = 1 then null else s_suppkey - 1 end as parent from supplier), w as (select id as node, id as up from e union all select w.node, e.parent from w join e on e.id = w.up where e.parent is not null),
    j as (select o_custkey as step, o_orderkey as judgment_id, o_orderdate as at from orders where lower(o_orderpriority) = '1-urgent'), b as (select node, max({'t': j.at, 'id': judgment_id}) as m from w join j on j.step = w.up group by 1) select node, m.id as judgment_id, m.t as at from b""")
def newest_judgment(spark: SparkSession, d: str) -> DataFrame:
    """The newest judgment by a criterion on each step or the steps before it; suppliers stand for steps, orders for judgments."""
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 7 != 1, F.col("s_suppkey") - 1).alias("parent"))
    j = table(spark, d, "orders").select(F.col("o_custkey").alias("step"), F.col("o_orderkey").alias("judgment_id"), F.col("o_orderpriority").alias("criterion"), F.col("o_orderdate").alias("at"))
    return S.newest_on_lineage(e, j, " 1-Urgent ")


@query("""with m as (select distinct doc_no from doc_terms where term_id = 25), j as (select source, doc_no, words from docs) select source, count(*) as judged, count(m.doc_no) as covered, count(*) filter (where m.doc_no is not null and words is not null) as scored from j left join m using (doc_no) group by 1""")
def rankings_list(spark: SparkSession, d: str) -> DataFrame:
    """Every judgment with the number of its rows that the present set holds; sources stand for judgments."""
    m = table(spark, d, "doc_terms").where("term_id = 25").select("doc_no").distinct().withColumn("in", F.lit(True))
    j = table(spark, d, "docs").select("source", "doc_no", "words").join(m, "doc_no", "left")
    return j.groupBy("source").agg(F.count("*").alias("judged"), F.count("in").alias("covered"), F.count_if(F.col("in") & F.col("words").isNotNull()).alias("scored"))


@query("""with e as (select event_type, case when event_id % 10 = 3 then substr(props, 1, 4) else props end as t from events), p as (select event_type, try_cast(t as json) as j from e) select event_type, count(*) as n, count(*) filter (where j is null) as broken, sum((j->>'k')::bigint)::bigint as total from p group by 1""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Fields of JSON texts of which some are cut short: broken ones are counted and give no value."""
    t = F.when(F.col("event_id") % 10 == 3, F.substring("props", 1, 4)).otherwise(F.col("props"))
    p = table(spark, d, "events").select("event_type", F.try_parse_json(t).alias("j"))
    return p.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("j").isNull()).alias("broken"), F.sum(F.try_variant_get("j", "$.k", "bigint")).alias("total"))


@query("""select user_id, row_number() over w as step, event_id, round(value - lag(value) over w, 6) as delta from events window w as (partition by user_id order by ts, event_id)""")
def step_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Change from step to step of every session."""
    s = S.deltas(table(spark, d, "events"), "user_id", "ts", "event_id", "value")
    return s.select("user_id", "step", "event_id", F.round("delta", 6).alias("delta"))


@query("""select c_mktsegment, n_name, count(*) as orders, round(sum(o_totalprice), 2) as total from orders join customer on c_custkey = o_custkey join nation on n_nationkey = c_nationkey where o_orderdate >= timestamp '1995-01-01' group by 1, 2""")
def star_join(spark: SparkSession, d: str) -> DataFrame:
    """Equi joins along a star with a pushed-down filter."""
    o = table(spark, d, "orders").where(F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00"))).groupBy("o_custkey").agg(F.count("*").alias("k"), F.sum("o_totalprice").alias("t"))
    j = o.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("c_mktsegment", "n_name").agg(F.sum("k").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("""select time_bucket(interval '1 hour', ts) as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def hourly_usage(spark: SparkSession, d: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")
