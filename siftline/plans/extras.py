"""Further operators: lookups, dictionary scan, merges, labels, lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import extract, scan, vocab
from ..operators import sessions as S
from ..operators.extract import level_rank
from ..runtime import table, texts
from .corpus import _LINES
from . import prepared
from .index import AVAILABILITY_SQL, POSTINGS_SQL

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("select id, doc_no, words from docs where id in ('livedesk-0000001', 'inbox-0000002', 'none') or doc_no in (5, 8)")
def lookup_points(spark: SparkSession, d: str) -> DataFrame:
    """Documents by name or number; the list is pushed into the scan."""
    return table(spark, d, "docs").where(F.col("id").isin("livedesk-0000001", "inbox-0000002", "none") | F.col("doc_no").isin(5, 8)).select("id", "doc_no", "words")


@query(r"""with f as (select min(term_id) as term_id, form from (select term_id, lower(unnest(list_prepend(canonical, aliases))) as form from terms where kind <> 'title') group by form),
    k as (select min(term_id) as term_id, regexp_replace(form, '[^a-z0-9+#]', '', 'g') as key from f group by 2), s as (select term_id, slug from terms where kind <> 'title'),
    e as (select distinct evidence as phrase from doc_terms where term_id is null and evidence is not null)
    select phrase, coalesce(f.term_id, k.term_id, s.term_id) as term_id from e left join f on f.form = lower(trim(phrase)) left join k on k.key = regexp_replace(lower(phrase), '[^a-z0-9+#]', '', 'g') and k.key <> '' left join s on s.slug = regexp_replace(lower(trim(phrase)), '[^a-z0-9]+', '-', 'g')""")
def phrase_resolution(spark: SparkSession, d: str) -> DataFrame:
    """A phrase is a form as it stands, else a form without its marks, else a slug."""
    terms = table(spark, d, "terms").where("kind <> 'title'")
    forms = terms.select("term_id", F.explode(F.concat(F.array("canonical"), "aliases")).alias("form")).groupBy(F.lower("form").alias("form")).agg(F.min("term_id").alias("t1"))
    keys = forms.groupBy(F.regexp_replace("form", "[^a-z0-9+#]", "").alias("key")).agg(F.min("t1").alias("t2")).where("key <> ''")
    slugs = terms.select("slug", F.col("term_id").alias("t3"))
    e = table(spark, d, "doc_terms").where("term_id is null and evidence is not null").select(F.col("evidence").alias("phrase")).distinct()
    e = e.withColumn("form", F.lower(F.trim("phrase"))).withColumn("key", F.regexp_replace(F.lower("phrase"), "[^a-z0-9+#]", "")).withColumn("slug", F.regexp_replace("form", "[^a-z0-9]+", "-"))
    return e.join(forms, "form", "left").join(keys, "key", "left").join(slugs, "slug", "left").select("phrase", F.coalesce("t1", "t2", "t3").alias("term_id"))


@query()
def dictionary_scan(spark: SparkSession, d: str) -> DataFrame:
    """Longest matches of the vocabulary in every document, ambiguous forms confirmed by sure ones."""
    return scan.scan(texts(spark, d, "docs"), "doc_no", "markdown", table(spark, d, "terms").where("kind <> 'title'"))


@query()
def dictionary_counts(spark: SparkSession, d: str) -> DataFrame:
    s = scan.scan(texts(spark, d, "docs"), "doc_no", "markdown", table(spark, d, "terms").where("kind <> 'title'"))
    return s.groupBy("term_id").agg(F.count("*").alias("docs"), F.sum("hits").alias("hits"))


@query(f"""with {_LINES}, f as (select doc_no, arg_min(text, line_no) as t from s where kind = 'experience' and role = 'line' and len(regexp_extract_all(text, '\\S+')) >= 4 group by 1) select doc_no, case when length(t) > 110 then substr(t, 1, 110) || '…' else t end as did from f""")
def did_fallback(spark: SparkSession, d: str) -> DataFrame:
    """First line of experience with four words, cut at 110 characters."""
    lines = extract.parsed_lines(texts(spark, d, "docs"), "doc_no", "markdown").where((F.col("kind") == "experience") & (F.col("role") == "line") & (T.word_count(F.col("text")) >= 4))
    m = lines.groupBy("doc_no").agg(F.min_by("text", "line_no").alias("t"))
    return m.select("doc_no", F.when(F.length("t") > 110, F.concat(F.substring("t", 1, 110), F.lit("…"))).otherwise(F.col("t")).alias("did"))


_RANK = "case level when 'led' then 3 when 'used' then 2 when 'listed' then 1 else 0 end"


@query(f"""with a as (select doc_no, term_id, max({_RANK}) as r from doc_terms where term_id is not null and via in ('dict', 'dict+llm') group by 1, 2), b as (select doc_no, term_id, max({_RANK}) as r from doc_terms where term_id is not null and via in ('llm', 'llm-embed', 'dict+llm') group by 1, 2)
    select coalesce(a.doc_no, b.doc_no) as doc_no, coalesce(a.term_id, b.term_id) as term_id, greatest(coalesce(a.r, 0), coalesce(b.r, 0))::int as level_rank, case when a.r is null then 'llm' when b.r is null then 'dict' else 'dict+llm' end as via from a full join b on a.doc_no = b.doc_no and a.term_id = b.term_id""")
def claims_merged(spark: SparkSession, d: str) -> DataFrame:
    """Claims of two extractors: the higher level wins, the channel says who made it."""
    dt = table(spark, d, "doc_terms").where("term_id is not null")
    side = lambda vias, n: dt.where(F.col("via").isin(*vias)).groupBy("doc_no", "term_id").agg(F.max(level_rank(F.col("level"))).alias(n))
    j = side(("dict", "dict+llm"), "a").join(side(("llm", "llm-embed", "dict+llm"), "b"), ["doc_no", "term_id"], "full")
    return j.select("doc_no", "term_id", F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("level_rank"), F.when(F.col("a").isNull(), "llm").when(F.col("b").isNull(), "dict").otherwise("dict+llm").alias("via"))


@query(f"""with {POSTINGS_SQL} select kind, count(*) filter (where strong) as strict, count(*) filter (where kind = 'topic' or strong) as normal, count(*) as loose, count(*) filter (where used) as used from po group by 1""")
def evidence_rule(spark: SparkSession, d: str) -> DataFrame:
    """How many members each rule of evidence lets in, by kind of term."""
    p = prepared.postings(spark, d)
    return p.groupBy("kind").agg(F.count_if("strong").alias("strict"), F.count_if((F.col("kind") == "topic") | F.col("strong")).alias("normal"), F.count("*").alias("loose"), F.count_if("used").alias("used"))


@query(f"""with p as (select doc_no, max(availability) as availability from profile group by 1) select doc_no from p where {AVAILABILITY_SQL} in ('now', '2w', '1m')""")
def filter_availability(spark: SparkSession, d: str) -> DataFrame:
    """Availability by its label, as are the wanted values; a missing one never matches."""
    p = table(spark, d, "profile").groupBy("doc_no").agg(F.max("availability").alias("a"))
    wanted = [T.availability_label(F.lit(x)) for x in ("Immediate", "2 weeks", "1m")]
    return p.where(T.availability_label(F.col("a")).isin(*wanted)).select("doc_no")


@query(r"""with c as (select doc_no, unnest(chunks) as c from build_docs), s as (select doc_no, c.idx as idx, len(list_filter(['payment', 'gateway', 'audit', 'trail'], lambda w: contains(lower(c.text), w))) as score from c) select doc_no, max(score)::int as score, arg_max(idx, score * 100000 - idx) as idx from s group by 1 having max(score) >= 2""")
def best_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Best chunk of each document for a query, the first on a tie, above a threshold."""
    c = table(spark, d, "build_docs").select("doc_no", F.explode("chunks").alias("c")).select("doc_no", "c.idx", F.lower("c.text").alias("t"))
    score = sum(F.coalesce(F.contains("t", F.lit(w)), F.lit(False)).cast("int") for w in ("payment", "gateway", "audit", "trail"))
    best = c.select("doc_no", "idx", score.alias("score")).groupBy("doc_no").agg(F.max(F.struct("score", (-F.col("idx")).alias("k"))).alias("b"))
    return best.select("doc_no", F.col("b.score").alias("score"), (-F.col("b.k")).alias("idx")).where("score >= 2")


@query("""with f as (select kind, canonical, count(distinct doc_no) as n from doc_terms join terms using (term_id) group by 1, 2), r as (select *, row_number() over (partition by kind order by n desc, canonical) as rn from f) select kind, canonical, n, row_number() over (order by rn, kind) as pos from r where rn <= 4 order by pos limit 8""")
def interleaved(spark: SparkSession, d: str) -> DataFrame:
    """Round robin over groups of suggestions, eight in all."""
    counts = table(spark, d, "doc_terms").where("term_id is not null").select("term_id", "doc_no").distinct().groupBy("term_id").agg(F.count("*").alias("n"))
    f = counts.join(table(spark, d, "terms").select("term_id", "kind", "canonical"), "term_id")
    r = f.withColumn("rn", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("n").desc(), "canonical"))).where("rn <= 4").orderBy("rn", "kind").limit(8)
    return r.select("kind", "canonical", "n", F.row_number().over(Window.orderBy("rn", "kind")).cast("bigint").alias("pos"))  # eight rows


@query("""with r as (select case when slug = 'react' then 'angular' else slug end as to_slug, case when slug <> 'react' then canonical end as name, list_concat(coalesce(aliases, []), case when slug = 'react' then [canonical] else [] end) as f, list_transform(coalesce(implies, []), lambda x: case when x = 'react' then 'angular' else x end) as i from terms where kind = 'skill'),
    g as (select to_slug, max(name) as canonical, list_sort(list_distinct(flatten(list(f)))) as forms, list_sort(list_distinct(flatten(list(i)))) as i from r group by 1) select to_slug as slug, canonical, forms, list_filter(i, lambda x: x <> to_slug) as implied from g""")
def vocab_merge(spark: SparkSession, d: str) -> DataFrame:
    """One term merged into another: its forms move, references to it are turned."""
    return vocab.merged(table(spark, d, "terms").where("kind = 'skill'"), "react", "angular")


@query("""with t as (select slug, canonical, aliases, implies from terms where kind <> 'title' union all select 'new-tool', 'New Tool', ['Python', 'NT'], ['nowhere']), f as (select slug, lower(unnest(list_prepend(canonical, coalesce(aliases, [])))) as form from t)
    select form, count(distinct slug) as terms from f group by 1 having count(distinct slug) > 1 union all select 'missing: ' || i, count(*) from (select unnest(implies) as i from t) where i not in (select slug from t) group by 1""")
def vocab_lint(spark: SparkSession, d: str) -> DataFrame:
    """What a careless addition to the vocabulary breaks: a form of another term and an implied term that doesn't exist."""
    t = table(spark, d, "terms").where("kind <> 'title'")
    return vocab.problems(vocab.aliased(vocab.added(t, "new-tool", "New Tool", "skill", ["Python"], ["nowhere"]), "new-tool", "NT"))


@query(f"""with {POSTINGS_SQL}, t(tau) as (values (0.35), (0.4), (0.45), (0.5), (0.55), (0.6)), c as (select tau, kind, count(*) filter (where strong and cosine >= tau) as tp, count(*) filter (where not strong and cosine >= tau) as fp, count(*) filter (where strong and cosine < tau) as fn from po, t group by 1, 2)
    select tau::double as tau, kind, tp, fp, fn, round(tp / nullif(tp + fp, 0)::double, 6) as precision, round(tp / nullif(tp + fn, 0)::double, 6) as recall from c""")
def quality_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the vector channel against strong evidence for six thresholds."""
    taus = F.explode(F.array(*[F.lit(t) for t in (0.35, 0.4, 0.45, 0.5, 0.55, 0.6)]))
    near = F.col("cosine") >= F.col("tau")
    c = prepared.postings(spark, d).select("kind", "strong", "cosine", taus.alias("tau")).groupBy("tau", "kind").agg(F.count_if(F.col("strong") & near).alias("tp"), F.count_if(~F.col("strong") & near).alias("fp"), F.count_if(F.col("strong") & ~near).alias("fn"))
    share = lambda a, b: F.round(F.col("tp") / F.nullif(F.col(a) + F.col(b), F.lit(0)), 6)
    return c.select("*", share("tp", "fp").alias("precision"), share("tp", "fn").alias("recall"))


@query()
def extract_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of every document with level, evidence and section, by the dictionary alone."""
    return scan.extracted(texts(spark, d, "docs"), "doc_no", "markdown", table(spark, d, "terms").where("kind <> 'title'"))


@query("""with p as (select doc_no, max(location) as location, max(years) as years, max(rate) as rate, bool_or(lower(rate_source) like '%synthetic%') as guess from profile group by 1) select doc_no, trim(split_part(location, ',', 1)) as place, case when years is null then '–' else floor(years)::int || ' y' end as years, case when rate is null then '–' when coalesce(guess, false) then '~' || floor(rate)::bigint else floor(rate)::bigint::varchar end as rate from p""")
def display_labels(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "profile").groupBy("doc_no").agg(F.max("location").alias("l"), F.max("years").alias("y"), F.max("rate").alias("r"), F.max(F.contains(F.lower("rate_source"), F.lit("synthetic"))).alias("g"))
    none, rate = F.lit("–"), F.floor("r").cast("string")
    return p.select("doc_no", F.trim(F.split_part("l", F.lit(","), F.lit(1))).alias("place"), F.when(F.col("y").isNull(), none).otherwise(F.concat(F.floor("y").cast("string"), F.lit(" y"))).alias("years"), F.when(F.col("r").isNull(), none).when(F.coalesce("g", F.lit(False)), F.concat(F.lit("~"), rate)).otherwise(rate).alias("rate"))


@query("""with e as (select user_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as step, count(*) over (partition by user_id) as n from events) select user_id, step, case event_type when 'purchase' then '+' when 'refund' then '−' else '·' end || ' ' || event_type as words, step = n as current from e""")
def history_list(spark: SparkSession, d: str) -> DataFrame:
    """Numbered steps of each session with the current one marked."""
    e = S.numbered(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", [F.col("ts"), F.col("event_id")])
    sign = F.when(F.col("event_type") == "purchase", "+").when(F.col("event_type") == "refund", "−").otherwise("·")
    return e.select("user_id", "step", F.concat_ws(" ", sign, "event_type").alias("words"), F.col("last").alias("current"))


@query("""with r(name, place) as (values ('Brand#11', 1), ('Brand#33', 2)), b as (select distinct p_brand from part) select p_brand, row_number() over (order by place nulls last, p_brand) as pos from b left join r on name = p_brand order by pos limit 6""")
def ranked_selection(spark: SparkSession, d: str) -> DataFrame:
    """Listed names first in their order, then the others by name, six in all."""
    r = spark.createDataFrame([("Brand#11", 1), ("Brand#33", 2)], "p_brand string, place int")
    b = table(spark, d, "part").select("p_brand").distinct().join(F.broadcast(r), "p_brand", "left").orderBy(F.col("place").asc_nulls_last(), "p_brand").limit(6)
    return b.select("p_brand", F.row_number().over(Window.orderBy(F.col("place").asc_nulls_last(), "p_brand")).cast("bigint").alias("pos"))  # six rows


@query("""select i::bigint as id, ['junior', 'mid', 'senior', 'lead'][1 + (('0x' || substr(md5('s' || i), 1, 7))::bigint % 4)] as seniority, 1 + (('0x' || substr(md5('y' || i), 1, 7))::bigint % 30) as years, i % 50 = 7 as outlier from range(1000) r(i)""")
def synthetic_people(spark: SparkSession, d: str) -> DataFrame:
    """A seeded population made on the workers: hashes of the number are its random draws."""
    draw = lambda p: F.conv(F.substring(F.md5(F.concat(F.lit(p), F.col("id").cast("string"))), 1, 7), 16, 10).cast("bigint")
    names = F.array(*[F.lit(x) for x in ("junior", "mid", "senior", "lead")])
    return spark.range(1000).select("id", F.element_at(names, (draw("s") % 4 + 1).cast("int")).alias("seniority"), (draw("y") % 30 + 1).alias("years"), (F.col("id") % 50 == 7).alias("outlier"))


@query(r"""select doc_no, list_filter([case when not regexp_matches(markdown, '(?m)^# ') then 'no title' end, case when not regexp_matches(markdown, '(?m)^## ') then 'no section' end, case when regexp_matches(markdown, '(?i)lorem ipsum|todo') then 'filler' end, case when len(regexp_extract_all(markdown, '\S+')) not between 50 and 1500 then 'length' end], lambda x: x is not null) as problems from docs where markdown is not null""")
def document_problems(spark: SparkSession, d: str) -> DataFrame:
    """Checks of generated documents as a list of what is wrong."""
    m, n = F.col("markdown"), T.word_count(F.col("markdown"))
    tests = [(~m.rlike(r"(?m)^# "), "no title"), (~m.rlike(r"(?m)^## "), "no section"), (m.rlike(r"(?i)lorem ipsum|todo"), "filler"), (~n.between(50, 1500), "length")]
    return table(spark, d, "docs").where("markdown is not null").select("doc_no", F.array_compact(F.array(*[F.when(c, F.lit(w)) for c, w in tests])).alias("problems"))


@query("""select source, greatest(3, ceil(count(*) / 25.0)::bigint * 7) as seconds from docs group by 1""")
def time_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Rounds of five times five cards at seven seconds, three at least."""
    return table(spark, d, "docs").groupBy("source").agg(F.greatest(F.lit(3), F.ceil(F.count("*") / 25) * 7).cast("bigint").alias("seconds"))


@query("""select id, (('0x' || substr(sha256(id), 1, 8))::bigint % 101)::bigint as score from docs where not coalesce(deleted, false)""")
def hash_judge(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic scores for tests of ranking without a model."""
    return table(spark, d, "docs").where("not coalesce(deleted, false)").select("id", (F.conv(F.substring(F.sha2("id", 256), 1, 8), 16, 10).cast("bigint") % 101).alias("score"))


@query("""select user_id, max(ts) as last from events group by 1 having max(ts) < (select max(ts) from events) - interval 2 days""")
def stale_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions untouched for two days before the newest event."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    newest = last.agg(F.max("last").alias("newest"))
    return last.crossJoin(newest).where(F.col("last") < F.col("newest") - F.expr("interval 2 days")).select("user_id", "last")  # newest is one row


@query("""with t as (select doc_no from doc_terms where term_id = 25 and doc_no in (select doc_no from docs where not coalesce(deleted, false)) group by 1) select doc_no from t where doc_no not in (select doc_no from profile where rate is not null)""")
def unjudged(spark: SparkSession, d: str) -> DataFrame:
    """Members without a score."""
    t = table(spark, d, "doc_terms").where("term_id = 25").select("doc_no").distinct().join(table(spark, d, "docs").where("not coalesce(deleted, false)").select("doc_no"), "doc_no", "left_semi")
    return t.join(table(spark, d, "profile").where("rate is not null").select("doc_no"), "doc_no", "left_anti")


@query("""with p as (select doc_no, max(rate) as rate from profile group by 1), b as (select doc_no, source, rate from docs join p using (doc_no) where rate is not null) select doc_no, rank() over (partition by source order by rate desc) as place, count(*) over (partition by source) as of from b""")
def place_among(spark: SparkSession, d: str) -> DataFrame:
    """Place of each document among the scored of its group; from counts of distinct scores, not from sorted groups."""
    p = table(spark, d, "profile").groupBy("doc_no").agg(F.max("rate").alias("rate")).where("rate is not null")
    b = p.join(table(spark, d, "docs").select("doc_no", "source"), "doc_no")
    w = Window.partitionBy("source").orderBy(F.col("rate").desc())
    places = b.groupBy("source", "rate").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(w)).withColumn("of", F.sum("k").over(Window.partitionBy("source")))
    return b.join(places, ["source", "rate"]).select("doc_no", (F.col("upto") - F.col("k") + 1).alias("place"), "of")


@query("""select user_id, event_id, substr(props, 1, 12) as said from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn <= 5""")
def last_turns(spark: SparkSession, d: str) -> DataFrame:
    """The last five turns of each session, cut at a number of characters."""
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, d, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("user_id", "event_id", F.substring("props", 1, 12).alias("said"))


@query("""select doc_no, term_id from (select distinct doc_no, term_id from doc_terms where term_id is not null) where doc_no not in (select doc_no from docs where coalesce(deleted, false)) and doc_no in (select doc_no from docs)""")
def index_without_deleted(spark: SparkSession, d: str) -> DataFrame:
    """Postings after removal of deleted documents."""
    docs = table(spark, d, "docs")
    dt = table(spark, d, "doc_terms").where("term_id is not null").select("doc_no", "term_id").distinct()
    return dt.join(docs.where(~F.coalesce("deleted", F.lit(False))).select("doc_no"), "doc_no", "left_semi")


@query()
def hashed_embedding(spark: SparkSession, d: str) -> DataFrame:
    return scan.hashed_embedding(texts(spark, d, "docs"), "doc_no", "markdown")
