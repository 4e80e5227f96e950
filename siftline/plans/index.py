"""Index build: chunks, full text, postings, cards, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cards as C
from ..operators import chunks as K
from ..operators import extract
from ..operators import index as I
from ..runtime import prepared as once_built
from ..runtime import table, texts
from . import prepared
from .corpus import _KINDS

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "build_docs").select("doc_no", F.explode("chunks").alias("c")).select("doc_no", "c.*")


@query("""with c as (select doc_no, unnest(chunks) as c from build_docs) select doc_no, c.idx as idx, greatest(1, length(c.text) // 4)::bigint as size, c.tokens is null or c.tokens <> greatest(1, length(c.text) // 4) as wrong, concat_ws(' / ', nullif(c.header, ''), c.section) as context from c""")
def chunk_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with their real size and context header."""
    size = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("bigint")
    return _chunks(spark, d).select("doc_no", "idx", size.alias("size"), (F.col("tokens").isNull() | (F.col("tokens") != size)).alias("wrong"), F.concat_ws(" / ", F.nullif("header", F.lit("")), "section").alias("context"))


@query()
def chunks_built(spark: SparkSession, d: str) -> DataFrame:
    """All documents in chunks by section and entry."""
    return K.chunked(texts(spark, d, "docs"), "doc_no", "markdown")


_TF = r"""w as (select doc_no, regexp_extract_all(lower(markdown), '[a-z0-9]+') as ws from docs where not coalesce(deleted, false) and markdown is not null)"""


@query(f"""with {_TF}, t as (select doc_no, unnest(ws) as word from w), f as (select doc_no, word, count(*) as tf from t group by 1, 2) select word, count(*) as df, sum(tf)::bigint as cf from f group by 1""")
def fulltext_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "docs").where("not coalesce(deleted, false) and markdown is not null").select("doc_no", T.words(F.col("markdown")).alias("ws"))
    return I.frequencies(docs, "doc_no", "ws").groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def _bm25_sql(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""with {_TF}, z as (select count(*) as docs, avg(len(ws)) as a from w), t as (select doc_no, len(ws) as n, unnest(ws) as word from w), f as (select doc_no, n, word, count(*) as tf from t where word in ({listed}) group by all),
        g as (select word, count(*) as df from f group by 1) select doc_no, round(sum(ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / a))), 6) as score from f join g using (word), z group by doc_no having count(*) = {len(words)}"""


@query(_bm25_sql(["payment", "gateway", "python"]))
def fulltext_bm25(spark: SparkSession, d: str) -> DataFrame:
    """Documents with all query words, by BM25; the words of the index are read by word."""
    return I.bm25(prepared.words(spark, d), prepared.sizes(spark, d), "doc_no", ["payment", "gateway", "python"]).withColumn("score", F.round("score", 6))


@query(r"""select doc_no from docs where regexp_matches(markdown, '(?i)\bdata\w*\W+contrac\w*')""")
def fulltext_phrase(spark: SparkSession, d: str) -> DataFrame:
    """Phrase check by neighbouring stems."""
    pattern = I.phrase_pattern(F.array(F.lit("data"), F.lit("contracts")))
    return table(spark, d, "docs").where(F.rlike("markdown", pattern)).select("doc_no")


_CHUNKS_SQL = f"""ch as (select doc_no, c.idx as idx, doc_no || ':' || c.idx as chunk, {_KINDS.format("c.section")} as kind, c.text as text from (select doc_no, unnest(chunks) as c from build_docs)),
    kv as (select substr(key, 1, 2) as pre, arg_min(vec, key)::double[] as vec from emb where model = 'hash-embed-96' and len(vec) = 96 and len(list_filter(vec, lambda x: x <> 0)) > 0 group by 1)"""
POSTINGS_SQL = rf"""{_CHUNKS_SQL}, tm as (select * from terms where kind <> 'title'),
    cl as (select term_id, doc_no, greatest(1, case level when 'led' then 3 when 'used' then 2 when 'listed' then 1 else 0 end) as r, via = 'llm' and kind = 'topic' as only_said from doc_terms join tm using (term_id)),
    c1 as (select term_id, doc_no, max(case when not coalesce(only_said, false) then r end) as ev, max(case when only_said then r end) as said from cl group by 1, 2),
    fo as (select term_id, unnest(list_prepend(canonical, coalesce(aliases, []))) as form, list_transform(coalesce(ambiguous, []), lambda x: lower(x)) as unsure from tm),
    fw as (select distinct term_id, regexp_extract_all(lower(form), '[a-z0-9]+') as words from fo where not list_contains(unsure, lower(form))),
    fx as (select term_id, words, len(list_distinct(words)) as n, '(?i)\b' || array_to_string(list_transform(words, lambda w: (case when length(w) <= 4 then w else substr(w, 1, greatest(4, length(w) - 2)) end) || '\w*'), '\W+') as pattern from fw where len(words) > 1 or length(words[1]) >= 4),
    cw as (select chunk, doc_no, kind, text, regexp_extract_all(lower(text), '[a-z0-9]+') as ws from ch where text is not null), z as (select count(*) as docs, avg(len(ws)) as a from cw),
    tf as (select chunk, doc_no, kind, len(ws) as n, u.word, count(*) as tf from cw, unnest(ws) as u(word) group by all), df as (select word, count(*) as df from tf group by 1),
    sc as (select chunk, doc_no, tf.word, ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * n / a)) as part from tf join df using (word), z where kind = 'experience'),
    ht as (select sc.chunk, sc.doc_no, x.term_id, x.words, x.pattern, x.n, sum(part) as score, count(*) as k from (select term_id, words, pattern, n, unnest(list_distinct(words)) as word from fx) x join sc using (word) group by all),
    c2 as (select term_id, ht.doc_no, max(score) as bm25 from ht join ch using (chunk) where k = n and (len(words) = 1 or regexp_matches(ch.text, pattern)) group by 1, 2),
    c3 as (select term_id, doc_no, max(list_cosine_similarity(vec, emb::double[])) as cosine from ch join kv on pre = substr(sha256(text), 1, 2), tm where kind_ok(ch.kind) and emb is not null and list_cosine_similarity(vec, emb::double[]) >= {prepared.TAU} group by 1, 2)""".replace("kind_ok(ch.kind)", "ch.kind <> 'education'") + r""",
    su as (select term_id, doc_no, ev, said, null::double as bm25 from c1 union all select term_id, doc_no, null, null, bm25 from c2),
    cx as (with recursive c as (select slug, unnest(implies) as implied, 1 as depth from tm union all select c.slug, unnest(t.implies), depth + 1 from c join tm t on t.slug = c.implied where depth < 5) select distinct x.term_id as skill, y.term_id as topic from c join tm x on x.slug = c.slug join tm y on y.slug = c.implied where c.slug <> c.implied),
    al as (select term_id, doc_no, ev, said, bm25, null::double as cosine from su union all select topic, doc_no, ev, null, bm25, null from su join cx on skill = term_id where ev is not null or bm25 is not null union all select term_id, doc_no, null, null, null, cosine from c3),
    ag as (select term_id, doc_no, max(ev) as ev, max(said) as said, max(bm25) as bm25, max(cosine) as cosine from al group by 1, 2),
    pw as (select *, ev is not null or bm25 is not null as strong, case when ev is not null or bm25 is not null then coalesce(greatest(ev, said), 0) else 0 end as evidence from ag),
    po as (select pw.term_id::bigint as term_id, kind, doc_no, coalesce('g' || dup_group, 'd' || doc_no) as person, evidence::int as evidence, coalesce(bm25, 0) as bm25, coalesce(cosine, 0) as cosine, strong, evidence >= 2 as used, not strong and cosine is not null as weak
        from pw join tm on tm.term_id = pw.term_id join docs using (doc_no) where not coalesce(deleted, false) and (strong or cosine is not null))"""


@query(f"with {POSTINGS_SQL} select term_id, doc_no, evidence, strong, used, weak from po")
def postings(spark: SparkSession, d: str) -> DataFrame:
    """Members of every term from claims, full text and vectors."""
    return prepared.postings(spark, d).select("term_id", "doc_no", "evidence", "strong", "used", "weak")


@query(f"with {POSTINGS_SQL} select term_id, doc_no, evidence, round(bm25, 6) as bm25, round(cosine, 6) as cosine from po")
def member_scores(spark: SparkSession, d: str) -> DataFrame:
    return prepared.postings(spark, d).select("term_id", "doc_no", "evidence", F.round("bm25", 6).alias("bm25"), F.round("cosine", 6).alias("cosine"))


@query(f"with {POSTINGS_SQL} select term_id, count(*) filter (where strong) as n_strong, count(*) filter (where used) as n_used, count(*) filter (where weak) as n_weak from po group by 1")
def posting_counts(spark: SparkSession, d: str) -> DataFrame:
    return prepared.postings(spark, d).groupBy("term_id").agg(F.count_if("strong").alias("n_strong"), F.count_if("used").alias("n_used"), F.count_if("weak").alias("n_weak"))


@query(f"with {POSTINGS_SQL} select term_id, doc_no, round(bm25, 6) as bm25 from po where bm25 > 0")
def channel_fulltext(spark: SparkSession, d: str) -> DataFrame:
    """Members that full text makes."""
    return prepared.postings(spark, d).where("bm25 > 0").select("term_id", "doc_no", F.round("bm25", 6).alias("bm25"))


@query(f"with {_CHUNKS_SQL} select doc_no, max(list_cosine_similarity(vec, emb::double[])) >= 0.3 as near, round(max(list_cosine_similarity(vec, emb::double[])), 6) as cosine from ch join kv on pre = substr(sha256(text), 1, 2), (select emb from terms where slug = 'data-pipelines') where kind <> 'education' group by 1")
def channel_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each document to a query vector: that of its best chunk, education aside."""
    q = table(spark, d, "terms").where("slug = 'data-pipelines'").select(F.lit(0).alias("term_id"), "emb").limit(1)
    best = I.near_terms(prepared.chunks(spark, d), q, -1.0)
    return best.select("doc_no", (F.col("cosine") >= 0.3).alias("near"), F.round("cosine", 6).alias("cosine"))


def _round_trip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_terms").where("term_id is not null").select("term_id", "doc_no").distinct()
    return rows.groupBy("term_id", F.floor(F.col("doc_no") / 32768).cast("int").alias("bucket")).agg(F.base64(F.bitmap_construct_agg(F.col("doc_no") % 32768)).alias("bits"))


@query("""select distinct term_id, doc_no from doc_terms where term_id is not null""")
def posting_bitmaps(spark: SparkSession, d: str) -> DataFrame:
    """Postings as bitmaps in base64 for each term and bucket of documents, and read back."""
    return I.members_of(once_built(spark, d, "bitmaps", _round_trip)).select("term_id", "doc_no")


@query("""with a as (select distinct term_id, doc_no from doc_terms where term_id is not null), o as (select distinct term_id, doc_no from doc_terms where term_id is not null and level = 'led'), g as (select doc_no from docs where coalesce(deleted, false)),
    x as (select term_id, doc_no from a where (term_id, doc_no) not in (select term_id, doc_no from o) and doc_no not in (select doc_no from g)) select term_id, doc_no // 32768 as bucket, count(*) as members from x group by 1, 2""")
def bitmaps_maintained(spark: SparkSession, d: str) -> DataFrame:
    """Bitmaps with new members added, some taken out and deleted documents discarded, without unpacking them."""
    dt = table(spark, d, "doc_terms").where("term_id is not null").select("term_id", "doc_no", "level")
    pack = lambda rows: I.bitmaps(rows.select("term_id", "doc_no"))
    old, new, off = pack(dt.where("level <> 'listed' or level is null")), pack(dt.where("level = 'listed'")), pack(dt.where("level = 'led'"))
    gone = table(spark, d, "docs").where("coalesce(deleted, false)").select("doc_no")
    kept = I.bitmaps_without(I.bitmaps_without(I.bitmaps_or(old, new), off, ["term_id", "bucket"]), I.bitmaps(gone.select(F.lit(0).alias("term_id"), "doc_no")).drop("term_id"), ["bucket"])
    return kept.select("term_id", "bucket", F.bitmap_count("bits").alias("members")).where("members > 0")


@query(f"with {POSTINGS_SQL} select topic::bigint as term_id, doc_no, max(ev)::int as evidence, round(max(bm25), 6) as bm25 from su join cx on skill = term_id where ev is not null or bm25 is not null group by 1, 2")
def topics_inherited(spark: SparkSession, d: str) -> DataFrame:
    """What topics get from the skills that imply them, over any number of steps."""
    terms = table(spark, d, "terms").where("kind <> 'title'")
    return I.inherited(I.sure(table(spark, d, "doc_terms"), terms, prepared.chunks(spark, d)), terms).groupBy(F.col("term_id").cast("bigint").alias("term_id"), "doc_no").agg(F.max("ev").alias("evidence"), F.round(F.max("bm25"), 6).alias("bm25"))


AVAILABILITY_SQL = r"""case when trim(availability) = '' then null when regexp_matches(lower(trim(availability)), '^(avail )?(immediate|now$)') then 'now' when regexp_matches(lower(trim(availability)), '^(notice |avail )?[0-9]+\s*[wmd](eeks?|onths?|ays?)?$')
    then regexp_extract(availability, '[0-9]+') || lower(regexp_extract(lower(availability), '[0-9]+\s*([wmd])', 1)) else substr(lower(trim(availability)), 1, 14) end"""


_CARD_PARTS = f"""pr as (select doc_no, max(current_title) as title, max(headline) as headline, max(years) as years, max(rate) as rate, max(currency) as currency, max(location) as location, bool_or(remote) as remote, max(availability) as availability, max(did) as did from profile group by 1),
    sk as (select doc_no, canonical, max(case level when 'led' then 3 when 'used' then 2 when 'listed' then 1 else 0 end) as r from doc_terms join terms using (term_id) where kind = 'skill' and via <> 'implied' group by 1, 2),
    sl as (select doc_no, coalesce(list(canonical order by r desc, canonical) filter (where r >= 2), []) as used, coalesce(list(canonical order by canonical) filter (where r = 1), []) as listed from sk group by 1),
    cp as (select pr.doc_no, d.id, concat_ws(' · ', d.id, substr(case when tt = upper(tt) and tt <> lower(tt) then list_aggregate(list_transform(string_split(lower(tt), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') else tt end, 1, 60), case when years >= 2 then round_even(years, 0)::int || 'y' when years is not null then printf('%.1f', years) || 'y' end,
        case when rate is not null then coalesce(case currency when 'EUR' then '€' when 'USD' then '$' when 'GBP' then '£' else currency || ' ' end, '€') || round_even(rate, 0)::bigint || '/h' end,
        case when location is not null then trim(split_part(location, ',', 1)) || case when remote then ' (remote ok)' else '' end when remote then 'remote ok' end, 'avail ' || {AVAILABILITY_SQL}) as facts,
        coalesce(used, []) as used, coalesce(listed, []) as listed, rtrim(regexp_replace(trim(coalesce(did, '')), '\\.+$', '')) as did from (select *, coalesce(title, headline) as tt from pr) pr join docs d using (doc_no) left join sl using (doc_no))"""


def _card_parts(spark: SparkSession, d: str) -> DataFrame:
    p = prepared.profile(spark, d).where("id is not null")
    t = table(spark, d, "doc_terms").where("via <> 'implied'").join(table(spark, d, "terms").where("kind = 'skill'").select("term_id", "canonical"), "term_id")
    r = t.groupBy("doc_no", "canonical").agg(F.max(extract.level_rank(F.col("level"))).alias("r"))
    named = F.sort_array(F.collect_list(F.when(F.col("r") >= 2, F.struct((-F.col("r")).alias("r"), "canonical"))))
    s = r.groupBy("doc_no").agg(F.transform(named, lambda x: x["canonical"]).alias("used"), F.sort_array(F.collect_list(F.when(F.col("r") == 1, F.col("canonical")))).alias("listed"))
    c = {n: F.col(n) for n in ("id", "years", "rate", "currency", "location", "remote", "availability")} | {"title": F.coalesce("current_title", "headline")}
    return p.join(s, "doc_no", "left").select("doc_no", "id", C.facts(c).alias("facts"), "used", "listed", "did")


@query(f"""with {_CARD_PARTS}, st as (select *, len(listed) as a, greatest(len(used) - 4, 0) as b, greatest(0, ceil((length(did) - 41) / 20.0))::int as cuts from cp),
    k as (select st.*, r.k from st, unnest(range(0, len(listed) + len(used) + cuts + 1)) as r(k)),
    n as (select *, len(used) - least(greatest(0, k - a), b) - greatest(0, k - a - b - cuts) as nu, a - least(k, a) as nl, least(greatest(0, k - a - b), cuts) as nd from k),
    w as (select doc_no, k, a + len(used) + cuts as last, facts, array_to_string(used[:greatest(nu, 0)], ', ') as us, array_to_string(listed[:nl], ', ') as ls, case when nd > 0 then rtrim(substr(did, 1, greatest(40, length(did) - nd * 20 - 1))) || '…' else did end as did from n),
    x as (select doc_no, k, last, concat_ws(chr(10), facts, case when us <> '' or ls <> '' then 'skills: ' || concat_ws(' · ', nullif(us, ''), case when ls <> '' then 'listed only: ' || ls end) end, case when did <> '' then 'did: ' || did end) as text from w)
    select doc_no, arg_min(text, k) as text, greatest(1, length(arg_min(text, k)) // 4)::bigint as tokens from x where length(text) // 4 <= 110 or k = last group by 1""")
def cards(spark: SparkSession, d: str) -> DataFrame:
    """Result cards within 110 tokens."""
    return C.rendered(_card_parts(spark, d)).select("doc_no", "text", "tokens")


@query(f"""with {_CARD_PARTS} select doc_no, used, listed, nullif(did, '') as did from cp where length(concat_ws(chr(10), facts, 'skills: ' || concat_ws(' · ', nullif(array_to_string(used, ', '), ''), case when len(listed) > 0 then 'listed only: ' || array_to_string(listed, ', ') end), case when did <> '' then 'did: ' || did end)) // 4 <= 110 and len(used) + len(listed) > 0""")
def cards_read_back(spark: SparkSession, d: str) -> DataFrame:
    """The parts of cards that needed no trimming, read back from their text."""
    parts = _card_parts(spark, d)
    shown = C.read_back(C.rendered(parts).where("size(used) + size(listed) > 0"), "text")
    whole = (F.size("used") == F.size("used_shown")) & (F.size("listed") == F.size("listed_shown")) & (F.coalesce("did_shown", F.lit("")) == F.col("did"))
    return shown.where(whole).select("doc_no", F.col("used_shown").alias("used"), F.col("listed_shown").alias("listed"), F.col("did_shown").alias("did"))


@query(f"""select distinct doc_no, {AVAILABILITY_SQL} as label, case when current_title = upper(current_title) and current_title <> lower(current_title) then list_aggregate(list_transform(string_split(lower(current_title), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') else current_title end as title from profile""")
def card_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "profile").select("doc_no", T.availability_label(F.col("availability")).alias("label"), T.title_case_if_upper(F.col("current_title")).alias("title")).distinct()


@query("""select 'docs' as name, count(*) as n from docs union all select 'live', count(*) from docs where not coalesce(deleted, false) union all select 'profile', count(*) from (select distinct * from profile)
    union all select 'terms', count(*) from terms union all select 'doc_terms', count(*) from (select distinct * from doc_terms) union all select 'chunks', sum(len(chunks))::bigint from build_docs
    union all select 'with_terms', count(distinct doc_no) from doc_terms union all select 'oversized', count(*) from (select unnest(chunks) as c from build_docs) where length(c.text) // 4 > 350""")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    one = lambda n, df, e=None: df.agg((e if e is not None else F.count("*")).cast("bigint").alias("n")).select(F.lit(n).alias("name"), "n")
    parts = [
        one("docs", t("docs")), one("live", t("docs").where("not coalesce(deleted, false)")), one("profile", t("profile").distinct()), one("terms", t("terms")), one("doc_terms", t("doc_terms").distinct()),
        one("chunks", t("build_docs"), F.sum(F.size("chunks"))), one("with_terms", t("doc_terms"), F.count_distinct("doc_no")), one("oversized", _chunks(spark, d).where(F.floor(F.length("text") / 4) > 350)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""with truth as (select doc_no, term_id from doc_terms where via = 'dict+llm' and term_id is not null group by 1, 2), found as (select doc_no, term_id from doc_terms where via = 'llm-embed' and term_id is not null group by 1, 2),
    m as (select coalesce(t.term_id, f.term_id) as term_id, t.doc_no is not null as t, f.doc_no is not null as f from truth t full join found f on t.doc_no = f.doc_no and t.term_id = f.term_id)
    select term_id, count(*) filter (where t and f) as tp, count(*) filter (where f and not t) as fp, count(*) filter (where t and not f) as fn from m group by 1""")
def quality_counts(spark: SparkSession, d: str) -> DataFrame:
    """True and false positives and misses of one channel against another, by term."""
    dt = table(spark, d, "doc_terms").where("term_id is not null")
    side = lambda via, name: dt.where(F.col("via") == via).select("doc_no", "term_id").distinct().withColumn(name, F.lit(True))
    m = side("dict+llm", "t").join(side("llm-embed", "f"), ["doc_no", "term_id"], "full")
    t, f = F.col("t").isNotNull(), F.col("f").isNotNull()
    return m.groupBy("term_id").agg(F.count_if(t & f).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(t & ~f).alias("fn"))


@query("""with v as (select distinct key, vec::double[] as vec from emb where model = 'hash-embed-96' and len(vec) = 96 and list_sum(list_transform(vec, lambda x: x * x)) > 0)
    select key, slug, round(list_cosine_similarity(vec, emb::double[]), 6) as cosine from v, terms where kind = 'topic' and list_cosine_similarity(vec, emb::double[]) >= 0.5""")
def vector_channel(spark: SparkSession, d: str) -> DataFrame:
    """Dense channel: vectors near a topic. The topics, a fixed vocabulary, are broadcast below a checked size."""
    v = table(spark, d, "emb").where("model = 'hash-embed-96' and size(vec) = 96").select("key", "vec").distinct()
    v = v.where(F.exists("vec", lambda x: x != 0))
    topics = table(spark, d, "terms").where("kind = 'topic'").select("slug", "emb")
    if topics.limit(10_001).count() > 10_000:
        raise ValueError("too many topics to compare with every vector; use an index")
    met = v.join(F.broadcast(topics), I.cosine(F.col("vec"), F.col("emb")) >= 0.5)
    return met.select("key", "slug", F.round(I.cosine(F.col("vec"), F.col("emb")), 6).alias("cosine"))


@query("""with q as (select emb::double[] as e from terms where slug = 'data-pipelines'), v as (select distinct key, vec::double[] as vec from emb where model = 'hash-embed-96' and len(vec) = 96 and list_sum(list_transform(vec, lambda x: x * x)) > 0)
    select key, round(list_cosine_similarity(vec, e), 6) as cosine from v, q order by list_cosine_similarity(vec, e) desc, key limit 10""")
def vector_top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to one query vector."""
    q = table(spark, d, "terms").where("slug = 'data-pipelines'").select("emb").limit(1)
    v = table(spark, d, "emb").where("model = 'hash-embed-96' and size(vec) = 96").select("key", "vec").distinct().where(F.exists("vec", lambda x: x != 0))
    scored = v.crossJoin(F.broadcast(q)).select("key", I.cosine(F.col("vec"), F.col("emb")).alias("c"))  # q is one row
    return scored.orderBy(F.col("c").desc(), "key").limit(10).select("key", F.round("c", 6).alias("cosine"))


@query("""with c as (select doc_no, unnest(chunks) as c from build_docs) select count(*) as texts, count(distinct sha256(c.text)) as distinct_texts, count(distinct substr(sha256(c.text), 1, 32)) filter (where substr(sha256(c.text), 1, 32) not in (select key from emb)) as misses from c""")
def embedding_misses(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose vector is not in the content-addressed cache."""
    k = _chunks(spark, d).select(F.sha2("text", 256).alias("h")).withColumn("key", F.substring("h", 1, 32))
    total = k.agg(F.count("*").alias("texts"), F.count_distinct("h").alias("distinct_texts"))
    miss = k.select("key").distinct().join(table(spark, d, "emb").select("key"), "key", "left_anti").agg(F.count("*").alias("misses"))
    return total.crossJoin(miss)  # one row each
