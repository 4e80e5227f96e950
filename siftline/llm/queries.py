"""Queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table, texts
from . import canonical, leaks, mixing, neardup, personal, segments, similar, spam, survivors

#: SQL of a list of words: maximal runs of letters, digits and underscores, lower-cased.
WORDS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


# 1: free values to canonical entries


def _named(spark: SparkSession, folder: str) -> DataFrame:
    terms = table(spark, folder, "terms").select("term_id", "kind", "canonical", "aliases")
    titles = table(spark, folder, "profile").select("doc_no", F.col("current_title").alias("value"))
    names = table(spark, folder, "doc_terms").where("term_id is null").select("doc_no", F.col("evidence").alias("value"))

    def part(field: str, rows: DataFrame, kinds: list[str]) -> DataFrame:
        rows = rows.where("value is not null and doc_no is not null").distinct()
        listed = terms.where(F.col("kind").isin(kinds))
        found = canonical.canonical(rows, "value", listed, "term_id", "canonical", "aliases")
        told = found.join(listed.select(F.col("term_id").cast("bigint").alias("term"), "canonical"), "term", "left").where("canonical is null or canonical <> value")
        return rows.join(told.select("value", "term", "edits"), "value").select(F.lit(field).alias("field"), F.col("doc_no").cast("bigint").alias("doc_no"), "value", F.coalesce("term", F.lit(-1)).cast("bigint").alias("term_id"), "edits")

    with ThreadPoolExecutor(2) as pool:  # the two lists have nothing to do with each other: their small jobs run side by side
        a, b = pool.map(part, ("current_title", "evidence"), (titles, names), (["title"], ["skill", "topic"]))
    return a.union(b)


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _named(spark, folder).select("field", "doc_no", "value", "term_id")


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values that mean no entry, with the number of records that have them."""
    return _named(spark, folder).where("term_id = -1").groupBy("field", "value").agg(F.count("*").alias("records"))


# 2: near-duplicate records


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    members, links = neardup.near_duplicates(texts(spark, folder, "docs"), "doc_no", "markdown", k=3, threshold=0.7)
    return neardup.all_pairs(members, links).select(F.col("a").cast("bigint").alias("doc_no_a"), F.col("b").cast("bigint").alias("doc_no_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document with its group at the default of five words and 0.8."""
    g = neardup.near_duplicate_groups(texts(spark, folder, "docs"), "doc_no", "markdown")
    return g.select(F.col("key").cast("bigint").alias("doc_no"), F.col("class").cast("bigint").alias("copy_class"), F.col("group").cast("bigint").alias("near_group"), "links")


def _shingle_sql(k: int) -> str:
    return f"""w as (select doc_no, {WORDS_SQL.format("markdown")} as ws from (select distinct doc_no, markdown from docs where markdown is not null)),
        s as (select distinct doc_no, list_aggregate(ws[i:i + {k - 1}], 'string_agg', ' ') as g from w, unnest(range(1, len(ws) - {k - 2})) as r(i)),
        n as (select doc_no, count(*) as n from s group by 1),
        c as (select a.doc_no as a, b.doc_no as b, count(*) as common from s a join s b on a.g = b.g and a.doc_no < b.doc_no group by 1, 2),
        p as (select c.a, c.b, common::double / (x.n + y.n - common) as j from c join n x on x.doc_no = c.a join n y on y.doc_no = c.b)"""


P2_FOUND_SQL = f"with {_shingle_sql(3)} select a::bigint as doc_no_a, b::bigint as doc_no_b from p where j >= 0.7"

P2_GROUPS_SQL = f"""with recursive {_shingle_sql(5)},
        mark as (select doc_no, string_agg(g, '|' order by g) as m from s group by 1),
        cls as (select doc_no, min(doc_no) over (partition by m) as class from mark),
        e as (select distinct x.class as a, y.class as b from p join cls x on x.doc_no = p.a join cls y on y.doc_no = p.b where j >= 0.8 and x.class <> y.class),
        e2 as (select a, b from e union select b, a from e),
        r as (select a as node, a as root from e2 union select e2.b, r.root from r join e2 on e2.a = r.node),
        g as (select node, min(root) as root from r group by 1),
        d as (select a, count(distinct b) as links from e2 group by 1)
        select cls.doc_no::bigint as doc_no, cls.class::bigint as copy_class, coalesce(g.root, cls.class)::bigint as near_group, coalesce(d.links, 0)::bigint as links
        from cls left join g on g.node = cls.class left join d on d.a = cls.class"""


# 3: most similar vectors


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    units = similar.usable(table(spark, folder, "emb"), "model", "key", "vec")
    near = similar.similar_keys(units, 0.9)
    pairs = near.select(F.col("grp").alias("model"), F.least("key", "other").alias("key_a"), F.greatest("key", "other").alias("key_b")).distinct()
    named = similar.nearest_reference(units.where("grp = 'hash-embed-96'"), table(spark, folder, "terms"), "slug", "emb", 0.8, 96)
    return pairs.union(named.select(F.lit("hash-embed-96").alias("model"), F.col("key").alias("key_a"), F.concat(F.lit("term:"), "ref").alias("key_b")))


P3_FOUND_SQL = """with v as (select distinct model, key, vec::double[] as vec from emb where (model = 'hash-embed-96' and len(vec) = 96 or model = 'hash-embed-48' and len(vec) = 48)
            and not list_contains(list_transform(vec, lambda x: x is null), true) and list_sum(list_transform(vec, lambda x: x * x)) > 0),
        c as (select a.model, a.key as k, b.key as o, list_cosine_similarity(a.vec, b.vec) as cos from v a join v b on a.model = b.model and a.key <> b.key),
        t as (select model, k, o, cos, row_number() over (partition by model, k order by round(cos, 9) desc, o) as rk from c),
        m as (select v.key, 'term:' || arg_max(slug, list_cosine_similarity(vec, emb::double[])) as o, max(list_cosine_similarity(vec, emb::double[])) as cos from v, terms where model = 'hash-embed-96' group by 1)
        select distinct model, least(k, o) as key_a, greatest(k, o) as key_b from t where rk <= 5 and cos >= 0.9
        union all select 'hash-embed-96', key, o from m where cos >= 0.8"""


# 5: personal details


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder, "docs").select(F.lit("docs").alias("tbl"), F.col("doc_no").cast("bigint").alias("rec_no"), "markdown")
    return docs.union(texts(spark, folder, "raw_docs").select(F.lit("raw_docs"), F.col("raw_no").cast("bigint"), "markdown"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with details that get a keyed surrogate; the key here is a public example."""
    return personal.found_lines(_texts(spark, folder), ["tbl", "rec_no"], "markdown").withColumnRenamed("line", "line_no")


def p5_placeholders(spark: SparkSession, folder: str) -> DataFrame:
    """All texts with typed placeholders."""
    return personal.masked(_texts(spark, folder), ["tbl", "rec_no"], "markdown")


def p5_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All texts with keyed surrogates; the key here is a public example."""
    return personal.masked(_texts(spark, folder), ["tbl", "rec_no"], "markdown", surrogate_key=b"example")


# 6: best representative of each group


def _survivors(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "docs").select("doc_no", "dup_group", "source", "words", "added_at", "deleted")
    return survivors.survivors(docs, table(spark, folder, "profile").select("doc_no", "rate", "rate_source"), table(spark, folder, "doc_terms").select("doc_no", "term_id"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [F.coalesce(c, F.lit(-1)).cast("bigint").alias(c) for c in ("text_doc_no", "date_doc_no", "rate_doc_no")]
    return _survivors(spark, folder).select(F.col("grp").cast("bigint").alias("dup_group"), *parts)


def p6_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """The surviving records with their rate and every term judged true by the quality model."""
    return _survivors(spark, folder)


P6_FOUND_SQL = """with d as (select distinct doc_no, dup_group, words, added_at from docs where not coalesce(deleted, false) and dup_group is not null),
        m as (select dup_group from d group by 1 having count(distinct doc_no) > 1),
        l as (select d.* from d join m using (dup_group)),
        p as (select distinct doc_no, coalesce(not contains(lower(rate_source), 'synthetic'), false) as stated from profile where rate is not null),
        t as (select dup_group, doc_no, row_number() over (partition by dup_group order by words desc nulls last, added_at desc nulls last, doc_no desc) as k from l),
        a as (select dup_group, doc_no, row_number() over (partition by dup_group order by added_at desc, doc_no desc) as k from l where added_at is not null),
        r as (select dup_group, l.doc_no, row_number() over (partition by dup_group order by stated desc, added_at desc nulls last, l.doc_no desc) as k from l join p using (doc_no))
        select m.dup_group::bigint as dup_group, t.doc_no::bigint as text_doc_no, coalesce(a.doc_no, -1)::bigint as date_doc_no, coalesce(r.doc_no, -1)::bigint as rate_doc_no
        from m join t on t.dup_group = m.dup_group and t.k = 1 left join a on a.dup_group = m.dup_group and a.k = 1 left join r on r.dup_group = m.dup_group and r.k = 1"""


# 7: splitting oversized texts


def _oversized(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder, "docs").select(F.col("doc_no").cast("bigint").alias("doc_no"), F.lit(-1).cast("bigint").alias("idx"), F.col("markdown").alias("text"))
    chunks = texts(spark, folder, "build_docs").select(F.col("doc_no").cast("bigint").alias("doc_no"), F.explode("chunks").alias("c")).select("doc_no", F.col("c.idx").cast("bigint").alias("idx"), F.col("c.text").alias("text"))
    return segments.pieces(docs, ["doc_no", "idx"], "text", over=1000).union(segments.pieces(chunks, ["doc_no", "idx"], "text"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return _oversized(spark, folder).where("piece = 1").select("doc_no", "idx").distinct()


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of texts over their limit, by document, with the offsets that put them together again."""
    return _oversized(spark, folder)


P7_FOUND_SQL = """select distinct doc_no::bigint as doc_no, (-1)::bigint as idx from docs where length(markdown) // 4 > 1000
        union select doc_no::bigint, c.idx::bigint from (select doc_no, unnest(chunks) as c from build_docs) where length(c.text) // 4 > 350"""


# 8: leaked test items


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leaks.leaks(texts(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")
    return found.where("exact > 0").select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"))


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the items that leaked into them, as they are or with numbers, units and names exchanged."""
    found = leaks.leaks(texts(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "exact", "reworded")


P8_FOUND_SQL = f"""with d as (select doc_id, {WORDS_SQL.format("text")} as ws from (select distinct doc_id, text from documents)),
        i as (select item_id, {WORDS_SQL.format("text")} as ws from eval_items),
        dg as (select distinct doc_id, list_aggregate(ws[r.n:r.n + 12], 'string_agg', ' ') as g from d, unnest(range(1, len(ws) - 11)) as r(n)),
        ig as (select distinct item_id, list_aggregate(ws[r.n:r.n + 12], 'string_agg', ' ') as g from i, unnest(range(1, len(ws) - 11)) as r(n))
        select distinct doc_id::bigint as doc_id, item_id::bigint as item_id from dg join ig using (g)"""


# 9: mixing sources


def _mixed(spark: SparkSession, folder: str, ranks: bytes | None = None) -> tuple[DataFrame, DataFrame]:
    return mixing.mixed(texts(spark, folder, "documents"), "doc_id", "source", "text", table(spark, folder, "mix_targets"), ranks=ranks)


def _ranks() -> bytes:
    """The rank file of a public byte-level vocabulary for many languages, read on the driver."""
    import public_tokenizers  # only these queries need it

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of the mix with the number of times each is used."""
    return _mixed(spark, folder)[0].withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each target source in the mix."""
    return _mixed(spark, folder)[1]


def p9_tokenized(spark: SparkSession, folder: str) -> DataFrame:
    """The mix whose sizes are in tokens of a tokenizer; those of p9_mix are the four characters of TESTDATA.md."""
    return _mixed(spark, folder, _ranks())[0].withColumnRenamed("key", "doc_id")


def p9_tokenized_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of each target source in that mix."""
    return _mixed(spark, folder, _ranks())[1]


_MIX_SQL = r"""with d as (select distinct doc_id, source, text from documents where text is not null and source is not null),
        w as (select doc_id, source, greatest(1, length(text) // 4)::bigint as tokens, greatest(0.05, length(regexp_replace(text, '[^\p{L}]+', '', 'g')) / greatest(1, length(text))::double) as weight from d),
        a as (select source, sum(tokens) as available, count(*) as documents from w group by 1),
        g as (select min(available * max_repeats / target_share) as t from a join mix_targets using (source)),
        p as (select m.source, target_share, max_repeats::bigint as max_repeats, coalesce(documents, 0) as documents, coalesce(available, 0) as available, target_share * t as budget,
            case when available > 0 then least(max_repeats, floor(target_share * t / available)) else 0 end::bigint as epochs from mix_targets m left join a using (source), g),
        q as (select *, case when epochs < max_repeats then budget - epochs * available else 0 end as rest from p),
        k as (select doc_id, w.source, tokens, epochs, rest, sum(tokens) over (partition by w.source order by ln((('0x' || substr(md5(doc_id || ':0'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / weight desc, doc_id
            rows unbounded preceding) as upto from w join q using (source)),
        c as (select doc_id, source, tokens, (epochs + (upto <= rest)::int)::bigint as copies from k where epochs + (upto <= rest)::int > 0)"""

P9_MIX_SQL = f"{_MIX_SQL} select doc_id, source, tokens, copies from c"

P9_SHARES_SQL = f"""{_MIX_SQL}, u as (select source, sum(tokens * copies) as used from c group by 1)
        select q.source, target_share, max_repeats, documents, available::bigint as available, budget, coalesce(used, 0)::bigint as tokens, coalesce(used / (select sum(used) from u)::double, 0) as actual_share,
        coalesce(used, 0) >= budget * 0.99 as reached from q left join u using (source)"""


# 10: keyword-stuffed and link-list pages


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.stuffed_pages(texts(spark, folder, "documents"), "doc_id", "text").where("stuffed").select(F.col("key").alias("doc_id"))


def p10_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Share of spam lines and mean bits of every page."""
    return spam.stuffed_pages(texts(spark, folder, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {name.lower()[:-4]: sql for name, sql in globals().items() if name[0] == "P" and name.endswith("_SQL") and isinstance(sql, str)}
