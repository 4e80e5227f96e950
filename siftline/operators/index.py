"""Full text, postings and vectors of a document index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from ..runtime import shipped, stored

K1, B = 1.2, 0.75


def frequencies(texts: DataFrame, key: str, words: str) -> DataFrame:
    """(key, word, tf) from an array of words: counted in two steps, so a frequent word is no hot key of raw tokens."""
    return texts.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))


def bm25(words: DataFrame, sizes: DataFrame, key: str, query: list[str]) -> DataFrame:
    """(key, score) of texts that contain every query word, from (key, len, word, tf) and one row of (docs, avg). Only the
    rows of the query words are read where words are stored by word; document frequencies are one aggregation."""
    wanted = list(dict.fromkeys(query))
    tf = words.where(F.col("word").isin(wanted)).select(key, "len", "word", "tf")
    df = tf.groupBy("word").agg(F.count("*").alias("df"))  # a row for each query word
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = tf.join(F.broadcast(df), "word").crossJoin(F.broadcast(sizes))  # sizes is one row
    return scored.groupBy(key).agg(F.sum(part).alias("score"), F.count("*").alias("n")).where(F.col("n") == len(wanted)).drop("n")


def bitmaps(rows: DataFrame, item: str = "doc_no", width: int = 32768) -> DataFrame:
    """(…, bucket, bits): the items of each group of the other columns as bitmaps, one for each ``width`` numbers."""
    others = [c for c in rows.columns if c != item]
    return rows.groupBy(*others, F.floor(F.col(item) / width).cast("int").alias("bucket")).agg(F.bitmap_construct_agg(F.col(item) % width).alias("bits"))


def members_of(packed: DataFrame, item: str = "doc_no", width: int = 32768) -> DataFrame:
    """(…, item): the numbers of bitmaps given in base64."""
    others = [c for c in packed.columns if c not in ("bucket", "bits")]
    rows = once(packed, __h=F.hex(F.unbase64("bits")))
    spelt = rows.select(*others, "bucket", F.posexplode(F.regexp_extract_all("__h", F.lit("[0-9A-F]{8}"), F.lit(0))).alias("i", "h")).where("h <> '00000000'")  # four bytes each
    byte = spelt.select(*others, "bucket", "i", F.posexplode(F.regexp_extract_all("h", F.lit(".."), F.lit(0))).alias("j", "b")).where("b <> '00'")
    bits = byte.select(*others, "bucket", "i", "j", F.conv("b", 16, 10).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).where("(shiftright(b, k) & 1) = 1")
    return bits.select(*others, (F.col("bucket") * width + F.col("i") * 32 + F.col("j") * 8 + F.col("k")).cast("int").alias(item))


def bitmaps_or(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bitmaps with the members of both."""
    others = [c for c in old.columns if c != "bits"]
    return old.union(new.select(*old.columns)).groupBy(*others).agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmaps_without(old: DataFrame, off: DataFrame, on: list[str]) -> DataFrame:
    """Bitmaps without the members of ``off``, which meet by ``on``: of a join's two maps the second is turned over and
    both are combined; groups without a partner stay as they are."""
    joined = old.join(off.select(*on, F.col("bits").alias("__off")), on, "left")
    words = lambda c: F.regexp_extract_all(F.hex(c), F.lit("[0-9A-F]{8}"), F.lit(0))
    both = once(joined, __x=F.when(F.col("__off").isNotNull(), words(F.col("bits"))), __y=words(F.col("__off")))
    number = lambda h: F.conv(h, 16, 10).cast("bigint")
    left = F.zip_with("__x", "__y", lambda x, y: F.when(y == "00000000", x).otherwise(F.lpad(F.hex(number(x).bitwiseAND(F.bitwise_not(number(y)))), 8, "0")))
    return both.select(*old.columns[:-1], F.coalesce(F.unhex(F.array_join(left, "")), F.col("bits")).alias("bits"))


def phrase_pattern(words: Column) -> Column:
    """A pattern for neighbouring words by their stems, from an array of words: words of more than four characters lose
    their last two, but keep four."""
    stem = lambda w: F.when(F.length(w) <= 4, w).otherwise(F.substring(w, F.lit(1), F.greatest(F.lit(4), F.length(w) - 2)))
    return F.concat(F.lit(r"(?i)\b"), F.array_join(F.transform(words, lambda w: F.concat(stem(w), F.lit(r"\w*"))), r"\W+"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def tagged(doc_terms: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_id, doc_no, ev, said): first channel. ev is the best level of the claims of a document; a topic that only a
    model names is no member by that, its level goes to ``said`` and counts where another channel makes a member."""
    from .extract import level_rank

    rank = F.greatest(F.lit(1), level_rank(F.col("level")))
    only_said = (F.col("via") == "llm") & (F.col("kind") == "topic")
    rows = doc_terms.where("term_id is not null").join(terms.select("term_id", "kind"), "term_id")
    return rows.groupBy("term_id", "doc_no").agg(F.max(F.when(F.coalesce(~only_said, F.lit(True)), rank)).alias("ev"), F.max(F.when(only_said, rank)).alias("said"))


def form_words(terms: DataFrame, least: int = 4) -> DataFrame:
    """(form, term_id, words): the sure forms of each term as words; single words shorter than ``least`` are left out."""
    none = F.array().cast("array<string>")
    forms = terms.select("term_id", F.explode(F.concat(F.array("canonical"), F.coalesce("aliases", none))).alias("form"), F.transform(F.coalesce("ambiguous", none), lambda x: F.lower(x)).alias("unsure"))
    sure = forms.where(~F.array_contains("unsure", F.lower("form"))).select("term_id", F.regexp_extract_all(F.lower("form"), F.lit("[a-z0-9]+"), F.lit(0)).alias("words"))
    return sure.where((F.size("words") > 1) | (F.length(F.get("words", F.lit(0))) >= least)).where("size(words) > 0").distinct().select(F.concat_ws(" ", F.col("term_id").cast("string"), "words").alias("form"), "term_id", "words")


def mentioned(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_id, doc_no, bm25): second channel, full text. A chunk of experience with all words of a sure form, several
    words as neighbouring stems, scores by BM25 over all chunks; the best chunk of a document counts.

    chunks: (chunk, doc_no, kind, text). Only words of forms leave the chunks; the words and the forms meet in equi-joins."""
    forms = form_words(terms)
    wanted = forms.select(F.explode("words").alias("word")).distinct()
    words = chunks.select("chunk", "doc_no", "kind", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("ws")).where("ws is not null")
    totals = words.agg(F.count("*").alias("docs"), F.avg(F.size("ws")).alias("avg"))
    tf = words.select("chunk", "doc_no", "kind", F.size("ws").alias("len"), F.explode("ws").alias("word")).join(wanted, "word", "left_semi").groupBy("chunk", "doc_no", "kind", "len", "word").agg(F.count("*").alias("tf"))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    scored = tf.where("kind = 'experience'").join(df, "word").crossJoin(totals).select("chunk", "doc_no", "word", part.alias("part"))  # totals is one row
    each = forms.select("form", "term_id", F.array_distinct("words").alias("ws"), F.size("words").alias("many"), phrase_pattern(F.col("words")).alias("pattern"))
    met = scored.join(each.select("form", "term_id", "many", "pattern", F.size("ws").alias("n"), F.explode("ws").alias("word")), "word")
    hits = met.groupBy("chunk", "doc_no", "form", "term_id", "many", "pattern", "n").agg(F.sum("part").alias("score"), F.count("*").alias("k")).where("k = n")
    sure = hits.where("many = 1").select("term_id", "doc_no", "score")
    several = hits.where("many > 1").join(chunks.select("chunk", "text"), "chunk").where("text rlike pattern").select("term_id", "doc_no", "score")
    return sure.union(several).groupBy("term_id", "doc_no").agg(F.max("score").alias("bm25"))


#: Bytes of term vectors that go to every worker at once; more take a pass over the chunks for each block.
BLOCK_BYTES = 32 << 20


def near_terms(chunks: DataFrame, terms: DataFrame, tau: float) -> DataFrame:
    """(term_id, doc_no, cosine): third channel. Cosine of the vectors of terms and of chunks, those about education
    aside, where it reaches ``tau``; the best chunk of a document counts. Terms, a vocabulary, are multiplied with whole
    batches of chunks, in blocks of a bounded size. Vectors that are null, zero or of another size match nothing.

    chunks: (doc_no, kind, vec); terms: (term_id, emb)."""
    shipped(chunks.sparkSession)
    rows = chunks.where("vec is not null and not kind <=> 'education'").select("doc_no", F.col("vec").cast("array<double>").alias("vec"))
    schema = f"term_id bigint, doc_no {rows.schema['doc_no'].dataType.simpleString()}, cosine double"
    out = None
    for ids, matrix in _blocks(terms.where("emb is not null").select(F.col("term_id").cast("bigint").alias("term_id"), F.col("emb").cast("array<double>").alias("emb"))):
        part = rows.mapInArrow(_multiplied(rows, ids, matrix, tau), schema)
        out = part if out is None else out.union(part)
    if out is None:
        return chunks.sparkSession.createDataFrame([], schema)
    return out.groupBy("term_id", "doc_no").agg(F.max("cosine").alias("cosine"))


def _blocks(terms: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    by_size: dict[int, list] = {}
    for r in terms.toLocalIterator():
        v = np.array(r["emb"], float)
        norm = np.linalg.norm(v) if len(v) and np.isfinite(v).all() else 0.0
        if norm > 0:
            block = by_size.setdefault(len(v), [])
            block.append((r["term_id"], v / norm))
            if len(block) * len(v) * 8 >= BLOCK_BYTES:
                yield np.array([i for i, _ in block]), np.stack([x for _, x in block])
                block.clear()
    for block in by_size.values():
        if block:
            yield np.array([i for i, _ in block]), np.stack([x for _, x in block])


def _multiplied(rows: DataFrame, ids: np.ndarray, matrix: np.ndarray, tau: float):
    shared = rows.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, t = shared.value
        size = t.shape[1]
        for batch in batches:
            vec = batch.column(1)
            right = np.flatnonzero(np.asarray(vec.value_lengths()) == size)
            x = vec.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(len(right), size)
            norm = np.sqrt((x * x).sum(axis=1))
            ok = np.isfinite(norm) & (norm > 0)
            right, x = right[ok], x[ok] / norm[ok, None]
            score = x @ t.T
            i, j = np.nonzero(score >= tau)
            yield pa.RecordBatch.from_arrays([pa.array(names[j], pa.int64()), batch.column(0).take(pa.array(right[i])), pa.array(score[i, j])], names=["term_id", "doc_no", "cosine"])

    return run


def sure(doc_terms: DataFrame, terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """(term_id, doc_no, ev, said, bm25) of the first two channels."""
    null = F.lit(None)
    claims = tagged(doc_terms, terms).select("term_id", "doc_no", "ev", "said", null.cast("double").alias("bm25"))
    return claims.union(mentioned(chunks, terms).select("term_id", "doc_no", null.cast("int"), null.cast("int"), "bm25"))


def inherited(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_id, doc_no, ev, said, bm25): claims and mentions of skills for all topics they imply, over any number of steps."""
    from .extract import closure

    names = terms.select("slug", "term_id")
    up = closure(terms).where("slug <> implied").join(names, "slug").join(names.select(F.col("slug").alias("implied"), F.col("term_id").alias("topic")), "implied").select("term_id", "topic").distinct()
    return rows.where("ev is not null or bm25 is not null").join(up, "term_id").select(F.col("topic").alias("term_id"), "doc_no", "ev", F.lit(None).cast("int").alias("said"), "bm25")


def postings(doc_terms: DataFrame, terms: DataFrame, chunks: DataFrame, tau: float = 0.5) -> DataFrame:
    """(term_id, doc_no, evidence, bm25, cosine, strong, used, weak): members of every term from three channels.

    Strong are claims and mentions in full text, used those claimed at level 2 or more, weak what only a cosine of tau
    makes near, so weak and strong share nothing. A topic inherits claims and mentions, not cosines, of all skills that
    imply it over any number of steps. Scores are 0 where a channel has none. The channels meet in one aggregation.

    chunks: (chunk, doc_no, kind, text, vec)."""
    null = F.lit(None)
    found = stored(sure(doc_terms, terms, chunks))
    dense = near_terms(chunks, terms, tau).select("term_id", "doc_no", null.cast("int").alias("ev"), null.cast("int").alias("said"), null.cast("double").alias("bm25"), "cosine")
    all_ = found.union(inherited(found, terms)).withColumn("cosine", null.cast("double")).union(dense)
    best = all_.groupBy("term_id", "doc_no").agg(*[F.max(c).alias(c) for c in ("ev", "said", "bm25", "cosine")])
    strong = F.col("ev").isNotNull() | F.col("bm25").isNotNull()
    evidence = F.when(strong, F.coalesce(F.greatest("ev", "said"), F.lit(0))).otherwise(0)
    rows = best.select(F.col("term_id").cast("bigint").alias("term_id"), "doc_no", evidence.alias("evidence"), F.coalesce("bm25", F.lit(0.0)).alias("bm25"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"), strong.alias("strong"), (evidence >= 2).alias("used"), (~strong & F.col("cosine").isNotNull()).alias("weak"))
    return rows.where("strong or weak")
