"""Dictionary scan: the longest forms of a vocabulary in a text, from left to right, without overlaps."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shipped, stored

TOKEN = re.compile(r"[a-z0-9][a-z0-9+#./&'-]*[a-z0-9+#]|[a-z0-9]")
LONGEST = 5
#: Forms that may go to every worker; a vocabulary is curated by hand and far below it.
FORM_LIMIT = 2_000_000


def longest_matches(tokens: list[str], forms: dict[tuple[str, ...], tuple[int, bool]]) -> list[tuple[int, bool]]:
    out, i = [], 0
    while i < len(tokens):
        for n in range(min(LONGEST, len(tokens) - i), 0, -1):
            hit = forms.get(tuple(tokens[i : i + n]))
            if hit:
                out.append(hit)
                i += n
                break
        else:
            i += 1
    return out


def scan(docs: DataFrame, key: str, text: str, terms: DataFrame, sure_only: bool = True) -> DataFrame:
    """(key, term_id, hits): terms by their names and aliases; forms of ``ambiguous`` count only in texts that also
    hold a sure form of the term, unless ``sure_only`` is off: then (key, term_id, hits, sure) has all. Null texts give no rows. A greedy scan depends on the order of tokens, which built-in
    expressions can't follow, so it runs in Arrow batches; nothing is shuffled."""
    shipped(docs.sparkSession)
    listed = terms.select("term_id", F.concat(F.array("canonical"), F.coalesce("aliases", F.array().cast("array<string>"))).alias("forms"), F.coalesce("ambiguous", F.array().cast("array<string>")).alias("unsure"))
    rows = listed.select("term_id", F.explode("forms").alias("form"), "unsure").limit(FORM_LIMIT + 1).collect()
    if len(rows) > FORM_LIMIT:
        raise ValueError("the vocabulary is too large to be sent to every worker")
    forms: dict[tuple[str, ...], tuple[int, bool]] = {}
    for r in sorted(rows, key=lambda r: -r["term_id"]):
        parts = tuple(TOKEN.findall(r["form"].lower()))
        if 0 < len(parts) <= LONGEST:
            forms[parts] = (r["term_id"], r["form"] not in r["unsure"])
    shared = docs.sparkSession.sparkContext.broadcast(forms)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            owner, term, hits, certain = [], [], [], []
            for i, value in enumerate(batch.column(1)):
                count: dict[int, list[int]] = {}
                for t, sure in longest_matches(TOKEN.findall(value.as_py().lower()), known):
                    count.setdefault(t, [0, 0])[sure] += 1
                for t, (unsure, sure) in count.items():
                    if sure or not sure_only:
                        certain.append(sure)
                        owner.append(i)
                        term.append(t)
                        hits.append(unsure + sure)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(term, pa.int64()), pa.array(hits, pa.int64()), pa.array(certain, pa.int64())], names=["key", "term_id", "hits", "sure"])

    found = docs.select(F.col(key), F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, f"key {kind}, term_id bigint, hits bigint, sure bigint")
    return found.drop("sure") if sure_only else found


def extracted(docs: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """(key, term_id, level, evidence, section): the terms that a document names, each at its best level with the line that
    says so. Lines of experience say 'used', those that open with a verb of leading 'led', the headline and all other
    sections 'listed'; education and sections to skip say nothing.

    An ambiguous form counts where the document also holds a sure form of the term, or its section a word of the term's
    ``context`` (array, if the table has one; of several words all must be there); what counts once counts everywhere.
    Lines are scanned where they are parsed; marks of certainty meet by document and term."""
    from . import extract

    lines = extract.parsed_lines(docs.where(F.col(key).isNotNull()).select(key, text).distinct(), key, text).where("role in ('headline', 'entry', 'line') and not coalesce(kind in ('education', 'skip'), false)")
    rows = lines.select(F.concat_ws("\x1f", F.col(key).cast("string"), "line_no").alias("__k"), key, "line_no", "role", "kind", "section", F.col("text").alias("t"))
    rows = stored(rows)
    hits = scan(rows, "__k", "t", terms, sure_only=False).withColumnRenamed("key", "__k")
    level = F.when(F.coalesce(F.col("kind") != "experience", F.lit(True)), 1).when(F.col("t").rlike(extract.LEADING), 3).otherwise(2)
    met = stored(rows.join(hits, "__k").select(key, "line_no", F.coalesce("section", F.lit("headline")).alias("section"), "term_id", "sure", level.alias("level"), F.substring("t", 1, 200).alias("evidence")))
    confirmed = met.where("sure > 0").select(key, "term_id")
    if "context" in terms.columns:
        words = terms.select("term_id", F.explode("context").alias("phrase")).select("term_id", "phrase", F.array_distinct(F.regexp_extract_all(F.lower("phrase"), F.lit(TOKEN.pattern), F.lit(0))).alias("ws")).where("size(ws) > 0")
        there = rows.select(key, F.coalesce("section", F.lit("headline")).alias("section"), F.explode(F.regexp_extract_all(F.lower("t"), F.lit(TOKEN.pattern), F.lit(0))).alias("word")).distinct()
        open_ = met.where("sure = 0").select(key, "section", "term_id").distinct().join(words.select("term_id", "phrase", F.size("ws").alias("n"), F.explode("ws").alias("word")), "term_id")
        said = open_.join(there, [key, "section", "word"]).groupBy(key, "section", "term_id", "phrase", "n").count().where("count = n")
        confirmed = confirmed.union(said.select(key, "term_id"))
    kept = met.join(confirmed.distinct(), [key, "term_id"], "left_semi")
    best = kept.groupBy(key, "term_id").agg(F.max(F.struct("level", (-F.col("line_no")).alias("first"), "evidence", "section")).alias("b"))
    names = F.element_at(F.array(*map(F.lit, extract.LEVELS)), F.col("b.level"))
    return best.select(key, "term_id", names.alias("level"), "b.evidence", "b.section")


def hashed_embedding(texts: DataFrame, key: str, text: str, size: int = 64) -> DataFrame:
    """(key, vec, tokens): a deterministic unit vector of each text from its hashed tokens, for tests without a model."""
    import xxhash

    shipped(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs, sizes = [], []
            for value in batch.column(1):
                t = value.as_py()
                v = np.zeros(size)
                for w in TOKEN.findall(t.lower()):
                    h = xxhash.xxh3_64_intdigest(w)
                    v[h % size] += 1 if h >> 63 else -1
                n = np.linalg.norm(v)
                vecs.append((v / n if n else v).astype(np.float32))
                sizes.append(max(1, len(t) // 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tolist() for x in vecs], pa.list_(pa.float32())), pa.array(sizes, pa.int64())], names=["key", "vec", "tokens"])

    return texts.select(F.col(key), F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, f"key {kind}, vec array<float>, tokens bigint")


def near_names(names: DataFrame, key: str, name: str, least: float) -> DataFrame:
    """(key, near, edits, alike): pairs of names, each once, that are alike: 1 - edits / length of the longer is ``least``
    or more. Of a name cut into as many segments as edits are allowed and one more, one at least is left whole, at a place
    moved by no more than the edits; segments meet in an equality join and edits are then counted."""
    one = names.where(F.length(name) > 0).select(F.col(key).alias("k"), F.col(name).alias("n")).distinct()
    allowed = lambda longest: F.floor(longest * (1 - least) + 1e-9).cast("int")
    sized = one.select("k", "n", F.length("n").alias("len")).withColumn("most", allowed(F.floor(F.col("len") / least + 1e-9)))
    parts = F.col("most") + 1
    cut = lambda i: F.floor(F.col("len") * i / parts).cast("int")
    held = sized.select("k", "n", "len", "most", F.explode(F.transform(F.sequence(F.lit(0), F.col("most")), lambda i: F.struct(cut(i).alias("at"), F.substring(F.col("n"), cut(i) + 1, cut(i + 1) - cut(i)).alias("s")))).alias("x"))
    held = held.select("k", "n", "len", "most", "x.at", "x.s").where("s <> ''")
    sizes = held.select(F.length("s").alias("l")).distinct()
    spots = sized.join(sizes, F.col("l") <= F.col("len")).select("k", "n", F.explode(F.transform(F.sequence(F.lit(0), F.col("len") - F.col("l")), lambda i: F.struct(i.alias("at"), F.substring(F.col("n"), i + 1, F.col("l")).alias("s")))).alias("x"))
    a, b = held.alias("a"), spots.select("k", "n", "x.at", "x.s").distinct().alias("b")
    met = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.abs(F.col("a.at") - F.col("b.at")) <= F.col("a.most"))).select(F.least("a.k", "b.k").alias("k"), F.greatest("a.k", "b.k").alias("near"), F.when(F.col("a.k") < F.col("b.k"), F.col("a.n")).otherwise(F.col("b.n")).alias("x"), F.when(F.col("a.k") < F.col("b.k"), F.col("b.n")).otherwise(F.col("a.n")).alias("y")).where("k <> near").distinct()
    scored = met.withColumn("edits", F.levenshtein("x", "y")).withColumn("alike", F.round(1 - F.col("edits") / F.greatest(F.length("x"), F.length("y")), 6))
    return scored.where(F.col("alike") >= least).select(F.col("k").alias(key), "near", "edits", "alike")
