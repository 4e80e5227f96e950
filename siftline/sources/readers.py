"""Sources and sinks of documents, vectors, judgments and ledgers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import shipped
from .files import Files

RAW = "source string, source_id string, category string, markdown string, meta map<string,string>"
_BLOCK = {"p", "div", "section", "article", "tr", "table", "ul", "ol", "header", "footer"}
_SKIP = {"script", "style", "head"}


class _Markdown(HTMLParser):
    """HTML read once from front to end: headings, list items, rows and breaks become lines of markdown."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines, self.now, self.mark, self.silent = [], [], "", 0

    def _end(self) -> None:
        text = " ".join("".join(self.now).split())
        if text:
            self.lines.append(self.mark + text)
        self.now, self.mark = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.silent += 1
        elif tag[:1] == "h" and tag[1:].isdigit():
            self._end()
            if self.lines:
                self.lines.append("")
            self.mark = "#" * min(int(tag[1:]), 6) + " "
        elif tag == "li":
            self._end()
            self.mark = "- "
        elif tag in ("td", "th"):
            self.now.append(" ")
        elif tag == "br" or tag in _BLOCK:
            self._end()

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.silent = max(0, self.silent - 1)
        elif tag == "li" or tag in _BLOCK or (tag[:1] == "h" and tag[1:].isdigit()):
            self._end()

    def handle_data(self, data):
        if not self.silent:
            self.now.append(data)


def html_to_markdown(html: str | None) -> str | None:
    """Markdown of a page; null stays null, a page without text is empty."""
    if html is None:
        return None
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parser._end()
    return "\n".join(parser.lines).strip("\n")


@F.pandas_udf(T.StringType())
def _html(values: pd.Series) -> pd.Series:
    return values.map(html_to_markdown)


def csv_html(spark: SparkSession, path: str, source: str, least: int = 30) -> DataFrame:
    """Rows (ID, Resume_str, Resume_html, Category): the HTML where it has ``least`` words, else the plain text."""
    shipped(spark)
    schema = "ID string, Resume_str string, Resume_html string, Category string"
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=schema)
    rows = rows.withColumn("md", _html("Resume_html"))
    enough = F.size(F.regexp_extract_all("md", F.lit(r"\S+"), F.lit(0))) >= least
    plain = F.trim(F.regexp_replace("Resume_str", " {3,}", "\n"))
    text = F.when(enough, F.col("md")).otherwise(plain)
    headed = F.when(text.rlike("(?m)^# "), text).otherwise(F.concat(F.lit("# "), F.initcap(F.coalesce("Category", F.lit("Document"))), F.lit("\n\n"), text))
    return rows.select(F.lit(source).alias("source"), F.col("ID").alias("source_id"), F.col("Category").alias("category"), headed.alias("markdown"), F.create_map().cast("map<string,string>").alias("meta"))


def csv_text(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Rows (Category, Resume), each text once, named by its hash; glued markers of sections become headings."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema="Category string, Resume string").where("Resume is not null")
    marked = F.regexp_replace("Resume", r"(Education|Skill|Company) Details", "\n## $1\n")
    rows = rows.select("Category", F.regexp_replace(marked, r"\s*[•*] +", "\n- ").alias("text"), F.substring(F.sha2("Resume", 256), 1, 12).alias("source_id")).groupBy("source_id").agg(F.min("Category").alias("category"), F.min("text").alias("text"))
    return rows.select(F.lit(source).alias("source"), "source_id", "category", F.concat(F.lit("# "), F.coalesce("category", F.lit("Document")), F.lit("\n\n"), F.trim("text")).alias("markdown"), F.create_map().cast("map<string,string>").alias("meta"))


def markdown_files(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Markdown files by name; keys of a front matter between lines of dashes become meta, the items of a list joined by
    commas. Of a key given twice the last value counts."""
    rows = spark.read.text(f"{folder}/*.md", wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    front = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n", 1)
    body = F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")
    lines = F.filter(F.split(front, r"\r?\n"), lambda x: x.rlike(r"^[\w-]+ *:"))
    listed = F.regexp_replace(front, r"(?m)\r?\n[ \t]*- +([^\r\n]*)", "\x1f$1")  # items of a list follow their key
    lines = F.filter(F.split(listed, r"\r?\n"), lambda x: x.rlike(r"^[\w-]+ *:"))
    bare = lambda v: F.trim(F.trim(v), F.lit("\"'"))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"(?s)^[\w-]+ *:(.*)$", 1)), r"^\[(.*)\]$", "$1")
    items = lambda v: F.filter(F.transform(F.split(v, "\x1f"), bare), lambda y: y != "")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([\w-]+) *:", 1)), F.array_join(items(value(x)), ", ")))
    meta = F.map_from_entries(pairs)
    return rows.select(F.lit(source).alias("source"), F.regexp_replace("file", r"\.md$", "").alias("source_id"), F.try_element_at(meta, F.lit("category")).alias("category"), body.alias("markdown"), meta.alias("meta"))


LOADERS: dict[str, Callable[..., DataFrame]] = {"csv_html": csv_html, "csv_text": csv_text, "markdown_files": markdown_files}


def load(spark: SparkSession, sources: list[tuple[str, str, str]], optional: tuple[str, ...] = ()) -> DataFrame:
    """All sources as one table. sources: (name, loader, path). A missing path is an error unless the name is optional."""
    out = spark.createDataFrame([], RAW)
    for name, loader, path in sources:
        if not Files(spark, path).exists():
            if name in optional:
                continue
            raise FileNotFoundError(f"DATA_MISSING: {path}")
        out = out.unionByName(LOADERS[loader](spark, path, name), allowMissingColumns=True)
    return out


def ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; broken ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def judgments(spark: SparkSession, path: str) -> DataFrame:
    """The first score that came for each document of a judgment, else a row without score."""
    rows = spark.read.parquet(path)
    first = F.min(F.when(F.col("score").isNotNull(), F.struct("created_at", "score", "note"))).alias("f")
    return rows.groupBy("judgment_id", "doc_no").agg(first, F.min("created_at").alias("since")).select("judgment_id", "doc_no", F.col("f.score").alias("score"), F.col("f.note").alias("note"), "since")


def append_judgments(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def publish(df: DataFrame, folder: str, check: Callable[[DataFrame], bool] = lambda d: not d.isEmpty(), keep: int = 2) -> str:
    """Writes a new version, checks it, then moves the pointer file in one step; old versions beyond ``keep`` are removed.
    Readers of the old version are not disturbed. The folder may lie in any file system that Spark reads."""
    spark = df.sparkSession
    files = Files(spark, folder)
    number = lambda v: int(v[2:].split("-")[0])
    old = sorted((v for v in files.names() if v.startswith("v=")), key=number)
    name = f"v={number(old[-1]) + 1 if old else 1}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{folder}/{name}")
    if not check(spark.read.parquet(f"{folder}/{name}")):
        raise ValueError(f"the new version failed its check: {folder}/{name}")
    files.replace(name, "CURRENT")
    for v in old[: max(0, len(old) + 1 - keep)]:
        files.delete(v)
    return name


def current(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{Files(spark, folder).read('CURRENT').strip()}")


def write_corpus(docs: DataFrame, folder: str, key: str = "id", text: str = "markdown") -> DataFrame:
    """Brings a corpus up to date and gives one row (written, unchanged, deleted, total). Rows whose text has the same hash
    as in the version before are counted as unchanged; what is no longer there is gone from the new version; a corpus
    without any change makes no new version. Null keys are left out, of repeated keys one row stays."""
    spark = docs.sparkSession
    new = docs.where(F.col(key).isNotNull()).withColumn("hash", F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)).dropDuplicates([key])
    there = Files(spark, folder).exists("CURRENT")
    old = current(spark, folder).select(F.col(key).alias("__k"), F.col("hash").alias("__h")) if there else spark.createDataFrame([], "__k string, __h string")
    met = new.select(key, "hash").join(old, F.col(key) == F.col("__k"), "full")
    same = F.col("hash") == F.col("__h")
    stats = met.agg(F.count_if(F.col(key).isNotNull() & ~F.coalesce(same, F.lit(False))).alias("written"), F.count_if(same).alias("unchanged"), F.count_if(F.col(key).isNull()).alias("deleted"), F.count(key).alias("total"))
    row = stats.first()
    if row["written"] or row["deleted"] or not there:
        publish(new, folder, check=lambda d: True)
    return spark.createDataFrame([tuple(row)], stats.schema)


def export_vectors(store: DataFrame, path: str, fingerprint: str) -> None:
    """A pack of vectors (model, key, vec), compressed, with the fingerprint of what made them."""
    store.select("model", "key", "vec").dropDuplicates(["model", "key"]).withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").option("compression", "zstd").parquet(path)


def import_pack(spark: SparkSession, path: str, store: DataFrame, fingerprint: str) -> DataFrame:
    """What a pack adds to a store; a pack made by something else is an error, whatever part of it is."""
    pack = spark.read.parquet(path)
    if not pack.where(~F.col("fingerprint").eqNullSafe(fingerprint)).isEmpty():
        raise ValueError("FINGERPRINT: the pack was made by something else")
    return import_vectors(pack.drop("fingerprint"), store)


def import_vectors(pack: DataFrame, store: DataFrame) -> DataFrame:
    """The rows of a vector pack whose (model, key) the store lacks, once each."""
    return pack.join(store.select("model", "key"), ["model", "key"], "left_anti").dropDuplicates(["model", "key"])
