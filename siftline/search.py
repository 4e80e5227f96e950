"""The interface: criteria compiled to a plan, saved filters, views, facets and pages.

    index = Index.open(spark, folder)
    found = index.search(Criteria(skills=["Python", "Docker"], mode="any", min_years=5))
    found.page(1).show()
"""

from __future__ import annotations

import difflib
import hashlib
import os
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import index as I
from .operators import like as L
from .operators import narrow, ranking, sets
from .plans import prepared
from .runtime import stored, table, version

#: Similarity of a chunk to a text that makes a document a weak member.
TAU_TEXT = 0.35
#: Likeness from which an unknown name is taken for a slip rather than for text.
SLIP = 0.8


class SearchError(ValueError):
    """An error with a code that callers can act on."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class Criteria:
    """What is asked for. mode: all, any, or min-cover with ``need`` terms at least. strict takes strong evidence only,
    used asks for terms that were used and not only listed. Names that the vocabulary doesn't know are searched as text.
    like is a query document: its text, a file, or the name or number of a document; beside other terms it only ranks."""

    skills: list[str] = field(default_factory=list)
    topics: list[str] = field(default_factory=list)
    text: str = ""
    mode: str = "all"
    need: int = 1
    strict: bool = False
    used: bool = False
    min_years: float | None = None
    rate_max: float | None = None
    seniority: list[str] = field(default_factory=list)
    location: list[str] = field(default_factory=list)
    remote: bool | None = None
    availability: list[str] = field(default_factory=list)
    include_unknown: bool = False
    like: str = ""

    def __post_init__(self) -> None:
        if self.mode not in ("all", "any", "min-cover"):
            raise SearchError("BAD_MODE", self.mode)
        for name in ("min_years", "rate_max"):
            value = getattr(self, name)
            if isinstance(value, str):
                try:
                    value = float(value.replace("€", "").replace(",", "").strip())
                except ValueError:
                    raise SearchError("BAD_NUMBER", f"{name} is {value}") from None
                setattr(self, name, value)
            if value is not None and value < 0:
                raise SearchError("BAD_NUMBER", f"{name} is negative")
        for name in ("skills", "topics", "seniority", "location", "availability"):
            value = getattr(self, name)
            if isinstance(value, str):
                setattr(self, name, [x.strip() for x in value.split("|") if x.strip()])
        if isinstance(self.remote, str):
            if self.remote.lower() not in ("true", "yes", "false", "no"):
                raise SearchError("BAD_FLAG", f"remote is {self.remote}")
            self.remote = self.remote.lower() in ("true", "yes")
        for s in self.seniority:
            if s.lower() not in ranking.SENIORITY:
                raise SearchError("BAD_SENIORITY", s)

    def parts(self) -> list[Criteria]:
        """Each condition as criteria of its own: the terms together, every constraint alone."""
        out = []
        if self.skills or self.topics or self.text or self.like:
            out.append(Criteria(self.skills, self.topics, self.text, self.mode, self.need, self.strict, self.used, like=self.like))
        for name in ("min_years", "rate_max", "seniority", "location", "remote", "availability"):
            value = getattr(self, name)
            if value not in (None, [], ""):
                out.append(Criteria(**{name: value}, include_unknown=self.include_unknown))
        return out

    def key(self) -> str:
        """The same for conditions that say the same in another order, case or spacing."""

        def plain(v):
            if isinstance(v, list):
                return sorted({" ".join(str(x).lower().split()) for x in v if str(x).strip()})
            return " ".join(v.lower().split()) if isinstance(v, str) else v

        return hashlib.sha256(repr(sorted((k, plain(v)) for k, v in asdict(self).items())).encode()).hexdigest()[:16]


#: Lists of scores of a condition: evidence, full text and vector of terms; words and vector of a text; cover and vector of
#: a query document.
SCORES = ("evidence", "bm25", "cosine", "score", "near", "cover", "alike")


class Index:
    """The tables of one version of an index, and its saved conditions. embed, where given, makes the vector of a text in
    the space of the chunks; without it texts are found by their words only."""

    def __init__(self, spark: SparkSession, folder: str, embed: Callable[[str], list[float]] | None = None):
        self.spark, self.folder, self.embed = spark, folder, embed
        self.docs, self.terms, self.doc_terms = (table(spark, folder, n) for n in ("docs", "terms", "doc_terms"))
        self.profile, self.postings, self.words, self.sizes, self.chunks = (f(spark, folder) for f in (prepared.profile, prepared.postings, prepared.words, prepared.sizes, prepared.chunks))
        self.version = version(spark, folder)
        self.saved: dict[str, DataFrame] = {}
        self.vectors: dict[str, list[float]] = {}

    @classmethod
    def open(cls, spark: SparkSession, folder: str, embed: Callable[[str], list[float]] | None = None) -> Index:
        return cls(spark, folder, embed)

    def refreshed(self, frozen: tuple[str, ...] = ()) -> Index:
        """This index, or one of the newer version of its tables. Conditions are evaluated again there, but for those with
        a key in ``frozen``, which keep their documents as far as they are live."""
        if version(self.spark, self.folder) == self.version:
            return self
        new = Index(self.spark, self.folder, self.embed)
        new.vectors = self.vectors
        live = new.docs.where(~F.coalesce("deleted", F.lit(False))).select("doc_no")
        new.saved = {k: df.join(live, "doc_no", "left_semi") for k, df in self.saved.items() if k in frozen}
        return new

    def resolve(self, names: list[str], kind: str) -> tuple[list[int], list[str]]:
        """(terms, names that mean none) by name, alias or slug. A name that looks like a slip of a known one is an error
        that gives it. A skill asked for as a topic stands for the topic that it implies, if that is one."""
        known = self.terms.where("kind <> 'title'")
        forms = known.select("term_id", "kind", "implies", F.explode(F.concat(F.array("canonical", "slug"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("form")).withColumn("form", F.lower("form"))
        ids, rest = [], []
        for name in names:
            low = " ".join(name.lower().split())
            near = forms.withColumn("edits", F.levenshtein("form", F.lit(low))).orderBy("edits", F.col("kind") != kind, "term_id").limit(50).collect()
            hit = near[0] if near and not near[0]["edits"] else None
            if hit and kind == "topic" and hit["kind"] == "skill" and len(hit["implies"] or ()) == 1:
                up = self.terms.where(F.col("slug") == hit["implies"][0]).select("term_id").first()
                ids.append(up["term_id"] if up else hit["term_id"])
            elif hit:
                ids.append(hit["term_id"])
            else:
                slip = next((r["form"] for r in near if difflib.SequenceMatcher(None, low, r["form"]).ratio() >= SLIP), None)
                if slip:
                    raise SearchError("UNKNOWN_TERM", f"{name}; nearest: {slip}")
                rest.append(name)
        return ids, rest

    def query_text(self, source: str) -> str:
        """The text of a query document: a file, a document by name or number, else the words given."""
        if os.path.isfile(source):
            with open(source, encoding="utf-8") as f:
                return f.read()
        number = int(source) if source.isdigit() else -1
        row = self.docs.where((F.col("id") == source) | (F.col("doc_no") == number)).select("markdown").first()
        return (row["markdown"] or "") if row else source

    def condition(self, c: Criteria) -> DataFrame:
        """(doc_no, strong, coverage and the scores SCORES) of one condition, evaluated once and saved."""
        k = c.key()
        if k not in self.saved:
            self.saved[k] = stored(self._evaluated(c))
        return self.saved[k]

    def _evaluated(self, c: Criteria) -> DataFrame:
        topics, unknown = self.resolve(c.topics, "topic")
        skills, more = self.resolve(c.skills, "skill")
        ids = sorted(set(topics + skills))
        text = " ".join([c.text, *unknown, *more]).strip()
        if ids or text or c.like:
            return self._terms(c, ids, text)
        tests, unknown_ = self._tests(c)
        ok = reduce(lambda a, b: a & b, tests, F.lit(True))
        if c.include_unknown:
            ok = F.coalesce(ok, F.lit(False)) | reduce(lambda a, b: a | b, unknown_, F.lit(False))
        return self.profile.where(ok).select("doc_no", F.lit(True).alias("strong"), F.lit(1).cast("bigint").alias("coverage"), *[F.lit(None).cast("double").alias(x) for x in SCORES])

    def _terms(self, c: Criteria, ids: list[int], text: str) -> DataFrame:
        null = {x: F.lit(None).cast("double").alias(x) for x in SCORES}
        own = lambda **given: [given[x].cast("double").alias(x) if x in given else null[x] for x in SCORES]
        count = len(ids) + bool(text)  # the text is a set like those of the terms
        need = {"all": count, "any": 1, "min-cover": min(c.need, count)}[c.mode]
        allowed = F.col("used") if c.used else F.col("strong") if c.strict else F.col("strong") | (F.col("kind") == "topic")
        p = self.postings.where(F.col("term_id").isin(ids)).where(allowed)
        members = p.select("doc_no", "term_id", (F.col("used") if c.used else F.col("strong")).alias("strong"), *own(evidence=F.col("evidence"), bm25=F.col("bm25"), cosine=F.col("cosine")))
        if text:
            t = self._text(text)
            members = members.union(t.select("doc_no", F.lit(-1).cast("bigint"), "strong", *own(score=F.col("score"), near=F.col("near"))))
        found = None
        if count:
            g = members.groupBy("doc_no").agg(F.count_distinct("term_id").alias("coverage"), F.count_distinct(F.when(F.col("strong"), F.col("term_id"))).alias("s"), *[F.max(x).alias(x) for x in SCORES])
            found = g.where(F.col("coverage") >= need).select("doc_no", (F.col("s") >= need).alias("strong"), "coverage", *SCORES)
        if c.like:
            l = self._like(c.like)
            if found is None:
                found = l.where("covered").select("doc_no", F.lit(True).alias("strong"), F.lit(1).cast("bigint").alias("coverage"), *own(cover=F.col("cover"), alike=F.col("alike")))
            else:  # terms decide, the document only ranks
                found = found.drop("cover", "alike").join(l.select("doc_no", "cover", "alike"), "doc_no", "left").select("doc_no", "strong", "coverage", *SCORES)
        return found if c.mode != "all" else found.withColumn("coverage", F.lit(1).cast("bigint"))

    def vector(self, text: str) -> list[float] | None:
        """The vector of a text, made once."""
        if self.embed is None:
            return None
        if text not in self.vectors:
            self.vectors[text] = [float(x) for x in self.embed(text)]
        return self.vectors[text]

    def _near(self, text: str) -> DataFrame | None:
        """(doc_no, near): cosine of the text to the best chunk of each document, education aside."""
        v = self.vector(text)
        if v is None:
            return None
        q = self.spark.createDataFrame([(0, v)], "term_id bigint, emb array<double>")
        return I.near_terms(self.chunks, q, -1.0).select("doc_no", F.col("cosine").alias("near"))

    def _text(self, text: str) -> DataFrame:
        """(doc_no, strong, score, near): documents with every word of the text, stop words aside, are strong; those whose
        best chunk is only near are weak. None for a text without words."""
        every = re.findall(T.WORD, text.lower())
        words = [w for w in every if w not in T.STOP_WORDS] or every
        empty = self.words.where("false").select("doc_no", F.lit(None).cast("double").alias("score"))
        hits = I.bm25(self.words, self.sizes, "doc_no", words) if words else empty
        near = self._near(text) if words else None
        if near is None:
            return hits.select("doc_no", F.lit(True).alias("strong"), "score", F.lit(None).cast("double").alias("near"))
        both = hits.join(near, "doc_no", "full").where(F.col("score").isNotNull() | (F.col("near") >= TAU_TEXT))
        return both.select("doc_no", F.col("score").isNotNull().alias("strong"), "score", "near")

    def _like(self, source: str) -> DataFrame:
        """(doc_no, cover, alike, covered) for a query document: mean weight of the evidence for its lines, cosine of its
        text to the best chunk, and whether enough lines are covered. Where no line names a term, nearness decides."""
        text = self.query_text(source)
        lines = stored(L.requirements(self.spark.createDataFrame([(0, text)], "q int, t string"), "q", "t"))
        named = stored(L.resolved(lines, "q", self.terms.where("kind <> 'title'")).select(F.col("line_no").alias("line"), "term_id"))
        near = self._near(text[:8000])
        if named.isEmpty():
            if near is None:
                raise SearchError("EMPTY_QUERY", "no line of the query document names a term")
            return near.select("doc_no", F.lit(None).cast("double").alias("cover"), F.col("near").alias("alike"), (F.col("near") >= TAU_TEXT).alias("covered"))
        cover = L.covered(self.postings, named, 0.0).withColumn("enough", F.col("covered") / named.select("line").distinct().count() >= 0.4).select("doc_no", "cover", "enough")
        if near is None:
            return cover.select("doc_no", "cover", F.lit(None).cast("double").alias("alike"), F.col("enough").alias("covered"))
        return cover.join(near, "doc_no", "full").select("doc_no", "cover", F.col("near").alias("alike"), F.coalesce("enough", F.lit(False)).alias("covered"))

    def _tests(self, c: Criteria) -> tuple[list[Column], list[Column]]:
        tests, unknown = [], []
        if c.min_years is not None:
            tests.append(F.col("years") >= c.min_years)
            unknown.append(F.col("years").isNull())
        if c.rate_max is not None:
            tests.append(F.col("rate") <= c.rate_max)
            unknown.append(F.col("rate").isNull())
        if c.seniority:
            tests.append(F.lower(F.trim("seniority")).isin([s.lower() for s in c.seniority]))
        if c.location:
            tests.append(F.lower("location").rlike(T.place_pattern(c.location)))
        if c.remote is not None:
            tests.append(F.col("remote") if c.remote else ~F.coalesce("remote", F.lit(False)))
        if c.availability:
            tests.append(F.col("label").isin(*[T.availability_label(F.lit(x)) for x in c.availability]))
        return tests, unknown

    def search(self, *criteria: Criteria) -> View:
        return View(self, [p for c in criteria for p in c.parts()])


class View:
    """The intersection of saved conditions over the newest live version of each person, in order."""

    def __init__(self, index: Index, conditions: list[Criteria], sort: list[Column] | None = None):
        self.index, self.conditions, self.sort = index, list({c.key(): c for c in conditions}.values()), sort
        self._rows: DataFrame | None = None

    def add(self, c: Criteria) -> View:
        return View(self.index, [*self.conditions, *c.parts()], self.sort)

    def drop(self, c: Criteria) -> View:
        gone = {p.key() for p in c.parts()}
        return View(self.index, [x for x in self.conditions if x.key() not in gone], self.sort)

    def sorted(self, *order: Column) -> View:
        return View(self.index, self.conditions, list(order))

    def members(self) -> DataFrame:
        people = sets.representatives(self.index.docs)
        return sets.intersected([people, *(self.index.condition(c) for c in self.conditions)])

    def rows(self) -> DataFrame:
        """(doc_no, strong, coverage, evidence, pos): ordered by the coverage of all ranked conditions, the fused ranks of
        all their lists of scores (evidence, full text and vectors of terms, words and vector of a text, cover and vector
        of a query document), number; without a ranked condition the newest first."""
        if self._rows is None:
            m = self.members()
            ranked = [c for c in self.conditions if c.skills or c.topics or c.text or c.like]
            size = None
            if ranked:
                lists = []
                for i, c in enumerate(ranked):
                    m = m.join(self.index.condition(c).select("doc_no", *[F.col(x).alias(f"{x}{i}") for x in ("strong", "coverage", *SCORES)]), "doc_no", "left")
                m = stored(m)
                some = m.agg(*[F.count(f"{x}{i}").alias(f"{x}{i}") for i in range(len(ranked)) for x in SCORES]).first()
                lists = [x for x in some.asDict() if some[x]]  # lists without entries contribute nothing
                each = lambda x: [F.col(f"{x}{i}") for i in range(len(ranked))]
                m = m.withColumn("coverage", reduce(lambda a, b: a + b, each("coverage"))).withColumn("evidence", F.array_max(F.array(*each("evidence"))).cast("int")).withColumn("strong", reduce(lambda a, b: a & b, each("strong")))
                m, size = ranking.competition_ranks(m, {x: f"rank_{x}" for x in lists}) if lists else (m, None)
                m = m.withColumn("fused", ranking.fused([F.col(f"rank_{x}") for x in lists]))
                order = [F.col("coverage").desc_nulls_last(), F.round("fused", 12).desc(), F.col("doc_no")]
            else:
                m = m.select("doc_no", F.lit(True).alias("strong"), F.lit(None).cast("bigint").alias("coverage"), F.lit(None).cast("int").alias("evidence"))
                order = [F.col("doc_no").desc()]
            if self.sort:
                m = m.join(self.index.profile, "doc_no", "left")
            laid = sets.ranked(m, [*(self.sort or []), *order], rows=size)
            self._rows = stored(laid.select("doc_no", "strong", "coverage", "evidence", "pos"))
        return self._rows

    def count(self) -> int:
        return self.members().count()

    def page(self, number: int = 1, size: int = 10) -> DataFrame:
        shown = ranking.page(self.rows(), number, size)
        return shown.join(self.index.profile.select("doc_no", "current_title", "seniority", "years", "rate", "location"), "doc_no", "left").orderBy("pos")

    def people(self) -> DataFrame:
        return self.members().join(self.index.profile.select("doc_no", "person"), "doc_no", "left").select("doc_no", F.coalesce("person", F.concat(F.lit("d"), F.col("doc_no").cast("string"))).alias("person"))

    def suggestions(self, limit: int = 50) -> DataFrame:
        """(grp, value, n, pos): what would narrow the view to ``limit`` people at most, with the number left."""
        taken = [t for c in self.conditions for t in self.index.resolve(c.skills, "skill")[0]]
        i = self.index
        return narrow.suggestions(stored(self.people()), i.profile, i.postings, i.doc_terms, i.terms, taken, limit)

    def summary(self) -> DataFrame:
        """One row: members, those with strong evidence only, and the rest."""
        return self.rows().agg(F.count("*").alias("members"), F.count_if("strong").alias("strong"), F.count_if(~F.col("strong")).alias("weak"))

    def diagnosis(self) -> DataFrame:
        """(condition, n, culprit) of an empty view: the condition added last, and each without which n would be found; no
        rows for a view that has members."""
        counts = self.counts()
        if self.count():
            return counts.where("false").select("condition", F.col("without").alias("n"), F.lit(False).alias("culprit"))
        last = self.conditions[-1].key()
        return counts.select("condition", F.col("without").alias("n"), (F.col("condition") == last).alias("culprit")).where("n > 0 or culprit")

    def drop_word(self, word: str) -> View:
        """Without the condition that the word names; an error if none or several do."""
        said = {k.key(): " ".join(str(v) for v in asdict(k).values() if v not in (None, [], "", False)).lower() + " " + " ".join(n for n, v in asdict(k).items() if v not in (None, [], "", False)) for k in self.conditions}
        hits = [k for k, words in said.items() if word.lower() in words]
        if len(hits) != 1:
            raise SearchError("AMBIGUOUS" if hits else "NOT_FOUND", f"{word}: {len(hits)} conditions")
        return View(self.index, [c for c in self.conditions if c.key() != hits[0]], self.sort)

    def unsorted(self) -> View:
        """In the order of the ranked conditions again."""
        return View(self.index, self.conditions)

    def cleared(self) -> View:
        return View(self.index, [])

    def refreshed(self) -> View:
        """The view over the newest version of the index."""
        new = self.index.refreshed()
        return self if new is self.index else View(new, self.conditions, self.sort)

    def facets(self) -> dict[str, DataFrame]:
        p = self.index.profile.join(self.members(), "doc_no", "left_semi")
        t = self.index.doc_terms.where("via <> 'implied'").join(self.members(), "doc_no", "left_semi").join(self.index.terms.where("kind = 'skill'").select("term_id", "canonical"), "term_id")
        return {
            "seniority": p.where("level is not null").groupBy("level").agg(F.count("*").alias("n")),
            "availability": p.where("label is not null").groupBy("label").agg(F.count("*").alias("n")),
            "skills": t.groupBy("canonical").agg(F.count_distinct("doc_no").alias("n")).orderBy(F.col("n").desc(), "canonical").limit(8),
            "places": p.where("city <> ''").groupBy("city").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "city").limit(5),
        }

    def snapshot(self, page: int = 1) -> dict[str, DataFrame]:
        """Everything that shows the state of a search: a page, summary, facets, filters and suggestions, or the diagnosis
        of an empty one."""
        out = {"rows": self.page(page), "summary": self.summary(), "filters": self.counts(), **{f"facet_{n}": f for n, f in self.facets().items()}}
        return out | ({"suggestions": self.suggestions()} if self.count() else {"diagnosis": self.diagnosis()})

    def counts(self) -> DataFrame:
        """(condition, alone, without): members of each condition alone and of the view without it."""
        spark = self.index.docs.sparkSession
        people = sets.representatives(self.index.docs)
        mask = sets.flags({c.key(): self.index.condition(c).join(people, "doc_no", "left_semi") for c in self.conditions})
        full = (1 << len(self.conditions)) - 1
        if not self.conditions:
            return spark.createDataFrame([], "condition string, alone bigint, without bigint")
        tests = []
        for i in range(len(self.conditions)):
            rest = full & ~(1 << i)
            tests += [F.count_if(F.col("mask").bitwiseAND(1 << i) != 0).alias(f"a{i}"), F.count_if(F.col("mask").bitwiseAND(rest) == rest).alias(f"w{i}")]
        one = mask.agg(*tests)
        return one.select(F.explode(F.array(*[F.struct(F.lit(c.key()).alias("condition"), F.col(f"a{i}").alias("alone"), F.col(f"w{i}").alias("without")) for i, c in enumerate(self.conditions)])).alias("x")).select("x.*")
