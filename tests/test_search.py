import pytest
from pyspark.sql import functions as F

from siftline.operators import components, scan
from siftline.search import Criteria, Index, SearchError
from tests.conftest import DATA


@pytest.fixture(scope="module")
def index(spark):
    return Index.open(spark, DATA)


def ids(view):
    return [r["doc_no"] for r in view.rows().orderBy("pos").collect()]


def test_laws(index):
    a, b = Criteria(topics=["Incident Response"]), Criteria(min_years=3, include_unknown=True)
    assert set(ids(index.search(a, b))) == set(ids(index.search(b).add(a)))
    assert ids(index.search(a).add(b).drop(b)) == ids(index.search(a))
    both = index.search(a, b)
    assert both.count() == len(ids(both)) <= index.search(a).count()
    counts = {r["condition"]: (r["alone"], r["without"]) for r in both.counts().collect()}
    assert counts[a.parts()[0].key()] == (index.search(a).count(), index.search(b).count())


def test_suggested_counts_are_delivered(index):
    view = index.search(Criteria(min_years=3))
    fields = {"skill": lambda v: {"skills": [v], "strict": True}, "seniority": lambda v: {"seniority": [v]}, "where": lambda v: {"location": [v]}, "remote": lambda v: {"remote": True}, "avail": lambda v: {"availability": [v]}, "rate": lambda v: {"rate_max": float(v)}}
    rows = view.suggestions(40).collect()
    assert {r["grp"] for r in rows} >= {"seniority", "where", "avail"}
    for r in rows:
        if r["grp"] in fields:
            assert view.add(Criteria(**fields[r["grp"]](r["value"]))).count() == r["n"], r


def test_availability_is_read_in_any_wording(index):
    found = {w: set(ids(index.search(Criteria(availability=[w])))) for w in ("2 weeks", "2w", "avail 2w", "Immediate", "now", "1 month", "1m", "3 months")}
    assert found["2 weeks"] == found["2w"] == found["avail 2w"] and found["2w"] and found["Immediate"] == found["now"] != found["2w"]
    assert found["1 month"] == found["1m"] and found["1m"] and found["3 months"] and not found["1m"] & found["3 months"]


def test_unknown_names_fall_back_to_text(index):
    assert set(ids(index.search(Criteria(skills=["release notes"])))) == set(ids(index.search(Criteria(text="release notes")))) != set()
    assert set(ids(index.search(Criteria(text="the release of notes")))) == set(ids(index.search(Criteria(text="release notes"))))


def test_vectors_of_a_text(spark):
    v = next(r["emb"] for r in spark.read.parquet(f"{DATA}/terms.parquet").where("slug = 'data-pipelines'").collect())
    calls = []
    index = Index.open(spark, DATA, lambda t: calls.append(t) or v)
    c = Criteria(text="release notes")
    rows = index.condition(c).collect()
    weak = {r["doc_no"] for r in rows if not r["strong"]}
    strong = {r["doc_no"] for r in rows if r["strong"]}
    plain = {r["doc_no"] for r in Index.open(spark, DATA).condition(c).collect()}
    assert strong == plain and not weak & strong and all(r["near"] >= 0.35 for r in rows if not r["strong"])
    assert index.vector("release notes") and calls == ["release notes"]
    s = index.search(c).summary().first()
    assert s["members"] == s["strong"] + s["weak"]


def test_query_document(index):
    text = "# Wanted\nNice to have:\n- Python\n- Docker or Terraform\n- a sense of humour and more\n"
    alone = {r["doc_no"]: r for r in index.condition(Criteria(like=text)).collect()}
    assert alone and all(0 < r["cover"] <= 1 for r in alone.values())
    skills = {n: {r["doc_no"] for r in index.condition(Criteria(skills=[n])).collect()} for n in ("Python", "Docker", "Terraform")}
    assert set(alone) == set().union(*skills.values())  # one of two lines is enough
    assert set(ids(index.search(Criteria(skills=["Python"], like=text)))) == set(ids(index.search(Criteria(skills=["Python"]))))  # terms decide
    name = index.docs.where("id is not null and markdown is not null").select("id", "markdown").first()
    assert index.query_text(name["id"]) == name["markdown"] and index.query_text("words") == "words"


def test_empty_views_say_why(index):
    a, b = Criteria(skills=["Python"]), Criteria(min_years=70)
    view = index.search(a).add(b)
    assert view.count() == 0
    rows = {r["condition"]: (r["n"], r["culprit"]) for r in view.diagnosis().collect()}
    assert rows == {b.key(): (index.search(a).count(), True)}
    assert index.search(a).diagnosis().count() == 0
    shown = view.snapshot()
    assert "diagnosis" in shown and "suggestions" not in shown and shown["rows"].count() == 0 and shown["summary"].first()["members"] == 0


def test_drop_by_word(index):
    view = index.search(Criteria(skills=["Python"]), Criteria(min_years=3), Criteria(rate_max=100))
    assert len(view.drop_word("python").conditions) == 2 and len(view.cleared().conditions) == 0
    for word, code in (("nothing", "NOT_FOUND"), ("3", None), ("a", "AMBIGUOUS")):
        if code:
            with pytest.raises(SearchError, match=code):
                view.drop_word(word)
    assert ids(view.sorted(F.col("rate").desc()).unsorted()) == ids(view)


def test_a_new_version_is_seen(spark, tmp_path):
    import shutil

    folder = tmp_path / "v"
    folder.mkdir()
    for name in ("docs", "profile", "terms", "doc_terms", "build_docs", "emb"):
        shutil.copy(f"{DATA}/{name}.parquet", folder / f"{name}.parquet")
    index = Index.open(spark, str(folder))
    view = index.search(Criteria(min_years=3))
    before = ids(view)
    assert view.refreshed() is view
    docs = spark.read.parquet(str(folder / "docs.parquet"))
    docs.withColumn("deleted", (F.col("doc_no") == before[0]) | F.coalesce("deleted", F.lit(False))).coalesce(1).write.parquet(str(tmp_path / "new"))
    part = next(p for p in (tmp_path / "new").iterdir() if p.suffix == ".parquet")
    shutil.copy(part, folder / "docs.parquet")
    after = view.refreshed()
    assert after is not view and before[0] not in ids(after)


def test_pages_and_sort(index):
    view = index.search().sorted(F.col("rate").asc_nulls_last())
    first, second = view.page(1).collect(), view.page(2).collect()
    assert [r["pos"] for r in first + second] == list(range(1, 21))
    rates = [r["rate"] for r in first + second]
    assert rates == sorted(rates)


def test_text_beside_terms(index):
    skill, text = Criteria(skills=["Python"]), Criteria(text="release notes")
    a, b = set(ids(index.search(skill))), set(ids(index.search(text)))
    assert a - b and b - a and a & b
    both = {"skills": ["Python"], "text": "release notes"}
    assert set(ids(index.search(Criteria(**both)))) == a & b
    assert set(ids(index.search(Criteria(**both, mode="any")))) == a | b
    assert set(ids(index.search(Criteria(**both, mode="min-cover", need=2)))) == a & b
    assert set(ids(index.search(Criteria(text="(Release, notes!)")))) == b
    assert set(ids(index.search(Criteria(text="release/notes+")))) == b
    assert ids(index.search(Criteria(text="…!"))) == []


def test_order_fuses_all_ranked_conditions(index):
    skill, text = Criteria(skills=["Python", "Docker"], mode="any"), Criteria(text="release")
    view = index.search(skill).add(text)
    a, b = ({r["doc_no"]: r for r in index.condition(c).collect()} for c in (skill, text))
    docs = [r["doc_no"] for r in view.members().collect()]
    lists = [{d: x[d] for d in docs if x.get(d) is not None} for x in (*({d: r[s] for d, r in a.items()} for s in ("evidence", "bm25", "cosine")), {d: r["score"] for d, r in b.items()})]
    rank = lambda x, d: 1 + sum(d not in x or x[d] < v for k, v in x.items() if k != d)
    fused = {d: sum(1 / (60 + rank(x, d)) for x in lists) for d in docs}
    assert len(docs) > 2 and ids(view) == sorted(docs, key=lambda d: (-a[d]["coverage"] - b[d]["coverage"], -round(fused[d], 12), d))


def test_keys_and_errors(index):
    assert Criteria(skills=["Python", " docker"]).key() == Criteria(skills=["DOCKER", "python"]).key() != Criteria(skills=["python"]).key()
    assert Criteria(rate_max="1,200 €").rate_max == 1200
    assert Criteria(skills="Python | Docker").skills == ["Python", "Docker"] and Criteria(remote="yes").remote is True
    for bad in ({"mode": "some"}, {"min_years": -1}, {"seniority": ["boss"]}, {"min_years": "many"}, {"remote": "perhaps"}):
        with pytest.raises(SearchError):
            Criteria(**bad)
    with pytest.raises(SearchError, match="nearest: python"):
        index.search(Criteria(skills=["pyhton"])).count()


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (300, 200), (5, 5), (None, 3), (300, 200)]
    got = {r["node"]: r["root"] for r in components.union_find(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(61)) and {got[i] for i in (100, 200, 300)} == {100}
    assert components.union_find(spark.createDataFrame([], "a int, b int")).count() == 0


def test_scan(spark):
    terms = spark.createDataFrame([(1, "Spark", ["Apache Spark"], ["Spark"]), (2, "C++", None, []), (3, "Apache Spark Streaming", [], [])], "term_id int, canonical string, aliases array<string>, ambiguous array<string>")
    docs = spark.createDataFrame([(1, "A spark of hope"), (2, "Apache Spark, spark and C++."), (3, "apache spark streaming"), (4, None), (5, "")], "doc_no int, t string")
    got = {(r["key"], r["term_id"], r["hits"]) for r in scan.scan(docs, "doc_no", "t", terms).collect()}
    assert got == {(2, 1, 2), (2, 2, 1), (3, 3, 1)}
    v = scan.hashed_embedding(docs, "doc_no", "t").collect()
    assert len(v) == 4 and abs(sum(x * x for x in v[1]["vec"]) - 1) < 1e-5
