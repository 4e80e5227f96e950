"""Parser, chunks, cards, extraction by dictionary, cleaning and sinks on small cases."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import cards, chunks, extract, like, narrow, ranking, scan, sessions, sets, vocab
from siftline.operators import index as I
from siftline.sources import readers as R
from siftline.streaming import inbox

DOC = "# Ann Lee\nintro line\n\n## Work Experience\r\n### Engineer\n*Acme — Cork · Mar 2014 to Current*\n- Led the Spark team\n- wrote code with Go and Docker\n### Clerk\n*2010 – 2012*\n• filed things\n## Education\n### BSc Maths\n## References\n- none\n"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "d int, t string")


def test_parsed_lines(spark):
    rows = sorted(tuple(r) for r in extract.parsed_lines(docs(spark, DOC, None, "", "x\n## Skills\n# not a headline"), "d", "t").collect())
    assert rows[:6] == [
        (0, 1, "headline", "Ann Lee", None, None, None, 0), (0, 2, "line", "intro line", "Preamble", "summary", None, 0), (0, 4, "section", "Work Experience", "Work Experience", "experience", None, 4),
        (0, 5, "entry", "Engineer", "Work Experience", "experience", "Engineer", 5), (0, 6, "meta", "Acme — Cork · Mar 2014 to Current", "Work Experience", "experience", "Engineer", 5), (0, 7, "line", "Led the Spark team", "Work Experience", "experience", "Engineer", 5),
    ]
    assert [r[2:6] for r in rows if r[0] == 3] == [("line", "x", "Preamble", "summary"), ("section", "Skills", "Skills", "skills"), ("line", "# not a headline", "Skills", "skills")]
    assert {r[0] for r in rows} == {0, 3} and [r[5] for r in rows if r[1] in (12, 14) and r[0] == 0] == ["education", "skip"]
    meta = {r["line_no"]: (r["company"], r["location"], r["dates_text"]) for r in extract.meta_lines(extract.parsed_lines(docs(spark, DOC), "d", "t"), "d").collect()}
    assert meta == {6: ("Acme", "Cork", "Mar 2014 to Current"), 10: (None, None, "2010 – 2012")}


def test_years_count_experience_only(spark):
    from siftline.operators import intervals

    m = lambda y, k: y * 12 + k - 1
    got = {(r["start_month"], r["end_month"]) for r in extract.date_ranges(docs(spark, DOC, "## School\n*A · 1999*\n## Work\n*B · 1940 to 1941*"), "d", "t", until=m(2020, 5), kind="experience").collect()}
    assert got == {(m(2014, 3), m(2020, 5)), (m(2010, 1), m(2012, 12))}
    years = intervals.years(extract.date_ranges(docs(spark, DOC), "d", "t", until=m(2020, 5), kind="experience"), "d").first()
    assert years["years"] == round((75 + 36) / 12, 1) and years["islands"] == 2


def test_chunks(spark):
    long_ = "# H\n## Summary\n" + "\n".join(f"line {i} " + "word " * 30 for i in range(40)) + "\n## Experience\n### Job\n*Co · 2014*\n" + "w" * 900 + " " + "many words " * 400
    rows = chunks.chunked(docs(spark, DOC, long_, None, "  \n", "## References\n- a"), "d", "t").collect()
    by = {}
    for r in rows:
        by.setdefault(r["d"], []).append(r)
    assert [(r["section"], r["header"], r["text"]) for r in sorted(by[0], key=lambda r: r["idx"])] == [
        ("summary", "Ann Lee | Preamble", "intro line"), ("experience", "Ann Lee | Work Experience › Engineer, Acme, Mar 2014 to Current", "Engineer\nLed the Spark team\nwrote code with Go and Docker"),
        ("experience", "Ann Lee | Work Experience › Clerk, 2010 – 2012", "Clerk\nfiled things"), ("education", "Ann Lee | Education", "BSc Maths"),
    ]
    assert all(r["tokens"] <= 352 for r in by[1]) and {r["idx"] for r in by[1]} == set(range(len(by[1])))
    lines = [x for r in sorted(by[1], key=lambda r: r["idx"]) if r["section"] == "summary" for x in r["text"].split("\n")]
    assert list(dict.fromkeys(lines)) == [f"line {i} " + ("word " * 30).strip() for i in range(40)] and len(lines) > 40  # all lines, some twice
    assert 2 not in by and 3 not in by and [r["section"] for r in by[4]] == ["other"]
    said = " ".join(r["text"] for r in sorted(by[1], key=lambda r: r["idx"]) if r["section"] == "experience")
    assert said.split() == ["Job", "w" * 900, *["many", "words"] * 400]


@pytest.mark.parametrize("n", [0, 3, 60])
def test_cards(spark, n):
    used, listed = [f"Used{i:03d}" for i in range(n)], [f"Listed{i:03d}" for i in range(n)]
    df = spark.createDataFrame([(1, "Ann · Engineer", used, listed, "built " + "things " * n + "..."), (2, None, None, None, None)], "d int, facts string, used array<string>, listed array<string>, did string")
    got = {r["d"]: r for r in cards.read_back(cards.rendered(df), "text").collect()}
    r = got[1]
    assert r["tokens"] <= 110 and r["text"].startswith("Ann · Engineer") and got[2]["text"] == ""
    assert r["used_shown"] == used[: len(r["used_shown"])] and r["listed_shown"] == listed[: len(r["listed_shown"])]
    if n <= 3:
        assert (r["used_shown"], r["listed_shown"]) == (used, listed)
    else:  # listed ones go first, then used ones down to four, then the line about the work
        assert r["listed_shown"] == [] and len(r["used_shown"]) == 4 and r["did_shown"].endswith("…")


def test_extracted_terms(spark):
    terms = spark.createDataFrame([(1, "Spark", [], ["Spark"], ["team leading"]), (2, "Golang", ["Go"], ["Go"], ["docker"]), (3, "Docker", None, None, None), (4, "Maths", None, None, None)], "term_id int, canonical string, aliases array<string>, ambiguous array<string>, context array<string>")
    got = {(r["d"], r["term_id"]): (r["level"], r["evidence"], r["section"]) for r in scan.extracted(docs(spark, DOC, "# Docker\n## Skills\nGo, Docker", None), "d", "t", terms).collect()}
    assert got == {(0, 2): ("used", "wrote code with Go and Docker", "Work Experience"), (0, 3): ("used", "wrote code with Go and Docker", "Work Experience"), (1, 2): ("listed", "Go, Docker", "Skills"), (1, 3): ("listed", "Docker", "headline")}
    sure = terms.withColumn("context", F.when(F.col("term_id") == 1, F.array(F.lit("team"), F.lit("led nothing"))).otherwise(F.col("context")))
    assert {r["term_id"]: r["level"] for r in scan.extracted(docs(spark, DOC), "d", "t", sure).collect()} == {1: "led", 2: "used", 3: "used"}


def test_redaction_by_context(spark):
    cases = {
        "ISBN: 959-7160-31-512 and +49 30 1234 5678": ("ISBN: 959-7160-31-512 and [phone]", 0, 0, 1), "Letters, 59 (2005) 570-5741234": ("Letters, 59 (2005) 570-5741234", 0, 0, 0), "US 200502767431": ("US 200502767431", 0, 0, 0),
        "see github.com/ann and ann@b.example, 0301234567890": ("see [url] and [email], [phone]", 1, 1, 1), "1999 - 2002 12.05.2013": ("1999 - 2002 12.05.2013", 0, 0, 0), "": ("", 0, 0, 0), "née@büro.example x": ("[email] x", 1, 0, 0),
    }
    got = T.redaction(spark.createDataFrame([(k, k) for k in cases], "k string, t string"), "t").collect()
    assert {r["k"]: (r["t"], r["emails"], r["urls"], r["phones"]) for r in got} == cases
    again = spark.createDataFrame([(k,) for k in cases], "k string").select("k", T.redacted(F.col("k")).alias("t")).collect()
    assert {r["k"]: r["t"] for r in again} == {k: v[0] for k, v in cases.items()}
    assert T.redaction(spark.createDataFrame([(None,)], "t string"), "t").first()["t"] is None


def test_repeated_lines(spark):
    rows = T.without_repeats(docs(spark, "a\n\na\nb\nb\nb\na", "", "x", None), "t").collect()
    assert {r["d"]: (r["t"], r["dropped"]) for r in rows if r["d"] < 3} == {0: ("a\n\nb\na", 3), 1: ("", 0), 2: ("x", 0)}


def test_ranks_by_driver_and_by_ranges(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i * 7 % 13) if i % 5 else None, float(i % 3)) for i in range(200)], "d int, a double, b double")
    few, rows = ranking.competition_ranks(df, {"a": "ra", "b": "rb"})
    monkeypatch.setattr(ranking, "FEW_SCORES", 3)
    many, unknown = ranking.competition_ranks(df, {"a": "ra", "b": "rb"})
    assert rows == 200 and unknown is None
    side = lambda x: {r["d"]: (r["ra"], r["rb"]) for r in x.collect()}
    assert side(few) == side(many) and len(side(few)) == 200
    order = [F.col("b"), F.col("d")]
    one, ranges = ({r["d"]: r["pos"] for r in sets.ranked(df, order, rows=n).collect()} for n in (200, None))
    assert one == ranges
    assert [r["d"] for r in ranking.top_page(df, order, 2, 5).orderBy("pos").collect()] == [d for d, p in sorted(one.items(), key=lambda x: x[1]) if 5 < p <= 10]


def test_bitmaps(spark):
    rows = [(1, d) for d in (0, 5, 40_000, 70_000)] + [(2, 5)]
    pack = lambda r: I.bitmaps(spark.createDataFrame(r, "term_id int, doc_no int"))
    read = lambda b: sorted((r["term_id"], r["doc_no"]) for r in I.members_of(b.withColumn("bits", F.base64("bits"))).collect())
    assert read(pack(rows)) == sorted(rows)
    both = I.bitmaps_or(pack(rows), pack([(1, 6), (3, 7)]))
    assert read(both) == sorted([*rows, (1, 6), (3, 7)])
    assert read(I.bitmaps_without(both, pack([(1, 5), (1, 40_000), (9, 1)]), ["term_id", "bucket"])) == [(1, 0), (1, 6), (1, 70_000), (2, 5), (3, 7)]


def test_near_terms_in_blocks(spark, monkeypatch):
    c = spark.createDataFrame([(1, "skills", [1.0, 0.0]), (1, "other", [0.6, 0.8]), (2, "education", [1.0, 0.0]), (3, None, [0.0, 0.0]), (4, "skills", None), (5, "skills", [1.0])], "doc_no int, kind string, vec array<float>")
    t = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 1.0]), (9, None)], "term_id int, emb array<float>")
    for size in (1 << 20, 1):
        monkeypatch.setattr(I, "BLOCK_BYTES", size)
        assert {(r["term_id"], r["doc_no"], round(r["cosine"], 6)) for r in I.near_terms(c, t, 0.5).collect()} == {(7, 1, 1.0), (8, 1, 0.8)}
    assert I.near_terms(c, t.limit(0), 0.5).count() == 0


def test_near_names_equal_brute_force(spark):
    import itertools
    import random

    r = random.Random(2)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(3, 9))) for _ in range(60)]
    words = sorted({*words, *(w[:-1] + "x" for w in words[:20])})

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(a, b) for a, b in itertools.combinations(words, 2) if round(1 - edits(a, b) / max(len(a), len(b)), 6) >= 0.7}
    got = {(r["k"], r["near"]) for r in scan.near_names(spark.createDataFrame([(w, w) for w in words], "k string, n string"), "k", "n", 0.7).collect()}
    assert got == want and len(want) > 10


def test_vocabulary_edits(spark):
    t = spark.createDataFrame([(1, "skill", "a", "A", ["AA"], ["b"]), (2, "skill", "b", "B", None, ["a"]), (3, "topic", "c", "C", [], ["a"])], "term_id int, kind string, slug string, canonical string, aliases array<string>, implies array<string>")
    assert {r["slug"]: (r["canonical"], r["forms"], r["implied"]) for r in vocab.merged(t, "a", "b").collect()} == {"b": ("B", ["A", "AA"], []), "c": ("C", [], ["b"])}
    more = vocab.aliased(vocab.added(t, "d", "D", "skill", ["aa"], ["gone"]), "b", "BB")
    assert {r["slug"]: r["aliases"] for r in more.collect()}["b"] == ["BB"]
    assert {tuple(r) for r in vocab.problems(more).collect()} == {("aa", 2), ("missing: gone", 1)} and vocab.problems(t).count() == 0
    with pytest.raises(ValueError, match="SLUG_IN_USE"):
        vocab.added(t, "a", "X", "skill", [], [])


def test_ranking_job(spark):
    members = spark.range(30).select(F.col("id").cast("int").alias("doc_no"))
    done = spark.createDataFrame([("j", 1, 50), ("j", 2, None), ("k", 3, 9)], "judgment_id string, doc_no int, score int")
    batches = [(r["batch"], r["doc_no"]) for r in sessions.rank_job(members, done, "j").collect()]
    assert len(batches) == 29 and {b for b, _ in batches} == {0, 1} and 1 not in {d for _, d in batches}
    assert tuple(sessions.landed(done, "j", members).first()) == (30, 1, 29, False)
    with pytest.raises(ValueError, match="TOO_MANY"):
        sessions.rank_job(spark.range(51).select(F.col("id").alias("doc_no")), done, "j")


def test_trailing_equals_brute_force(spark):
    rows = [(i % 3, i * i * 13 % 5000, float(i)) for i in range(300)] + [(0, 100, 1.0), (0, 100, 2.0)]
    df = spark.createDataFrame(rows, "u int, s int, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r["u"], r["s"], r["v"], r["recent"], r["recent_sum"]) for r in sessions.trailing(df, "u", "ts", 600, F.col("v")).collect())
    want = sorted((u, s, v, sum(a == u and s - 600 <= b <= s for a, b, _ in rows), sum(c for a, b, c in rows if a == u and s - 600 <= b <= s)) for u, s, v in rows)
    assert got == want


def test_covered_lines_and_thresholds(spark):
    p = spark.createDataFrame([(1, "skill", 10, True, True), (1, "skill", 11, True, False), (2, "topic", 10, False, False), (3, "skill", 12, False, False)], "term_id bigint, kind string, doc_no int, strong boolean, used boolean")
    lines = spark.createDataFrame([(0, 1), (1, 2), (1, 3)], "line int, term_id bigint")
    assert {r["doc_no"]: (r["covered"], r["cover"]) for r in like.covered(p, lines, 0.4).collect()} == {10: (2, 0.75), 11: (1, 0.4)}
    rows = spark.createDataFrame([(f"p{i}", 20.5 + i, float(i)) for i in range(10)] + [("p0", 99.0, 0.5)], "person string, rate double, years double")
    assert {(r["grp"], r["value"], r["n"]) for r in narrow.thresholds(rows, 10, 4).collect()} == {("rate", "24", 4), ("years", "6", 4)}
    assert narrow.thresholds(rows, 10, 1).count() == 0


def test_corpus_sink(spark, tmp_path):
    folder = str(tmp_path / "c")
    make = lambda rows: spark.createDataFrame(rows, "id string, markdown string")
    assert tuple(R.write_corpus(make([("a", "x"), ("b", "y"), (None, "z")]), folder).first()) == (2, 0, 0, 2)
    assert tuple(R.write_corpus(make([("a", "x"), ("b", "y")]), folder).first()) == (0, 2, 0, 2)
    assert tuple(R.write_corpus(make([("a", "new"), ("c", None)]), folder).first()) == (2, 0, 1, 2)
    assert {r["id"] for r in R.current(spark, folder).collect()} == {"a", "c"}


def test_vector_pack(spark, tmp_path):
    store = spark.createDataFrame([("m", "a", [1.0]), ("m", "a", [1.0]), ("m", "b", [2.0])], "model string, key string, vec array<float>")
    R.export_vectors(store, str(tmp_path / "p"), "f1")
    assert R.import_pack(spark, str(tmp_path / "p"), store.where("key = 'a'"), "f1").count() == 1
    with pytest.raises(ValueError, match="FINGERPRINT"):
        R.import_pack(spark, str(tmp_path / "p"), store, "f2")


def test_scores_land_once(spark, tmp_path):
    source, store = str(tmp_path / "s"), str(tmp_path / "t")
    schema = "judgment_id string, doc_no int, score int, note string"
    for rows in ([("j", 1, 50, "a"), ("j", 2, None, None)], [("j", 1, 90, "late"), ("j", 2, 70, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        inbox.land_scores(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "ck")).awaitTermination()
    assert {r["doc_no"]: r["score"] for r in spark.read.parquet(store).collect()} == {1: 50, 2: 70}


def test_front_matter_lists(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: 'T'\ntags:\n  - one\n  - \"two\"\ncategory: Data\n---\n# A\n")
    row = R.markdown_files(spark, str(tmp_path), "m").first()
    assert row["meta"] == {"title": "T", "tags": "one, two", "category": "Data"} and row["category"] == "Data" and row["markdown"] == "# A\n"
