import json

from pyspark.sql import functions as F

from siftline.sources import readers as R
from siftline.streaming import inbox


def test_html():
    html = "<html><head><title>t</title></head><body><h1>Ann &amp; Co</h1><script>x</script><p>One<br>two</p><ul><li>a</li><li>b <b>c</b></li></ul><table><tr><td>x</td><td>y</td></tr></table></body></html>"
    assert R.html_to_markdown(html) == "# Ann & Co\nOne\ntwo\n- a\n- b c\nx y"
    assert R.html_to_markdown("") == "" and R.html_to_markdown(None) is None


def test_loaders(spark, tmp_path):
    md = tmp_path / "md"
    md.mkdir()
    (md / "b.md").write_text('---\nname: "B"\ncategory: Data\n---\n# B\ntext\n')
    (md / "a.md").write_text("# A\n")
    (tmp_path / "t.csv").write_text('Category,Resume\nHR,"x Education Details BSc * one"\nHR,"x Education Details BSc * one"\n')
    (tmp_path / "h.csv").write_text('ID,Resume_str,Resume_html,Category\n1,"plain text","<p>short</p>",HR\n2,"p","<h1>T</h1><p>' + "word " * 40 + '</p>",IT\n')
    got = R.load(spark, [("m", "markdown_files", str(md)), ("t", "csv_text", str(tmp_path / "t.csv")), ("h", "csv_html", str(tmp_path / "h.csv")), ("no", "csv_text", "/nowhere")], optional=("no",))
    rows = {(r["source"], r["source_id"]): r for r in got.collect()}
    assert len(rows) == 5
    assert rows["m", "b"]["category"] == "Data" and rows["m", "b"]["markdown"] == "# B\ntext\n" and rows["m", "b"]["meta"]["name"] == "B"
    assert rows["m", "a"]["meta"] == {}
    assert rows["h", "1"]["markdown"] == "# Hr\n\nplain text" and rows["h", "2"]["markdown"].startswith("# T\nword")


def test_ledger_and_versions(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text(json.dumps({"at": 1, "user": "a"}) + "\n{broken\n" + json.dumps({"at": 2, "user": "b"}) + "\n")
    assert R.ledger(spark, str(tmp_path / "l.jsonl"), "at bigint, user string").count() == 2
    folder = str(tmp_path / "v")
    for n in (3, 4, 5):
        R.publish(spark.range(n), folder)
    assert R.current(spark, folder).count() == 5
    try:
        R.publish(spark.range(0), folder)
        raise AssertionError("an empty version must not be published")
    except ValueError:
        assert R.current(spark, folder).count() == 5


def test_judgments_and_vectors(spark, tmp_path):
    p = str(tmp_path / "j")
    schema = "judgment_id string, doc_no int, score int, note string, created_at string"
    R.append_judgments(spark.createDataFrame([("j", 1, None, None, "1"), ("j", 1, 70, "x", "2")], schema), p)
    R.append_judgments(spark.createDataFrame([("j", 1, 90, "late", "3"), ("j", 2, None, None, "3")], schema), p)
    assert {r["doc_no"]: r["score"] for r in R.judgments(spark, p).collect()} == {1: 70, 2: None}
    pack = spark.createDataFrame([("m", "a", [1.0]), ("m", "b", [2.0]), ("m", "b", [2.0])], "model string, key string, vec array<float>")
    assert R.import_vectors(pack, pack.limit(1)).count() == 1


def test_inbox(spark, tmp_path):
    folder, store, ck = (str(tmp_path / n) for n in ("in", "store", "ck"))
    text = "one two three four five six"
    row = lambda i, t: ("s", i, "c", t, {"a": "b"})
    spark.createDataFrame([row("1", text), row("1", text), row("2", "too short")], R.RAW).write.parquet(folder)
    inbox.watch_inbox(spark, folder, store, ck).awaitTermination()
    spark.createDataFrame([row("1", text + " changed"), row("3", text), row("4", text + " new")], R.RAW).write.mode("append").parquet(folder)
    inbox.watch_inbox(spark, folder, store, ck).awaitTermination()
    assert sorted(r["source_id"] for r in spark.read.parquet(store).collect()) == ["1", "4"]


def test_usage_windows(spark, tmp_path):
    from tests.conftest import DATA

    spark.read.parquet(f"{DATA}/events.parquet").repartition(2).write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    q = inbox.usage_windows(spark.readStream.schema(schema).parquet(str(tmp_path / "e"))).writeStream.outputMode("update").format("memory").queryName("usage").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("usage").agg(F.sum("n")).first()[0] == spark.read.parquet(str(tmp_path / "e")).count()
