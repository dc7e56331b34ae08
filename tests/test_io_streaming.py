import pytest
from pyspark.sql import functions as F

from lexweave.operators import models, scorecard
from lexweave.sources import clients, readers, sinks
from lexweave.streaming import cache


def test_files_to_pages(spark, tmp_path):
    root = tmp_path / "corpus"
    (root / "app" / "sub").mkdir(parents=True)
    (root / "app" / "sub" / "a.TXT").write_text("page one\fpage two is here")
    (root / "app" / "b.html").write_text("<p>Hi <b>all</b></p><script>x</script>")
    (root / "app" / "c.bin").write_bytes(b"x")
    found = readers.discover(spark, str(root))
    assert {(r["owner"], r["name"]) for r in found.collect()} == {("app", "a.TXT"), ("app", "b.html")}
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(root)).where("path not like '%.bin'")
    got = {(r["doc"], r["page_number"]): r["text"] for r in readers.pages(files).collect()}
    assert got == {("a.TXT", 1): "page one", ("a.TXT", 2): "page two is here", ("b.html", 1): "Hi  all"}

    def bad(name, content):
        raise OSError("broken")

    assert {r["warning"] for r in readers.pages(files, bad).collect()} == {"OSError: broken"}


def test_docx(tmp_path):
    import io
    import zipfile

    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f"<w:document {w}><w:body>{para('One')}{para('')}<w:tbl><w:tr><w:tc>{para('a')}</w:tc><w:tc>{para('b')}</w:tc></w:tr></w:tbl>{para('Two')}</w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    extract = readers.by_suffix(docx=readers.docx_pages)
    assert list(extract("x.DOCX", out.getvalue())) == [(1, "One\nTwo\na | b", "docx", None)]
    assert [p[1] for p in extract("x.txt", b"a\fb")] == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a b", ["x", "y"]), ("c", None)], "k string, ids array<string>")
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert {tuple(r) for r in spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()} == {("a b", '["x","y"]'), ("c", None)}
    sinks.export_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    sinks.partitioned(df, "k", str(tmp_path / "parts"))
    assert {p.name for p in (tmp_path / "parts").iterdir() if p.is_dir()} == {"k_key=a_b", "k_key=c"}
    for n in (2, 3, 4):
        sinks.replace_atomically(spark.range(n), str(tmp_path / "table"))
        with pytest.raises(Exception):  # a write that fails leaves the table as it is
            sinks.replace_atomically(spark.range(5).select(F.raise_error(F.lit("no")).cast("int").alias("id")), str(tmp_path / "table"))
        assert sinks.read_current(spark, str(tmp_path / "table")).count() == n
    assert {p.name for p in tmp_path.iterdir()} == {"csv", "json", "parts", "table"}
    sinks.export_csv(df, str(tmp_path / "bom"), bom=True)
    assert all(f.read_bytes().startswith(b'"\xef\xbb\xbfk"') or not f.stat().st_size for f in (tmp_path / "bom").glob("*.csv"))
    kept, review = sinks.side_outputs(df.withColumn("why", F.when(F.col("k") == "c", "x")), "why")
    assert (kept.count(), review.count()) == (1, 1)


def test_client_retries(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "k int, p string")

    def client(p):
        if p == "bad":
            raise TimeoutError("slow")
        return p.upper()

    got = {r["k"]: (r["response"], r["status"], r["attempts"]) for r in clients.ask(df, "k", "p", client, 2, 0.0).collect()}
    assert got == {1: ("GOOD", "SUCCESS", 1), 2: ("TimeoutError: slow", "FAILED", 2)}


def test_stream_uses_the_cache(spark, tmp_path):
    src, schema = tmp_path / "in", "k string, p string"
    asked = spark.sparkContext.accumulator(0)

    def work(df):
        def one(parts):
            for part in parts:
                asked.add(len(part))
                yield part[["k"]].assign(answer=part["p"].str.upper())

        return df.mapInPandas(one, "k string, answer string")

    for n, data in enumerate([[("1", "a"), ("2", "b"), ("1", "a")], [("2", "b"), ("3", "c")]]):
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = cache.run(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "cache"), "k", work, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
        assert q.exception() is None
    answers = {(r["k"], r["answer"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert answers == {("1", "A"), ("2", "B"), ("3", "C")}
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 3


def test_stream_windows(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 00:10:00' ts, 'a' event_type, 1.0D value union all select timestamp '2024-01-01 02:10:00', 'a', 2.0D").coalesce(1).write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "ev"))
    q = cache.event_counts(s).writeStream.outputMode("append").format("memory").queryName("ev_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.sql("select * from ev_out").collect()] in ([1], [])


def test_scorecard_cases(spark):
    labels = spark.createDataFrame(
        [("p", "r1", "Compliant"), ("p", "r1", "Partially Compliant"), ("p", "zz", "Compliant"), ("q", "NONE", "Not Addressed"), ("q", "r2", "Partially Compliant")], "app string, best_match_taxonomy_id string, verdict string"
    )
    rules = spark.createDataFrame([("r1", "A"), ("r2", "A"), ("r3", "B")], "taxonomy_id string, act string")
    points = scorecard.rule_points(labels, rules, "app")
    m = {r["owner"]: (r["A"], r["B"], round(r["combined"], 4)) for r in scorecard.matrix(points, ["A", "B"]).collect()}
    assert m == {"p": (50.0, 0.0, 33.3333), "q": (25.0, 0.0, 16.6667)}
    r = {x["owner"]: x for x in scorecard.rankings(labels, points, "app", 3, 2).collect()}
    assert r["p"]["rules_covered"] == 2 and round(r["p"]["effective"], 4) == round(0.4 * r["p"]["quality"] + 0.6 * r["p"]["combined"], 4)


def test_classifier_learns(spark):
    data = [(f"we {w} your data today", y) for w, y in (("delete", "Compliant"), ("sell", "Not Addressed")) for _ in range(12)]
    df = spark.createDataFrame(data, "t string, y string")
    m = models.logistic(df, "t", "y", c=100.0, buckets=256)
    got = {r["t"]: r["guess"] for r in models.predict(m, df.drop("y"), "t").collect()}
    assert got == dict(data)


def test_scratch_tables_end_with_their_block(spark):
    """Intermediates are there inside the block and gone after it; functions that bring the module along can still be sent."""
    import pathlib

    from lexweave import session

    with session.scratch():
        made = session.materialize(spark.range(5), "tested")
        files = [pathlib.Path(f.removeprefix("file://").removeprefix("file:")) for f in made.inputFiles()]
        assert all(f.exists() for f in files)

        def run(batches):
            assert session._SCOPES is not None  # refers to the module
            yield from batches

        assert made.mapInArrow(run, "id bigint").count() == 5
    assert not any(f.exists() for f in files)
