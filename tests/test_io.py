"""Sources, sinks and streaming on small folders."""

from pyspark.sql import functions as F

from scrivano.sources import files, sinks
from scrivano.streaming import ingest


def test_text_files_and_archive(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.org").write_text("#+title: t\n#+source: https://b/12345\nbody")
    (tmp_path / "y.org").write_text("no header")
    (tmp_path / "z.md").write_text("other")
    rows = files.text_files(spark, str(tmp_path), "*.org")
    assert rows.count() == 2
    assert [r.post_id for r in files.archive_index(rows).collect()] == ["12345"]


def test_mime(spark, tmp_path):
    good = "MIME-Version: 1.0\nContent-Type: multipart/related; boundary=B\n\n--B\nContent-Type: text/html; charset=utf-8\nContent-Transfer-Encoding: quoted-printable\n\n<p>=ED=95=9C</p>\n--B--\n"
    (tmp_path / "a.doc").write_text(good)
    (tmp_path / "b.doc").write_text("Content-Type: text/plain\n\nx")
    got = {r.path.rpartition("/")[2]: r for r in files.mime_documents(spark, str(tmp_path)).collect()}
    assert got["a.doc"].html.strip() == "<p>한</p>" and got["a.doc"].error is None
    assert got["b.doc"].html is None and got["b.doc"].error == "no text/html part"


def test_folder_source_pushes_a_filter(spark, tmp_path):
    for n in ("a.md", "b.org", "c.md"):
        (tmp_path / n).write_text(n)
    files.register(spark)
    df = spark.read.format("document_folder").option("path", str(tmp_path)).load()
    assert df.count() == 3
    assert sorted(r.name for r in df.where("ext = 'md'").collect()) == ["a.md", "c.md"]


def test_unwrap(spark):
    df = spark.createDataFrame([('{"result": "x"}',), ("plain",), ('{"other": 1}',)], "raw string")
    assert [r.v for r in df.select(files.unwrap_json(F.col("raw")).alias("v")).collect()] == ["x", "plain", '{"other": 1}']


def test_ingest_twice_writes_once(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, text string").coalesce(1).write.parquet(source)

    def go(checkpoint):
        q = ingest.ingest(ingest.read_incoming(spark, source, "id int, text string"), target, checkpoint, "id")
        q.awaitTermination(60)

    go(mark)
    spark.createDataFrame([(2, "b"), (3, "c")], "id int, text string").coalesce(1).write.mode("append").parquet(source)
    go(mark)
    go(mark + "2")
    assert sorted(r.id for r in spark.read.parquet(target).collect()) == [1, 2, 3]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "category string, text string")
    sinks.by_category(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "category=a").is_dir()
    assets = spark.createDataFrame([(1, "u", "p", 200, bytearray(b"abc"))], "page int, url string, local_path string, status int, content binary")
    assert "ba7816bf" in sinks.manifest(assets).first().manifest


def test_a_batch_that_was_cut_off_is_written_anew(spark, tmp_path):
    """Files without a manifest are no rows; the batch's replay neither loses nor repeats any."""
    target, schema = str(tmp_path / "out"), "id int, text string"
    batch = spark.createDataFrame([(k, f"t{k}") for k in range(40)], schema).repartition(4)
    # The first try ended between two files.
    batch.where("id < 11").write.parquet(f"{target}/rows/run=a/batch=0")
    assert ingest.read_committed(spark, target, schema).count() == 0
    assert ingest.commit_batch(batch, target, "a", 0)
    assert not ingest.commit_batch(batch, target, "a", 0)
    batch.limit(3).write.parquet(f"{target}/rows/run=a/batch=1")
    assert sorted(r.id for r in ingest.read_committed(spark, target, schema).collect()) == list(range(40))
    assert ingest.commit_batch(batch.selectExpr("id + 30 AS id", "'new' AS text"), target, "b", 0)
    rows = ingest.read_committed(spark, target, schema, "id").collect()
    assert sorted((r.id, r.text) for r in rows) == [(k, f"t{k}" if k < 40 else "new") for k in range(70)]


def test_committed_stream(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "id int, text string"
    for part in ([(1, "a"), (2, "b"), (2, "b")], [(2, "b"), (3, "c")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.ingest_committed(ingest.read_incoming(spark, source, schema), target, mark, "id", "main").awaitTermination(60)
    assert sorted(r.id for r in ingest.read_committed(spark, target, schema).collect()) == [1, 2, 3]


def test_feed_waits_for_a_late_page(spark, tmp_path):
    """Offsets are page numbers; a page that isn't there yet is tried again with growing waits."""
    import json
    import threading
    import time

    feed, out, mark = (tmp_path / x for x in ("feed", "out", "mark"))
    feed.mkdir()
    for k in (0, 2):
        (feed / f"page-{k}.json").write_text(json.dumps([f"p{k}a", f"p{k}b"]))
    files.register(spark)

    def late():
        time.sleep(2)
        (feed / "page-1.tmp").write_text(json.dumps(["late"]))
        (feed / "page-1.tmp").rename(feed / "page-1.json")

    def go():
        rows = spark.readStream.format("document_feed").option("path", str(feed)).option("delay", "0.2").option("tries", "8").load()
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(mark)).option("path", str(out)).trigger(availableNow=True).start()
        query.awaitTermination(90)
        return sorted((r.page, r.pos, r.text) for r in spark.read.parquet(str(out)).collect())

    helper = threading.Thread(target=late)
    helper.start()
    assert go() == [(0, 0, "p0a"), (0, 1, "p0b"), (1, 0, "late"), (2, 0, "p2a"), (2, 1, "p2b")]
    helper.join()
    (feed / "page-3.json").write_text("[]")
    (feed / "page-4.json").write_text(json.dumps(["new"]))
    assert go()[-1] == (4, 0, "new") and len(go()) == 6


def test_patience_ends():
    tried = []

    def fails():
        tried.append(1)
        raise OSError("gone")

    try:
        files.patient(fails, 3, 0.01)
    except OSError:
        pass
    assert len(tried) == 3
