import hashlib
import json
import zipfile

from pyspark.sql import functions as F

from shelfspark.sources import readers, reports
from shelfspark.streaming import upserts


def test_readers(spark, tmp_path):
    (tmp_path / "s.txt").write_text("https://A.example/\n\n  http://b.example/x \n")
    assert readers.suppliers(spark, str(tmp_path / "s.txt")).count() == 2
    assert [r.url for r in readers.suppliers(spark, str(tmp_path / "s.txt"), ["a.example"]).collect()] == ["https://A.example/"]
    (tmp_path / "r.json").write_text(json.dumps([{"id": "F-1", "fixture_type": "Люстра", "exact_dimensions": {"width": 5}}, {"id": "F-2", "taxonomy_family": "spot"}]))
    got = {r.id: r for r in readers.requirements(spark, str(tmp_path / "r.json")).collect()}
    assert (got["F-1"].taxonomy_family, got["F-2"].taxonomy_family, got["F-1"].exact_dimensions) == ("chandelier", "spot", {"width": 5.0})
    (tmp_path / "c.json").write_text(json.dumps({"default_mode": "mixed", "suppliers": {"a.example": {"mode": "mixed", "evidence": "e"}, "b.example": {"mode": "odd"}}}))
    assert {r.host: r.mode for r in readers.capability(spark, str(tmp_path / "c.json")).collect()} == {"a.example": "mixed", "b.example": "stock_tracked"}
    assert readers.capability(spark, str(tmp_path / "none.json")).count() == 0


def test_docx_and_fingerprints(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = lambda *t: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{x}</w:t></w:r></w:p>" for x in t) + "</w:tc>"
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:tbl><w:tr>{cell('№')}{cell('Имя')}</w:tr><w:tr>{cell('1')}{cell('Бра ', 'белое')}</w:tr></w:tbl></w:document>")
    (tmp_path / "b.docx").write_bytes(b"not a zip")
    got = readers.docx_tables(spark, str(tmp_path / "*.docx")).orderBy("path", "row_no").collect()
    assert [r.cells for r in got] == [["№", "Имя"], ["1", "Бра белое"], None] and got[2].error
    assert readers.fingerprints(spark, str(tmp_path / "b.docx")).first().sha256 == hashlib.sha256(b"not a zip").hexdigest()


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("q", 1, "a|<b>"), ("q", 2, "c"), ("p", 3, None)], "g string, id long, name string")
    docs = reports.nested(df, "g", [F.col("id")], ["id", "name"], 1)
    reports.write_json(docs, str(tmp_path / "out"), "g")
    assert {r.g: r["items"][0].id for r in spark.read.json(str(tmp_path / "out")).collect()} == {"q": 1, "p": 3}
    assert "a\\|<b>" in reports.markdown(df, "t") and "a|&lt;b&gt;" in reports.html(df, "t") and "No rows" in reports.markdown(df.limit(0), "t")


def test_stream_upsert_and_windows(spark, tmp_path):
    schema = "k long, seq long, at timestamp, a string, b string"
    src = tmp_path / "src"
    for n, rows in enumerate([[(1, 1, "x", "p"), (2, 2, "y", None)], [(1, 3, None, None), (3, 4, "z", "q")]]):
        spark.createDataFrame([(k, s, a, b) for k, s, a, b in rows], "k long, seq long, a string, b string").withColumn("at", F.timestamp_seconds(F.col("seq") * 60)).select("k", "seq", "at", "a", "b").coalesce(1).write.mode("append").parquet(str(src))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    state = upserts.StreamState(spark, str(tmp_path / "state"), ["k"], ["seq"], ["a"], ["b"])
    got = sorted(tuple(r) for r in upserts.stream_upsert(source, state, str(tmp_path / "cp")).select("k", "seq", "a", "b").collect())
    assert got == [(1, 3, None, "p"), (2, 2, "y", None), (3, 4, "z", "q")]
    q = upserts.tumbling_counts(spark.readStream.schema(schema).parquet(str(src)), "at", "k", "10 minutes", "1 minute").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 4


def test_stream_state_survives_a_restart(spark, tmp_path):
    schema, path = "k long, seq long, a string", str(tmp_path / "state")
    state = lambda: upserts.StreamState(spark, path, ["k"], ["seq"], ["a"], [], parts=4)
    df = lambda *rows: spark.createDataFrame(rows, schema)
    state().merge(df((1, 1, "a"), (2, 1, "b")), 0)
    state().merge(df((3, 2, "c"), (1, 2, "d")), 1)
    want = [(1, 2, "d"), (2, 1, "b"), (3, 2, "c")]
    assert sorted(map(tuple, state().read().collect())) == want
    state().merge(df((3, 2, "c"), (1, 2, "d")), 1)  # the batch runs again
    assert sorted(map(tuple, state().read().collect())) == want
    state().merge(df(), 2)
    assert sorted(map(tuple, state().read().collect())) == want


def docx(path, tables):
    import zipfile

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    rows = lambda t: "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in t)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>' + "".join(f"<w:tbl>{rows(t)}</w:tbl>" for t in tables) + "</w:body></w:document>")


def test_offers(spark, tmp_path):
    docx(tmp_path / "a.docx", [[["№", "Наименование товара", "Кол-во", "Цена, руб", "Срок поставки"], ["7", "Бра LED 4000K d120 WX-4514/01", "2 шт", "1 249,50", "склад"], ["", "Люстра, артикул ЖЛ46-03", "", "по запросу", ""], ["9", "", "1", "1", ""]], [["другая"], ["x"]]])
    docx(tmp_path / "b.docx", [])
    (tmp_path / "c.docx").write_bytes(b"broken")
    got = {(r.path.rsplit("/", 1)[-1], r.row_no): r for r in readers.offers(spark, f"{tmp_path}/*.docx").collect()}
    assert set(got) == {("a.docx", 1), ("a.docx", 2), ("c.docx", None)} and got["c.docx", None].error
    assert tuple(got["a.docx", 1])[2:] == (7, "Бра LED 4000K d120 WX-4514/01", "WX-4514/01", 2, 1249.5, "склад", None)
    assert tuple(got["a.docx", 2])[2:] == (2, "Люстра, артикул ЖЛ46-03", None, None, None, None, None)


def test_reviews_annotations_domains_and_responses(spark, tmp_path):
    import json

    entry = {"candidate_set_fingerprint": "f", "candidates": [{"sku": "A", "status": "accepted"}, {"status": "x"}, 5]}
    (tmp_path / "r.json").write_text(json.dumps({"requirements": {"F-1": entry, "F-2": {"reviews": {"B": {"status": "rejected"}, "C": 1}}, "F-3": 7}}))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "list.json").write_text("[1]")
    got = sorted(tuple(r)[:4] for r in readers.reviews(spark, f"{tmp_path}/*.json").collect())
    assert got == [("F-1", "f", "A", "accepted"), ("F-2", None, "B", "rejected"), ("F-2", None, "C", None)]
    assert readers.reviews(spark, f"{tmp_path}/missing.json").count() == 0
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "n.json").write_text(json.dumps({"sku_mapping": {"a1": {"requirement_id": "F-1", "confidence": 1, "note": "n"}, "b": 3}, "system_category_mapping": None}))
    assert [tuple(r) for r in readers.annotations(spark, f"{tmp_path}/notes").collect()] == [("sku_mapping", "a1", "F-1", 1.0, "n")]
    (tmp_path / "d.txt").write_text(" https://Shop.example/ \n\nb.example/x//\n")
    assert [r.domain for r in readers.allowed_domains(spark, str(tmp_path / "d.txt")).collect()] == ["shop.example", "b.example/x"]
    wanted = spark.createDataFrame([("u1",), ("u2",), ("u3",), (None,)], "url string")
    cache = spark.createDataFrame([("u1", '{"a": 1}'), ("u1", "{"), ("u2", "oops{")], "url string, body string").select(F.sha2("url", 256).alias("key"), "body")
    assert sorted(map(tuple, readers.cached_responses(wanted, cache).collect()), key=str) == [("u1", '{"a": 1}'), ("u2", None), ("u3", None), (None, None)]
