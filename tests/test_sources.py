"""Readers, sinks and the row-wise operators on a stream."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import documents as D
from ledgerleaf.operators import quotation as Q
from ledgerleaf.sources import readers, sinks

RAW = {"title": "t", "document_type": "d", "source": {"provider": "p", "source_uri": "u"}, "participants": [], "segments": [{"sequence": 1, "text": "hello"}]}


def test_raw_documents_by_file_and_by_line(spark, tmp_path):
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.json").write_text(json.dumps(RAW, indent=1))
    (tmp_path / "lines.json").write_text("\n".join([json.dumps(RAW), "broken"]))
    (whole,) = readers.read_raw_documents(spark, str(tmp_path / "one")).collect()
    assert whole.title == "t" and json.loads(whole.raw) == RAW
    lines = readers.read_raw_documents(spark, str(tmp_path / "lines.json"), lines=True).orderBy("raw").collect()
    assert [r.title for r in lines] == [None, "t"] and lines[0].raw == "broken"


def test_layout_documents(spark, tmp_path):
    page = {"page_number": 1, "width": 1.0, "height": 2.0, "text": "x", "blocks": [], "words": [], "tables": [{"bbox": None, "rows": [["a", None]]}], "unknown": 1}
    (tmp_path / "a.json").write_text(json.dumps({"pages": [page]}, indent=2))
    (row,) = readers.read_layout_documents(spark, str(tmp_path)).collect()
    assert row.pages[0].tables[0].rows == [["a", None]] and row.pages[0].height == 2.0


def test_stored_files(spark, tmp_path):
    (tmp_path / "2026" / "09").mkdir(parents=True)
    (tmp_path / "2026" / "09" / "a.pdf").write_bytes(b"%PDF-1.7 and more")
    (row,) = readers.read_stored_files(spark, str(tmp_path)).collect()
    assert (row.storage_key, row["size"], bytes(row.content)) == ("2026/09/a.pdf", 17, b"%PDF-1.7")


def test_artifacts_and_export(spark, tmp_path):
    docs = D.normalize_documents(readers.parse_raw_documents(spark.createDataFrame([(json.dumps(RAW),)], "raw string")))
    sinks.write_artifacts(docs, D.document_summary(docs), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "normalized")).first().document_id == spark.read.parquet(str(tmp_path / "out" / "structured")).first().document_id
    items = spark.createDataFrame([("q", [("s", "d", None, "u", None, None, None)])], f"quotation string, items array<{Q.ITEM}>")
    sinks.export_items(items, str(tmp_path / "csv"), "quotation")
    (row,) = spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()
    assert (row.quotation, row.sku, row.unit) == ("q", "s", "u")


def test_normalising_a_stream_equals_the_batch(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({**RAW, "title": f" t{i} "}))
    stream = spark.readStream.schema("value string").option("wholetext", True).text(str(tmp_path)).withColumnRenamed("value", "raw")
    query = D.normalize_documents(readers.parse_raw_documents(stream)).select("document_id", "fingerprint").writeStream.format("memory").queryName("normalised").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = D.normalize_documents(readers.read_raw_documents(spark, str(tmp_path)))
    assert sorted(spark.table("normalised").collect()) == sorted(batch.select("document_id", "fingerprint").collect())
    assert batch.select(F.countDistinct("fingerprint")).first()[0] == 3


def test_artifacts_are_published_together(spark, tmp_path):
    root = str(tmp_path / "root")
    one, two = (spark.createDataFrame([(i, "d")], "n int, t string") for i in (1, 2))
    with pytest.raises(ValueError):
        sinks.read_artifacts(spark, root)
    # A run that breaks off leaves nothing to be read, and does not hinder the next.
    sinks.write_documents(two, f"{root}/versions/a/normalized")
    with pytest.raises(ValueError):
        sinks.read_artifacts(spark, root)
    assert sinks.publish_artifacts(one, one, root, "a") and not sinks.publish_artifacts(two, two, root, "a")
    assert [[r.n for r in df.collect()] for df in sinks.read_artifacts(spark, root)] == [[1], [1]]
    sinks.write_documents(one, f"{root}/versions/b/normalized")
    assert sinks.read_artifacts(spark, root)[0].first().n == 1
    assert sinks.publish_artifacts(two, two, root, "b")
    assert sinks.read_artifacts(spark, root)[1].first().n == 2 and sinks.read_artifacts(spark, root, "a")[1].first().n == 1
    assert sorted(r.version for r in sinks.published_versions(spark, root).collect()) == ["a", "b"]
    for bad in ("", "../x", "a/b"):
        with pytest.raises(ValueError):
            sinks.publish_artifacts(one, one, root, bad)
    with pytest.raises(ValueError):
        sinks.read_artifacts(spark, root, "c")
