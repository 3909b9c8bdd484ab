"""The query inputs reach both sides of every threshold; one bad row or a second save stops nothing."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from veilmark.functions import reporting
from veilmark.functions.html import with_html_text
from veilmark.operators import evaluation
from veilmark.plans import queries
from veilmark.sources import files, registry, sinks

BAD_PAGE = "<p>x</p><![foo[bar]]>"


def test_confidence_reaches_every_branch(spark, sf):
    bands = {r["band"] for r in queries.confidence_band(spark, sf).collect()}
    assert bands == {"low", "medium", "high"}
    assert sum(r["n"] > 0 for r in queries.confidence_histogram(spark, sf).collect()) >= 5
    log = queries.classify_log(spark, sf).cache()
    done = log.filter("classification is not null")
    assert 0 < done.filter("review_flag").count() < done.count()
    assert 0 < done.filter("confidence >= 0.5").count() < done.count()
    assert log.filter("extraction_status <> 'ok'").count() > 0
    assert 0.05 < queries.fit_temperature(spark, sf).first()["t"] < 10.0
    assert {r["status"] for r in queries.text_fallback(spark, sf).select("status").distinct().collect()} == {"ok", "no_text_layer"}


def test_a_page_the_parser_rejects_is_a_row(spark):
    df = spark.createDataFrame([(1, BAD_PAGE), (2, "<p>fine</p>"), (3, None)], "page_id long, html string")
    rows = {r["page_id"]: r for r in with_html_text(df, "html", error="why").collect()}
    assert rows[1]["text"] is None and rows[1]["why"] and rows[2]["text"] == "fine" and rows[2]["why"] is None
    inputs = spark.createDataFrame([("/a/bad.html", BAD_PAGE.encode(), 30), ("/a/good.html", b"<p>good</p>", 11)], "path string, content binary, length long")
    got = {r["filename"]: r for r in files.extract(inputs).collect()}
    assert got["bad.html"]["extraction_status"] == "extraction_failed" and got["bad.html"]["extraction_detail"]
    assert got["good.html"]["text"] == "good"


def test_confusion_counts_every_row(spark):
    rows = [(0, 0), (1, None), (None, 2), (9, 1), (1, 1)]
    df = spark.createDataFrame(rows, "y int, pred int").withColumn("confidence", F.lit(0.5))
    cells = {(r["y"], r["pred"]): r["n"] for r in evaluation.confusion_matrix(df).collect()}
    assert sum(cells.values()) == 5 and cells[1, -1] == 1 and cells[-1, 2] == 1 and cells[-1, 1] == 1
    report = {r["label"]: r for r in evaluation.class_report(df).collect()}
    assert report["accuracy"]["f1"] == pytest.approx(evaluation.accuracy(df).first()["accuracy"]) == pytest.approx(0.4)
    assert report["accuracy"]["support"] == 5


def test_rows_without_a_class_differ_from_the_total(spark):
    df = spark.createDataFrame([(1,), (None,), (1,)], "y int")
    assert {(r["y"], r["is_total"]): r["n"] for r in evaluation.class_distribution(df).collect()} == {(1, 0): 2, (None, 0): 1, (None, 1): 3}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_stamp_is_utc_in_any_zone(spark, zone):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.range(1).select(F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"), F.lit(None).cast("timestamp").alias("none"))
        row = df.select(reporting.utc_stamp(F.col("ts")), reporting.utc_stamp_spaced(F.col("ts")), reporting.utc_stamp(F.col("none"))).first()
        assert tuple(row) == ("2023-11-14T22:13:20Z", "2023-11-14 22:13:20Z", None)
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_models_are_saved_again(spark, sf, tmp_path):
    folder = str(tmp_path / "models")
    model = queries.inputs.formula_model(spark, sf)
    first = registry.save_model(spark, model, folder)
    assert registry.save_model(spark, model, folder) == first
    second = registry.save_model(spark, model.with_temperature(3.0), folder)
    assert second != first and registry.load_model(spark, folder).temperature == 3.0
    model = replace(model, layers=[(-w, b) for w, b in model.layers])
    assert registry.save_model(spark, model, folder) not in (first, second)
    assert (registry.load_model(spark, folder).layers[0][0] == model.layers[0][0]).all()


def test_written_run_and_export(spark, sf, tmp_path):
    log = queries.classify_log(spark, sf)
    sinks.write_log(log, str(tmp_path / "run"))
    read = lambda name: spark.read.parquet(str(tmp_path / "run" / name))
    summary = read("summary").first()
    assert summary["total"] == read("log").count() and summary["flagged"] == read("review").count()
    assert sum(r["n"] for r in read("levels").collect()) == summary["classified"]
    assert sum(r["n"] for r in read("errors").collect()) == summary["errors"]
    # Many rows to a part and many parts: joined in order, they are the checked lines, byte for byte.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = sinks.write_export(log, str(tmp_path / "export")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) > 1 and [r["part"] for r in parts] == sorted(r["part"] for r in parts)
    whole = b"".join((tmp_path / "export" / r["filename"]).read_bytes() for r in parts)
    assert [r["bytes"] for r in parts] == [(tmp_path / "export" / r["filename"]).stat().st_size for r in parts]
    rows = log.select("filename", "filepath", "timestamp").collect()
    line_of = {r["filename"]: r["line"] for r in queries.csv_export(spark, sf).withColumn("filename", F.split("line", ",")[1]).collect()}
    assert len(line_of) == len(rows)
    ordered = sorted(sorted(rows, key=lambda r: r["filepath"]), key=lambda r: r["timestamp"], reverse=True)
    want = [",".join(sinks.EXPORT_COLUMNS)] + [line_of[r["filename"]] for r in ordered]
    assert whole.decode() == "".join(x + "\r\n" for x in want)


def test_export_of_no_rows_is_the_header(spark, sf, tmp_path):
    parts = sinks.write_export(queries.classify_log(spark, sf).limit(0), str(tmp_path / "none")).collect()
    whole = b"".join((tmp_path / "none" / r["filename"]).read_bytes() for r in parts)
    assert whole.decode() == ",".join(sinks.EXPORT_COLUMNS) + "\r\n"
