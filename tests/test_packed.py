"""Packed texts: round trips, byte ranges, and what a failed or repeated write leaves."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from sitelens.session import ensure_checkpoint_dir
from sitelens.sources import files, packed
from sitelens.sources.sinks import read_back, write_report_json


@pytest.fixture()
def path(spark):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"


def local(path):
    return path.removeprefix("file:")


def test_sheets_come_back(spark, path):
    rows = [("007", 0, "a { }\n"), ("007", 1, ""), ("https://é.test", 2, "ü\n\n" * 1000), ("x", 3, None), (None, None, "z")]
    rows += [("many", k, f".c{k} {{ }}" * (k % 50)) for k in range(3000)]
    sheets = spark.createDataFrame(rows, "site string, css_ord bigint, css string").repartition(3)
    files.write_css_files(sheets, path)
    back = files.read_css_files(spark, path)
    key = lambda r: str(r)
    assert sorted(map(tuple, back.select("site", "css_ord", "css").collect()), key=key) == sorted(rows, key=key)
    assert len(os.listdir(local(path))) <= 3 * 2 + 1  # whatever the number of sheets
    assert back.select("css_path").distinct().count() > 2900


def test_byte_ranges_and_bundles(spark, path):
    rows = [(k, "x" * (k % 700) + "é") for k in range(2000)] + [(5000, ""), (5001, "")]
    df = spark.createDataFrame(rows, "k bigint, text string").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        packed.cloudpickle.register_pickle_by_value(packed)
        spark.dataSource.register(packed.PackedTexts)
        df.write.format("packed_texts").option("path", path).option("bundleBytes", "100000").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(f.endswith(".texts") for f in os.listdir(local(path))) > 3
    got = spark.read.format("packed_texts").option("path", path).option("rangeBytes", "9000").load()
    assert got.rdd.getNumPartitions() > 30
    assert sorted(map(tuple, got.select("k", "text").collect())) == rows


def test_overwrite_append_and_empty(spark, path):
    one = spark.createDataFrame([("r", "both", "first"), ("s", "extract", "gone later")], "request_id string, mode string, report_json string")
    write_report_json(one, path)
    write_report_json(one.where("request_id = 'r'").withColumn("report_json", F.lit("second")), path)
    assert [tuple(r) for r in read_back(spark, path).collect()] == [("r", "second")]
    assert packed.vacuum(local(path)) >= 2 and read_back(spark, path).count() == 1
    packed.write_packed(spark.createDataFrame([("t", "third")], "request_id string, text string"), path, mode="append")
    assert sorted(r["text"] for r in read_back(spark, path).collect()) == ["second", "third"]
    write_report_json(one.limit(0), path)
    assert read_back(spark, path).count() == 0


def test_a_failed_write_changes_nothing(spark, path):
    good = spark.createDataFrame([("r", "whole")], "request_id string, text string")
    packed.write_packed(good, path)
    bad = spark.range(40, numPartitions=4).select(F.col("id").cast("string").alias("request_id"),
                                                  F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.lit("half")).alias("text"))
    with pytest.raises(Exception, match="lost"):
        packed.write_packed(bad, path)
    assert [tuple(r) for r in read_back(spark, path).collect()] == [("r", "whole")]
