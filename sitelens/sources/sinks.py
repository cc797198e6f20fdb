"""Sinks (S6, S7): report JSON and design document per request, gated by mode.

Texts are rows ``(request_id, text)`` in packed files with a committed manifest
(``sources.packed``): a failed or repeated task leaves no second text of a
request, and a rerun replaces all texts at once.  Ids are data, so they come
back as they were.  One file per request is an explicit export.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.sources.packed import read_packed, write_packed

JSON_MODES = ("extract", "both")
DOC_MODES = ("prompt", "both")


def _rows(outputs: DataFrame, modes: tuple[str, ...], column: str) -> DataFrame:
    return outputs.where(F.col("mode").isin(*modes)).select("request_id", F.col(column).alias("text"))


def write_report_json(outputs: DataFrame, path: str) -> None:
    """``theme_report.json`` text per request (modes extract/both)."""
    write_packed(_rows(outputs, JSON_MODES, "report_json"), path)


def write_design_doc(outputs: DataFrame, path: str) -> None:
    """``design_system.md`` text per request (modes prompt/both)."""
    write_packed(_rows(outputs, DOC_MODES, "design_doc"), path)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Written texts again: request_id, text."""
    return read_packed(spark, path).select("request_id", "text")


def export_files(texts: DataFrame, path: str) -> None:
    """One text file per request, in a folder named by its id — for a bounded number of requests."""
    texts.select("request_id", "text").write.mode("overwrite").partitionBy("request_id").text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Exported files again: request_id (as written, never taken for a number), text (the writer's final newline removed)."""
    df = spark.read.schema("value string, request_id string").text(path, wholetext=True)
    value = F.col("value")
    text = F.when(value.endswith("\n"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(value)
    return df.select("request_id", text.alias("text"))
