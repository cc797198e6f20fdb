"""Style sheets held as files (S3): whole texts with their keys, packed into few files (see ``sources.packed``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.sources.packed import read_packed, write_packed


def write_css_files(css_assets: DataFrame, path: str) -> None:
    """Land all style sheets in bundles; the number of files depends on the tasks and not on the sheets."""
    write_packed(css_assets.select("site", F.col("css_ord").cast("bigint").alias("css_ord"), "css"), path, text="css")


def read_css_files(spark: SparkSession, path: str) -> DataFrame:
    """Landed style sheets again.  Output: site, css_ord, css_path (bundle and offset), css."""
    return read_packed(spark, path).select("site", "css_ord", F.col("packed_path").alias("css_path"), "css")
