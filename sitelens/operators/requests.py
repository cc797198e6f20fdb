"""Requests as a table: validation (V1) and defaults (V2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.urls import origin, with_resolved_url

REQUEST_COLS = ["request_id", "theme_url", "max_pages", "same_origin_only", "include_assets", "mode", "notes"]


def validate_requests(requests: DataFrame) -> DataFrame:
    """V1: errors per request (in rule order) and ``valid`` = no errors.

    url required / parseable / http(s); max_pages in 1..20 when given; mode in the set when given.
    """
    parsed = with_resolved_url(requests.select(*REQUEST_COLS), "theme_url", None, "_parsed")
    url = F.col("theme_url")
    scheme = F.regexp_extract(F.col("_parsed"), r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    lo, hi = P.MAX_PAGES_RANGE
    errors = F.array_compact(F.array(
        F.when(url.isNull() | (url == ""), F.lit(P.ERR_URL_REQUIRED))
        .when(F.col("_parsed").isNull(), F.lit(P.ERR_URL_INVALID))
        .when(~scheme.isin("http", "https"), F.lit(P.ERR_URL_SCHEME)),
        F.when(F.col("max_pages").isNotNull() & ((F.col("max_pages") < lo) | (F.col("max_pages") > hi)),
               F.lit(P.ERR_MAX_PAGES)),
        F.when(F.col("mode").isNotNull() & ~F.col("mode").isin(*P.MODES), F.lit(P.ERR_MODE))))
    return parsed.select(*REQUEST_COLS, errors.alias("errors")).withColumn("valid", F.size("errors") == 0)


def normalize_requests(requests: DataFrame) -> DataFrame:
    """V2: fill defaults; add the canonical seed and its origin (the ``site`` key)."""
    filled = requests.select(
        "request_id", "theme_url",
        F.coalesce("max_pages", F.lit(P.DEFAULT_MAX_PAGES)).cast("int").alias("max_pages"),
        F.coalesce("same_origin_only", F.lit(P.DEFAULT_SAME_ORIGIN_ONLY)).alias("same_origin_only"),
        F.coalesce("include_assets", F.lit(P.DEFAULT_INCLUDE_ASSETS)).alias("include_assets"),
        F.coalesce("mode", F.lit(P.DEFAULT_MODE)).alias("mode"),
        F.coalesce("notes", F.lit(P.DEFAULT_NOTES)).alias("notes"))
    seeded = with_resolved_url(filled, "theme_url", None, "seed")
    return seeded.withColumn("site", origin(F.col("seed")))


def accepted_requests(requests: DataFrame) -> DataFrame:
    """Valid requests with defaults filled (the input of a batch run)."""
    valid = validate_requests(requests).where("valid").select(*REQUEST_COLS)
    return normalize_requests(valid)
