"""Tokens under Structured Streaming (optional extension, survey §7.7).

Style blocks, declarations and colour literals are stateless per page, so the
batch operators run unchanged on a ``readStream`` of landed pages.  The
per-site colour registry is a streaming de-duplication on (site, value): its
state is the set of distinct tokens per site (use the RocksDB state store
provider at scale).  Order differs from the batch rule: the first *arriving*
declaration wins, since pages arrive over time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.operators import corpus as C
from sitelens.operators import tokens as T

PAGES_SCHEMA = "page_id bigint, page_ord bigint, site string, url string, html string"


def color_stream(pages: DataFrame) -> DataFrame:
    """Colour literals of custom properties, one row per declaration (stateless)."""
    decls = T.declarations(C.css_corpus(pages, None))
    color = F.regexp_extract(F.col("value"), P.java_rx(P.COLOR), 0)
    return decls.select("site", "source_url", F.concat(F.lit("--"), "name").alias("name"),
                        color.alias("value")).where(F.col("value") != "")


def color_registry(pages: DataFrame) -> DataFrame:
    """Distinct colours per site, first arrival kept (streaming state keyed by site and value)."""
    return color_stream(pages).dropDuplicates(["site", "value"])


def run_available(spark: SparkSession, pages_path: str, out_path: str, checkpoint: str,
                  files_per_batch: int = 1) -> None:
    """Process every landed page file now (several micro-batches), append the registry to parquet."""
    pages = (spark.readStream.schema(PAGES_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
             .parquet(pages_path))
    query = (color_registry(pages).writeStream.format("parquet").option("path", out_path)
             .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
