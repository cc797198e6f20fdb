"""Technology-stack detection (K1-K4).

The 35 weighted patterns are a static 35-row dimension.  Documents are never
cross-joined with it: one projection tests every literal pattern against the
document (each regex compiles once per task) and emits the small array of
pattern numbers that hit; only those ints travel on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions import patterns as P


def pattern_dimension(spark: SparkSession) -> DataFrame:
    """The fixed detector table: k, detector_idx, pattern_idx, detector, category, weight, evidence."""
    rows = [(k, d, p, name, cat, float(w), ev) for k, (d, p, name, cat, w, ev, _rx) in enumerate(P.stack_patterns())]
    return spark.createDataFrame(
        rows, "k int, detector_idx bigint, pattern_idx bigint, detector string, category string, "
              "weight double, evidence string")


def pattern_hits(docs: DataFrame) -> DataFrame:
    """K1: which (document, pattern) pairs hit.

    Input: site, src_rank, src_ord, source_url, content.
    Output: site, src_rank, src_ord, source_url, detector_idx, pattern_idx, detector, category, weight, evidence.
    """
    flags = F.array(*[F.when(F.col("content").rlike(P.java_rx(rx, True)), F.lit(k))
                      for k, (*_, rx) in enumerate(P.stack_patterns())])
    hits = docs.select("site", "src_rank", "src_ord", "source_url",
                       F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("k"))
    dim = pattern_dimension(docs.sparkSession)
    # 35 fixed rows: a proven size bound, so broadcasting it is safe at any scale.
    return hits.join(F.broadcast(dim), "k").drop("k")


def stack_signals(hits: DataFrame) -> DataFrame:
    """K2: one row per (site, detector) with evidence in pattern order and the boosted confidence.

    confidence = min(max weight + min(0.1 * (n - 1), 0.15), 1) over the n distinct patterns hit.
    """
    per_pattern = hits.select("site", "detector_idx", "pattern_idx", "detector", "category", "weight",
                              "evidence").distinct()
    agg = per_pattern.groupBy("site", "detector_idx", "detector", "category").agg(
        F.max("weight").alias("max_weight"),
        F.count("*").cast("bigint").alias("n_evidence"),
        F.array_sort(F.collect_list(F.struct("pattern_idx", "evidence"))).alias("_ev"))
    boost = F.least(F.lit(0.1) * (F.col("n_evidence") - 1), F.lit(0.15))
    return agg.select("site", "detector_idx", "detector", "category", "n_evidence",
                      F.least(F.col("max_weight") + boost, F.lit(1.0)).alias("confidence"),
                      F.transform("_ev", lambda x: x["evidence"]).alias("evidence"))


def signal_sources(hits: DataFrame) -> DataFrame:
    """K3: distinct source URLs per signal with their first-seen key (pattern, page-then-CSS, order)."""
    first = F.min(F.struct("pattern_idx", "src_rank", "src_ord")).alias("_k")
    return (hits.groupBy("site", "detector_idx", "detector", "source_url").agg(first)
            .select("site", "detector_idx", "detector", "source_url",
                    F.col("_k.pattern_idx").alias("pattern_idx"), F.col("_k.src_rank").alias("src_rank"),
                    F.col("_k.src_ord").alias("src_ord")))


def ranked_stack(signals: DataFrame) -> DataFrame:
    """K4: rank per site by confidence, ties in detector order (at most 12 rows per site)."""
    w = Window.partitionBy("site").orderBy(F.col("confidence").desc(), F.col("detector_idx"))
    return signals.withColumn("stack_rank", F.row_number().over(w).cast("bigint"))


def primary_stack(signals: DataFrame) -> DataFrame:
    return ranked_stack(signals).where(F.col("stack_rank") == 1).drop("stack_rank")
