"""Layout facts (K13-K16) over external CSS only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.text import js_trim, snippet
from sitelens.operators.corpus import first_seen, matches


def container_widths(css: DataFrame) -> DataFrame:
    """``.container… { … max-width: v`` values, in order, not de-duplicated; conf .8; snippet 80."""
    rows = matches(css, "css", P.CONTAINER_WIDTH, groups=(1,), keep=["css_ord"])
    return rows.select("site", "css_ord", "pos", js_trim(F.col("g1")).alias("value"),
                       snippet(F.col("m"), 80).alias("snippet"), F.lit(P.CONF_CONTAINER).alias("confidence"))


def breakpoints(css: DataFrame) -> DataFrame:
    """min/max-width of media queries (the last condition of each), distinct first seen; snippet 60."""
    rows = matches(css, "css", P.MEDIA_WIDTH, groups=(1,), keep=["css_ord"])
    rows = rows.select("site", "css_ord", "pos", js_trim(F.col("g1")).alias("value"),
                       snippet(F.col("m"), 60).alias("snippet"))
    return first_seen(rows, ["site", "value"], ["css_ord", "pos"], ["snippet"]).withColumn(
        "confidence", F.lit(P.CONF_BREAKPOINT))


def grid_system(sites: DataFrame, css: DataFrame | None) -> DataFrame:
    """Css-grid, else flexbox; bootstrap-grid overrides both; else unknown; with the evidence list."""
    if css is None:
        flags = sites.select("site", *[F.lit(False).alias(c) for c in ("grid", "flex", "cols")])
    else:
        per_doc = css.select("site", F.col("css").rlike(P.java_rx(P.GRID_DISPLAY)).alias("grid"),
                             F.col("css").rlike(P.java_rx(P.FLEX_DISPLAY)).alias("flex"),
                             F.col("css").rlike(P.java_rx(P.BOOTSTRAP_COLUMNS)).alias("cols"))
        per_site = per_doc.groupBy("site").agg(*[F.bool_or(c).alias(c) for c in ("grid", "flex", "cols")])
        flags = sites.join(per_site, "site", "left").select(
            "site", *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("grid", "flex", "cols")])
    g, f, b = F.col("grid"), F.col("flex"), F.col("cols")
    system = F.when(b, "bootstrap-grid").when(g, "css-grid").when(f, "flexbox").otherwise("unknown")
    evidence = F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in zip((g, f, b), P.GRID_EVIDENCE)]))
    return flags.select("site", system.alias("grid_system"), evidence.alias("grid_evidence"))


def layout_info(sites: DataFrame, css: DataFrame | None) -> DataFrame:
    """Per site grid system, evidence and the number of container widths and breakpoints."""
    grid = grid_system(sites, css)
    if css is None:
        return grid.select("site", "grid_system", "grid_evidence", F.lit(0).cast("bigint").alias("n_container_widths"),
                           F.lit(0).cast("bigint").alias("n_breakpoints"))
    cw = container_widths(css).groupBy("site").agg(F.count("*").alias("n_container_widths"))
    bp = breakpoints(css).groupBy("site").agg(F.count("*").alias("n_breakpoints"))
    out = grid.join(cw, "site", "left").join(bp, "site", "left")
    return out.select("site", "grid_system", "grid_evidence",
                      F.coalesce("n_container_widths", F.lit(0)).cast("bigint").alias("n_container_widths"),
                      F.coalesce("n_breakpoints", F.lit(0)).cast("bigint").alias("n_breakpoints"))
