"""Risks (K17) and notes (K18) per site, from per-site aggregates joined on ``site``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import patterns as P

MANY_COLORS = 50


def site_facts(sites: DataFrame, colors: DataFrame, signals: DataFrame, robots: DataFrame,
               pages: DataFrame, css: DataFrame | None) -> DataFrame:
    """Inputs of the risk and note rules, one row per site."""
    n_colors = colors.groupBy("site").agg(F.count("*").alias("n_colors"))
    stacks = signals.groupBy("site").agg(
        F.bool_or(F.col("detector") == "Bootstrap").alias("bootstrap"),
        F.bool_or(F.col("detector") == "Tailwind CSS").alias("tailwind"))
    n_pages = pages.groupBy("site").agg(F.count("*").alias("n_pages"))
    out = (sites.join(n_colors, "site", "left").join(stacks, "site", "left")
           .join(robots.select("site", "robots_status"), "site", "left").join(n_pages, "site", "left"))
    if css is not None:
        out = out.join(css.groupBy("site").agg(F.count("*").alias("n_css")), "site", "left")
    else:
        out = out.withColumn("n_css", F.lit(0))
    zero = F.lit(0).cast("bigint")
    return out.select(
        "site", F.coalesce("n_colors", zero).cast("bigint").alias("n_colors"),
        F.coalesce("bootstrap", F.lit(False)).alias("bootstrap"), F.coalesce("tailwind", F.lit(False)).alias("tailwind"),
        F.coalesce("robots_status", F.lit("allowed")).alias("robots_status"),
        F.coalesce("n_pages", zero).cast("bigint").alias("n_pages"), F.coalesce("n_css", zero).cast("bigint").alias("n_css"))


def note_facts(sites: DataFrame, pages: DataFrame, css: DataFrame | None) -> DataFrame:
    """Inputs of the note rule only: pages and fetched style sheets per site."""
    n_pages = pages.groupBy("site").agg(F.count("*").alias("n_pages"))
    out = sites.join(n_pages, "site", "left")
    if css is not None:
        out = out.join(css.groupBy("site").agg(F.count("*").alias("n_css")), "site", "left")
    else:
        out = out.withColumn("n_css", F.lit(0))
    zero = F.lit(0).cast("bigint")
    return out.select("site", F.coalesce("n_pages", zero).cast("bigint").alias("n_pages"),
                      F.coalesce("n_css", zero).cast("bigint").alias("n_css"))


def risk_list(facts: DataFrame) -> DataFrame:
    """Risks per site as an ordered array: many colours, Bootstrap + Tailwind, robots blocked."""
    risks = F.array_compact(F.array(
        F.when(F.col("n_colors") > MANY_COLORS, F.lit(P.RISK_MANY_COLORS)),
        F.when(F.col("bootstrap") & F.col("tailwind"), F.lit(P.RISK_TWO_FRAMEWORKS)),
        F.when(F.col("robots_status") == "blocked", F.lit(P.RISK_ROBOTS))))
    return facts.select("site", risks.alias("risks"))


def risks(facts: DataFrame) -> DataFrame:
    """K17 as a long table: site, risk_ord, risk."""
    return risk_list(facts).select("site", F.posexplode("risks").alias("risk_ord", "risk")).select(
        "site", F.col("risk_ord").cast("bigint"), "risk")


def note_list(facts: DataFrame) -> DataFrame:
    notes = F.array_compact(F.array(
        F.when((F.col("n_css") == 0) & (F.col("n_pages") > 0), F.lit(P.NOTE_NO_EXTERNAL_CSS))))
    return facts.select("site", notes.alias("notes"))


def notes(facts: DataFrame) -> DataFrame:
    """K18 as a long table: site, note_ord, note."""
    return note_list(facts).select("site", F.posexplode("notes").alias("note_ord", "note")).select(
        "site", F.col("note_ord").cast("bigint"), "note")
