"""Accessibility signals.

Flags and counts are computed per document (narrow), then summed / OR-ed per
site with partial aggregation; the HTML never reaches the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.text import count_matches, find_all


def page_flags(pages: DataFrame) -> DataFrame:
    """Per page: skip link, ARIA count, images, images with alt, the four landmarks."""
    html = F.col("html")
    imgs = find_all(html, P.IMG_TAG)
    return pages.select(
        "site",
        html.rlike(P.java_rx(P.SKIP_LINK)).alias("skip"),
        count_matches(html, P.ARIA_ATTR).alias("aria"),
        F.size(imgs).cast("bigint").alias("imgs"),
        F.size(F.filter(imgs, lambda t: t.rlike(P.java_rx(P.ALT_ATTR)))).cast("bigint").alias("imgs_alt"),
        *[html.rlike(P.java_rx(rx)).alias(f"lm{i}") for i, rx in enumerate(P.LANDMARKS)])


def css_flags(css: DataFrame) -> DataFrame:
    """Per external style sheet: ``:focus-visible`` and ``:focus … outline``."""
    return css.select("site", F.col("css").rlike(P.java_rx(P.FOCUS_VISIBLE)).alias("focus_visible"),
                      F.col("css").rlike(P.java_rx(P.FOCUS_OUTLINE)).alias("focus_outline"))


def site_a11y(sites: DataFrame, pages: DataFrame, css: DataFrame | None) -> DataFrame:
    """Per site aggregate of all accessibility inputs; every site of ``sites`` is kept."""
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    p = page_flags(pages).groupBy("site").agg(
        any_(F.col("skip")).alias("skip"), F.sum("aria").alias("aria"), F.sum("imgs").alias("imgs"),
        F.sum("imgs_alt").alias("imgs_alt"), *[any_(F.col(f"lm{i}")).alias(f"lm{i}") for i in range(4)])
    out = sites.join(p, "site", "left")
    if css is not None:
        c = css_flags(css).groupBy("site").agg(any_(F.col("focus_visible")).alias("focus_visible"),
                                               any_(F.col("focus_outline")).alias("focus_outline"))
        out = out.join(c, "site", "left")
    else:
        out = out.withColumn("focus_visible", F.lit(False)).withColumn("focus_outline", F.lit(False))
    false = F.lit(False)
    zero = F.lit(0).cast("bigint")
    landmarks = sum(F.coalesce(F.col(f"lm{i}"), false).cast("bigint") for i in range(4))
    return out.select(
        "site",
        F.coalesce("skip", false).alias("skip"),
        F.coalesce("focus_visible", false).alias("focus_visible"),
        F.coalesce("focus_outline", false).alias("focus_outline"),
        F.coalesce("aria", zero).cast("bigint").alias("aria_count"),
        F.coalesce("imgs", zero).cast("bigint").alias("img_count"),
        F.coalesce("imgs_alt", zero).cast("bigint").alias("img_alt_count"),
        landmarks.cast("bigint").alias("landmark_count"))


def _skip(a):
    present = F.col("skip")
    return (present, F.when(present, F.lit(P.SKIP_LINK_DETAIL)), F.lit(P.A11Y_SNIPPETS[0]),
            F.when(present, 0.9).otherwise(0.5))


def _focus(a):
    fv, fo = F.col("focus_visible"), F.col("focus_outline")
    return (fv | fo, F.when(fv, F.lit(P.FOCUS_VISIBLE_DETAIL)).when(fo, F.lit(P.FOCUS_OUTLINE_DETAIL)),
            F.lit(P.A11Y_SNIPPETS[1]), F.when(fv, 0.9).when(fo, 0.7).otherwise(0.4))


def _aria(a):
    n = F.col("aria_count")
    return (n > 5, F.format_string("Found %d ARIA attributes", n), F.format_string("%d aria-* attributes", n),
            F.when(n > 20, 0.9).when(n > 5, 0.7).otherwise(0.4))


def _alt(a):
    total, with_alt = F.col("img_count"), F.col("img_alt_count")
    cov = F.when(total > 0, with_alt / total).otherwise(F.lit(1.0))
    pct = F.floor(cov * 100 + 0.5).cast("bigint")
    return (cov > 0.8, F.format_string("%d/%d images have alt text (%d%%)", with_alt, total, pct),
            F.lit(P.A11Y_SNIPPETS[3]), F.when(cov > 0.9, 0.9).when(cov > 0.7, 0.7).otherwise(0.5))


def _semantic(a):
    n = F.col("landmark_count")
    return (n >= 3, F.format_string("Uses %d/4 semantic landmarks (nav, main, header, footer)", n),
            F.lit(P.A11Y_SNIPPETS[4]), F.when(n >= 3, 0.85).when(n >= 2, 0.6).otherwise(0.4))


SIGNALS = [_skip, _focus, _aria, _alt, _semantic]
SOURCE_TYPES = ["html", "css", "html", "html", "html"]


def signal(agg: DataFrame, idx: int) -> DataFrame:
    """One of K7-K11 per site: present, details, snippet, confidence."""
    present, details, snip, conf = SIGNALS[idx](agg)
    return agg.select("site", F.lit(idx).cast("bigint").alias("feature_ord"), F.lit(P.A11Y_FEATURES[idx]).alias("feature"),
                      present.alias("present"), details.alias("details"), F.lit(SOURCE_TYPES[idx]).alias("source_type"),
                      snip.cast("string").alias("snippet"), conf.cast("double").alias("confidence"))


def a11y_report(agg: DataFrame) -> DataFrame:
    """The five signals per site, always five rows, in fixed order.

    One pass over the per-site aggregate: the five rows are an inline array of
    structs (no union that would recompute the aggregate five times).
    """
    rows = []
    for idx, fn in enumerate(SIGNALS):
        present, details, snip, conf = fn(agg)
        rows.append(F.struct(F.lit(idx).cast("bigint").alias("feature_ord"), F.lit(P.A11Y_FEATURES[idx]).alias("feature"),
                             present.alias("present"), details.alias("details"),
                             F.lit(SOURCE_TYPES[idx]).alias("source_type"), snip.cast("string").alias("snippet"),
                             conf.cast("double").alias("confidence")))
    return agg.select("site", F.inline(F.array(*rows)))
