"""Corpus building: style blocks, the CSS corpus, the content corpus, first-seen dedup.

Order is data.  Every row extracted from the corpus carries the order key
``(src_rank, src_ord, block_ord, pos)``: ``src_rank`` 0 = inline ``<style>``
of a page, 1 = external style sheet; ``src_ord`` = page order or style-sheet
order; ``block_ord`` = n-th ``<style>`` of the page; ``pos`` = n-th match.

Pages are narrow inputs: ``html`` is reduced to style blocks or flags in the
first projection and never reaches a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.text import find_all, rx

ORD = ["src_rank", "src_ord", "block_ord"]


def style_blocks(pages: DataFrame) -> DataFrame:
    """Bodies of ``<style>`` tags per page, in order.

    Input: site, page_ord, url, html.  Output: site, page_ord, source_url, block_ord, css.
    The whole match is kept and every ``<style…>``/``</style>`` token in it is
    removed, as the rule does.
    """
    blocks = F.transform(find_all(F.col("html"), P.STYLE_BLOCK, 0),
                         lambda m: F.regexp_replace(m, P.java_rx(P.STYLE_TAG), ""))
    return (pages.select("site", "page_ord", F.col("url").alias("source_url"),
                         F.posexplode(blocks).alias("block_ord", "css"))
            .withColumn("block_ord", F.col("block_ord").cast("bigint")))


def css_corpus(pages: DataFrame, css_assets: DataFrame | None) -> DataFrame:
    """Inline blocks (page order) then external style sheets (fetch order).

    Output: site, src_rank, src_ord, block_ord, source_url, css.
    """
    inline = style_blocks(pages).select(
        "site", F.lit(0).cast("bigint").alias("src_rank"), F.col("page_ord").alias("src_ord"),
        "block_ord", "source_url", "css")
    if css_assets is None:
        return inline
    external = css_assets.select(
        "site", F.lit(1).cast("bigint").alias("src_rank"), F.col("css_ord").cast("bigint").alias("src_ord"),
        F.lit(0).cast("bigint").alias("block_ord"), F.col("css_url").alias("source_url"), "css")
    return inline.unionByName(external)


def content_corpus(pages: DataFrame, css_assets: DataFrame | None) -> DataFrame:
    """Page HTML and external CSS as separate documents (never concatenated).

    Output: site, src_rank, src_ord, source_url, content.
    """
    docs = pages.select("site", F.lit(0).cast("bigint").alias("src_rank"), F.col("page_ord").alias("src_ord"),
                        F.col("url").alias("source_url"), F.col("html").alias("content"))
    if css_assets is None:
        return docs
    return docs.unionByName(css_assets.select(
        "site", F.lit(1).cast("bigint").alias("src_rank"), F.col("css_ord").cast("bigint").alias("src_ord"),
        F.col("css_url").alias("source_url"), F.col("css").alias("content")))


def external_css(css_assets: DataFrame | None) -> DataFrame | None:
    """External style sheets as analysed by the CSS-only rules: site, css_ord, css_url, css."""
    return None if css_assets is None else css_assets.select(
        "site", F.col("css_ord").cast("bigint").alias("css_ord"), "css_url", "css")


def matches(df: DataFrame, text: str, pattern: str, groups: Sequence[int] = (), keep: Sequence[str] = ORD,
            ) -> DataFrame:
    """Explode all matches of ``pattern`` in column ``text``.

    The document is scanned once for whole matches; capture groups are
    re-read from each (short) match.  Output: site, *keep, pos, m, g1, g2…
    """
    java = P.java_rx(pattern)
    found = F.regexp_extract_all(F.col(text), rx(pattern), F.lit(0))
    out = df.select("site", *keep, F.posexplode(found).alias("pos", "m"))
    cols = [F.regexp_extract("m", java, g).alias(f"g{g}") for g in groups]
    return out.select("site", *keep, F.col("pos").cast("bigint").alias("pos"), "m", *cols)


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Keep the first row (by ``order``) for each key.

    Written as a grouped ``min`` over a struct that starts with the order
    columns, so the work is a hash/sort aggregate with a map-side partial
    step: a key that repeats in every page of a huge site is combined before
    the shuffle and never lands whole in one task.
    """
    best = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in payload])).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in (*order, *payload)])


def last_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Keep the last row (by ``order``) for each key, as a whole row."""
    best = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in payload])).alias("_last")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in (*order, *payload)])


def site_seeds(pages: DataFrame) -> DataFrame:
    """Start URL of each site: its first page."""
    return first_seen(pages, ["site"], ["page_ord"], ["url"]).select("site", F.col("url").alias("start_url"))
