"""Page and style-sheet sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators import links as LK
from sitelens.operators.corpus import first_seen
from sitelens.operators.crawl import effective_status, fetch_state, page_status, with_page_status
from sitelens.operators.robots import site_robots

SNIPPET_CHARS = 2000


def page_records(pages: DataFrame, fetch_log: DataFrame | None) -> DataFrame:
    """Page records — url, final url, status, error, first 2,000 characters, the three link lists.

    A failed fetch keeps an empty snippet and empty link lists; ``headers`` is
    always an empty map, as in the original.  One pass over the HTML cuts the
    snippet, makes the base and extracts the links; one aggregate per page puts
    them together, and only its short rows meet the fetch log.  A table with a
    ``crawled_at`` column hands it on.
    """
    extra = {"_url": F.col("url"), "_snip": F.substring("html", 1, SNIPPET_CHARS)}
    when = ["crawled_at"] if "crawled_at" in pages.columns else []
    extra |= {c: F.col(c) for c in when}
    rows = LK.listed(LK.page_rows(pages, extra))
    put = [F.max(c).alias(c) for c in when]  # only the page's first row holds it
    one = rows.groupBy(*LK.PAGE, "final_url").agg(F.max("_url").alias("url"), F.max("_snip").alias("_snip"), *put, *LK.link_lists(rows))
    out = with_page_status(one, fetch_log)
    ok = F.col("error").isNull()
    return out.select(
        "site", "page_ord", "url", "final_url", "status", "error",
        F.create_map().cast("map<string,string>").alias("headers"),
        F.when(ok, F.col("_snip")).otherwise(F.lit("")).alias("html_snippet"),
        *[F.when(ok, F.col(c)).otherwise(F.array().cast("array<string>")).alias(c) for c in LK.LISTS], *when)


def css_fetch_list(pages: DataFrame, fetch_log: DataFrame | None) -> DataFrame:
    """Distinct style-sheet links of a site's successfully fetched pages, first seen (page order, link order).

    Output: site, css_url, page_ord, kind_rank, p1, p2.
    """
    status = page_status(pages, fetch_log)
    ok = status.where(F.col("error").isNull()).select("site", "page_ord")
    links = LK.css_links(LK.resolved_links(pages).join(ok, ["site", "page_ord"], "left_semi"))
    out = first_seen(links, ["site", "url"], ["page_ord", "kind_rank", "p1", "p2"], [])
    return out.withColumnRenamed("url", "css_url")


def css_assets_fetched(pages: DataFrame, fetch_log: DataFrame | None, store: DataFrame) -> DataFrame:
    """The link list looked up in the fetched style-sheet store; missing or empty content failed, and so did
    a sheet whose logged fetch was not answered with 2xx.

    Output: site, css_url, page_ord, kind_rank, p1, p2, fetched, css (null when failed).
    """
    wanted = css_fetch_list(pages, fetch_log)
    got = store.select("site", "css_url", "css")
    out = wanted.join(got, ["site", "css_url"], "left")
    if fetch_log is None:
        out = out.withColumn("_error", F.lit(None).cast("string"))
    else:
        log = fetch_state(fetch_log.where(F.col("kind") == "css")).select("site", F.col("url").alias("css_url"), F.col("error").alias("_error"))
        out = out.join(log, ["site", "css_url"], "left")
    fetched = F.col("css").isNotNull() & (F.col("css") != "") & F.col("_error").isNull()
    return out.select("site", "css_url", "page_ord", "kind_rank", "p1", "p2", fetched.alias("fetched"),
                      F.when(fetched, F.col("css")).alias("css"))


def fetch_outcomes(fetch_log: DataFrame) -> DataFrame:
    """Counts per (site, kind, outcome): ``ok``, ``HTTP n`` or ``error`` (status 0 after retries)."""
    eff, err = effective_status(F.col("status"), F.col("url"))
    outcome = F.when(err.isNull(), F.lit("ok")).when(eff == 0, F.lit("error")).otherwise(err)
    return (fetch_log.select("site", "kind", outcome.alias("outcome"), eff.alias("status"))
            .groupBy("site", "kind", "outcome", "status").agg(F.count("*").cast("bigint").alias("n")))


def crawl_stats(sites: DataFrame, fetch_log: DataFrame, robots: DataFrame, store: DataFrame) -> DataFrame:
    """Per site pages, total requests (pages + style sheets), failed requests, duration, robots status.

    A page fails on any non-2xx outcome; a style sheet fails unless it was answered with 2xx and has content.
    """
    full = store.where("css <> ''").select("site", F.col("css_url").alias("url"), F.lit("css").alias("kind"), F.lit(True).alias("_full")).distinct()
    failed = F.col("error").isNotNull() | ((F.col("kind") == "css") & F.col("_full").isNull())
    agg = (fetch_state(fetch_log).join(full, ["site", "url", "kind"], "left")
           .select("site", "kind", failed.alias("failed"), "started_ms", "ended_ms").groupBy("site")).agg(
        F.count_if(F.col("kind") == "page").cast("bigint").alias("pages_crawled"),
        F.count("*").cast("bigint").alias("total_requests"),
        F.count_if("failed").cast("bigint").alias("failed_requests"),
        (F.max("ended_ms") - F.min("started_ms")).cast("bigint").alias("crawl_duration_ms"))
    rob = site_robots(sites, robots)
    zero = F.lit(0).cast("bigint")
    return (sites.join(agg, "site", "left").join(rob, "site", "left")
            .select("site", *[F.coalesce(c, zero).alias(c) for c in
                              ("pages_crawled", "total_requests", "failed_requests", "crawl_duration_ms")],
                    F.coalesce("robots_status", F.lit("allowed")).alias("robots_status")))
