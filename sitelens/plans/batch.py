"""A whole run for many requests at once (R14): validate → crawl → extract → report → write.

Each accepted request is its own analysis scope (``site`` = request id), so
two requests for one origin never mix.  The crawl is the budgeted BFS over
the landed pages; style sheets are looked up only for requests with
``include_assets``; modes gate only the writes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.urls import strip_fragment
from sitelens.operators import crawl as CR
from sitelens.operators import links as LK
from sitelens.operators import requests as RQ
from sitelens.operators.corpus import first_seen
from sitelens.operators.robots import robots_status
from sitelens.plans.analysis import SiteAnalysis
from sitelens.plans.markdown import design_doc
from sitelens.plans.report import report_json, site_report
from sitelens.session import ensure_checkpoint_dir, materialize
from sitelens.sources.page_store import PageStore, land_pages

DEFAULT_GENERATED_AT = "2026-01-01T00:00:00.000Z"
MISSING_STATUS = 404  # a URL with no landed page answers Not Found


@dataclass
class BatchResult:
    requests: DataFrame  # accepted requests, defaults filled
    pages: DataFrame  # crawled page records per request
    css: DataFrame  # fetched style sheets per request
    reports: DataFrame  # site, report (nested), notes_text, primary_stack, primary_confidence
    outputs: DataFrame  # request_id, site, mode, report_json, design_doc
    robots: DataFrame  # site (= request id), robots_status
    stats: DataFrame  # crawl statistics per request (see crawl_statistics)


def crawled_pages(visited: DataFrame, store: PageStore) -> DataFrame:
    """Page records of the crawl: the landed row behind each visited URL, or a failed fetch.

    The visited set holds at most ``max_pages`` rows per request; the store, laid out by fetch key, stays in place.
    Output: site (= request), page_ord, url, final_url, status, error, html, store_site, store_url.
    """
    vk = visited.withColumn("key", strip_fragment(F.col("url")))
    rows = store.rows(vk.select("key").distinct(), ["site", "url", "final_url", "html", "raw_status", "message"])
    rec = vk.join(rows.select("key", F.col("site").alias("store_site"), F.col("url").alias("store_url"), "final_url", "html", "raw_status", "message"), "key", "left")
    missing = F.col("store_site").isNull()
    # the retry rule names the URL that was fetched: the visited one
    raw = F.when(missing, F.lit(MISSING_STATUS)).otherwise(F.col("raw_status"))
    status_c, error_c = CR.effective_status(raw, F.col("url"))
    no_answer = F.col("message").isNotNull()
    error_c = F.when(no_answer, F.col("message")).otherwise(error_c)
    html = F.when(error_c.isNotNull(), F.lit("")).otherwise(F.col("html"))
    return rec.select(F.col("request_id").alias("site"), (F.col("visit_no") - 1).alias("page_ord"), "url",
                      F.coalesce("final_url", "key").alias("final_url"), F.when(no_answer, F.lit(0)).otherwise(status_c).cast("int").alias("status"),
                      error_c.alias("error"), html.alias("html"), "store_site", "store_url")


def css_fetches(crawled: DataFrame, requests: DataFrame, css_store: DataFrame, fetch_log: DataFrame | None) -> DataFrame:
    """Every style sheet that a request with ``include_assets`` asks for, once, at its first link in the crawled pages.

    Of the store's rows of a URL, the first whose logged fetch was answered with 2xx is taken, whichever site it was
    landed for; a sheet without one, and an empty one, is a failed fetch (css is null).
    Output: site, css_url, page_ord, kind_rank, p1, p2, css, store_site (of the sheet, or of the linking page if it failed).
    """
    wanted = requests.where("include_assets").select(F.col("request_id").alias("site"))
    ok = crawled.join(wanted, "site", "left_semi").where(F.col("error").isNull())
    links = LK.css_links(LK.resolved_links(ok.select("site", "page_ord", F.col("final_url").alias("url"), "html")))
    links = links.join(ok.select("site", "page_ord", F.col("store_site").alias("page_site")), ["site", "page_ord"])
    first = materialize(first_seen(links, ["site", "url"], ["page_ord", "kind_rank", "p1", "p2"], ["page_site"]), "css-wanted")
    urls = first.select(F.col("url").alias("css_url")).distinct()
    # one store row per URL is chosen by its keys; the style sheet's text is looked up last
    rows = css_store.select("css_url", "site", "css_ord").join(urls, "css_url", "left_semi")
    if fetch_log is not None:
        failed = CR.fetch_state(fetch_log.where(F.col("kind") == "css")).where("error is not null").select("site", F.col("url").alias("css_url"))
        rows = rows.join(failed, ["site", "css_url"], "left_anti")
    keys = first_seen(rows, ["css_url"], ["site", "css_ord"], [])
    store = css_store.select("css_url", "css", "site", "css_ord").join(keys, ["css_url", "site", "css_ord"], "left_semi")
    got = first.withColumnRenamed("url", "css_url").join(store.select("css_url", F.col("css").alias("_css"), F.col("site").alias("_site")), "css_url", "left")
    css = F.when(F.col("_css") != "", F.col("_css"))
    return got.select("site", "css_url", "page_ord", "kind_rank", "p1", "p2", css.alias("css"),
                      F.when(css.isNotNull(), F.col("_site")).otherwise(F.col("page_site")).alias("store_site"))


def fetched_css(fetches: DataFrame) -> DataFrame:
    """The style sheets that were fetched, numbered in link order.  Output: site, css_ord, css_url, css, store_site."""
    w = Window.partitionBy("site").orderBy("page_ord", "kind_rank", "p1", "p2")
    return fetches.where("css is not null").select("site", (F.row_number().over(w) - 1).cast("bigint").alias("css_ord"), "css_url", "css", "store_site")


def crawl_statistics(reqs: DataFrame, crawled: DataFrame, fetches: DataFrame, fetch_log: DataFrame | None, robots: DataFrame) -> DataFrame:
    """S4 per request: pages, requests made (pages, and with ``include_assets`` style sheets), failed ones, the time from
    the first logged start to the last logged end, and the robots rule's status and warning.

    Output: site (= request), pages_crawled, total_requests, failed_requests, crawl_duration_ms, robots_status, robots_warning.
    """
    made = (crawled.select("site", F.lit("page").alias("kind"), F.col("error").isNotNull().alias("failed"), F.col("store_site").alias("s"), F.col("store_url").alias("u"))
            .unionByName(fetches.select("site", F.lit("css").alias("kind"), F.col("css").isNull().alias("failed"), F.col("store_site").alias("s"), F.col("css_url").alias("u"))))
    if fetch_log is None:
        made = made.select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("started_ms", "ended_ms")])
    else:
        # by the store's own site and URL: a sheet shared by sites counts only as this request fetched it
        log = CR.fetch_state(fetch_log).select(F.col("site").alias("s"), F.col("url").alias("u"), "kind", "started_ms", "ended_ms")
        made = made.join(log, ["s", "u", "kind"], "left")
    agg = made.groupBy("site").agg(F.count_if(F.col("kind") == "page").alias("pages_crawled"), F.count("*").alias("total_requests"),
                                   F.count_if("failed").alias("failed_requests"), (F.max("ended_ms") - F.min("started_ms")).alias("crawl_duration_ms"))
    out = reqs.select(F.col("request_id").alias("site")).join(agg, "site", "left").join(robots, "site", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("site", *[F.coalesce(c, zero).cast("bigint").alias(c) for c in ("pages_crawled", "total_requests", "failed_requests", "crawl_duration_ms")],
                      F.coalesce("robots_status", F.lit("allowed")).alias("robots_status"), "robots_warning")


@dataclass
class Crawl:
    requests: DataFrame  # accepted requests, defaults filled
    pages: DataFrame  # crawled page records per request
    css: DataFrame  # fetched style sheets per request
    stats: DataFrame  # crawl statistics per request (see crawl_statistics)


def crawl_requests(requests: DataFrame, pages: DataFrame | PageStore, css_store: DataFrame, fetch_log: DataFrame | None,
                   robots: DataFrame | None, links: DataFrame | None = None) -> Crawl:
    """The crawl of all accepted requests over landed pages, which are a page store or a table that is laid out first.

    ``links``: the store's whole link table (``crawl.store_links``), if built before; else the crawl parses the pages
    it visits, or finds their links in the store's cache.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    # Stage results are written as tables in the checkpoint folder: each is reused
    # by many report pieces, and the lineage behind them (crawl levels) is long.
    reqs = materialize(RQ.accepted_requests(requests), "requests")
    store = pages if isinstance(pages, PageStore) else land_pages(pages, fetch_log)
    visited = CR.site_bfs(reqs, store if links is None else links)
    crawled = materialize(crawled_pages(visited, store), "crawled-pages")
    fetches = materialize(css_fetches(crawled, reqs, css_store, fetch_log), "css-fetches")
    if robots is not None:
        rob = robots_status(robots)
        ruled = (reqs.join(rob, reqs["site"] == rob["origin"], "left")
                 .select(F.col("request_id").alias("site"), F.coalesce("status", F.lit("allowed")).alias("robots_status"), F.col("warning").alias("robots_warning")))
    else:
        ruled = reqs.select(F.col("request_id").alias("site"), F.lit("allowed").alias("robots_status"), F.lit(None).cast("string").alias("robots_warning"))
    stats = materialize(crawl_statistics(reqs, crawled, fetches, fetch_log, ruled), "crawl-statistics")
    return Crawl(reqs, crawled, fetched_css(fetches), stats)


def run_batch(requests: DataFrame, pages: DataFrame | PageStore, css_store: DataFrame, fetch_log: DataFrame | None,
              robots: DataFrame | None, generated_at: str = DEFAULT_GENERATED_AT,
              links: DataFrame | None = None) -> BatchResult:
    """Crawl all accepted requests (see ``crawl_requests``), analyse what they found, and make their texts."""
    crawl = crawl_requests(requests, pages, css_store, fetch_log, robots, links)
    reqs, crawled, stats = crawl.requests, crawl.pages, crawl.stats
    css = materialize(crawl.css, "crawled-css")
    site_rob = stats.select("site", "robots_status")
    # sources of inline styles and stack signals are the pages' final URLs (no fragment), as fetched
    analysed = crawled.select("site", "page_ord", F.col("final_url").alias("url"), "html")
    analysis = SiteAnalysis(analysed, css.drop("store_site"), reqs.select(F.col("request_id").alias("site")), site_rob)
    meta = stats.select("site", "pages_crawled", "crawl_duration_ms", "robots_status").join(
        reqs.select(F.col("request_id").alias("site"), F.col("theme_url").alias("source_url"), F.col("notes").alias("notes_text")), "site")
    reports = materialize(site_report(analysis, meta, generated_at), "reports")
    docs = design_doc(reports)
    outputs = (reqs.select(F.col("request_id"), F.col("request_id").alias("site"), "mode")
               .join(report_json(reports), "site").join(docs, "site"))
    return BatchResult(reqs, crawled, css, reports, outputs, site_rob, stats)
