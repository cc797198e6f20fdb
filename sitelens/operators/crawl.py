"""Budgeted breadth-first page selection over landed pages (L8) and fetch outcomes.

The crawl of the reference is a FIFO queue per site: pop, skip visited,
mark visited, skip off-origin (vs. the seed), fetch, enqueue the page's
internal links, stop at ``max_pages`` pages (failed fetches count).  Here
all requests advance together, one level per iteration:

  frontier ⋈ links of its pages → candidates → origin filter → anti-join visited
  → first per (request, url) by (parent visit_no, link order)
  → visit_no = pages so far + rank → keep ``<= max_pages``

which equals the queue (duplicates in the queue are dropped at pop time and
children queue in parent order, then link order).  A level holds at most
``max_pages`` (<= 20) rows per request, so the per-request window is
bounded.  Levels go on until one is empty.  Lineage is cut every level by writing the level as a table in the
session's checkpoint folder (``session.materialize``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.urls import origin, strip_fragment, with_resolved_url
from sitelens.operators import links as LK
from sitelens.operators.corpus import first_seen
from sitelens.session import ensure_checkpoint_dir, materialize


def effective_status(status: F.Column, url: F.Column) -> tuple[F.Column, F.Column]:
    """(status, error) after the retry rule: 2xx ok; no status, 0, 429 and 5xx end as status 0 after the retries; else ``HTTP n``."""
    failed = status.isNull() | (status == 0) | (status == 429) | (status >= 500)
    ok = (status >= 200) & (status < 300)
    eff = F.when(failed, F.lit(0)).otherwise(status).cast("int")
    err = (F.when(failed, F.format_string(f"Failed to fetch %s after {P.FETCH_RETRIES} attempts", url))
           .when(ok, F.lit(None).cast("string"))
           .otherwise(F.concat(F.lit("HTTP "), status.cast("string"))))
    return eff, err


def fetch_state(fetch_log: DataFrame) -> DataFrame:
    """The log as one row per (site, url, kind): the last answer's status and error, first start and last end.

    A log may carry an ``error`` text (no HTTP answer at all); it wins over the status, which becomes 0.
    """
    message = F.col("error") if "error" in fetch_log.columns else F.lit(None).cast("string")
    last = F.max(F.struct("ended_ms", "started_ms", "status", message.alias("message"))).alias("_last")
    one = fetch_log.groupBy("site", "url", "kind").agg(last, F.min("started_ms").alias("started_ms"), F.max("ended_ms").alias("ended_ms"))
    eff, err = effective_status(F.col("_last.status"), F.col("url"))
    no_answer = F.col("_last.message").isNotNull()
    return one.select("site", "url", "kind", F.col("_last.status").alias("raw_status"), F.col("_last.message").alias("message"),
                      F.when(no_answer, F.lit(0)).otherwise(eff).cast("int").alias("status"),
                      F.when(no_answer, F.col("_last.message")).otherwise(err).alias("error"), "started_ms", "ended_ms")


def with_page_status(pages: DataFrame, fetch_log: DataFrame | None) -> DataFrame:
    """``pages`` (site, url, …) with status, error, raw_status and message from the fetch log, after the retry rule for
    this URL: 200 when not logged; a logged page without a status failed."""
    if fetch_log is None:
        return pages.select("*", F.lit(200).alias("status"), F.lit(None).cast("string").alias("error"),
                            F.lit(200).alias("raw_status"), F.lit(None).cast("string").alias("message"))
    log = fetch_state(fetch_log.where(F.col("kind") == "page")).select(
        "site", "url", "status", "error", "raw_status", "message", F.lit(True).alias("_logged"))
    out = pages.join(log, ["site", "url"], "left")
    default = lambda c: F.when(F.col("_logged"), F.col(c)).otherwise(F.lit(200)).cast("int").alias(c)
    return out.select(*pages.columns, default("status"), "error", default("raw_status"), "message")


def page_status(pages: DataFrame, fetch_log: DataFrame | None) -> DataFrame:
    """Status of each landed page.  Output: site, page_ord, url, status, error, raw_status, message."""
    return with_page_status(pages.select("site", "page_ord", "url"), fetch_log)


def page_keys(pages: DataFrame) -> DataFrame:
    """Landed pages by fetch key: the canonical URL without fragment (fragments never reach a server)."""
    canon = with_resolved_url(pages.select("site", "page_ord", "url"), "url", None, "_c")
    return canon.select("site", "page_ord", "url", strip_fragment(F.col("_c")).alias("key")).where(
        F.col("key").isNotNull())


def store_rows(pages: DataFrame, status: DataFrame) -> DataFrame:
    """One landed row per fetch key, the first by (site, page_ord): its status decides, and only its links are followed.

    Output: key, site, page_ord, url, raw_status, message, error.
    """
    keyed = page_keys(pages).join(status.drop("url", "status"), ["site", "page_ord"])
    return first_seen(keyed, ["key"], ["site", "page_ord"], ["url", "raw_status", "message", "error"])


def store_links(pages: DataFrame, status: DataFrame) -> DataFrame:
    """Internal links of the landed row behind each fetch key, if it was fetched.

    One narrow pass over the HTML; only short link rows meet the keys.  The
    table depends on the store alone: a caller with many batches builds it once
    and hands it to each.  Output: key, pos (link order), target.
    """
    ok = store_rows(pages, status).where(F.col("error").isNull()).select("key", "site", "page_ord")
    internal = LK.internal_links(LK.resolved_links(pages)).join(ok, ["site", "page_ord"])
    return internal.select("key", F.struct("kind_rank", "p1", "p2").alias("pos"), F.col("url").alias("target"))


class LinkTable:
    """A store's whole link table (``store_links``), asked like a page store."""

    def __init__(self, links: DataFrame):
        self.table = materialize(links, "bfs-links")

    def links(self, keys: DataFrame) -> DataFrame | None:
        return None if keys.isEmpty() else self.table.join(keys, "key", "left_semi")


def site_bfs(requests: DataFrame, store) -> DataFrame:
    """The pages each request would crawl, in crawl order.

    Input requests: request_id, seed (canonical URL, may be null), max_pages, same_origin_only.
    ``store``: a page store (``sources.page_store``), which reads and parses the pages of a level only, or a link
    table made before.  Output: request_id, url, visit_no (1-based crawl order), level.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    if isinstance(store, DataFrame):
        store = LinkTable(store)
    request = ["request_id", "max_pages", "same_origin_only", "seed_origin"]
    first = (requests.where(F.col("seed").isNotNull() & (F.col("max_pages") >= 1))
             .select("request_id", "max_pages", "same_origin_only", origin(F.col("seed")).alias("seed_origin"), F.col("seed").alias("url"),
                     F.lit(1).cast("bigint").alias("visit_no"), F.lit(0).cast("bigint").alias("level"), F.lit(1).cast("bigint").alias("n")))
    # a frontier row carries its request's options and the number of pages so far (n): a level joins links and nothing else
    frontier = visited = materialize(first, "bfs-level")
    level = 0
    while True:  # every level visits a page of some request, so the largest budget bounds the levels
        level += 1
        at = frontier.withColumn("key", strip_fragment(F.col("url")))
        links = store.links(at.select("key"))
        if links is None:  # no row in the frontier
            break
        cand = at.join(links, "key").select(*request, "n", F.col("target").alias("url"), F.col("visit_no").alias("parent"), "pos")
        cand = cand.where(~F.col("same_origin_only") | F.coalesce(origin(F.col("url")) == F.col("seed_origin"), F.lit(False)))
        cand = cand.join(visited.select("request_id", "url"), ["request_id", "url"], "left_anti")
        found = cand.groupBy(*request, "n", "url").agg(F.min(F.struct("parent", "pos")).alias("_o"))
        own = Window.partitionBy("request_id")
        new = found.select(*request, "url", (F.col("n") + F.row_number().over(own.orderBy("_o"))).cast("bigint").alias("visit_no"),
                           F.lit(level).cast("bigint").alias("level"), F.least(F.col("n") + F.count("*").over(own), F.col("max_pages")).cast("bigint").alias("n"))
        frontier = materialize(new.where(F.col("visit_no") <= F.col("max_pages")), "bfs-level")
        # every piece is materialised, so the union's lineage stays one level deep per piece
        visited = visited.unionByName(frontier)
    return visited.select("request_id", "url", "visit_no", "level")
