"""Links of pages.

One narrow pass over each page's HTML extracts the raw ``href``/``src``
values of stylesheet links, ``@import`` rules, script sources and anchors
into a long table of short rows; the HTML is dropped right there.  URLs are
then resolved against the page's canonical final URL and de-duplicated per
page, first seen (a partial aggregate keyed by page and URL).

Link order key per page: ``(kind_rank, p1, p2)`` — stylesheet links
(kind 0), ``type=text/css`` links (1), ``@import`` in style tags (2, by
block then import), script sources (3), anchors (4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.text import find_all
from sitelens.functions.urls import origin, strip_fragment, strip_query_fragment, with_resolved_url
from sitelens.operators.corpus import first_seen

PAGE = ["site", "page_ord"]
LINK_ORD = ["kind_rank", "p1", "p2"]
KINDS = {0: "css", 1: "css", 2: "css", 3: "js", 4: "anchor"}


def landed_url(pages: DataFrame) -> F.Column:
    """Where each page was answered: its ``final_url`` (after redirects) if the table has one, else its URL."""
    return F.coalesce("final_url", "url") if "final_url" in pages.columns else F.col("url")


def page_bases(pages: DataFrame) -> DataFrame:
    """Canonical final URL (no fragment) of each page: the base for its links."""
    canon = with_resolved_url(pages.select(*PAGE, "url", landed_url(pages).alias("_landed")), "_landed", None, "_canon")
    return canon.select(*PAGE, "url", strip_fragment(F.col("_canon")).alias("final_url"))


def link_array(html: F.Column, kinds: tuple[int, ...] = tuple(KINDS)) -> F.Column:
    """All raw link values of a page's HTML, in page order, as an array of (kind_rank, p1, p2, href)."""
    href_of = lambda tag: F.regexp_extract(tag, P.java_rx(P.HREF_IN_TAG), 1)
    has_href = lambda tag: tag.rlike(P.java_rx(P.HREF_IN_TAG))

    def tagged(kind: int, tags, value, keep=None):
        items = F.filter(F.transform(tags, lambda t: F.struct(value(t).alias("href"),
                                                              (keep(t) if keep else F.lit(True)).alias("ok"))),
                         lambda s: s["ok"])
        return F.transform(items, lambda s, i: F.struct(F.lit(kind).alias("kind_rank"), i.alias("p1"),
                                                        F.lit(0).alias("p2"), s["href"].alias("href")))

    found = {
        0: lambda: tagged(0, find_all(html, P.LINK_STYLESHEET), href_of, has_href),
        1: lambda: tagged(1, find_all(html, P.LINK_TEXT_CSS), href_of, has_href),
        2: lambda: F.flatten(F.transform(
            find_all(html, P.STYLE_BLOCK, 1),
            lambda body, b: F.transform(find_all(body, P.CSS_IMPORT, 1),
                                        lambda h, j: F.struct(F.lit(2).alias("kind_rank"), b.alias("p1"),
                                                              j.alias("p2"), h.alias("href"))))),
        3: lambda: tagged(3, find_all(html, P.SCRIPT_SRC, 1), lambda v: v),
        4: lambda: tagged(4, find_all(html, P.ANCHOR_HREF, 1), lambda v: v),
    }
    return F.concat(*[found[k]() for k in kinds])


def link_rows(pages: DataFrame, every: F.Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """An array of raw links as rows.  Output: site, page_ord, *keep, kind_rank, p1, p2, href."""
    return pages.select(*PAGE, *keep, F.inline(every)).select(
        *PAGE, *keep, F.col("kind_rank").cast("bigint"), F.col("p1").cast("bigint"), F.col("p2").cast("bigint"),
        "href")


def raw_links(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw link values of each page, in page order.  Output: site, page_ord, *keep, kind_rank, p1, p2, href."""
    return link_rows(pages, link_array(F.col("html")), keep)


def resolved_links(pages: DataFrame) -> DataFrame:
    """Every raw link resolved against its page.  Output: site, page_ord, final_url, kind_rank, p1, p2, href, url.

    One narrow pass: the page's own URL is canonicalised in the same rows
    that carry its HTML, then the link values are exploded and resolved — no
    join of link rows back to their pages.
    """
    based = with_resolved_url(pages.select(*PAGE, landed_url(pages).alias("_landed"), "html"), "_landed", None, "_canon")
    based = based.select(*PAGE, strip_fragment(F.col("_canon")).alias("final_url"), "html")
    return with_resolved_url(raw_links(based, ("final_url",)), "href", "final_url", "url")


def _dedup(df: DataFrame) -> DataFrame:
    # final_url depends on the page only; keeping it as a key carries it through at no cost
    return first_seen(df, [*PAGE, "final_url", "url"], LINK_ORD, [])


def css_links(resolved: DataFrame) -> DataFrame:
    """L4: stylesheet, text/css and @import links per page, resolved, de-duplicated, no origin filter."""
    return _dedup(resolved.where((F.col("kind_rank") <= 2) & F.col("url").isNotNull()))


def js_links(resolved: DataFrame) -> DataFrame:
    """Script sources per page, resolved, de-duplicated."""
    return _dedup(resolved.where((F.col("kind_rank") == 3) & F.col("url").isNotNull()))


def anchor_links(resolved: DataFrame) -> DataFrame:
    """Anchors that are not mailto/tel/javascript/data/fragment-only, resolved (invalid dropped)."""
    return resolved.where((F.col("kind_rank") == 4) & ~F.col("href").rlike(P.java_rx(P.SKIPPED_SCHEMES))
                          & F.col("url").isNotNull())


def internal_anchors(resolved: DataFrame) -> DataFrame:
    """Anchors of the page's final origin, query and fragment stripped, every occurrence."""
    same = F.coalesce(origin(F.col("url")) == origin(F.col("final_url")), F.lit(False))
    return anchor_links(resolved).where(same).withColumn("url", strip_query_fragment(F.col("url")))


def internal_links(resolved: DataFrame) -> DataFrame:
    """Anchors of the page's final origin, query and fragment stripped, de-duplicated."""
    return _dedup(internal_anchors(resolved))


#: The three link lists of a page.
LISTS = ("css_links", "js_links", "internal_links")


def listed(resolved: DataFrame) -> DataFrame:
    """Resolved links with the list they belong to (``list``, null for none) and the URL as that list holds it."""
    url, kind = F.col("url"), F.col("kind_rank")
    internal = ((kind == 4) & ~F.col("href").rlike(P.java_rx(P.SKIPPED_SCHEMES))
                & F.coalesce(origin(url) == origin(F.col("final_url")), F.lit(False)))
    out = resolved.withColumn("list", F.when(url.isNull(), F.lit(None)).when(kind <= 2, "css_links").when(kind == 3, "js_links").when(internal, "internal_links"))
    return out.withColumn("url", F.when(F.col("list") == "internal_links", strip_query_fragment(url)).otherwise(url))


def link_lists(rows: DataFrame) -> list[F.Column]:
    """Aggregates of ``listed`` rows of one page: each list in link order, a URL at its first place."""
    item = F.struct(*LINK_ORD, "url")
    return [F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == name, item))), lambda s: s["url"])).alias(name) for name in LISTS]


def page_rows(pages: DataFrame, extra: dict[str, F.Column] | None = None) -> DataFrame:
    """The resolved links of every page from one pass over the HTML; a page without links gives one row of nulls.

    Output: site, page_ord, final_url, *extra (on the page's first row only), kind_rank, p1, p2, href, url.
    """
    extra = extra or {}
    based = with_resolved_url(pages.select(*PAGE, landed_url(pages).alias("_landed"), "html", *[c.alias(n) for n, c in extra.items()]), "_landed", None, "_canon")
    based = based.select(*PAGE, strip_fragment(F.col("_canon")).alias("final_url"), *extra, link_array(F.col("html")).alias("_links"))
    rows = based.select(*PAGE, "final_url", *extra, F.posexplode_outer("_links").alias("_n", "_link"))
    first = F.coalesce("_n", F.lit(0)) == 0
    rows = rows.select(*PAGE, "final_url", *[F.when(first, F.col(n)).alias(n) for n in extra],
                       *[F.col(f"_link.{c}").cast("bigint").alias(c) for c in LINK_ORD], F.col("_link.href").alias("href"))
    return with_resolved_url(rows, "href", "final_url", "url")


def page_links(pages: DataFrame) -> DataFrame:
    """The three ordered lists per page (a page's links are bounded by the page itself): one scan, one aggregate."""
    rows = listed(page_rows(pages))
    return rows.groupBy(*PAGE).agg(*link_lists(rows))


def canonical_urls(resolved: DataFrame) -> DataFrame:
    """L1: distinct canonical URLs per site with their number of occurrences (invalid links dropped)."""
    return (resolved.where(F.col("url").isNotNull()).groupBy("site", "url")
            .agg(F.count("*").cast("bigint").alias("n_links")))


def pages_per_origin(pages: DataFrame) -> DataFrame:
    """L2: pages per origin of their canonical URL (null origin for invalid URLs)."""
    canon = with_resolved_url(pages.select("url"), "url", None, "_canon")
    return canon.groupBy(origin(F.col("_canon")).alias("origin")).agg(F.count("*").cast("bigint").alias("n_pages"))


def link_origin_split(resolved: DataFrame) -> DataFrame:
    """L3: anchors per site split into same-origin and cross-origin (false when either side is invalid)."""
    a = anchor_links(resolved)
    same = F.coalesce(origin(F.col("url")) == origin(F.col("final_url")), F.lit(False))
    return a.groupBy("site").agg(F.count_if(same).cast("bigint").alias("n_same_origin"),
                                 F.count_if(~same).cast("bigint").alias("n_cross_origin"))


def link_counts(resolved: DataFrame) -> DataFrame:
    """Per site, distinct CSS, JS and internal links (the sizes of the crawl's link sets); a site counts once a raw link is found."""
    each = listed(resolved).select("site", "list", F.when(F.col("list").isNotNull(), F.col("url")).alias("url")).distinct()
    return each.groupBy("site").agg(*[F.count_if(F.col("list") == name).cast("bigint").alias(f"n_{name}") for name in LISTS])
