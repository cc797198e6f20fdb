"""Small builders for hand-written test inputs."""

from pyspark.sql import functions as F

from sitelens.plans.analysis import SiteAnalysis

SITE = "https://s.test"


def pages_of(spark, *htmls, site=SITE):
    rows = [(site, i, f"{site}/p{i}", h) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "site string, page_ord bigint, url string, html string")


def inline(spark, css, site=SITE):
    return pages_of(spark, f"<html><head><style>{css}</style></head><body></body></html>", site=site)


def css_of(spark, *sheets, site=SITE):
    rows = [(site, i, f"{site}/c{i}.css", c) for i, c in enumerate(sheets)]
    return spark.createDataFrame(rows, "site string, css_ord bigint, css_url string, css string")


def analysis(spark, pages, css=None, extra_sites=()):
    sites = pages.select("site").union(spark.createDataFrame([(s,) for s in extra_sites], "site string")).distinct()
    return SiteAnalysis(pages, css, sites)


def rows(df, *cols, order=None):
    out = df.select(*cols)
    if order:
        out = out.orderBy(*order)
    return [tuple(r) for r in out.collect()]
