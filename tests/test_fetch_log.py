"""The fetch log decides: one row per fetch, one landed row per key, redirects, durations (hand-made cases)."""

import uuid

from pyspark.sql import functions as F

from sitelens.operators import crawl as CR
from sitelens.operators import links as LK
from sitelens.plans.batch import run_batch
from sitelens.session import drop_materialized, ensure_checkpoint_dir, materialize
from sitelens.sources import pages as SP
from sitelens.sources.sinks import export_files, read_back, read_files, write_report_json

S, T = "https://s.test", "https://t.test"
PAGES = "site string, page_ord bigint, url string, html string"
LOG = "site string, url string, kind string, status int, started_ms bigint, ended_ms bigint"
CSS = "site string, css_ord bigint, css_url string, css string"
REQ = "request_id string, theme_url string, max_pages int, same_origin_only boolean, include_assets boolean, mode string, notes string"
SHEET = '<link rel="stylesheet" href="{}">'


def batch(spark, pages, css=(), log=(), url=f"{S}/p", include=True, site_requests=None):
    reqs = site_requests or [("r", url, 20, True, include, None, None)]
    return run_batch(spark.createDataFrame(reqs, REQ), spark.createDataFrame(pages, PAGES) if isinstance(pages, list) else pages,
                     spark.createDataFrame(list(css), CSS), spark.createDataFrame(list(log), LOG) if log else None, None)


def test_failed_and_empty_sheets(spark):
    pages = [(S, 0, f"{S}/p", "".join(SHEET.format(f"/{k}.css") for k in "abcd"))]
    css = [(S, 0, f"{S}/a.css", ".btn { color: red }"), (S, 1, f"{S}/b.css", ""), (S, 2, f"{S}/c.css", ".card { color: red }")]
    log = [(S, f"{S}/p", "page", 200, 0, 10), (S, f"{S}/a.css", "css", 500, 10, 20), (S, f"{S}/b.css", "css", 200, 20, 30), (S, f"{S}/c.css", "css", 200, 30, 40)]
    p, c, g = spark.createDataFrame(pages, PAGES), spark.createDataFrame(css, CSS), spark.createDataFrame(log, LOG)
    got = {r["css_url"][-5:]: r["fetched"] for r in SP.css_assets_fetched(p, g, c).collect()}
    assert got == {"a.css": False, "b.css": False, "c.css": True, "d.css": False}
    robots = spark.createDataFrame([], "origin string, body string")
    stats = SP.crawl_stats(spark.createDataFrame([(S,)], "site string"), g, robots, c).first()
    assert (stats["total_requests"], stats["failed_requests"], stats["crawl_duration_ms"]) == (4, 2, 40)
    res = batch(spark, pages, css, log)
    assert [r["css_url"] for r in res.css.collect()] == [f"{S}/c.css"]
    assert drop_materialized(spark) > 0


def test_duration_is_the_requests_own(spark):
    pages = [(S, 0, f"{S}/p#f", SHEET.format("https://cdn.test/x.css")), (T, 0, f"{T}/q", SHEET.format("https://cdn.test/x.css"))]
    css = [(S, 0, "https://cdn.test/x.css", ".a{}"), (T, 0, "https://cdn.test/x.css", ".a{}")]
    log = [(S, f"{S}/p#f", "page", 200, 1000, 1100), (S, "https://cdn.test/x.css", "css", 200, 1300, 1400),
           (T, f"{T}/q", "page", 200, 900_000, 900_100), (T, "https://cdn.test/x.css", "css", 200, 900_200, 900_500)]
    meta = F.col("report.meta.crawlDuration")
    assert batch(spark, pages, css, log).reports.select(meta).first()[0] == 400


def test_one_landed_row_decides(spark):
    pages = [(S, 0, f"{S}/p", '<a href="/x">x</a>'), (S, 1, f"{S}/p#f", '<a href="/y">y</a>')]
    log = [(S, f"{S}/p", "page", 404, 0, 1), (S, f"{S}/p#f", "page", 200, 1, 2)]
    got = [(r["url"], r["status"], r["error"]) for r in batch(spark, pages, log=log).pages.collect()]
    assert got == [(f"{S}/p", 404, "HTTP 404")]


def test_no_status_and_repeated_log_rows(spark):
    p = spark.createDataFrame([(S, 0, f"{S}/p", ""), (S, 1, f"{S}/q", ""), (S, 2, f"{S}/r", "")], PAGES)
    g = spark.createDataFrame([(S, f"{S}/p", "page", None, 0, 1), (S, f"{S}/q", "page", 503, 0, 1), (S, f"{S}/q", "page", 200, 2, 3)], LOG)
    got = {r["url"][-1]: (r["status"], r["error"]) for r in CR.page_status(p, g).collect()}
    assert got["p"][0] == 0 and got["p"][1].startswith("Failed to fetch") and got["q"] == (200, None) and got["r"] == (200, None)
    assert SP.page_records(p, g).count() == 3
    told = g.withColumn("error", F.when(F.col("url") == f"{S}/q", F.lit("socket hang up")))
    assert {r["url"][-1]: r["error"] for r in CR.page_status(p, told).collect()}["q"] == "socket hang up"


def test_redirects(spark):
    rows = [(S, 0, f"{S}/p", '<a href="a">a</a><a href="https://s.test/b">b</a>', f"{T}/deep/z"), (S, 1, f"{S}/b", "", None)]
    p = spark.createDataFrame(rows, PAGES + ", final_url string")
    links = LK.internal_links(LK.resolved_links(p)).collect()
    assert [(r["url"]) for r in links] == [f"{T}/deep/a"]  # links and their origin follow the answering URL
    assert LK.page_bases(p).where("page_ord = 0").first()["final_url"] == f"{T}/deep/z"
    got = batch(spark, p).pages.orderBy("page_ord").collect()
    assert [(r["url"], r["final_url"]) for r in got] == [(f"{S}/p", f"{T}/deep/z")]  # the queue is checked against the seed


def test_sink_ids_stay(spark):
    out = spark.createDataFrame([("007", "both", "{}"), ("7", "extract", "[1]"), ("x", "prompt", "no")], "request_id string, mode string, report_json string")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sink-{uuid.uuid4().hex}"
    write_report_json(out, f"{root}/rows")
    want = [("007", "{}"), ("7", "[1]")]
    assert sorted(map(tuple, read_back(spark, f"{root}/rows").collect())) == want
    export_files(read_back(spark, f"{root}/rows"), f"{root}/files")
    assert sorted(map(tuple, read_files(spark, f"{root}/files").collect())) == want


def test_drop_materialized(spark):
    kept = materialize(spark.range(3), "gone")
    assert kept.count() == 3 and drop_materialized(spark) >= 1 and drop_materialized(spark) == 0
