"""Pages laid out by fetch key: what a level reads, what a second run parses, clean-up of runs."""

import uuid

from pyspark.sql import functions as F

from conftest import SF001
from sitelens.operators import crawl as CR
from sitelens.operators import requests as RQ
from sitelens.plans.batch import crawl_requests
from sitelens.plans.catalog import Inputs, queries
from sitelens.session import drop_materialized, ensure_checkpoint_dir, materialize, run_scope
from sitelens.sources import page_store as PS

S = "https://s.test"
PAGES = "site string, page_ord bigint, url string, html string"
LOG = "site string, url string, kind string, status int, started_ms bigint, ended_ms bigint"


def rows(df, *cols):
    return sorted(map(str, df.select(*cols).collect()))


def site(spark, n=60):
    return spark.createDataFrame([(S, k, f"{S}/p{k}", f'<style>.a{k % 7}{{}}</style><a href="/p{k + 1}">x</a><a href="/p{k + 2}">y</a>') for k in range(n)], PAGES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_literal_keys_prune_buckets(spark):
    store = PS.land_pages(site(spark), None, buckets=16)
    keys = spark.createDataFrame([(f"{S}/p3",), (f"{S}/p4",), (f"{S}/none",)], "key string")
    got = store.links(keys)
    assert rows(got, "key", "target") == rows(spark.createDataFrame([(f"{S}/p{k}", f"{S}/p{k + d}") for k in (3, 4) for d in (1, 2)], "key string, target string"), "key", "target")
    text = got._jdf.queryExecution().toString()
    assert "SelectedBucketsCount: 3 out of 16" in text or "SelectedBucketsCount: 2 out of 16" in text


def test_many_keys_move_the_keys_and_not_the_store(spark, monkeypatch):
    monkeypatch.setattr(PS, "LITERAL_KEYS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = PS.land_pages(site(spark), None, buckets=8)
        keys = store.bodies.select("key").where(F.crc32("key") % 2 == 0).distinct()
        got = store.rows(keys, ["site", "html", "error"])
        # every scan of the store is bucketed, and above it there is no exchange up to the join
        lines = plan(got).splitlines()
        depth = lambda line: len(line) - len(line.lstrip(" :+-*(0123456789)"))
        for k, line in enumerate(lines):
            if "Scan parquet" in line and "html" in line:
                above, at = [], depth(line)
                for up in reversed(lines[:k]):
                    if depth(up) < at:
                        above.append(up)
                        at = depth(up)
                assert not any("Exchange" in x for x in above), plan(got)
        assert got.count() == keys.count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_crawl_is_the_same_by_store_cache_and_link_table(spark, monkeypatch):
    i = Inputs(spark, SF001)
    reqs = RQ.accepted_requests(i.requests)
    cols = ["request_id", "url", "visit_no", "level"]
    table = rows(CR.site_bfs(reqs, CR.store_links(i.pages_themed, CR.page_status(i.pages_themed, i.fetch_log))), *cols)
    cache = PS.PageCache(spark, f"{ensure_checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}")
    assert rows(CR.site_bfs(reqs, i.page_store), *cols) == table
    assert rows(CR.site_bfs(reqs, PS.land_pages(i.pages_themed, i.fetch_log, cache)), *cols) == table
    monkeypatch.setattr(PS, "LITERAL_KEYS", 0)
    assert rows(CR.site_bfs(reqs, i.page_store), *cols) == table


def test_second_run_parses_nothing(spark):
    cache = PS.PageCache(spark, f"{ensure_checkpoint_dir(spark)}/cache-{uuid.uuid4().hex}")
    pages = site(spark)
    store = PS.land_pages(pages, None, cache)
    assert cache.read().count() == 60 and store.refresh() == 0
    again = PS.land_pages(pages, None, cache)  # another crawl that found the same contents
    assert cache.read().count() == 60
    keys = pages.select(F.col("url").alias("key"))
    assert rows(again.links(keys), "key", "pos", "target") == rows(PS.land_pages(pages, None).links(keys), "key", "pos", "target")
    assert "html#" not in plan(again.links(keys)).replace("html_hash#", "")  # no HTML is read for links
    changed = pages.withColumn("html", F.when(F.col("page_ord") % 20 == 0, F.concat("html", F.lit("<a href=/new>"))).otherwise(F.col("html")))
    assert PS.land_pages(changed, None, cache).links(keys).where("target like '%/new'").count() == 0  # an unquoted href is no link
    assert cache.read().count() == 63
    reqs = spark.createDataFrame([("r", f"{S}/p0", 5, True, False, None, None)], "request_id string, theme_url string, max_pages int, same_origin_only boolean, include_assets boolean, mode string, notes string")
    css = spark.createDataFrame([], "site string, css_ord bigint, css_url string, css string")
    one, two = (crawl_requests(reqs, s, css, None, None) for s in (store, pages))
    for name in ("pages", "stats"):
        assert rows(getattr(one, name), "*") == rows(getattr(two, name), "*")


def test_first_landed_row_of_a_key_decides(spark):
    pages = spark.createDataFrame([(S, 1, f"{S}/p#f", '<a href="/y">y</a>'), (S, 0, f"{S}/p", '<a href="/x">x</a>'), (S, 2, "not a url", "")], PAGES)
    log = spark.createDataFrame([(S, f"{S}/p", "page", 200, 0, 1), (S, f"{S}/p#f", "page", 404, 1, 2)], LOG)
    store = PS.land_pages(pages, log)
    assert [r["target"] for r in store.links(spark.createDataFrame([(f"{S}/p",)], "key string")).collect()] == [f"{S}/x"]
    assert store.bodies.count() == 1 and PS.land_pages(pages.limit(0), log).bodies.count() == 0


def test_a_run_deletes_its_own_tables_only(spark):
    other = materialize(spark.range(5), "other")
    with run_scope() as run:
        mine = materialize(spark.range(3), "mine")
        store = PS.land_pages(site(spark, 3), None)
        assert mine.count() == 3 and store.bodies.count() == 3
    assert drop_materialized(spark, run) >= 3 and drop_materialized(spark, run) == 0
    assert other.count() == 5
    before = queries()["color_usage_counts"](spark, SF001).count()
    drop_materialized(spark)
    assert queries()["color_usage_counts"](spark, SF001).count() == before > 0
