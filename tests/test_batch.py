"""The whole run on the smallest scale: modes gate the writes; the report and document are complete."""

import json
import uuid

from pyspark.sql import functions as F

from conftest import SF001, SF01
from sitelens.plans.batch import run_batch
from sitelens.plans.catalog import Inputs
from sitelens.session import ensure_checkpoint_dir
from sitelens.sources.sinks import read_back, write_design_doc, write_report_json


def test_modes_gate_writes(spark):
    i = Inputs(spark, SF001)
    reqs = i.requests.where(~F.col("request_id").startswith("invalid"))
    first3 = [r[0] for r in reqs.orderBy("request_id").limit(3).collect()]
    modes = dict(zip(first3, ["extract", "prompt", "both"]))
    mode = F.create_map(*[x for k, v in modes.items() for x in (F.lit(k), F.lit(v))])[F.col("request_id")]
    reqs = reqs.where(F.col("request_id").isin(first3)).withColumn("mode", mode) \
        .withColumn("include_assets", F.lit(True)).withColumn("notes", F.lit("team notes"))
    res = run_batch(reqs, i.pages_themed, i.css_assets, i.fetch_log, i.robots, generated_at="2026-02-03T04:05:06Z")
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-sinks-{uuid.uuid4().hex}"
    write_report_json(res.outputs, f"{root}/json")
    write_design_doc(res.outputs, f"{root}/md")
    js = {r["request_id"]: r["text"] for r in read_back(spark, f"{root}/json").collect()}
    md = {r["request_id"]: r["text"] for r in read_back(spark, f"{root}/md").collect()}
    assert set(js) == {k for k, v in modes.items() if v in ("extract", "both")}
    assert set(md) == {k for k, v in modes.items() if v in ("prompt", "both")}
    for text in js.values():
        rep = json.loads(text)
        assert rep["meta"]["generatedAt"] == "2026-02-03T04:05:06Z"
        assert 1 <= rep["meta"]["pagesCrawled"] <= 6
        assert len(rep["accessibilitySignals"]) == 5
        assert rep["tokens"]["spacing"] == []
        assert rep["layout"]["gridSystem"] in ("css-grid", "flexbox", "bootstrap-grid", "unknown")
        assert all(0 <= s["confidence"] <= 1 for s in rep["stackSignals"])
    for text in md.values():
        assert text.startswith("# Design System Documentation\n")
        assert "### User Context\nteam notes\n" in text
        assert "## 12. Quick Start Code" in text


def test_confidence_bounds(spark):
    from sitelens.plans.catalog import queries
    sig = queries()["stack_signals"](spark, SF01)
    lo, hi = sig.agg(F.min("confidence"), F.max("confidence")).first()
    assert 0 <= lo <= hi <= 1


def test_report_lists_match_flat_analysis(spark):
    from sitelens.plans.analysis import SiteAnalysis
    from sitelens.plans.report import run_summary

    i = Inputs(spark, SF001)
    reqs = i.requests.withColumn("include_assets", F.lit(True))
    res = run_batch(reqs, i.pages_themed, i.css_assets, i.fetch_log, i.robots)
    flat = run_summary(SiteAnalysis(res.pages, res.css, res.requests.select(F.col("request_id").alias("site")),
                                    res.robots))
    want = {r["site"]: r for r in flat.collect()}
    r = F.col("report")
    got = res.reports.select(
        "site", F.size(r["stackSignals"]).alias("n_signals"), F.size(r["tokens"]["colors"]).alias("n_colors"),
        F.size(r["tokens"]["typography"]).alias("n_typography"), F.size(r["tokens"]["radii"]).alias("n_radii"),
        F.size(r["tokens"]["shadows"]).alias("n_shadows"), F.size(r["componentPatterns"]).alias("n_components"),
        F.size(r["accessibilitySignals"]).alias("n_a11y"), F.size(r["risks"]).alias("n_risks"),
        F.try_element_at(r["stackSignals"], F.lit(1))["name"].alias("primary")).collect()
    assert len(got) == len(want) > 0
    n_comp = 0
    for g in got:
        w = want[g["site"]]
        for c in ("n_signals", "n_colors", "n_typography", "n_radii", "n_shadows", "n_components", "n_a11y", "n_risks"):
            assert g[c] == w[c], (g["site"], c)
        assert g["primary"] == w["primary_stack"]
        n_comp += g["n_components"]
    assert n_comp > 0  # style sheets were fetched and analysed


def test_link_table_built_once_gives_the_same(spark):
    """A link table built beforehand changes neither the pages nor the texts."""
    from sitelens.operators import crawl as CR

    i = Inputs(spark, SF001)
    reqs = i.requests.where(F.crc32("request_id") % 4 == 0)
    links = CR.store_links(i.pages_themed, CR.page_status(i.pages_themed, i.fetch_log))
    a = run_batch(reqs, i.pages_themed, i.css_assets, i.fetch_log, i.robots)
    b = run_batch(reqs, i.pages_themed, i.css_assets, i.fetch_log, i.robots, links=links)
    for name, cols in (("pages", ["site", "page_ord", "url", "status", "error"]), ("outputs", ["site", "report_json", "design_doc"])):
        key = lambda res: sorted(tuple(map(str, r)) for r in getattr(res, name).select(*cols).collect())  # noqa: B023, E731
        assert key(a) == key(b)
