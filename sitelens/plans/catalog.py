"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Outputs are flat (strings, bigints, doubles, booleans) so that they compare
one-to-one with the oracle SQL; nested per-site documents are built in
``plans.report``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.operators import a11y as A
from sitelens.operators import components as CP
from sitelens.operators import corpus as C
from sitelens.operators import crawl as CR
from sitelens.operators import layout as LY
from sitelens.operators import links as LK
from sitelens.operators import requests as RQ
from sitelens.operators import risks as RK
from sitelens.operators import robots as RB
from sitelens.operators import stack as S
from sitelens.operators import tokens as T
from sitelens.plans import batch as BT
from sitelens.plans import markdown as MD
from sitelens.plans import report as RP
from sitelens.plans.analysis import SiteAnalysis
from sitelens.session import ensure_checkpoint_dir, materialize, read_table, table_state
from sitelens.sources import files as FL
from sitelens.sources import fixtures as FX
from sitelens.sources import pages as SP
from sitelens.sources.page_store import PageStore, land_pages
from sitelens.sources import sinks as SK
from sitelens.streaming import tokens as ST

# sf_dir -> folder holding pre-derived ``pages_themed`` / ``css_assets`` parquet
# (the bench lands them once, as a crawl would).
PREPARED: dict[str, str] = {}

# Derived input tables are deterministic and read-only: once written for an
# application and a state of the data folder, later queries of the same application
# reuse them.  They belong to no run, so no run's clean-up deletes them.
_DERIVED: dict[tuple, object] = {}


class Inputs:
    """Per-call inputs; the shared intermediate frames are built once per query plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _prepared(self, name: str) -> DataFrame | None:
        root = PREPARED.get(self.sf_dir)
        return self.spark.read.parquet(f"{root}/{name}") if root else None

    @cached_property
    def pages(self) -> DataFrame:
        return read_table(self.spark, self.sf_dir, "pages")

    @cached_property
    def _source(self) -> tuple:
        root = PREPARED.get(self.sf_dir)
        return (self.spark.sparkContext.applicationId, self.sf_dir, root, table_state(self.spark, f"{self.sf_dir.rstrip('/')}/pages.parquet"))

    def _once(self, name: str, build):
        """What ``build`` makes, once per application and state of the data."""
        key = (*self._source, name)
        if key not in _DERIVED:
            _DERIVED[key] = build()
        return _DERIVED[key]

    def _derived(self, name: str, build) -> DataFrame:
        """A derived input table, written once to the checkpoint folder: many branches (and queries) read it."""
        return self._once(name, lambda: materialize(build(), f"derived-{name}", keep=True))

    @cached_property
    def pages_themed(self) -> DataFrame:
        return self._prepared("pages_themed") or self._derived(
            "pages_themed", lambda: FX.pages_themed_frame(self.spark, self.pages))

    @cached_property
    def css_assets(self) -> DataFrame:
        return self._prepared("css_assets") or self._derived(
            "css_assets", lambda: FX.run_sql(self.spark, FX.CSS_ASSETS_SQL, pages_themed=self.pages_themed))

    @cached_property
    def requests(self) -> DataFrame:
        return FX.run_sql(self.spark, FX.REQUESTS_SQL, pages_themed=self.pages_themed)

    @cached_property
    def fetch_log(self) -> DataFrame:
        return FX.run_sql(self.spark, FX.FETCH_LOG_SQL, pages_themed=self.pages_themed, css_assets=self.css_assets)

    @cached_property
    def page_store(self) -> PageStore:
        """The landed pages laid out by fetch key, as a crawl leaves them."""
        return self._once("page_store", lambda: land_pages(self.pages_themed, self.fetch_log, keep=True))

    @cached_property
    def robots(self) -> DataFrame:
        return FX.run_sql(self.spark, FX.ROBOTS_SQL, pages_themed=self.pages_themed)

    @cached_property
    def sites(self) -> DataFrame:
        return self.pages_themed.select("site").distinct()

    @cached_property
    def corpus(self) -> DataFrame:
        return C.css_corpus(self.pages_themed, self.css_assets)

    @cached_property
    def decls(self) -> DataFrame:
        return T.declarations(self.corpus)


REGISTRY: dict[str, Callable[[Inputs], DataFrame]] = {}


def register(name: str):
    def deco(fn: Callable[[Inputs], DataFrame]):
        REGISTRY[name] = fn
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
    return {name: bind(fn) for name, fn in REGISTRY.items()}


ORD = ["src_rank", "src_ord", "block_ord"]

# ---------------------------------------------------------------------------
# Fixtures and corpus
# ---------------------------------------------------------------------------


@register("fixture_pages_themed")
def _q_pages_themed(i: Inputs) -> DataFrame:
    return i.pages_themed.select("page_id", "page_ord", "site", "url", "html")


@register("fixture_css_assets")
def _q_css_assets(i: Inputs) -> DataFrame:
    return i.css_assets.select("site", "css_ord", "css_url", "css")


@register("style_blocks")
def _q_style_blocks(i: Inputs) -> DataFrame:
    return C.style_blocks(i.pages_themed)


@register("css_corpus")
def _q_css_corpus(i: Inputs) -> DataFrame:
    return i.corpus


@register("content_corpus")
def _q_content_corpus(i: Inputs) -> DataFrame:
    docs = C.content_corpus(i.pages_themed, i.css_assets)
    return docs.select("site", "src_rank", "src_ord", "source_url",
                       F.length("content").cast("bigint").alias("n_chars"))


@register("first_seen")
def _q_first_seen(i: Inputs) -> DataFrame:
    """D1 on its own: the first declaration of each custom-property name per site."""
    return C.first_seen(i.decls, ["site", "name"], [*ORD, "pos"], ["value"])


# ---------------------------------------------------------------------------
# Tokens
# ---------------------------------------------------------------------------


@register("custom_properties")
def _q_custom_properties(i: Inputs) -> DataFrame:
    return T.custom_properties(i.decls)


@register("color_tokens")
def _q_color_tokens(i: Inputs) -> DataFrame:
    return T.color_tokens(i.decls)


@register("color_formats")
def _q_color_formats(i: Inputs) -> DataFrame:
    return T.color_tokens(i.decls).groupBy("site", "format").agg(F.count("*").alias("n_colors"))


@register("color_usage")
def _q_color_usage(i: Inputs) -> DataFrame:
    return T.color_tokens(i.decls).select("site", "name", "value", "usage")


def color_usage_counts(sites: DataFrame, colors: DataFrame) -> DataFrame:
    """Per site, the number of colour tokens of each usage (all seven, zeros kept)."""
    names = {"unknown": "n_other"}
    aggs = [F.count_if(F.col("usage") == u).alias(names.get(u, f"n_{u}")) for u in P.COLOR_USAGE_ORDER]
    counts = colors.groupBy("site").agg(*aggs)
    cols = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in counts.columns if c != "site"]
    return sites.join(counts, "site", "left").select("site", *cols)


@register("color_usage_counts")
def _q_color_usage_counts(i: Inputs) -> DataFrame:
    return color_usage_counts(i.sites, T.color_tokens(i.decls))


@register("font_tokens")
def _q_font_tokens(i: Inputs) -> DataFrame:
    return T.font_tokens(i.corpus)


@register("radius_tokens")
def _q_radius_tokens(i: Inputs) -> DataFrame:
    return T.radius_tokens(i.corpus)


@register("shadow_tokens")
def _q_shadow_tokens(i: Inputs) -> DataFrame:
    return T.shadow_tokens(i.corpus)


@register("heading_scale")
def _q_heading_scale(i: Inputs) -> DataFrame:
    return T.heading_scale(i.corpus)


@register("body_text")
def _q_body_text(i: Inputs) -> DataFrame:
    return T.body_text(i.corpus)


@register("font_families")
def _q_font_families(i: Inputs) -> DataFrame:
    return T.font_families(i.corpus)


@register("all_tokens")
def _q_all_tokens(i: Inputs) -> DataFrame:
    return T.all_tokens(i.corpus)


# ---------------------------------------------------------------------------
# Detection and scoring
# ---------------------------------------------------------------------------

def _docs(i: Inputs) -> DataFrame:
    return C.content_corpus(i.pages_themed, i.css_assets)


def _signals(i: Inputs) -> DataFrame:
    return S.stack_signals(S.pattern_hits(_docs(i)))


def _flat_signals(df: DataFrame) -> DataFrame:
    return df.select("site", "detector_idx", "detector", "category", "n_evidence",
                     F.round("confidence", 4).alias("confidence"), F.array_join("evidence", "; ").alias("evidence"))


@register("pattern_hits")
def _q_pattern_hits(i: Inputs) -> DataFrame:
    return S.pattern_hits(_docs(i)).select("site", "src_rank", "src_ord", "source_url", "detector_idx",
                                           "pattern_idx", "detector", "evidence")


@register("stack_signals")
def _q_stack_signals(i: Inputs) -> DataFrame:
    return _flat_signals(_signals(i))


@register("signal_sources")
def _q_signal_sources(i: Inputs) -> DataFrame:
    return S.signal_sources(S.pattern_hits(_docs(i)))


@register("ranked_stack")
def _q_ranked_stack(i: Inputs) -> DataFrame:
    ranked = S.ranked_stack(_signals(i))
    return ranked.select("site", "stack_rank", "detector", F.round("confidence", 4).alias("confidence"))


@register("primary_stack")
def _q_primary_stack(i: Inputs) -> DataFrame:
    return S.primary_stack(_signals(i)).select("site", "detector", "category",
                                               F.round("confidence", 4).alias("confidence"))


def _css(i: Inputs) -> DataFrame:
    return C.external_css(i.css_assets)


@register("component_patterns")
def _q_component_patterns(i: Inputs) -> DataFrame:
    return CP.component_classes(CP.component_matches(_css(i)))


@register("component_states")
def _q_component_states(i: Inputs) -> DataFrame:
    css = _css(i)
    samples = CP.component_samples(CP.component_matches(css))
    return CP.component_states(samples, CP.state_pieces(css))


def _a11y(i: Inputs) -> DataFrame:
    return A.site_a11y(i.sites, i.pages_themed, _css(i))


for _idx, _name in enumerate(["a11y_skip_link", "a11y_focus", "a11y_aria", "a11y_alt", "a11y_semantic"]):
    REGISTRY[_name] = (lambda idx: lambda i: A.signal(_a11y(i), idx))(_idx)


@register("a11y_report")
def _q_a11y_report(i: Inputs) -> DataFrame:
    return A.a11y_report(_a11y(i))


@register("container_widths")
def _q_container_widths(i: Inputs) -> DataFrame:
    return LY.container_widths(_css(i))


@register("breakpoints")
def _q_breakpoints(i: Inputs) -> DataFrame:
    return LY.breakpoints(_css(i))


@register("grid_system")
def _q_grid_system(i: Inputs) -> DataFrame:
    g = LY.grid_system(i.sites, _css(i))
    return g.select("site", "grid_system", F.array_join("grid_evidence", "; ").alias("grid_evidence"))


@register("layout_info")
def _q_layout_info(i: Inputs) -> DataFrame:
    li = LY.layout_info(i.sites, _css(i))
    return li.withColumn("grid_evidence", F.array_join("grid_evidence", "; "))


def _facts(i: Inputs) -> DataFrame:
    return RK.site_facts(i.sites, T.color_tokens(i.decls), _signals(i), RB.site_robots(i.sites, i.robots),
                         i.pages_themed, _css(i))


@register("risks")
def _q_risks(i: Inputs) -> DataFrame:
    return RK.risks(_facts(i))


@register("notes")
def _q_notes(i: Inputs) -> DataFrame:
    """K18 on sites whose style sheets were not fetched (external CSS left out, as with include_assets off)."""
    return RK.notes(RK.note_facts(i.sites, i.pages_themed, SP.css_assets_fetched(i.pages_themed, i.fetch_log, i.css_assets).where("fetched").select("site", "css")))


@register("robots_status")
def _q_robots_status(i: Inputs) -> DataFrame:
    return RB.robots_status(i.robots)


# ---------------------------------------------------------------------------
# URLs and links
# ---------------------------------------------------------------------------

def _resolved(i: Inputs) -> DataFrame:
    return LK.resolved_links(i.pages_themed)


_LINK_COLS = ["site", "page_ord", "url", "kind_rank", "p1", "p2"]


@register("canonical_urls")
def _q_canonical_urls(i: Inputs) -> DataFrame:
    return LK.canonical_urls(_resolved(i))


@register("pages_per_origin")
def _q_pages_per_origin(i: Inputs) -> DataFrame:
    return LK.pages_per_origin(i.pages_themed)


@register("link_origin_split")
def _q_link_origin_split(i: Inputs) -> DataFrame:
    return LK.link_origin_split(_resolved(i))


@register("css_links")
def _q_css_links(i: Inputs) -> DataFrame:
    return LK.css_links(_resolved(i)).select(*_LINK_COLS)


@register("js_links")
def _q_js_links(i: Inputs) -> DataFrame:
    return LK.js_links(_resolved(i)).select(*_LINK_COLS)


@register("internal_links")
def _q_internal_links(i: Inputs) -> DataFrame:
    return LK.internal_links(_resolved(i)).select(*_LINK_COLS)


@register("page_links")
def _q_page_links(i: Inputs) -> DataFrame:
    pl = LK.page_links(i.pages_themed)
    return pl.select("site", "page_ord",
                     *[F.size(c).cast("bigint").alias(f"n_{c}") for c in ("css_links", "js_links", "internal_links")],
                     *[F.array_join(c, " ").alias(c) for c in ("css_links", "js_links", "internal_links")])


@register("link_counts")
def _q_link_counts(i: Inputs) -> DataFrame:
    return LK.link_counts(_resolved(i))


# ---------------------------------------------------------------------------
# Requests, sources and the crawl
# ---------------------------------------------------------------------------


@register("validate_requests")
def _q_validate_requests(i: Inputs) -> DataFrame:
    v = RQ.validate_requests(i.requests)
    return v.select("request_id", "valid", F.size("errors").cast("bigint").alias("n_errors"),
                    F.array_join("errors", ", ").alias("errors"))


@register("normalize_requests")
def _q_normalize_requests(i: Inputs) -> DataFrame:
    n = RQ.normalize_requests(i.requests)
    return n.select("request_id", "theme_url", F.col("max_pages").cast("bigint").alias("max_pages"),
                    "same_origin_only", "include_assets", "mode", "notes", "seed", "site")


@register("src_pages")
def _q_src_pages(i: Inputs) -> DataFrame:
    r = SP.page_records(i.pages_themed, i.fetch_log)
    lists = ("css_links", "js_links", "internal_links")
    return r.select("site", "page_ord", "url", "final_url", F.col("status").cast("bigint").alias("status"), "error", "html_snippet",
                    *[F.size(c).cast("bigint").alias(f"n_{c}") for c in lists], *[F.array_join(c, " ").alias(c) for c in lists])


@register("src_css_assets")
def _q_src_css_assets(i: Inputs) -> DataFrame:
    s = SP.css_assets_fetched(i.pages_themed, i.fetch_log, i.css_assets)
    return s.select("site", "css_url", "page_ord", "kind_rank", "p1", "p2", "fetched",
                    F.length("css").cast("bigint").alias("css_length"))


@register("src_css_files")
def _q_src_css_files(i: Inputs) -> DataFrame:
    """S3 round trip: land ``css_assets`` as files in the checkpoint folder, read them back."""
    path = f"{ensure_checkpoint_dir(i.spark).rstrip('/')}/css-files-{uuid.uuid4().hex}"
    FL.write_css_files(i.css_assets, path)
    return FL.read_css_files(i.spark, path).select("site", "css_ord", "css")


@register("crawl_stats")
def _q_crawl_stats(i: Inputs) -> DataFrame:
    return SP.crawl_stats(i.sites, i.fetch_log, i.robots, i.css_assets)


@register("fetch_outcome")
def _q_fetch_outcome(i: Inputs) -> DataFrame:
    out = SP.fetch_outcomes(i.fetch_log)
    return out.select("site", "kind", "outcome", F.col("status").cast("bigint").alias("status"), "n")


@register("site_bfs")
def _q_site_bfs(i: Inputs) -> DataFrame:
    return CR.site_bfs(RQ.accepted_requests(i.requests), i.page_store)


# ---------------------------------------------------------------------------
# Report (whole-table, flat) and the batch run (nested documents over the budgeted crawl)
# ---------------------------------------------------------------------------

def _analysis(i: Inputs) -> SiteAnalysis:
    return SiteAnalysis(i.pages_themed, i.css_assets, i.sites, RB.site_robots(i.sites, i.robots))


@register("recommended_approach")
def _q_recommended_approach(i: Inputs) -> DataFrame:
    prim = RP.primary_stacks(_analysis(i))
    out = i.sites.join(prim, "site", "left")
    return out.select("site", "primary_stack", RP.recommended_approach(F.col("primary_stack")).alias(
        "recommended_approach"))


@register("report_meta")
def _q_report_meta(i: Inputs) -> DataFrame:
    stats = SP.crawl_stats(i.sites, i.fetch_log, i.robots, i.css_assets)
    seeds = C.site_seeds(i.pages_themed)
    return stats.join(seeds, "site").select(
        "site", F.lit(P.REPORT_VERSION).alias("version"), F.lit(BT.DEFAULT_GENERATED_AT).alias("generated_at"),
        F.col("start_url").alias("source_url"), "pages_crawled", "crawl_duration_ms", "robots_status")


@register("typography_summary")
def _q_typography_summary(i: Inputs) -> DataFrame:
    a = _analysis(i)
    w = Window.partitionBy("site").orderBy(*RP.TOKEN_ORD)
    top = a.families.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 5)  # partial group limit
    fonts = RP.ordered(top, ["site"], ["_r"], F.col("font_family"), "_f", "string")
    n_head = a.headings.groupBy("site").agg(F.count("*").cast("bigint").alias("n_headings"))
    out = i.sites.join(fonts, "site", "left").join(n_head, "site", "left").join(
        a.body.select("site", F.col("font_size").alias("body_size")), "site", "left")
    return out.select("site", F.array_join(F.coalesce("_f", F.array().cast("array<string>")), " | ")
                      .alias("primary_fonts"), F.coalesce("n_headings", F.lit(0).cast("bigint")).alias("n_headings"),
                      "body_size")


@register("component_summary")
def _q_component_summary(i: Inputs) -> DataFrame:
    a = _analysis(i)
    classes = RP.ordered(a.component_classes, ["site", "type_idx", "type"], ["class_rank"], F.col("class_pattern"),
                         "classes", "string")
    states = F.array_compact(F.array(*[F.when(F.col(f"has_{s}"), F.lit(s)) for s in P.COMPONENT_STATES]))
    out = classes.join(a.component_states, ["site", "type_idx", "type"])
    return out.select("site", F.col("type").alias("name"), "type", F.array_join("classes", ", ").alias("classes"),
                      F.array_join(states, ", ").alias("states"))


@register("a11y_layout_summary")
def _q_a11y_layout_summary(i: Inputs) -> DataFrame:
    return _analysis(i).a11y.select("site", "feature_ord", "feature", "present", "details")


@register("quick_start_tokens")
def _q_quick_start_tokens(i: Inputs) -> DataFrame:
    return RP.quick_start_tokens(_analysis(i))


@register("run_summary")
def _q_run_summary(i: Inputs) -> DataFrame:
    return RP.run_summary(_analysis(i))


def _batch(i: Inputs) -> BT.BatchResult:
    return BT.run_batch(i.requests, i.page_store, i.css_assets, i.fetch_log, i.robots)


@register("extract_site")
def _q_extract_site(i: Inputs) -> DataFrame:
    """R1 over the crawl: the nested extraction result per request, as JSON, with a few of its sizes."""
    b = _batch(i)
    sites = b.requests.select(F.col("request_id").alias("site"))
    starts = b.requests.select(F.col("request_id").alias("site"), F.col("theme_url").alias("start_url"))
    ex = RP.extraction_result(SiteAnalysis(b.pages, b.css, sites, b.robots), starts)
    e = F.col("extraction")
    return ex.select("site", F.size(e["typographyScale"]["headings"]).alias("n_headings"),
                     F.size(e["typographyScale"]["fontFamilies"]).alias("n_font_families"),
                     F.size(e["componentPatterns"]).alias("n_components"), e["layout"]["gridSystem"].alias("grid_system"),
                     F.to_json(e).alias("extraction_json"))


@register("site_report")
def _q_site_report(i: Inputs) -> DataFrame:
    r = F.col("report")
    return _batch(i).reports.select(
        "site", r["meta"]["pagesCrawled"].alias("pages_crawled"), F.size(r["stackSignals"]).alias("n_stack_signals"),
        F.size(r["tokens"]["colors"]).alias("n_colors"),
        F.size(r["tokens"]["customProperties"]).alias("n_custom_properties"),
        r["layout"]["gridSystem"].alias("grid_system"), r["recommendedApproach"].alias("recommended_approach"))


@register("report_json")
def _q_report_json(i: Inputs) -> DataFrame:
    return _batch(i).outputs.select("site", "report_json")


@register("design_doc")
def _q_design_doc(i: Inputs) -> DataFrame:
    return _batch(i).outputs.select("site", "design_doc")


@register("doc_lines")
def _q_doc_lines(i: Inputs) -> DataFrame:
    return MD.doc_lines(_batch(i).outputs.select("site", "design_doc"))


@register("run_batch")
def _q_run_batch(i: Inputs) -> DataFrame:
    b = _batch(i)
    n_css = b.css.groupBy("site").agg(F.count("*").cast("bigint").alias("n_css"))
    out = b.outputs.join(b.reports.select("site", F.col("report")["meta"]["pagesCrawled"].alias("pages_crawled")),
                         "site").join(n_css, "site", "left")
    return out.select("request_id", "mode", "pages_crawled", F.coalesce("n_css", F.lit(0).cast("bigint")).alias("n_css"),
                      F.length("report_json").cast("bigint").alias("json_chars"),
                      F.size(F.split("design_doc", "\n")).cast("bigint").alias("doc_lines"))


def _crawl(i: Inputs) -> BT.Crawl:
    return BT.crawl_requests(i.requests, i.page_store, i.css_assets, i.fetch_log, i.robots)


@register("batch_pages")
def _q_batch_pages(i: Inputs) -> DataFrame:
    """The page records of every request's crawl."""
    return _crawl(i).pages.select("site", "page_ord", "url", "final_url", F.col("status").cast("bigint").alias("status"), "error",
                                  F.length("html").cast("bigint").alias("html_chars"))


@register("batch_css")
def _q_batch_css(i: Inputs) -> DataFrame:
    """The style sheets fetched for every request, in link order."""
    return _crawl(i).css.select("site", "css_ord", "css_url", "css")


@register("batch_stats")
def _q_batch_stats(i: Inputs) -> DataFrame:
    """S4 per request: pages, total and failed requests, duration, robots status and warning."""
    return _crawl(i).stats


def _sink_roundtrip(i: Inputs, writer) -> DataFrame:
    path = f"{ensure_checkpoint_dir(i.spark).rstrip('/')}/sink-{uuid.uuid4().hex}"
    writer(_batch(i).outputs, path)
    back = SK.read_back(i.spark, path)
    return back.select("request_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("bigint").alias("n_chars"),
                       F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))


@register("sink_report_json")
def _q_sink_report_json(i: Inputs) -> DataFrame:
    return _sink_roundtrip(i, SK.write_report_json)


@register("sink_report_md")
def _q_sink_report_md(i: Inputs) -> DataFrame:
    return _sink_roundtrip(i, SK.write_design_doc)


@register("stream_color_tokens")
def _q_stream_color_tokens(i: Inputs) -> DataFrame:
    """§7.7: land the pages as files, stream them through the colour registry, read the sink back."""
    root = f"{ensure_checkpoint_dir(i.spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    i.pages_themed.select("page_id", "page_ord", "site", "url", "html").repartition(4).write.parquet(f"{root}/pages")
    ST.run_available(i.spark, f"{root}/pages", f"{root}/out", f"{root}/state")
    return i.spark.read.parquet(f"{root}/out").select("site", "value")


@register("layout_summary")
def _q_layout_summary(i: Inputs) -> DataFrame:
    """R6, layout half: the layout values without source info, as (site, kind, sheet_ord, item_ord, value).

    Container widths in order (not de-duplicated), breakpoints first seen, the
    grid system, and its evidence list.  Item order is the order key, not a rank.
    """
    a = _analysis(i)
    cw = a.container_widths.select("site", F.lit("container_width").alias("kind"),
                                   F.col("css_ord").cast("bigint").alias("sheet_ord"), F.col("pos").cast("bigint").alias("item_ord"), "value")
    bp = a.breakpoints.select("site", F.lit("breakpoint").alias("kind"),
                              F.col("css_ord").cast("bigint").alias("sheet_ord"), F.col("pos").cast("bigint").alias("item_ord"), "value")
    grid = a.grid.select("site", F.lit("grid_system").alias("kind"), F.lit(0).cast("bigint").alias("sheet_ord"), F.lit(0).cast("bigint").alias("item_ord"),
                         F.col("grid_system").alias("value"))
    ev = a.grid.select("site", F.lit("grid_evidence").alias("kind"), F.lit(0).cast("bigint").alias("sheet_ord"),
                       F.posexplode("grid_evidence").alias("item_ord", "value")).select(
        "site", "kind", "sheet_ord", F.col("item_ord").cast("bigint"), "value")
    return cw.unionByName(bp).unionByName(grid).unionByName(ev)
