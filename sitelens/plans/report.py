"""Report assembly.

Every piece is a per-site aggregate joined on ``site``, starting from the
site list (``left``), so an empty site still gets a full report.  Lists are
rebuilt in the reference's order from the order keys the operators keep:
``collect_list`` of (order key, value) then ``array_sort``.

The nested report is a per-site *document*: it is built over a budgeted
crawl (at most 20 pages per request, plus the style sheets they link), which
bounds every list in it.  Whole-table analyses use the flat long tables of
the operators instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.operators.corpus import ORD
from sitelens.plans.analysis import SiteAnalysis

TOKEN_ORD = [*ORD, "pos"]


def ordered(df: DataFrame | None, keys: Sequence[str], order: Sequence[str], value: Column, name: str,
            element: str) -> DataFrame | None:
    """Per key, the list of ``value`` in ``order`` (collect then sort on the order key)."""
    if df is None:
        return None
    items = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], value.alias("_v"))))
    return df.groupBy(*keys).agg(F.transform(items, lambda s: s["_v"]).cast(f"array<{element}>").alias(name))


def _source(source_type: str, url: Column, snippet: Column, conf: Column) -> Column:
    return F.struct(F.lit(source_type).alias("sourceType"), url.alias("sourceUrl"),
                    snippet.alias("sampleSnippet"), conf.cast("double").alias("confidence"))


SOURCE_T = "struct<sourceType:string,sourceUrl:string,sampleSnippet:string,confidence:double>"
COLOR_T = f"struct<name:string,value:string,format:string,usage:string,source:{SOURCE_T}>"
TYPO_T = f"struct<name:string,fontFamily:string,source:{SOURCE_T}>"
NV_T = f"struct<name:string,value:string,source:{SOURCE_T}>"
EXTRACTED_T = "struct<value:string,sourceType:string,sourceUrl:string,sampleSnippet:string,confidence:double>"
SIGNAL_T = "struct<name:string,category:string,confidence:double,evidence:array<string>,sourceUrls:array<string>>"
SPACING_T = f"struct<name:string,value:string,unit:string,source:{SOURCE_T}>"
HEAD_T = "struct<tag:string,size:string>"
COMP_T = "struct<name:string,type:string,classes:array<string>,states:array<string>>"
A11Y_T = "struct<feature:string,present:boolean,details:string>"


def _extracted(value: Column, url: Column, snippet: Column, conf: Column) -> Column:
    return F.struct(value.alias("value"), F.lit("css").alias("sourceType"), url.alias("sourceUrl"),
                    snippet.alias("sampleSnippet"), conf.cast("double").alias("confidence"))


ORD_WIDTH = 5  # common order-key width of all report lists (padded with zeros)


def _lists(specs: list[tuple[DataFrame | None, str, Sequence[str], Column, str]]) -> DataFrame | None:
    """Several ordered per-site lists in one aggregate.

    specs: (frame, list name, order columns, value, element type).  The frames
    become one union of (site, list id, order key, value-in-its-own-column)
    rows, grouped once by site with one guarded ``collect_list`` per list —
    one shuffle and no joins instead of one aggregate and one join per list.
    """
    specs = [sp for sp in specs if sp[0] is not None]
    if not specs:
        return None
    parts = []
    for k, (df, _name, order, value, element) in enumerate(specs):
        pad = [F.lit(0).cast("bigint")] * (ORD_WIDTH - len(order))
        okey = F.struct(*[F.col(c).cast("bigint").alias(f"o{i}") for i, c in enumerate(order)],
                        *[p.alias(f"o{len(order) + i}") for i, p in enumerate(pad)])
        vals = [value.cast(element).alias(f"_v{j}") if j == k else F.lit(None).cast(sp[4]).alias(f"_v{j}")
                for j, sp in enumerate(specs)]
        parts.append(df.select("site", F.lit(k).alias("_k"), okey.alias("_o"), *vals))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    aggs = []
    for k, (_df, name, _order, _value, element) in enumerate(specs):
        items = F.array_sort(F.collect_list(F.when(F.col("_k") == k, F.struct(F.col("_o"), F.col(f"_v{k}").alias("_v")))))
        aggs.append(F.transform(items, lambda x: x["_v"]).cast(f"array<{element}>").alias(name))
    return union.groupBy("site").agg(*aggs)


def report_pieces(a: SiteAnalysis) -> list[DataFrame]:
    """The per-site list columns of the report, as (site, columns…) frames."""
    src = F.col("source_url")
    sig_sources = ordered(a.signal_sources, ["site", "detector_idx"], ["pattern_idx", "src_rank", "src_ord"],
                          F.col("source_url"), "sourceUrls", "string")
    signals = a.signals.join(sig_sources, ["site", "detector_idx"], "left")
    source = lambda: _source("css", src, F.col("snippet"), F.col("confidence"))
    specs = [
        (signals, "stackSignals", ["stack_rank"], F.struct(
            F.col("detector").alias("name"), "category", "confidence", "evidence",
            F.coalesce("sourceUrls", F.array().cast("array<string>")).alias("sourceUrls")), SIGNAL_T),
        (a.colors, "colors", TOKEN_ORD, F.struct("name", "value", "format", "usage", source().alias("source")),
         COLOR_T),
        (a.fonts, "typography", TOKEN_ORD, F.struct(F.lit("font-family").alias("name"),
                                                     F.col("font_family").alias("fontFamily"),
                                                     source().alias("source")), TYPO_T),
        (a.radii, "radii", [*ORD, "kind_rank", "pos"], F.struct("name", "value", source().alias("source")), NV_T),
        (a.shadows, "shadows", [*ORD, "kind_rank", "pos"], F.struct("name", "value", source().alias("source")),
         NV_T),
        (a.properties, "customProperties", TOKEN_ORD,
         _extracted(F.col("property"), src, F.col("snippet"), F.col("confidence")), EXTRACTED_T),
        (a.families, "_families", TOKEN_ORD, F.col("font_family"), "string"),
        (a.headings, "headingScale", TOKEN_ORD, F.struct("tag", F.col("font_size").alias("size")), HEAD_T),
        (a.a11y, "accessibilitySignals", ["feature_ord"], F.struct("feature", "present", "details"), A11Y_T),
        (a.container_widths, "containerWidths", ["css_ord", "pos"], F.col("value"), "string"),
        (a.breakpoints, "breakpoints", ["css_ord", "pos"], F.col("value"), "string"),
    ]
    if a.component_classes is not None:
        classes = ordered(a.component_classes, ["site", "type_idx", "type"], ["class_rank"], F.col("class_pattern"),
                          "classes", "string")
        states = F.array_compact(F.array(*[F.when(F.col(f"has_{s}"), F.lit(s)) for s in P.COMPONENT_STATES]))
        comps = classes.join(a.component_states, ["site", "type_idx", "type"])
        specs.append((comps, "componentPatterns", ["type_idx"], F.struct(
            F.col("type").alias("name"), "type", "classes", states.alias("states")), COMP_T))
    lists = _lists(specs)
    lists = lists.withColumn("primaryFonts", F.slice("_families", 1, 5)).drop("_families")
    body = a.body.select("site", F.col("font_size").alias("bodySize"))
    return [lists, body]


def recommended_approach(primary: Column) -> Column:
    """R2: the integration text for the primary stack."""
    expr = F.lit(P.RECOMMEND_DEFAULT)
    for name, text in reversed(P.RECOMMENDATIONS):
        expr = F.when(primary == name, F.lit(text)).otherwise(expr)
    return expr


def primary_stacks(a: SiteAnalysis) -> DataFrame:
    return a.signals.where(F.col("stack_rank") == 1).select(
        "site", F.col("detector").alias("primary_stack"), F.col("confidence").alias("primary_confidence"))


def site_report(a: SiteAnalysis, meta: DataFrame, generated_at: str) -> DataFrame:
    """One nested row per site, fields as in the reference's report.

    ``meta``: site, source_url, pages_crawled, crawl_duration_ms, robots_status, notes_text (config notes).
    """
    out = meta
    for piece in report_pieces(a):
        out = out.join(piece, "site", "left")
    out = (out.join(primary_stacks(a), "site", "left").join(a.grid, "site", "left")
           .join(a.risks, "site", "left").join(a.notes, "site", "left"))
    empty = lambda t: F.array().cast(f"array<{t}>")
    arr = lambda c, t: F.coalesce(F.col(c), empty(t))
    cols = set(out.columns)
    opt = lambda c, t: arr(c, t) if c in cols else empty(t)
    meta_s = F.struct(F.lit(P.REPORT_VERSION).alias("version"), F.lit(generated_at).alias("generatedAt"),
                      F.col("source_url").alias("sourceUrl"), F.col("pages_crawled").alias("pagesCrawled"),
                      F.col("crawl_duration_ms").alias("crawlDuration"),
                      F.col("robots_status").alias("robotsTxtStatus"))
    tokens = F.struct(arr("colors", COLOR_T).alias("colors"), arr("typography", TYPO_T).alias("typography"),
                      empty(SPACING_T).alias("spacing"), arr("radii", NV_T).alias("radii"),
                      arr("shadows", NV_T).alias("shadows"), arr("customProperties", EXTRACTED_T).alias("customProperties"))
    typo = F.struct(arr("primaryFonts", "string").alias("primaryFonts"),
                    arr("headingScale", HEAD_T).alias("headingScale"), F.col("bodySize").alias("bodySize"))
    layout = F.struct(opt("containerWidths", "string").alias("containerWidths"),
                      opt("breakpoints", "string").alias("breakpoints"),
                      F.coalesce("grid_system", F.lit("unknown")).alias("gridSystem"))
    report = F.struct(
        meta_s.alias("meta"), arr("stackSignals", SIGNAL_T).alias("stackSignals"), tokens.alias("tokens"),
        typo.alias("typographySummary"), opt("componentPatterns", COMP_T).alias("componentPatterns"),
        arr("accessibilitySignals", A11Y_T).alias("accessibilitySignals"), layout.alias("layout"),
        arr("risks", "string").alias("risks"), arr("notes", "string").alias("notes"),
        recommended_approach(F.col("primary_stack")).alias("recommendedApproach"))
    return out.select("site", report.alias("report"), F.col("notes_text"), F.col("primary_stack"),
                      F.col("primary_confidence"))


def report_json(report: DataFrame, pretty: bool = False) -> DataFrame:
    """The report as JSON text (absent optional fields omitted)."""
    opts = {"pretty": "true"} if pretty else {}
    return report.select("site", F.to_json("report", opts).alias("report_json"))


def site_facts_table(a: SiteAnalysis) -> DataFrame:
    """Facts of every site as one tall table: site, kind, name, value.

    A row per item that a phase found (kind ``signal``, a token kind, ``component``, ``a11y``), one for the number of
    risks (``risks``, value), and one for the site itself (``site``), so a site without findings is there too.  The
    first signal carries its detector and confidence.
    """
    none, nothing = F.lit(None).cast("string"), F.lit(None).cast("double")
    item = lambda df, kind, name=none, value=nothing: df.select("site", kind.alias("kind"), name.alias("name"), value.cast("double").alias("value"))
    top = F.col("stack_rank") == 1
    pieces = [item(a.sites, F.lit("site")), item(a.tokens, F.col("kind")), item(a.a11y, F.lit("a11y")),
              item(a.signals, F.lit("signal"), F.when(top, F.col("detector")), F.when(top, F.col("confidence"))),
              item(a.risks, F.lit("risks"), value=F.size("risks"))]
    if a.component_classes is not None:
        pieces.append(item(a.component_classes.select("site", "type_idx").distinct(), F.lit("component")))
    out = pieces[0]
    for piece in pieces[1:]:
        out = out.unionByName(piece)
    return out


def run_summary(a: SiteAnalysis) -> DataFrame:
    """Counts per phase per site, the primary stack and its confidence in percent — one pivoting aggregate over the facts."""
    kind = F.col("kind")
    n = lambda k: F.count_if(kind == k).cast("bigint")
    counts = {"n_signals": n("signal"), "n_colors": n("color"), "n_typography": n("font"), "n_radii": n("radius"), "n_shadows": n("shadow"),
              "n_components": n("component"), "n_a11y": n("a11y"),
              "n_risks": F.coalesce(F.max(F.when(kind == "risks", F.col("value"))), F.lit(0)).cast("bigint")}
    out = site_facts_table(a).groupBy("site").agg(*[c.alias(name) for name, c in counts.items()], F.max("name").alias("primary_stack"),
                                                  F.max(F.when(kind == "signal", F.col("value"))).alias("_confidence"), n("site").alias("_sites"))
    total = F.col("n_colors") + F.col("n_typography") + F.col("n_radii") + F.col("n_shadows")
    return out.where("_sites > 0").select("site", *counts, total.alias("total_tokens"), "primary_stack",
                                          F.round(F.col("_confidence") * 100, 0).cast("bigint").alias("primary_confidence_pct"))


def tailwind_key(name: Column) -> Column:
    """R12 helper: ``--x.y`` → ``x-y`` (leading ``--`` dropped, other non-alphanumerics to ``-``)."""
    return F.regexp_replace(F.regexp_replace(name, "^--", ""), "[^a-zA-Z0-9]", "-")


def quick_start_tokens(a: SiteAnalysis) -> DataFrame:
    """The tokens the quick-start code shows — first 10 colours, 5 radii, 3 shadows, the fonts' first family.

    Long table: site, kind, item_ord, name, key, value.
    """
    from pyspark.sql import Window

    def first(df: DataFrame, kind: str, n: int, order: Sequence[str], name: Column, value: Column) -> DataFrame:
        w = Window.partitionBy("site").orderBy(*order)
        ranked = df.withColumn("item_ord", F.row_number().over(w).cast("bigint")).where(F.col("item_ord") <= n)
        return ranked.select("site", F.lit(kind).alias("kind"), "item_ord", name.alias("name"),
                             tailwind_key(name).alias("key"), value.alias("value"))

    fonts = first(a.families, "font", 5, TOKEN_ORD, F.col("font_family"),
                  F.regexp_replace(F.split("font_family", ",")[0], r"^\s+|\s+$", ""))
    return (first(a.colors, "color", 10, TOKEN_ORD, F.col("name"), F.col("value"))
            .unionByName(first(a.radii, "radius", 5, [*ORD, "kind_rank", "pos"], F.col("name"), F.col("value")))
            .unionByName(first(a.shadows, "shadow", 3, [*ORD, "kind_rank", "pos"], F.col("name"), F.col("value")))
            .unionByName(fonts.withColumn("key", F.lit(None).cast("string"))))


HEADING_FULL_T = ("struct<tag:string,fontSize:string,fontWeight:string,lineHeight:string,fontFamily:string,"
                  f"source:{SOURCE_T}>")
BODY_T = f"struct<fontSize:string,lineHeight:string,fontFamily:string,source:{SOURCE_T}>"
COMP_FULL_T = ("struct<name:string,type:string,classPatterns:array<string>,hasHoverState:boolean,"
               f"hasFocusState:boolean,hasActiveState:boolean,source:{SOURCE_T}>")
A11Y_FULL_T = f"struct<feature:string,present:boolean,details:string,source:{SOURCE_T}>"


def extraction_result(a: SiteAnalysis, start_urls: DataFrame) -> DataFrame:
    """Everything the extractors produce for a site, nested (the original's extraction result).

    ``start_urls``: site, start_url — the source URL of the site-level rules
    (type scale, components, accessibility, layout).  Lists are built in one
    aggregate; the start URL is filled in afterwards with one join on site.
    """
    src = F.col("source_url")
    none = F.lit(None).cast("string")
    css_src = lambda url, snip, conf: _source("css", url, snip, conf)
    extracted_start = lambda v, snip, conf: F.struct(
        v.alias("value"), F.lit("css").alias("sourceType"), none.alias("sourceUrl"), snip.alias("sampleSnippet"),
        F.lit(conf).cast("double").alias("confidence"))
    sig_sources = ordered(a.signal_sources, ["site", "detector_idx"], ["pattern_idx", "src_rank", "src_ord"],
                          F.col("source_url"), "sourceUrls", "string")
    signals = a.signals.join(sig_sources, ["site", "detector_idx"], "left")
    specs = [
        (signals, "stackSignals", ["stack_rank"], F.struct(
            F.col("detector").alias("name"), "category", "confidence", "evidence",
            F.coalesce("sourceUrls", F.array().cast("array<string>")).alias("sourceUrls")), SIGNAL_T),
        (a.colors, "colors", TOKEN_ORD, F.struct("name", "value", "format", "usage",
                                                  css_src(src, F.col("snippet"), F.col("confidence")).alias("source")),
         COLOR_T),
        (a.fonts, "typography", TOKEN_ORD, F.struct(F.lit("font-family").alias("name"),
                                                     F.col("font_family").alias("fontFamily"),
                                                     css_src(src, F.col("snippet"), F.col("confidence")).alias("source")),
         TYPO_T),
        (a.radii, "radii", [*ORD, "kind_rank", "pos"],
         F.struct("name", "value", css_src(src, F.col("snippet"), F.col("confidence")).alias("source")), NV_T),
        (a.shadows, "shadows", [*ORD, "kind_rank", "pos"],
         F.struct("name", "value", css_src(src, F.col("snippet"), F.col("confidence")).alias("source")), NV_T),
        (a.properties, "customProperties", TOKEN_ORD,
         _extracted(F.col("property"), src, F.col("snippet"), F.col("confidence")), EXTRACTED_T),
        (a.headings, "headings", TOKEN_ORD, F.struct(
            "tag", F.col("font_size").alias("fontSize"), F.col("font_weight").alias("fontWeight"),
            F.col("line_height").alias("lineHeight"), F.col("font_family").alias("fontFamily"),
            css_src(none, F.col("snippet"), F.col("confidence")).alias("source")), HEADING_FULL_T),
        (a.families, "fontFamilies", TOKEN_ORD,
         extracted_start(F.col("font_family"), F.col("snippet"), P.CONF_FONT_FAMILY_SCALE), EXTRACTED_T),
        (a.a11y, "accessibilitySignals", ["feature_ord"], F.struct(
            "feature", "present", "details", _source("x", none, F.col("snippet"), F.col("confidence"))
            .withField("sourceType", F.col("source_type")).alias("source")), A11Y_FULL_T),
        (a.container_widths, "containerWidths", ["css_ord", "pos"],
         extracted_start(F.col("value"), F.col("snippet"), P.CONF_CONTAINER), EXTRACTED_T),
        (a.breakpoints, "breakpoints", ["css_ord", "pos"],
         extracted_start(F.col("value"), F.col("snippet"), P.CONF_BREAKPOINT), EXTRACTED_T),
    ]
    if a.component_classes is not None:
        classes = ordered(a.component_classes, ["site", "type_idx", "type"], ["class_rank"], F.col("class_pattern"),
                          "classPatterns", "string")
        comps = classes.join(a.component_states, ["site", "type_idx", "type"])
        specs.append((comps, "componentPatterns", ["type_idx"], F.struct(
            F.col("type").alias("name"), "type", "classPatterns", F.col("has_hover").alias("hasHoverState"),
            F.col("has_focus").alias("hasFocusState"), F.col("has_active").alias("hasActiveState"),
            css_src(none, F.col("sample_snippet"), F.lit(P.CONF_COMPONENT)).alias("source")), COMP_FULL_T))
    lists = _lists(specs)
    body = a.body.select("site", F.struct(
        F.col("font_size").alias("fontSize"), F.col("line_height").alias("lineHeight"),
        F.col("font_family").alias("fontFamily"), css_src(none, F.col("snippet"), F.col("confidence")).alias("source"))
        .cast(BODY_T).alias("bodyText"))
    out = (a.sites.join(start_urls, "site", "left").join(lists, "site", "left").join(body, "site", "left")
           .join(a.grid, "site", "left").join(a.risks, "site", "left").join(a.notes, "site", "left"))
    start = F.col("start_url")
    with_start = lambda c: F.transform(c, lambda x: x.withField("source.sourceUrl", start))
    with_start_flat = lambda c: F.transform(c, lambda x: x.withField("sourceUrl", start))
    cols = set(out.columns)
    empty = lambda t: F.array().cast(f"array<{t}>")
    arr = lambda c, t: F.coalesce(F.col(c), empty(t)) if c in cols else empty(t)
    result = F.struct(
        arr("stackSignals", SIGNAL_T).alias("stackSignals"),
        F.struct(arr("colors", COLOR_T).alias("colors"), arr("typography", TYPO_T).alias("typography"),
                 empty(SPACING_T).alias("spacing"), arr("radii", NV_T).alias("radii"),
                 arr("shadows", NV_T).alias("shadows"),
                 arr("customProperties", EXTRACTED_T).alias("customProperties")).alias("tokens"),
        F.struct(with_start(arr("headings", HEADING_FULL_T)).alias("headings"),
                 F.when(F.col("bodyText").isNotNull(), F.col("bodyText").withField("source.sourceUrl", start))
                 .alias("bodyText"),
                 with_start_flat(arr("fontFamilies", EXTRACTED_T)).alias("fontFamilies")).alias("typographyScale"),
        with_start(arr("componentPatterns", COMP_FULL_T)).alias("componentPatterns"),
        with_start(arr("accessibilitySignals", A11Y_FULL_T)).alias("accessibilitySignals"),
        F.struct(with_start_flat(arr("containerWidths", EXTRACTED_T)).alias("containerWidths"),
                 with_start_flat(arr("breakpoints", EXTRACTED_T)).alias("breakpoints"),
                 F.coalesce("grid_system", F.lit("unknown")).alias("gridSystem"),
                 F.coalesce("grid_evidence", empty("string")).alias("gridEvidence")).alias("layout"),
        F.coalesce("risks", empty("string")).alias("risks"), F.coalesce("notes", empty("string")).alias("notes"))
    return out.select("site", result.alias("extraction"))
