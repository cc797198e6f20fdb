"""Oracle SQL (DuckDB dialect) for the registered queries.

Each query is an independent ANSI-ish SQL text over the given ``pages``
table: the derived fixture tables and shared intermediate steps are named
CTEs, assembled on demand in dependency order.  Patterns come from
``functions.patterns`` in their RE2 form.
"""

from __future__ import annotations

from sitelens.functions import patterns as P
from sitelens.functions.patterns import re2_rx, sql_lit
from sitelens.sources.fixtures import oracle_ctes


def L(rx: str) -> str:  # noqa: N802 - short helper for SQL regex literals
    return sql_lit(re2_rx(rx))


def jtrim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def first_group(text: str, rx: str) -> str:
    return f"CASE WHEN regexp_matches({text}, {L(rx)}) THEN {jtrim(f'regexp_extract({text}, {L(rx)}, 1)')} END"


def explode_matches(src: str, text: str, rx: str, keep: str) -> str:
    """Rows (keep…, pos, m) for every match of rx in text (pos from 0)."""
    return (f"SELECT {keep}, cast(generate_subscripts(ms, 1) - 1 AS bigint) AS pos, unnest(ms) AS m "
            f"FROM (SELECT {keep}, regexp_extract_all({text}, {L(rx)}, 0) AS ms FROM {src})")


ORD = "src_rank, src_ord, block_ord"

_CTES: dict[str, tuple[str, list[str]]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    _CTES[name] = (sql.strip(), deps)


for _n, _sql in oracle_ctes().items():
    cte(_n, ["css_assets", "pages_themed"] if _n == "fetch_log" else ([] if _n == "pages_themed" else ["pages_themed"]),
        _sql)

cte("blocks", ["pages_themed"], f"""
SELECT site, page_ord, source_url, block_ord, regexp_replace(css0, {L(P.STYLE_TAG)}, '', 'g') AS css FROM (
  SELECT site, page_ord, url AS source_url, cast(generate_subscripts(b, 1) - 1 AS bigint) AS block_ord,
         unnest(b) AS css0
  FROM (SELECT site, page_ord, url, regexp_extract_all(html, {L(P.STYLE_BLOCK)}, 0) AS b FROM pages_themed))
""")

cte("corpus", ["blocks", "css_assets"], """
SELECT site, cast(0 AS bigint) AS src_rank, page_ord AS src_ord, block_ord, source_url, css FROM blocks
UNION ALL
SELECT site, cast(1 AS bigint), cast(css_ord AS bigint), cast(0 AS bigint), css_url, css FROM css_assets
""")

cte("decl_m", ["corpus"], explode_matches("corpus", "css", P.CUSTOM_PROPERTY, f"site, {ORD}, source_url"))

cte("decls", ["decl_m"], f"""
SELECT site, {ORD}, pos, source_url, regexp_extract(m, {L(P.CUSTOM_PROPERTY)}, 1) AS name,
       {jtrim(f"regexp_extract(m, {L(P.CUSTOM_PROPERTY)}, 2)")} AS value, m
FROM decl_m
""")

cte("custom_properties", ["decls"], f"""
SELECT site, property, {ORD}, pos, source_url, snippet, cast({P.CONF_CUSTOM_PROPERTY} AS double) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY site, property ORDER BY {ORD}, pos) AS rn FROM (
    SELECT site, {ORD}, pos, source_url, concat('--', name, ': ', value) AS property, substring(m, 1, 100) AS snippet
    FROM decls)) WHERE rn = 1
""")


def _usage_sql(name: str) -> str:
    whens = " ".join(f"WHEN regexp_matches(lower({name}), {sql_lit('(?i)' + rx)}) THEN '{u}'" for u, rx in P.COLOR_USAGE)
    return f"CASE {whens} ELSE 'unknown' END"


def _format_sql(v: str) -> str:
    return (f"CASE WHEN starts_with({v}, '#') THEN 'hex' WHEN starts_with({v}, 'rgba') THEN 'rgba' "
            f"WHEN starts_with({v}, 'rgb') THEN 'rgb' WHEN starts_with({v}, 'hsla') THEN 'hsla' "
            f"WHEN starts_with({v}, 'hsl') THEN 'hsl' ELSE 'named' END")


cte("color_tokens", ["decls"], f"""
SELECT site, value, name, {_format_sql('value')} AS format, usage, source_url, snippet,
       cast({P.CONF_COLOR} AS double) AS confidence, {ORD}, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY site, value ORDER BY {ORD}, pos) AS rn FROM (
    SELECT site, {ORD}, pos, source_url, regexp_extract(value, {L(P.COLOR)}, 0) AS value,
           concat('--', name) AS name, {_usage_sql('name')} AS usage, substring(m, 1, 80) AS snippet
    FROM decls WHERE regexp_extract(value, {L(P.COLOR)}, 0) <> '')) WHERE rn = 1
""")

cte("sites", ["pages_themed"], "SELECT DISTINCT site FROM pages_themed")

_QUERIES: dict[str, tuple[list[str], str]] = {}


def query(name: str, deps: list[str], sql: str) -> None:
    _QUERIES[name] = (deps, sql.strip())


def _resolve(deps: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in _CTES[n][1]:
            visit(d)
        order.append(n)

    for d in deps:
        visit(d)
    return order


def build(name: str) -> str:
    deps, body = _QUERIES[name]
    names = _resolve(deps)
    if not names:
        return body
    withs = ",\n".join(f"{n} AS (\n{_CTES[n][0]}\n)" for n in names)
    return f"WITH {withs}\n{body}"


def oracle_sql() -> dict[str, str]:
    return {name: build(name) for name in _QUERIES}


# ---------------------------------------------------------------------------
# Sources and fixtures
# ---------------------------------------------------------------------------
query("fixture_pages_themed", ["pages_themed"],
      "SELECT page_id, page_ord, site, url, html FROM pages_themed")
query("fixture_css_assets", ["css_assets"],
      "SELECT site, css_ord, css_url, css FROM css_assets")

# ---------------------------------------------------------------------------
# Corpus
# ---------------------------------------------------------------------------
query("style_blocks", ["blocks"], "SELECT site, page_ord, source_url, block_ord, css FROM blocks")
query("css_corpus", ["corpus"], f"SELECT site, {ORD}, source_url, css FROM corpus")
query("content_corpus", ["pages_themed", "css_assets"], """
SELECT site, cast(0 AS bigint) AS src_rank, page_ord AS src_ord, url AS source_url, length(html) AS n_chars
FROM pages_themed
UNION ALL
SELECT site, cast(1 AS bigint), cast(css_ord AS bigint), css_url, length(css) FROM css_assets
""")
query("first_seen", ["decls"], f"""
SELECT site, name, {ORD}, pos, value FROM (
  SELECT *, row_number() OVER (PARTITION BY site, name ORDER BY {ORD}, pos) AS rn FROM decls) WHERE rn = 1
""")

# ---------------------------------------------------------------------------
# Tokens
# ---------------------------------------------------------------------------
query("custom_properties", ["custom_properties"], "SELECT * FROM custom_properties")
query("color_tokens", ["color_tokens"], "SELECT * FROM color_tokens")
query("color_formats", ["color_tokens"],
      "SELECT site, format, count(*) AS n_colors FROM color_tokens GROUP BY site, format")
query("color_usage", ["color_tokens"], "SELECT site, name, value, usage FROM color_tokens")
query("color_usage_counts", ["sites", "color_tokens"], """
SELECT s.site,
  count(c.value) FILTER (WHERE c.usage = 'background') AS n_background,
  count(c.value) FILTER (WHERE c.usage = 'foreground') AS n_foreground,
  count(c.value) FILTER (WHERE c.usage = 'primary') AS n_primary,
  count(c.value) FILTER (WHERE c.usage = 'secondary') AS n_secondary,
  count(c.value) FILTER (WHERE c.usage = 'accent') AS n_accent,
  count(c.value) FILTER (WHERE c.usage = 'border') AS n_border,
  count(c.value) FILTER (WHERE c.usage = 'unknown') AS n_other
FROM sites s LEFT JOIN color_tokens c ON s.site = c.site GROUP BY s.site
""")

# ---------------------------------------------------------------------------
# More tokens
# ---------------------------------------------------------------------------


def _font_sql(conf: float) -> str:
    return f"""
SELECT site, font_family, {ORD}, pos, source_url, snippet, cast({conf} AS double) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY site, font_family ORDER BY {ORD}, pos) AS rn FROM (
    SELECT site, {ORD}, pos, source_url, {jtrim(f"regexp_extract(m, {L(P.FONT_FAMILY)}, 1)")} AS font_family,
           substring(m, 1, 80) AS snippet
    FROM ({explode_matches("corpus", "css", P.FONT_FAMILY, f"site, {ORD}, source_url")}))) WHERE rn = 1"""


cte("font_tokens", ["corpus"], _font_sql(P.CONF_FONT))
cte("font_families", ["corpus"], _font_sql(P.CONF_FONT_FAMILY_SCALE))


def _prop_or_direct_sql(name_rx: str, direct_rx: str, direct_name: str, skip_none: bool) -> str:
    none = " AND value <> 'none'" if skip_none else ""
    return f"""
SELECT site, value, {ORD}, kind_rank, pos, source_url, name, snippet, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY site, value ORDER BY {ORD}, kind_rank, pos) AS rn FROM (
    SELECT site, {ORD}, cast(0 AS bigint) AS kind_rank, pos, source_url, name, value, snippet,
           cast({P.CONF_FROM_PROPERTY} AS double) AS confidence FROM (
      SELECT site, {ORD}, pos, source_url, concat('--', name) AS name, value, substring(m, 1, 80) AS snippet,
             row_number() OVER (PARTITION BY site, {ORD}, name ORDER BY pos) AS rn
      FROM decls WHERE regexp_matches(name, {sql_lit('(?i)' + name_rx)})) a WHERE rn = 1
    UNION ALL
    SELECT site, {ORD}, cast(1 AS bigint), pos, source_url, '{direct_name}', value, snippet,
           cast({P.CONF_DIRECT} AS double) FROM (
      SELECT *, row_number() OVER (PARTITION BY site, {ORD}, value ORDER BY pos) AS rn FROM (
        SELECT site, {ORD}, pos, source_url, {jtrim(f"regexp_extract(m, {L(direct_rx)}, 1)")} AS value,
               substring(m, 1, 80) AS snippet
        FROM ({explode_matches("corpus", "css", direct_rx, f"site, {ORD}, source_url")}))
      WHERE NOT starts_with(value, 'var('){none}) b
    WHERE rn = 1 AND NOT EXISTS (
      SELECT 1 FROM decls d WHERE d.site = b.site AND d.src_rank = b.src_rank AND d.src_ord = b.src_ord
        AND d.block_ord = b.block_ord AND regexp_matches(d.name, {sql_lit('(?i)' + name_rx)})
        AND concat('--', d.name) = b.value))) WHERE rn = 1"""


cte("radius_tokens", ["decls", "corpus"], _prop_or_direct_sql("radius", P.BORDER_RADIUS, "border-radius", False))
cte("shadow_tokens", ["decls", "corpus"], _prop_or_direct_sql("shadow", P.BOX_SHADOW, "box-shadow", True))


def _rule_props(styles: str, props: list[tuple[str, str]]) -> str:
    return ", ".join(f"{first_group(styles, rx)} AS {name}" for name, rx in props)


_HEAD_STYLES = f"regexp_extract(m, {L(P.HEADING_RULE)}, 2)"
_BODY_STYLES = f"regexp_extract(m, {L(P.BODY_RULE)}, 1)"

query("font_tokens", ["font_tokens"], "SELECT * FROM font_tokens")
query("font_families", ["font_families"], "SELECT * FROM font_families")
query("radius_tokens", ["radius_tokens"], "SELECT * FROM radius_tokens")
query("shadow_tokens", ["shadow_tokens"], "SELECT * FROM shadow_tokens")
query("heading_scale", ["corpus"], f"""
SELECT site, {ORD}, pos, lower(regexp_extract(m, {L(P.HEADING_RULE)}, 1)) AS tag,
  {_rule_props(_HEAD_STYLES, [("font_size", P.RULE_FONT_SIZE), ("font_weight", P.RULE_FONT_WEIGHT),
                              ("line_height", P.RULE_LINE_HEIGHT), ("font_family", P.RULE_FONT_FAMILY)])},
  substring(m, 1, 100) AS snippet, cast({P.CONF_RULE} AS double) AS confidence
FROM ({explode_matches("corpus", "css", P.HEADING_RULE, f"site, {ORD}")})
""")
query("body_text", ["corpus"], f"""
SELECT site, {ORD}, pos, font_size, line_height, font_family, snippet, cast({P.CONF_RULE} AS double) AS confidence
FROM (
  SELECT site, {ORD}, pos,
    {_rule_props(_BODY_STYLES, [("font_size", P.RULE_FONT_SIZE), ("line_height", P.RULE_LINE_HEIGHT),
                                ("font_family", P.RULE_FONT_FAMILY)])},
    substring(m, 1, 100) AS snippet,
    row_number() OVER (PARTITION BY site ORDER BY src_rank DESC, src_ord DESC, block_ord DESC, pos DESC) AS rn
  FROM ({explode_matches("corpus", "css", P.BODY_RULE, f"site, {ORD}")})) WHERE rn = 1
""")
query("all_tokens", ["custom_properties", "color_tokens", "font_tokens", "radius_tokens", "shadow_tokens"], f"""
SELECT site, 'custom_property' AS kind, regexp_extract(property, '^(--[^:]*):', 1) AS name, property AS value,
       source_url, {ORD}, pos FROM custom_properties
UNION ALL SELECT site, 'color', name, value, source_url, {ORD}, pos FROM color_tokens
UNION ALL SELECT site, 'font', 'font-family', font_family, source_url, {ORD}, pos FROM font_tokens
UNION ALL SELECT site, 'radius', name, value, source_url, {ORD}, pos FROM radius_tokens
UNION ALL SELECT site, 'shadow', name, value, source_url, {ORD}, pos FROM shadow_tokens
""")

# ---------------------------------------------------------------------------
# Detection (K1-K4)
# ---------------------------------------------------------------------------
_PATTERN_ROWS = ",\n  ".join(
    f"({d}, {p}, {sql_lit(name)}, {sql_lit(cat)}, {w}, {sql_lit(ev)}, {sql_lit(re2_rx(rx, True))})"
    for d, p, name, cat, w, ev, rx in P.stack_patterns())
cte("stack_dim", [], f"""
SELECT cast(detector_idx AS bigint) AS detector_idx, cast(pattern_idx AS bigint) AS pattern_idx, detector, category,
       cast(weight AS double) AS weight, evidence, rx
FROM (VALUES
  {_PATTERN_ROWS}) AS v(detector_idx, pattern_idx, detector, category, weight, evidence, rx)
""")
cte("docs", ["pages_themed", "css_assets"], """
SELECT site, cast(0 AS bigint) AS src_rank, page_ord AS src_ord, url AS source_url, html AS content FROM pages_themed
UNION ALL
SELECT site, cast(1 AS bigint), cast(css_ord AS bigint), css_url, css FROM css_assets
""")
cte("hits", ["docs", "stack_dim"], """
SELECT d.site, d.src_rank, d.src_ord, d.source_url, s.detector_idx, s.pattern_idx, s.detector, s.category,
       s.weight, s.evidence
FROM docs d, stack_dim s WHERE regexp_matches(d.content, s.rx)
""")
cte("signals", ["hits"], """
SELECT site, detector_idx, detector, category, n_evidence, evidence,
       least(mw + least(cast(0.1 AS double) * (n_evidence - 1), cast(0.15 AS double)), cast(1.0 AS double)) AS conf
FROM (
  SELECT site, detector_idx, detector, category, count(*) AS n_evidence, max(weight) AS mw,
         string_agg(evidence, '; ' ORDER BY pattern_idx) AS evidence
  FROM (SELECT DISTINCT site, detector_idx, pattern_idx, detector, category, weight, evidence FROM hits)
  GROUP BY site, detector_idx, detector, category)
""")
query("pattern_hits", ["hits"],
      "SELECT site, src_rank, src_ord, source_url, detector_idx, pattern_idx, detector, evidence FROM hits")
query("stack_signals", ["signals"], """
SELECT site, detector_idx, detector, category, n_evidence, round(conf, 4) AS confidence, evidence FROM signals
""")
query("signal_sources", ["hits"], """
SELECT site, detector_idx, detector, source_url, pattern_idx, src_rank, src_ord FROM (
  SELECT *, row_number() OVER (PARTITION BY site, detector_idx, source_url
                               ORDER BY pattern_idx, src_rank, src_ord) AS rn FROM hits) WHERE rn = 1
""")
cte("ranked", ["signals"], """
SELECT *, row_number() OVER (PARTITION BY site ORDER BY conf DESC, detector_idx) AS stack_rank FROM signals
""")
query("ranked_stack", ["ranked"],
      "SELECT site, stack_rank, detector, round(conf, 4) AS confidence FROM ranked")
query("primary_stack", ["ranked"],
      "SELECT site, detector, category, round(conf, 4) AS confidence FROM ranked WHERE stack_rank = 1")

# ---------------------------------------------------------------------------
# Components (K5-K6)
# ---------------------------------------------------------------------------
cte("component_m", ["css_assets"], "\nUNION ALL\n".join(
    f"SELECT site, cast({t} AS bigint) AS type_idx, '{ctype}' AS type, cast({p} AS bigint) AS pattern_idx, "
    f"cast(css_ord AS bigint) AS css_ord, pos, {jtrim(chr(39).join(['regexp_replace(m, ', '\\{$', ', ', '', ')']))} "
    f"AS class_pattern FROM ({explode_matches('css_assets', 'css', re2_rx(rx, True), 'site, css_ord')})"
    for t, p, ctype, rx in P.component_patterns()))
cte("component_first", ["component_m"], """
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY site, type_idx ORDER BY pattern_idx, css_ord, pos) AS rn
  FROM component_m) WHERE rn = 1
""")
query("component_patterns", ["component_m"], """
SELECT site, type_idx, type, class_rank, class_pattern FROM (
  SELECT *, row_number() OVER (PARTITION BY site, type_idx ORDER BY pattern_idx, css_ord, pos) AS class_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY site, type_idx, class_pattern ORDER BY pattern_idx, css_ord, pos) AS rn
    FROM component_m) WHERE rn = 1) WHERE class_rank <= 5
""")
query("component_states", ["component_first", "css_assets"], f"""
SELECT site, type_idx, type, sample_snippet, base_class,
  coalesce((SELECT bool_or(regexp_matches(c.css, concat('(?i)\\.', base_class, '[^{{]*:hover'))) FROM css_assets c
            WHERE c.site = f.site), false) AS has_hover,
  coalesce((SELECT bool_or(regexp_matches(c.css, concat('(?i)\\.', base_class, '[^{{]*:focus'))) FROM css_assets c
            WHERE c.site = f.site), false) AS has_focus,
  coalesce((SELECT bool_or(regexp_matches(c.css, concat('(?i)\\.', base_class, '[^{{]*:active'))) FROM css_assets c
            WHERE c.site = f.site), false) AS has_active
FROM (SELECT site, type_idx, type, class_pattern AS sample_snippet,
             regexp_extract(regexp_replace(class_pattern, '^\\.', ''), '^([a-zA-Z0-9_-]*)', 1) AS base_class
      FROM component_first) f
""".replace("{{", "{"))

# ---------------------------------------------------------------------------
# Accessibility
# ---------------------------------------------------------------------------
_LM = " + ".join(f"cast(coalesce(lm{i}, false) AS bigint)" for i in range(4))
cte("a11y_site", ["sites", "pages_themed", "css_assets"], f"""
SELECT s.site, coalesce(p.skip, false) AS skip, coalesce(c.fv, false) AS focus_visible,
       coalesce(c.fo, false) AS focus_outline, cast(coalesce(p.aria, 0) AS bigint) AS aria_count,
       cast(coalesce(p.imgs, 0) AS bigint) AS img_count, cast(coalesce(p.imgs_alt, 0) AS bigint) AS img_alt_count,
       cast({_LM} AS bigint) AS landmark_count
FROM sites s
LEFT JOIN (
  SELECT site, bool_or(skip) AS skip, sum(aria) AS aria, sum(imgs) AS imgs, sum(imgs_alt) AS imgs_alt,
         {", ".join(f"bool_or(lm{i}) AS lm{i}" for i in range(4))}
  FROM (SELECT site, regexp_matches(html, {L(P.SKIP_LINK)}) AS skip,
               len(regexp_extract_all(html, {L(P.ARIA_ATTR)}, 0)) AS aria,
               len(regexp_extract_all(html, {L(P.IMG_TAG)}, 0)) AS imgs,
               len(list_filter(regexp_extract_all(html, {L(P.IMG_TAG)}, 0),
                               lambda t: regexp_matches(t, {L(P.ALT_ATTR)}))) AS imgs_alt,
               {", ".join(f"regexp_matches(html, {L(rx)}) AS lm{i}" for i, rx in enumerate(P.LANDMARKS))}
        FROM pages_themed) GROUP BY site) p ON s.site = p.site
LEFT JOIN (
  SELECT site, bool_or(regexp_matches(css, {L(P.FOCUS_VISIBLE)})) AS fv,
         bool_or(regexp_matches(css, {L(P.FOCUS_OUTLINE)})) AS fo
  FROM css_assets GROUP BY site) c ON s.site = c.site
""")

_COV = "CASE WHEN img_count > 0 THEN img_alt_count / img_count ELSE cast(1.0 AS double) END"
_A11Y_SQL = [
    ("skip", f"""SELECT site, cast(0 AS bigint) AS feature_ord, '{P.A11Y_FEATURES[0]}' AS feature, skip AS present,
       CASE WHEN skip THEN '{P.SKIP_LINK_DETAIL}' END AS details, 'html' AS source_type,
       '{P.A11Y_SNIPPETS[0]}' AS snippet, cast(CASE WHEN skip THEN 0.9 ELSE 0.5 END AS double) AS confidence
FROM a11y_site"""),
    ("focus", f"""SELECT site, cast(1 AS bigint), '{P.A11Y_FEATURES[1]}', focus_visible OR focus_outline,
       CASE WHEN focus_visible THEN '{P.FOCUS_VISIBLE_DETAIL}' WHEN focus_outline THEN '{P.FOCUS_OUTLINE_DETAIL}' END,
       'css', '{P.A11Y_SNIPPETS[1]}',
       cast(CASE WHEN focus_visible THEN 0.9 WHEN focus_outline THEN 0.7 ELSE 0.4 END AS double)
FROM a11y_site"""),
    ("aria", f"""SELECT site, cast(2 AS bigint), '{P.A11Y_FEATURES[2]}', aria_count > 5,
       concat('Found ', cast(aria_count AS varchar), ' ARIA attributes'), 'html',
       concat(cast(aria_count AS varchar), ' aria-* attributes'),
       cast(CASE WHEN aria_count > 20 THEN 0.9 WHEN aria_count > 5 THEN 0.7 ELSE 0.4 END AS double)
FROM a11y_site"""),
    ("alt", f"""SELECT site, cast(3 AS bigint), '{P.A11Y_FEATURES[3]}', {_COV} > 0.8,
       concat(cast(img_alt_count AS varchar), '/', cast(img_count AS varchar), ' images have alt text (',
              cast(cast(floor(({_COV}) * 100 + 0.5) AS bigint) AS varchar), '%)'), 'html', '{P.A11Y_SNIPPETS[3]}',
       cast(CASE WHEN {_COV} > 0.9 THEN 0.9 WHEN {_COV} > 0.7 THEN 0.7 ELSE 0.5 END AS double)
FROM a11y_site"""),
    ("semantic", f"""SELECT site, cast(4 AS bigint), '{P.A11Y_FEATURES[4]}', landmark_count >= 3,
       concat('Uses ', cast(landmark_count AS varchar), '/4 semantic landmarks (nav, main, header, footer)'), 'html',
       '{P.A11Y_SNIPPETS[4]}',
       cast(CASE WHEN landmark_count >= 3 THEN 0.85 WHEN landmark_count >= 2 THEN 0.6 ELSE 0.4 END AS double)
FROM a11y_site"""),
]
_A11Y_HEAD = "SELECT * FROM (\n"
_A11Y_TAIL = "\n) AS t(site, feature_ord, feature, present, details, source_type, snippet, confidence)"
for _key, _sql in _A11Y_SQL:
    query({"skip": "a11y_skip_link", "focus": "a11y_focus", "aria": "a11y_aria", "alt": "a11y_alt",
           "semantic": "a11y_semantic"}[_key], ["a11y_site"], _A11Y_HEAD + _sql + _A11Y_TAIL)
query("a11y_report", ["a11y_site"], _A11Y_HEAD + "\nUNION ALL\n".join(s for _, s in _A11Y_SQL) + _A11Y_TAIL)

# ---------------------------------------------------------------------------
# Layout (K13-K16)
# ---------------------------------------------------------------------------
cte("container_widths", ["css_assets"], f"""
SELECT site, cast(css_ord AS bigint) AS css_ord, pos, {jtrim(f"regexp_extract(m, {L(P.CONTAINER_WIDTH)}, 1)")} AS value,
       substring(m, 1, 80) AS snippet, cast({P.CONF_CONTAINER} AS double) AS confidence
FROM ({explode_matches("css_assets", "css", P.CONTAINER_WIDTH, "site, css_ord")})
""")
cte("breakpoints", ["css_assets"], f"""
SELECT site, value, css_ord, pos, snippet, cast({P.CONF_BREAKPOINT} AS double) AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY site, value ORDER BY css_ord, pos) AS rn FROM (
    SELECT site, cast(css_ord AS bigint) AS css_ord, pos,
           {jtrim(f"regexp_extract(m, {L(P.MEDIA_WIDTH)}, 1)")} AS value, substring(m, 1, 60) AS snippet
    FROM ({explode_matches("css_assets", "css", P.MEDIA_WIDTH, "site, css_ord")}))) WHERE rn = 1
""")
cte("grid", ["sites", "css_assets"], f"""
SELECT s.site,
  CASE WHEN coalesce(b, false) THEN 'bootstrap-grid' WHEN coalesce(g, false) THEN 'css-grid'
       WHEN coalesce(f, false) THEN 'flexbox' ELSE 'unknown' END AS grid_system,
  concat_ws('; ', CASE WHEN g THEN '{P.GRID_EVIDENCE[0]}' END, CASE WHEN f THEN '{P.GRID_EVIDENCE[1]}' END,
            CASE WHEN b THEN '{P.GRID_EVIDENCE[2]}' END) AS grid_evidence
FROM sites s LEFT JOIN (
  SELECT site, bool_or(regexp_matches(css, {L(P.GRID_DISPLAY)})) AS g,
         bool_or(regexp_matches(css, {L(P.FLEX_DISPLAY)})) AS f,
         bool_or(regexp_matches(css, {L(P.BOOTSTRAP_COLUMNS)})) AS b
  FROM css_assets GROUP BY site) c ON s.site = c.site
""")
query("container_widths", ["container_widths"], "SELECT * FROM container_widths")
query("breakpoints", ["breakpoints"], "SELECT * FROM breakpoints")
query("grid_system", ["grid"], "SELECT * FROM grid")
query("layout_info", ["grid", "container_widths", "breakpoints"], """
SELECT g.site, g.grid_system, g.grid_evidence,
  cast((SELECT count(*) FROM container_widths c WHERE c.site = g.site) AS bigint) AS n_container_widths,
  cast((SELECT count(*) FROM breakpoints b WHERE b.site = g.site) AS bigint) AS n_breakpoints
FROM grid g
""")

# ---------------------------------------------------------------------------
# robots.txt (L9), risks (K17), notes
# ---------------------------------------------------------------------------
_AG = "jtrim_ag"
cte("robots_status", ["robots"], f"""
SELECT origin, CASE WHEN f.path IS NOT NULL THEN 'blocked' ELSE 'allowed' END AS status,
       CASE WHEN f.path IS NOT NULL THEN concat('robots.txt disallows crawling: ', f.path) END AS warning
FROM (SELECT origin, list_reduce(
        list_transform(string_split(body, chr(10)), lambda x: lower({jtrim('x')})),
        lambda acc, ln: struct_pack(
          in_block := CASE WHEN starts_with(ln, 'user-agent:')
                           THEN ({jtrim('substring(ln, 12)')} = '*' OR contains({jtrim('substring(ln, 12)')}, 'bot'))
                           ELSE acc.in_block END,
          path := CASE WHEN acc.path IS NULL AND NOT starts_with(ln, 'user-agent:') AND acc.in_block
                             AND starts_with(ln, 'disallow:') AND {jtrim('substring(ln, 10)')} IN ('/', '/*')
                       THEN {jtrim('substring(ln, 10)')} ELSE acc.path END),
        struct_pack(in_block := false, path := cast(NULL AS varchar))) AS f
      FROM robots)
""")
query("robots_status", ["robots_status"], "SELECT * FROM robots_status")
cte("site_facts", ["sites", "color_tokens", "signals", "robots_status", "pages_themed", "css_assets"], """
SELECT s.site,
  cast((SELECT count(*) FROM color_tokens c WHERE c.site = s.site) AS bigint) AS n_colors,
  EXISTS (SELECT 1 FROM signals g WHERE g.site = s.site AND g.detector = 'Bootstrap') AS bootstrap,
  EXISTS (SELECT 1 FROM signals g WHERE g.site = s.site AND g.detector = 'Tailwind CSS') AS tailwind,
  coalesce((SELECT r.status FROM robots_status r WHERE r.origin = s.site), 'allowed') AS robots_status,
  cast((SELECT count(*) FROM pages_themed p WHERE p.site = s.site) AS bigint) AS n_pages,
  cast((SELECT count(*) FROM css_assets a WHERE a.site = s.site) AS bigint) AS n_css
FROM sites s
""")
query("risks", ["site_facts"], f"""
SELECT site, cast(row_number() OVER (PARTITION BY site ORDER BY k) - 1 AS bigint) AS risk_ord, risk FROM (
  SELECT site, 0 AS k, {sql_lit(P.RISK_MANY_COLORS)} AS risk FROM site_facts WHERE n_colors > 50
  UNION ALL SELECT site, 1, {sql_lit(P.RISK_TWO_FRAMEWORKS)} FROM site_facts WHERE bootstrap AND tailwind
  UNION ALL SELECT site, 2, {sql_lit(P.RISK_ROBOTS)} FROM site_facts WHERE robots_status = 'blocked')
""")
query("notes", ["sites", "pages_themed", "css_fetched"], f"""
SELECT site, cast(0 AS bigint) AS note_ord, {sql_lit(P.NOTE_NO_EXTERNAL_CSS)} AS note FROM sites
WHERE (SELECT count(*) FROM pages_themed p WHERE p.site = sites.site) > 0
  AND NOT EXISTS (SELECT 1 FROM css_fetched f WHERE f.site = sites.site AND f.fetched)
""")

# ---------------------------------------------------------------------------
# URL resolution (L1-L3), DuckDB mirror of functions.urls
# ---------------------------------------------------------------------------
from sitelens.functions import urls as U  # noqa: E402


def _q(s: str) -> str:
    return sql_lit(s)


def _pct(c: str, extra: str) -> str:
    rx = _q(U._set_rx(extra))
    return (f"CASE WHEN regexp_matches({c}, {rx}) THEN array_to_string(list_transform("
            f"regexp_extract_all({c}, '(?s).', 0), lambda ch: CASE WHEN regexp_matches(ch, {rx}) "
            f"THEN regexp_replace(hex(encode(ch)), '(..)', '%\\1', 'g') ELSE ch END), '') ELSE {c} END")


def _dots_sql(path: str) -> str:
    one = "lower({}) IN ('.', '%2e')"
    two = "lower({}) IN ('..', '.%2e', '%2e.', '%2e%2e')"
    segs = f"string_split(substring({path}, 2), '/')"
    fold = (f"list_reduce({segs}, lambda acc, s: CASE WHEN {two.format('s')} THEN "
            f"(CASE WHEN len(acc) > 0 THEN acc[1:len(acc) - 1] ELSE acc END) WHEN {one.format('s')} THEN acc "
            f"ELSE list_concat(acc, [s]) END, cast([] AS varchar[]))")
    last = f"({segs})[-1]"
    return (f"concat('/', array_to_string(CASE WHEN {one.format(last)} OR {two.format(last)} "
            f"THEN list_concat({fold}, ['']) ELSE {fold} END, '/'))")


def resolve_sql(src: str, keep: str, href: str, base: str | None, out: str) -> str:
    """SELECT keep…, <href resolved against base> AS out FROM src (same staging as the Spark version)."""
    P_ = _q(U.URL_PARTS)
    base_e = base if base else "cast(NULL AS varchar)"
    s1 = (f"SELECT {keep}, regexp_replace(regexp_replace({href}, {_q(U.EDGE_SPACE)}, '', 'g'), "
          f"{_q(U.TAB_NEWLINE)}, '', 'g') AS _h, "
          + ", ".join(f"regexp_extract({base_e}, {P_}, {g}) AS b{n}"
                      for g, n in ((1, "s"), (3, "a"), (4, "p"), (5, "q")))
          + f", coalesce(regexp_matches({base_e}, {P_}), false) AS _bok FROM {src}")
    s2 = (f"SELECT *, lower(regexp_extract(_h, {_q(U.SCHEME)}, 1)) AS _s FROM ({s1})")
    s3 = (f"SELECT *, substring(_h, length(_s) + 2) AS _rest, lower(bs) AS _bs FROM ({s2})")
    s4 = (f"SELECT *, CASE WHEN _s = '' THEN _h WHEN _s IN ('http', 'https') AND _s = _bs "
          f"AND NOT regexp_matches(_rest, '^[/\\\\]') THEN _rest END AS _r FROM ({s3})")
    origin_b = "concat(_bs, '://', ba)"
    relative = (f"CASE WHEN NOT _bok THEN NULL "
                f"WHEN regexp_matches(_r, '^[/\\\\][/\\\\]') THEN concat(_bs, ':', _r) "
                f"WHEN regexp_matches(_r, '^[/\\\\]') THEN concat({origin_b}, _r) "
                f"WHEN starts_with(_r, '?') THEN concat({origin_b}, bp, _r) "
                f"WHEN starts_with(_r, '#') THEN concat({origin_b}, bp, bq, _r) "
                f"WHEN _r = '' THEN concat({origin_b}, bp, bq) "
                f"ELSE concat({origin_b}, regexp_extract(bp, '^(.*/)', 1), _r) END")
    s5 = (f"SELECT *, CASE WHEN _r IS NOT NULL THEN {relative} "
          f"WHEN _s IN ('http', 'https') THEN concat(_s, '://', regexp_replace(_rest, '^[/\\\\]+', '')) "
          f"ELSE concat(_s, ':', _rest) END AS _abs FROM ({s4})")
    s6 = (f"SELECT *, lower(regexp_extract(_abs, {P_}, 1)) AS _us, regexp_extract(_abs, {P_}, 2) AS _a2, "
          f"regexp_extract(_abs, {P_}, 3) AS _ua, regexp_extract(_abs, {P_}, 4) AS _up, "
          f"regexp_extract(_abs, {P_}, 5) AS _uq, regexp_extract(_abs, {P_}, 6) AS _uf FROM ({s5})")
    s7 = (f"SELECT *, regexp_extract(_ua, '^(.*@)', 1) AS _ui, "
          f"regexp_extract(_ua, '^(?:.*@)?([^@]*)$', 1) AS _hp FROM ({s6})")
    s8 = (f"SELECT *, lower(regexp_extract(_hp, '^(\\[[^\\]]*\\]|[^:]*)', 1)) AS _host, "
          f"regexp_extract(_hp, '^(?:\\[[^\\]]*\\]|[^:]*):(.*)$', 1) AS _port FROM ({s7})")
    s9 = (f"SELECT *, CASE WHEN regexp_matches(_port, '^[0-9]{{1,5}}$') THEN cast(_port AS integer) END AS _pn, "
          f"CASE WHEN _up = '' THEN '/' ELSE replace(_up, '\\', '/') END AS _p0 FROM ({s8})")
    s10 = (f"SELECT *, (_a2 <> '' AND _host <> '' AND NOT regexp_matches(_host, {_q(U.FORBIDDEN_HOST)}) "
           f"AND (_port = '' OR (_pn IS NOT NULL AND _pn <= 65535))) AS _ok, "
           f"CASE WHEN _port = '' OR _pn = (CASE WHEN _us = 'http' THEN 80 WHEN _us = 'https' THEN 443 END) "
           f"THEN '' ELSE concat(':', cast(_pn AS varchar)) END AS _po, {_dots_sql('_p0')} AS _path FROM ({s9})")
    canonical = (f"concat(_us, '://', _ui, _host, _po, {_pct('_path', U.PATH_SET)}, {_pct('_uq', U.QUERY_SET)}, "
                 f"{_pct('_uf', U.FRAGMENT_SET)})")
    keep_cols = ", ".join(c.strip().split(" AS ")[-1].split(".")[-1] for c in keep.split(","))
    return (f"SELECT {keep_cols}, CASE WHEN _abs IS NULL THEN NULL "
            f"WHEN _us IN ('http', 'https') THEN CASE WHEN _ok THEN {canonical} END "
            f"WHEN regexp_matches(_abs, {_q(U.SCHEME)}) THEN _abs END AS {out} FROM ({s10})")


def origin_sql(u: str) -> str:
    return (f"CASE WHEN {u} IS NULL THEN NULL WHEN regexp_matches({u}, '^https?://') THEN "
            f"concat(regexp_extract({u}, '^(https?://)', 1), regexp_extract({u}, '^https?://(?:[^/?#@]*@)?([^/?#]*)', 1)) "
            f"WHEN regexp_matches({u}, {_q(U.SCHEME)}) THEN 'null' END")


def _tags(kind: int, rx: str, with_href: bool) -> str:
    if with_href:
        lst = f"list_filter(regexp_extract_all(html, {L(rx)}, 0), lambda t: regexp_matches(t, {L(P.HREF_IN_TAG)}))"
        val = f"regexp_extract(t, {L(P.HREF_IN_TAG)}, 1)"
    else:
        lst = f"regexp_extract_all(html, {L(rx)}, 1)"
        val = "t"
    return (f"SELECT site, page_ord, cast({kind} AS bigint) AS kind_rank, p1, cast(0 AS bigint) AS p2, {val} AS href "
            f"FROM (SELECT site, page_ord, cast(generate_subscripts(l, 1) - 1 AS bigint) AS p1, unnest(l) AS t "
            f"FROM (SELECT site, page_ord, {lst} AS l FROM pages_themed))")


cte("raw_links", ["pages_themed"], "\nUNION ALL\n".join([
    _tags(0, P.LINK_STYLESHEET, True),
    _tags(1, P.LINK_TEXT_CSS, True),
    f"""SELECT site, page_ord, cast(2 AS bigint), p1, cast(generate_subscripts(im, 1) - 1 AS bigint), unnest(im)
FROM (SELECT site, page_ord, p1, regexp_extract_all(body, {L(P.CSS_IMPORT)}, 1) AS im FROM (
  SELECT site, page_ord, cast(generate_subscripts(bl, 1) - 1 AS bigint) AS p1, unnest(bl) AS body
  FROM (SELECT site, page_ord, regexp_extract_all(html, {L(P.STYLE_BLOCK)}, 1) AS bl FROM pages_themed)))""",
    _tags(3, P.SCRIPT_SRC, False),
    _tags(4, P.ANCHOR_HREF, False)]))
cte("page_bases", ["pages_themed"],
    "SELECT site, page_ord, url, regexp_replace(canon, '#.*$', '') AS final_url FROM ("
    + resolve_sql("pages_themed", "site, page_ord, url", "url", None, "canon") + ")")
cte("resolved", ["raw_links", "page_bases"], resolve_sql(
    "(SELECT r.*, b.final_url FROM raw_links r JOIN page_bases b ON r.site = b.site AND r.page_ord = b.page_ord)",
    "site, page_ord, final_url, kind_rank, p1, p2, href", "href", "final_url", "url"))


def _dedup_links(where: str, url: str = "url") -> str:
    return f"""
SELECT site, page_ord, url, kind_rank, p1, p2 FROM (
  SELECT site, page_ord, {url} AS url, kind_rank, p1, p2,
         row_number() OVER (PARTITION BY site, page_ord, {url} ORDER BY kind_rank, p1, p2) AS rn
  FROM resolved WHERE {where}) WHERE rn = 1"""


_ANCHOR = f"kind_rank = 4 AND NOT regexp_matches(href, {L(P.SKIPPED_SCHEMES)}) AND url IS NOT NULL"
_SAME = f"coalesce({origin_sql('url')} = {origin_sql('final_url')}, false)"
cte("css_links", ["resolved"], _dedup_links("kind_rank <= 2 AND url IS NOT NULL"))
cte("js_links", ["resolved"], _dedup_links("kind_rank = 3 AND url IS NOT NULL"))
cte("internal_links", ["resolved"], _dedup_links(f"{_ANCHOR} AND {_SAME}", "regexp_replace(url, '[?#].*$', '')"))
query("css_links", ["css_links"], "SELECT * FROM css_links")
query("js_links", ["js_links"], "SELECT * FROM js_links")
query("internal_links", ["internal_links"], "SELECT * FROM internal_links")
query("canonical_urls", ["resolved"],
      "SELECT site, url, count(*) AS n_links FROM resolved WHERE url IS NOT NULL GROUP BY site, url")
query("pages_per_origin", ["page_bases"],
      f"SELECT {origin_sql('final_url')} AS origin, count(*) AS n_pages FROM page_bases GROUP BY 1")
query("link_origin_split", ["resolved"], f"""
SELECT site, count(*) FILTER (WHERE {_SAME}) AS n_same_origin, count(*) FILTER (WHERE NOT {_SAME}) AS n_cross_origin
FROM resolved WHERE {_ANCHOR} GROUP BY site
""")
_PL = "\n".join(f"""LEFT JOIN (SELECT site, page_ord, count(*) AS n, string_agg(url, ' ' ORDER BY kind_rank, p1, p2) AS l
           FROM {t} GROUP BY site, page_ord) {t[0]} ON p.site = {t[0]}.site AND p.page_ord = {t[0]}.page_ord"""
                for t in ("css_links", "js_links", "internal_links"))
query("page_links", ["pages_themed", "css_links", "js_links", "internal_links"], f"""
SELECT p.site, p.page_ord, coalesce(c.n, 0) AS n_css_links, coalesce(j.n, 0) AS n_js_links,
       coalesce(i.n, 0) AS n_internal_links, coalesce(c.l, '') AS css_links, coalesce(j.l, '') AS js_links,
       coalesce(i.l, '') AS internal_links
FROM pages_themed p
{_PL}
""")
query("link_counts", ["resolved", "css_links", "js_links", "internal_links"], """
SELECT s.site,
  coalesce((SELECT count(DISTINCT url) FROM css_links c WHERE c.site = s.site), 0) AS n_css_links,
  coalesce((SELECT count(DISTINCT url) FROM js_links c WHERE c.site = s.site), 0) AS n_js_links,
  coalesce((SELECT count(DISTINCT url) FROM internal_links c WHERE c.site = s.site), 0) AS n_internal_links
FROM (SELECT DISTINCT site FROM resolved) s
""")

# ---------------------------------------------------------------------------
# Requests (V1, V2) and sources
# ---------------------------------------------------------------------------
_REQ = "request_id, theme_url, max_pages, same_origin_only, include_assets, mode, notes"
cte("req_parsed", ["requests"], resolve_sql("requests", _REQ, "theme_url", None, "parsed"))
query("validate_requests", ["req_parsed"], f"""
SELECT request_id, len(errs) = 0 AS valid, cast(len(errs) AS bigint) AS n_errors,
       array_to_string(errs, ', ') AS errors FROM (
  SELECT request_id, list_filter([
    CASE WHEN theme_url IS NULL OR theme_url = '' THEN {sql_lit(P.ERR_URL_REQUIRED)}
         WHEN parsed IS NULL THEN {sql_lit(P.ERR_URL_INVALID)}
         WHEN regexp_extract(parsed, '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1) NOT IN ('http', 'https')
         THEN {sql_lit(P.ERR_URL_SCHEME)} END,
    CASE WHEN max_pages IS NOT NULL AND (max_pages < 1 OR max_pages > 20) THEN {sql_lit(P.ERR_MAX_PAGES)} END,
    CASE WHEN mode IS NOT NULL AND mode NOT IN ('extract', 'prompt', 'both') THEN {sql_lit(P.ERR_MODE)} END
  ], lambda e: e IS NOT NULL) AS errs FROM req_parsed)
""")
cte("req_filled", ["requests"], f"""
SELECT request_id, theme_url, coalesce(max_pages, {P.DEFAULT_MAX_PAGES}) AS max_pages,
       coalesce(same_origin_only, true) AS same_origin_only, coalesce(include_assets, false) AS include_assets,
       coalesce(mode, 'both') AS mode, coalesce(notes, '') AS notes FROM requests
""")
cte("req_norm", ["req_filled"], resolve_sql("req_filled", _REQ, "theme_url", None, "seed"))
query("normalize_requests", ["req_norm"], f"""
SELECT request_id, theme_url, cast(max_pages AS bigint) AS max_pages, same_origin_only, include_assets, mode, notes,
       seed, {origin_sql('seed')} AS site FROM req_norm
""")


def _eff(s: str) -> str:
    return f"CASE WHEN {s} = 429 OR {s} >= 500 THEN 0 ELSE {s} END"


def _err(s: str, url: str) -> str:
    return (f"CASE WHEN {s} >= 200 AND {s} < 300 THEN NULL WHEN {s} = 429 OR {s} >= 500 "
            f"THEN concat('Failed to fetch ', {url}, ' after {P.FETCH_RETRIES} attempts') "
            f"ELSE concat('HTTP ', cast({s} AS varchar)) END")


cte("page_status", ["pages_themed", "fetch_log"], f"""
SELECT p.site, p.page_ord, p.url, {_eff('coalesce(f.status, 200)')} AS status,
       {_err('coalesce(f.status, 200)', 'p.url')} AS error, p.html
FROM pages_themed p LEFT JOIN fetch_log f ON f.kind = 'page' AND f.site = p.site AND f.url = p.url
""")
_PLN = "\n".join(f"""LEFT JOIN (SELECT site, page_ord, count(*) AS n, string_agg(url, ' ' ORDER BY kind_rank, p1, p2) AS l FROM {t} GROUP BY site, page_ord) {t[0]}
  ON s.site = {t[0]}.site AND s.page_ord = {t[0]}.page_ord""" for t in ("css_links", "js_links", "internal_links"))
query("src_pages", ["page_status", "page_bases", "css_links", "js_links", "internal_links"], f"""
SELECT s.site, s.page_ord, s.url, b.final_url, cast(s.status AS bigint) AS status, s.error,
       CASE WHEN s.error IS NULL THEN substring(s.html, 1, 2000) ELSE '' END AS html_snippet,
       CASE WHEN s.error IS NULL THEN coalesce(c.n, 0) ELSE 0 END AS n_css_links,
       CASE WHEN s.error IS NULL THEN coalesce(j.n, 0) ELSE 0 END AS n_js_links,
       CASE WHEN s.error IS NULL THEN coalesce(i.n, 0) ELSE 0 END AS n_internal_links,
       CASE WHEN s.error IS NULL THEN coalesce(c.l, '') ELSE '' END AS css_links,
       CASE WHEN s.error IS NULL THEN coalesce(j.l, '') ELSE '' END AS js_links,
       CASE WHEN s.error IS NULL THEN coalesce(i.l, '') ELSE '' END AS internal_links
FROM page_status s JOIN page_bases b ON s.site = b.site AND s.page_ord = b.page_ord
{_PLN}
""")
query("src_css_assets", ["css_links", "page_status", "css_assets", "fetch_log"], """
SELECT w.site, w.url AS css_url, w.page_ord, w.kind_rank, w.p1, w.p2,
       coalesce(a.css IS NOT NULL AND a.css <> '' AND (f.url IS NULL OR f.status BETWEEN 200 AND 299), false) AS fetched,
       CASE WHEN a.css IS NOT NULL AND a.css <> '' AND (f.url IS NULL OR f.status BETWEEN 200 AND 299) THEN cast(length(a.css) AS bigint) END AS css_length
FROM (SELECT * FROM (
        SELECT l.*, row_number() OVER (PARTITION BY l.site, l.url ORDER BY l.page_ord, l.kind_rank, l.p1, l.p2) AS rn
        FROM css_links l JOIN page_status s ON s.site = l.site AND s.page_ord = l.page_ord AND s.error IS NULL)
      WHERE rn = 1) w
LEFT JOIN css_assets a ON a.site = w.site AND a.css_url = w.url
LEFT JOIN fetch_log f ON f.kind = 'css' AND f.site = w.site AND f.url = w.url
""")
cte("css_fetched", ["css_links", "page_status", "css_assets", "fetch_log"], _QUERIES["src_css_assets"][1])
query("src_css_files", ["css_assets"], "SELECT site, cast(css_ord AS bigint) AS css_ord, css FROM css_assets")
query("crawl_stats", ["sites", "fetch_log", "robots_status"], """
SELECT s.site, coalesce(a.pages_crawled, 0) AS pages_crawled, coalesce(a.total_requests, 0) AS total_requests,
       coalesce(a.failed_requests, 0) AS failed_requests, coalesce(a.crawl_duration_ms, 0) AS crawl_duration_ms,
       coalesce(r.status, 'allowed') AS robots_status
FROM sites s
LEFT JOIN (SELECT site, count(*) FILTER (WHERE kind = 'page') AS pages_crawled, count(*) AS total_requests,
                  count(*) FILTER (WHERE NOT (status >= 200 AND status < 300)) AS failed_requests,
                  cast(max(ended_ms) - min(started_ms) AS bigint) AS crawl_duration_ms
           FROM fetch_log GROUP BY site) a ON a.site = s.site
LEFT JOIN robots_status r ON r.origin = s.site
""")
query("fetch_outcome", ["fetch_log"], f"""
SELECT site, kind, CASE WHEN err IS NULL THEN 'ok' WHEN eff = 0 THEN 'error' ELSE err END AS outcome,
       cast(eff AS bigint) AS status, count(*) AS n
FROM (SELECT site, kind, {_eff('status')} AS eff, {_err('status', 'url')} AS err FROM fetch_log)
GROUP BY ALL
""")

# ---------------------------------------------------------------------------
# Report pieces over the whole tables
# ---------------------------------------------------------------------------
_REC = " ".join(f"WHEN primary_stack = {sql_lit(n)} THEN {sql_lit(t)}" for n, t in P.RECOMMENDATIONS)
query("recommended_approach", ["sites", "ranked"], f"""
SELECT s.site, r.detector AS primary_stack,
       CASE {_REC} ELSE {sql_lit(P.RECOMMEND_DEFAULT)} END AS recommended_approach
FROM sites s LEFT JOIN (SELECT site, detector FROM ranked WHERE stack_rank = 1) r ON r.site = s.site
""".replace("CASE WHEN primary_stack", "CASE WHEN r.detector").replace("WHEN primary_stack", "WHEN r.detector"))
query("report_meta", ["sites", "fetch_log", "robots_status", "pages_themed"], f"""
SELECT s.site, '{P.REPORT_VERSION}' AS version, '2026-01-01T00:00:00.000Z' AS generated_at,
       (SELECT p.url FROM pages_themed p WHERE p.site = s.site AND p.page_ord = 0) AS source_url,
       coalesce(a.pages_crawled, 0) AS pages_crawled, coalesce(a.crawl_duration_ms, 0) AS crawl_duration_ms,
       coalesce(r.status, 'allowed') AS robots_status
FROM sites s
LEFT JOIN (SELECT site, count(*) FILTER (WHERE kind = 'page') AS pages_crawled,
                  cast(max(ended_ms) - min(started_ms) AS bigint) AS crawl_duration_ms
           FROM fetch_log GROUP BY site) a ON a.site = s.site
LEFT JOIN robots_status r ON r.origin = s.site
""")
query("typography_summary", ["sites", "font_families", "corpus"], f"""
SELECT s.site,
  coalesce((SELECT array_to_string(list(font_family ORDER BY {ORD}, pos)[1:5], ' | ') FROM font_families f
            WHERE f.site = s.site), '') AS primary_fonts,
  coalesce(h.n, 0) AS n_headings, b.font_size AS body_size
FROM sites s
LEFT JOIN (SELECT site, count(*) AS n FROM ({explode_matches("corpus", "css", P.HEADING_RULE, "site")}) GROUP BY site) h
  ON h.site = s.site
LEFT JOIN (SELECT site, font_size FROM (
    SELECT site, {first_group(_BODY_STYLES, P.RULE_FONT_SIZE)} AS font_size,
           row_number() OVER (PARTITION BY site ORDER BY src_rank DESC, src_ord DESC, block_ord DESC, pos DESC) AS rn
    FROM ({explode_matches("corpus", "css", P.BODY_RULE, f"site, {ORD}")})) WHERE rn = 1) b ON b.site = s.site
""")
cte("comp_states", ["component_first", "css_assets"], _QUERIES["component_states"][1])
cte("comp_classes", ["component_m"], _QUERIES["component_patterns"][1])
query("component_summary", ["comp_states", "comp_classes"], """
SELECT st.site, st.type AS name, st.type,
       (SELECT string_agg(class_pattern, ', ' ORDER BY class_rank) FROM comp_classes c
        WHERE c.site = st.site AND c.type_idx = st.type_idx) AS classes,
       concat_ws(', ', CASE WHEN has_hover THEN 'hover' END, CASE WHEN has_focus THEN 'focus' END,
                 CASE WHEN has_active THEN 'active' END) AS states
FROM comp_states st
""")
query("a11y_layout_summary", ["a11y_site"],
      "SELECT site, feature_ord, feature, present, details FROM (\n" + "\nUNION ALL\n".join(s for _, s in _A11Y_SQL)
      + "\n) AS t(site, feature_ord, feature, present, details, source_type, snippet, confidence)")
query("quick_start_tokens", ["color_tokens", "radius_tokens", "shadow_tokens", "font_families"], f"""
SELECT site, kind, item_ord, name, CASE WHEN kind = 'font' THEN NULL ELSE
         regexp_replace(regexp_replace(name, '^--', ''), '[^a-zA-Z0-9]', '-', 'g') END AS key, value FROM (
  SELECT site, 'color' AS kind, row_number() OVER (PARTITION BY site ORDER BY {ORD}, pos) AS item_ord, name, value
  FROM color_tokens
  UNION ALL SELECT site, 'radius', row_number() OVER (PARTITION BY site ORDER BY {ORD}, kind_rank, pos), name, value
  FROM radius_tokens
  UNION ALL SELECT site, 'shadow', row_number() OVER (PARTITION BY site ORDER BY {ORD}, kind_rank, pos), name, value
  FROM shadow_tokens
  UNION ALL SELECT site, 'font', row_number() OVER (PARTITION BY site ORDER BY {ORD}, pos), font_family,
         {jtrim("split_part(font_family, ',', 1)")}
  FROM font_families)
WHERE (kind = 'color' AND item_ord <= 10) OR (kind = 'radius' AND item_ord <= 5) OR (kind = 'shadow' AND item_ord <= 3)
   OR (kind = 'font' AND item_ord <= 5)
""")
query("run_summary", ["sites", "signals", "ranked", "color_tokens", "font_tokens", "radius_tokens", "shadow_tokens",
                      "component_m", "site_facts"], """
SELECT s.site,
  (SELECT count(*) FROM signals x WHERE x.site = s.site) AS n_signals,
  (SELECT count(*) FROM color_tokens x WHERE x.site = s.site) AS n_colors,
  (SELECT count(*) FROM font_tokens x WHERE x.site = s.site) AS n_typography,
  (SELECT count(*) FROM radius_tokens x WHERE x.site = s.site) AS n_radii,
  (SELECT count(*) FROM shadow_tokens x WHERE x.site = s.site) AS n_shadows,
  (SELECT count(DISTINCT type_idx) FROM component_m x WHERE x.site = s.site) AS n_components,
  cast(5 AS bigint) AS n_a11y,
  (SELECT cast((n_colors > 50)::int + (bootstrap AND tailwind)::int + (robots_status = 'blocked')::int AS bigint)
   FROM site_facts f WHERE f.site = s.site) AS n_risks,
  (SELECT count(*) FROM color_tokens x WHERE x.site = s.site) + (SELECT count(*) FROM font_tokens x WHERE x.site = s.site)
  + (SELECT count(*) FROM radius_tokens x WHERE x.site = s.site)
  + (SELECT count(*) FROM shadow_tokens x WHERE x.site = s.site) AS total_tokens,
  r.detector AS primary_stack, cast(round(r.conf * 100) AS bigint) AS primary_confidence_pct
FROM sites s LEFT JOIN (SELECT * FROM ranked WHERE stack_rank = 1) r ON r.site = s.site
""")

# Streaming registry (§7.7): the set of distinct colours per site over inline style blocks.
cte("inline_colors", ["blocks"], f"""
SELECT DISTINCT site, regexp_extract({jtrim(f"regexp_extract(m, {L(P.CUSTOM_PROPERTY)}, 2)")}, {L(P.COLOR)}, 0) AS value
FROM ({explode_matches("blocks", "css", P.CUSTOM_PROPERTY, "site")})
""")
query("stream_color_tokens", ["inline_colors"], "SELECT site, value FROM inline_colors WHERE value <> ''")

# ---------------------------------------------------------------------------
# Crawl (L8): the level-wise rule unrolled (the budget caps it at 20 levels)
# ---------------------------------------------------------------------------
cte("bfs_links", ["internal_links", "page_status", "page_bases"], """
SELECT b.final_url AS key, l.kind_rank, l.p1, l.p2, l.url AS target
FROM internal_links l JOIN page_status s ON s.site = l.site AND s.page_ord = l.page_ord
JOIN page_bases b ON b.site = l.site AND b.page_ord = l.page_ord
WHERE s.error IS NULL AND b.final_url IS NOT NULL
""")
cte("bfs_reqs", ["req_norm", "validate_requests_v"], f"""
SELECT n.request_id, n.seed, n.max_pages, n.same_origin_only, {origin_sql('n.seed')} AS seed_origin
FROM req_norm n JOIN validate_requests_v v ON v.request_id = n.request_id AND v.valid
""")
cte("validate_requests_v", ["req_parsed"], _QUERIES["validate_requests"][1])
cte("bfs_v0", ["bfs_reqs"], """
SELECT request_id, seed AS url, cast(1 AS bigint) AS visit_no, cast(0 AS bigint) AS level
FROM bfs_reqs WHERE seed IS NOT NULL AND max_pages >= 1
""")
_MAX_LEVELS = P.MAX_PAGES_RANGE[1]
for _lv in range(1, _MAX_LEVELS + 1):
    _prev_v, _prev_f = f"bfs_v{_lv - 1}", ("bfs_v0" if _lv == 1 else f"bfs_n{_lv - 1}")
    cte(f"bfs_n{_lv}", [_prev_v, _prev_f, "bfs_links", "bfs_reqs"], f"""
SELECT request_id, url, visit_no, cast({_lv} AS bigint) AS level FROM (
  SELECT c.request_id, c.url, r.max_pages,
         cast((SELECT max(visit_no) FROM {_prev_v} v WHERE v.request_id = c.request_id)
              + row_number() OVER (PARTITION BY c.request_id ORDER BY c.parent, c.kind_rank, c.p1, c.p2) AS bigint)
           AS visit_no
  FROM (
    SELECT * FROM (
      SELECT f.request_id, b.target AS url, f.visit_no AS parent, b.kind_rank, b.p1, b.p2,
             row_number() OVER (PARTITION BY f.request_id, b.target
                                ORDER BY f.visit_no, b.kind_rank, b.p1, b.p2) AS rn
      FROM {_prev_f} f
      JOIN bfs_links b ON b.key = regexp_replace(f.url, '#.*$', '')
      JOIN bfs_reqs r ON r.request_id = f.request_id
      WHERE (NOT r.same_origin_only OR coalesce({origin_sql('b.target')} = r.seed_origin, false))
        AND NOT EXISTS (SELECT 1 FROM {_prev_v} v WHERE v.request_id = f.request_id AND v.url = b.target))
    WHERE rn = 1) c
  JOIN bfs_reqs r ON r.request_id = c.request_id)
WHERE visit_no <= max_pages
""")
    cte(f"bfs_v{_lv}", [_prev_v, f"bfs_n{_lv}"], f"SELECT * FROM {_prev_v} UNION ALL SELECT * FROM bfs_n{_lv}")
query("site_bfs", [f"bfs_v{_MAX_LEVELS}"], f"SELECT request_id, url, visit_no, level FROM bfs_v{_MAX_LEVELS}")

query("layout_summary", ["container_widths", "breakpoints", "grid", "sites", "css_assets"], f"""
SELECT site, 'container_width' AS kind, cast(css_ord AS bigint) AS sheet_ord, cast(pos AS bigint) AS item_ord, value FROM container_widths
UNION ALL SELECT site, 'breakpoint', cast(css_ord AS bigint), cast(pos AS bigint), value FROM breakpoints
UNION ALL SELECT site, 'grid_system', cast(0 AS bigint), cast(0 AS bigint), grid_system FROM grid
UNION ALL SELECT site, 'grid_evidence', cast(0 AS bigint), cast(k AS bigint), ev FROM (
  SELECT s.site, unnest(list_filter([
      CASE WHEN bool_or(regexp_matches(c.css, {L(P.GRID_DISPLAY)})) THEN '{P.GRID_EVIDENCE[0]}' END,
      CASE WHEN bool_or(regexp_matches(c.css, {L(P.FLEX_DISPLAY)})) THEN '{P.GRID_EVIDENCE[1]}' END,
      CASE WHEN bool_or(regexp_matches(c.css, {L(P.BOOTSTRAP_COLUMNS)})) THEN '{P.GRID_EVIDENCE[2]}' END],
      lambda x: x IS NOT NULL)) AS ev,
    unnest(generate_series(0, len(list_filter([
      CASE WHEN bool_or(regexp_matches(c.css, {L(P.GRID_DISPLAY)})) THEN 1 END,
      CASE WHEN bool_or(regexp_matches(c.css, {L(P.FLEX_DISPLAY)})) THEN 1 END,
      CASE WHEN bool_or(regexp_matches(c.css, {L(P.BOOTSTRAP_COLUMNS)})) THEN 1 END], lambda x: x IS NOT NULL)) - 1))
      AS k
  FROM sites s JOIN css_assets c ON c.site = s.site GROUP BY s.site)
""")

# ---------------------------------------------------------------------------
# The batch (R14, S4, R7): page records of the crawl, their style sheets, statistics, and the analysis over them
# ---------------------------------------------------------------------------


def scoped(overrides: dict[str, str], deps: list[str], body: str) -> str:
    """``body`` over the named steps, with some of the tables they read replaced (names of the outer query stay visible)."""
    names = [n for n in _resolve_over(deps, set(overrides)) if n not in overrides]
    steps = [(n, sql) for n, sql in overrides.items()] + [(n, _CTES[n][0]) for n in names]
    return "WITH " + ",\n".join(f"{n} AS (\n{sql}\n)" for n, sql in steps) + f"\n{body}"


def _resolve_over(deps: list[str], given: set[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order or n in given:
            return
        for d in _CTES[n][1]:
            visit(d)
        order.append(n)

    for d in deps:
        visit(d)
    return order


cte("store_keys", ["page_bases"], """
SELECT final_url AS key, site, page_ord, url FROM page_bases WHERE final_url IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY final_url ORDER BY site, page_ord) = 1
""")
cte("crawled", [f"bfs_v{_MAX_LEVELS}", "store_keys", "pages_themed", "fetch_log"], f"""
SELECT site, page_ord, url, final_url, {_eff('raw')} AS status, {_err('raw', 'url')} AS error,
       CASE WHEN {_err('raw', 'url')} IS NULL THEN html ELSE '' END AS html, store_site, store_url
FROM (
  SELECT v.request_id AS site, cast(v.visit_no - 1 AS bigint) AS page_ord, v.url, regexp_replace(v.url, '#.*$', '') AS final_url,
         CASE WHEN k.key IS NULL THEN 404 ELSE coalesce(f.status, 200) END AS raw, p.html, k.site AS store_site, k.url AS store_url
  FROM bfs_v{_MAX_LEVELS} v LEFT JOIN store_keys k ON k.key = regexp_replace(v.url, '#.*$', '')
  LEFT JOIN pages_themed p ON p.site = k.site AND p.page_ord = k.page_ord
  LEFT JOIN fetch_log f ON f.kind = 'page' AND f.site = k.site AND f.url = k.url)
""")
cte("css_fetches", ["crawled", "req_norm", "css_assets", "fetch_log"], f"""
SELECT w.site, w.url AS css_url, w.page_ord, w.kind_rank, w.p1, w.p2, CASE WHEN a.css <> '' THEN a.css END AS css,
       CASE WHEN a.css <> '' THEN a.site ELSE w.page_site END AS store_site
FROM (
  SELECT l.*, c.store_site AS page_site FROM ({scoped({"pages_themed": """
SELECT c.site, c.page_ord, c.final_url AS url, c.html FROM crawled c JOIN req_norm r ON r.request_id = c.site
WHERE c.error IS NULL AND r.include_assets"""}, ["css_links"], "SELECT * FROM css_links")}) l
  JOIN crawled c ON c.site = l.site AND c.page_ord = l.page_ord
  QUALIFY row_number() OVER (PARTITION BY l.site, l.url ORDER BY l.page_ord, l.kind_rank, l.p1, l.p2) = 1) w
LEFT JOIN (
  SELECT a.* FROM css_assets a LEFT JOIN fetch_log f ON f.kind = 'css' AND f.site = a.site AND f.url = a.css_url
  WHERE f.url IS NULL OR f.status BETWEEN 200 AND 299
  QUALIFY row_number() OVER (PARTITION BY a.css_url ORDER BY a.site, a.css_ord) = 1) a ON a.css_url = w.url
""")
cte("batch_css", ["css_fetches"], """
SELECT site, cast(row_number() OVER (PARTITION BY site ORDER BY page_ord, kind_rank, p1, p2) - 1 AS bigint) AS css_ord, css_url, css
FROM css_fetches WHERE css IS NOT NULL
""")
cte("batch_stats", ["crawled", "css_fetches", "fetch_log", "robots_status", "bfs_reqs"], f"""
SELECT r.request_id AS site, coalesce(m.pages, 0) AS pages_crawled, coalesce(m.total, 0) AS total_requests, coalesce(m.failed, 0) AS failed_requests,
       coalesce(m.duration, 0) AS crawl_duration_ms, coalesce(b.status, 'allowed') AS robots_status, b.warning AS robots_warning
FROM bfs_reqs r LEFT JOIN (
  SELECT m.site, count(*) FILTER (WHERE m.kind = 'page') AS pages, count(*) AS total, count(*) FILTER (WHERE m.failed) AS failed,
         cast(max(f.ended_ms) - min(f.started_ms) AS bigint) AS duration
  FROM (SELECT site, 'page' AS kind, error IS NOT NULL AS failed, store_site, store_url FROM crawled
        UNION ALL SELECT site, 'css', css IS NULL, store_site, css_url FROM css_fetches) m
  LEFT JOIN fetch_log f ON f.kind = m.kind AND f.site = m.store_site AND f.url = m.store_url
  GROUP BY m.site) m ON m.site = r.request_id
LEFT JOIN robots_status b ON b.origin = r.seed_origin
""")
query("batch_pages", ["crawled"], """
SELECT site, page_ord, url, final_url, cast(status AS bigint) AS status, error, cast(length(html) AS bigint) AS html_chars FROM crawled
""")
query("batch_css", ["batch_css"], "SELECT * FROM batch_css")
query("batch_stats", ["batch_stats"], "SELECT * FROM batch_stats")
_REC_R = _REC.replace("primary_stack =", "r.detector =")
_SCOPE = {"pages_themed": "SELECT site, page_ord, final_url AS url, html FROM crawled",
          "css_assets": "SELECT site, css_ord, css_url, css FROM batch_css", "sites": "SELECT request_id AS site FROM bfs_reqs"}
query("site_report", ["crawled", "batch_css", "bfs_reqs", "batch_stats"], "SELECT * FROM (" + scoped(
    _SCOPE, ["signals", "ranked", "color_tokens", "custom_properties", "grid"], f"""
SELECT s.site, b.pages_crawled, cast((SELECT count(*) FROM signals x WHERE x.site = s.site) AS integer) AS n_stack_signals,
  cast((SELECT count(*) FROM color_tokens x WHERE x.site = s.site) AS integer) AS n_colors,
  cast((SELECT count(*) FROM custom_properties x WHERE x.site = s.site) AS integer) AS n_custom_properties,
  g.grid_system, CASE {_REC_R} ELSE {sql_lit(P.RECOMMEND_DEFAULT)} END AS recommended_approach
FROM sites s JOIN batch_stats b ON b.site = s.site JOIN grid g ON g.site = s.site
LEFT JOIN (SELECT site, detector FROM ranked WHERE stack_rank = 1) r ON r.site = s.site
""") + ")")
