"""Detector, component and extraction patterns, weights and texts.

Every value in this module must equal the behaviour being reproduced, so the
tables are written out plainly, in their natural order.  Regexes are stored in
the dialect-neutral form shared by Java (Spark) and RE2 (the DuckDB oracle);
``java_rx`` / ``re2_rx`` add the case-insensitive flag and, for Java, turn the
ASCII word boundary into explicit look-arounds (Java 17's ``\\b`` is Unicode
aware, the original is ASCII).
"""

from __future__ import annotations

import re

# --------------------------------------------------------------------------
# FIXED VALUES — stack detectors: (detector, category, [(weight, evidence, regex)])
# All regexes are matched case-insensitively.
# --------------------------------------------------------------------------
STACK_DETECTORS = [
    ("Next.js", "framework", [
        (0.9, "__NEXT_DATA__ script", r"__NEXT_DATA__"),
        (0.8, "/_next/ assets", r"/_next/"),
        (0.7, "next/head import", r"next/head"),
        (0.6, "Next.js script attribute", r"data-nscript"),
    ]),
    ("React", "framework", [
        (0.9, "data-reactroot attribute", r"data-reactroot"),
        (0.8, "React DevTools", r"__REACT_DEVTOOLS"),
        (0.7, "React bundle", r"react(?:\.min)?\.js"),
        (0.6, "react-dom reference", r"react-dom"),
    ]),
    ("Vue.js", "framework", [
        (0.9, "Vue scoped style attribute", r"data-v-[a-f0-9]+"),
        (0.8, "__VUE__ global", r"__VUE__"),
        (0.7, "Vue bundle", r"vue(?:\.min)?\.js"),
    ]),
    ("Nuxt", "framework", [
        (0.9, "__NUXT__ data", r"__NUXT__"),
        (0.8, "/_nuxt/ assets", r"/_nuxt/"),
    ]),
    ("Svelte", "framework", [
        (0.8, "Svelte class pattern", r"svelte-[a-z0-9]+"),
        (0.9, "__svelte marker", r"__svelte"),
    ]),
    ("Tailwind CSS", "css-framework", [
        (0.9, "tailwindcss reference", r"tailwindcss"),
        (0.85, "Tailwind CSS variable", r"--tw-[a-z-]+"),
        (0.6, "Tailwind utility classes", r'\bclass="[^"]*(?:bg-|text-|flex|grid|p-|m-|w-|h-)[^"]*"'),
        (0.7, "Tailwind breakpoint prefix", r"\b(?:sm:|md:|lg:|xl:|2xl:)[a-z]"),
    ]),
    ("shadcn/ui", "ui-library", [
        (0.8, "@radix-ui import", r"@radix-ui"),
        (0.6, "cn() utility function", r"\bcn\s*\("),
        (0.7, "Radix state attribute", r"data-\[state="),
        (0.8, "CVA import", r"class-variance-authority"),
    ]),
    ("Bootstrap", "css-framework", [
        (0.9, "Bootstrap CSS", r"bootstrap(?:\.min)?\.css"),
        (0.7, "Bootstrap grid classes", r'\bclass="[^"]*(?:container|row|col-)[^"]*"'),
        (0.8, "Bootstrap button classes", r"\bbtn-(?:primary|secondary|success|danger)"),
    ]),
    ("Material UI", "ui-library", [
        (0.9, "@mui/ import", r"@mui/"),
        (0.8, "MUI component class", r"MuiButton|MuiCard|MuiTypography"),
        (0.5, "Emotion (MUI styling)", r"__emotion"),
    ]),
    ("Chakra UI", "ui-library", [
        (0.9, "@chakra-ui import", r"@chakra-ui"),
        (0.7, "Chakra class prefix", r"chakra-"),
    ]),
    ("Vite", "build-tool", [
        (0.8, "@vite reference", r"@vite"),
        (0.9, "Vite config", r"vite\.config"),
    ]),
    ("Webpack", "build-tool", [
        (0.8, "Webpack runtime", r"webpackJsonp"),
        (0.9, "Webpack require", r"__webpack_require__"),
    ]),
]

# --------------------------------------------------------------------------
# FIXED VALUES — component patterns, applied to external CSS only, case-insensitive.
# --------------------------------------------------------------------------
COMPONENT_PATTERNS = [
    ("button", [r"\.btn[^{]*\{", r"\.button[^{]*\{", r'\[class\*="btn"\]']),
    ("card", [r"\.card[^{]*\{", r"\.card-body", r"\.card-header"]),
    ("nav", [r"\.nav[^{]*\{", r"\.navbar[^{]*\{", r"\.navigation[^{]*\{"]),
    ("hero", [r"\.hero[^{]*\{", r"\.hero-section", r"\.banner[^{]*\{"]),
    ("form", [r"\.form[^{]*\{", r"\.form-group", r"\.form-control"]),
    ("input", [r"\.input[^{]*\{", r"input\[type", r"\.text-field"]),
    ("modal", [r"\.modal[^{]*\{", r"\.dialog[^{]*\{", r'\[role="dialog"\]']),
]
COMPONENT_STATES = ["hover", "focus", "active"]

# --------------------------------------------------------------------------
# FIXED VALUES — extraction regexes (case-sensitive unless marked (?i)).
# --------------------------------------------------------------------------
CUSTOM_PROPERTY = r"--([a-zA-Z0-9_-]+)\s*:\s*([^;}\n]+)"
COLOR = r"(?i)#([a-fA-F0-9]{3,8})\b|rgba?\s*\([^)]+\)|hsla?\s*\([^)]+\)"
FONT_FAMILY = r"(?i)font-family\s*:\s*([^;}\n]+)"
BORDER_RADIUS = r"(?i)border-radius\s*:\s*([^;}\n]+)"
BOX_SHADOW = r"(?i)box-shadow\s*:\s*([^;}\n]+)"
STYLE_BLOCK = r"(?i)<style[^>]*>([\s\S]*?)</style>"
STYLE_TAG = r"(?i)</?style[^>]*>"
HEADING_RULE = r"(?i)\b(h[1-6])\s*\{([^}]+)\}"
BODY_RULE = r"(?i)\bbody\s*\{([^}]+)\}"
RULE_FONT_SIZE = r"(?i)font-size\s*:\s*([^;]+)"
RULE_FONT_WEIGHT = r"(?i)font-weight\s*:\s*([^;]+)"
RULE_LINE_HEIGHT = r"(?i)line-height\s*:\s*([^;]+)"
RULE_FONT_FAMILY = r"(?i)font-family\s*:\s*([^;]+)"
SKIP_LINK = r"(?i)skip[- ]?(?:to[- ]?)?(?:main|content|navigation)"
FOCUS_VISIBLE = r"(?i):focus-visible"
FOCUS_OUTLINE = r"(?i):focus[^}]*outline"
ARIA_ATTR = r"(?i)aria-[a-z]+="
IMG_TAG = r"(?i)<img[^>]*>"
ALT_ATTR = r"(?i)alt="
LANDMARKS = [r"(?i)<nav[\s>]", r"(?i)<main[\s>]", r"(?i)<header[\s>]", r"(?i)<footer[\s>]"]
CONTAINER_WIDTH = r"(?i)\.container[^{]*\{[^}]*max-width\s*:\s*([^;]+)"
MEDIA_WIDTH = r"(?i)@media[^{]*\(\s*(?:min|max)-width\s*:\s*([^)]+)\)"
GRID_DISPLAY = r"(?i)display\s*:\s*grid"
FLEX_DISPLAY = r"(?i)display\s*:\s*flex"
BOOTSTRAP_COLUMNS = r"(?i)\.col-(?:xs|sm|md|lg|xl)-\d+"
LINK_STYLESHEET = r"""(?i)<link[^>]+rel=["']stylesheet["'][^>]*>"""
LINK_TEXT_CSS = r"""(?i)<link[^>]+type=["']text/css["'][^>]*>"""
HREF_IN_TAG = r"""(?i)href=["']([^"']+)["']"""
CSS_IMPORT = r"""(?i)@import\s+(?:url\()?["']?([^"')]+)["']?\)?"""
SCRIPT_SRC = r"""(?i)<script[^>]+src=["']([^"']+)["'][^>]*>"""
ANCHOR_HREF = r"""(?i)<a[^>]+href=["']([^"'#][^"']*)["'][^>]*>"""
SKIPPED_SCHEMES = r"(?i)^(mailto:|tel:|javascript:|data:|#)"

# --------------------------------------------------------------------------
# FIXED VALUES — confidences.
# --------------------------------------------------------------------------
CONF_CUSTOM_PROPERTY = 0.9
CONF_COLOR = 0.85
CONF_FONT = 0.8
CONF_FROM_PROPERTY = 0.85
CONF_DIRECT = 0.7
CONF_RULE = 0.8
CONF_FONT_FAMILY_SCALE = 0.75
CONF_COMPONENT = 0.7
CONF_CONTAINER = 0.8
CONF_BREAKPOINT = 0.85

# --------------------------------------------------------------------------
# FIXED VALUES — colour usage by property name, tested in this order.
# --------------------------------------------------------------------------
COLOR_USAGE = [
    ("background", r"background|bg"),
    ("foreground", r"foreground|fg|text"),
    ("primary", r"primary"),
    ("secondary", r"secondary"),
    ("accent", r"accent"),
    ("border", r"border"),
]
COLOR_USAGE_ORDER = ["background", "foreground", "primary", "secondary", "accent", "border", "unknown"]

# --------------------------------------------------------------------------
# FIXED VALUES — accessibility feature names and texts.
# --------------------------------------------------------------------------
A11Y_FEATURES = ["Skip Links", "Focus Visible Styling", "ARIA Attributes", "Image Alt Text", "Semantic HTML"]
A11Y_SNIPPETS = [
    "skip-to-content pattern",
    ":focus-visible or :focus outline",
    None,  # "<n> aria-* attributes"
    "img alt attribute coverage",
    "semantic HTML elements",
]
SKIP_LINK_DETAIL = "Skip navigation link detected"
FOCUS_VISIBLE_DETAIL = "Uses :focus-visible pseudo-class"
FOCUS_OUTLINE_DETAIL = "Custom focus outline styling"

# --------------------------------------------------------------------------
# FIXED VALUES — layout, risks, notes, recommendations.
# --------------------------------------------------------------------------
GRID_EVIDENCE = ["CSS Grid (display: grid)", "Flexbox (display: flex)", "Bootstrap grid classes"]
RISK_MANY_COLORS = "Large color palette detected (50+ colors) - may indicate inconsistent design tokens"
RISK_TWO_FRAMEWORKS = "Multiple CSS frameworks detected (Bootstrap + Tailwind) - may cause style conflicts"
RISK_ROBOTS = "robots.txt blocks crawling - results may be incomplete"
NOTE_NO_EXTERNAL_CSS = "No external CSS files were fetched - tokens extracted from inline styles only"

RECOMMEND_DEFAULT = "Standard CSS integration with design token centralization."
RECOMMENDATIONS = [
    ("Tailwind CSS", "Extend Tailwind configuration with extracted tokens. Create custom utilities for component "
                     "variants. Use @apply for reusable patterns."),
    ("shadcn/ui", "Update CSS variables in globals.css. Extend component variants using CVA. Add custom primitives "
                  "following shadcn/ui patterns."),
    ("Bootstrap", "Override Bootstrap Sass variables. Create custom utility classes for design system extensions."),
    ("Next.js", "Centralize tokens in CSS variables or theme configuration. Create reusable component primitives. "
                "Use CSS Modules or styled-components for scoped styling."),
    ("React", "Centralize tokens in CSS variables or theme configuration. Create reusable component primitives. "
              "Use CSS Modules or styled-components for scoped styling."),
]

# --------------------------------------------------------------------------
# FIXED VALUES — request validation and defaults.
# --------------------------------------------------------------------------
REPORT_VERSION = "1.0.0"
DEFAULT_MAX_PAGES = 6
DEFAULT_SAME_ORIGIN_ONLY = True
DEFAULT_INCLUDE_ASSETS = False
DEFAULT_MODE = "both"
DEFAULT_NOTES = ""
MODES = ["extract", "prompt", "both"]
MAX_PAGES_RANGE = (1, 20)
ERR_URL_REQUIRED = "themeUrl is required"
ERR_URL_SCHEME = "themeUrl must use http or https protocol"
ERR_URL_INVALID = "themeUrl must be a valid URL"
ERR_MAX_PAGES = "maxPages must be a number between 1 and 20"
ERR_MODE = 'mode must be "extract", "prompt", or "both"'
FETCH_RETRIES = 3


# --------------------------------------------------------------------------
# Derived tables and dialect helpers.
# --------------------------------------------------------------------------
def stack_patterns() -> list[tuple[int, int, str, str, float, str, str]]:
    """Flattened detector table: (detector_idx, pattern_idx, detector, category, weight, evidence, regex)."""
    rows = []
    for d_idx, (name, category, pats) in enumerate(STACK_DETECTORS):
        for p_idx, (weight, evidence, rx) in enumerate(pats):
            rows.append((d_idx, p_idx, name, category, weight, evidence, rx))
    return rows


def component_patterns() -> list[tuple[int, int, str, str]]:
    """Flattened component table: (type_idx, pattern_idx, type, regex)."""
    return [(t_idx, p_idx, ctype, rx)
            for t_idx, (ctype, pats) in enumerate(COMPONENT_PATTERNS)
            for p_idx, rx in enumerate(pats)]


_WORD = "A-Za-z0-9_"


def java_rx(rx: str, ignore_case: bool = False) -> str:
    """Java form: ASCII word boundaries as look-arounds, optional (?i)."""
    out = re.sub(r"\\b(?=$|\|)", f"(?![{_WORD}])", rx)
    out = out.replace(r"\b", f"(?<![{_WORD}])")
    if ignore_case and not out.startswith("(?i)"):
        out = "(?i)" + out
    return out


def re2_rx(rx: str, ignore_case: bool = False) -> str:
    """RE2 form (DuckDB): RE2's \\b is already ASCII."""
    if ignore_case and not rx.startswith("(?i)"):
        return "(?i)" + rx
    return rx


def sql_lit(s: str) -> str:
    """Quote a string for a DuckDB/ANSI SQL literal (backslashes are literal)."""
    return "'" + s.replace("'", "''") + "'"
