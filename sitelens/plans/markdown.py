"""The design document in Markdown (R10, R11), as column expressions over a report row.

The document is a fixed template whose ``{slots}`` are filled from the
nested report; list sections use ``transform`` + ``array_join`` with the
fixed empty-state texts.  ``doc_lines`` splits it into (site, line_no, line).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# FIXED VALUES — the document template and its empty-state texts.
# --------------------------------------------------------------------------
TEMPLATE = """# Design System Documentation

> **Source**: {source_url}
> **Extracted**: {generated_at}
> **Pages Analyzed**: {pages_crawled}
> **Crawl Duration**: {crawl_seconds}s

---

## 1. Tech Stack

| Technology | Category | Confidence | Evidence |
|------------|----------|------------|----------|
{stack_summary}

**Recommended Integration Approach**: {recommended}

---

## 2. Color Palette

### CSS Custom Properties ({n_colors} colors detected)

```css
:root {
{color_tokens}
}
```

### Color Usage Summary

| Usage | Count |
|-------|-------|
| Background | {n_background} |
| Foreground/Text | {n_foreground} |
| Primary | {n_primary} |
| Secondary | {n_secondary} |
| Accent | {n_accent} |
| Border | {n_border} |
| Other | {n_other} |

---

## 3. Typography

### Font Families

{font_families}

### Type Scale

| Element | Size |
|---------|------|
{type_scale}

### Body Text
- **Font Size**: {body_size}

---

## 4. Spacing & Layout

### Grid System
- **Type**: {grid_system}

### Breakpoints
{breakpoints}

### Container Widths
{container_widths}

---

## 5. Border Radius

| Token | Value |
|-------|-------|
{border_radii}

---

## 6. Shadows

| Token | Value |
|-------|-------|
{shadows}

---

## 7. All CSS Custom Properties

```css
:root {
{custom_props}
}
```

{custom_props_note}

---

## 8. Component Patterns

{component_patterns}

---

## 9. Accessibility

| Feature | Present | Details |
|---------|---------|---------|
{a11y_signals}

---

## 10. Risks & Considerations

{risks}

### Notes
{notes}
{user_notes}

---

## 11. Implementation Checklist

Use this checklist when integrating this design system:

### Token Setup
- [ ] Import color tokens into your styling system
- [ ] Configure typography (font families, scale)
- [ ] Set up spacing/layout tokens
- [ ] Configure border-radius values
- [ ] Add shadow definitions

### Component Migration
- [ ] Identify components to update
- [ ] Apply color tokens to backgrounds, text, borders
- [ ] Update typography styles
- [ ] Apply spacing tokens
- [ ] Update border-radius values
- [ ] Add shadow effects where appropriate

### Quality Checks
- [ ] Verify color contrast meets accessibility standards
- [ ] Test responsive breakpoints
- [ ] Validate component states (hover, focus, active)
- [ ] Check keyboard navigation
- [ ] Test across browsers

---

## 12. Quick Start Code

### CSS Variables Setup

```css
/* tokens.css */
:root {
{color_tokens}

  /* Typography */
{font_primary}
{font_size_body}

  /* Border Radius */
{radii_css}

  /* Shadows */
{shadows_css}
}
```

### Tailwind Config (if using Tailwind)

```javascript
// tailwind.config.js
module.exports = {
  theme: {
    extend: {
      colors: {
{tw_colors}
      },
      fontFamily: {
{tw_fonts}
      },
      borderRadius: {
{tw_radii}
      },
    },
  },
}
```

---

## Appendix: Source Information

- **URL Analyzed**: {source_url}
- **Pages Crawled**: {pages_crawled}
- **robots.txt Status**: {robots_status}
- **Extractor Version**: {version}

For complete data with confidence scores and source references, see `theme_report.json`.

---

*Generated by sitelens from publicly accessible HTML and CSS.*
"""

NO_STACK = "| No frameworks detected | - | - | - |"
NO_COLORS = "  /* No color tokens detected */"
NO_PROPS = "  /* No custom properties detected */"
NO_FONTS = "- No font families detected"
NO_HEADINGS = "| - | No heading styles detected |"
NO_RADII = "| - | No border-radius tokens detected |"
NO_SHADOWS = "| - | No shadow tokens detected |"
NO_COMPONENTS = "No component patterns detected."
NO_BREAKPOINTS = "- No breakpoints detected"
NO_CONTAINERS = "- No container widths detected"
NO_RISKS = "- No significant risks identified"
NO_NOTES = "- No additional notes"
NO_BODY_SIZE = "Not detected"
NO_HEADING_SIZE = "Not specified"
NO_STATES = "No state variants detected"
ADD_FONTS_CSS = "  /* Add font families */"
ADD_RADII_CSS = "  /* Add border-radius tokens */"
ADD_SHADOWS_CSS = "  /* Add shadow tokens */"
ADD_TW_COLORS = "        // Add extracted colors"
ADD_TW_FONTS = "        // Add font families"
ADD_TW_RADII = "        // Add border-radius values"
PROPS_SHOWN = 50
SHADOW_CHARS = 60
YES, NO = "✅ Yes", "❌ No"


def fill(template: str, slots: dict[str, Column]) -> Column:
    """``concat`` of the template's literal parts and the slot columns."""
    parts = re.split(r"\{([a-z_0-9]+)\}", template)
    cols = [F.lit(p) if i % 2 == 0 else slots[p] for i, p in enumerate(parts)]
    return F.concat(*[c for c in cols])


def _lines(arr: Column, fn, empty: str, sep: str = "\n") -> Column:
    return F.when(F.size(arr) > 0, F.array_join(F.transform(arr, fn), sep)).otherwise(F.lit(empty))


def js_fixed1_seconds(ms: Column) -> Column:
    """``(ms / 1000).toFixed(1)`` for integer ms >= 0, exact like JavaScript.

    Off a decimal tie it is integer rounding.  On a tie (``ms % 100 == 50``)
    JavaScript rounds the exact binary value of ``ms / 1000``; whether that
    value lies above or below the tie is told by scaling it to an integer (a
    power of two changes no digit) and comparing in decimals.
    """
    x = ms.cast("double") / 1000
    scale = F.pow(F.lit(2.0), F.lit(52) - F.floor(F.log2(x)))
    whole = lambda c: c.cast("decimal(20,0)")
    up = whole((x * scale).cast("bigint")) * 1000 >= whole(ms) * whole(scale.cast("bigint"))
    n = (F.when(ms % 100 == 50, F.floor(ms / 100) + F.when(up, 1).otherwise(0))
         .otherwise(F.floor((ms + 50) / 100))).cast("bigint")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def pct0(x: Column) -> Column:
    """``(x * 100).toFixed(0)``."""
    return F.round(x * 100, 0).cast("bigint").cast("string")


def design_doc(report: DataFrame) -> DataFrame:
    """The Markdown document per site.  Input: site, report (R7), notes_text."""
    r = F.col("report")
    meta, tokens, typo, layout = r["meta"], r["tokens"], r["typographySummary"], r["layout"]
    colors, radii, shadows, props = tokens["colors"], tokens["radii"], tokens["shadows"], tokens["customProperties"]
    fonts = typo["primaryFonts"]

    def usage(u: str) -> Column:
        return F.size(F.filter(colors, lambda c: c["usage"] == u)).cast("string")

    color_lines = _lines(colors, lambda c: F.concat(
        F.lit("  "), c["name"], F.lit(": "), c["value"], F.lit(";"),
        F.when(c["usage"] != "unknown", F.concat(F.lit(" /* "), c["usage"], F.lit(" */"))).otherwise(F.lit(""))),
        NO_COLORS)
    stack = _lines(r["stackSignals"], lambda s: F.concat(
        F.lit("| "), s["name"], F.lit(" | "), s["category"], F.lit(" | "), pct0(s["confidence"]), F.lit("% | "),
        F.array_join(F.slice(s["evidence"], 1, 2), ", "), F.lit(" |")), NO_STACK)
    font_list = _lines(fonts, lambda f, i: F.concat((i + 1).cast("string"), F.lit(". `"), f, F.lit("`")), NO_FONTS)
    type_scale = _lines(typo["headingScale"], lambda h: F.concat(
        F.lit("| "), h["tag"], F.lit(" | "), F.coalesce(F.nullif(h["size"], F.lit("")), F.lit(NO_HEADING_SIZE)),
        F.lit(" |")), NO_HEADINGS)
    radii_tbl = _lines(radii, lambda t: F.concat(F.lit("| `"), t["name"], F.lit("` | `"), t["value"], F.lit("` |")),
                       NO_RADII)
    shadow_tbl = _lines(shadows, lambda t: F.concat(
        F.lit("| `"), t["name"], F.lit("` | `"),
        F.when(F.length(t["value"]) > SHADOW_CHARS, F.concat(F.substring(t["value"], 1, SHADOW_CHARS), F.lit("...")))
        .otherwise(t["value"]), F.lit("` |")), NO_SHADOWS)
    prop_lines = _lines(F.slice(props, 1, PROPS_SHOWN), lambda p: F.concat(F.lit("  "), p["value"]), NO_PROPS)
    n_props = F.size(props)
    props_note = F.when(n_props > PROPS_SHOWN, F.concat(
        F.lit(f"\n*Showing first {PROPS_SHOWN} of "), n_props.cast("string"),
        F.lit(" properties. See theme_report.json for complete list.*\n"))).otherwise(F.lit(""))
    comp = _lines(r["componentPatterns"], lambda p: F.concat(
        F.lit("### "), F.upper(F.substring(p["name"], 1, 1)), F.substring(p["name"], 2, 1 << 30),
        F.lit("\n- **Type**: "), p["type"],
        F.lit("\n- **Classes**: `"), F.array_join(p["classes"], "`, `"), F.lit("`"),
        F.lit("\n- **States**: "),
        F.when(F.size(p["states"]) > 0, F.array_join(p["states"], ", ")).otherwise(F.lit(NO_STATES))),
        NO_COMPONENTS, "\n\n")
    a11y = F.array_join(F.transform(r["accessibilitySignals"], lambda s: F.concat(
        F.lit("| "), s["feature"], F.lit(" | "), F.when(s["present"], F.lit(YES)).otherwise(F.lit(NO)), F.lit(" | "),
        F.coalesce(F.nullif(s["details"], F.lit("")), F.lit("-")), F.lit(" |"))), "\n")
    bullets = lambda arr, empty: _lines(arr, lambda b: F.concat(F.lit("- `"), b, F.lit("`")), empty)
    risks = _lines(r["risks"], lambda x: F.concat(F.lit("- ⚠️ "), x), NO_RISKS)
    notes = _lines(r["notes"], lambda x: F.concat(F.lit("- "), x), NO_NOTES)
    user_notes = F.when(F.coalesce(F.col("notes_text"), F.lit("")) != "",
                        F.concat(F.lit("\n### User Context\n"), F.col("notes_text"), F.lit("\n"))).otherwise(F.lit(""))
    body_size = typo["bodySize"]
    key = lambda n: F.regexp_replace(F.regexp_replace(n, "^--", ""), "[^a-zA-Z0-9]", "-")
    slots = {
        "source_url": meta["sourceUrl"], "generated_at": meta["generatedAt"],
        "pages_crawled": meta["pagesCrawled"].cast("string"),
        "crawl_seconds": js_fixed1_seconds(meta["crawlDuration"]),
        "stack_summary": stack, "recommended": r["recommendedApproach"],
        "n_colors": F.size(colors).cast("string"), "color_tokens": color_lines,
        "n_background": usage("background"), "n_foreground": usage("foreground"), "n_primary": usage("primary"),
        "n_secondary": usage("secondary"), "n_accent": usage("accent"), "n_border": usage("border"),
        "n_other": usage("unknown"),
        "font_families": font_list, "type_scale": type_scale,
        "body_size": F.coalesce(F.nullif(body_size, F.lit("")), F.lit(NO_BODY_SIZE)),
        "grid_system": F.coalesce(F.nullif(layout["gridSystem"], F.lit("")), F.lit("Unknown")),
        "breakpoints": bullets(layout["breakpoints"], NO_BREAKPOINTS),
        "container_widths": bullets(layout["containerWidths"], NO_CONTAINERS),
        "border_radii": radii_tbl, "shadows": shadow_tbl, "custom_props": prop_lines,
        "custom_props_note": props_note, "component_patterns": comp, "a11y_signals": a11y,
        "risks": risks, "notes": notes, "user_notes": user_notes,
        "font_primary": F.when(F.size(fonts) > 0, F.concat(F.lit("  --font-primary: "), fonts[0], F.lit(";")))
        .otherwise(F.lit(ADD_FONTS_CSS)),
        "font_size_body": F.when(F.coalesce(body_size, F.lit("")) != "",
                                 F.concat(F.lit("  --font-size-body: "), body_size, F.lit(";"))).otherwise(F.lit("")),
        "radii_css": _lines(F.slice(radii, 1, 5), lambda t: F.concat(F.lit("  "), t["name"], F.lit(": "), t["value"],
                                                                    F.lit(";")), ADD_RADII_CSS),
        "shadows_css": _lines(F.slice(shadows, 1, 3), lambda t: F.concat(F.lit("  "), t["name"], F.lit(": "),
                                                                        t["value"], F.lit(";")), ADD_SHADOWS_CSS),
        "tw_colors": _lines(F.slice(colors, 1, 10), lambda c: F.concat(
            F.lit("        '"), key(c["name"]), F.lit("': '"), c["value"], F.lit("',")), ADD_TW_COLORS),
        "tw_fonts": F.when(F.size(fonts) > 0, F.concat(
            F.lit("        'primary': ["),
            F.array_join(F.transform(fonts, lambda f: F.concat(
                F.lit("'"), F.regexp_replace(F.split(f, ",")[0], r"^\s+|\s+$", ""), F.lit("'"))), ", "),
            F.lit("],"))).otherwise(F.lit(ADD_TW_FONTS)),
        "tw_radii": _lines(F.slice(radii, 1, 5), lambda t: F.concat(
            F.lit("        '"), key(t["name"]), F.lit("': '"), t["value"], F.lit("',")), ADD_TW_RADII),
        "robots_status": meta["robotsTxtStatus"], "version": meta["version"],
    }
    return report.select("site", fill(TEMPLATE, slots).alias("design_doc"))


def doc_lines(docs: DataFrame) -> DataFrame:
    """The document as (site, line_no, line)."""
    return docs.select("site", F.posexplode(F.split("design_doc", "\n")).alias("line_no", "line")).select(
        "site", F.col("line_no").cast("bigint"), "line")
