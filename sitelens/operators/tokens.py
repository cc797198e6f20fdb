"""Design-token extraction (T1-T11) over the CSS corpus.

Each extractor turns corpus blocks into match rows (narrow, no shuffle), then
de-duplicates first-seen per site with a partial aggregate (see
``corpus.first_seen``).  Outputs are long tables that keep the order key, so
report assembly can rebuild the reference's list order without a window over
a whole site.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.text import find_all, first_group, js_trim, snippet
from sitelens.operators.corpus import ORD, first_seen, last_seen, matches

TOKEN_ORD = [*ORD, "kind_rank", "pos"]


def declarations(corpus: DataFrame) -> DataFrame:
    """All ``--name: value`` matches of each block, in order (shared by T1, T2, T6, T7).

    Output: site, src_rank, src_ord, block_ord, pos, source_url, name, value, m.
    """
    return (matches(corpus, "css", P.CUSTOM_PROPERTY, groups=(1, 2), keep=[*ORD, "source_url"])
            .select("site", *ORD, "pos", "source_url", F.col("g1").alias("name"),
                    js_trim(F.col("g2")).alias("value"), "m"))


def custom_properties(decls: DataFrame) -> DataFrame:
    """Distinct ``--name: value`` texts per site, first seen; conf .9; snippet 100."""
    rows = decls.select("site", *ORD, "pos", "source_url",
                        F.concat(F.lit("--"), "name", F.lit(": "), "value").alias("property"),
                        snippet(F.col("m"), 100).alias("snippet"))
    out = first_seen(rows, ["site", "property"], [*ORD, "pos"], ["source_url", "snippet"])
    return out.withColumn("confidence", F.lit(P.CONF_CUSTOM_PROPERTY))


def _usage(name):
    lower = F.lower(name)
    expr = F.lit("unknown")
    for usage, pattern in reversed(P.COLOR_USAGE):
        expr = F.when(lower.rlike("(?i)" + pattern), F.lit(usage)).otherwise(expr)
    return expr


def _format(value):
    return (F.when(value.startswith("#"), "hex").when(value.startswith("rgba"), "rgba")
            .when(value.startswith("rgb"), "rgb").when(value.startswith("hsla"), "hsla")
            .when(value.startswith("hsl"), "hsl").otherwise("named"))


def color_tokens(decls: DataFrame) -> DataFrame:
    """T2 (+T3 format, T4 usage): first colour literal of each custom property value.

    Each declaration is tested on its own (the original's shared regex state
    skips a colour that follows another; see README).  Distinct by colour text
    per site, first seen.  Output: site, value, name, format, usage, source_url,
    snippet, confidence, order key.
    """
    color = F.regexp_extract(F.col("value"), P.java_rx(P.COLOR), 0)
    rows = (decls.withColumn("color", color).where(F.col("color") != "")
            .select("site", *ORD, "pos", "source_url", F.col("color").alias("value"),
                    F.concat(F.lit("--"), "name").alias("name"), _usage(F.col("name")).alias("usage"),
                    snippet(F.col("m"), 80).alias("snippet")))
    out = first_seen(rows, ["site", "value"], [*ORD, "pos"], ["source_url", "name", "usage", "snippet"])
    return out.withColumn("format", _format(F.col("value"))).withColumn("confidence", F.lit(P.CONF_COLOR))


def font_tokens(corpus: DataFrame, confidence: float = P.CONF_FONT) -> DataFrame:
    """T5: distinct ``font-family`` values per site, first seen; snippet 80."""
    rows = (matches(corpus, "css", P.FONT_FAMILY, groups=(1,), keep=[*ORD, "source_url"])
            .select("site", *ORD, "pos", "source_url", js_trim(F.col("g1")).alias("font_family"),
                    snippet(F.col("m"), 80).alias("snippet")))
    out = first_seen(rows, ["site", "font_family"], [*ORD, "pos"], ["source_url", "snippet"])
    return out.withColumn("confidence", F.lit(confidence))


def font_families(corpus: DataFrame) -> DataFrame:
    """Distinct ``font-family`` values over the whole corpus; conf .75 (source = start URL)."""
    return font_tokens(corpus, P.CONF_FONT_FAMILY_SCALE)


#: Kinds of tokens, in the order of the long table.
KINDS = ("custom_property", "color", "font", "radius", "shadow")
_DIRECT = {"radius": (P.BORDER_RADIUS, "border-radius"), "shadow": (P.BOX_SHADOW, "box-shadow")}


def _bound(value, build):
    """``build`` over ``value``, computed once (an expression used twice in a lambda would be computed twice)."""
    return F.transform(F.array(value), build)[0]


def _hit(kind, kind_rank, pos, name, value, usage, m, width, confidence):
    return F.struct(F.lit(kind).alias("kind"), F.lit(kind_rank).cast("bigint").alias("kind_rank"), pos.cast("bigint").alias("pos"), name.alias("name"),
                    value.alias("value"), usage.alias("usage"), snippet(m, width).alias("snippet"), F.lit(confidence).alias("confidence"))


def _from_properties(decls, kind):
    """T6/T7 (a): custom properties whose name holds ``kind``, the first of each name in the block."""
    named = F.filter(decls, lambda d: d["name"].rlike("(?i)" + kind))
    by_name = F.array_sort(F.transform(named, lambda d: F.struct(d["name"].alias("name"), d["pos"].alias("pos"), d["value"].alias("value"), d["m"].alias("m"))))
    return _bound(by_name, lambda ds: F.filter(ds, lambda d, i: (i == 0) | (F.get(ds, i - 1)["name"] != d["name"])))


def _direct(matches_of, own_names, kind):
    """T6/T7 (b): direct declarations, not starting ``var(`` (nor ``none`` for shadows), whose value is no name of (a) in the block."""
    def keep(d):
        ok = ~d["value"].startswith("var(") & ~(d["value"].startswith("--") & F.array_contains(own_names, d["value"]))
        return ok & (d["value"] != "none") if kind == "shadow" else ok

    return F.filter(matches_of, keep)


def tagged_matches(corpus: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """Every match of the wanted kinds in every block, as rows, from one projection and one generator.

    A block's matches, and the names of its own custom properties that (b) of T6/T7 looks at, are arrays beside each
    other, so nothing is joined.  Output: site, src_rank, src_ord, block_ord, source_url, kind, kind_rank, pos, name,
    value, usage (colours), snippet, confidence.
    """
    css = F.col("css")

    def parsed(pattern, build):
        return F.transform(find_all(css, pattern), lambda m, i: build(m, i.cast("bigint")))

    decl = lambda m, i: F.struct(i.alias("pos"), m.alias("m"), F.regexp_extract(m, P.java_rx(P.CUSTOM_PROPERTY), 1).alias("name"),
                                 js_trim(F.regexp_extract(m, P.java_rx(P.CUSTOM_PROPERTY), 2)).alias("value"))
    plain = lambda rx_: lambda m, i: F.struct(i.alias("pos"), m.alias("m"), js_trim(F.regexp_extract(m, P.java_rx(rx_), 1)).alias("value"))
    first = {"_decls": parsed(P.CUSTOM_PROPERTY, decl)} if set(kinds) - {"font"} else {}
    if "font" in kinds:
        first["_fonts"] = parsed(P.FONT_FAMILY, plain(P.FONT_FAMILY))
    for kind in set(kinds) & set(_DIRECT):
        first[f"_{kind}"] = parsed(_DIRECT[kind][0], plain(_DIRECT[kind][0]))
    blocks = corpus.select("site", *ORD, "source_url", *[c.alias(n) for n, c in first.items()])
    own = {f"_own_{k}": _from_properties(F.col("_decls"), k) for k in kinds if k in _DIRECT}
    if own:
        blocks = blocks.select("*", *[c.alias(n) for n, c in own.items()])
    dashed = lambda d: F.concat(F.lit("--"), d["name"])
    none = F.lit(None).cast("string")

    def hits(kind):
        if kind == "custom_property":
            return [F.transform("_decls", lambda d: _hit(kind, 0, d["pos"], F.regexp_extract(F.concat(dashed(d), F.lit(": "), d["value"]), "^(--[^:]*):", 1),
                                                         F.concat(dashed(d), F.lit(": "), d["value"]), none, d["m"], 100, P.CONF_CUSTOM_PROPERTY))]
        if kind == "color":
            found = F.transform("_decls", lambda d: _hit(kind, 0, d["pos"], dashed(d), F.regexp_extract(d["value"], P.java_rx(P.COLOR), 0), _usage(d["name"]), d["m"], 80, P.CONF_COLOR))
            return [F.filter(found, lambda h: h["value"] != "")]
        if kind == "font":
            return [F.transform("_fonts", lambda d: _hit(kind, 0, d["pos"], F.lit("font-family"), d["value"], none, d["m"], 80, P.CONF_FONT))]
        names = F.transform(f"_own_{kind}", dashed)
        direct = _bound(names, lambda ns: _direct(F.col(f"_{kind}"), ns, kind))
        return [F.transform(f"_own_{kind}", lambda d: _hit(kind, 0, d["pos"], dashed(d), d["value"], none, d["m"], 80, P.CONF_FROM_PROPERTY)),
                F.transform(direct, lambda d: _hit(kind, 1, d["pos"], F.lit(_DIRECT[kind][1]), d["value"], none, d["m"], 80, P.CONF_DIRECT))]

    return blocks.select("site", *ORD, "source_url", F.inline(F.concat(*[h for k in kinds for h in hits(k)])))


def tokens(corpus: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The wanted kinds of tokens: the first match per site, kind and value, by block, kind_rank and position, in one aggregate.

    Output: site, kind, value, src_rank, src_ord, block_ord, kind_rank, pos, source_url, name, usage, snippet, confidence.
    """
    return first_seen(tagged_matches(corpus, kinds), ["site", "kind", "value"], TOKEN_ORD, ["source_url", "name", "usage", "snippet", "confidence"])


def of_kind(found: DataFrame, kind: str) -> DataFrame:
    """One kind of ``tokens`` with that kind's own columns."""
    rows = found.where(F.col("kind") == kind)
    if kind in _DIRECT:
        return rows.select("site", "value", *TOKEN_ORD, "source_url", "name", "snippet", "confidence")
    if kind == "color":
        return rows.select("site", "value", *ORD, "pos", "source_url", "name", "usage", "snippet", _format(F.col("value")).alias("format"), "confidence")
    value = {"custom_property": "property", "font": "font_family"}[kind]
    return rows.select("site", F.col("value").alias(value), *ORD, "pos", "source_url", "snippet", "confidence")


def radius_tokens(corpus: DataFrame) -> DataFrame:
    """Radius tokens (custom properties named *radius*, direct ``border-radius``)."""
    return of_kind(tokens(corpus, ("radius",)), "radius")


def shadow_tokens(corpus: DataFrame) -> DataFrame:
    """Shadow tokens (custom properties named *shadow*, direct ``box-shadow`` except ``none``)."""
    return of_kind(tokens(corpus, ("shadow",)), "shadow")


def _rule_props(styles, props):
    return [first_group(styles, rx_).alias(name) for name, rx_ in props]


def heading_scale(corpus: DataFrame) -> DataFrame:
    """Every ``hN { … }`` rule in order, not de-duplicated; conf .8; snippet 100."""
    rows = matches(corpus, "css", P.HEADING_RULE, groups=(1, 2))
    styles = F.col("g2")
    return rows.select(
        "site", *ORD, "pos", F.lower("g1").alias("tag"),
        *_rule_props(styles, [("font_size", P.RULE_FONT_SIZE), ("font_weight", P.RULE_FONT_WEIGHT),
                              ("line_height", P.RULE_LINE_HEIGHT), ("font_family", P.RULE_FONT_FAMILY)]),
        snippet(F.col("m"), 100).alias("snippet"), F.lit(P.CONF_RULE).alias("confidence"))


def body_text(corpus: DataFrame) -> DataFrame:
    """The last ``body { … }`` rule of the site wins as a whole."""
    rows = matches(corpus, "css", P.BODY_RULE, groups=(1,))
    styles = F.col("g1")
    rows = rows.select("site", *ORD, "pos",
                       *_rule_props(styles, [("font_size", P.RULE_FONT_SIZE), ("line_height", P.RULE_LINE_HEIGHT),
                                             ("font_family", P.RULE_FONT_FAMILY)]),
                       snippet(F.col("m"), 100).alias("snippet"))
    out = last_seen(rows, ["site"], [*ORD, "pos"], ["font_size", "line_height", "font_family", "snippet"])
    return out.withColumn("confidence", F.lit(P.CONF_RULE))


def all_tokens(corpus: DataFrame) -> DataFrame:
    """One long table of all token kinds: site, kind, name, value, source_url, order key."""
    return tokens(corpus).select("site", "kind", "name", "value", "source_url", *ORD, "pos")
