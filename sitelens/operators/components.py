"""Component patterns (K5) and their interaction states (K6), over external CSS only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.text import js_trim, rx
from sitelens.operators.corpus import first_seen

SALTS = 16  # a site's selector pieces meet its base classes in so many groups
MAX_CLASSES = 5  # the report keeps the first five distinct class patterns per component

_STATE_PIECE = r"(?i)[^{]*:(?:hover|focus|active)"


def component_matches(css: DataFrame) -> DataFrame:
    """All matches of the 21 component patterns, in one pass over each style sheet.

    Input: site, css_ord, css.  Output: site, type_idx, type, pattern_idx, css_ord, pos, class_pattern.
    """
    arr = F.array(*[F.struct(F.lit(t).cast("bigint").alias("type_idx"), F.lit(ctype).alias("type"),
                             F.lit(p).cast("bigint").alias("pattern_idx"),
                             F.regexp_extract_all("css", rx(pattern, True), F.lit(0)).alias("ms"))
                    for t, p, ctype, pattern in P.component_patterns()])
    per_pattern = css.select("site", "css_ord", F.inline(arr))
    out = per_pattern.select("site", "type_idx", "type", "pattern_idx", "css_ord",
                             F.posexplode("ms").alias("pos", "m"))
    return out.select("site", "type_idx", "type", "pattern_idx", "css_ord", F.col("pos").cast("bigint"),
                      js_trim(F.regexp_replace("m", r"\{$", "")).alias("class_pattern"))


def component_classes(matches: DataFrame) -> DataFrame:
    """K5: the first five distinct class patterns per (site, component), in first-seen order.

    Distinct first (partial aggregate), then a ranked window limited to five,
    which Spark plans as a partial group limit ahead of the shuffle.
    """
    order = ["pattern_idx", "css_ord", "pos"]
    distinct = first_seen(matches, ["site", "type_idx", "type", "class_pattern"], order, [])
    w = Window.partitionBy("site", "type_idx").orderBy(*order)
    ranked = distinct.withColumn("class_rank", F.row_number().over(w).cast("bigint"))
    return ranked.where(F.col("class_rank") <= MAX_CLASSES).select(
        "site", "type_idx", "type", "class_rank", "class_pattern")


def component_samples(matches: DataFrame) -> DataFrame:
    """First match per (site, component) and its base class (leading dot dropped, cut at a non-name char)."""
    first = first_seen(matches, ["site", "type_idx", "type"], ["pattern_idx", "css_ord", "pos"], ["class_pattern"])
    base = F.regexp_extract(F.regexp_replace("class_pattern", r"^\.", ""), r"^([a-zA-Z0-9_-]*)", 1)
    return first.select("site", "type_idx", "type", F.col("class_pattern").alias("sample_snippet"),
                        base.alias("base_class"))


def state_pieces(css: DataFrame) -> DataFrame:
    """Selector text that can carry a state: each ``{``-free run up to its last ``:hover/:focus/:active``.

    A match of ``\\.base[^{]*:state`` never crosses ``{``, so it lies inside
    one such piece; testing the pieces equals testing the whole sheet while
    carrying only selector text (not the CSS) into the join.
    """
    pieces = css.select("site", F.explode(F.regexp_extract_all("css", F.lit(_STATE_PIECE), F.lit(0))).alias("piece"))
    return pieces.distinct()


def component_states(samples: DataFrame, pieces: DataFrame) -> DataFrame:
    """K6: hover / focus / active per (site, component), from the base class.

    A piece holds no ``{``, so the class followed by a state anywhere later in
    it is found by plain substring search.  The pieces are salted and the at
    most seven base classes of a site repeated per salt: the join spreads a hot
    site over ``SALTS`` tasks, and the flags are OR-ed by a partial aggregate
    with an exchange of its own.
    """
    keys = ["site", "type_idx"]
    salted = pieces.select("site", F.lower("piece").alias("piece"), F.pmod(F.xxhash64("piece"), F.lit(SALTS)).cast("int").alias("salt"))
    wanted = samples.select(*keys, F.concat(F.lit("."), F.lower("base_class")).alias("dotted"),
                            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    at = F.position(F.col("dotted"), F.col("piece"))
    after = at + F.length("dotted")
    flags = [F.bool_or((at > 0) & (F.position(F.lit(f":{state}"), F.col("piece"), after) > 0)).alias(f"has_{state}") for state in P.COMPONENT_STATES]
    hit = salted.join(wanted, ["site", "salt"]).groupBy(*keys).agg(*flags)
    out = samples.join(hit, keys, "left")
    return out.select("site", "type_idx", "type", "sample_snippet", "base_class",
                      *[F.coalesce(F.col(f"has_{s}"), F.lit(False)).alias(f"has_{s}") for s in P.COMPONENT_STATES])
