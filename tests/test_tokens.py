"""Hand goldens for the extraction rules (micro CSS inputs)."""

from pyspark.sql import functions as F

from helpers import analysis, css_of, inline, pages_of, rows
from sitelens.operators.corpus import ORD

TOK = [*ORD, "pos"]


def test_custom_properties_and_colours(spark):
    a = analysis(spark, inline(spark, ":root{--bg:#fff;--fg:#000}"))
    assert rows(a.properties, "property", order=TOK) == [("--bg: #fff",), ("--fg: #000",)]
    # each declaration is tested on its own (the original's shared regex state would skip #000)
    assert rows(a.colors, "value", "format", "usage", order=TOK) == [("#fff", "hex", "background"),
                                                                    ("#000", "hex", "foreground")]


def test_colour_inside_shadow_property(spark):
    a = analysis(spark, inline(spark, "--shadow: 0 0 1px rgba(0,0,0,.5);"))
    assert rows(a.colors, "value", "format", "usage") == [("rgba(0,0,0,.5)", "rgba", "unknown")]
    assert rows(a.shadows, "name", "value") == [("--shadow", "0 0 1px rgba(0,0,0,.5)")]


def test_upper_case_function_is_named(spark):
    a = analysis(spark, inline(spark, "--overlay: RGBA(0,0,0,.5);"))
    assert rows(a.colors, "value", "format") == [("RGBA(0,0,0,.5)", "named")]


def test_radius_first_per_name_then_value(spark):
    a = analysis(spark, inline(spark, "--radius:8px;--radius:4px;border-radius:4px"))
    got = rows(a.radii, "name", "value", "confidence", order=[*ORD, "kind_rank", "pos"])
    assert got == [("--radius", "8px", 0.85), ("border-radius", "4px", 0.7)]
    a = analysis(spark, inline(spark, "--radius:8px;border-radius:8px"))
    assert rows(a.radii, "name", "value") == [("--radius", "8px")]


def test_shadow_skips_none_and_var(spark):
    a = analysis(spark, inline(spark, "box-shadow:none;box-shadow:var(--s);box-shadow:0 0 1px red"))
    assert rows(a.shadows, "name", "value") == [("box-shadow", "0 0 1px red")]


def test_bem_selector_reads_as_property(spark):
    a = analysis(spark, inline(spark, ".btn--primary:hover{color:red}"))
    assert rows(a.properties, "property") == [("--primary: hover{color:red",)]


def test_last_body_rule_wins_whole(spark):
    a = analysis(spark, inline(spark, "body{font-size:16px;line-height:1.5} .card-body{font-size:14px}"))
    assert rows(a.body, "font_size", "line_height") == [("14px", None)]


def test_grouped_heading_selector(spark):
    a = analysis(spark, inline(spark, "h1, h2 { font-size: 2rem }"))
    assert rows(a.headings, "tag", "font_size") == [("h2", "2rem")]


def test_breakpoint_takes_last_condition(spark):
    pages = pages_of(spark, "<html></html>")
    a = analysis(spark, pages, css_of(spark, "@media (min-width: 640px) and (max-width: 1024px) {"))
    assert rows(a.breakpoints, "value") == [("1024px",)]


def test_component_states(spark):
    pages = pages_of(spark, "<html></html>")
    a = analysis(spark, pages, css_of(spark, ".btn{} .btn:hover{}"))
    assert rows(a.component_classes, "type", "class_pattern", order=["type_idx", "class_rank"]) == [
        ("button", ".btn"), ("button", ".btn:hover")]
    assert rows(a.component_states.where("type = 'button'"), "has_hover", "has_focus", "has_active") == [
        (True, False, False)]


def test_first_seen_across_blocks_and_sheets(spark):
    pages = pages_of(spark, "<style>:root{--a:#111}</style><style>:root{--b:#111;--c:#222}</style>",
                     "<style>:root{--d:#222;--e:#333}</style>")
    a = analysis(spark, pages, css_of(spark, ":root{--f:#333;--g:#444}"))
    got = rows(a.colors, "value", "name", order=TOK)
    assert got == [("#111", "--a"), ("#222", "--c"), ("#333", "--e"), ("#444", "--g")]


def test_tokens_unchanged_by_partitioning_and_other_sites(spark):
    css = ":root{--bg:#fff;--fg:#000;--radius:4px} body{font-family: A, B}"
    one = analysis(spark, inline(spark, css))
    other = inline(spark, ":root{--bg:#fff;--x:#123}", site="https://other.test")
    both = analysis(spark, inline(spark, css).unionByName(other).repartition(7))
    for attr in ("colors", "radii", "fonts", "properties"):
        left = sorted(map(tuple, getattr(one, attr).collect()))
        right = sorted(map(tuple, getattr(both, attr).where(F.col("site") == "https://s.test").collect()))
        assert left == right, attr
