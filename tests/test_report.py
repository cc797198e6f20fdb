"""Markdown number formats and first-seen properties."""

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from helpers import inline, analysis, rows
from sitelens.operators.corpus import ORD, first_seen
from sitelens.plans.markdown import js_fixed1_seconds


def js_to_fixed1(ms: int) -> str:
    """Reference semantics: round the exact binary value of ms/1000, ties up."""
    return str(Decimal(ms / 1000).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))


def test_to_fixed_matches_exact_rounding(spark):
    cases = [0, 230, 150, 250, 350, 450, 1050, 12500, 106050, 99950, 123456789]
    df = spark.createDataFrame([(c,) for c in cases], "ms bigint")
    got = [r[0] for r in df.select(js_fixed1_seconds(F.col("ms"))).collect()]
    assert got == [js_to_fixed1(c) for c in cases]
    assert got[2] == "0.1" and got[4] == "0.3" and got[5] == "0.5"


def test_first_seen_is_idempotent(spark):
    a = analysis(spark, inline(spark, ":root{--a:1;--b:2;--a:3;--c:1}"))
    once = first_seen(a.decls, ["site", "value"], [*ORD, "pos"], ["name"])
    twice = first_seen(once, ["site", "value"], [*ORD, "pos"], ["name"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    assert rows(once, "value", "name", order=[*ORD, "pos"]) == [("1", "a"), ("2", "b"), ("3", "a")]
