"""Plans: what is read once is read once."""

import re

import pytest

from conftest import SF001
from sitelens.plans.catalog import Inputs, queries


def scans(df, column):
    """Leaf scans of the plan that read a column of that name."""
    df.collect()
    text = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    final = text.split("== Initial Plan ==")[0]
    return len(re.findall(rf"FileScan parquet \[[^\]]*\b{column}#", final))


@pytest.mark.parametrize("name,html,css", [("all_tokens", 1, 1), ("radius_tokens", 1, 1), ("shadow_tokens", 1, 1), ("page_links", 1, 0), ("link_counts", 1, 0), ("src_pages", 1, 0)])
def test_one_scan_of_the_texts(spark, name, html, css):
    i = Inputs(spark, SF001)
    i.pages_themed, i.css_assets  # noqa: B018  (derived inputs are written before)
    df = queries()[name](spark, SF001)
    assert (scans(df, "html"), scans(df, "css")) == (html, css)


def test_tokens_of_a_block_in_one_pass(spark):
    from helpers import css_of, inline, rows

    from sitelens.operators import corpus as C
    from sitelens.operators import tokens as T

    css = ("--radius-a: 1px; --radius-a: 2px; --Radius: 1px; a { border-radius: --radius-a; border-radius: var(--x); border-radius: 3px }"
           " b { border-radius: 3px; box-shadow: none; box-shadow: 0 0 1px #fff } --shadow: none")
    corpus = C.css_corpus(inline(spark, css), css_of(spark, "a { border-radius: 1px } --radius-z: 3px"))
    assert rows(T.radius_tokens(corpus), "value", "name", "kind_rank", "src_rank", order=["src_rank", "kind_rank", "pos"]) == [
        ("1px", "--radius-a", 0, 0), ("3px", "border-radius", 1, 0)]
    assert rows(T.shadow_tokens(corpus), "value", "name", order=["kind_rank"]) == [("none", "--shadow"), ("0 0 1px #fff", "box-shadow")]
