"""Registered queries against their DuckDB oracle on the smallest scale (the driver runs sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

FAST = ["color_usage_counts", "custom_properties", "radius_tokens", "stack_signals", "component_states",
        "a11y_report", "breakpoints", "css_links", "internal_links", "validate_requests", "crawl_stats",
        "quick_start_tokens", "robots_status", "layout_summary", "site_bfs"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("pages",):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def _norm(rows):
    return sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF001)
    cols = sorted(sdf.columns)
    s_rows = [tuple(r[c] for c in cols) for r in sdf.collect()]
    rel = duck.sql(E.oracle_sql()[name])
    d_rows = [tuple(dict(zip(rel.columns, r))[c] for c in cols) for r in rel.fetchall()]
    assert sorted(rel.columns) == cols
    assert _norm(s_rows) == _norm(d_rows)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "site"
