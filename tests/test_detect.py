"""Stack confidence goldens, accessibility on an empty site, robots rules."""

import pytest

from helpers import analysis, pages_of, rows
from sitelens.operators.robots import robots_status


@pytest.mark.parametrize("html,detector,conf", [
    ("__NEXT_DATA__", "Next.js", 0.9),
    ("__NEXT_DATA__ /_next/", "Next.js", 1.0),
    ("next/head data-nscript", "Next.js", 0.8),
    ('<i class="flex"></i> md:hidden --tw-ring', "Tailwind CSS", 1.0),
    ("__emotion", "Material UI", 0.5),
])
def test_confidence(spark, html, detector, conf):
    a = analysis(spark, pages_of(spark, html))
    got = rows(a.signals.where(f"detector = '{detector}'"), "confidence")
    assert len(got) == 1 and abs(got[0][0] - conf) < 1e-9


def test_a11y_on_empty_site(spark):
    pages = pages_of(spark, "<p>x</p>")
    a = analysis(spark, pages, extra_sites=["https://empty.test"])
    got = rows(a.a11y.where("site = 'https://empty.test'"), "feature", "present", "details", "confidence",
               order=["feature_ord"])
    assert got == [
        ("Skip Links", False, None, 0.5),
        ("Focus Visible Styling", False, None, 0.4),
        ("ARIA Attributes", False, "Found 0 ARIA attributes", 0.4),
        ("Image Alt Text", True, "0/0 images have alt text (100%)", 0.9),
        ("Semantic HTML", False, "Uses 0/4 semantic landmarks (nav, main, header, footer)", 0.4),
    ]


ROBOTS = [
    ("User-agent: *\nDisallow: /", "blocked"),
    ("User-agent: *\nDisallow: /*", "blocked"),
    ("User-agent: GoogleBot\nDisallow: /", "blocked"),
    ("User-agent: *\nDisallow: /private", "allowed"),
    ("User-agent: *\nUser-agent: foo\nDisallow: /", "allowed"),
    ("User-agent: *\nDisallow: / # all", "allowed"),
    ("Disallow: /", "allowed"),
]


def test_robots_rules(spark):
    df = spark.createDataFrame([(f"https://r{i}.test", b) for i, (b, _) in enumerate(ROBOTS)], "origin string, body string")
    got = dict(rows(robots_status(df), "origin", "status"))
    assert got == {f"https://r{i}.test": s for i, (_, s) in enumerate(ROBOTS)}
    warn = rows(robots_status(df).where("origin = 'https://r1.test'"), "warning")
    assert warn == [("robots.txt disallows crawling: /*",)]
