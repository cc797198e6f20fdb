"""URL resolution goldens (platform URL class behaviour on the supported subset)."""

from sitelens.functions.urls import origin, with_resolved_url
from pyspark.sql import functions as F

BASE = "https://WWW.Example.com:443/fr/825?page=2&ref=x#top"
GOLDEN = [
    ("/für", "https://www.example.com/f%C3%BCr"),
    ("/the,", "https://www.example.com/the,"),
    ("a/b", "https://www.example.com/fr/a/b"),
    ("../js/0.js", "https://www.example.com/js/0.js"),
    ("./x", "https://www.example.com/fr/x"),
    ("?q=1", "https://www.example.com/fr/825?q=1"),
    ("#f", "https://www.example.com/fr/825?page=2&ref=x#f"),
    ("", "https://www.example.com/fr/825?page=2&ref=x"),
    ("//CDN.x.org/a", "https://cdn.x.org/a"),
    ("http://h.x:80/p", "http://h.x/p"),
    ("http://h.x:8080/p", "http://h.x:8080/p"),
    ("HTTP://U.X", "http://u.x/"),
    ("/a b", "https://www.example.com/a%20b"),
    ("/a/./b/../c/", "https://www.example.com/a/c/"),
    ("/..//z", "https://www.example.com//z"),
    ("/%7euser", "https://www.example.com/%7euser"),
    ("/a%zz", "https://www.example.com/a%zz"),
    ('/a"<>b', "https://www.example.com/a%22%3C%3Eb"),
    ("/q?x=ü y", "https://www.example.com/q?x=%C3%BC%20y"),
    ("  /t  ", "https://www.example.com/t"),
    ("http://", None),
    ("mailto:a@b.c", "mailto:a@b.c"),
]


def test_resolution_goldens(spark):
    base = spark.createDataFrame([(BASE,)], "base string")
    canon = with_resolved_url(base, "base", None, "canon").first()["canon"]
    assert canon == "https://www.example.com/fr/825?page=2&ref=x#top"
    df = spark.createDataFrame([(h, canon) for h, _ in GOLDEN], "href string, base string")
    got = dict((r["href"], r["url"]) for r in with_resolved_url(df, "href", "base", "url").collect())
    assert got == dict(GOLDEN)


def test_origin(spark):
    df = spark.createDataFrame([("https://www.example.com/fr/825?x#y",), ("http://h.x:8080/p",), ("mailto:a@b.c",),
                                (None,)], "u string")
    got = [r[0] for r in df.select(origin(F.col("u"))).collect()]
    assert got == ["https://www.example.com", "http://h.x:8080", "null", None]


def test_canonical_urls_are_fixed_points(spark):
    """Resolving an already canonical URL (no base) gives it back unchanged, for every link of the corpus."""
    from conftest import SF01
    from sitelens.operators.links import resolved_links
    from sitelens.plans.catalog import Inputs

    urls = resolved_links(Inputs(spark, SF01).pages_themed).where(F.col("url").isNotNull()).select("url").distinct()
    again = with_resolved_url(urls, "url", None, "again")
    assert again.count() > 1000
    assert again.where(~F.col("again").eqNullSafe(F.col("url"))).count() == 0


def test_ipv6_hosts_and_backslashes(spark):
    cases = [("http://[2001:DB8::1]:80/a", "http://[2001:db8::1]/a"), ("https://[::1]:8443/x?q", "https://[::1]:8443/x?q"),
             ("https://h.test\\a\\b", "https://h.test/a/b"), ("https://h.test/a?x\\y", "https://h.test/a?x\\y"), ("http://[zz]/", None)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "h string")
    from sitelens.functions.urls import with_resolved_url
    assert [r["u"] for r in with_resolved_url(df, "h", None, "u").collect()] == [w for _, w in cases]
