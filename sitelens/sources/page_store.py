"""Landed pages laid out by fetch key, and what was extracted from them before.

A crawl asks for pages by fetch key (the canonical URL without fragment), a
level at a time.  ``land_pages`` writes the pages once into buckets by that key,
so that a level reads what it asks for:

* few keys become literals of the scan, which leaves out all other buckets and,
  in a bucket, the row groups without them;
* many keys meet the buckets in a join that moves the keys and never the store.

Only the pages asked for are parsed.  A ``PageCache`` keeps the extracted links
and style blocks by the hash of the page's content, over runs and sessions: a
new crawl parses the contents that no run has seen yet, and a crawl with a cache
reads no HTML for its links at all.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitelens.functions import patterns as P
from sitelens.functions.text import find_all
from sitelens.functions.urls import strip_fragment, with_resolved_url
from sitelens.operators import links as LK
from sitelens.operators.corpus import first_seen
from sitelens.operators.crawl import page_status, store_rows
from sitelens.session import materialize_by_key, table_state

#: Up to so many keys are handed to the scan as literals; the rows are the same either way.
LITERAL_KEYS = 1000
BODY = ["site", "page_ord", "url", "final_url", "html_hash", "html"]
STATE = ["raw_status", "message", "error"]


class PageCache:
    """Extracted parts of page contents by their SHA-256, as a parquet table that outlives the session.

    Output of ``read``: html_hash, links (kind_rank, p1, p2, href in page order), styles (bodies of style tags).
    One writer at a time; readers see whole refreshes, since a refresh is committed as one part.
    """

    SCHEMA = "html_hash string, links array<struct<kind_rank:int,p1:int,p2:int,href:string>>, styles array<string>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        if not table_state(self.spark, self.path)[1]:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)

    def refresh(self, bodies: DataFrame) -> int:
        """Parse the contents of ``bodies`` (key, html_hash, html) that are not in the cache; how many those are.

        Which contents are new is decided on hashes and keys; of equal contents one key is parsed.
        """
        new = (bodies.select("html_hash", "key").join(self.read().select("html_hash"), "html_hash", "left_anti")
               .groupBy("html_hash").agg(F.min("key").alias("key")).select("key"))
        styles = F.transform(find_all(F.col("html"), P.STYLE_BLOCK, 0), lambda m: F.regexp_replace(m, P.java_rx(P.STYLE_TAG), ""))
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        (bodies.select("key", "html_hash", "html").join(new, "key", "left_semi")
         .select("html_hash", LK.link_array(F.col("html")).alias("links"), styles.alias("styles")).write.parquet(part))
        return self.spark.read.schema(self.SCHEMA).parquet(part).count()


@dataclass
class PageStore:
    """Landed pages by fetch key, one row per key (the first by site and page_ord).

    bodies: key, site, page_ord, url, final_url, html_hash, html.  states: key, raw_status, message, error (after the
    retry rule).  Both are bucketed by key.  ``cache``: extracted links by content, if they are kept.
    """

    bodies: DataFrame
    states: DataFrame
    cache: PageCache | None = None

    @staticmethod
    def _chooser(keys: DataFrame):
        """How a table is cut to the keys (column key, repeats allowed): by literals, or by a join; None without any key."""
        few = [r[0] for r in keys.limit(LITERAL_KEYS + 1).collect()]
        if not few:
            return None
        if len(few) <= LITERAL_KEYS:
            return lambda table: table.where(F.col("key").isin(sorted(set(few))))
        return lambda table: table.join(keys, "key", "left_semi")

    def _rows(self, only, columns: list[str]) -> DataFrame:
        body = [c for c in columns if c in BODY]
        state = [c for c in columns if c in STATE]
        wanted = only(self.bodies.select("key", *body))
        return wanted.join(only(self.states.select("key", *state)), "key") if state else wanted

    def rows(self, keys: DataFrame, columns: list[str]) -> DataFrame:
        """Page and fetch state of the keys that were landed."""
        return self._rows(self._chooser(keys) or (lambda table: table.limit(0)), columns)

    def links(self, keys: DataFrame) -> DataFrame | None:
        """Internal links of the fetched pages behind the keys, first seen (None without any key).  Output: key, pos (link order), target."""
        only = self._chooser(keys)
        if only is None:
            return None
        place = ["site", "page_ord", "final_url"]
        if self.cache is None:
            pages = self._rows(only, [*place, "html", "error"]).where(F.col("error").isNull())
            raw = LK.link_rows(pages, LK.link_array(F.col("html"), (4,)), ("key", "final_url"))
        else:
            pages = self._rows(only, [*place, "html_hash", "error"]).where(F.col("error").isNull())
            raw = LK.link_rows(pages.join(self.cache.read().select("html_hash", "links"), "html_hash"), F.col("links"), ("key", "final_url"))
        anchors = LK.internal_anchors(with_resolved_url(raw.where("kind_rank = 4"), "href", "final_url", "url"))
        first = first_seen(anchors, ["key", "url"], LK.LINK_ORD, [])
        return first.select("key", F.struct(*LK.LINK_ORD).alias("pos"), F.col("url").alias("target"))

    def refresh(self) -> int:
        """Bring the cache up to the store; how many page contents were parsed (none, if nothing changed)."""
        return self.cache.refresh(self.bodies) if self.cache is not None else 0


def land_pages(pages: DataFrame, fetch_log: DataFrame | None, cache: PageCache | None = None, buckets: int | None = None,
               keep: bool = False) -> PageStore:
    """Lay out landed pages by fetch key; the HTML is shuffled once, after each task has dropped its later rows of a key."""
    spark = pages.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    moved = "final_url" in pages.columns
    own = pages.select("site", "page_ord", "url", LK.landed_url(pages).alias("_landed"), "html")
    keyed = with_resolved_url(own, "url", None, "_canon").withColumn("key", strip_fragment(F.col("_canon"))).where("key is not null")
    if moved:
        keyed = with_resolved_url(keyed, "_landed", None, "_base").withColumn("final_url", strip_fragment(F.col("_base")))
    else:
        keyed = keyed.withColumn("final_url", F.col("key"))
    first = F.row_number().over(Window.partitionBy("key").orderBy("site", "page_ord"))
    bodies = keyed.select("key", "site", "page_ord", "url", "final_url", "html").withColumn("_n", first).where("_n = 1")
    bodies = bodies.select("key", *[F.sha2("html", 256).alias(c) if c == "html_hash" else c for c in BODY])
    states = store_rows(pages, page_status(pages, fetch_log)).select("key", *STATE)
    store = PageStore(materialize_by_key(bodies, "store-bodies", "key", buckets, keep), materialize_by_key(states, "store-states", "key", buckets, keep), cache)
    store.refresh()
    return store
