"""robots.txt rules (L9) over landed robots bodies.

A body is one row; its lines are folded left to right with ``aggregate``:
the last ``user-agent`` line decides whether following ``disallow`` lines
apply (agent ``*`` or containing ``bot``); ``disallow: /`` or ``/*`` blocks.
Purely narrow: no window, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.text import js_trim

AGENT_PREFIX = "user-agent:"
DISALLOW_PREFIX = "disallow:"


def robots_status(robots: DataFrame) -> DataFrame:
    """Input: origin, body.  Output: origin, status ('allowed'|'blocked'), warning (null if allowed)."""
    lines = F.transform(F.split(F.col("body"), "\n"), lambda ln: F.lower(js_trim(ln)))
    init = F.struct(F.lit(False).alias("in_block"), F.lit(None).cast("string").alias("path"))

    def step(acc, ln):
        is_agent = ln.startswith(AGENT_PREFIX)
        agent = js_trim(F.substring(ln, len(AGENT_PREFIX) + 1, 1 << 30))
        path = js_trim(F.substring(ln, len(DISALLOW_PREFIX) + 1, 1 << 30))
        hit = (acc["path"].isNull() & ~is_agent & acc["in_block"] & ln.startswith(DISALLOW_PREFIX)
               & path.isin("/", "/*"))
        return F.struct(
            F.when(is_agent, (agent == "*") | agent.contains("bot")).otherwise(acc["in_block"]).alias("in_block"),
            F.when(hit, path).otherwise(acc["path"]).alias("path"))

    folded = F.aggregate(lines, init, step)
    blocked = folded["path"].isNotNull()
    return robots.select(
        "origin", F.when(blocked, "blocked").otherwise("allowed").alias("status"),
        F.when(blocked, F.concat(F.lit("robots.txt disallows crawling: "), folded["path"])).alias("warning"))


def site_robots(sites: DataFrame, robots: DataFrame) -> DataFrame:
    """Robots status per site (origin = site); a site without a file is allowed."""
    status = robots_status(robots)
    return (sites.join(status, sites["site"] == status["origin"], "left")
            .select("site", F.coalesce("status", F.lit("allowed")).alias("robots_status"), "warning"))
