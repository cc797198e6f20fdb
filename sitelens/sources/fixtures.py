"""Deterministic tables derived from the given ``pages`` table.

The given ``pages`` carry no theme content, so the test corpus is derived from
them by plain SQL that gives byte-equal text in Spark and in DuckDB (the
oracle).  Table references are written ``$name``; Spark binds DataFrames,
the oracle binds CTE names.  The derived tables grow with ``pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.session import run_sql

# ``pages_themed``: page_id, page_ord, site, url, html.  The text is the fixture as specified;
# ``p``/``n`` number the pages of each site and name the next two paths.
PAGES_THEMED_N_SQL = r"""
p AS (
  SELECT page_id, url, html,
         regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site,
         regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path
  FROM $pages),
n AS (
  SELECT *, cast(row_number() OVER (PARTITION BY site ORDER BY page_id) - 1 AS bigint) AS page_ord,
    coalesce(lead(path) OVER (PARTITION BY site ORDER BY page_id), '/end') AS nxt,
    coalesce(lead(path, 2) OVER (PARTITION BY site ORDER BY page_id), '/end') AS nxt2
  FROM p)
"""

PAGES_THEMED_M_SQL = r"""
m AS (SELECT * FROM (VALUES
  (0,'__NEXT_DATA__'),(1,'/_next/x'),(2,'next/head'),(3,'data-nscript'),(4,'data-reactroot'),
  (5,'__REACT_DEVTOOLS'),(6,'react.min.js'),(7,'react-dom'),(8,'data-v-1a2b'),(9,'__VUE__'),(10,'vue.js'),
  (11,'__NUXT__'),(12,'/_nuxt/x'),(13,'svelte-x1'),(14,'__svelte'),(15,'tailwindcss'),(16,'--tw-ring'),
  (17,'<i class="flex"></i>'),(18,'md:hidden'),(19,'@radix-ui'),(20,'cn ('),(21,'data-[state='),
  (22,'class-variance-authority'),(23,'bootstrap.min.css'),(24,'<i class="row"></i>'),(25,'btn-danger'),
  (26,'@mui/'),(27,'MuiCard'),(28,'__emotion'),(29,'@chakra-ui'),(30,'chakra-x'),(31,'@vite/x'),
  (32,'vite.config'),(33,'webpackJsonp'),(34,'__webpack_require__')) AS v(mk, marker))
"""

PAGES_THEMED_FINAL_SQL = r"""
SELECT page_id, page_ord, site, url,
  replace(replace(html, '</head>', concat(
    '<link rel="stylesheet" href="/assets/', cast(page_id % 7 AS string), '.css">',
    CASE WHEN page_id % 5 = 0 THEN '<link type="text/css" href="theme.css?v=2">' ELSE '' END,
    '<script src="../js/', cast(page_id % 3 AS string), '.js"></script>',
    '<style>@import url("/assets/', cast((page_id + 1) % 7 AS string), '.css"); :root{--bg-main: #',
    lpad(cast((page_id * 7919) % 1000000 AS string), 6, '0'),
    ';--text-color:rgb(', cast(page_id % 256 AS string), ', 0, 0);--overlay: RGBA(0,0,0,.5);',
    '--radius-md: ', cast(page_id % 4 * 2 AS string), 'px;--radius-md: 99px;--gap: 4px;',
    '--shadow-sm: 0 1px 2px rgba(0,0,0,.1)}', chr(10),
    'body { font-family: Inter, sans-serif; font-size: 16px; line-height: 1.5 }', chr(10),
    'h1, h2 { font-size: ', cast(28 + page_id % 3 AS string), 'px; font-weight: 700 }</style></head>')),
    '<article>', concat('<header aria-label="top"><a href="', nxt, '?ref=1">n</a><a href="', nxt2,
    '#x">m</a><a href="mailto:a@b.c">c</a></header><img src="a.png" alt="a">',
    CASE WHEN page_id % 2 = 0 THEN '<img src="b.png">' ELSE '' END,
    CASE WHEN page_id % 4 = 0 THEN '<a href="#main">Skip to content</a><main >' ELSE '' END,
    coalesce(marker, ''), '<article>')) AS html
FROM $n n LEFT JOIN m ON n.page_id % 37 = m.mk
"""

PAGES_THEMED_SQL = ("WITH " + PAGES_THEMED_N_SQL.strip() + ",\n" + PAGES_THEMED_M_SQL.strip() + "\n"
                    + PAGES_THEMED_FINAL_SQL.strip().replace("FROM $n n LEFT JOIN", "FROM n LEFT JOIN"))

# Spark side: the same final projection over a numbered page table built without per-site tasks.
PAGES_THEMED_FROM_N_SQL = "WITH " + PAGES_THEMED_M_SQL.strip() + "\n" + PAGES_THEMED_FINAL_SQL.strip()

# ``css_assets``: site, css_ord, css_url, css — the fetched external style sheets.
CSS_ASSETS_SQL = r"""
SELECT DISTINCT site, page_id % 7 AS css_ord, concat(site, '/assets/', cast(page_id % 7 AS string), '.css') AS css_url,
  concat('.btn { border-radius: ', cast(page_id % 7 AS string), 'px; box-shadow: 0 0 ', cast(page_id % 7 AS string), 'px #000 }', chr(10),
    CASE WHEN page_id % 7 = 1 THEN '.btn:hover { box-shadow: none } ' ELSE '' END,
    CASE WHEN page_id % 7 = 2 THEN '[class*="btn"] { color: red } .btn:active { border-radius: var(--r) }' ELSE '' END,
    CASE WHEN page_id % 7 = 3 THEN '.btn--primary:focus{color:red}' ELSE '' END, chr(10),
    '.card { display: ', CASE WHEN page_id % 7 < 4 THEN 'grid' ELSE 'flex' END, ' }', chr(10),
    '.card-body { font-size: 14px }', chr(10), '.card-header { font-family: Georgia, serif }', chr(10),
    CASE WHEN page_id % 7 = 5 THEN '.col-md-6 { width: 50% } .hero { } .navbar { } .form-group { } [role="dialog"] { } .button { } .navigation { } .hero-section { } .banner { } .form-control { } .input { } .text-field { } .modal { } .dialog { }' ELSE '' END, chr(10),
    '.container { max-width: ', cast(960 + page_id % 7 * 60 AS string), 'px; }', chr(10),
    '@media (min-width: 1px) and (max-width: ', cast(480 + page_id % 7 * 144 AS string), 'px) { input[type=text]:focus { outline: 1px } }', chr(10),
    CASE WHEN page_id % 7 = 6 THEN '.nav:focus-visible { color: red }' ELSE '' END, chr(10),
    ':root { --accent: hsl(', cast(page_id % 7 * 40 AS string), ', 50%, 50%); --radius: 8px; --border-radius: 8px }') AS css
FROM $pages_themed
"""

# ``requests``: one per site (seed = first page; each option given or left to its default) plus invalid rows.
REQUESTS_SQL = r"""
SELECT site AS request_id, url AS theme_url,
       cast(CASE page_id % 4 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 12 END AS int) AS max_pages,
       CASE page_id % 3 WHEN 1 THEN true WHEN 2 THEN false END AS same_origin_only,
       CASE WHEN page_id % 5 = 0 THEN cast(NULL AS boolean) ELSE page_id % 5 > 1 END AS include_assets,
       CASE page_id % 4 WHEN 1 THEN 'both' WHEN 2 THEN 'extract' WHEN 3 THEN 'prompt' END AS mode,
       CASE WHEN page_id % 2 = 1 THEN concat('note on ', site) END AS notes
FROM $pages_themed WHERE page_ord = 0
UNION ALL
SELECT * FROM (VALUES
  ('invalid-1', cast(NULL AS string), cast(NULL AS int), cast(NULL AS boolean), cast(NULL AS boolean), cast(NULL AS string), cast(NULL AS string)),
  ('invalid-2', 'ftp://x.y', NULL, NULL, NULL, NULL, NULL),
  ('invalid-3', 'not a url', NULL, NULL, NULL, NULL, NULL),
  ('invalid-4', 'https://invalid.example.com/', 0, NULL, NULL, NULL, NULL),
  ('invalid-5', 'https://invalid.example.com/', 21, NULL, NULL, NULL, NULL),
  ('invalid-6', 'https://invalid.example.com/', 6, true, true, 'all', 'x')
) AS v(request_id, theme_url, max_pages, same_origin_only, include_assets, mode, notes)
"""

# ``fetch_log``: one row per page fetch and per style-sheet fetch, timings in epoch milliseconds.
FETCH_LOG_SQL = r"""
SELECT site, url, 'page' AS kind,
       cast(CASE WHEN page_id % 11 = 0 THEN 404 WHEN page_id % 13 = 0 THEN 503 ELSE 200 END AS int) AS status,
       cast(1700000000000 + page_ord * 1000 AS bigint) AS started_ms,
       cast(1700000000000 + page_ord * 1000 + 200 + page_id % 100 AS bigint) AS ended_ms
FROM $pages_themed
UNION ALL
SELECT site, css_url AS url, 'css' AS kind,
       cast(CASE WHEN css_ord = 6 THEN 500 ELSE 200 END AS int) AS status,
       cast(1700000100000 + css_ord * 1000 AS bigint) AS started_ms,
       cast(1700000100000 + css_ord * 1000 + 50 AS bigint) AS ended_ms
FROM $css_assets
"""

# ``robots``: origin, body — one of the rule cases per site, chosen by the length of the origin.
ROBOTS_SQL = r"""
SELECT origin, body FROM (
  SELECT DISTINCT site AS origin, length(site) % 8 AS k FROM $pages_themed) s
JOIN (VALUES
  (0, concat('User-agent: *', chr(10), 'Disallow: /')),
  (1, concat('User-agent: *', chr(10), 'Disallow: /*')),
  (2, concat('User-agent: GoogleBot', chr(10), 'Disallow: /')),
  (3, concat('User-agent: *', chr(10), 'Disallow: /private')),
  (4, concat('User-agent: *', chr(10), 'User-agent: foo', chr(10), 'Disallow: /')),
  (5, concat('User-agent: *', chr(10), 'Disallow: / # all')),
  (6, 'Disallow: /')) AS b(k, body)
ON s.k = b.k
"""


def numbered_pages(pages_df: DataFrame) -> DataFrame:
    """``n`` of the fixture: site, path, page_ord and the next two paths of each page, skew-safe.

    Equals ``row_number()``/``lead`` over ``PARTITION BY site ORDER BY page_id``
    but never puts one site in one task, and the HTML moves only in the final
    join by ``page_id``.
    """
    from pyspark.sql import functions as F

    from sitelens.operators.ordinal import with_lead, with_ordinal

    keys = pages_df.select("page_id", F.regexp_extract("url", r"^(https?://[^/?#]+)", 1).alias("site"),
                           F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"))
    ranked = with_ordinal(keys, "site", "page_id", "page_ord")
    ranked = with_lead(with_lead(ranked, "site", "page_ord", "path", 1, "nxt"), "site", "page_ord", "path", 2, "nxt2")
    small = ranked.select("page_id", "site", "path", "page_ord", F.coalesce("nxt", F.lit("/end")).alias("nxt"),
                          F.coalesce("nxt2", F.lit("/end")).alias("nxt2"))
    return pages_df.select("page_id", "url", "html").join(small, "page_id")


def pages_themed_frame(spark: SparkSession, pages_df: DataFrame) -> DataFrame:
    return run_sql(spark, PAGES_THEMED_FROM_N_SQL, n=numbered_pages(pages_df))


# Oracle CTE bodies (DuckDB): the same text with table references bound to CTE names.
def oracle_ctes() -> dict[str, str]:
    def bind(sql: str) -> str:
        for name in ("pages_themed", "css_assets", "pages"):
            sql = sql.replace(f"${name}", name)
        return sql.strip()

    return {
        "pages_themed": bind(PAGES_THEMED_SQL),
        "css_assets": bind(CSS_ASSETS_SQL),
        "requests": bind(REQUESTS_SQL),
        "fetch_log": bind(FETCH_LOG_SQL),
        "robots": bind(ROBOTS_SQL),
    }
