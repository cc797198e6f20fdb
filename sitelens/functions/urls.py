"""URL resolution and origins as native column expressions (L1-L3).

Supported subset of the WHATWG URL rules: absolute http(s) URLs,
scheme-relative ``//host``, path-absolute ``/p``, ``?q``, ``#f``, empty and
path-relative references; lower-case scheme and host; default ports dropped;
``.``/``..`` segments removed; non-ASCII and the characters of each
component's percent-encode set encoded as UTF-8 ``%XX``; existing ``%xx``
kept as written.  Other schemes are kept as written (opaque).  Not covered:
IDN/punycode hosts, IPv4 shorthand, percent-decoding of hosts.

The resolution runs as a few staged projections on the DataFrame so that
Catalyst keeps each intermediate value computed once (``CollapseProject``
does not inline expensive expressions that are used more than once), and the
result leaves through a generator so that predicates on it are not pushed
back into the stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL_PARTS = r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*):(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"
SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"
EDGE_SPACE = r"^[\x00-\x20]+|[\x00-\x20]+$"
TAB_NEWLINE = r"[\t\n\r]"
IPV6_HOST = r"^\[[0-9a-f:.]+\]$"
FORBIDDEN_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^|]"
DEFAULT_PORTS = {"http": 80, "https": 443}
SPECIAL = ["http", "https"]

# Characters to percent-encode per component, beyond non-ASCII / control characters.
PATH_SET = '"<>`{}'
QUERY_SET = "\"<>'"
FRAGMENT_SET = '"<>`'
_ONE_CHAR = r"(?s)."


def _set_rx(extra: str) -> str:
    escaped = "".join("\\" + c if c in "[]\\^-" else c for c in extra)
    return f"[^\\x21-\\x7E]|[{escaped}]"


def percent_encode(c: Column, extra: str) -> Column:
    """Percent-encode the characters of ``c`` outside printable ASCII or in ``extra`` (UTF-8, upper hex)."""
    rx = _set_rx(extra)
    chars = F.regexp_extract_all(c, F.lit(_ONE_CHAR), F.lit(0))
    enc = F.array_join(F.transform(chars, lambda ch: F.when(ch == " ", F.lit("%20"))
                                   .when(ch.rlike(rx), F.url_encode(ch)).otherwise(ch)), "")
    return F.when(c.rlike(rx), enc).otherwise(c)


DOT_SEGMENT = r"(?i)(^|/)(\.|%2e){1,2}(/|$)"


def _dot_segments(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments; a trailing dot segment leaves a trailing slash.

    The fold is a higher-order function (interpreted per row), so it runs only
    for the rare paths that hold a dot segment; for all others it is the identity.
    """
    return F.when(path.rlike(DOT_SEGMENT), _fold_dot_segments(path)).otherwise(path)


def _fold_dot_segments(path: Column) -> Column:
    segs = F.split(F.substring(path, 2, 1 << 30), "/")
    one = lambda s: F.lower(s).isin(".", "%2e")
    two = lambda s: F.lower(s).isin("..", ".%2e", "%2e.", "%2e%2e")
    empty = F.array().cast("array<string>")
    folded = F.aggregate(segs, empty, lambda acc, s: (
        F.when(two(s), F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .when(one(s), acc).otherwise(F.concat(acc, F.array(s)))))
    last = F.element_at(segs, -1)
    folded = F.when(one(last) | two(last), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def _parts(c: Column, prefix: str) -> list[Column]:
    return [F.regexp_extract(c, URL_PARTS, g).alias(f"{prefix}{name}")
            for g, name in ((1, "s"), (2, "a2"), (3, "a"), (4, "p"), (5, "q"), (6, "f"))]


def with_resolved_url(df: DataFrame, href: str, base: str | None, out: str) -> DataFrame:
    """Add column ``out``: ``href`` resolved against ``base`` (a canonical absolute URL), or null if invalid.

    With ``base=None`` the href must be absolute.
    """
    cols = df.columns
    h = F.regexp_replace(F.regexp_replace(F.col(href), EDGE_SPACE, ""), TAB_NEWLINE, "")
    base_col = F.col(base) if base else F.lit(None).cast("string")
    t = df.select(*cols, h.alias("_h"), F.struct(*_parts(base_col, "b")).alias("_b"),
                  F.when(base_col.rlike(URL_PARTS), True).otherwise(False).alias("_bok"))
    s = F.lower(F.regexp_extract("_h", SCHEME, 1))
    t = t.select(*cols, "_h", "_b", "_bok", s.alias("_s"),
                 F.substring(F.col("_h"), F.length(s) + 2, 1 << 30).alias("_rest"))
    b = F.col("_b")
    bs, ba, bp, bq = F.lower(b["bs"]), b["ba"], b["bp"], b["bq"]
    b_origin = F.concat(bs, F.lit("://"), ba)
    sv = F.col("_s")
    rel = (F.when(sv == "", F.col("_h"))
           .when(sv.isin(*SPECIAL) & (sv == bs) & ~F.col("_rest").rlike(r"^[/\\]"), F.col("_rest")))
    t = t.select(*cols, "_s", "_rest", "_b", "_bok", rel.alias("_r"))
    r = F.col("_r")
    relative = (F.when(~F.col("_bok"), F.lit(None))
                .when(r.rlike(r"^[/\\][/\\]"), F.concat(bs, F.lit(":"), r))
                .when(r.rlike(r"^[/\\]"), F.concat(b_origin, r))
                .when(r.startswith("?"), F.concat(b_origin, bp, r))
                .when(r.startswith("#"), F.concat(b_origin, bp, bq, r))
                .when(r == "", F.concat(b_origin, bp, bq))
                .otherwise(F.concat(b_origin, F.regexp_extract(bp, r"^(.*/)", 1), r)))
    absolute = (F.when(r.isNotNull(), relative)
                .when(sv.isin(*SPECIAL), F.concat(sv, F.lit("://"), F.regexp_replace("_rest", r"^[/\\]+", "")))
                .otherwise(F.concat(sv, F.lit(":"), F.col("_rest"))))
    t = t.select(*cols, absolute.alias("_abs"))
    # for http and https a backslash before the query is a slash
    head = F.regexp_extract("_abs", r"^([^?#]*)", 1)
    slashed = F.concat(F.translate(head, "\\", "/"), F.substring(F.col("_abs"), F.length(head) + 1, F.lit(1 << 30)))
    t = t.select(*cols, F.when(F.contains("_abs", F.lit("\\")) & F.col("_abs").rlike(r"^(?i:https?):"), slashed).otherwise(F.col("_abs")).alias("_abs"))
    t = t.select(*cols, "_abs", F.struct(*_parts(F.col("_abs"), "u")).alias("_u"))
    u = F.col("_u")
    us = F.lower(u["us"])
    auth = u["ua"]
    userinfo = F.regexp_extract(auth, r"^(.*@)", 1)
    hostport = F.regexp_extract(auth, r"^(?:.*@)?([^@]*)$", 1)
    host = F.lower(F.regexp_extract(hostport, r"^(\[[^\]]*\]|[^:]*)", 1))
    has_port = hostport.rlike(r"^(\[[^\]]*\]|[^:]*):")
    port = F.regexp_extract(hostport, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1)
    t = t.select(*cols, "_abs", us.alias("_us"), userinfo.alias("_ui"), host.alias("_host"),
                 has_port.alias("_hasport"), port.alias("_port"), u["up"].alias("_p"), u["uq"].alias("_q"),
                 u["uf"].alias("_f"), u["ua2"].alias("_a2"))
    port_num = F.when(F.col("_port").rlike("^[0-9]{1,5}$"), F.col("_port").cast("int"))
    default = F.when(F.col("_us") == "http", 80).when(F.col("_us") == "https", 443)
    port_ok = (F.col("_port") == "") | (port_num.isNotNull() & (port_num <= 65535))
    port_out = (F.when((F.col("_port") == "") | (port_num == default), F.lit(""))
                .otherwise(F.concat(F.lit(":"), port_num.cast("string"))))
    host_ok = ~F.col("_host").rlike(FORBIDDEN_HOST) | F.col("_host").rlike(IPV6_HOST)
    valid = (F.col("_a2") != "") & (F.col("_host") != "") & host_ok & port_ok
    path = F.regexp_replace(F.col("_p"), r"\\", "/")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    t = t.select(*cols, "_abs", "_us", "_ui", "_host", "_q", "_f", port_out.alias("_po"), valid.alias("_ok"),
                 _dot_segments(path).alias("_path"))
    special = F.col("_us").isin(*SPECIAL)
    canonical = F.concat(F.col("_us"), F.lit("://"), F.col("_ui"), F.col("_host"), F.col("_po"),
                         percent_encode(F.col("_path"), PATH_SET), percent_encode(F.col("_q"), QUERY_SET),
                         percent_encode(F.col("_f"), FRAGMENT_SET))
    result = (F.when(F.col("_abs").isNull(), F.lit(None))
              .when(special, F.when(F.col("_ok"), canonical))
              .when(F.col("_abs").rlike(SCHEME), F.col("_abs")))
    # Emitted through a one-element generator: a later filter on ``out`` (e.g. "is not null")
    # then stays above it instead of being pushed down through the staged projections,
    # which would inline every stage into the predicate many times over.
    return t.select(*cols, F.explode(F.array(result)).alias(out))


def origin(url: Column) -> Column:
    """Origin of a canonical URL: scheme://host[:port]; the string 'null' for other schemes; null if invalid."""
    m = F.regexp_extract(url, r"^(https?://)(?:[^/?#@]*@)?([^/?#]*)", 0)
    scheme_host = F.concat(F.regexp_extract(url, r"^(https?://)", 1),
                           F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#]*)", 1))
    return (F.when(url.isNull(), F.lit(None))
            .when(m != "", scheme_host)
            .when(url.rlike(SCHEME), F.lit("null")))


def strip_query_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def strip_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")
