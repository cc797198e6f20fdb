"""Column helpers for the string semantics of the extraction rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelens.functions.patterns import java_rx


def rx(pattern: str, ignore_case: bool = False) -> Column:
    """A literal Java regex (compiled once per task by Spark)."""
    return F.lit(java_rx(pattern, ignore_case))


def js_trim(c: Column) -> Column:
    """Strip leading/trailing ASCII whitespace (Spark's ``trim`` only strips spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def snippet(c: Column, n: int) -> Column:
    """First ``n`` characters."""
    return F.substring(c, 1, n)


def find_all(text: Column, pattern: str, idx: int = 0) -> Column:
    """All non-overlapping matches, left to right (group ``idx``)."""
    return F.regexp_extract_all(text, rx(pattern), F.lit(idx))


def first_group(text: Column, pattern: str, idx: int = 1) -> Column:
    """Trimmed first capture, or null when the pattern does not match."""
    return F.when(text.rlike(java_rx(pattern)), js_trim(F.regexp_extract(text, java_rx(pattern), idx)))


def count_matches(text: Column, pattern: str) -> Column:
    return F.size(find_all(text, pattern)).cast("bigint")
