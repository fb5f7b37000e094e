"""String functions on columns that follow Python's rules where Spark's own differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z0-9]{3,}"


def strip(c: Column) -> Column:
    """Unicode blanks off both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def rfind(window: Column, what: str) -> Column:
    """0-based last position of a one-character string in a window, -1 if absent."""
    return F.when(F.locate(what, window) == 0, F.lit(-1)).otherwise(F.length(window) - F.locate(what, F.reverse(window)))


def tokens(c: Column) -> Column:
    """Lower-case runs of three or more ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def title_case(c: Column) -> Column:
    """First letter of every run of letters upper, others lower (a digit or mark ends a run)."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.concat_ws("", F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, F.lit(2), F.length(r))))))


def squeeze_breaks(c: Column) -> Column:
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def sha1_id(*parts: Column, length: int = 16) -> Column:
    """First hex digits of the SHA-1 of the parts, joined by NUL."""
    return F.substring(F.sha1(F.concat_ws("\x00", *parts).cast("binary")), 1, length)
