"""Whitespace-exact text expressions.

Python's ``str.split()`` / ``str.strip()`` treat every Unicode whitespace
character as a separator; Java's ``\\s`` and Spark's ``trim`` do not.  The class
below lists the characters for which ``str.isspace()`` is true, written with
``\\x{..}`` escapes that both Java regex and RE2 (DuckDB) accept, so the same
pattern string is used in Spark code and in the oracle SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python treats as whitespace.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WS = f"[{WS_CLASS}]+"
NON_WS = f"[^{WS_CLASS}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(text) -> Column:
    """``len(text.split())`` as a BIGINT; null text counts as 0 words.

    Splitting the stripped text is about twice as fast as counting regex matches
    (which Spark evaluates by materialising every match)."""
    stripped = py_strip(text)
    n = F.size(F.split(stripped, WS, -1)).cast("bigint")
    return F.when(stripped.isNull() | (stripped == ""), F.lit(0).cast("bigint")).otherwise(n)


def py_strip(text) -> Column:
    """``text.strip()``: remove Unicode whitespace at both ends (Spark ``trim`` only removes spaces)."""
    return F.btrim(_col(text), F.lit(WS_CHARS))


def words(text) -> Column:
    """``text.split()`` as an array of strings (no empty elements)."""
    return F.regexp_extract_all(_col(text), F.lit(f"({NON_WS})"), 1)
