"""Time parsing and formatting columns (SCL-4, SCL-5, SCL-6, SCL-13, SCL-14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Fixed value: the syntax Python's float() accepts (after stripping whitespace);
# digits may be grouped with single underscores.
_DIGITS = r"[0-9](?:_?[0-9])*"
PY_FLOAT_SYNTAX = (
    rf"(?i)^[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?|nan)$"
)


def py_float(c) -> Column:
    """SCL-4: ``float(x)`` with Python's syntax (``1_0`` is 10.0, ``1.5d`` is not a
    number); anything Python would reject gives null instead of an error."""
    from parlance.functions.text import py_strip

    t = py_strip(_c(c))
    ok = F.regexp_like(t, F.lit(PY_FLOAT_SYNTAX))
    return F.when(ok, F.regexp_replace(t, "_", "").try_cast("double"))


# Fixed value: the numeric prefix JavaScript's parseFloat accepts (after leading blanks).
JS_FLOAT_PREFIX = r"^[\t\n\x0B\f\r \x{A0}\x{FEFF}]*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))"


def js_parse_float(c) -> Column:
    """SCL-5: lenient prefix parse (``parseFloat``); no numeric prefix -> null."""
    return F.regexp_extract(_c(c), JS_FLOAT_PREFIX, 1).try_cast("double")


def hms(seconds) -> Column:
    """SCL-6: ``[HH:MM:SS]``: floor of x/3600, of (x rem 3600)/60 and of x rem 60,
    remainders taking the sign of x (JavaScript ``%``); hours are not wrapped and
    negative parts print as ``-1``.  Null, NaN or infinite input -> null.  Hours beyond
    2**63 are printed as the whole number the double holds, from 1e21 on in scientific
    notation, as JavaScript prints numbers."""
    x = _c(seconds)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    hours = F.when(finite, x / 3600)
    small = F.abs(hours) < F.lit(9.0e18)
    h = F.floor(F.when(small, hours)).cast("bigint")
    m = F.floor((x % 3600) / 60).cast("bigint")
    s = F.floor(x % 60).cast("bigint")
    whole = F.when(F.abs(hours) < F.lit(1e21), hours).cast("decimal(38,0)").cast("string")
    far = F.coalesce(whole, F.replace(hours.cast("string"), F.lit("E"), F.lit("e+")))
    text = F.when(small, F.format_string("%02d", h)).otherwise(far)
    return F.when(finite, F.concat(F.lit("["), text, F.format_string(":%02d:%02d]", m, s)))


def iso_datetime(c) -> Column:
    """SCL-13: ``datetime.isoformat()`` text of a (naive) timestamp: the
    fraction is printed with six digits, and left out when it is zero."""
    t = _c(c)
    base = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(t, ".SSSSSS")
    whole = F.date_format(t, "SSSSSS") == F.lit("000000")
    return F.when(t.isNotNull(), F.concat(base, F.when(whole, F.lit("")).otherwise(frac)))


_EPOCH_NTZ = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def ntz_micros(c) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ wall-clock value, read as
    UTC -- independent of the session time zone (a cast to TIMESTAMP is not)."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), _c(c))


def ntz_to_instant(c) -> Column:
    """TIMESTAMP_NTZ -> TIMESTAMP at the same UTC instant (for event-time watermarks)."""
    return F.timestamp_micros(ntz_micros(c))


def instant_to_ntz(c) -> Column:
    """TIMESTAMP -> TIMESTAMP_NTZ wall clock in UTC (inverse of ``ntz_to_instant``)."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(_c(c)), F.expr(_EPOCH_NTZ))


def epoch_seconds(c) -> Column:
    """Seconds since the epoch of a TIMESTAMP_NTZ value, as a double (exact micro
    count / 1e6), independent of the session time zone."""
    return ntz_micros(c) / F.lit(1e6)
