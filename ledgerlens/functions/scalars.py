"""Scalar and predicate expressions (Column -> Column), all JVM-side built-ins.

ANSI mode is on in Spark 4, so every coercion uses the ``try_`` form and
returns NULL instead of failing the task.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._cols import as_col

# Fixed values that must equal the analysed application's behaviour.
# Money-cleaning keeps digits, the dot and the minus sign only.
NON_NUMERIC_CHARS = r"[^\d.\-]"
# Inline tags removed from report text.
HTML_TAG = r"<[^>]+>"
# Email shape used by the contact check.
EMAIL_SHAPE = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
# Phone shape: 7 to 15 digits once everything else is removed.
PHONE_MIN_DIGITS, PHONE_MAX_DIGITS = 7, 15
# First stand-alone integer in a question; default when absent.
FIRST_INT = r"\b(\d+)\b"
DEFAULT_N = 10


def coerce_numeric(c, already_numeric: bool = False) -> Column:
    """Text money to double: keep digits, '.', '-'; empty or unparseable -> NULL.

    Keeps the quirks of the rule: '(100)' -> 100, '1.2e3' -> 1.23, '1-2' -> NULL.
    Numeric input is passed through unchanged (pass ``already_numeric``).
    """
    c = as_col(c)
    if already_numeric:
        return c
    cleaned = F.regexp_replace(c.cast("string"), NON_NUMERIC_CHARS, "")
    return F.nullif(cleaned, F.lit("")).try_cast("double")


def to_datetime(c) -> Column:
    """Text to a wall-clock timestamp; bad values become NULL."""
    return as_col(c).cast("string").try_cast("timestamp_ntz")


def safe_div(a, b, default: float = 0.0) -> Column:
    """A / b, ``default`` when b is 0 or NULL."""
    return F.coalesce(F.try_divide(as_col(a), as_col(b)), F.lit(default))


_SPLIT = 134217729.0  # 2**27 + 1, splits a double into two 26-bit halves


def _split(a: Column):
    c = a * _SPLIT
    hi = c - (c - a)
    return hi, a - hi


def round_binary_half_even(v: Column, decimals: int) -> Column:
    """Round the exact binary value of ``v`` to ``decimals`` places, ties to even.

    This is how Python's fixed-point formatting rounds (R14). ``p = v * 10**k``
    is computed with its exact rounding error ``e`` (Dekker's error-free
    product), so a product that only looks like a tie after rounding is
    decided by the sign of ``e``; true ties go to the even neighbour.
    """
    scale = float(10 ** decimals)
    p = v * scale
    ah, al = _split(v)
    bh, bl = _split(F.lit(scale))
    err = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    fl = F.floor(p).cast("double")
    f = p - fl
    up = (F.when(f > 0.5, 1.0).when(f < 0.5, 0.0).when(err > 0, 1.0).when(err < 0, 0.0)
          .when(F.pmod(fl, F.lit(2.0)) == 0, 0.0).otherwise(1.0))
    return (fl + up) / scale


def fixed(v: Column, decimals: int, thousands: bool = True, suffix: str = "", sign: bool = False) -> Column:
    """Python-style fixed-point text with optional thousands separators.

    ``format_string`` alone rounds the shortest decimal form half-up
    (1.25 -> '1.3'); the value is first rounded like Python does, after which
    formatting only prints digits.
    """
    pattern = ("%," if thousands else "%") + ("+" if sign else "") + f".{decimals}f" + suffix.replace("%", "%%")
    return F.format_string(pattern, round_binary_half_even(v, decimals))


def format_number(c) -> Column:
    """C4: 1.23B / 4.56M / 7.8K / 9.00 with thousands separators; NULL -> em dash."""
    v = as_col(c).cast("double")
    a = F.abs(v)
    return (F.when(v.isNull(), F.lit("—"))
            .when(a >= 1e9, fixed(v / 1e9, 2, suffix="B"))
            .when(a >= 1e6, fixed(v / 1e6, 2, suffix="M"))
            .when(a >= 1e3, fixed(v / 1e3, 1, suffix="K"))
            .otherwise(fixed(v, 2)))


def human_readable_size(c) -> Column:
    """Byte count as 'x.x B/KB/MB/GB', base 1024, GB is the last unit."""
    v = as_col(c).cast("double")
    return (F.when(v < 1024, fixed(v, 1, suffix=" B"))
            .when(v < 1024.0 ** 2, fixed(v / 1024.0, 1, suffix=" KB"))
            .when(v < 1024.0 ** 3, fixed(v / 1024.0 ** 2, 1, suffix=" MB"))
            .otherwise(fixed(v / 1024.0 ** 3, 1, suffix=" GB")))


def strip_html(c) -> Column:
    """Remove inline tags."""
    return F.regexp_replace(as_col(c), HTML_TAG, "")


def latin1_safe(c) -> Column:
    """Replace every code point outside Latin-1 by '?'."""
    return F.regexp_replace(as_col(c), r"[^\x00-\xFF]", "?")


def name_key(c, sep_from: str = " ", sep_to: str = "_") -> Column:
    """Lower-case, trim, swap separators (space -> '_' by default)."""
    return F.replace(F.lower(F.trim(as_col(c))), F.lit(sep_from), F.lit(sep_to))


def first_int(c, default: int = DEFAULT_N) -> Column:
    """First stand-alone integer of a text, ``default`` when none."""
    found = F.regexp_extract(as_col(c), FIRST_INT, 1)
    return F.coalesce(F.nullif(found, F.lit("")).try_cast("bigint"), F.lit(default).cast("bigint"))


def contains_any(c, keywords) -> Column:
    """Substring match against any keyword (so 'stop' matches 'top')."""
    c = as_col(c)
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(c, F.lit(k))
    return out


def clip(c, lower, upper) -> Column:
    """C11: clip to [lower, upper]; NULL stays NULL (bare least/greatest would skip it)."""
    c = as_col(c)
    lo, hi = as_col(lower) if isinstance(lower, (str, Column)) else F.lit(lower), \
        as_col(upper) if isinstance(upper, (str, Column)) else F.lit(upper)
    return F.when(c < lo, lo).when(c > hi, hi).otherwise(c)


def is_email(c) -> Column:
    """Whole value has the email shape."""
    return F.coalesce(as_col(c).rlike(EMAIL_SHAPE), F.lit(False))


def is_phone(c) -> Column:
    """C14: 7-15 digits after removing every non-digit."""
    n = F.length(F.regexp_replace(F.coalesce(as_col(c), F.lit("")), r"\D", ""))
    return n.between(PHONE_MIN_DIGITS, PHONE_MAX_DIGITS)


def round_scaled(c, decimals: int) -> Column:
    """Round to ``decimals`` places as ``round(x * 10**k) / 10**k`` (ties away from zero on the product).

    This is how SQL engines commonly round doubles; Spark's ``round`` instead
    rounds the shortest decimal form of ``x``, which differs on exact ties such
    as -48922.0607625.
    """
    scale = float(10 ** decimals)
    return F.round(as_col(c) * scale, 0) / scale
