"""Scalar helpers. Missing, NaN and infinite values are all represented by NULL."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

INF = float("inf")


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_double() -> Column:
    return F.lit(None).cast("double")


def finite_or_null(c) -> Column:
    """NaN and +-Inf become NULL."""
    c = as_col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), null_double()).otherwise(c)


def number_or_null(c) -> Column:
    """Text to double; anything that does not parse ('ND', 'NF', '-') becomes NULL."""
    return finite_or_null(as_col(c).try_cast("double"))


def ratio(a, b) -> Column:
    """a / b with NULL instead of an error or an infinity when b is 0."""
    return F.try_divide(as_col(a).cast("double"), as_col(b).cast("double"))


def log10(c) -> Column:
    c = as_col(c)
    return F.when(c > 0, F.log10(c))


def signif(c, digits: int) -> Column:
    """Round to a number of significant digits."""
    c = as_col(c).cast("double")
    shift = F.lit(digits - 1) - F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), F.abs(shift))
    return (
        F.when(c == 0, F.lit(0.0))
        .when(shift >= 0, F.round(c * scale) / scale)
        .otherwise(F.round(c / scale) * scale)
    )


def half_even(c, digits: int = 0) -> Column:
    """Banker's rounding; digits may be negative."""
    return F.bround(as_col(c), digits)


def logit(c, delta: float = 1e-5) -> Column:
    c = as_col(c)
    return F.ln(ratio(c + F.lit(delta), F.lit(1.0 + delta) - c))


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-as_col(c)))


def in_set(c, values) -> Column:
    """Set membership that is never NULL: a missing value is simply not in the set."""
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))


def not_in_set(c, values) -> Column:
    return ~in_set(c, values)


def blank_to_null(c) -> Column:
    c = as_col(c)
    return F.when(c != "", c)


def default_to(c, default) -> Column:
    """A parameter, or its default where it is missing."""
    return F.coalesce(as_col(c), F.lit(default))


def row_count(cols) -> Column:
    """How many of the given columns hold a value in this row."""
    return reduce(add, [as_col(c).isNotNull().cast("int") for c in cols])


def row_missing(cols) -> Column:
    return reduce(add, [as_col(c).isNull().cast("int") for c in cols])


def row_mean(cols) -> Column:
    """Mean across columns, ignoring NULLs; plain arithmetic so that it stays in generated code."""
    total = reduce(add, [F.coalesce(as_col(c), F.lit(0.0)) for c in cols])
    return ratio(total, row_count(cols))


def row_sd(cols, mean, n) -> Column:
    """Sample standard deviation across columns from their row mean and count; NULL below two values."""
    mean, n = as_col(mean), as_col(n)
    gaps = [as_col(c) - mean for c in cols]
    squares = reduce(add, [F.coalesce(g * g, F.lit(0.0)) for g in gaps])
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def non_missing(array) -> Column:
    """The values of an array without its NULLs, or one NULL when there is nothing else."""
    kept = F.filter(as_col(array), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, kept).otherwise(F.slice(as_col(array), 1, 1))


def hash_hex(seed: int, *keys) -> Column:
    """Seeded 128-bit hash of a key as 32 hex digits: the library's only source of randomness. A missing part is marked, so that its place tells."""
    return F.md5(hash_text(F.lit(str(seed)), *keys))


def hash_text(*parts) -> Column:
    """The text that hash_hex hashes."""
    return F.concat_ws(":", *[F.coalesce(as_col(k).cast("string"), F.lit("\0")) for k in parts])


def hash_int(hex_col, start: int = 1, width: int = 8) -> Column:
    """An integer from `width` hex digits of a hash."""
    return F.conv(F.substring(as_col(hex_col), start, width), 16, 10).cast("bigint")


def percent_text(c) -> Column:
    return F.format_string("%.0f%%", as_col(c) * 100)


def power_of_ten_text(c) -> Column:
    """Axis label of a positive bin edge: 10^k."""
    return F.concat(F.lit("10^"), F.log10(as_col(c)).cast("bigint").cast("string"))


def number_text(c, digits: int) -> Column:
    """Significant digits as plain text: '20', '0.23'; no exponent, twelve decimals at most."""
    return F.regexp_replace(signif(c, digits).cast("decimal(38,12)").cast("string"), r"\.?0+$", "")


def packed_interval(med, low, high, digits: int = 2) -> Column:
    """'m (lo - hi)' with significant-digit rounding."""
    parts = [number_text(med, digits), F.lit(" ("), number_text(low, digits), F.lit(" - "), number_text(high, digits), F.lit(")")]
    return F.concat(*parts)


def unpack_interval(c) -> Column:
    """'m (lo - hi)' or 'm,lo,hi' to struct(med, low, high)."""
    plain = F.regexp_replace(F.regexp_replace(as_col(c), r" \(| - ", ","), r"\)", "")
    parts = F.split(plain, ",")
    return F.struct(
        number_or_null(F.get(parts, F.lit(0))).alias("med"),
        number_or_null(F.get(parts, F.lit(1))).alias("low"),
        number_or_null(F.get(parts, F.lit(2))).alias("high"),
    )


def linear_grid(lo, hi, n: int) -> Column:
    """Array of n equally spaced points from lo to hi."""
    lo, hi = as_col(lo), as_col(hi)
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i.cast("double") / F.lit(float(n - 1))
    )


def first_token(c, sep: str = ",") -> Column:
    """First element of a separated list."""
    return F.get(F.split(as_col(c), sep), F.lit(0))


def bin_index(c, breaks) -> Column:
    """Half-open bins (lo, hi] over ascending literal breaks; NULL outside (1-based)."""
    c = as_col(c)
    out = None
    for i in range(len(breaks) - 1):
        test = (c > F.lit(float(breaks[i]))) & (c <= F.lit(float(breaks[i + 1])))
        out = F.when(test, F.lit(i + 1)) if out is None else out.when(test, F.lit(i + 1))
    return out


def cut_index(c, cuts) -> Column:
    """1 + number of interior cut points strictly below the value; NULL stays NULL."""
    c = as_col(c)
    cuts = [F.lit(float(x)) if not isinstance(x, Column) else x for x in cuts]
    idx = reduce(add, [(c > x).cast("int") for x in cuts], F.lit(1))
    return F.when(c.isNotNull(), idx)
