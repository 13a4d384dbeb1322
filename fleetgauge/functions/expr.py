"""Column expressions used across the operators. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_number(c: str | Column) -> Column:
    """Double with unparsable text and NaN turned into NULL."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def log_level(c: str | Column) -> Column:
    """log1p of the value clipped at zero; NULL stays NULL (`greatest` alone would skip it)."""
    value = col(c)
    return F.when(value.isNotNull(), F.log1p(F.greatest(value, F.lit(0.0))))


def finite_or_zero(c: Column) -> Column:
    """NULL, NaN and the infinities become 0."""
    inf = F.lit(float("inf"))
    return F.when(c.isNotNull() & ~F.isnan(c) & (c != inf) & (c != -inf), c).otherwise(F.lit(0.0))


def digest(*parts) -> Column:
    """Hex md5 of the parts joined by '|'. The same text in any engine, so draws can be replayed."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]).cast("binary"))


def draw(*parts) -> Column:
    """A replayable integer in [0, 2**32)."""
    return F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("bigint")


def unit_draw(*parts) -> Column:
    """A replayable double in [0, 1)."""
    return draw(*parts) / F.lit(4294967296.0)


def ratio(num: Column, den: Column) -> Column:
    """Double division, NULL when the denominator is 0."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def bin_index(value: Column, lo: float, hi: float, bins: int) -> Column:
    """1-based equal-width bin; the upper edge falls into the last bin."""
    raw = F.floor((value - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)).cast("int") + 1
    return F.least(F.greatest(raw, F.lit(1)), F.lit(bins))


def fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded on the exact binary value as C and Python do."""
    return F.call_function("format_number", c, F.lit("0." + "0" * digits))


def pair_corr(a: str | Column, b: str | Column) -> Column:
    """Correlation over rows where both are present; NULL when either does not vary (`corr` would divide by 0)."""
    x, y = col(a).cast("double"), col(b).cast("double")
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
