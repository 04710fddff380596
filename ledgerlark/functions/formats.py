"""Labels for display, as Column expressions. Figures that are compared or computed with stay unformatted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_BITS = 1 << 40


def _parts(x: Column, digits: int) -> tuple[Column, Column]:
    """Whole part and decimals (as a whole number) of |x|, rounded from its exact binary value, halves away from zero.

    The fraction of a double that is not too small to round to 0 has at most 80
    binary places, so it is read as two whole numbers of 40 bits and rounded in
    whole numbers.
    """
    size = F.abs(x.cast("double"))
    whole = F.floor(size)
    fraction = size - whole
    high = F.floor(fraction * float(_HALF_BITS))
    low = F.floor((fraction * float(_HALF_BITS) - high) * float(_HALF_BITS))
    big = lambda c: c.cast("decimal(38,0)")
    number = (big(high) * big(F.lit(_HALF_BITS)) + big(low)) * big(F.lit(10**digits))
    one = F.lit(str(_HALF_BITS**2)).cast("decimal(38,0)")
    number = number + F.lit(str(_HALF_BITS**2 // 2)).cast("decimal(38,0)")
    rounded = ((number - number % one) / one).cast("bigint")
    over = rounded >= 10**digits
    return whole + over.cast("bigint"), F.when(over, 0).otherwise(rounded)


def fixed(x: Column, digits: int) -> Column:
    """A number with a fixed count of decimals (3 at most); a negative one that rounds to 0 keeps its sign. Null and NaN: null."""
    whole, part = _parts(x, digits)
    body = F.concat(whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), digits, "0")) if digits else whole.cast("string")
    return F.when(~F.isnan(x.cast("double")), F.concat(F.when(x < 0, "-").otherwise(""), body))


def grouped(x: Column, least: int = 0, most: int = 3) -> Column:
    """A number with thousands grouping and between `least` and `most` decimals. Null and NaN: null."""
    whole, part = _parts(x, most)
    body = F.format_number(whole, 0)
    if most:
        digits = F.lpad(part.cast("string"), most, "0")
        digits = F.rpad(F.rtrim(digits, F.lit("0")), least, "0") if least else F.rtrim(digits, F.lit("0"))
        digits = F.when(F.length(F.rtrim(F.lpad(part.cast("string"), most, "0"), F.lit("0"))) > least, F.rtrim(F.lpad(part.cast("string"), most, "0"), F.lit("0"))).otherwise(digits)
        body = F.concat(body, F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""))
    return F.when(~F.isnan(x.cast("double")), F.concat(F.when(x < 0, "-").otherwise(""), body))


def dollars(x: Column, least: int = 0, most: int = 3, sign_first: bool = True) -> Column:
    """US dollars with grouping; the sign stands before the $ or after it."""
    if not sign_first:
        return F.concat(F.lit("$"), grouped(x, least, most))
    return F.concat(F.when(x < 0, "-$").otherwise("$"), grouped(F.abs(x), least, most))


def signed_percent(x: Column, digits: int = 2) -> Column:
    """A percentage with a plus sign from 0 on."""
    return F.concat(F.when(x >= 0, "+").otherwise(""), fixed(x, digits), F.lit("%"))


def iso_day(instant: Column) -> Column:
    """The date of an instant in ISO form, which is what stands before its T."""
    return F.to_date(F.split(instant, "T")[0])


def month_day(d: Column) -> Column:
    """A date as in "Aug 26"."""
    return F.date_format(d, "MMM d")


def clock(t: Column) -> Column:
    """The time of an instant, for display."""
    return F.date_format(t, "h:mm:ss a")
