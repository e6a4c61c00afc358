"""Number formatting, rounding and the cutting / printing formulas as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------------
EFFECTIVE_VOLUME_FRACTION = 0.25
SECONDS_PER_MINUTE = 60
# ---------------------------------------------------------------------------------------------


def fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of digits, half-even on the binary value; null gives null.

    ``round`` and ``bround`` work on the decimal spelling of a double and differ at ties such as
    2.675; ``format_number`` looks at the binary value.
    """
    return F.regexp_replace(F.format_number(c.cast("double"), digits), ",", "")


def exact_round(c: Column, digits: int) -> Column:
    return fixed(c, digits).cast("double") + F.lit(0.0)


def short(c: Column) -> Column:
    """Six significant digits without trailing zeros, exponents below 1e-4 and from 1e6 on (C's ``%g``).

    The rounded number decides: 9.999999e-5 becomes 0.0001.
    """
    x = c.cast("double")
    size = F.abs(x)
    digits = (5 - F.floor(F.log10(size))).cast("int")
    plain = F.regexp_replace(F.call_function("format_number", x, digits), ",", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    exponent = F.floor(F.log10(size))
    large = F.format_number(size / F.pow(F.lit(10.0), exponent - 5), 0)
    small = F.regexp_replace(F.call_function("format_number", size, digits), r"^0\.0*", "")
    six = F.regexp_replace(F.when(exponent > 0, large).otherwise(small), ",", "")
    carried = F.when(F.length(six) > 6, exponent + 1).otherwise(exponent)  # 9999995 became 1000000
    mantissa = F.concat(F.substring(six, 1, 1), F.lit("."), F.substring(six, 2, 5))
    power = F.concat(
        F.when(x < 0, "-").otherwise(""), F.regexp_replace(mantissa, r"\.?0*$", ""),
        F.when(carried < 0, "e-").otherwise("e+"), F.when(F.abs(carried) < 10, "0").otherwise(""), F.abs(carried).cast("string"),
    )
    special = F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x < 0, "-inf").otherwise("inf")).when(size == 0, "0")
    return special.when((carried >= -4) & (size < 999999.5), plain).when(x.isNotNull(), power)


def span(low: Column, high: Column, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), short(low), F.lit("-"), short(high))


def cutting_speed(cv: Column, life: Column, m: Column, depth: Column, xv: Column, feed: Column, yv: Column, kv: Column) -> Column:
    return cv / (F.pow(life, m) * F.pow(depth, xv) * F.pow(feed, yv)) * F.coalesce(kv, F.lit(1.0))


def spindle_speed(speed: Column, diameter: Column) -> Column:
    return 1000 * speed / (F.lit(math.pi) * diameter)


def middle(low: Column, high: Column) -> Column:
    return (low + high) / 2


def effective_volume(x: Column, y: Column, z: Column) -> Column:
    return x * y * z * EFFECTIVE_VOLUME_FRACTION
