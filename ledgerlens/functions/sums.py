"""Sums of doubles that do not depend on the order of addition, for values of any size.

A finite double is split into a group of 16 binary exponents and two whole numbers, which
add up without rounding. One number per group of exponents is left, at most some 130 for
any number of rows; these few are added with compensation. Null and non-finite values
have no part in a sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 16  # binary exponents in one group
HIGH_BITS, LOW_BITS = 20, 40  # fraction bits of the first number, and those after them
WHOLE = "decimal(20,0)"


def _scaled(value: Column, group: Column) -> Column:
    """value * 2 ** (WIDTH * group), in two steps so that the factor is in range."""
    half = F.pow(F.lit(2.0), group * (WIDTH // 2))
    return value * half * half


def split(value: Column) -> Column:
    """The double as struct(band, high, low); null for null, NaN and infinities."""
    band = F.coalesce(F.floor(F.log2(F.abs(value)) / WIDTH), F.lit(0)).cast("int")
    shifted = _scaled(value, -band) * float(2**HIGH_BITS)
    high = F.floor(shifted)
    low = (shifted - high.cast("double")) * float(2**LOW_BITS)
    parts = F.struct(band.alias("band"), high.cast(WHOLE).alias("high"), low.cast(WHOLE).alias("low"))
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(finite, parts)


def grouped(df: DataFrame, keys: list[str], value: Column, name: str, counts: dict[str, Column]) -> DataFrame:
    """Per key the parts of the sum of `value` as array `name`, and the sums of `counts`."""
    banded = df.withColumn("_parts", split(value)).groupBy(*keys, F.col("_parts.band").alias("_band")).agg(
        F.sum("_parts.high").alias("_high"), F.sum("_parts.low").alias("_low"), *[F.sum(c.cast("long")).alias(n) for n, c in counts.items()]
    )
    part = F.struct(F.col("_band").alias("band"), F.col("_high").alias("high"), F.col("_low").alias("low"))
    return banded.groupBy(*keys).agg(
        F.collect_list(F.when(F.col("_band").isNotNull(), part)).alias(name), *[F.sum(n).alias(n) for n in counts]
    )


def total(parts: Column, less: Column | None = None) -> Column:
    """The parts as one double, without the value `less` where that is given; 0 for no parts."""

    def terms(p: Column, sign: float) -> Column:
        shift = float(2.0**-HIGH_BITS) * sign
        return F.array(
            _scaled(p["high"].cast("double") * shift, p["band"]),
            _scaled(p["low"].cast("double") * (shift * float(2.0**-LOW_BITS)), p["band"]),
        )

    numbers = F.flatten(F.transform(F.array_sort(parts), lambda p: terms(p, 1.0)))
    if less is not None:
        own = split(less)
        numbers = F.concat(numbers, F.when(own.isNotNull(), terms(own, -1.0)).otherwise(F.array().cast("array<double>")))

    def add(state: Column, x: Column) -> Column:
        s, lost = state["s"], state["lost"]
        t = s + x
        gap = F.when(F.abs(s) >= F.abs(x), (s - t) + x).otherwise((x - t) + s)
        return F.struct(t.alias("s"), (lost + gap).alias("lost"))

    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("lost"))
    return F.aggregate(numbers, start, add, lambda state: state["s"] + state["lost"])


def steady(value: Column) -> Column:
    """The value to 15 significant digits, to be rounded to one or two decimals next.

    A half then stays a half, whatever was added before it. From 1e12 on these digits do not
    reach below two decimals, where the value stays as it is. The formatter rounds the shortest
    decimal that names a double; where that ends in a 5 just behind the digits kept, the true
    value of the double decides, by its product with a power of ten and that product's error.
    """

    def halves(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    def judged(p: Column) -> Column:
        a, scale = p["size"], p["scale"]
        (ah, al), (sh, sl) = halves(a), halves(scale)
        error = ((ah * sh - a * scale) + ah * sl + al * sh) + al * sl
        whole = F.floor(a * scale).cast("long")
        rest = a * scale - whole
        down = (rest < 0.5) | ((rest == 0.5) & ((error < 0) | ((error == 0) & (whole % 2 == 0))))
        return F.when(down, p["sign"] * (whole.cast("double") / scale))

    digits = F.format_string("%.16e", F.abs(value))  # d.dddddddddddddd, two more digits, the exponent
    places = 14 - F.substring_index(digits, "e", -1).try_cast("int")
    tie = (F.substring(digits, 17, 2) == "50") & places.between(0, 22)  # powers of ten that are exact doubles
    parts = F.struct(F.abs(value).alias("size"), F.pow(F.lit(10.0), places.cast("double")).alias("scale"), F.signum(value).alias("sign"))
    below = F.when(tie, F.transform(F.array(parts), judged)[0])
    rounded = F.coalesce(below, F.format_string("%.14e", value).cast("double"))
    return F.when(F.abs(value) < 1e12, rounded).otherwise(value)
