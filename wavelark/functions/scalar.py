"""Column functions that the operators share. Spark runs in ANSI mode: nothing here divides by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pearson(x: Column, y: Column, over=None) -> Column:
    """Correlation as an aggregate, or over a window; null if either side is constant. (corr() would raise.)"""
    cov, sx, sy = F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)
    if over is not None:
        cov, sx, sy = cov.over(over), sx.over(over), sy.over(over)
    return cov / F.nullif(sx * sy, F.lit(0.0))


def decibel(x: Column, floor: float = 1e-10) -> Column:
    return 10 * F.log10(x + F.lit(floor))


def clip_low(x: Column, low: float = 0.0) -> Column:
    """x, but `low` where it is less; null stays null."""
    return F.when(x < low, F.lit(low)).otherwise(x)


def text_name(x: Column) -> Column:
    """The first word of a channel name such as `S1_D1 hbo`."""
    return F.regexp_extract(x, r"^\s*(\S+)", 1)


def md5_mod(x: Column, n: int) -> Column:
    """The whole 128-bit MD5 number modulo n, digit by digit."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: F.conv(F.substring(F.md5(x.cast("binary")), i, F.lit(1)), 16, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 16 + d) % n)


def md5_rgb(x: Column) -> list[Column]:
    """Red, green and blue from 0 to 1: the first three bytes of the MD5."""
    return [F.conv(F.substring(F.md5(x.cast("binary")), 2 * k + 1, 2), 16, 10).cast("double") / 255 for k in range(3)]


def hash_uniform(*parts: Column) -> Column:
    """A reproducible number in [0, 1): the first 32 bits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def stars(q: Column) -> Column:
    return F.when(q < 0.01, "**").when(q < 0.05, "*").otherwise("")


def unit_scale(distance: Column) -> Column:
    """Metres a unit, told from the distance between two ears; an unusual distance is an error."""
    told = F.when(distance.between(0.1, 0.2), 1.0).when(distance.between(10, 20), 0.01).when(distance.between(100, 200), 0.001)
    return F.when(told.isNotNull(), told).otherwise(F.raise_error(F.concat(F.lit("unusual distance: "), distance.cast("string"))).cast("double"))


def label_rank(label: Column, order: list[str]) -> Column:
    """The place of a label in a fixed order, from 0; null for others."""
    out = F.lit(None).cast("int")
    for k, name in enumerate(order):
        out = F.when(label == name, k).otherwise(out)
    return out


def at_least(x: Column, floor: float) -> Column:
    """x, or null where it is below the floor."""
    return F.when(x >= floor, x)


def in_any(x: Column, stretches: list[tuple[float, float]]) -> Column:
    """Whether x lies in any of the stretches, ends included: the union of closed intervals."""
    return F.exists(F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in stretches)), lambda i: x.between(i["a"], i["b"]))


def integer_ticks(start: Column, end: Column, ideal: int = 5) -> Column:
    """model.integer_ticks as a column: an array of whole numbers."""
    low, high = F.floor(start).cast("int"), F.ceil(end).cast("int")
    raw = F.floor((high - low) / F.lit(ideal - 1)).cast("int")
    step = F.when(raw <= 1, 1).when(raw <= 2, 2).when(raw <= 5, 5).when(raw <= 10, 10).otherwise((F.bround(raw / 10) * 10).cast("int"))
    return F.when(high <= low, F.array(low)).otherwise(F.transform(F.sequence(F.lit(0), F.ceil((high - low) / step).cast("int")), lambda k: low + k * step))
