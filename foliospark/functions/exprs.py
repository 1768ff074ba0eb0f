"""Column builders: numbers, vectors, bins and axes. All stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def is_number(c: Column) -> Column:
    """Neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a, b)


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, lo if isinstance(lo, Column) else F.lit(lo)), hi if isinstance(hi, Column) else F.lit(hi))


def half_up(c: Column, places: int = 1) -> Column:
    """Rounds halves upwards, also below zero."""
    scale = 10.0**places
    return F.floor(c * scale + 0.5) / scale


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def bin_index(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """0-based bin of n equal ones; values outside go to the nearest bin."""
    return clamp(F.floor((v - lo) / (hi - lo) * n), 0, n - 1).cast("int")


def unit_bin(v: Column, n: int) -> Column:
    """1-based bin of n equal ones over [0, 1], the last closed; null outside."""
    return F.when(v.between(0.0, 1.0), F.least(F.lit(n), (F.floor(v * n) + 1))).cast("int")


def tick_step(lo: Column, hi: Column, n: int) -> Column:
    """Distance of about n ticks: 1, 2, 5 or 10 times a power of ten; null for an empty span."""
    raw = (hi - lo) / n
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    err = raw / base
    return F.when(hi > lo, base * F.when(err >= 7.5, 10).when(err >= 3.5, 5).when(err >= 1.5, 2).otherwise(1))


def ticks(lo: Column, hi: Column, n: int) -> Column:
    """The multiples of the step from lo to hi; both ends for an empty span."""
    step = tick_step(lo, hi, n)
    some = F.transform(F.sequence(F.ceil(lo / step), F.floor(hi / step + 1e-6)), lambda k: k * step)
    return F.when(hi > lo, some).otherwise(F.array(lo, hi))


def scaled(v: Column, domain: tuple, extent: tuple) -> Column:
    """v carried linearly from the domain to the extent; null for an empty domain. With both swapped it is the inverse."""
    (d0, d1), (r0, r1) = ([c if isinstance(c, Column) else F.lit(float(c)) for c in x] for x in (domain, extent))
    return r0 + F.try_divide(v - d0, d1 - d0) * (r1 - r0)


def pushed_out(axes: list[Column], by: float) -> list[Column]:
    """A point moved away from the origin by a distance; the origin itself moves along the first axis."""
    norm = F.sqrt(sum((a * a for a in axes[1:]), axes[0] * axes[0]))
    return [F.when(norm == 0, F.lit(by if i == 0 else 0.0)).otherwise(a * (1 + by / norm)) for i, a in enumerate(axes)]


def compact(c: Column) -> Column:
    """Short text of a number: thousands as k, below 0.001 one digit and a power of ten, else up to three places."""
    a = F.abs(c)
    plain = lambda v: F.regexp_replace(v.cast("string"), r"\.0$", "")
    exponent = F.floor(F.log10(a)).cast("int")
    tiny = F.concat(F.round(c / F.pow(F.lit(10.0), exponent)).cast("int").cast("string"), F.lit("e"), exponent.cast("string"))
    return F.when(a >= 1000, F.concat(plain(c / 1000), F.lit("k"))).when((a < 0.001) & (a > 0), tiny).otherwise(plain(half_up(c, 3)))


def percent(c: Column, places: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{places}f", c), F.lit("%"))


def portable_hash(id_: Column) -> Column:
    """One step of the 32-bit linear congruential generator over an id, the same in any engine."""
    return F.pmod(id_ * F.lit(1664525) + F.lit(1013904223), F.lit(4294967296))
