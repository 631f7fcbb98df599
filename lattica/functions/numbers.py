"""Numeric parsing, formatting and estimates as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)
#: Unit names and their factors.
UNITS = {"b": 1, "k": 10**3, "kb": 10**3, "m": 10**6, "mb": 10**6, "g": 10**9, "gb": 10**9, "t": 10**12, "tb": 10**12, "kib": 1 << 10, "mib": 1 << 20, "gib": 1 << 30, "tib": 1 << 40}


def parse_long(s: Column) -> Column:
    """A whole decimal integer, else null (also when it does not fit)."""
    return F.when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("bigint"))


def parse_double(s: Column) -> Column:
    return F.when(s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), s.try_cast("double"))


def digit_count(n: Column) -> Column:
    return F.char_length(F.regexp_replace(n.cast("string"), "^-", "")).cast("long")


def to_long_saturating(d: Column) -> Column:
    """Truncation toward zero, held at the ends of the 64-bit range; NaN gives 0."""
    return F.when(F.isnan(d), F.lit(0)).when(d >= float(LONG_MAX), F.lit(LONG_MAX)).when(d <= float(LONG_MIN), F.lit(LONG_MIN)).otherwise(F.when(F.abs(d) < float(LONG_MAX), d).cast("long"))


def human_to_bytes(s: Column) -> Column:
    """'12GB', '12 GB' and the like as a number of bytes; null for anything else."""
    number, unit = F.regexp_extract(s, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]*)\s*$", 1), F.lower(F.regexp_extract(s, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*([a-zA-Z]*)\s*$", 2))
    factor = F.lit(None).cast("bigint")
    for name, value in UNITS.items():
        factor = F.when(unit == name, F.lit(value).cast("bigint")).otherwise(factor)
    factor = F.when(unit == "", F.lit(1).cast("bigint")).otherwise(factor)
    return F.when(number != "", F.round(F.try_multiply(number.try_cast("double"), factor.cast("double")))).cast("bigint")


BINARY_UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB")


def bytes_to_human(n: Column, largest: str = BINARY_UNITS[-1]) -> Column:
    """Five decimals and a binary unit, up to ``largest``."""
    value, unit = n.cast("double"), F.lit(" B")
    for k, name in enumerate(BINARY_UNITS[: BINARY_UNITS.index(largest) + 1], 1):
        value, unit = F.when(n >= 1 << (10 * k), n / float(1 << (10 * k))).otherwise(value), F.when(n >= 1 << (10 * k), F.lit(" " + name)).otherwise(unit)
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).otherwise(F.concat(fixed(value, 5), unit))


def fixed(x: Column, digits: int) -> Column:
    """A double's exact value rounded to ``digits`` decimals, half to even, as C's printf does.

    A double below 10 ** 9 in magnitude is a whole number of 2 ** -52 parts of its floor's remainder, so
    the part after the point times 2 ** 52 is exact and the comparison with one half is one of whole numbers.
    """
    size, unit = F.abs(x), 10**digits
    whole = F.floor(size)
    parts = ((size - whole) * float(1 << 52)).cast("decimal(38,0)") * unit  # exact below 2 ** 53 * unit
    low = F.call_function("div", parts, F.lit(1 << 52)).cast("decimal(38,0)")
    rest = parts - low * (1 << 52)
    up = (rest > 1 << 51) | ((rest == 1 << 51) & (low % 2 == 1))
    total = whole.cast("decimal(38,0)") * unit + low + up.cast("int")
    text = F.lpad(total.cast("decimal(38,0)").cast("string"), F.greatest(F.char_length(total.cast("decimal(38,0)").cast("string")), F.lit(digits + 1)), F.lit("0"))
    head, tail = F.substr(text, F.lit(1), F.char_length(text) - digits), F.right(text, F.lit(digits))
    return F.concat(F.when(x < 0, "-").otherwise(""), head, F.lit("."), tail)


def log_estimate(n: Column) -> Column:
    """Ten times log2, rounded; 0 for 0 and 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.round(F.log2(n.cast("double")) * 10)).cast("bigint")


def ten_power(k: Column) -> Column:
    """10 ** k, exact, for 0 to 37; else null."""
    return F.when(k.between(0, 37), F.rpad(F.lit("1"), (k + 1).cast("int"), F.lit("0"))).cast("decimal(38,0)")


def parse_unsigned(s: Column) -> Column:
    """A whole number from 0 to 2 ** 64 - 1, else null."""
    n = F.when(s.rlike("^[0-9]+$"), s.try_cast("decimal(38,0)"))
    return F.when(n < F.lit(str(1 << 64)).cast("decimal(38,0)"), n)


def parse_radix(s: Column) -> Column:
    """Whole numbers with a prefix: 0x hexadecimal, 0 octal; else decimal."""
    digits = lambda skip, radix: F.conv(F.substr(s, F.lit(skip + 1)), radix, 10).cast("decimal(20,0)").try_cast("bigint")
    return F.when(s.rlike("^0[xX][0-9a-fA-F]{1,16}$"), digits(2, 16)).when(s.rlike("^0[0-7]{1,21}$"), digits(1, 8)).otherwise(parse_long(s))


def parse_any_double(s: Column) -> Column:
    """As parse_double, and the words inf, infinity and nan in any case, signed."""
    word = F.lower(s)
    named = F.when(word.rlike(r"^\+?inf(inity)?$"), F.lit(float("inf"))).when(word.rlike("^-inf(inity)?$"), F.lit(float("-inf"))).when(word.rlike("^[+-]?nan$"), F.lit(float("nan")))
    return F.coalesce(named, parse_double(s))


def is_lossless(d: Column) -> Column:
    """Whether a double is a whole number that a 64-bit integer holds."""
    return F.coalesce(~F.isnan(d) & (F.abs(d) < float(LONG_MAX)) & (d == F.when(F.abs(d) < float(LONG_MAX), d).cast("bigint").cast("double")), F.lit(False))


def compare_exact(whole: Column, real: Column) -> Column:
    """-1, 0 or 1 of a 64-bit integer against a double, by value without loss; below NaN."""
    held = to_long_saturating(real)
    part = real - held.cast("double")
    inside = F.when(whole < held, -1).when(whole > held, 1).when(part > 0, -1).when(part < 0, 1).otherwise(0)
    return F.when(F.isnan(real) | (real >= float(LONG_MAX)), -1).when(real < float(LONG_MIN), 1).otherwise(inside).cast("long")


def log_add(a: Column, b: Column) -> Column:
    """The estimate of the sum of two numbers whose tenfold log2 estimates are given."""
    return F.round(F.greatest(a, b) + 10 * F.log2(1 + F.pow(F.lit(2.0), -F.abs(a - b) / 10.0))).cast("bigint")


def log_inverse(e: Column) -> Column:
    """The number of an estimate, rounded."""
    return F.round(F.pow(F.lit(2.0), e / 10.0)).cast("bigint")


@F.pandas_udf(T.LongType())
def half_encode(v: pd.Series) -> pd.Series:
    """The 16 bits of the nearest half-precision float; null stays null."""
    with np.errstate(over="ignore", invalid="ignore"):
        bits = pd.Series(v.to_numpy(np.float32).astype(np.float16).view(np.uint16).astype(np.int64))
    return bits.astype("Int64").mask(v.isna().to_numpy())


@F.pandas_udf(T.DoubleType())
def half_decode(v: pd.Series) -> pd.Series:
    out = pd.Series(v.fillna(0).to_numpy(np.int64).astype(np.uint16).view(np.float16).astype(np.float64))
    return out.astype("Float64").mask(v.isna().to_numpy())


@F.pandas_udf(T.LongType())
def brain_encode(v: pd.Series) -> pd.Series:
    """The 16 high bits of a single-precision float, rounded half to even; null stays null."""
    x = v.to_numpy(np.float32).view(np.uint32).astype(np.int64)
    bits = np.where((x & 0x7FFFFFFF) > 0x7F800000, (x >> 16) | 0x40, (x + 0x7FFF + ((x >> 16) & 1)) >> 16)
    return pd.Series(bits).astype("Int64").mask(v.isna().to_numpy())


@F.pandas_udf(T.DoubleType())
def brain_decode(v: pd.Series) -> pd.Series:
    out = pd.Series((v.fillna(0).to_numpy(np.int64).astype(np.uint32) << 16).view(np.float32).astype(np.float64))
    return out.astype("Float64").mask(v.isna().to_numpy())
