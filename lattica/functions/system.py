"""Small system-level functions: hashes, paths, addresses, big integers, integer widths, random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the integer encodings, by the largest magnitude each holds.
WIDTHS = ((1, 127), (2, 32767), (4, 2147483647))


def hash64(x: Column, seed: int | None = None) -> Column:
    """XXH64 of a value; a seed is mixed in as a second column."""
    return F.xxhash64(x) if seed is None else F.xxhash64(x, F.lit(seed))


def hash64_ignoring_case(x: Column) -> Column:
    return F.xxhash64(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def is_base_name(path: Column) -> Column:
    """Whether a path is a plain file name."""
    return (path != "") & ~path.contains("/") & ~path.contains("\\")


def absolute_path(path: Column, base: str) -> Column:
    """Joined to ``base`` unless absolute; '.' segments and doubled slashes are removed."""
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def address(ip: Column, port: Column) -> Column:
    """ip:port, IPv6 in brackets."""
    return F.when(ip.contains(":"), F.concat(F.lit("["), ip, F.lit("]:"), port.cast("string"))).otherwise(F.concat(ip, F.lit(":"), port.cast("string")))


def big(x: Column) -> Column:
    """A 38-digit integer."""
    return x.cast("decimal(38,0)")


def big_divide(a: Column, b: Column) -> tuple[Column, Column]:
    """(quotient, remainder), truncating; null for a zero divisor."""
    r = F.when(b != 0, big(a) % big(b))
    return F.when(b != 0, ((big(a) - r) / big(b)).cast("decimal(38,0)")), r


def big_power(base: Column, exponent: int) -> Column:
    out = F.lit(1).cast("decimal(38,0)")
    for _ in range(exponent):
        out = (out * big(base)).cast("decimal(38,0)")
    return out


def int_width(x: Column) -> Column:
    """Bytes of the smallest signed integer that holds a value."""
    out = F.lit(8)
    for size, most in reversed(WIDTHS):
        out = F.when(x.between(-most - 1, most), F.lit(size)).otherwise(out)
    return out


def human_seconds(seconds: Column) -> Column:
    """Four decimals and s, ms, us or ns."""
    from .numbers import fixed

    value, name = seconds * 1e9, F.lit(" ns")
    for unit, factor in (("us", 1e6), ("ms", 1e3), ("s", 1.0)):
        value, name = F.when(seconds >= 1 / factor, seconds * factor).otherwise(value), F.when(seconds >= 1 / factor, F.lit(" " + unit)).otherwise(name)
    return F.concat(fixed(value, 4), name)


def xorshift(x: Column) -> Column:
    """One step of a 64-bit xorshift generator (13, 7, 17): shifts and XOR only, so it cannot overflow."""
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def random_hex(x: Column, digits: int = 16) -> Column:
    """Deterministic pseudo-random hexadecimal digits of a value."""
    return F.substring(F.sha2(x.cast("string").cast("binary"), 256), 1, digits)


def big_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 of two whole numbers of up to 38 digits, whatever their types."""
    x, y = big(a), big(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0).cast("long")
