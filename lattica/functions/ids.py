"""Sortable identifiers: time in the high bits, random or sequence bits below, base-36 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (unit in nanoseconds, time bits, random bits) of the 64- and 32-bit layouts.
LAYOUTS = {"ms64": (10**6, 44, 20), "us64": (10**3, 54, 10), "s64": (10**9, 35, 29), "ms32": (10**6, 26, 6), "s32": (10**9, 22, 10)}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def compose(ts_ns: Column, random: Column, layout: str) -> Column:
    unit, time_bits, random_bits = LAYOUTS[layout]
    ticks = F.pmod(F.call_function("div", ts_ns, F.lit(unit)), F.lit(1 << min(time_bits, 62 - random_bits)))
    return F.shiftleft(ticks, random_bits).bitwiseOR(F.pmod(random, F.lit(1 << random_bits)))


def ticks(value: Column, layout: str) -> Column:
    return F.shiftright(value, LAYOUTS[layout][2])


def random_part(value: Column, layout: str) -> Column:
    return value.bitwiseAND(F.lit((1 << LAYOUTS[layout][2]) - 1))


def base36(value: Column, width: int = 13) -> Column:
    """Fixed-width upper-case base 36 of a non-negative long; its order is the numbers' order."""
    return F.lpad(F.conv(value.cast("string"), 10, 36), width, "0")


def from_base36(text: Column) -> Column:
    return F.conv(text, 36, 10).cast("long")


def wide(ts_ns: Column, random: Column) -> Column:
    """128 bits as 32 hexadecimal digits: nanoseconds, then 64 random bits."""
    return F.concat(F.lpad(F.hex(ts_ns), 16, "0"), F.lpad(F.hex(random), 16, "0"))


def wide_ts(text: Column) -> Column:
    return F.conv(F.substring(text, 1, 16), 16, 10).cast("long")


def interleave(a: Column, b: Column, bits: int = 20) -> Column:
    """Bits of two numbers in turn, a's above b's."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(a, k).bitwiseAND(F.lit(1)), 2 * k + 1)).bitwiseOR(F.shiftleft(F.shiftright(b, k).bitwiseAND(F.lit(1)), 2 * k))
    return out


def text_width(layout: str) -> int:
    """Base-36 digits of a layout."""
    return 13 if layout.endswith("64") else 7


def most_ticks(layout: str) -> int:
    return (1 << LAYOUTS[layout][1]) - 1


def fits(ts_ns: Column, layout: str) -> Column:
    """Whether a layout holds a time without wrapping around."""
    unit = LAYOUTS[layout][0]
    return (ts_ns >= 0) & (F.call_function("div", ts_ns, F.lit(unit)) <= F.lit(most_ticks(layout)))


def is_null_id(value: Column) -> Column:
    """Whether an id is the null id, all bits 0, or missing."""
    return value.isNull() | (value == 0)


def deinterleave(z: Column, bits: int = 20) -> tuple[Column, Column]:
    """The two numbers whose bits ``interleave`` put in turn."""
    a = b = F.lit(0).cast("long")
    for k in range(bits):
        a = a.bitwiseOR(F.shiftleft(F.shiftright(z, 2 * k + 1).bitwiseAND(F.lit(1)), k))
        b = b.bitwiseOR(F.shiftleft(F.shiftright(z, 2 * k).bitwiseAND(F.lit(1)), k))
    return a, b


def dual(first_ns: Column, second_ns: Column) -> Column:
    """Two times as 32 hexadecimal digits, the first one above."""
    return F.concat(F.lpad(F.hex(first_ns), 16, "0"), F.lpad(F.hex(second_ns), 16, "0"))
