"""Array columns as small sequences: search, push, insert, replace and delete as Column expressions.

Positions are 0-based; a negative one counts from the end. A position outside the array
finds nothing (null) and changes nothing. A null array stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _at(a: Column, pos: int | Column) -> Column:
    """The position from the front; null outside the array."""
    p = F.lit(pos) if isinstance(pos, int) else pos
    p = F.when(p < 0, F.size(a) + p).otherwise(p)
    return F.when((p >= 0) & (p < F.size(a)), p)


def get(a: Column, pos: int | Column) -> Column:
    return F.get(a, _at(a, pos))


def find(a: Column, value, skip: int = 0, start: int = 0) -> Column:
    """First position of a value among every (skip + 1)-th item from ``start`` on; null if absent."""
    places = F.filter(F.sequence(F.lit(start), F.greatest(F.size(a) - 1, F.lit(start))), lambda i: ((i - start) % (skip + 1) == 0) & (F.get(a, i) == value))
    return F.when(F.size(a) > start, F.get(places, F.lit(0)))


def find_last(a: Column, value) -> Column:
    p = F.array_position(F.reverse(a), value)
    return F.when(p > 0, F.size(a) - p)


def first_at_or_after(a: Column, value) -> Column:
    """Position of the first item of a sorted array that is not below a value; the size if all are."""
    return F.size(F.filter(a, lambda x: x < value))


def push_tail(a: Column, *values) -> Column:
    return F.concat(a, F.array(*values))


def push_head(a: Column, *values) -> Column:
    """The last value given comes first, as when they are pushed one by one."""
    return F.concat(F.array(*reversed(values)), a)


def insert(a: Column, pos: int | Column, *values) -> Column:
    """Before the item at ``pos``; the size itself appends."""
    p = F.lit(pos) if isinstance(pos, int) else pos
    p = F.when(p < 0, F.size(a) + p).otherwise(p)
    made = F.concat(F.slice(a, F.lit(1), p), F.array(*values), F.slice(a, p + 1, F.greatest(F.size(a) - p, F.lit(0))))
    return F.when((p >= 0) & (p <= F.size(a)), made).otherwise(a)


def insert_sorted(a: Column, value) -> Column:
    """Into a sorted array, before equal items."""
    return insert(a, first_at_or_after(a, value), value)


def replace(a: Column, pos: int | Column, value) -> Column:
    p = _at(a, pos)
    return F.transform(a, lambda x, i: F.when(i == p, F.lit(value) if not isinstance(value, Column) else value).otherwise(x))


def increment(a: Column, pos: int | Column, by) -> Column:
    p = _at(a, pos)
    return F.transform(a, lambda x, i: F.when(i == p, x + by).otherwise(x))


def delete(a: Column, pos: int | Column, n: int = 1) -> Column:
    """Without ``n`` items from ``pos`` on."""
    p = _at(a, pos)
    return F.when(p.isNull(), a).otherwise(F.filter(a, lambda x, i: (i < p) | (i >= p + n)))


def delete_head(a: Column, n: int) -> Column:
    return F.filter(a, lambda x, i: i >= n)


def delete_tail(a: Column, n: int) -> Column:
    size = F.size(a)
    return F.filter(a, lambda x, i: i < size - n)


def split(a: Column, pos: int) -> tuple[Column, Column]:
    """Items before and from ``pos`` on."""
    return F.filter(a, lambda x, i: i < pos), F.filter(a, lambda x, i: i >= pos)


def intersect_sorted(a: Column, b: Column) -> Column:
    """Common distinct items, in order."""
    return F.sort_array(F.array_intersect(a, b))


def merge_sorted(a: Column, b: Column) -> Column:
    """All items of both, in order, with repeats."""
    return F.sort_array(F.concat(a, b))
