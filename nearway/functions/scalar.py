"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def round_half_up(x: Column) -> Column:
    """The nearest whole number, halves up (also below zero)."""
    return F.floor(x + 0.5).cast("long")


def is_integer(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[+-]?[0-9]+$") & text.try_cast("int").isNotNull(), F.lit(False))


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH-mm-ss")


def random_int(low: int, high: int, seed: int, *keys: Column | str) -> Column:
    """A whole number from low to high (inclusive) that the keys and the seed fix."""
    return (F.pmod(F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(seed)), F.lit(high - low + 1)) + low).cast("long")


def random_double(seed: int, *keys: Column | str) -> Column:
    """A number in [0, 1) that the keys and the seed fix."""
    return F.pmod(F.xxhash64(*[F.col(k) if isinstance(k, str) else k for k in keys], F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def half_normal(deviation: float, scale: float, seed: int, *keys: Column | str) -> Column:
    """The magnitude of a normal number that the keys and the seed fix."""
    u, v = random_double(seed, *keys), random_double(seed + 1, *keys)
    return F.abs(F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * F.pi() * v)) * deviation * scale


def objects_that_fit(length: Column, spacing: Column) -> Column:
    """How many objects an edge can have with at least that spacing, and as much at both ends; none if it is shorter."""
    return F.greatest(F.floor(length / spacing) - 1, F.lit(0)).cast("long")


def key_of_value(m: Column, value: Column) -> Column:
    """The least key of a map with that value."""
    return F.array_min(F.map_keys(F.map_filter(m, lambda _, v: v == value)))


def first_key(m: Column) -> Column:
    return F.array_min(F.map_keys(m))


def last_key(m: Column) -> Column:
    return F.array_max(F.map_keys(m))


def second_least(values: Column) -> Column:
    """The second of the different values of an array; null if there aren't two."""
    return F.try_element_at(F.array_sort(F.array_distinct(values)), F.lit(2))
