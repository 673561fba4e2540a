"""Scalar expressions that several operators share."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def per_episode(*order: str | Column):
    """The window of an episode's rows, in the given order if any."""
    w = Window.partitionBy("episode_index")
    return w.orderBy(*order) if order else w


def js_round(c: Column, digits: int = 0) -> Column:
    """Round half up: floor(x + 0.5) at the given digits."""
    k = 10.0**digits
    return F.floor(c * F.lit(k) + F.lit(0.5)) / F.lit(k)


def element(vector: Column, k: int) -> Column:
    """Element ``k`` of a vector; a missing one counts as 0."""
    return F.coalesce(F.get(vector, F.lit(k)), F.lit(0.0))


def norm(a: Column, b: Column, width: int) -> Column:
    """Euclidean distance of two vectors of ``width``; unrolled, so it stays in generated code."""
    d = [element(a, k) - element(b, k) for k in range(width)]
    return F.sqrt(reduce(add, [x * x for x in d]))


def even_position(i: Column, total: Column, target: Column) -> Column:
    """The ``i``-th of ``target`` positions spread evenly over ``total``."""
    return F.floor(i * (total - 1) / F.greatest(target - 1, F.lit(1)) + F.lit(0.5)).cast("bigint")


def finite(c: Column) -> Column:
    """A double, or null where it is not a number or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)
