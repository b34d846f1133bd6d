"""Distinct texts held within an aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def held_values(text: Column, distinct: int) -> Column:
    """Aggregate: the distinct texts, all of them as long as there are no more than six times the limit; a null counts as
    one."""
    return F.call_function("approx_top_k", text, F.lit(distinct + 2), F.lit(8 * distinct))


def few_values(held: Column, about: Column, distinct: int) -> Column:
    """The sorted values where there are at most ``distinct``, else null. about: their estimated number, which tells
    whether all are held."""
    values = F.array_sort(F.filter(F.transform(held, lambda h: h["item"]), lambda v: v.isNotNull()))
    none = F.when(about == 0, F.array().cast("array<string>"))
    return F.when((about > 0) & (about <= 2 * distinct) & (F.size(values) <= distinct), values).otherwise(none)
