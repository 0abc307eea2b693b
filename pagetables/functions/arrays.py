"""Small array idioms shared by the extractors.

A page is one row, so everything that happens inside one page can be done with
array functions in that row, without an exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def keep_first(items: Column, key: Callable[[Column], Column]) -> Column:
    """Keep the first element of every ``key`` group, in the original order.

    Sorting by (key, position) makes this n log n; ``array_distinct`` on structs
    would compare all pairs.
    """
    tagged = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))

    def firsts(s: Column) -> Column:
        # element_at is 1-based, so position j names the element before s[j]
        return F.filter(s, lambda e, j: F.when(j == 0, True).otherwise(e.k != F.element_at(s, j).k))

    kept = let(F.array_sort(tagged), firsts)
    in_order = F.array_sort(F.transform(kept, lambda e: F.struct(e.i.alias("i"), e.x.alias("x"))))
    return F.transform(in_order, lambda e: e.x)


def cap(items: Column, max_records: int | None) -> Column:
    """First ``max_records`` elements; None, 0 and negative numbers keep all."""
    if max_records and max_records > 0:
        return F.slice(items, 1, max_records)
    return items


def explode_items(rows: DataFrame, items: Column, *kept: str | Column) -> DataFrame:
    """One row (kept columns, i, r) per element, i counting from 0.

    An inner ``posexplode`` makes Catalyst add ``size(items) > 0`` and ``items is not
    null`` below it, which would compute a long expression three times. The outer one
    does not, and rows without elements are dropped after it.
    """
    return rows.select(*kept, F.posexplode_outer(items).alias("i", "r")).where("i is not null")


def keep_rows(rows: DataFrame, condition: Column) -> DataFrame:
    """``rows.where(condition)`` for a condition on columns that are costly to
    compute: a plain filter would be pushed below them and compute them again."""
    whole = F.when(condition, F.array(F.struct(*[F.col(c) for c in rows.columns])))
    return rows.select(F.explode_outer(whole).alias("kept")).where("kept is not null").select("kept.*")
