"""Tables inside tables, read in the page's own row.

The rows of an inner table also count as rows of every table around it, and the text of
a cell includes the text of the tables in it. So a row is an interval of the page's cells, a
table an interval of its rows: ``read_tables`` numbers the tags where elements begin and
end, and keeps each cell once. What a table shows of its rows is decided on intervals;
cells are copied when a row is handed out, one row at a time.

``read_tables`` is a small helper over the structural tags of one page; only pages with nested
tables pass any to it. Names, widths and cleaning are column expressions, the same as
for other pages.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TABLE = frozenset(("table", "/table"))
_SECTION = _TABLE | frozenset(("thead", "/thead", "tbody", "/tbody", "tfoot", "/tfoot"))
_ROW = _SECTION | frozenset(("tr", "/tr"))
_CELL = _ROW | frozenset(("td", "/td", "th", "/th"))
_ENDS = {"table": _TABLE, "thead": _SECTION, "tbody": _SECTION, "tr": _ROW, "td": _CELL, "th": _CELL}
_NEVER = 2**31 - 1

_INTERVAL = [("first", pa.int32()), ("n", pa.int32())]
TABLES_TYPE = pa.struct(
    [
        ("cells", pa.list_(pa.struct([("is_th", pa.bool_()), ("text", pa.string())]))),
        ("rows", pa.list_(pa.struct(_INTERVAL))),
        ("tables", pa.list_(pa.struct([("table_no", pa.int64()), ("head", pa.struct(_INTERVAL)), ("rows", pa.struct(_INTERVAL))]))),
    ]
)
SPARK_TYPE = (
    "struct<cells: array<struct<is_th: boolean, text: string>>, rows: array<struct<first: int, n: int>>, "
    "tables: array<struct<table_no: bigint, head: struct<first: int, n: int>, rows: struct<first: int, n: int>>>>"
)


def _levels(elements: list[str]) -> list[int]:
    """Nesting level of each tag; closing tags without an open table do not count."""
    out, run, low = [], 0, 0
    for e in elements:
        run += (e == "table") - (e == "/table")
        low = min(low, run)
        out.append(run - low + (e == "/table"))
    return out


def _ends(elements: list[str], levels: list[int]) -> list[int]:
    """Where each element ends: at the next tag of its level that closes it."""
    out, following = [_NEVER] * len(elements), {}
    for at in range(len(elements) - 1, -1, -1):
        own = following.setdefault(levels[at], {})
        if elements[at] in _ENDS:
            out[at] = own.get(_ENDS[elements[at]], _NEVER)
        for closing in (_TABLE, _SECTION, _ROW, _CELL):
            if elements[at] in closing:
                own[closing] = at
    return out


def _next(elements: list[str], name: str) -> list[int]:
    """The next tag of this name after each tag."""
    out, following = [_NEVER] * len(elements), _NEVER
    for at in range(len(elements) - 1, -1, -1):
        out[at] = following
        if elements[at] == name:
            following = at
    return out


def _inside(places: list[int], begin: int, end: int) -> dict[str, int]:
    """The interval of the sorted ``places`` between two tags."""
    first = bisect_right(places, begin)
    return {"first": first, "n": max(0, bisect_left(places, end) - first)}


def read_tables(structure: str) -> dict:
    """All tables of a page from its table tags, as ``html.only_tags`` leaves them: cells, rows as
    intervals of cells, tables as intervals of rows. No tag of an outer level stands
    between the begin and the end of an element, so what is inside one is what stands between."""
    segments = structure.split("\x01")[1:]
    elements = [s.partition("\x02")[0] for s in segments]
    levels = _levels(elements)
    ends = _ends(elements, levels)
    heads, bodies = _next(elements, "thead"), _next(elements, "tbody")
    # Rows and cells outside of all tables belong to none.
    inner = [at for at, level in enumerate(levels) if level]
    cells = [at for at in inner if elements[at] in ("td", "th")]
    rows = [at for at in inner if elements[at] == "tr"]
    texts = [s.rpartition("\x03")[2] for s in segments]
    whole, starts = "".join(texts), [0, *accumulate(map(len, texts))]
    tables = []
    for at in inner:
        if elements[at] == "table":
            body, head = (n if n < ends[at] else None for n in (bodies[at], heads[at]))
            begin, end = (at, ends[at]) if body is None else (body, ends[body])
            shown = _inside(cells, head, ends[head]) if head is not None else {"first": 0, "n": 0}
            tables.append({"table_no": len(tables) + 1, "head": shown, "rows": _inside(rows, begin, end)})
    return {
        "cells": [
            {"is_th": elements[c] == "th", "text": whole[starts[c] : starts[min(ends[c], len(elements))]]} for c in cells
        ],
        "rows": [_inside(cells, r, ends[r]) for r in rows],
        "tables": tables,
    }


def nested_tables(structure: Column) -> Column:
    """What ``read_tables`` finds in a page's table tags; null stays null."""

    def of(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else read_tables(p) for p in pages.to_pylist()], TABLES_TYPE)

    return F.arrow_udf(of, SPARK_TYPE).asNondeterministic()(structure)
