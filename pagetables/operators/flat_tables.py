"""Tables of many pages at a time.

Pages with a table inside another one go to ``nested_tables.read_tables``. For the others ``read_flat`` takes the table tags of a batch of pages (``html.mark_names``). All tags of the batch are one array of kinds; what a tag belongs to is the last or next
tag of some kind, so every step is one pass over arrays and there is no loop over pages, rows or cells. The
rules are those of ``tables._read_table``, which reads one table in its page's row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import COMMON
from . import nested_tables

_TABLE, _TABLE_END, _HEAD, _BODY, _SECTION, _ROW_END, _ROW, _CELL_END, _CELL, _TH = range(10)
# By the second letter of a name; "th" begins two of them.
_OPENS, _CLOSES, _LENGTHS = (np.zeros(256, dtype=np.int64) for _ in range(3))
for _letter, _open, _close, _length in (
    ("a", _TABLE, _TABLE_END, 5),
    ("b", _BODY, _SECTION, 5),
    ("f", _SECTION, _SECTION, 5),
    ("r", _ROW, _ROW_END, 2),
    ("d", _CELL, _CELL_END, 2),
    ("h", _TH, _CELL_END, 2),
):
    _OPENS[ord(_letter)], _CLOSES[ord(_letter)], _LENGTHS[ord(_letter)] = _open, _close, _length

# Python's white space is that of ``text.WHITESPACE``.
_UNEVEN = re.compile(r"[^\S ]\s*+| \s++")

# Bytes of pages whose tags are in memory together; a longer page is read alone.
_TOGETHER = 1 << 21

FLAT_TYPE = pa.list_(
    pa.struct(
        [
            ("table_no", pa.int64()),
            ("several", pa.bool_()),
            ("headers", pa.list_(pa.string())),
            ("width", pa.int32()),
            ("data", pa.list_(pa.list_(pa.string()))),
        ]
    )
)
SPARK_TYPE = (
    "struct<flat: array<struct<table_no: bigint, several: boolean, headers: array<string>, width: int, data: array<array<string>>>>, "
    f"found: {nested_tables.SPARK_TYPE}>"
)
_NAME = re.compile("\x01[^\x02]+")


def _begins(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of intervals, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The texts at these places of ``data``."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(data[_places(starts, sizes)]))


def _cleaned(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts at these places of ``data``, each with the tag's first character behind it, decoded and with single spaces
    and none at their ends: (data, starts, sizes). No reference and no white space goes past a \x01."""
    whole = data[np.minimum(_places(starts, sizes + 1), len(data) - 1)]
    whole[np.cumsum(sizes + 1) - 1] = 1
    joined = whole.tobytes().decode(errors="replace")
    if "&" in joined:
        for name, char in COMMON.items():
            joined = joined.replace(f"&{name};", char)
    clean = np.frombuffer(_UNEVEN.sub(" ", joined).encode(), dtype=np.uint8)
    ends = np.flatnonzero(clean == 1)
    begins = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    begins = begins + (clean[begins] == 32)
    return clean, begins, ends - begins - ((ends > begins) & (clean[ends - 1] == 32))


def _read(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The tables with data of pages, each from its offset to the next one, and which pages have a table inside another
    one. Those have no tables here."""
    tag = offsets[0] + np.flatnonzero(data[offsets[0] : offsets[-1]] == 1)
    n = len(tag)
    page = np.searchsorted(offsets, tag, side="right") - 1
    closes = data[tag + 1] == ord("/")
    name = tag + 1 + closes
    letter = data[name + 1] | 0x20
    thead = (letter == ord("h")) & (data[name + 2] != 2)
    kind = np.where(closes, _CLOSES[letter], _OPENS[letter])
    kind[thead] = np.where(closes[thead], _SECTION, _HEAD)
    start = name + np.where(thead, 5, _LENGTHS[letter]) + 2
    at = np.arange(n)

    def last(of: np.ndarray) -> np.ndarray:
        """The last of these tags up to each tag."""
        return np.maximum.accumulate(np.where(of, at, -1))

    def first(tables: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The first of the places, which ascend, of every table."""
        out = np.full(len(opens), -1)
        out[tables[::-1]] = places[::-1]
        return out

    def between(cells: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Whether cells stand between a tag and the end of its section."""
        return (cells > begin) & (cells < following[begin])

    is_table = kind == _TABLE
    opens, table = np.flatnonzero(is_table), np.cumsum(is_table) - 1
    opened = last(is_table)
    page_begin = np.zeros(n, dtype=np.int64)
    page_begin[_begins(page)] = _begins(page)
    inside = (opened >= np.maximum.accumulate(page_begin)) & (opened > last(kind == _TABLE_END))
    section = kind <= _SECTION
    following = np.append(np.minimum.accumulate(np.where(section, at, n)[::-1])[::-1][1:], n) if n else at
    heads, bodies = (np.flatnonzero((kind == k) & inside) for k in (_HEAD, _BODY))
    head, body = first(table[heads], heads), first(table[bodies], bodies)

    cell = np.flatnonzero((kind >= _CELL) & inside)
    owner = table[cell]
    # The text of a cell goes to the next tag or the end of the page.
    ends = np.minimum(np.append(tag[1:], offsets[-1]), offsets[page + 1])[cell]
    texts, begin, size = _cleaned(data, start[cell], ends - start[cell])
    in_head = (head[owner] >= 0) & between(cell, head[owner])
    in_body = (body[owner] < 0) | between(cell, body[owner])
    row_tag = last(kind == _ROW)[cell]
    in_row = np.flatnonzero(in_body & (row_tag > last(kind <= _ROW_END)[cell]))

    rows = _begins(row_tag[in_row])
    width = np.diff(np.append(rows, len(in_row)))
    row_owner = owner[in_row[rows]]
    all_th = np.logical_and.reduceat(kind[cell[in_row]] == _TH, rows) if len(rows) else np.zeros(0, dtype=bool)
    filled = np.logical_or.reduceat(size[in_row] > 0, rows) if len(rows) else all_th
    named = np.bincount(owner[in_head], minlength=len(opens)) > 0
    ths = np.flatnonzero(all_th & ~named[row_owner])
    header = first(row_owner[ths], ths)
    is_header = np.zeros(len(rows), dtype=bool)
    is_header[header[header >= 0]] = True
    # A table inside another one begins before the one in front of it has ended.
    tables = np.flatnonzero(kind <= _TABLE_END)
    inner = is_table[tables[1:]] & is_table[tables[:-1]] & (page[tables[1:]] == page[tables[:-1]])
    nested = np.zeros(len(offsets) - 1, dtype=bool)
    nested[page[tables[1:][inner]]] = True
    is_data = filled & ~is_header & ~nested[page[opens[row_owner]]]

    n_rows = np.bincount(row_owner[is_data], minlength=len(opens))
    shown = np.flatnonzero(n_rows)
    headers = in_head.copy()
    headers[in_row] |= np.repeat(is_header, width)
    headers = np.flatnonzero(headers & (n_rows[owner] > 0))
    cells = in_row[np.repeat(is_data, width)]
    widths = np.maximum.reduceat(width[is_data], _begins(row_owner[is_data])) if len(shown) else shown
    table_page = page[opens]
    number = np.arange(len(opens)) - np.searchsorted(table_page, table_page) + 1
    n_tables = np.bincount(table_page, minlength=len(offsets) - 1)
    found = pa.StructArray.from_arrays(
        [
            pa.array(number[shown], pa.int64()),
            pa.array(n_tables[table_page[shown]] > 1, pa.bool_()),
            _lists(np.bincount(owner[headers], minlength=len(opens))[shown], _strings(texts, begin[headers], size[headers])),
            pa.array(widths, pa.int32()),
            _lists(n_rows[shown], _lists(width[is_data], _strings(texts, begin[cells], size[cells]))),
        ],
        fields=list(FLAT_TYPE.value_type),
    )
    return _lists(np.bincount(table_page[shown], minlength=len(offsets) - 1), found), nested


def read_flat(pages: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """For every page its tables with data: number, whether the page has several, texts of the header cells, most cells
    of a data row, and cell texts of the data rows; and which pages are left to ``read_tables``. Some pages at a time."""
    raw = pages.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(raw):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _TOGETHER, side="right")) - 1)
        yield _read(data, offsets[at : to + 1])
        at = to


def all_tables(tags: Column) -> Column:
    """struct(flat, found): what ``read_flat`` finds, and ``read_tables`` for the pages left to it, else null."""

    def of(pages: pa.Array) -> pa.Array:
        flat, nested = [pa.array([], FLAT_TYPE)], [np.zeros(0, dtype=bool)]
        for found, left in read_flat(pages):
            flat.append(found.cast(FLAT_TYPE))
            nested.append(left)
        inner: list[dict | None] = [None] * len(pages)
        for at in np.flatnonzero(np.concatenate(nested)).tolist():
            inner[at] = nested_tables.read_tables(_NAME.sub(lambda name: name[0].lower(), pages[at].as_py()))
        return pa.StructArray.from_arrays([pa.concat_arrays(flat), pa.array(inner, nested_tables.TABLES_TYPE)], names=["flat", "found"])

    return F.arrow_udf(of, SPARK_TYPE).asNondeterministic()(tags)
