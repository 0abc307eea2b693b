"""HTML tables as records.

Every page is read inside its own row. Pages without nested tables are read with
arrays into one struct per data row: (table_no, table_label, row_no, col_names, cells). Where a
table holds another one, ``nested_tables`` reads the tags, and the page keeps its cells once with
the intervals of its rows (``shape_nested``), from which the same structs are made when they are
handed out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text
from ..functions.arrays import cap, let

NAMES = ("td", "tr", "th", "table", "thead", "tbody", "tfoot")
STRUCTURE = f"/?(?:{'|'.join(NAMES)})"
# One character per structural tag: splitting on a single character needs no regex.
_TABLE, _TABLE_END, _ROW, _ROW_END = "\x04", "\x05", "\x06", "\x07"
_HEAD, _BODY, _SECTION, _CELL, _TH = "\x08", "\x0e", "\x0f", "\x10", "\x11"
_MARKS = _TABLE + _TABLE_END + _ROW + _ROW_END + _HEAD + _BODY + _SECTION + _CELL + _TH
_TAG_MARKS = {
    "td": _CELL,
    "th": _TH,
    "tr": _ROW,
    "/tr": _ROW_END,
    "table": _TABLE,
    "/table": _TABLE_END,
    "thead": _HEAD,
    "tbody": _BODY,
    "tfoot|/tfoot|/thead|/tbody": _SECTION,
}

def bare(marked: Column) -> Column:
    """A marked page with its table tags alone, as ``html.mark_names`` gives it."""
    marks = F.regexp_replace(marked, f"\x01(?:({STRUCTURE})(?=\x02))?[^\x03]*+\x03", "\x01$1\x02\x03")
    return F.replace(marks, F.lit("\x01\x02\x03"), F.lit(""))


def structure(tags: Column) -> Column:
    """A page with its table tags alone (``html.mark_names`` or ``bare``) with single-character marks for
    them and nothing else but the texts of cells, each right after its mark; '' without tables."""
    outside = f"[^{_MARKS}\x01]*+"
    # Only what follows a cell's begin is text of a cell, so the end of a cell need not be kept.
    marks = F.regexp_replace(tags, f"(?i)\x01/t[dh]\x02\x03{outside}", "")
    for names, mark in _TAG_MARKS.items():
        rest = "" if mark in (_CELL, _TH) else outside
        marks = F.regexp_replace(marks, f"(?i)\x01(?:{names})\x02\x03{rest}", mark)
    return F.when(tags.contains("\x01"), marks).otherwise("")


def cleaned(part: Column) -> Column:
    """The texts of one table decoded, with single spaces and none at their ends (no reference and no white
    space goes past a mark)."""
    spaced = text.collapse_space(text.decode_common(part))
    return F.regexp_replace(spaced, f" (?:(?=[{_MARKS}]|\\z)|(?<=[{_MARKS}] ))", "")


def _after(part: Column, mark: str) -> Column:
    """The pieces that follow each ``mark``."""
    return let(F.split(part, mark, -1), lambda p: F.slice(p, 2, F.size(p)))


def _until(part: Column, *marks: str) -> Column:
    for mark in marks:
        part = F.substring_index(part, mark, 1)
    return part


def _cells(row: Column) -> Column:
    """array<string> of one row (or of a whole head)."""
    return _after(F.replace(row, F.lit(_TH), F.lit(_CELL)), _CELL)


def has_nested_tables(marks: Column) -> Column:
    """True when a table opens before the one in front of it has closed, from ``structure``."""
    return marks.rlike(f"{_TABLE}[^{_TABLE}{_TABLE_END}]*+{_TABLE}")


def column_names(headers: Column, width: Column) -> Column:
    """Unique column names; headers that do not fit the width are not used.

    A blank header is called ``Column``, the k-th repeat of a name ``name_k``."""

    def unique(given: Column) -> Column:
        # Equal names stand together when sorted by (name, position), so a name's
        # repeats are counted from where its run begins.
        tagged = F.array_sort(F.transform(given, lambda n, i: F.struct(n.alias("n"), i.alias("i"))))

        def counted(t: Column) -> Column:
            first = lambda j: F.when(j == 0, True).otherwise(t[j - 1].n != t[j].n)
            begins = F.filter(F.transform(t, lambda x, j: F.when(first(j), j)), lambda j: j.isNotNull())
            runs = F.transform(begins, lambda b, k: F.struct(b.alias("b"), F.coalesce(F.get(begins, k + 1), F.size(t)).alias("e")))
            named = F.flatten(
                F.transform(
                    runs,
                    lambda r: F.transform(
                        F.slice(t, r.b + 1, r.e - r.b),
                        lambda x, j: F.struct(x.i.alias("i"), F.when(j == 0, x.n).otherwise(F.concat_ws("_", x.n, j)).alias("n")),
                    ),
                )
            )
            return F.transform(F.array_sort(named), lambda x: x.n)

        return let(tagged, counted)

    def named(given: Column) -> Column:
        return F.when(F.size(F.array_distinct(given)) == F.size(given), given).otherwise(unique(given))

    return F.when(
        F.size(headers) == width, let(F.transform(headers, lambda h: text.default_label(h, "Column")), named)
    ).otherwise(F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("Column "), i)))


def has_text(cells: Column) -> Column:
    """Whether a row of cleaned cell texts is data."""
    return F.exists(cells, lambda c: c != "")


# One table in steps; each reads what the steps before it gave, as columns of a table's row
# (``extract``) or in the page's row (``_read_table``).


def table_parts(marks: Column) -> Column:
    """array<string>: a page's ``structure`` from the begin of every table to its end."""
    return F.transform(_after(marks, _TABLE), lambda t: _until(t, _TABLE_END))


def head_cells(part: Column) -> Column:
    """Texts of the thead of a ``cleaned`` table."""
    head = _until(_after(part, _HEAD)[0], _BODY, _SECTION)
    for mark in (_ROW, _ROW_END):
        head = F.replace(head, F.lit(mark), F.lit(""))
    return F.when(part.contains(_HEAD), _cells(head)).otherwise(F.array().cast("array<string>"))


def row_parts(part: Column) -> Column:
    """The rows with cells of a ``cleaned`` table. A missing tbody means the whole table, so
    the rows of a thead are then read as data too; later tbodys are not read."""
    body = F.when(part.contains(_BODY), _until(_after(part, _BODY)[0], _HEAD, _SECTION)).otherwise(part)
    rows = F.transform(_after(body, _ROW), lambda r: _until(r, _ROW_END, _HEAD, _BODY, _SECTION))
    return F.filter(rows, lambda r: r != "")


def header_place(head: Column, rows: Column) -> Column:
    """Place of the row that gives the headers: without head, the first one made of th cells only."""
    first_th = F.array_position(F.transform(rows, lambda r: ~r.contains(_CELL)), True)
    return F.when(F.size(head) > 0, F.lit(0)).otherwise(first_th)


def headers(head: Column, rows: Column, place: Column) -> Column:
    return F.when(place > 0, _cells(F.element_at(rows, place.cast("int")))).otherwise(head)


def data_rows(rows: Column, place: Column) -> Column:
    """array<array<string>>: every other row with some text."""
    return F.transform(
        F.filter(rows, lambda r, i: (i + 1 != place) & (F.trim(r, F.lit(_CELL + _TH)) != "")), _cells
    )


def table_width(data: Column) -> Column:
    return F.array_max(F.transform(data, lambda c: F.size(c)))


def padded(data: Column, width: Column) -> Column:
    return F.transform(
        data,
        lambda c: F.when(F.size(c) == width, c).otherwise(F.concat(c, F.array_repeat(F.lit(""), width - F.size(c)))),
    )


def names_of(headers: Column, data: Column, width: Column) -> Column:
    """The column names of a table, null when it has no data row."""
    return F.when(F.size(data) > 0, column_names(headers, width))


def clean_cells(cells: Column) -> Column:
    return F.transform(
        cells, lambda c: F.struct(c.is_th.alias("is_th"), text.clean_text(text.decode_common(c.text)).alias("text"))
    )


def _read_table(part: Column) -> Column:
    """struct(col_names, rows) of one table without inner tables, null when it has no data row."""

    def choose(t: Column) -> Column:
        return let(
            header_place(t.head, t["rows"]),
            lambda p: F.struct(headers(t.head, t["rows"], p).alias("headers"), data_rows(t["rows"], p).alias("data")),
        )

    def shape(t: Column) -> Column:
        return let(
            table_width(t.data),
            lambda width: F.when(
                F.size(t.data) > 0,
                F.struct(names_of(t.headers, t.data, width).alias("col_names"), padded(t.data, width).alias("rows")),
            ),
        )

    return let(let(F.struct(head_cells(part).alias("head"), row_parts(part).alias("rows")), choose), shape)


def _numbered_rows(table_no: Column, t: Column, several: Column) -> Column:
    """Data rows of one table; the label is there when the page has several tables."""
    return F.transform(
        t.rows,
        lambda cells, i: F.struct(
            table_no.alias("table_no"),
            F.when(several, F.concat(F.lit("Table "), table_no)).alias("table_label"),
            (i + 1).cast("bigint").alias("row_no"),
            t.col_names.alias("col_names"),
            cells.alias("cells"),
        ),
    )


def flat_table_rows(marks: Column, max_records: int | None = None) -> Column:
    """array<struct(table_no, table_label, row_no, col_names, cells)> of a page's ``structure``, capped
    over all its tables together. Every table counts for ``table_no``."""
    tables = F.transform(
        table_parts(marks), lambda t, i: F.struct((i + 1).cast("bigint").alias("table_no"), let(cleaned(t), _read_table).alias("t"))
    )

    def rows(found: Column) -> Column:
        return F.transform(
            F.filter(found, lambda t: t.t.isNotNull()),
            lambda t: _numbered_rows(t.table_no, t.t, F.size(found) > 1),
        )

    return cap(F.flatten(let(tables, rows)), max_records)


def shape_nested(found: Column, max_records: int | None = None) -> Column:
    """struct(texts, tables) of ``nested_tables``: the cleaned cells of the page, and for every table with
    data (table_no, col_names, width, rows, before). A row is an interval of the cells; ``before``
    counts the data rows of the tables in front."""

    def part(items: Column, interval: Column) -> Column:
        return F.slice(items, interval["first"] + 1, interval["n"])

    def row_facts(cells: Column) -> Column:
        return F.transform(
            found["rows"],
            lambda r: F.struct(
                r["first"].alias("first"),
                r["n"].alias("n"),
                F.forall(part(cells, r), lambda c: c.is_th).alias("all_th"),
                F.exists(part(cells, r), lambda c: c.text != "").alias("filled"),
            ),
        )

    def shape(t: Column, rows: Column, texts: Column) -> Column:
        def choose(own: Column) -> Column:
            first_th = F.array_position(F.transform(own, lambda r: r.all_th), True)
            position = F.when(t["head"]["n"] > 0, F.lit(0)).otherwise(first_th)
            return let(
                position,
                lambda p: F.struct(
                    F.when(p > 0, part(texts, F.element_at(own, p.cast("int")))).otherwise(part(texts, t["head"])).alias("headers"),
                    F.transform(
                        F.filter(own, lambda r, i: (i + 1 != p) & r.filled),
                        lambda r: F.struct(r["first"].alias("first"), r["n"].alias("n")),
                    ).alias("data"),
                ),
            )

        def named(chosen: Column) -> Column:
            return let(
                F.array_max(F.transform(chosen.data, lambda r: r["n"])),
                lambda width: F.when(
                    F.size(chosen.data) > 0,
                    F.struct(
                        t.table_no.alias("table_no"),
                        column_names(chosen.headers, width).alias("col_names"),
                        width.alias("width"),
                        chosen.data.alias("rows"),
                    ),
                ),
            )

        return let(let(F.filter(part(rows, t["rows"]), lambda r: r["n"] > 0), choose), named)

    def numbered(shaped: Column) -> Column:
        """With the count of rows in front; beyond the cap there are no rows."""
        sizes = F.transform(shaped, lambda t: F.size(t["rows"]).cast("bigint"))
        start = F.struct(F.array().cast("array<bigint>").alias("all"), F.lit(0).cast("bigint").alias("n"))
        step = lambda s, n: F.struct(F.concat(s["all"], F.array(s["n"])).alias("all"), (s["n"] + n).alias("n"))
        before = F.aggregate(sizes, start, step, lambda s: s["all"])

        def kept(t: Column, n: Column) -> Column:
            if max_records and max_records > 0:
                return F.slice(t["rows"], 1, F.greatest(F.lit(0), F.lit(max_records) - n).cast("int"))
            return t["rows"]

        return let(
            before,
            lambda b: F.transform(
                shaped,
                lambda t, i: F.struct(
                    t.table_no.alias("table_no"), t.col_names.alias("col_names"), t.width.alias("width"), kept(t, b[i]).alias("rows"), b[i].alias("before")
                ),
            ),
        )

    def whole(cells: Column) -> Column:
        return let(
            F.struct(row_facts(cells).alias("rows"), F.transform(cells, lambda c: c.text).alias("texts")),
            lambda x: F.struct(
                x.texts.alias("texts"),
                let(
                    F.filter(F.transform(found.tables, lambda t: shape(t, x["rows"], x.texts)), lambda t: t.isNotNull()), numbered
                ).alias("tables"),
            ),
        )

    return F.when(found.isNotNull(), let(clean_cells(found.cells), whole))


def nested_cells(texts: Column, t: Column, limit: int | None = None) -> Column:
    """The cells of the data rows of one table of ``shape_nested``."""

    def cells(r: Column) -> Column:
        own = F.slice(texts, r["first"] + 1, r["n"])
        return F.when(r["n"] == t.width, own).otherwise(F.concat(own, F.array_repeat(F.lit(""), t.width - r["n"])))

    return F.transform(F.slice(t["rows"], 1, limit) if limit else t["rows"], cells)


def nested_rows(texts: Column, t: Column, limit: int | None = None) -> Column:
    """Data rows of one table of ``shape_nested``, as ``flat_table_rows`` gives them."""
    return F.transform(
        nested_cells(texts, t, limit),
        lambda cells, i: F.struct(
            t.table_no.alias("table_no"),
            F.concat(F.lit("Table "), t.table_no).alias("table_label"),
            (i + 1).cast("bigint").alias("row_no"),
            t.col_names.alias("col_names"),
            cells.alias("cells"),
        ),
    )


# The two columns of a page row that hold its tables: ``table_rows`` for pages without nested
# tables, ``nested`` (as ``shape_nested`` gives it, else null) for the others.


def flat_rows(marks: Column, found: Column, max_records: int | None = None) -> Column:
    """``table_rows``: empty for pages with nested tables."""
    return flat_table_rows(F.when(found.isNull(), marks).otherwise(""), max_records)


def row_count() -> Column:
    """Number of data rows of a page."""
    inner = F.aggregate(F.col("nested.tables"), F.lit(0).cast("bigint"), lambda n, t: n + F.size(t["rows"]))
    return F.size("table_rows") + F.coalesce(inner, F.lit(0))


def first_rows(limit: int) -> Column:
    """The first data rows of a page."""
    some = F.slice(F.filter(F.col("nested.tables"), lambda t: F.size(t["rows"]) > 0), 1, limit)
    inner = F.slice(F.flatten(F.transform(some, lambda t: nested_rows(F.col("nested.texts"), t, limit))), 1, limit)
    return F.when(F.col("nested").isNull(), F.slice("table_rows", 1, limit)).otherwise(inner)


def parts_of() -> Column:
    """A page in parts to be handed out: null for all but nested tables, then those one by one."""
    tables = F.col("nested.tables")
    nothing = F.transform(F.slice(tables, 1, 1), lambda t: F.when(F.lit(False), t))
    alone = F.array(F.when(F.lit(False), F.get(tables, F.lit(0))))
    return F.when(F.size(nothing) > 0, F.concat(nothing, tables)).otherwise(alone)


def either_table(flat: Column, nested: Column) -> Column:
    """array<struct<table_no, several, headers, width, data, inner>> of a page's tables: those of ``read_flat``, or
    the tables of ``shape_nested`` as ``inner`` where there are some."""
    none = F.when(F.lit(False), F.get(nested["tables"], F.lit(0)))
    lack = F.when(F.lit(False), F.get(flat, F.lit(0)))

    def item(t: Column, table_no: Column, several: Column, inner: Column) -> Column:
        return F.struct(
            table_no.alias("table_no"),
            several.alias("several"),
            t["headers"].alias("headers"),
            t["width"].alias("width"),
            t["data"].alias("data"),
            inner.alias("inner"),
        )

    return F.when(nested.isNull(), F.transform(flat, lambda t: item(t, t.table_no, t.several, none))).otherwise(
        F.transform(nested["tables"], lambda t: item(lack, t.table_no, F.lit(True), t))
    )


def rows_of_part(part: Column) -> Column:
    """Data rows of one of ``parts_of``."""
    return F.when(part.isNull(), F.col("table_rows")).otherwise(nested_rows(F.col("nested.texts"), part))
