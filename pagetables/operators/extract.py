"""Page extraction: DataFrame(page_id, url, html) to records of six kinds.

All kinds are narrow: a page's records are computed in its own row and exploded
there, so the HTML is read and marked once and never shuffled. Pages may share a
``page_id``: each row is a page of its own.
``record_no`` numbers a page's records after deduplication.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..functions.arrays import cap, explode_items, keep_rows
from ..session import new_folder
from . import records, tables
from .flat_tables import all_tables
from .nested_tables import nested_tables

# The kinds of records and their names.
SCRAPE_TYPES = ("Page Title", "Headings", "Links", "Paragraphs", "Tables", "Images")

# The names records are shown and exported with.
DISPLAY_NAMES = {
    "Page Title": {
        "page_title": "Page Title",
        "length_chars": "Length (Chars)",
        "meta_description": "Meta Description",
        "canonical_url": "Canonical URL",
    },
    "Headings": {
        "level": "Level",
        "tag": "Tag",
        "heading_text": "Heading Text",
        "character_count": "Character Count",
    },
    "Links": {"text": "Text", "link_url": "URL", "link_type": "Type", "target": "Target"},
    "Paragraphs": {
        "paragraph_no": "Paragraph #",
        "paragraph_text": "Paragraph Text",
        "word_count": "Word Count",
        "character_count": "Character Count",
    },
    "Images": {"alt_text": "Alt Text", "image_url": "Image URL", "image_type": "Type"},
}
TABLE_LABEL = "Table #"


# Most columns of a wide table whose names are found in the data.
MOST_COLUMNS = 2000


def mark_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, base, page_chars, is_blank, marked): the page read once, its
    URL split once. A column ``raw_url`` is kept."""
    kept = ["page_id", "url", *[c for c in pages.columns if c == "raw_url"]]
    marked = pages.select(
        *kept,
        F.length("html").cast("bigint").alias("page_chars"),
        text.is_blank(F.col("html")).alias("is_blank"),
        html.mark_tags(F.col("html")).alias("marked"),
    )
    # Each step reads its input several times, so each is a projection of its own.
    lowered = marked.select(*kept, "page_chars", "is_blank", html.lower_tags(F.col("marked")).alias("marked"))
    return lowered.select(
        *kept,
        urls.split_url(F.coalesce("url", F.lit(""))).alias("base"),
        "page_chars",
        "is_blank",
        text.common_references(F.col("marked")).alias("marked"),
    )


def _explode(page_rows: DataFrame, items: Column) -> DataFrame:
    return explode_items(page_rows, items, "page_id").select(
        "page_id", (F.col("i") + 1).cast("bigint").alias("record_no"), "r.*"
    )


def extract_title(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    """Exactly one row per page; a cap does not apply."""
    found = mark_pages(pages).select("page_id", records.title_record(F.col("marked"), F.col("base")).alias("r"))
    return found.select("page_id", "r.*")


def extract_headings(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    return _explode(mark_pages(pages), records.headings(F.col("marked"), max_records))


def extract_links(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    return _explode(mark_pages(pages), records.links(F.col("marked"), F.col("base"), max_records))


def extract_paragraphs(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    return _explode(mark_pages(pages), records.paragraphs(F.col("marked"), max_records)).drop("record_no")


def extract_images(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    return _explode(mark_pages(pages), records.images(F.col("marked"), F.col("base"), max_records))


def with_nested(marked_pages: DataFrame, bare: Column) -> DataFrame:
    """Marked pages with ``structure``, from their table tags, and ``nested``: the tables of a page
    where one holds another, else null. Decided on the marked text alone, so every page is read in
    exactly one way."""
    marks = marked_pages.withColumn("bare", bare).withColumn("structure", tables.structure(F.col("bare")))
    tags = F.when(tables.has_nested_tables(F.col("structure")), F.col("bare"))
    return marks.withColumn("nested", nested_tables(tags)).drop("bare")


def _marked_tables(pages: DataFrame) -> DataFrame:
    """(page_id, tags): every page with its table tags alone."""
    marked = pages.select("page_id", html.mark_names(F.col("html"), tables.NAMES).alias("tags"))
    return marked.withColumn("tags", text.common_references(F.col("tags")))


def _structures(pages: DataFrame) -> DataFrame:
    """(page_id, structure, found): the table marks of every page, and the tables of a page where one holds
    another, else null. Only the tags of such pages are read by name."""
    tags = F.col("tags")
    marks = _marked_tables(pages).select("page_id", "tags", tables.structure(tags).alias("structure"))
    inner = html.lower_tags(F.when(tables.has_nested_tables(F.col("structure")), tags))
    tags = marks.select("page_id", "structure", inner.alias("tags"))
    # The Python node is given a plain column.
    only = F.when(html.has_tag(F.col("tags"), "table"), F.col("tags"))
    return tags.withColumn("found", nested_tables(only)).drop("tags")


def page_tables(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    """(page_id, table_rows, nested): the data rows of a page's tables, in order."""
    structure, found = F.col("structure"), F.col("found")
    return _structures(pages).select(
        "page_id", tables.flat_rows(structure, found, max_records).alias("table_rows"), tables.shape_nested(found, max_records).alias("nested")
    )


def _each_table(pages: DataFrame) -> DataFrame:
    """(page_id, several, texts, table_no, inner, col_names, width, data) of every table with data: ``inner`` on
    pages with nested tables, else ``data``. A table is a row here, handed out of its page before its names are
    made, so that those are plain projections."""
    tags = F.col("tags")
    # The Python node is given a plain column.
    given = _marked_tables(pages).select("page_id", F.when(tags.contains("\x01"), tags).alias("tags"))
    found = given.select("page_id", all_tables(tags).alias("r"))
    read = found.select("page_id", F.col("r.flat").alias("flat"), tables.shape_nested(F.col("r.found")).alias("nested"))
    each = explode_items(read, tables.either_table(F.col("flat"), F.col("nested")), "page_id", F.col("nested.texts").alias("texts"))
    each = each.select("page_id", "texts", "r.*")
    names = F.when(F.col("inner").isNull(), tables.names_of(F.col("headers"), F.col("data"), F.col("width")))
    names = names.otherwise(F.col("inner.col_names")).alias("col_names")
    return each.select("page_id", "several", "texts", "table_no", "inner", names, "width", "data")


def _table_records(pages: DataFrame, max_records: int | None) -> DataFrame:
    """(page_id, table_no, table_label, row_no, col_names, cells) of every data row."""
    if max_records and max_records > 0:
        # A cap is over all tables of a page, so it is decided in the page's row.
        parts = explode_items(page_tables(pages, max_records), tables.parts_of(), "page_id", "table_rows", "nested")
        return explode_items(parts.withColumnRenamed("r", "part").drop("i"), tables.rows_of_part(F.col("part")), "page_id").select("page_id", "r.*")
    return _rows_of_tables(_each_table(pages))


def _rows_of_tables(each: DataFrame) -> DataFrame:
    """``_table_records`` of the rows of ``_each_table``."""
    inner = F.col("inner")
    cells = F.when(inner.isNull(), tables.padded(F.col("data"), F.col("width"))).otherwise(tables.nested_cells(F.col("texts"), inner))
    label = F.when(F.col("several"), F.concat(F.lit("Table "), F.col("table_no"))).alias("table_label")
    return explode_items(each, cells, "page_id", "table_no", label, "col_names").select(
        "page_id", "table_no", "table_label", (F.col("i") + 1).cast("bigint").alias("row_no"), "col_names", F.col("r").alias("cells")
    )


def extract_tables(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    """Long form: one row per cell."""
    return (
        explode_items(
            _table_records(pages, max_records), F.arrays_zip("col_names", "cells"), "page_id", "table_no", "row_no"
        )
        .select(
            "page_id",
            "table_no",
            "row_no",
            (F.col("i") + 1).cast("bigint").alias("col_no"),
            F.col("r.col_names").alias("col_name"),
            F.col("r.cells").alias("cell"),
        )
    )


def map_names(col_names: Column) -> Column:
    """The keys of ``row_map``. Headers such as A, A, A_1 collide after numbering; the later
    column is then told apart by its position, so no cell is lost."""
    told_apart = F.transform(
        col_names,
        lambda n, i: F.when(F.array_position(col_names, n) == i + 1, n).otherwise(F.concat(n, F.lit("#"), i + 1)),
    )
    # Names are made unique when a table is read, so collisions are rare.
    collide = F.size(F.array_distinct(col_names)) < F.size(col_names)
    return F.when(collide, told_apart).otherwise(col_names)


def row_map(col_names: Column, cells: Column) -> Column:
    """map<column name, cell> of a data row."""
    return F.map_from_arrays(map_names(col_names), cells)


def extract_tables_map(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    """Row form: one map of column name to cell per data row."""
    return _maps(_table_records(pages, max_records))


def _maps(records: DataFrame) -> DataFrame:
    """``extract_tables_map`` of ``_table_records``."""
    return records.select(
        "page_id", "table_no", "table_label", "row_no", row_map(F.col("col_names"), F.col("cells")).alias("record")
    )


def _tables_of(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, n_rows, col_names) of every table with data."""
    n_rows = F.when(F.col("inner").isNull(), F.size("data")).otherwise(F.size("inner.rows")).cast("bigint")
    found = _each_table(pages).select("page_id", "table_no", n_rows.alias("n_rows"), "col_names")
    return keep_rows(found, F.col("n_rows") > 0)


def _stored_tables(pages: DataFrame) -> DataFrame:
    """The rows of ``_each_table``, written once to the shared folder and read back: the pages are read
    once, whatever reads their tables."""
    each = _each_table(pages)
    folder = new_folder(pages.sparkSession, "tables")
    each.write.parquet(folder)
    return pages.sparkSession.read.schema(each.schema).parquet(folder)


def table_headers(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, col_no, col_name): the column names of every table with data."""
    return explode_items(_tables_of(pages), F.col("col_names"), "page_id", "table_no").select(
        "page_id", "table_no", (F.col("i") + 1).cast("bigint").alias("col_no"), F.col("r").alias("col_name")
    )


def table_columns(pages: DataFrame, most: int = MOST_COLUMNS) -> list[str]:
    """The names of all tables' columns, in the order of their first place. One aggregation that
    counts a name once a task; more than ``most`` names are refused."""
    return _first_names(_tables_of(pages), most)


def _first_names(each: DataFrame, most: int) -> list[str]:
    """``table_columns`` of tables with data."""
    # Tables with the same names in the same order are counted together, then their names.
    alike = each.groupBy("col_names").agg(F.min(F.struct("page_id", "table_no")).alias("at"))
    names = explode_items(alike, map_names(F.col("col_names")), "at")
    first = names.groupBy(F.col("r").alias("name")).agg(F.min(F.struct("at", "i")).alias("place"))
    found = [r.name for r in first.orderBy("place").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"the tables have more than {most} different columns")
    return found


def extract_tables_wide(
    pages: DataFrame, columns: list[str] | None = None, max_records: int | None = None, most: int = MOST_COLUMNS
) -> DataFrame:
    """Wide form over all tables: one column per name, null where a table does not have it. Without a
    list the names are those that the tables have. ``table_label`` is set for pages with several
    tables. A name that is already taken, in any case, gets its position added."""
    if columns is None and not (max_records and max_records > 0):
        each = _stored_tables(pages)
        rows, columns = _maps(_rows_of_tables(each)), _first_names(each, most)
    else:
        rows = extract_tables_map(pages, max_records)
    own = ("page_id", "table_no", "table_label", "row_no")
    taken, wide = set(own), []
    for i, c in enumerate(table_columns(pages, most) if columns is None else columns, 1):
        name = c if c.lower() not in taken else f"{c}#{i}"
        taken.add(name.lower())
        wide.append(F.element_at("record", F.lit(c)).alias(name))
    return rows.select(*own, *wide)


def page_reader(max_records: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """``page_records`` as a function whose column expressions are built once, for
    callers that read many batches."""
    marked, base = F.col("marked"), F.col("base")
    arrays = [
        F.array(records.title_record(marked, base)).alias("titles"),
        records.headings(marked, max_records).alias("headings"),
        records.links(marked, base).alias("links"),
        records.paragraphs(marked, max_records).alias("paragraphs"),
        tables.flat_rows(F.col("structure"), F.col("nested"), max_records).alias("table_rows"),
        tables.shape_nested(F.col("nested"), max_records).alias("nested"),
        records.images(marked, base).alias("images"),
    ]
    broken = {
        "Page Title": F.exists("titles", lambda r: urls.has_bad_host(r.canonical_url)),
        "Links": F.exists("links", lambda r: urls.has_bad_host(r.link_url)),
        "Images": F.exists("images", lambda r: urls.has_bad_host(r.image_url)),
    }
    unreadable = F.array_compact(F.array(*[F.when(b, F.lit(t)) for t, b in broken.items()])).alias("unreadable")

    def read(pages: DataFrame) -> DataFrame:
        rows = with_nested(mark_pages(pages), tables.bare(marked))
        found = rows.select(*[c for c in rows.columns if c not in ("base", "marked", "structure", "nested")], *arrays)
        return found.select("*", unreadable).select(
            *[c for c in found.columns if c not in ("links", "images")],
            cap(F.col("links"), max_records).alias("links"),
            cap(F.col("images"), max_records).alias("images"),
            "unreadable",
        )

    return read


def page_records(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    """One row per page with the records of all six kinds as arrays, from one
    marking of the page: (page_id, url, page_chars, is_blank, titles, headings,
    links, paragraphs, table_rows, nested, images, unreadable). Pages with nested tables have
    theirs in ``nested``, each cell once (``tables.shape_nested``). ``unreadable`` lists the
    kinds that hold a URL with a broken host."""
    return page_reader(max_records)(pages)


def _shown(items: Column, scrape_type: str) -> Column:
    names = DISPLAY_NAMES[scrape_type]
    return F.transform(items, lambda r: F.struct(*[r[c].alias(n) for c, n in names.items()]))


def _shown_rows(rows: Column) -> Column:
    def shown(r: Column) -> Column:
        cells = row_map(r.col_names, r.cells)
        return F.when(r.table_label.isNull(), cells).otherwise(
            F.map_concat(F.create_map(F.lit(TABLE_LABEL), r.table_label), F.map_filter(cells, lambda k, _: k != TABLE_LABEL))
        )

    return F.transform(rows, shown)


_ARRAYS = {
    "Page Title": "titles",
    "Headings": "headings",
    "Links": "links",
    "Paragraphs": "paragraphs",
    "Tables": "table_rows",
    "Images": "images",
}


def shown_records(scrape_type: str, limit: int) -> Column:
    """The first records of one kind of a ``page_records`` row under their display names."""
    if scrape_type == "Tables":
        return _shown_rows(tables.first_rows(limit))
    return _shown(F.slice(F.col(_ARRAYS[scrape_type]), 1, limit), scrape_type)


def record_counts() -> Column:
    """map<scrape_type, number of records> of a ``page_records`` row."""
    counts = {t: tables.row_count() if t == "Tables" else F.size(a) for t, a in _ARRAYS.items()}
    return F.create_map(*[x for t, n in counts.items() for x in (F.lit(t), n.cast("bigint"))])


def records_of(found: DataFrame, payload: Callable[[Column], Column] = F.to_json) -> DataFrame:
    """``page_records`` as (page_id, scrape_type, record_no, payload). Nested tables are handed
    out one after the other, all else of a page at once."""

    def numbered(scrape_type: str, shown: Column, before: Column) -> Column:
        return F.transform(
            shown,
            lambda r, i: F.struct(
                F.lit(scrape_type).alias("scrape_type"),
                (before + i + 1).cast("bigint").alias("record_no"),
                payload(r).alias("payload"),
            ),
        )

    none = F.lit(0)
    flat = [numbered(t, _shown_rows(F.col(a)) if t == "Tables" else _shown(F.col(a), t), none) for t, a in _ARRAYS.items()]
    part = F.col("part")
    inner = numbered("Tables", _shown_rows(tables.nested_rows(F.col("nested.texts"), part)), part.before)
    kept = ["page_id", *_ARRAYS.values(), "nested"]
    parts = explode_items(found, tables.parts_of(), *kept).withColumnRenamed("r", "part").drop("i")
    return explode_items(parts, F.when(part.isNull(), F.concat(*flat)).otherwise(inner), "page_id").select("page_id", "r.*")


def extract_all(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    """All six kinds from one scan: (page_id, scrape_type, record_no, payload JSON)."""
    return records_of(page_records(pages, max_records))


def extract_all_variant(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    """``extract_all`` with the payload as VARIANT, which keeps types: readers take fields of it
    (``text.field``) without parsing text."""
    return records_of(page_records(pages, max_records), F.to_variant_object)


EXTRACTORS: dict[str, Callable[..., DataFrame]] = {
    "Page Title": extract_title,
    "Headings": extract_headings,
    "Links": extract_links,
    "Paragraphs": extract_paragraphs,
    "Tables": extract_tables,
    "Images": extract_images,
}


def extract(pages: DataFrame, scrape_type: str, max_records: int | None = None) -> DataFrame:
    """Extract one kind of records by its name."""
    if scrape_type not in EXTRACTORS:
        raise ValueError(f"Unknown scraping type '{scrape_type}'. Supported: {list(EXTRACTORS)}")
    return EXTRACTORS[scrape_type](pages, max_records)


def table_shape(pages: DataFrame) -> DataFrame:
    """(page_id, table_no, n_rows, n_cols) of every table with data."""
    return _tables_of(pages).select("page_id", "table_no", "n_rows", F.size("col_names").cast("bigint").alias("n_cols"))
