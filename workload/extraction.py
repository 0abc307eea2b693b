"""Queries for page extraction, over the raw pages and over rendered pages."""

from __future__ import annotations

from pyspark.sql import functions as F


from pagetables.functions import text
from pagetables.operators import extract, records
from pagetables.session import new_folder
from pagetables.sources import archives, sinks
from pagetables.sources import pages as page_source

from . import rendered, views
from .registry import query, table
from .views import HEADINGS_SQL, LINKS_SQL, PARAGRAPHS_SQL, TITLES_SQL

# -- sources and sinks ---------------------------------------------------------------


@query("SELECT page_id, url, length(html)::BIGINT AS n_chars FROM pages")
def scan_pages(spark, sf_dir):
    return views.pages(spark, sf_dir).select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query("SELECT page_id, 'https://files.example.com/' || page_id AS url, md5(html) AS html_md5 FROM pages")
def scan_html_files(spark, sf_dir):
    folder = new_folder(spark, "html")
    page_source.write_html_files(views.pages(spark, sf_dir), folder)
    page_id = F.regexp_extract("path", "page_id=([0-9]+)", 1)
    files = page_source.read_html_files(spark, folder, page_id, F.concat(F.lit("https://files.example.com/"), page_id))
    # a written document ends with one line break
    body = F.substr("html", F.lit(1), F.length("html") - 1)
    return files.select("page_id", "url", F.md5(body).alias("html_md5"))


@query("SELECT page_id, url, 200 AS status_code, md5(html) AS html_md5 FROM pages")
def scan_archives(spark, sf_dir):
    """The pages written to archives of many pages a file, each in the smallest charset that
    holds it, and read back."""
    folder = new_folder(spark, "archives")
    narrow = F.col("html").rlike(r"^[\x00-\x7f\xa0-\xff]*+$")
    pages = views.pages(spark, sf_dir).select(
        F.concat(F.lit("<urn:page:"), F.col("page_id"), F.lit(">")).alias("record_id"),
        "url",
        "html",
        F.when(narrow, F.lit("iso-8859-1")).otherwise("utf-8").alias("charset"),
    )
    archives.write_archives(pages, folder)
    found = archives.read_archives(spark, folder)
    page_id = F.regexp_extract("record_id", "[0-9]+", 0).cast("bigint")
    return found.select(page_id.alias("page_id"), "url", "status_code", F.md5("html").alias("html_md5"))


_LINK_COLUMNS = "page_id, record_no, text, link_url, link_type, target"


@query(f"WITH {LINKS_SQL} SELECT {_LINK_COLUMNS} FROM links")
def sink_csv(spark, sf_dir):
    folder = new_folder(spark, "csv")
    sinks.write_csv(extract.extract_links(views.pages(spark, sf_dir)), folder)
    return sinks.read_csv(
        spark, folder, "page_id bigint, record_no bigint, text string, link_url string, link_type string, target string"
    )


@query(f"WITH {PARAGRAPHS_SQL} SELECT page_id, paragraph_no, paragraph_text, word_count, character_count FROM paragraphs")
def sink_json(spark, sf_dir):
    folder = new_folder(spark, "json")
    found = extract.extract_paragraphs(views.pages(spark, sf_dir))
    sinks.write_json(found, folder)
    return spark.read.schema(found.schema).json(folder)


def _width(table_name: str, name: str, value: str) -> str:
    return (
        f"SELECT '{name}' AS column_name, least(greatest(greatest(coalesce(max(length(split_part({value}, chr(10), 1))), 0), "
        f"length('{name}')) + 4, 12), 60)::BIGINT AS width FROM {table_name}"
    )


@query(
    " UNION ALL ".join(
        [
            _width("documents", "doc_id", "CASE WHEN doc_id <> 0 THEN CAST(doc_id AS VARCHAR) ELSE '' END"),
            _width("documents", "text", "coalesce(text, '')"),
            _width("documents", "lang", "coalesce(lang, '')"),
            _width("documents", "source", "coalesce(source, '')"),
            _width("documents", "n_chars", "CASE WHEN n_chars <> 0 THEN CAST(n_chars AS VARCHAR) ELSE '' END"),
        ]
    )
)
def sink_column_widths(spark, sf_dir):
    return sinks.column_widths(table(spark, sf_dir, "documents"))


# -- the six kinds over the raw pages -------------------------------------------------


@query(
    f"WITH {TITLES_SQL} SELECT page_id, page_title, length(page_title)::BIGINT AS length_chars, meta_description, "
    "canonical_url FROM titles"
)
def extract_title(spark, sf_dir):
    return extract.extract_title(views.pages(spark, sf_dir))


@query(
    f"WITH {HEADINGS_SQL} SELECT page_id, record_no, level, tag, heading_text, "
    "length(heading_text)::BIGINT AS character_count FROM headings WHERE heading_text <> ''"
)
def extract_headings(spark, sf_dir):
    return extract.extract_headings(views.pages(spark, sf_dir))


@query(f"WITH {LINKS_SQL} SELECT {_LINK_COLUMNS} FROM links")
def extract_links(spark, sf_dir):
    return extract.extract_links(views.pages(spark, sf_dir))


@query(f"WITH {PARAGRAPHS_SQL} SELECT * FROM paragraphs")
def extract_paragraphs(spark, sf_dir):
    return extract.extract_paragraphs(views.pages(spark, sf_dir))


@query(
    f"""WITH {PARAGRAPHS_SQL}, {LINKS_SQL.replace(views.SCRUBBED_SQL + ",", "")},
{HEADINGS_SQL.replace(views.SCRUBBED_SQL + ",", "")}, {TITLES_SQL.replace(views.SCRUBBED_SQL + ",", "")}
SELECT page_id, 'Page Title' AS scrape_type, 1::BIGINT AS record_no, CAST(json_object('Page Title', page_title,
    'Length (Chars)', length(page_title), 'Meta Description', meta_description, 'Canonical URL', canonical_url) AS VARCHAR)
    AS payload FROM titles
UNION ALL SELECT page_id, 'Headings', record_no, CAST(json_object('Level', level, 'Tag', tag, 'Heading Text', heading_text,
    'Character Count', length(heading_text)) AS VARCHAR) FROM headings WHERE heading_text <> ''
UNION ALL SELECT page_id, 'Links', record_no, CAST(json_object('Text', text, 'URL', link_url, 'Type', link_type, 'Target',
    target) AS VARCHAR) FROM links
UNION ALL SELECT page_id, 'Paragraphs', paragraph_no, CAST(json_object('Paragraph #', paragraph_no, 'Paragraph Text',
    paragraph_text, 'Word Count', word_count, 'Character Count', character_count) AS VARCHAR) FROM paragraphs"""
)
def extract_all(spark, sf_dir):
    return extract.extract_all(views.pages(spark, sf_dir))


@query(
    f"WITH {PARAGRAPHS_SQL} SELECT page_id, paragraph_no, paragraph_text, word_count, character_count FROM paragraphs"
)
def registry_dispatch(spark, sf_dir):
    return extract.extract(views.pages(spark, sf_dir), "Paragraphs")


@query(f"WITH {PARAGRAPHS_SQL} SELECT * FROM paragraphs WHERE paragraph_no <= 5")
def cap_records(spark, sf_dir):
    return extract.extract_paragraphs(views.pages(spark, sf_dir), max_records=5)


# -- the six kinds over rendered pages ------------------------------------------------


@query(rendered.META_SQL)
def extract_title_rendered(spark, sf_dir):
    return extract.extract_title(rendered.meta_pages(spark, sf_dir))


@query(rendered.RENDERED_HEADINGS_SQL)
def extract_headings_rendered(spark, sf_dir):
    return extract.extract_headings(rendered.heading_pages(spark, sf_dir))


@query(rendered.RENDERED_LINKS_SQL)
def extract_links_rendered(spark, sf_dir):
    return extract.extract_links(rendered.link_pages(spark, sf_dir))


@query(rendered.RENDERED_IMAGES_SQL)
def extract_images(spark, sf_dir):
    return extract.extract_images(rendered.image_pages(spark, sf_dir))


@query(rendered.TABLES_LONG_SQL)
def extract_tables(spark, sf_dir):
    return extract.extract_tables(rendered.table_pages(spark, sf_dir))


@query(rendered.NESTED_SQL)
def extract_tables_nested(spark, sf_dir):
    return extract.extract_tables(rendered.nested_table_pages(spark, sf_dir))


@query(rendered.TABLES_MAP_SQL)
def extract_tables_map(spark, sf_dir):
    rows = extract.extract_tables_map(rendered.table_pages(spark, sf_dir))
    return rows.withColumn("record", F.to_json("record"))


@query(rendered.TABLES_WIDE_SQL)
def extract_tables_wide(spark, sf_dir):
    """The columns that are asked for."""
    return extract.extract_tables_wide(rendered.table_pages(spark, sf_dir), rendered.WIDE_COLUMNS)


@query(rendered.UNION_TABLES_SQL)
def union_tables(spark, sf_dir):
    """All tables of a page as one, with every column that some table has, missing ones null."""
    return extract.extract_tables_wide(rendered.table_pages(spark, sf_dir))


@query(f"WITH {rendered.MIXED_SQL} SELECT page_id, scrape_type, record_no, CAST(payload AS VARCHAR) AS payload FROM mixed")
def extract_all_rendered(spark, sf_dir):
    """All kinds of pages that hold all kinds, nested tables among them."""
    return extract.extract_all(rendered.mixed_pages(spark, sf_dir))


@query(
    f"WITH {rendered.MIXED_SQL}, typed AS (SELECT page_id, scrape_type, record_no, CAST(payload AS JSON) AS payload FROM mixed) "
    "SELECT page_id, scrape_type, record_no, len(json_keys(payload))::BIGINT AS n_fields, "
    "coalesce(payload ->> 'Paragraph Text', payload ->> 'URL', payload ->> 'Heading Text', payload ->> 'Page Title', "
    "payload ->> 'Image URL') AS shown, CAST(payload ->> 'Word Count' AS BIGINT) AS words, "
    "CAST(coalesce(payload ->> 'Character Count', payload ->> 'Length (Chars)') AS BIGINT) AS characters FROM typed"
)
def extract_all_variant(spark, sf_dir):
    """All kinds as variants, their fields read with their types."""
    found = extract.extract_all_variant(rendered.mixed_pages(spark, sf_dir))
    record, names = F.col("payload"), ("Paragraph Text", "URL", "Heading Text", "Page Title", "Image URL")
    return found.select(
        "page_id",
        "scrape_type",
        "record_no",
        F.size(F.variant_get(record, "$", "map<string,variant>")).cast("bigint").alias("n_fields"),
        F.coalesce(*[text.field(record, n) for n in names]).alias("shown"),
        text.field(record, "Word Count", "bigint").alias("words"),
        F.coalesce(*[text.field(record, n, "bigint") for n in ("Character Count", "Length (Chars)")]).alias("characters"),
    )


@query(
    "SELECT page_id, table_no, count(DISTINCT row_no)::BIGINT AS n_rows, count(DISTINCT col_no)::BIGINT AS n_cols FROM ("
    + rendered.TABLES_LONG_SQL
    + ") GROUP BY ALL"
)
def table_shape(spark, sf_dir):
    return extract.table_shape(rendered.table_pages(spark, sf_dir))


@query("SELECT DISTINCT page_id, table_no, col_no, col_name FROM (" + rendered.TABLES_LONG_SQL + ")")
def unique_headers(spark, sf_dir):
    return extract.table_headers(rendered.table_pages(spark, sf_dir))


@query("SELECT page_id, record_no, link_url FROM (" + rendered.RENDERED_LINKS_SQL + ") WHERE link_type = 'Internal'")
def internal_links(spark, sf_dir):
    found = extract.extract_links(rendered.link_pages(spark, sf_dir))
    return found.where(F.col("link_type") == "Internal").select("page_id", "record_no", "link_url")


@query("SELECT page_id, record_no, link_url FROM (" + rendered.RENDERED_LINKS_SQL + ") WHERE link_type = 'External'")
def external_links(spark, sf_dir):
    found = extract.extract_links(rendered.link_pages(spark, sf_dir))
    return found.where(F.col("link_type") == "External").select("page_id", "record_no", "link_url")


# -- deduplication --------------------------------------------------------------------



@query(
    "SELECT o_orderkey, i::BIGINT AS i, tag, heading_text FROM (SELECT o_orderkey, v.i, v.tag, v.heading_text, "
    "row_number() OVER (PARTITION BY o_orderkey, v.tag, v.heading_text ORDER BY v.i) AS rn FROM orders, LATERAL (VALUES "
    "(1, 'H1', o_orderstatus), (2, 'H2', o_orderstatus), (3, 'H1', 'F'), (4, 'H1', o_orderstatus), (5, 'H2', 'F'), "
    "(6, 'H2', o_orderpriority)) v(i, tag, heading_text)) WHERE rn = 1"
)
def dedup_headings(spark, sf_dir):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    found = F.array(
        *[
            F.struct(F.lit(t).alias("tag"), x.alias("heading_text"))
            for t, x in [("H1", s), ("H2", s), ("H1", F.lit("F")), ("H1", s), ("H2", F.lit("F")), ("H2", p)]
        ]
    )
    kept = table(spark, sf_dir, "orders").select(
        "o_orderkey", found.alias("found"), F.explode(records.dedup_headings(found)).alias("h")
    )
    # i: where the kept heading stood among the found ones
    return kept.select(
        "o_orderkey",
        F.array_position("found", F.struct(F.col("h.tag").alias("tag"), F.col("h.heading_text").alias("heading_text"))).alias("i"),
        "h.tag",
        "h.heading_text",
    )


@query(
    "SELECT o_orderkey, text, link_url, target FROM (SELECT o_orderkey, v.*, row_number() OVER (PARTITION BY o_orderkey, "
    "v.text, v.link_url ORDER BY v.i) AS rn FROM orders, LATERAL (VALUES (1, 'a', o_orderstatus, 't1'), (2, 'a', 'F', 't2'), "
    "(3, 'b', 'F', 't3'), (4, 'a', o_orderstatus, 't4'), (5, 'b', o_orderstatus, 't5')) v(i, text, link_url, target)) WHERE rn = 1"
)
def dedup_links(spark, sf_dir):
    s = F.col("o_orderstatus")
    found = F.array(
        *[
            F.struct(F.lit(t).alias("text"), u.alias("link_url"), F.lit(w).alias("target"))
            for t, u, w in [("a", s, "t1"), ("a", F.lit("F"), "t2"), ("b", F.lit("F"), "t3"), ("a", s, "t4"), ("b", s, "t5")]
        ]
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(records.dedup_links(found)))


@query(f"WITH {PARAGRAPHS_SQL} SELECT page_id, paragraph_text FROM firsts")
def dedup_paragraphs(spark, sf_dir):
    return extract.extract_paragraphs(views.pages(spark, sf_dir)).select("page_id", "paragraph_text")


@query(
    "SELECT o_orderkey, alt_text, image_url FROM (SELECT o_orderkey, v.*, row_number() OVER (PARTITION BY o_orderkey, "
    "v.image_url ORDER BY v.i) AS rn FROM orders, LATERAL (VALUES (1, 'a', o_orderstatus), (2, 'b', 'F'), "
    "(3, 'c', o_orderstatus), (4, 'd', 'O')) v(i, alt_text, image_url)) WHERE rn = 1"
)
def dedup_images(spark, sf_dir):
    s = F.col("o_orderstatus")
    found = F.array(
        *[
            F.struct(F.lit(a).alias("alt_text"), u.alias("image_url"))
            for a, u in [("a", s), ("b", F.lit("F")), ("c", s), ("d", F.lit("O"))]
        ]
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(records.dedup_images(found)))


@query(f"WITH {PARAGRAPHS_SQL} SELECT page_id, paragraph_no, md5(paragraph_text) AS text_md5 FROM paragraphs")
def renumber_paragraphs(spark, sf_dir):
    found = extract.extract_paragraphs(views.pages(spark, sf_dir))
    return found.select("page_id", "paragraph_no", F.md5("paragraph_text").alias("text_md5"))


@query(f"WITH {LINKS_SQL} SELECT count(*) AS n_rows, 6::BIGINT AS n_cols FROM links")
def frame_shape(spark, sf_dir):
    found = extract.extract_links(views.pages(spark, sf_dir))
    return found.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(found.columns)).cast("bigint"))


