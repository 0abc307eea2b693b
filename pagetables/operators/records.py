"""Per-page record arrays.

Every function takes the marked page (``operators.extract.mark_pages``), where needed
the page's split URL (``functions.urls.split_url``), and returns one array of record structs, cleaned, classified, deduplicated keep-first and
capped. Nothing here moves a row: the arrays live in the page's own row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import html, text, urls
from ..functions.arrays import cap, keep_first, let

HEADINGS = "h[1-6]"
# Hrefs that are no links to follow (case-sensitive prefixes).
SKIPPED_HREFS = "^(?:#|javascript:|mailto:|tel:)"
SKIPPED_SOURCES = "data:image"


def is_followable(href: Column) -> Column:
    return (href != "") & ~href.rlike(SKIPPED_HREFS)


def is_loadable(src: Column) -> Column:
    return (src != "") & ~src.startswith(SKIPPED_SOURCES)


def is_long_enough(paragraph: Column) -> Column:
    return F.length(paragraph) >= 3


def _bigint(n: Column) -> Column:
    return n.cast("bigint")


def title_record(marked: Column, base: Column) -> Column:
    """One struct per page: title, its length, description and canonical URL."""
    title = F.coalesce(html.first_text(marked, "title"), F.lit(text.NO_TITLE))
    # A tag whose name matches wins even when its content is empty.
    described = let(
        html.tag_attributes(marked, "meta"),
        lambda metas: F.coalesce(
            F.get(F.filter(metas, lambda m: html.attribute(m, "name").rlike("(?i)description")), F.lit(0)),
            F.get(F.filter(metas, lambda m: html.attribute(m, "property").rlike("(?i)og:description")), F.lit(0)),
        ),
    )
    canonical = F.get(
        F.filter(
            html.tag_attributes(marked, "link"),
            lambda a: F.array_contains(
                F.split(text.clean_text(html.attribute(a, "rel")), " "), F.lit("canonical")
            ),
        ),
        F.lit(0),
    )
    canonical_url = let(
        F.coalesce(html.attribute(canonical, "href"), F.lit("")),
        lambda h: F.when(h == "", h).otherwise(urls.resolve_against(base, text.strip_space(h))),
    )
    return F.struct(
        title.alias("page_title"),
        text.char_count(title).alias("length_chars"),
        text.default_label(text.clean_text(html.attribute(described, "content")), text.NOT_AVAILABLE).alias(
            "meta_description"
        ),
        text.default_label(canonical_url, text.NOT_AVAILABLE).alias("canonical_url"),
    )


def raw_headings(marked: Column) -> Column:
    """Non-empty headings in document order, before deduplication."""
    opened = html.segments(marked, HEADINGS, "/h[1-6]|" + "|".join(html.HEADING_ENDS))
    found = F.transform(
        opened,
        lambda s: F.struct(
            F.upper(html.segment_name(s)).alias("tag"), html.segment_text(s).alias("heading_text")
        ),
    )
    return F.filter(found, lambda h: h.heading_text != "")


def dedup_headings(found: Column) -> Column:
    # tag has two characters, so the joined key is unambiguous
    keys = F.array_distinct(F.transform(found, lambda h: F.concat(h.tag, h.heading_text)))
    return F.transform(
        keys,
        lambda k: F.struct(
            text.heading_label(F.substring(k, 1, 2)).alias("level"),
            F.substring(k, 1, 2).alias("tag"),
            F.substr(k, F.lit(3)).alias("heading_text"),
            _bigint(F.length(k) - 2).alias("character_count"),
        ),
    )


def headings(marked: Column, max_records: int | None = None) -> Column:
    return cap(dedup_headings(raw_headings(marked)), max_records)


def raw_links(marked: Column, base: Column) -> Column:
    """Followable links with absolute URL and type, before deduplication."""

    def read(segment: Column) -> Column:
        attributes = html.segment_attributes(segment)
        return F.struct(
            text.strip_space(html.attribute(attributes, "href")).alias("href"),
            F.when(html.has_attribute(attributes, "target"), html.attribute(attributes, "target"))
            .otherwise(text.DEFAULT_TARGET)
            .alias("target"),
            text.default_label(html.segment_text(segment), text.NO_LINK_TEXT).alias("text"),
        )

    opened = html.segments(marked, "a", "/a|" + "|".join(html.ANCHOR_ENDS))
    kept = F.filter(F.transform(opened, read), lambda a: is_followable(a.href))
    resolved = F.transform(
        kept,
        lambda a: F.struct(
            a.text.alias("text"), urls.resolve_against(base, a.href).alias("link_url"), a.target.alias("target")
        ),
    )
    return F.transform(
        resolved,
        lambda a: F.struct(
            a.text.alias("text"),
            a.link_url.alias("link_url"),
            urls.link_type(a.link_url, F.lower(base.netloc)).alias("link_type"),
            a.target.alias("target"),
        ),
    )


def dedup_links(found: Column) -> Column:
    return keep_first(found, lambda a: F.struct(a.link_url, a.text))


def links(marked: Column, base: Column, max_records: int | None = None) -> Column:
    return cap(dedup_links(raw_links(marked, base)), max_records)


def raw_paragraphs(marked: Column) -> Column:
    """array<string>: cleaned paragraph texts of three or more characters."""
    ends = [t for t in html.BLOCK_TAGS if t != "p"]
    opened = html.segments(marked, "p", "/?(?:" + "|".join(ends) + ")|/p")
    return F.filter(F.transform(opened, html.segment_text), is_long_enough)


def paragraphs(marked: Column, max_records: int | None = None) -> Column:
    return cap(
        F.transform(
            F.array_distinct(raw_paragraphs(marked)),
            lambda t, i: F.struct(
                _bigint(i + 1).alias("paragraph_no"),
                t.alias("paragraph_text"),
                text.word_count(t).alias("word_count"),
                text.char_count(t).alias("character_count"),
            ),
        ),
        max_records,
    )


def raw_images(marked: Column, base: Column) -> Column:
    """Images with absolute URL and type, before deduplication."""

    def read(a: Column) -> Column:
        # an empty src falls back to data-src, one of white space only does not
        source = F.coalesce(F.nullif(html.attribute(a, "src"), F.lit("")), html.attribute(a, "data-src"))
        return F.struct(
            text.strip_space(source).alias("src"),
            text.default_label(text.clean_text(html.attribute(a, "alt")), text.NO_ALT_TEXT).alias("alt_text"),
        )

    found = F.transform(html.tag_attributes(marked, "img"), read)
    kept = F.filter(found, lambda i: is_loadable(i.src))
    resolved = F.transform(
        kept,
        lambda i: F.struct(i.alt_text.alias("alt_text"), urls.resolve_against(base, i.src).alias("image_url")),
    )
    return F.transform(
        resolved,
        lambda i: F.struct(
            i.alt_text.alias("alt_text"),
            i.image_url.alias("image_url"),
            urls.link_type(i.image_url, F.lower(base.netloc)).alias("image_type"),
        ),
    )


def dedup_images(found: Column) -> Column:
    return keep_first(found, lambda i: i.image_url)


def images(marked: Column, base: Column, max_records: int | None = None) -> Column:
    return cap(dedup_images(raw_images(marked, base)), max_records)
