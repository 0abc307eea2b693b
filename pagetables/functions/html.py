"""Page markup as a flat marked string.

``mark_tags`` reads every tag of a page once. Tags that matter to an extractor
become ``\\x01name\\x02attributes\\x03`` in place; all other tags, comments,
scripts and styles disappear. What is left between markers is text. Each
extractor then drops the markers it does not care about (``only_tags``) and
splits on ``\\x01``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, decode_common

# Elements whose start ends an open paragraph in HTML, with list
# and table parts and the document elements.
BLOCK_TAGS = (
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li listing "
    "main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul xmp"
).split()
# Elements whose start ends an open heading or anchor.
HEADING_ENDS = "fieldset form li p table".split()
ANCHOR_ENDS = "fieldset table td th".split()

# Frequent names first: the matcher tries them in this order.
_FREQUENT = "p a li div td tr img ul h1 h2 h3 h4 th".split()
_MARKED = tuple(dict.fromkeys([*_FREQUENT, "link", "meta", *BLOCK_TAGS]))


def _any_of(names: Iterable[str]) -> str:
    """Regex for one of the names, letter by letter, so that a name is not tried against all others."""
    rests: dict[str, list[str]] = {}
    for name in names:
        rests.setdefault(name[:1], []).append(name[1:])
    optional = "?" if rests.pop("", None) else ""
    letters = [letter + _any_of(rest) for letter, rest in rests.items()]
    return f"(?:{'|'.join(letters)}){optional}" if letters else ""


# The rest of a tag up to '>': quotes count only right after '='. Possessive
# quantifiers keep Java's matcher iterative and linear.
_REST = r"""[^>=]*+(?:=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+[^>=]*+)*+"""
# What is no tag of interest, after its '<': as one piece, and the end of a page as the end of a tag.
_OTHER = (
    r"!--.*?(?:-->|\z)"
    rf"|script(?=[\s/>]){_REST}>.*?(?:</script\s*+>|\z)"
    rf"|style(?=[\s/>]){_REST}>.*?(?:</style\s*+>|\z)"
    rf"|[a-z/!?]{_REST}(?:>|\z)"
)
# Control characters that serve as marks; a page's own ones are dropped.
MARKS = "\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f\x10\x11"


def tag(names: str) -> str:
    """Regex for the rest of a tag with one of the names, up to its '>'."""
    # most tags end right after their name
    return rf"(?:{names})(?:>|(?=[\s/]){_REST}>)"


def _marked(html: Column, wanted: str, mark: str) -> Column:
    page = F.coalesce(html, F.lit(""))
    page = F.when(page.rlike(f"[{MARKS}]"), F.translate(page, MARKS, "")).otherwise(page)
    # Wanted tags first: most tags are.
    return F.replace(F.regexp_replace(page, f"(?is)<(?:{wanted}|{_OTHER})", mark), F.lit("\x01\x02\x03"), F.lit(""))


def mark_tags(html: Column) -> Column:
    """One pass over the page; see the module text. Null becomes ''."""
    return _marked(html, rf"(/?{_any_of(_MARKED)})(?=[\s/>])({_REST})>", "\x01$1\x02$2\x03")


def mark_names(html: Column, names: Iterable[str]) -> Column:
    """``mark_tags`` for these elements alone and without their attributes."""
    return _marked(html, tag(f"(/?{_any_of(names)})"), "\x01$1\x02\x03")


def lower_tags(marked: Column) -> Column:
    """Marker names in lower case, so that later steps can compare them plainly."""
    lowered = F.transform(
        F.split(marked, "\x01", -1),
        lambda s, i: F.when(i == 0, s).otherwise(
            F.concat(F.lower(segment_name(s)), F.substr(s, F.length(segment_name(s)) + 1))
        ),
    )
    return F.when(marked.rlike("\x01/?[a-z0-9]*[A-Z]"), F.array_join(lowered, "\x01")).otherwise(marked)


def strip_markup(html: Column) -> Column:
    """Text of a fragment: tags, comments, scripts and styles removed."""
    return F.regexp_replace(mark_tags(html), "\x01[^\x03]*\x03", "")


def has_tag(marked: Column, name: str) -> Column:
    return marked.contains(f"\x01{name}\x02")


def only_tags(marked: Column, names: str) -> Column:
    """Drop every marker whose name does not match the regex ``names``."""
    return F.regexp_replace(marked, f"\x01(?!(?:{names})\x02)[^\x03]*+\x03", "")


def segments(marked: Column, wanted: str, ends: str) -> Column:
    """array<string> of ``name\\x02attributes\\x03text`` for the wanted tags, each
    with its text up to the next wanted or ending marker."""
    pieces = F.split(only_tags(marked, f"{wanted}|{ends}"), "\x01", -1)
    return F.filter(pieces, lambda s: s.rlike(f"^(?:{wanted})\x02"))


def segment_name(segment: Column) -> Column:
    return F.substring_index(segment, "\x02", 1)


def segment_attributes(segment: Column) -> Column:
    return F.substring_index(F.substring_index(segment, "\x03", 1), "\x02", -1)


def segment_text(segment: Column) -> Column:
    return clean_text(decode_common(F.substring_index(segment, "\x03", -1)))


def first_text(marked: Column, name: str) -> Column:
    """Cleaned text of the first element called ``name``; null without one."""
    content = F.regexp_extract(marked, f"(?s)\x01{name}\x02[^\x03]*+\x03(.*?)(?:\x01/{name}\x02|\\z)", 1)
    clean = clean_text(decode_common(F.regexp_replace(content, "\x01[^\x03]*+\x03", "")))
    return F.when(has_tag(marked, name), clean)


def tag_attributes(marked: Column, name: str) -> Column:
    """array<string>: the attribute text of every tag called ``name``."""
    return F.regexp_extract_all(marked, F.lit(f"\x01{name}\x02([^\x03]*+)\x03"), F.lit(1))


def _before(name: str) -> str:
    """Regex for the attributes in front of ``name``, consumed whole, so that a
    name inside another attribute's quoted value is not found."""
    value = r"""(?:"[^"]*+"|'[^']*+'|[^\s"']\S*+)"""
    return rf"(?is)^(?:[\s/]++|(?!{name}(?:[\s/=]|\z))=?+[^\s/=]++(?:\s*+=\s*+{value}?+)?+)*+{name}"


def has_attribute(attributes: Column, name: str) -> Column:
    return attributes.rlike(_before(name) + r"(?:[\s/=]|\z)")


def attribute(attributes: Column, name: str) -> Column:
    """Decoded value of the first attribute called ``name``; '' without one."""
    quoted_or_bare = r"""(?:"|'|)((?<=")[^"]*+|(?<=')[^']*+|(?<!["'])[^\s"']\S*+)"""
    return decode_common(F.regexp_extract(attributes, _before(name) + rf"\s*+=\s*+{quoted_or_bare}", 1))
