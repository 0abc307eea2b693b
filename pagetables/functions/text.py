"""Text cleaning, entity decoding, labels and text statistics."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

# The code points Unicode calls white space (plus the four C0
# separators). Java's \s is ASCII only, so they are spelled out. Single code points
# below 256 become a bit set in Java, and the outer range rejects most others fast.
_GAPS = (
    r"\t\n\x0B\f\r\x1c\x1d\x1e\x1f\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)
WHITESPACE = _GAPS + r"\x20"

# Texts shown when a page leaves a field out.
NO_TITLE = "No Title Found"
NOT_AVAILABLE = "N/A"
NO_LINK_TEXT = "[No Text / Image / Icon]"
NO_ALT_TEXT = "[No Alt Text]"
DEFAULT_TARGET = "_self"

# The references most pages use; '&amp;' has to be replaced last.
COMMON = {
    "lt": "<",
    "gt": ">",
    "quot": '"',
    "#39": "'",
    "nbsp": "\xa0",
    "copy": "\xa9",
    "middot": "\xb7",
    "amp": "&",
}
_UNCOMMON = "&(?=[#A-Za-z])(?!(?:" + "|".join(COMMON) + ");)"

# The entity tables are derived from the standard library's HTML5 list.
# Lookups scan the map, so the HTML 4 names come first.
_ENTITIES = {
    name.rstrip(";"): text
    for name, text in sorted(html.entities.html5.items(), key=lambda e: e[0].rstrip(";") not in html.entities.name2codepoint)
}
_BARE_NAMES = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_BARE = "|".join(_BARE_NAMES)
# Numeric references 128..159 mean windows-1252 characters in HTML.
_WINDOWS_1252 = {i: bytes([i]).decode("cp1252", errors="ignore") or chr(i) for i in range(0x80, 0xA0)}


def collapse_space(text: Column) -> Column:
    """White space as single spaces."""
    # Single plain spaces, by far the most common run, need no replacement. One plain range
    # is looked at first, because most characters are in it.
    uneven = f"(?=[^!-~])(?:[{_GAPS}][{WHITESPACE}]*+| [{WHITESPACE}]++)"
    return F.regexp_replace(text, uneven, " ")


def clean_text(text: Column) -> Column:
    """Collapse white space to single spaces and trim; null becomes ''."""
    return F.trim(collapse_space(F.coalesce(text, F.lit(""))))


def strip_space(text: Column) -> Column:
    """Trim Unicode white space at both ends (``trim`` drops U+0020 only)."""
    return F.regexp_replace(text, rf"^[{WHITESPACE}]++|[{WHITESPACE}]++\z", "")


def field(record: Column, name: str, kind: str = "string") -> Column:
    """A field of a variant record with its type; null where it is missing or of another type."""
    if not set("'\"\\?") & set(name):
        return F.try_variant_get(record, f"$['{name}']", kind)
    # Paths cannot quote these.
    fields = F.try_variant_get(record, "$", "map<string,variant>")
    return F.try_variant_get(F.element_at(fields, F.lit(name)), "$", kind)


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{WHITESPACE}]")


def default_label(text: Column, label: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(label))


def word_count(clean: Column) -> Column:
    """Number of words of an already cleaned text."""
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, " "))).cast("bigint")


def char_count(text: Column) -> Column:
    return F.length(text).cast("bigint")


def heading_label(tag: Column) -> Column:
    return F.concat(F.lit("Heading "), F.substring(tag, 2, 1))


def _entity(name: Column) -> Column:
    """Text of a named reference, null for an unknown name: first the names with one
    first letter, as one string, then the name in it."""
    buckets: dict[str, str] = {}
    for key, text in _ENTITIES.items():
        buckets[key[0]] = buckets.get(key[0], "") + f"\x04{key}\x05{text}"
    letters = F.str_to_map(
        F.lit("\x02".join(f"{c}\x01{names}\x04" for c, names in buckets.items())), F.lit("\x02"), F.lit("\x01")
    )
    marked = F.concat(F.lit("\x04"), name, F.lit("\x05"))
    return let(
        F.element_at(letters, F.substring(name, 1, 1)),
        lambda names: F.when(
            F.contains(names, marked), F.substring_index(F.split_part(names, marked, F.lit(2)), "\x04", 1)
        ),
    )


def _code_point(number: Column) -> Column:
    """Character of a code point, with HTML's repairs for invalid numbers."""
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    repaired = F.element_at(
        F.str_to_map(
            F.lit("\x02".join(f"{i}\x01{c}" for i, c in _WINDOWS_1252.items())), F.lit("\x02"), F.lit("\x01")
        ),
        number.cast("string"),
    )
    replacement = F.lit("\ufffd")
    return (
        F.when(number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), replacement)
        .when(number.between(0x80, 0x9F), repaired)
        .when(
            number.between(0x1, 0x8)
            | (number == 0xB)
            | number.between(0xE, 0x1F)
            | (number == 0x7F)
            | number.between(0xFDD0, 0xFDEF)
            | (number % 0x10000 >= 0xFFFE),
            F.lit(""),
        )
        .otherwise(char)
    )


def _reference(piece: Column, in_attribute: Column) -> Column:
    """``piece`` (the text after an ``&``) with the reference at its start decoded
    and every ``&``, ``<``, ``>`` and quote written as a common reference."""
    decimal = F.regexp_extract(piece, r"^#([0-9]+);?", 1)
    hexa = F.regexp_extract(piece, r"^#[xX]([0-9a-fA-F]+);?", 1)
    number = F.when(decimal != "", decimal.try_cast("bigint")).when(
        F.length(F.ltrim(hexa, F.lit("0"))) <= 8, F.conv(hexa, 16, 10).cast("bigint")
    )
    closed = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]{1,31});", 1)
    bare = F.regexp_extract(piece, f"^({_BARE})", 1)
    # in attribute values a name without ';' counts only before a separator
    bare = F.when(in_attribute & piece.rlike(f"^(?:{_BARE})[=A-Za-z0-9]"), F.lit("")).otherwise(bare)
    hits = F.transform(
        F.array(closed, bare), lambda n: F.struct(n.alias("ref"), F.when(n != "", _entity(n)).alias("char"))
    )
    numeric = r"^#(?:[0-9]+|[xX][0-9a-fA-F]+);?"
    found = let(
        F.struct(number.alias("number"), hits.alias("hits")),
        lambda r: F.when(
            piece.rlike(numeric),
            F.struct(_code_point(r.number).alias("char"), F.regexp_replace(piece, numeric, "").alias("rest")),
        )
        .when(
            r.hits[0].char.isNotNull(),
            F.struct(r.hits[0].char.alias("char"), F.substr(piece, F.length(r.hits[0].ref) + 2).alias("rest")),
        )
        .when(
            r.hits[1].char.isNotNull(),
            F.struct(r.hits[1].char.alias("char"), F.substr(piece, F.length(r.hits[1].ref) + 1).alias("rest")),
        )
        .otherwise(F.struct(F.lit("&").alias("char"), piece.alias("rest"))),
    )

    def written(f: Column) -> Column:
        char = f.char
        for name in ("amp", "lt", "gt", "quot", "#39"):
            char = F.replace(char, F.lit(COMMON[name]), F.lit(f"&{name};"))
        return F.concat(char, f.rest)

    return let(found, written)


def _spell_out(part: Column, in_attribute: Column) -> Column:
    return let(
        F.split(part, "&", -1),
        lambda p: F.array_join(
            F.concat(
                F.slice(p, 1, 1), F.transform(F.slice(p, 2, F.size(p)), lambda r: _reference(r, in_attribute))
            ),
            "",
        ),
    )


def common_references(marked: Column) -> Column:
    """A marked page in which only common references are left, so that its fields
    need no entity table. Pages without other references pass through."""
    parts = F.split(marked, "(?<=[\x01\x03])", -1)
    spelled = F.array_join(
        F.transform(parts, lambda p: F.when(p.rlike(_UNCOMMON), _spell_out(p, p.contains("\x02"))).otherwise(p)), ""
    )
    return F.when(marked.rlike(_UNCOMMON), spelled).otherwise(marked)


def decode_common(text: Column) -> Column:
    """Decode a field of a page that went through ``common_references``."""
    decoded = text
    for name, char in COMMON.items():
        decoded = F.replace(decoded, F.lit(f"&{name};"), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def decode_entities(text: Column) -> Column:
    """Replace HTML character references in a text."""
    return decode_common(F.when(text.rlike(_UNCOMMON), _spell_out(text, F.lit(False))).otherwise(text))
