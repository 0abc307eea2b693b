"""URL expressions: splitting, resolving, validating and classifying.

Splitting and resolving follow RFC 3986 the way Python's ``urllib.parse`` reads
it; property tests compare them with that module.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .text import is_blank, strip_space

# Schemes whose references may be relative, those whose path may
# carry parameters, and those with an authority part.
_HIERARCHICAL = (
    "ftp http gopher nntp imap wais file https shttp mms prospero rtsp rtsps rtspu sftp svn svn+ssh ws wss"
).split()
_WITH_PARAMS = "ftp hdl prospero http imap https shttp rtsp rtsps rtspu sip sips mms sftp tel".split()
_WITH_AUTHORITY = (
    "ftp http gopher nntp telnet imap wais file mms https shttp snews prospero rtsp rtsps rtspu rsync svn "
    "svn+ssh sftp nfs git git+ssh ws wss itms-services"
).split()

# Messages of the validator.
EMPTY_URL = "URL cannot be empty. Please enter a valid website address."
MALFORMED_URL = "Malformed URL"
MISSING_HOST = "Invalid URL structure. Missing host or domain name (e.g., https://example.com)."

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"


def _tidy(url: Column) -> Column:
    """Leading control characters and inner tabs and line breaks do not count."""
    url = F.coalesce(url, F.lit(""))
    untidy = url.rlike(r"^[\x00-\x20]|[\t\r\n]")
    return F.when(untidy, F.regexp_replace(url, r"^[\x00-\x20]++|[\t\r\n]", "")).otherwise(url)


def _rest(text: Column, before: Column) -> Column:
    """What follows ``before`` and one separator in ``text``."""
    return F.when(F.length(before) < F.length(text), F.substr(text, F.length(before) + 2)).otherwise("")


def split_url(url: Column) -> Column:
    """struct(raw, scheme, netloc, path, params, query, fragment)."""

    def named(x: Column) -> Column:
        has_params = (
            x.path.contains(";") & x.path.rlike(r";[^/]*\z") & ((x.scheme == "") | x.scheme.isin(_WITH_PARAMS))
        )
        return let(
            has_params,
            lambda has: F.struct(
                url.alias("raw"),
                x.scheme.alias("scheme"),
                x.netloc.alias("netloc"),
                F.when(has, F.regexp_replace(x.path, r"(?s)^((?:.*/)?[^/;]*);[^/]*\z", "$1")).otherwise(x.path).alias("path"),
                F.when(has, F.regexp_extract(x.path, r"(?s)^(?:.*/)?[^/;]*;([^/]*)\z", 1)).otherwise("").alias("params"),
                x.query.alias("query"),
                x.fragment.alias("fragment"),
            ),
        )

    def located(x: Column) -> Column:
        """With the rest of the stem as authority and path."""
        rest = F.when(x.scheme == "", x.stem).otherwise(_rest(x.stem, x.scheme))
        return let(
            rest,
            lambda r: let(
                F.when(r.startswith("//"), F.substring_index(F.substr(r, F.lit(3)), "/", 1)).otherwise(""),
                lambda netloc: F.struct(
                    F.lower(x.scheme).alias("scheme"),
                    netloc.alias("netloc"),
                    F.when(r.startswith("//"), F.substr(r, F.length(netloc) + 3)).otherwise(r).alias("path"),
                    x.query.alias("query"),
                    x.fragment.alias("fragment"),
                ),
            ),
        )

    def cut(x: Column) -> Column:
        """With scheme and query cut off; both stand in front of the fragment."""
        return let(
            F.substring_index(x.head, "?", 1),
            lambda stem: F.struct(
                stem.alias("stem"),
                F.when(stem.contains(":"), F.regexp_extract(stem, _SCHEME, 1)).otherwise("").alias("scheme"),
                _rest(x.head, stem).alias("query"),
                x.fragment.alias("fragment"),
            ),
        )

    def whole(u: Column) -> Column:
        return let(
            F.substring_index(u, "#", 1),
            lambda head: F.struct(head.alias("head"), _rest(u, head).alias("fragment")),
        )

    return let(let(let(let(_tidy(url), whole), cut), located), named)


def _prefixed(prefix: str, text: Column) -> Column:
    return F.when(text != "", F.concat(F.lit(prefix), text)).otherwise("")


def _unsplit(u: Column) -> Column:
    return let(F.concat(u.path, _prefixed(";", u.params)), lambda path: _written(u, path))


def _written(u: Column, path: Column) -> Column:
    slashes = (
        F.when((u.netloc != "") & ((path == "") | path.startswith("/")), F.concat(F.lit("//"), u.netloc))
        .when(u.netloc != "", F.concat(F.lit("//"), u.netloc, F.lit("/")))
        .when(
            path.startswith("//") | (u.scheme.isin(_WITH_AUTHORITY) & ((path == "") | path.startswith("/"))),
            F.lit("//"),
        )
        .otherwise("")
    )
    return F.concat(
        F.when(u.scheme != "", F.concat(u.scheme, F.lit(":"))).otherwise(""),
        slashes,
        path,
        _prefixed("?", u.query),
        _prefixed("#", u.fragment),
    )


def _remove_dots(parts: Column) -> Column:
    """Join path segments after applying '.' and '..'.

    Read from the end, every '..' drops the next segment that nothing else drops, so one
    pass with a counter and the text so far will do; paths without dot segments are
    just joined."""
    last = F.element_at(parts, -1)
    start = F.struct(F.lit(0).alias("drop"), F.when(last.isin(".", ".."), F.lit("")).alias("path"))

    def step(done: Column, s: Column) -> Column:
        kept = (s != ".") & (s != "..") & (done.drop == 0)
        joined = F.when(done.path.isNull(), s).otherwise(F.concat(s, F.lit("/"), done.path))
        drop = F.when(s == "..", done.drop + 1).when(s == ".", done.drop).otherwise(F.greatest(done.drop - 1, F.lit(0)))
        return F.struct(drop.alias("drop"), F.when(kept, joined).otherwise(done.path).alias("path"))

    walked = F.aggregate(F.reverse(parts), start, step, lambda done: F.coalesce(done.path, F.lit("")))
    dotted = F.exists(parts, lambda s: s.isin(".", ".."))
    return default_path(F.when(dotted, walked).otherwise(F.array_join(parts, "/")))


def default_path(path: Column) -> Column:
    return let(path, lambda p: F.when(p == "", F.lit("/")).otherwise(p))


def _merge_paths(base_path: Column, path: Column) -> Column:
    """Path of a relative reference seen from ``base_path``."""
    base_dir = F.regexp_replace(base_path, r"(?s)/?[^/]+\z", "")
    # a base without any '/' contributes no directory at all
    has_dir = (base_path == "") | base_path.contains("/")
    relative = let(
        F.when(has_dir, F.concat(F.split(base_dir, "/", -1), F.split(path, "/", -1))).otherwise(
            F.split(path, "/", -1)
        ),
        # empty segments inside the joined path would double the slashes
        lambda p: F.filter(p, lambda s, i: (s != "") | (i == 0) | (i == F.size(p) - 1)),
    )
    plain = path.startswith("/") & ~path.contains("/.")
    return F.when(plain, path).otherwise(
        let(F.when(path.startswith("/"), F.split(path, "/", -1)).otherwise(relative), _remove_dots)
    )


# References that need no rewriting: complete web addresses and paths from the
# root, without dot segments, parameters, empty parts or control characters.
_TAIL = r"(?:\?[^#\x00-\x20]+)?(?:#[^\x00-\x20]+)?\z"
_COMPLETE = r"^https?://[^/?#\x00-\x20]+(?:/[^?#;\x00-\x20]*+)?" + _TAIL
_ROOTED = r"^/(?!/)(?:[^?#;/\x00-\x20]|/(?!\.))*+" + _TAIL


def resolve_against(base: Column, href: Column) -> Column:
    """Absolute URL of ``href`` seen from ``base``, a ``split_url`` struct."""
    web_base = base.scheme.isin("http", "https") & (base.netloc != "")
    return (
        F.when(web_base & href.rlike(_COMPLETE), href)
        .when(
            web_base & href.rlike(_ROOTED) & ~href.startswith("/."),
            F.concat(base.scheme, F.lit("://"), base.netloc, href),
        )
        .otherwise(_resolve_any(base, href))
    )


def _resolve_any(base: Column, href: Column) -> Column:

    def parts(h: Column) -> Column:
        same_page = (h.netloc == "") & (h.path == "") & (h.params == "")
        return F.struct(
            F.when(h.scheme == "", base.scheme).otherwise(h.scheme).alias("scheme"),
            F.when(h.netloc == "", base.netloc).otherwise(h.netloc).alias("netloc"),
            F.when(h.netloc != "", h.path)
            .when(same_page, base.path)
            .otherwise(_merge_paths(base.path, h.path))
            .alias("path"),
            F.when(same_page, base.params).otherwise(h.params).alias("params"),
            F.when(same_page & (h.query == ""), base.query).otherwise(h.query).alias("query"),
            h.fragment.alias("fragment"),
        )

    def joined(h: Column) -> Column:
        foreign = (h.scheme != "") & (h.scheme != base.scheme) | ~base.scheme.isin("", *_HIERARCHICAL)
        return (
            F.when(base.raw == "", h.raw)
            .when(h.raw == "", base.raw)
            .when(foreign, h.raw)
            .otherwise(let(parts(h), _unsplit))
        )

    return let(split_url(href), joined)


def resolve_url(base: Column, href: Column) -> Column:
    return let(split_url(F.coalesce(base, F.lit(""))), lambda b: resolve_against(b, F.coalesce(href, F.lit(""))))


def url_netloc(url: Column) -> Column:
    """Lower-cased authority with port and user info."""
    return F.lower(F.regexp_extract(_tidy(url), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def has_bad_host(url: Column) -> Column:
    """True for an unbalanced bracket in the authority, which no URL may have."""
    return let(url_netloc(url), lambda n: n.contains("[") != n.contains("]"))


def link_type(url: Column, base_netloc: Column) -> Column:
    same_site = F.startswith(url, F.concat(F.lit("https://"), base_netloc, F.lit("/"))) | F.startswith(
        url, F.concat(F.lit("http://"), base_netloc, F.lit("/"))
    )
    other = let(
        url_netloc(url),
        lambda n: F.when((n == "") | (n == base_netloc), F.lit("Internal")).otherwise("External"),
    )
    return F.when(same_site, F.lit("Internal")).otherwise(other)


def sanitize_url(url: Column) -> Column:
    """Trim and add ``https://`` where no scheme is given; '' stays ''."""
    clean = strip_space(F.coalesce(url, F.lit("")))
    return F.when(
        (F.coalesce(url, F.lit("")) != "") & ~_tidy(clean).rlike(_SCHEME), F.concat(F.lit("https://"), clean)
    ).otherwise(clean)


def validate_url(url: Column) -> Column:
    """struct(is_valid boolean, error string); the first failing check wins."""

    def checks(u: Column) -> Column:
        host = F.substring_index(u.netloc, ":", 1)
        error = (
            F.when(is_blank(url), F.lit(EMPTY_URL))
            .when(u.netloc.contains("[") != u.netloc.contains("]"), F.lit(MALFORMED_URL))
            .when(
                ~u.scheme.isin("http", "https"),
                F.concat(
                    F.lit("Invalid protocol '"),
                    u.scheme,
                    F.lit("'. Only 'http://' and 'https://' are supported."),
                ),
            )
            .when(u.netloc == "", F.lit(MISSING_HOST))
            .when(
                ~host.contains(".") & (host != "localhost"),
                F.concat(F.lit("Invalid domain name '"), host, F.lit("'. Expected format like 'example.com'.")),
            )
            .otherwise("")
        )
        return F.struct((error == "").alias("is_valid"), error.alias("error"))

    return let(split_url(sanitize_url(url)), checks)


def url_hostname(url: Column) -> Column:
    """Host without user info and port."""
    return F.regexp_replace(F.regexp_replace(url_netloc(url), r"^.*@", ""), r":[0-9]*\z", "")


def _ipv4(text: str) -> int:
    a, b, c, d = (int(x) for x in text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


# Private, loopback, reserved and link-local IPv4 blocks.
PRIVATE_BLOCKS = (
    "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 "
    "192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 240.0.0.0/4"
).split()
PUBLIC_EXCEPTIONS = "192.0.0.9 192.0.0.10".split()


_NUMBER = r"(?:0[xX][0-9a-fA-F]+|[0-9]+)"


def ipv4_number(host: Column) -> Column:
    """A literal IPv4 address as a number, in all the forms that system resolvers read:
    one to four parts, decimal, octal after 0 or hexadecimal after 0x, the last part
    filling what the others leave. Null for anything else."""

    def value(part: Column) -> Column:
        digits = (
            F.when(part.rlike("^0[xX]"), F.conv(F.concat(F.lit("0"), F.substring(part, 3, 2**31 - 1)), 16, 10))
            .when(part.rlike("^0[0-7]*$"), F.conv(part, 8, 10))
            .when(part.rlike("^[1-9]"), part)
        )
        # longer numbers than these are no address
        return F.when(F.length(part) <= 16, digits.cast("decimal(20,0)").cast("bigint"))

    def number(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        k = F.size(parts)
        fits = F.forall(F.slice(parts, 1, k - 1), lambda p: (p <= 255)) & (last < F.pow(F.lit(256.0), 5 - k))
        high = F.aggregate(
            F.transform(F.slice(parts, 1, k - 1), lambda p, i: p * F.pow(F.lit(256.0), 3 - i).cast("bigint")),
            F.lit(0).cast("bigint"),
            lambda done, x: done + x,
        )
        return F.when(fits, high + last)

    parts = F.when(
        F.coalesce(host, F.lit("")).rlike(rf"^{_NUMBER}(?:\.{_NUMBER}){{0,3}}\z"), F.transform(F.split(host, "[.]"), value)
    )
    return F.when(F.lower(host) == "localhost", F.lit(_ipv4("127.0.0.1"))).otherwise(let(parts, number))


def is_private_host(host: Column) -> Column:
    """True for an IPv4 address in a private block, in any literal form, and for
    ``localhost``; other names are not looked up."""

    def inside(n: Column) -> Column:
        hit = F.lit(False)
        for block in PRIVATE_BLOCKS:
            first, bits = block.split("/")
            low = _ipv4(first)
            hit = hit | n.between(low, low + 2 ** (32 - int(bits)) - 1)
        return F.coalesce(hit & ~n.isin([_ipv4(x) for x in PUBLIC_EXCEPTIONS]), F.lit(False))

    return let(ipv4_number(host), inside)


def domain_display(url: Column) -> Column:
    """Authority of a URL, or the first 22 characters of its path."""
    return let(
        split_url(url),
        lambda u: F.coalesce(F.nullif(u.netloc, F.lit("")), F.substring(u.path, 1, 22)),
    )


def _quote(text: Column) -> Column:
    """Percent-encode all but letters, digits and ``_.-~/``."""
    # url_encode writes forms: spaces as '+', and leaves '*' alone
    encoded = F.url_encode(text)
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/")):
        encoded = F.replace(encoded, F.lit(form), F.lit(plain))
    return encoded


def _unquote(text: Column) -> Column:
    kept = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(kept), text)


def robots_path(url: Column) -> Column:
    """Path, query and fragment of a URL as robots rules compare them."""
    no_host = F.lit("")
    path = let(
        split_url(_unquote(url)),
        lambda u: let(
            F.struct(
                no_host.alias("scheme"),
                no_host.alias("netloc"),
                u.path.alias("path"),
                u.params.alias("params"),
                u.query.alias("query"),
                u.fragment.alias("fragment"),
            ),
            _unsplit,
        ),
    )
    return default_path(_quote(path))


def robots_prefix(path: Column) -> Column:
    """A rule's path in the form of ``robots_path``."""
    return _quote(path)
