"""Queries for the scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetables.functions import html, outcome, text, urls
from pagetables.operators import records, tables
from pagetables.plans import history, report

from . import rendered, views
from .registry import query, table
from .views import LOG_SQL, RESPONSES_SQL, RUNS_SQL, WS, sql_clean


def _case(key: Column, values: list[str]) -> Column:
    """One of several templates, chosen by key; '#' stands for the key."""
    chosen = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        chosen = F.when(key % len(values) == i, v).otherwise(chosen)
    return F.replace(chosen, F.lit("#"), key.cast("string"))


def _sql_case(key: str, values: list[str | None]) -> str:
    arms = " ".join(
        f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'") for i, v in enumerate(values)
    )
    return f"replace(CASE {key} % {len(values)} {arms} END, '#', CAST({key} AS VARCHAR))"


_DIRTY_SQL = "' ' || lang || chr(9) || chr(10) || text || chr(160) || chr(8195) || source || chr(28)"


@query(f"SELECT doc_id, {sql_clean(_DIRTY_SQL)} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    dirty = F.concat(
        F.lit(" "), F.col("lang"), F.lit("\t\n"), F.col("text"), F.lit("  "), F.col("source"), F.lit("\x1c")
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_text(dirty).alias("cleaned"))


@query(
    f"SELECT page_id, md5(regexp_replace(regexp_replace(html, '{views.SCRUB}', '', 'g'), "
    r"'(?s)<[a-zA-Z/!?][^>]*(>|\z)', '', 'g')) AS text_md5 FROM pages"
)
def strip_markup(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(html.strip_markup(F.col("html"))).alias("text_md5"))


@query(
    "SELECT doc_id, text || ' é é é € < > & &nosuch; © &am – ' || lang || '' AS decoded FROM documents"
)
def decode_entities(spark, sf_dir):
    escaped = F.col("text")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&#62;"), ('"', "&quot;"), ("é", "&eacute;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(name))
    extra = " &eacute; &#233; &#xE9; &#128; &lt; &gt &amp &nosuch; &copy &am &ndash; "
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.decode_entities(F.concat(escaped, F.lit(extra), F.col("lang"), F.lit("&#11;"))).alias("decoded"),
    )


# raw URL, sanitised URL, error; '#' is the key
_URLS = [
    ("", "", urls.EMPTY_URL),
    ("   ", "https://", urls.EMPTY_URL),
    ("  shop#.example.com  ", "https://shop#.example.com", ""),
    ("http://a#.b.example/x", "http://a#.b.example/x", ""),
    ("HTTP://A#.COM", "HTTP://A#.COM", ""),
    ("ftp://files#.example.com", "ftp://files#.example.com",
     "Invalid protocol 'ftp'. Only 'http://' and 'https://' are supported."),
    ("https://", "https://", urls.MISSING_HOST),
    ("//h#.com", "https:////h#.com", urls.MISSING_HOST),
    ("localhost", "https://localhost", ""),
    ("localhost:3000", "localhost:3000", "Invalid protocol 'localhost'. Only 'http://' and 'https://' are supported."),
    ("http://nodot#", "http://nodot#", "Invalid domain name 'nodot#'. Expected format like 'example.com'."),
    ("http://a#.b:81/x?y#z", "http://a#.b:81/x?y#z", ""),
    ("http://[x#", "http://[x#", urls.MALFORMED_URL),
    ("http://user:pw@h#.com", "http://user:pw@h#.com",
     "Invalid domain name 'user'. Expected format like 'example.com'."),
    ("mailto:c#@example.com", "mailto:c#@example.com",
     "Invalid protocol 'mailto'. Only 'http://' and 'https://' are supported."),
    (" example#.com/a b ", "https://example#.com/a b", ""),
]


@query(f"SELECT c_custkey, {_sql_case('c_custkey', [u[1] for u in _URLS])} AS sanitized FROM customer")
def sanitize_url(spark, sf_dir):
    raw = _case(F.col("c_custkey"), [u[0] for u in _URLS])
    return table(spark, sf_dir, "customer").select("c_custkey", urls.sanitize_url(raw).alias("sanitized"))


@query(
    f"SELECT c_custkey, error = '' AS is_valid, error FROM "
    f"(SELECT c_custkey, {_sql_case('c_custkey', [u[2] for u in _URLS])} AS error FROM customer)"
)
def validate_url(spark, sf_dir):
    raw = _case(F.col("c_custkey"), [u[0] for u in _URLS])
    checked = table(spark, sf_dir, "customer").select("c_custkey", urls.validate_url(raw).alias("v"))
    return checked.select("c_custkey", "v.is_valid", "v.error")


@query(
    "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS netloc, "
    "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || ':8080' AS with_port, '' AS relative FROM pages"
)
def url_netloc(spark, sf_dir):
    url = F.col("url")
    ported = F.upper(F.regexp_replace(url, "^([a-z]+://[^/?#]*).*$", "$1:8080?x=1"))
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.url_netloc(url).alias("netloc"),
        urls.url_netloc(ported).alias("with_port"),
        urls.url_netloc(F.regexp_replace(url, "^[a-z]+:/", "")).alias("relative"),
    )


# The RFC 3986 examples seen from http://a/b/c/d;p?q, on hosts made of the key.
_RELATIVE = [
    ("g:h", "g:h"), ("g", "http://a#/b/c/g"), ("./g", "http://a#/b/c/g"), ("g/", "http://a#/b/c/g/"),
    ("/g", "http://a#/g"), ("//g", "http://g"), ("?y", "http://a#/b/c/d;p?y"), ("g?y", "http://a#/b/c/g?y"),
    ("*s", "http://a#/b/c/d;p?q*s"), ("g*s", "http://a#/b/c/g*s"), ("g?y*s", "http://a#/b/c/g?y*s"),
    (";x", "http://a#/b/c/;x"), ("g;x", "http://a#/b/c/g;x"), ("", "http://a#/b/c/d;p?q"), (".", "http://a#/b/c/"),
    ("./", "http://a#/b/c/"), ("..", "http://a#/b/"), ("../g", "http://a#/b/g"), ("../..", "http://a#/"),
    ("../../g", "http://a#/g"), ("../../../g", "http://a#/g"), ("/./g", "http://a#/g"), ("/../g", "http://a#/g"),
    ("g.", "http://a#/b/c/g."), (".g", "http://a#/b/c/.g"), ("g..", "http://a#/b/c/g.."),
    ("./../g", "http://a#/b/g"), ("./g/.", "http://a#/b/c/g/"), ("g/./h", "http://a#/b/c/g/h"),
    ("g/../h", "http://a#/b/c/h"), ("g;x=1/./y", "http://a#/b/c/g;x=1/y"), ("g;x=1/../y", "http://a#/b/c/y"),
    ("g?y/./x", "http://a#/b/c/g?y/./x"), ("g*s/../x", "http://a#/b/c/g*s/../x"), ("http:g", "http://a#/b/c/g"),
    ("data:image/png,x", "data:image/png,x"), ("JavaScript:go", "JavaScript:go"),
    ("https://other#.example/x", "https://other#.example/x"),
]


@query(
    "SELECT c_custkey, replace(v.href, '*', '#') AS href, "
    "replace(replace(v.resolved, '#', CAST(c_custkey AS VARCHAR)), '*', '#') AS resolved "
    "FROM customer, LATERAL (VALUES "
    + ", ".join(f"('{h.replace('#', '')}', '{r}')" for h, r in _RELATIVE if "#" not in h)
    + ") v(href, resolved)"
)
def resolve_url(spark, sf_dir):
    hrefs = F.array(*[F.lit(h.replace("*", "#")) for h, _ in _RELATIVE if "#" not in h])
    base = F.concat(F.lit("http://a"), F.col("c_custkey"), F.lit("/b/c/d;p?q"))
    refs = rendered.table(spark, sf_dir, "customer").select("c_custkey", base.alias("base"), F.explode(hrefs).alias("href"))
    return refs.select("c_custkey", "href", urls.resolve_url(F.col("base"), F.col("href")).alias("resolved"))


@query(
    "SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'Internal' WHEN c_nationkey % 3 = 1 THEN 'External' "
    "ELSE 'Internal' END AS link_type FROM customer"
)
def link_type(spark, sf_dir):
    m = F.col("c_nationkey") % 3
    link = F.when(m == 0, "HTTPS://Shop.Example.com/x").when(m == 1, "https://shop.example.com:8443/").otherwise("/rel")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", urls.link_type(link, F.lit("shop.example.com")).alias("link_type")
    )


# First and last number of every private block.
_PRIVATE_SQL = """n BETWEEN 0 AND 16777215 OR n BETWEEN 167772160 AND 184549375 OR n BETWEEN 2130706432 AND 2147483647
  OR n BETWEEN 2851995648 AND 2852061183 OR n BETWEEN 2886729728 AND 2887778303 OR n BETWEEN 3221225472 AND 3221225727
  OR n BETWEEN 3221225984 AND 3221226239 OR n BETWEEN 3232235520 AND 3232301055 OR n BETWEEN 3323068416 AND 3323199487
  OR n BETWEEN 3325256704 AND 3325256959 OR n BETWEEN 3405803776 AND 3405804031 OR n BETWEEN 4026531840 AND 4294967295"""


@query(
    f"""SELECT c_custkey, host, is_literal AND ({_PRIVATE_SQL}) AND n NOT IN (3221225481, 3221225482) AS is_private
FROM (SELECT c_custkey, m <> 6 AS is_literal, a * 16777216 + b * 65536 + c * 256 + d AS n,
  CASE WHEN m = 6 THEN 'host' || c_custkey || '.example.com'
    WHEN c_custkey % 4 = 0 THEN '' || (a * 16777216 + b * 65536 + c * 256 + d)
    WHEN c_custkey % 4 = 1 THEN printf('0x%x.%d', a, b * 65536 + c * 256 + d)
    WHEN c_custkey % 4 = 2 THEN printf('%d.0%o.%d', a, b, c * 256 + d)
    ELSE a || '.' || b || '.' || c || '.' || d END AS host
  FROM (SELECT c_custkey, c_custkey % 7 AS m, c_custkey * 31 % 256 AS c, c_custkey % 256 AS d,
    CASE c_custkey % 7 WHEN 0 THEN 10 WHEN 1 THEN 172 WHEN 2 THEN 192 WHEN 3 THEN 169 WHEN 4 THEN 127
      ELSE c_custkey * 7 % 256 END AS a,
    CASE c_custkey % 7 WHEN 2 THEN 168 WHEN 3 THEN 254 ELSE c_custkey * 13 % 256 END AS b FROM customer))"""
)
def is_private_host(spark, sf_dir):
    k = F.col("c_custkey")
    m = k % 7
    a = F.when(m == 0, 10).when(m == 1, 172).when(m == 2, 192).when(m == 3, 169).when(m == 4, 127).otherwise(k * 7 % 256)
    b = F.when(m == 2, 168).when(m == 3, 254).otherwise(k * 13 % 256)
    c, d = k * 31 % 256, k % 256
    rest = c * 256 + d
    host = (
        F.when(m == 6, F.concat(F.lit("host"), k, F.lit(".example.com")))
        .when(k % 4 == 0, (a * 16777216 + b * 65536 + rest).cast("string"))
        .when(k % 4 == 1, F.concat(F.lit("0x"), F.lower(F.hex(a)), F.lit("."), b * 65536 + rest))
        .when(k % 4 == 2, F.concat(a, F.lit(".0"), F.conv(b, 10, 8), F.lit("."), rest))
        .otherwise(F.concat_ws(".", a, b, c, d))
    )
    url = F.concat(F.lit("http://"), host, F.lit(":80/x"))
    hosts = table(spark, sf_dir, "customer").select("c_custkey", urls.url_hostname(url).alias("host"))
    return hosts.select("*", urls.is_private_host(F.col("host")).alias("is_private"))


@query(
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'N/A' END AS label, "
    "CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN '[No Text / Image / Icon]' ELSE '[No Text / Image / Icon]' END "
    "AS link_text FROM customer"
)
def default_label(spark, sf_dir):
    m = F.col("c_custkey") % 3
    value = F.when(m == 0, F.col("c_name")).when(m == 1, "")
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        text.default_label(value, text.NOT_AVAILABLE).alias("label"),
        text.default_label(value, text.NO_LINK_TEXT).alias("link_text"),
    )


@query(
    f"""SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END::BIGINT AS word_count,
  length(t)::BIGINT AS character_count FROM (SELECT doc_id, {sql_clean('text')} AS t FROM documents)"""
)
def text_stats(spark, sf_dir):
    clean = table(spark, sf_dir, "documents").select("doc_id", text.clean_text(F.col("text")).alias("t"))
    return clean.select(
        "doc_id",
        text.word_count(F.col("t")).alias("word_count"),
        text.char_count(F.col("t")).alias("character_count"),
    )


@query("SELECT p_partkey, 'H' || (p_size % 6 + 1) AS tag, 'Heading ' || (p_size % 6 + 1) AS level FROM part")
def heading_label(spark, sf_dir):
    tags = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("H"), F.col("p_size") % 6 + 1).alias("tag"))
    return tags.select("*", text.heading_label(F.col("tag")).alias("level"))


@query(
    "SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, substr(regexp_replace("
    "regexp_replace(url, '^https?://[^/]+', ''), '[?#].*', ''), 1, 22) AS path_start FROM pages"
)
def domain_display(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://[^/]+", "")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        urls.domain_display(F.col("url")).alias("host"),
        urls.domain_display(path).alias("path_start"),
    )


@query(
    "SELECT event_id, CASE WHEN event_type = 'view' THEN 'Never' ELSE strftime(ts, '%H:%M:%S') END AS time_of_day FROM events"
)
def time_display(spark, sf_dir):
    stamp = F.when(F.col("event_type") != "view", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", outcome.time_display(stamp).alias("time_of_day"))


@query(
    f"WITH {LOG_SQL} SELECT event_id, CASE level WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' "
    "WHEN 'SUCCESS' THEN 'success' ELSE 'info' END AS level FROM log_lines"
)
def log_level(spark, sf_dir):
    return views.log_lines(spark, sf_dir).select("event_id", outcome.log_level(F.col("line")).alias("level"))


@query(
    f"WITH {LOG_SQL} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, level, "
    "event_type || ' by ' || user_id AS message FROM log_lines"
)
def log_parse(spark, sf_dir):
    parsed = views.log_lines(spark, sf_dir).select("event_id", outcome.parse_log_line(F.col("line")).alias("p"))
    return parsed.select(
        "event_id", F.date_format("p.timestamp", "yyyy-MM-dd HH:mm:ss").alias("at"), "p.level", "p.message"
    )


@query(
    f"""WITH {RESPONSES_SQL} SELECT page_id,
  CASE WHEN status_code IN (403, 404) OR status_code >= 500 OR page_id % 7 = 0 THEN 'failed'
    WHEN status_code <> 200 THEN 'warning' ELSE 'ok' END AS outcome,
  CASE WHEN status_code = 403 THEN '{outcome.HTTP_403}'
    WHEN status_code = 404 THEN '🔍 HTTP 404 Not Found: The requested URL ''' || url || ''' does not exist on the server.'
    WHEN status_code >= 500 THEN '⚠️ Server Error (HTTP ' || status_code
      || '): The remote server encountered an error while processing the request.'
    WHEN page_id % 7 = 0 THEN '{outcome.EMPTY_PAGE}' END AS error
FROM responses JOIN pages USING (page_id) WHERE status_code IS NOT NULL"""
)
def http_outcome(spark, sf_dir):
    body = F.when(F.col("page_id") % 7 == 0, " \n ").otherwise(F.col("html"))
    answered = views.responses(spark, sf_dir).where("status_code is not null")
    # outcomes are decided next to the page, so that no page moves: the responses are joined to a flag
    pages = views.pages(spark, sf_dir).select("page_id", "url", F.when(text.is_blank(body), "").otherwise("x").alias("html"))
    return (
        pages.join(answered, "page_id")
        .withColumn("o", outcome.http_outcome(F.col("status_code"), F.col("url"), F.col("html")))
        .select("page_id", "o.outcome", "o.error")
    )


@query(
    f"""WITH {RESPONSES_SQL} SELECT page_id, CASE fetch_error
    WHEN 'timeout' THEN '⏱️ Connection timeout: The target server at ''' || url || ''' did not respond within 10 seconds.'
    WHEN 'ssl' THEN '{outcome.TLS_ERROR.replace("'", "''")}'
    WHEN 'connection' THEN '❌ Connection Error: Unable to reach ''' || url
      || '''. The domain might be down, invalid, or blocking connections.'
    ELSE '❌ HTTP Request Exception: ' || fetch_error END AS message
FROM responses JOIN pages USING (page_id)"""
)
def fetch_error_message(spark, sf_dir):
    urls_only = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls_only.join(views.responses(spark, sf_dir), "page_id").select(
        "page_id", outcome.fetch_error_message(F.col("fetch_error"), F.col("url")).alias("message")
    )


@query(
    f"WITH {RUNS_SQL} SELECT id, round(execution_time / 3, 2) AS time2, "
    "CASE WHEN id % 5 > 0 THEN round(record_count / (id % 5) * 100, 1) ELSE 0.0 END AS rate1 FROM runs"
)
def round2(spark, sf_dir):
    return views.runs(spark, sf_dir).select(
        "id",
        outcome.seconds(F.col("execution_time") / 3).alias("time2"),
        outcome.percent(F.col("record_count"), F.col("id") % 5).alias("rate1"),
    )


_DISPLAY_SQL = ", ".join(f'{"runs." + c} AS "{n}"' for c, n in history.DISPLAY_COLUMNS.items())


@query(f"WITH {RUNS_SQL} SELECT {_DISPLAY_SQL} FROM runs")
def rename_display(spark, sf_dir):
    return history.rename_display(views.runs(spark, sf_dir).select(*history.DISPLAY_COLUMNS))


@query(
    f"WITH {RUNS_SQL} SELECT id, 'scraped_' || replace(lower(scrape_type || ' Of Page'), ' ', '_') || '_' || "
    "strftime(ts, '%Y%m%d_%H%M%S') AS name FROM runs JOIN events ON event_id = id"
)
def export_name(spark, sf_dir):
    kinds = views.runs(spark, sf_dir).select("id", "scrape_type", "timestamp")
    at = F.to_timestamp("timestamp", "yyyy-MM-dd HH:mm:ss")
    return kinds.select("id", outcome.export_name(F.concat("scrape_type", F.lit(" Of Page")), at).alias("name"))


# -- filters that work on one value -------------------------------------------------

_HREFS = ["", "#a", "javascript:x", "mailto:m", "tel:1", "JavaScript:x", "Mailto:m", "/a#b", "x", " #", "data:image/x"]
_HREF_KEEP = [h for h in _HREFS if h and not h.startswith(("#", "javascript:", "mailto:", "tel:"))]


@query(
    f"SELECT o_orderkey, href FROM (SELECT o_orderkey, {_sql_case('o_orderkey', [h.replace('#', '~') for h in _HREFS])} AS href "
    "FROM orders) WHERE href IN (" + ", ".join("'" + h.replace("#", "~") + "'" for h in _HREF_KEEP) + ")"
)
def filter_link_scheme(spark, sf_dir):
    href = F.replace(_case(F.col("o_orderkey"), [h.replace("#", "~") for h in _HREFS]), F.lit("~"), F.lit("#"))
    kept = table(spark, sf_dir, "orders").select("o_orderkey", href.alias("href")).where(
        records.is_followable(F.col("href"))
    )
    return kept.withColumn("href", F.replace("href", F.lit("#"), F.lit("~")))


@query(
    "SELECT o_orderkey, src FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'data:image/png,x' "
    "WHEN 2 THEN 'data:text/x' ELSE '/i/' || o_orderkey END AS src FROM orders) WHERE src <> '' AND src NOT LIKE 'data:image%'"
)
def filter_data_uri(spark, sf_dir):
    k = F.col("o_orderkey")
    src = F.when(k % 4 == 0, "").when(k % 4 == 1, "data:image/png,x").when(k % 4 == 2, "data:text/x")
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", F.coalesce(src, F.concat(F.lit("/i/"), k)).alias("src"))
        .where(records.is_loadable(F.col("src")))
    )


@query(
    f"SELECT conv_id, turn, t FROM (SELECT conv_id, turn, {sql_clean('text')} AS t FROM conversations) WHERE length(t) >= 3"
)
def filter_short_text(spark, sf_dir):
    clean = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_text(F.col("text")).alias("t"))
    return clean.where(records.is_long_enough(F.col("t")))


@query("SELECT page_id FROM pages WHERE page_id % 5 = 0")
def filter_blank_body(spark, sf_dir):
    body = F.when(F.col("page_id") % 5 == 0, F.lit(" \t　\n")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").where(text.is_blank(body)).select("page_id")


@query(
    "SELECT o_orderkey, o_orderkey % 2 = 0 AS has_text FROM orders WHERE o_orderkey % 2 = 0"
)
def filter_empty_rows(spark, sf_dir):
    cells = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit(""), F.col("o_orderstatus"))).otherwise(F.array(F.lit(""), F.lit("")))
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", tables.has_text(cells).alias("has_text"))
        .where("has_text")
    )
