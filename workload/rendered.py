"""Pages rendered from table rows, one page per row, so that the expected records
are the rows themselves. Rendering is a projection: no grouping, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table as small_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rows that pages are rendered from, dealt out before they are rendered: the
    given tables have one row group each. The pages themselves are not moved."""
    rows = small_table(spark, sf_dir, name)
    # a given number, because the rows are small and would be put back into few tasks
    return rows.repartition(4 * spark.sparkContext.defaultParallelism, rows.columns[0])


def _fill(template: str, **values: Column) -> Column:
    """The template with every {name} replaced by a column."""
    parts: list[Column] = []
    rest = template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven tables per order, one for every way a table can be written."""
    html = _fill(
        """<html><body><table class="a>b"><thead><tr><th>Order</th><TD> Status </TD><th>Priority</th></tr></thead>
<tbody><tr><td>{k}</td><td><span title='</td>'>{s}</span></td><td>{p}&nbsp;</td></tr></tbody>
<tbody><tr><td>not read</td></tr></tbody></table>
<table><tr><td>c{c}</td><td>first</td></tr><tr><th>Customer</th><th>Note</th></tr><tr><td>c{c}<td>R&amp;D
</table>
<TABLE><TR><TD>{k}<TD>x<TD>y<TR><TD>{c}<TR><TD> <TD></TABLE>
<table><thead><tr><th>One</th></tr></thead><tbody><tr><td>{k}</td><td>{s}</td></tr></tbody></table>
<table><tr><td></td></tr><tr></tr></table>
<table><thead><tr><th>A</th><th></th><th>A</th><th> </th><th>A</th></tr></thead><tbody>
<tr><td>1</td><td>2</td><td>{s}</td><td>4</td><td>{k}</td></tr></tbody></table>
<table><thead><tr><th>Key</th></tr></thead><tr><td>{k}</td></tr></table></body></html>""",
        k=F.col("o_orderkey"),
        s=F.col("o_orderstatus"),
        p=F.col("o_orderpriority"),
        c=F.col("o_custkey"),
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page_id"), F.lit("https://orders.example.com/").alias("url"), html.alias("html")
    )


# (table_no, row_no, names, cells); a cell is SQL over orders
_TABLE_ROWS = [
    (1, 1, ["Order", "Status", "Priority"], ["o_orderkey", "o_orderstatus", "o_orderpriority"]),
    (2, 1, ["Customer", "Note"], ["'c' || o_custkey", "'first'"]),
    (2, 2, ["Customer", "Note"], ["'c' || o_custkey", "'R&D'"]),
    (3, 1, ["Column 1", "Column 2", "Column 3"], ["o_orderkey", "'x'", "'y'"]),
    (3, 2, ["Column 1", "Column 2", "Column 3"], ["o_custkey", "''", "''"]),
    (4, 1, ["Column 1", "Column 2"], ["o_orderkey", "o_orderstatus"]),
    (6, 1, ["A", "Column", "A_1", "Column_1", "A_2"], ["'1'", "'2'", "o_orderstatus", "'4'", "o_orderkey"]),
    (7, 1, ["Key"], ["'Key'"]),
    (7, 2, ["Key"], ["o_orderkey"]),
]


def _long(rows: list) -> str:
    """SQL of the expected cells, one row per cell."""
    values = ", ".join(
        f"({t}, {r}, {c}, '{name}', CAST({cell} AS VARCHAR))"
        for t, r, names, cells in rows
        for c, (name, cell) in enumerate(zip(names, cells), 1)
    )
    return (
        "SELECT o_orderkey AS page_id, v.table_no::BIGINT AS table_no, v.row_no::BIGINT AS row_no, "
        "v.col_no::BIGINT AS col_no, v.col_name, v.cell "
        f"FROM orders, LATERAL (VALUES {values}) v(table_no, row_no, col_no, col_name, cell)"
    )


TABLES_LONG_SQL = _long(_TABLE_ROWS)
TABLES_MAP_SQL = " UNION ALL ".join(
    f"SELECT o_orderkey AS page_id, {t}::BIGINT AS table_no, 'Table {t}' AS table_label, {r}::BIGINT AS row_no, "
    + "CAST(json_object("
    + ", ".join(f"'{n}', CAST({c} AS VARCHAR)" for n, c in zip(names, cells))
    + ") AS VARCHAR) AS record FROM orders"
    for t, r, names, cells in _TABLE_ROWS
)


def _wide(columns: list[str]) -> str:
    """SQL of the expected rows with these columns, null where a table lacks one."""
    return " UNION ALL ".join(
        f"SELECT o_orderkey AS page_id, {t}::BIGINT AS table_no, 'Table {t}' AS table_label, {r}::BIGINT AS row_no, "
        + ", ".join(f'CAST({dict(zip(names, cells)).get(w, "NULL")} AS VARCHAR) AS "{w}"' for w in columns)
        + " FROM orders"
        for t, r, names, cells in _TABLE_ROWS
    )


WIDE_COLUMNS = ["Order", "Status", "Customer", "Column 1", "Column 2", "A_1", "Key"]
TABLES_WIDE_SQL = _wide(WIDE_COLUMNS)
# Every column of every table.
ALL_COLUMNS = list(dict.fromkeys(n for _, _, names, _ in _TABLE_ROWS for n in names))
UNION_TABLES_SQL = _wide(ALL_COLUMNS)


def nested_table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in a cell of another one, two levels deep, and one behind them."""
    html = _fill(
        """<table><tr><th>H</th></tr><tr><td>{k}<table><tr><td>{s}</td><td>i</td></tr><tr><td>{c}
<table><tr><td>deep</td></tr></table></td></tr></table>z</td></tr></table><table><tr><td>{p}</td></tr></table>""",
        k=F.col("o_orderkey"),
        s=F.col("o_orderstatus"),
        p=F.col("o_orderpriority"),
        c=F.col("o_custkey"),
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("page_id"), F.lit("https://orders.example.com/").alias("url"), html.alias("html")
    )


_WIDE5 = ["Column 1", "Column 2", "Column 3", "Column 4", "Column 5"]
NESTED_SQL = _long(
    [
        (1, 1, _WIDE5, ["o_orderkey || o_orderstatus || 'i' || o_custkey || ' deepz'", "o_orderstatus", "'i'",
                        "o_custkey || ' deep'", "'deep'"]),
        (1, 2, _WIDE5, ["o_orderstatus", "'i'", "''", "''", "''"]),
        (1, 3, _WIDE5, ["o_custkey || ' deep'", "'deep'", "''", "''", "''"]),
        (1, 4, _WIDE5, ["'deep'", "''", "''", "''", "''"]),
        (2, 1, _WIDE5[:2], ["o_orderstatus", "'i'"]),
        (2, 2, _WIDE5[:2], ["o_custkey || ' deep'", "'deep'"]),
        (2, 3, _WIDE5[:2], ["'deep'", "''"]),
        (3, 1, _WIDE5[:1], ["'deep'"]),
        (4, 1, _WIDE5[:1], ["o_orderpriority"]),
    ]
)


def link_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of every spelling, one page per customer."""
    html = _fill(
        """<body><a href="/c/{k}">{n}</a> <A HREF='item-{k}.html?a=1&amp;b=2#top' TARGET=_blank>Item <b>{k}</b></A>
<a title="see href=/no > x" href=../up/{k}>Up</a><a href="//cdn.example.net/{m}">cdn</a>
<a href="HTTPS://Other.example.org/{k}" target="">Other</a><a href="https://SHOP.example.com/x">Same host</a>
<a href="/c/{k}" target="_top">{n}</a><a href=" /c/{k} ">again</a><a href="#top">jump</a><a href="javascript:go({k})">js</a>
<a href="mailto:c{k}@example.com">mail</a><a href="tel:{k}">call</a><a name="x">no link</a><a href="">empty</a>
<a href="?page={k}"><img src="i.png"></a><a href="ftp://files.example.com/{k}">files</a>
<!-- <a href="/hidden">hidden</a> --><script>var a = '<a href="/js">js</a>';</script></body>""",
        k=F.col("c_custkey"),
        n=F.col("c_name"),
        m=F.col("c_mktsegment"),
    )
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("page_id"),
        F.lit("https://shop.example.com/a/b/index.html?q=1").alias("url"),
        html.alias("html"),
    )


# (text, url, type, target); SQL over customer
_LINK_ROWS = [
    ("c_name", "'https://shop.example.com/c/' || c_custkey", "Internal", "_self"),
    ("'Item ' || c_custkey", "'https://shop.example.com/a/b/item-' || c_custkey || '.html?a=1&b=2#top'", "Internal", "_blank"),
    ("'Up'", "'https://shop.example.com/a/up/' || c_custkey", "Internal", "_self"),
    ("'cdn'", "'https://cdn.example.net/' || c_mktsegment", "External", "_self"),
    ("'Other'", "'https://Other.example.org/' || c_custkey", "External", ""),
    ("'Same host'", "'https://SHOP.example.com/x'", "Internal", "_self"),
    ("'again'", "'https://shop.example.com/c/' || c_custkey", "Internal", "_self"),
    ("'[No Text / Image / Icon]'", "'https://shop.example.com/a/b/index.html?page=' || c_custkey", "Internal", "_self"),
    ("'files'", "'ftp://files.example.com/' || c_custkey", "External", "_self"),
]
RENDERED_LINKS_SQL = (
    "SELECT c_custkey AS page_id, v.record_no::BIGINT AS record_no, v.text, v.link_url, v.link_type, v.target "
    "FROM customer, LATERAL (VALUES "
    + ", ".join(f"({i}, {t}, {u}, '{k}', '{w}')" for i, (t, u, k, w) in enumerate(_LINK_ROWS, 1))
    + ") v(record_no, text, link_url, link_type, target)"
)


def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of every spelling, one page per part."""
    html = _fill(
        """<img src="/img/{k}.png" alt="{n}"><IMG SRC=thumb/{k}.gif ALT='a &lt; b
c'><img data-src="lazy/{k}.jpg" src=""><img src="   " data-src="/blocked.png"><img src="data:image/png;base64,AA">
<img src="/img/{k}.png" alt="again"><img src="https://cdn.example.net/{k}"><img alt="nothing"><img src="//x.example.org/i" alt=" ">""",
        k=F.col("p_partkey"),
        n=F.col("p_name"),
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"), F.lit("http://parts.example.com/shop/").alias("url"), html.alias("html")
    )


_IMAGE_ROWS = [
    ("p_name", "'http://parts.example.com/img/' || p_partkey || '.png'", "Internal"),
    ("'a < b c'", "'http://parts.example.com/shop/thumb/' || p_partkey || '.gif'", "Internal"),
    ("'[No Alt Text]'", "'http://parts.example.com/shop/lazy/' || p_partkey || '.jpg'", "Internal"),
    ("'[No Alt Text]'", "'https://cdn.example.net/' || p_partkey", "External"),
    ("'[No Alt Text]'", "'http://x.example.org/i'", "External"),
]
RENDERED_IMAGES_SQL = (
    "SELECT p_partkey AS page_id, v.record_no::BIGINT AS record_no, v.alt_text, v.image_url, v.image_type "
    "FROM part, LATERAL (VALUES "
    + ", ".join(f"({i}, {a}, {u}, '{k}')" for i, (a, u, k) in enumerate(_IMAGE_ROWS, 1))
    + ") v(record_no, alt_text, image_url, image_type)"
)


def heading_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings in document order, one page per part."""
    html = _fill(
        """<h1>{n}</h1><H2 class="x">{b} <em>by</em>
{t}</H2><h3> </h3><h2>{n}</h2><h1>{n}</h1><p>text</p><h4>Size&#32;{s} &eacute;</h4><div><h6>no end<p>para</p></div>
<h5>{b}<!-- note --></h5><template></template>""",
        n=F.col("p_name"),
        b=F.col("p_brand"),
        t=F.col("p_type"),
        s=F.col("p_size"),
    )
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"), F.lit("http://parts.example.com/").alias("url"), html.alias("html")
    )


_HEADING_ROWS = [
    ("1", "p_name"),
    ("2", "p_brand || ' by ' || p_type"),
    ("2", "p_name"),
    ("4", "'Size ' || p_size || ' é'"),
    ("6", "'no end'"),
    ("5", "p_brand"),
]
RENDERED_HEADINGS_SQL = (
    "SELECT p_partkey AS page_id, v.record_no::BIGINT AS record_no, 'Heading ' || v.n AS level, 'H' || v.n AS tag, "
    "v.heading_text, length(v.heading_text)::BIGINT AS character_count FROM part, LATERAL (VALUES "
    + ", ".join(f"({i}, '{n}', {t})" for i, (n, t) in enumerate(_HEADING_ROWS, 1))
    + ") v(record_no, n, heading_text)"
)


def meta_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and metadata in eight variants, one page per customer."""
    k, n = F.col("c_custkey"), F.col("c_name")
    variants = [
        '<title>{n}</title><meta name="description" content="About {n}"><link rel="canonical" href="/c/{k}">',
        "<title> </title><meta property='og:description' content='OG {n}'>",
        '<meta name="description" content=""><meta property="og:description" content="not used"><title>{n} &amp; Co</title>',
        '<META CONTENT="Tw {k}" NAME="Twitter:Description"><link rel="alternate canonical" href="https://x.example.org/{k}">',
        '<title>a</title><title>b</title><link rel="canonical"><link rel="canonical" href="/second">',
        '<svg><title>{n}</title></svg><title>later</title><link href=" c{k} " rel=canonical>',
        '<meta property="description" content="no"><link rel="Canonical" href="/no"><title>{n}\n\t{k}</title>',
        "<title>{n}",
    ]
    html = F.lit("")
    for i, v in enumerate(variants):
        html = F.when(k % len(variants) == i, _fill(v, k=k, n=n)).otherwise(html)
    return table(spark, sf_dir, "customer").select(
        k.alias("page_id"), F.lit("https://shop.example.com/a/").alias("url"), html.alias("html")
    )


META_SQL = """SELECT page_id, page_title, length(page_title)::BIGINT AS length_chars, meta_description, canonical_url
FROM (SELECT c_custkey AS page_id,
  CASE c_custkey % 8 WHEN 0 THEN c_name WHEN 1 THEN '' WHEN 2 THEN c_name || ' & Co' WHEN 3 THEN 'No Title Found'
    WHEN 4 THEN 'a' WHEN 5 THEN c_name WHEN 6 THEN c_name || ' ' || c_custkey ELSE c_name END AS page_title,
  CASE c_custkey % 8 WHEN 0 THEN 'About ' || c_name WHEN 1 THEN 'OG ' || c_name WHEN 3 THEN 'Tw ' || c_custkey
    ELSE 'N/A' END AS meta_description,
  CASE c_custkey % 8 WHEN 0 THEN 'https://shop.example.com/c/' || c_custkey WHEN 3 THEN 'https://x.example.org/' || c_custkey
    WHEN 5 THEN 'https://shop.example.com/a/c' || c_custkey ELSE 'N/A' END AS canonical_url
  FROM customer)"""


def mixed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all six kinds on one page, with a table in a table; odd customers have
    a second, plain table, multiples of five no table at all."""
    k = F.col("c_custkey")
    head = """<title>Customer {k}</title><meta name=description content="Of {m}"><link rel=canonical href="/c/{k}"><h1>{n}</h1>
<p>Segment {m} &amp; more.</p><a href="/s/{m}">Segment</a><img src="{k}.png" alt="{n}"><h2>{n}</h2>"""
    nested = "<table><tr><td>{n}<table><tr><td>{k}</td></tr></table></td></tr></table>"
    plain = "<table><tr><th>Name</th><th>Segment</th></tr><tr><td>{n}</td><td>{m}</td></tr></table>"
    fill = lambda t: _fill(t, k=k, n=F.col("c_name"), m=F.col("c_mktsegment"))
    html = F.concat(
        fill(head),
        F.when(k % 5 == 0, F.lit("")).when(k % 2 == 1, fill(plain)).otherwise(fill(nested)),
    )
    return table(spark, sf_dir, "customer").select(
        k.alias("page_id"), F.lit("https://shop.example.com/a/b").alias("url"), html.alias("html")
    )


# (page_id, scrape_type, record_no, payload) of the mixed pages.
MIXED_SQL = """mixed AS (
  SELECT c_custkey AS page_id, 'Page Title' AS scrape_type, 1::BIGINT AS record_no, json_object('Page Title', 'Customer ' || c_custkey,
    'Length (Chars)', length('Customer ' || c_custkey), 'Meta Description', 'Of ' || c_mktsegment, 'Canonical URL',
    'https://shop.example.com/c/' || c_custkey) AS payload FROM customer
  UNION ALL SELECT c_custkey, 'Headings', i, json_object('Level', 'Heading ' || i, 'Tag', 'H' || i, 'Heading Text', c_name,
    'Character Count', length(c_name)) FROM customer, (VALUES (1::BIGINT), (2::BIGINT)) v(i)
  UNION ALL SELECT c_custkey, 'Links', 1, json_object('Text', 'Segment', 'URL', 'https://shop.example.com/s/' || c_mktsegment,
    'Type', 'Internal', 'Target', '_self') FROM customer
  UNION ALL SELECT c_custkey, 'Paragraphs', 1, json_object('Paragraph #', 1, 'Paragraph Text', 'Segment ' || c_mktsegment || ' & more.',
    'Word Count', 4, 'Character Count', length('Segment ' || c_mktsegment || ' & more.')) FROM customer
  UNION ALL SELECT c_custkey, 'Images', 1, json_object('Alt Text', c_name, 'Image URL', 'https://shop.example.com/a/' || c_custkey || '.png',
    'Type', 'Internal') FROM customer
  UNION ALL SELECT c_custkey, 'Tables', 1, json_object('Name', c_name, 'Segment', c_mktsegment) FROM customer
    WHERE c_custkey % 5 <> 0 AND c_custkey % 2 = 1
  UNION ALL SELECT c_custkey, 'Tables', i, CASE i
      WHEN 1 THEN json_object('Table #', 'Table 1', 'Column 1', c_name || c_custkey, 'Column 2', '' || c_custkey)
      WHEN 2 THEN json_object('Table #', 'Table 1', 'Column 1', '' || c_custkey, 'Column 2', '')
      ELSE json_object('Table #', 'Table 2', 'Column 1', '' || c_custkey) END
    FROM customer, (VALUES (1::BIGINT), (2::BIGINT), (3::BIGINT)) v(i) WHERE c_custkey % 5 <> 0 AND c_custkey % 2 = 0)"""
