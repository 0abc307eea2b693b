import gzip
import json
import os
import random
import re
import time
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagetables.functions import html, text
from pagetables.functions.arrays import explode_items
from pagetables.operators import extract as x
from pagetables.operators import flat_tables, nested_tables, tables
from pagetables.session import new_folder
from pagetables.sources import archives
from pagetables.sources.pages import read_pages
from workload import rendered

# One page for the rules of every kind: what is kept, merged, numbered, left out.
ORCHARD = """<html><body><img data-src=map.png><h4>Pears &amp; <i>quinces</i></h4><p>Ripe in <b>late</b>
October.</p><ul><li><a href="?sort=size">by size</a><li><a name=top>no address</a><li><a href=HTTP://seeds.example/>Seeds</a></ul>
<h4>Pears & quinces</h4><h2>&nbsp;</h2><p>ok</p><p>ok!</p><p>Ripe in late October.</p>
<table><tr><th>Tree<th>Rows<th>Tree</tr><tr><td>Pear<td>12<td>old</tr><tr><td> <td></tr><tr><td>Quince</table>
<img src="data:image/gif;base64,R0" alt=dot><img src=map.png alt=twice><a href="mailto:me@seeds.example">write</a>
</body><head><meta property="og:description" content=" Fruit	list "><link href=//cdn.example/o rel="author CANONICAL canonical"></head></html>"""


def rows(frame, *columns):
    picked = [tuple(r) for r in frame.select(*columns).collect()]
    return sorted(picked)


def test_orchard_page(pages_of):
    pages = pages_of(ORCHARD, url="http://grove.example/trees/list.html")
    assert rows(x.extract_images(pages), "alt_text", "image_url", "image_type") == [
        ("[No Alt Text]", "http://grove.example/trees/map.png", "Internal")
    ]
    assert rows(x.extract_paragraphs(pages), "paragraph_no", "paragraph_text", "word_count", "character_count") == [
        (1, "Ripe in late October.", 4, 21), (2, "ok!", 1, 3),
    ]
    assert rows(x.extract_headings(pages), "record_no", "level", "heading_text") == [(1, "Heading 4", "Pears & quinces")]
    assert rows(x.extract_links(pages), "record_no", "text", "link_url", "link_type") == [
        (1, "by size", "http://grove.example/trees/list.html?sort=size", "Internal"),
        (2, "Seeds", "http://seeds.example/", "External"),
    ]
    wide = x.extract_tables_wide(pages, ["Tree_1", "Tree", "Crown"])
    assert rows(wide, "row_no", "Tree", "Tree_1", "Crown") == [(1, "Pear", "old", None), (2, "Quince", "", None)]
    title = x.extract_title(pages).first()
    assert (title.page_title, title.meta_description, title.canonical_url) == (
        "No Title Found", "Fruit list", "http://cdn.example/o",
    )


def test_empty_pages_have_a_title_only(pages_of):
    pages = pages_of("", None, "<p>", "<table></table>")
    assert rows(x.extract_title(pages), "page_title", "length_chars") == [("No Title Found", 14)] * 4
    for kind in x.SCRAPE_TYPES[1:]:
        assert x.extract(pages, kind).count() == 0


def test_unclosed_and_hidden_markup(pages_of):
    pages = pages_of(
        "<p><b>one<br><p>two two<div>three</div><script>var t='</p><p>no</p>'</script><!-- <p>no</p> --><p>two two</p><p>ab",
        "<a href=/one>1<a href='/two'>2</a><a title='a > b' href=\"/three\">3",
    )
    assert rows(x.extract_paragraphs(pages), "page_id", "paragraph_text") == [(0, "one"), (0, "two two")]
    assert rows(x.extract_links(pages), "record_no", "text", "link_url") == [
        (1, "1", "https://example.com/one"), (2, "2", "https://example.com/two"), (3, "3", "https://example.com/three"),
    ]


def test_registry(pages_of):
    with pytest.raises(ValueError, match="Unknown scraping type 'Nothing'. Supported: \\['Page Title', 'Headings'"):
        x.extract(pages_of(ORCHARD), "Nothing")
    assert x.extract(pages_of(ORCHARD), "Headings").count() == 1


def test_caps_are_prefixes(pages_of):
    many = "".join(f"<p>para {i}</p><h2>h{i}</h2><a href='/{i}'>x</a><img src='/{i}'>" for i in range(12))
    pages = pages_of(many + "<table>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(12)) + "</table>")
    for kind in x.SCRAPE_TYPES[1:]:
        whole = rows(x.EXTRACTORS[kind](pages, None), "*")
        assert len(whole) == 12
        for cap in (1, 5, 300):
            assert rows(x.EXTRACTORS[kind](pages, cap), "*") == whole[:cap]
        for no_cap in (0, -1):
            assert rows(x.EXTRACTORS[kind](pages, no_cap), "*") == whole


TABLES = [
    "<table><tr><td>1</td></tr></table>",
    "<table><tr><td>x<tr><th>A<th>A<th><tr><td>1<td>2<td>3</table><table></table><table><tr><td>q<tr><td>w<td>e</table>",
    "<TABLE><THEAD><TR><TH>h</TH></TR></THEAD><TR><TD>v &lt; w</TD></TR></TABLE>",
    "<table><thead><tr><th>a<th>b</tr><tfoot><tr><td>f</td></tr></tfoot><tbody><tr><td>1<td>2</tr></tbody>"
    "<tbody><tr><td>no</td></tr></table>",
    "<table><tr><td>cut<td>off",
]


def test_both_readers_read_flat_tables_alike(pages_of):
    pages = pages_of(*TABLES)
    tags = F.when(html.has_tag(F.col("marked"), "table"), html.only_tags(F.col("marked"), tables.STRUCTURE))
    marked = x.mark_pages(pages).withColumn("found", nested_tables.nested_tables(tags))
    # the label says whether a page has several tables, which nesting implies
    kept = ("table_no", "row_no", "col_names", "cells")
    shaped = marked.select("page_id", tables.shape_nested(F.col("found")).alias("nested"))
    by_tags = explode_items(shaped, F.col("nested.tables"), "page_id", "nested").withColumnRenamed("r", "t").drop("i")
    by_tags = explode_items(by_tags, tables.nested_rows(F.col("nested.texts"), F.col("t")), "page_id")
    by_tags = rows(by_tags.select("page_id", *[f"r.{c}" for c in kept]), "*")
    by_array = rows(x._table_records(pages, None), "page_id", *kept)
    assert by_array == by_tags
    assert len(by_array) == 1 + 4 + 2 + 1 + 1


def test_nested_tables(pages_of):
    pages = pages_of(
        "<table><tr><td>a<table><thead><tr><th>H</th></tr></thead><tbody><tr><td>i</td></tr></tbody></table>z</td></tr></table>",
        "<table><tr><td>a<table><tr><td>i<td>j</table>z<td>b<tr><td>c</table><table><tr><td>after</table>",
    )
    assert rows(x._table_records(pages, None), "page_id", "table_no", "row_no", "col_names", "cells") == [
        # the outer table finds the inner head and body first
        (0, 1, 1, ["H"], ["i"]),
        (0, 2, 1, ["H"], ["i"]),
        (1, 1, 1, [f"Column {i}" for i in range(1, 5)], ["aijz", "i", "j", "b"]),
        (1, 1, 2, [f"Column {i}" for i in range(1, 5)], ["i", "j", "", ""]),
        (1, 1, 3, [f"Column {i}" for i in range(1, 5)], ["c", "", "", ""]),
        (1, 2, 1, ["Column 1", "Column 2"], ["i", "j"]),
        (1, 3, 1, ["Column 1"], ["after"]),
    ]


def deep(n):
    return "".join(f"<table><tr><td>c{i}" for i in range(n)) + "</td></tr></table>" * n


def test_deep_tables_hold_each_cell_once(spark, pages_of):
    """The page's row stays small; tables show the rows of the tables inside."""
    page = deep(500)
    tags = "".join(f"\x01{e}\x02\x03{t}" for e, t in re.findall(r"<(/?[a-z]+)>([^<]*)", page))
    start = time.perf_counter()
    found = nested_tables.read_tables(tags)
    assert time.perf_counter() - start < 1
    assert len(found["cells"]) == len(found["rows"]) == len(found["tables"]) == 500
    assert found["tables"][0]["rows"] == {"first": 0, "n": 500} and found["rows"][499] == {"first": 499, "n": 1}
    pages = pages_of(page)
    assert x.page_tables(pages).select(F.size("nested.texts")).first()[0] == 500
    shape = {r.table_no: (r.n_rows, r.n_cols) for r in x.table_shape(pages).collect()}
    assert shape == {k: (501 - k, 501 - k) for k in range(1, 501)}
    small = rows(x.extract_tables(pages_of(deep(6))), "table_no", "row_no", "col_no", "cell")
    text = lambda a: "".join(f"c{i}" for i in range(a, 6))
    want = [(t, r - t + 1, c - r + 1, text(c - 1)) for t in range(1, 7) for r in range(t, 7) for c in range(r, 7)]
    want += [(t, r - t + 1, c + 1, "") for t in range(1, 7) for r in range(t, 7) for c in range(7 - r, 7 - t)]
    assert small == sorted(want)


@pytest.mark.parametrize("most", [1, 2, 3, 7])
def test_cap_over_nested_tables(pages_of, most):
    pages = pages_of(deep(3), "<table><tr><td>x<tr><td>y</table>")
    every = x._table_records(pages, None).orderBy("page_id", "table_no", "row_no").collect()
    want = [r for p in (0, 1) for r in [r for r in every if r.page_id == p][:most]]
    assert x._table_records(pages, most).orderBy("page_id", "table_no", "row_no").collect() == want
    assert {r.page_id: r.n for r in x.page_records(pages, most).select("page_id", tables.row_count().alias("n")).collect()} == {
        p: len([r for r in want if r.page_id == p]) for p in (0, 1)
    }
    numbers = x.extract_all(pages, most).where("scrape_type = 'Tables'").orderBy("page_id", "record_no").collect()
    assert [(r.page_id, r.record_no) for r in numbers] == [(p, i + 1) for p in (0, 1) for i in range(len([r for r in want if r.page_id == p]))]


def test_colliding_headers_keep_all_cells(pages_of):
    pages = pages_of("<table><thead><tr><th>A<th>A<th>A_1</thead><tbody><tr><td>1<td>2<td>3</tbody></table>")
    assert x.extract_tables_map(pages).first().record == {"A": "1", "A_1": "2", "A_1#3": "3"}


def test_partitioning_does_not_matter(spark):
    pages = rendered.link_pages(spark, "/root/testdata/sf0.001")
    one = rows(x.extract_all(pages.coalesce(1)), "*")
    assert one == rows(x.extract_all(pages.repartition(13)), "*")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_one_scan_and_no_exchange_over_the_given_pages(spark):
    pages = read_pages(spark, "/root/testdata/sf0.001/pages.parquet")
    frames = {kind: x.extract(pages, kind) for kind in x.SCRAPE_TYPES}
    frames |= {
        "all": x.extract_all(pages),
        "map": x.extract_tables_map(pages),
        "wide": x.extract_tables_wide(pages, ["A"]),
        "shape": x.table_shape(pages),
    }
    for kind, frame in frames.items():
        plan = plan_of(frame)
        assert "Exchange" not in plan, kind
        assert plan.count("FileScan") == 1, kind


NESTED = "<h1>N</h1><table><tr><td>out<ta\x01ble><tr><td>in</table></table>"


def test_no_page_is_lost_or_mixed(spark, pages_of):
    # A control character hides the inner table from a look at the raw text.
    found = x.extract_all(pages_of(NESTED)).collect()
    assert sorted((r.scrape_type, r.record_no) for r in found) == [
        ("Headings", 1), ("Page Title", 1), ("Tables", 1), ("Tables", 2), ("Tables", 3),
    ]
    again = spark.createDataFrame(
        [(7, "https://a.example", NESTED), (7, "https://a.example", NESTED.replace("out", "new"))],
        "page_id bigint, url string, html string",
    )
    cells = rows(x._table_records(again, None), "page_id", "table_no", "row_no", "cells")
    assert cells == sorted(
        (7, *own)
        for word in ("out", "new")
        for own in [(1, 1, [word + "in", "in"]), (1, 2, ["in", ""]), (2, 1, ["in"])]
    )


def test_no_kind_is_capped_by_default(pages_of):
    page = "".join(f"<p>para {i}</p><h2>h{i}</h2><a href='/{i}'>x</a><img src='/{i}'>" for i in range(250))
    pages = pages_of(page + "<table>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(250)) + "</table>")
    for kind in x.SCRAPE_TYPES[1:]:
        assert x.extract(pages, kind).count() == 250
    assert x.extract_all(pages).count() == 5 * 250 + 1


def test_repeated_headers_are_counted_by_name(pages_of):
    names = "b a b a_1 a b a c".split()
    page = "<table><thead><tr>" + "".join(f"<th>{n}" for n in names) + "</thead><tbody><tr>" + "<td>1" * 8 + "</tbody></table>"
    assert x._table_records(pages_of(page), None).first().col_names == ["b", "a", "b_1", "a_1", "a_1", "b_2", "a_2", "c"]


def test_wide_tables_find_their_columns(spark, pages_of):
    many = ["<table><tr><th>Name<th>Age<tr><td>a<td>1</table>"] * 30
    pages = pages_of(*many, "<table><tr><td>only</table><table><tr><th>Late<th>name<th>page_id<tr><td>x<td>y<td>z</table>").repartition(5)
    wide = x.extract_tables_wide(pages)
    assert wide.columns[4:] == ["Name", "Age", "Column 1", "Late", "name#5", "page_id#6"]
    found = {(r.page_id, r.table_no): tuple(r)[4:] for r in wide.collect()}
    assert found[(0, 1)] == ("a", "1", None, None, None, None)
    assert found[(30, 1)] == (None, None, "only", None, None, None) and found[(30, 2)] == (None, None, None, "x", "y", "z")
    assert x.table_columns(pages_of(deep(3))) == ["Column 1", "Column 2", "Column 3"]
    assert x.table_columns(pages_of("no table")) == [] and x.extract_tables_wide(pages_of("no table")).count() == 0
    with pytest.raises(ValueError, match="more than 3 different columns"):
        x.table_columns(pages, most=3)


def test_wide_tables_read_their_pages_once(spark):
    """Each reading of these pages gives other headers: names and cells are of the same one."""
    page = F.udf(lambda i: f"<table><tr><th>{uuid.uuid4()}<tr><td>x</table>").asNondeterministic()
    pages = spark.range(3).select(F.col("id").alias("page_id"), F.lit("https://a.example").alias("url"), page("id").alias("html"))
    wide = x.extract_tables_wide(pages)
    assert len(wide.columns) == 7 and sorted(c for r in wide.collect() for c in tuple(r)[4:] if c) == ["x"] * 3
    nested = [deep(3), "<table><tr><th>B<th>A<tr><td>1<td>2</table>", "<table><tr><td>p<tr><td><td></table><table></table>", "", None]
    # Two of the pages have no id.
    given = [(i % 3 if i < 8 else None, "https://a.example", t) for i, t in enumerate(nested * 2)]
    pages = spark.createDataFrame(given, "page_id bigint, url string, html string")
    columns = x.table_columns(pages)
    shown = lambda frame: (frame.columns, sorted(map(repr, frame.collect())))
    assert shown(x.extract_tables_wide(pages)) == shown(x.extract_tables_wide(pages, columns))


ODD_TABLES = [
    "x<table>no<b>cell</b><TR> no <Td title='</td>'> a <i>b</i>\n c </TD> no <b>no</b> < no <tH>d<!-- <td>no</td> --></tR><td>no<tr><td>e</table>no",
    "</table><td>no<table><tr id=1><td a=<td>f</td><tr></tr><tr><td> &nbsp; </td></tr></TABLE><tr><td>no</td></tr>",
    "<table><THEAD><td>h<tr><th>i</tr><td>j</thead>no<tr><td>1<td>2<td>3 </table><table><tr><td>&lt;&#116;d&gt; </tr ",
]


def test_texts_and_tags_around_cells(pages_of):
    """Tags in any case, texts outside of cells, tags in quotes and comments; in a table's row, in the page's row, and
    with the other kinds."""
    pages = pages_of(*ODD_TABLES)
    kept = ("page_id", "table_no", "row_no", "col_names", "cells")
    found = rows(x._table_records(pages, None), *kept)
    assert found == [
        (0, 1, 1, ["Column 1", "Column 2"], ["a b c", "d"]), (0, 1, 2, ["Column 1", "Column 2"], ["e", ""]),
        (1, 1, 1, ["Column 1"], ["f"]),
        (2, 1, 1, ["h", "i", "j"], ["i", "", ""]), (2, 1, 2, ["h", "i", "j"], ["1", "2", "3"]), (2, 2, 1, ["Column 1"], ["<td>"]),
    ]
    assert rows(x._table_records(pages, 100), *kept) == found
    together = explode_items(x.page_records(pages), F.col("table_rows"), "page_id").select("page_id", "r.*")
    assert rows(together, *kept) == found


def test_pages_read_together_are_read_as_alone(spark):
    """Random tags and texts: a batch of pages gives the rows that each page's own row gives."""
    draw = random.Random(4)
    names = [f"<{c}{n}>" for n in "td tr th table thead tbody tfoot".split() for c in ("", "", "/")]
    names += ["<td>"] * 12 + ["<tr>"] * 8 + ["<th>"] * 6 + ["<TD a='>'>", "</TABLE><table>", "<tH>", "<b>", "<!-- <td> -->"]
    texts = ["", "", "a", "b", "b", " c", "é \t", "&nbsp;", "&am", "p;lt;", " ", "\u2003 ", "&#32;&lt;", "日", "< "]
    pieces = lambda n: "".join(draw.choice(names) + draw.choice(texts) for _ in range(n))
    soup = ["x<table>" + pieces(draw.randint(20, 120)).replace("<table>", draw.choice(["</table><table>"] * 9 + ["<TABLE>"])) + draw.choice(texts) for _ in range(600)]
    pages = spark.createDataFrame([(i, "https://a.example", t) for i, t in enumerate([*soup, None, "", *ODD_TABLES])], "page_id bigint, url string, html string")
    pages = pages.repartition(2).cache()
    kept = ("page_id", "table_no", "table_label", "row_no", "col_names", "cells")
    shown = lambda frame: sorted(map(repr, frame.select(*kept).collect()))
    want = shown(x._table_records(pages, 1 << 30))
    assert shown(x._table_records(pages, None)) == want and len(want) > 800


def test_a_long_batch_is_read_in_parts(monkeypatch):
    tags = ["\x01table\x02\x03\x01tr\x02\x03\x01td\x02\x03é &amp;" + str(i) for i in range(50)] + ["", None]
    (whole, nested), = flat_tables.read_flat(pa.array(tags))
    assert not nested.any()
    monkeypatch.setattr(flat_tables, "_TOGETHER", 60)
    parts = [p for p, _ in flat_tables.read_flat(pa.array(["cut", *tags])[1:])]
    assert len(parts) > 20 and pa.concat_arrays(parts).equals(whole)
    assert whole.to_pylist()[7] == [{"table_no": 1, "several": False, "headers": [], "width": 1, "data": [["é &7"]]}]
    assert whole.to_pylist()[50:] == [[], []] and list(flat_tables.read_flat(pa.array([], pa.string()))) == []


def test_a_table_is_a_row_before_it_is_read(spark, pages_of):
    """Names and rows of tables are columns of a table's row: no array of all rows of a page is built, and names in the
    page's own row only where tables are nested."""
    pages = read_pages(spark, "/root/testdata/sf0.001/pages.parquet")
    for frame in (x.extract_tables(pages), x.extract_tables_map(pages), x.extract_tables_wide(pages, ["A"]), x.table_headers(pages)):
        assert "table_rows" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_archives_of_many_pages(spark):
    folder = new_folder(spark, "archives")
    texts = ["", "plain", "ünïcode é", "a\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc" * 3, "日本", "x" * 50_000, None]
    rows = [(f"<urn:{i}>", f"https://x.example/{i}", t, "iso-8859-1" if i == 2 else "shift_jis" if i == 4 else None) for i, t in enumerate(texts * 5)]
    pages = spark.createDataFrame(rows, "record_id string, url string, html string, charset string")
    archives.write_archives(pages.repartition(3), folder)
    assert len([f for f in os.listdir(folder) if not f.startswith(".")]) == 3
    # Ranges shorter than a record: every page once all the same.
    for size in (1000, 1 << 20):
        found = archives.read_archives(spark, folder, rangeBytes=size).collect()
        assert sorted((r.record_id, r.url, r.html, r.status_code) for r in found) == sorted((i, u, t or "", 200) for i, u, t, _ in rows)
    archives.write_archives(pages.limit(1), folder)
    assert archives.read_archives(spark, folder).count() == len(rows) + 1
    # Compressed archives, and one that is cut short.
    names = sorted(f for f in os.listdir(folder) if f.endswith(".warc"))
    other = new_folder(spark, "archives")
    os.makedirs(other)
    with open(f"{folder}/{names[0]}", "rb") as f, gzip.open(f"{other}/a.warc.gz", "wb") as g:
        whole = f.read()
        g.write(whole)
    n = archives.read_archives(spark, f"{folder}/{names[0]}").count()
    assert archives.read_archives(spark, other).count() == n
    with open(f"{other}/b.warc", "wb") as f:
        f.write(whole[:-20])
    with pytest.raises(Exception, match="cut short"):
        archives.read_archives(spark, other).count()
    assert archives.read_archives(spark, other, failOnCut="false").count() == 2 * n - 1
    with pytest.raises(Exception, match="record_id"):
        archives.write_archives(pages.drop("record_id"), folder)


@pytest.mark.parametrize(
    "body, kind, text",
    [
        (b"\xef\xbb\xbf\xc3\xa9", "text/html; charset=latin1", "é"),
        (b"\xff\xfea\x00", None, "a"),
        (b"\xe9", "text/html; charset=ISO-8859-1", "é"),
        (b"\x80", "text/html; charset=ISO-8859-1", "€"),
        (b"\xd0", 'text/html; charset="koi8-r"', "п"),
        (b"<META http-equiv=x content='text/html; charset=koi8-r'>\xd0", "text/html", "<META http-equiv=x content='text/html; charset=koi8-r'>п"),
        (b"<meta charset=utf-16>\xc3\xa9", None, "<meta charset=utf-16>é"),
        (b"\xc3\xa9", "text/html; charset=nonsense", "é"),
        (b"\xe9", "text/html; charset=hex", "é"),
        (b"\xc3(", "text/html; charset=utf-8", "�("),
        (b"", None, ""),
    ],
)
def test_charsets(body, kind, text):
    assert archives.decoded(body, kind) == text


def test_payloads_as_variants(spark, pages_of):
    page = "<title>T</title><p>one two three four five</p><table><tr><th>it's \"A\"</th><th>B?</th></tr><tr><td>1</td><td></td></tr></table>"
    pages = pages_of(page, "", None)
    folder = new_folder(spark, "variants")
    x.extract_all_variant(pages).write.parquet(folder)
    stored = spark.read.parquet(folder)
    assert stored.schema["payload"].dataType.simpleString() == "variant"
    key = ["page_id", "scrape_type", "record_no"]
    mine = stored.select(*key, F.to_json("payload").alias("payload")).collect()
    want = x.extract_all(pages).collect()
    assert {tuple(r)[:3]: {k: v for k, v in json.loads(r.payload).items() if v is not None} for r in mine} == {
        tuple(r)[:3]: json.loads(r.payload) for r in want
    }
    rows = stored.where("scrape_type in ('Paragraphs', 'Tables')").orderBy("scrape_type").select(
        text.field(F.col("payload"), "Word Count", "bigint"),
        text.field(F.col("payload"), "it's \"A\""),
        text.field(F.col("payload"), "B?"),
        text.field(F.col("payload"), "Paragraph Text", "bigint"),
    )
    assert [tuple(r) for r in rows.collect()] == [(5, None, None, None), (None, "1", "", None)]


def test_table_pages_are_marked_for_table_tags_alone(pages_of):
    page = "<p class=x>a</p><TABLE id=t><tr><td>&am<b></b>p; \t x&nbsp;</td><!-- <td> --><th title='>'> y</TABLE><theadx>"
    marked = pages_of(page).select(html.lower_tags(html.mark_names(F.col("html"), tables.NAMES)).alias("m")).first().m
    tags = ["table", "tr", "td", "/td", "th", "/table"]
    assert [s.split("\x02")[0] for s in marked.split("\x01")[1:]] == tags and "class" not in marked and "id=" not in marked
    assert [(r.col_name, r.cell) for r in x.extract_tables(pages_of(page)).orderBy("col_no").collect()] == [("Column 1", "& x"), ("Column 2", "y")]
