import html as stdlib_html
import random
import re

from pyspark.sql import functions as F

from pagetables.functions import html, text

SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0        　"


def values(spark, column, inputs):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r.o for r in rows.select("i", column.alias("o")).orderBy("i").collect()]


def random_texts(alphabet, n=300, size=12):
    rng = random.Random(7)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_clean_text(spark):
    inputs = ["\tcrate of\r\n\x0b pears \x1f", None, "", *random_texts(list("ab​é") + list(SPACES))]
    expected = [re.sub(r"\s+", " ", s or "").strip() for s in inputs]
    assert values(spark, text.clean_text(F.col("s")), inputs) == expected


def test_blank_and_strip(spark):
    inputs = ["", None, " 　\n", "x", " a b\xa0", *random_texts(["a", " ", "\xa0", "\n"])]
    assert values(spark, text.is_blank(F.col("s")), inputs) == [not (s or "").strip() for s in inputs]
    filled = [s for s in inputs if s is not None]
    assert values(spark, text.strip_space(F.col("s")), filled) == [s.strip() for s in filled]


def test_entities_match_the_standard_library(spark):
    inputs = [
        "a &amp; b", "&lt;b&gt;", "&copy 2026", "&ampfoo", "&notit;", "&#65;&#x41;&#150;&#0;&#xD800;", "&", "&&", "&;",
        "x&nosuch;y", "&middot;&quot;", "&NotEqualTilde;", "&#99999999999999;", "&#x110000;", "&#11;", "&am", "&amp",
        "&hellip", "&#x1F600; &eacute", "&amp;lt;", "&#38;lt;", "&a&#109;p;", "&amp;#65;", "&lt &gt;&copy=1", "&#xfffe;x",
        *random_texts(["&", "amp", "lt", ";", "#", "6", "x4", "copy", "not", "in", " ", "é", "="]),
    ]
    assert values(spark, text.decode_entities(F.col("s")), inputs) == [stdlib_html.unescape(s) for s in inputs]


def test_stats_and_labels(spark):
    assert values(spark, text.word_count(text.clean_text(F.col("s"))), ["", " a  b ", "x"]) == [0, 2, 1]
    assert values(spark, text.default_label(F.col("s"), "N/A"), ["", None, "x"]) == ["N/A", "N/A", "x"]
    assert values(spark, text.heading_label(F.col("s")), ["H2", "H6"]) == ["Heading 2", "Heading 6"]


def test_strip_markup(spark):
    inputs = [
        "a<b>b</b>c", "x<!-- <p>no</p> -->y", "<script>if (a<b) '</p>'</script>z", "<style>p{}</style >q",
        '<a title="x > y">t</a>', "1 < 2", "cut <a href='x", "<script>open", "<P CLASS=x>Up</P>", "a\x01\x02\x03b",
    ]
    expected = ["abc", "xy", "z", "q", "t", "1 < 2", "cut ", "", "Up", "ab"]
    assert values(spark, html.strip_markup(F.col("s")), inputs) == expected


def test_attributes(spark):
    inputs = [
        ' href="a b"', " href='a\"b'", " href=a/b/ class=x", ' title="see href=no" href="yes"', " HREF = X", " href", "",
        ' data-href="no"', ' href="" href="second"', ' href="?a=1&amp;b=2"', ' href="open',
    ]
    expected = ["a b", 'a"b', "a/b/", "yes", "X", "", "", "", "", "?a=1&b=2", "open"]
    assert values(spark, html.attribute(F.col("s"), "href"), inputs) == expected
    present = [True, True, True, True, True, True, False, False, True, True, True]
    assert values(spark, html.has_attribute(F.col("s"), "href"), inputs) == present
