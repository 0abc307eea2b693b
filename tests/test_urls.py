import ipaddress
import random
from urllib.parse import quote, unquote, urljoin, urlparse, urlunparse

import pytest
from pyspark.sql import functions as F

from pagetables.functions import urls
from workload import scalars

from .test_text import values

BASES = [
    "http://a/b/c/d;p?q", "http://a", "https://h.com/x/", "", "mailto:x@y", "a/b", "http://a.com/x//y/../z?u=1#f",
    "HTTP://A.com/b", "/r/s", "http://a?q", "http://a/b;p=1/c",
]
HREFS = [
    "g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", ";x", "g;x?y#s", "", ".", "./", "..", "../g", "../..",
    "../../../g", "/./g", "/../g", ".g", "g..", "./g/.", "g/../h", "g;x=1/./y", "g;x=1/../y", "http:g", "HTTP://Xx.com/../a",
    "data:abc", "JavaScript:x", "x y", "a//b", "/a//b", "c#", "c?", "c;", "..;x", "a:b", "1:b", "  sp", "a\tb", "//", "///x",
    "http:///x", "/;p", "?", "#", ";a/../b", "g;x/h", "https://o.com/a?b=/../c", "/a/..", "http://h?", "/x;", "http://h/a;b/c",
]


def test_resolve_matches_the_standard_library(spark):
    rng = random.Random(3)
    parts = ["a", "b", "/", "..", ".", "?", "#", ";", "//", "x=1", ":", "http:", " "]
    random_hrefs = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(120)]
    rows = [(b, h) for b in BASES for h in [*HREFS, *random_hrefs]]
    frame = spark.createDataFrame(rows, "b string, h string").repartition(8)
    found = frame.select("b", "h", urls.resolve_url(F.col("b"), F.col("h")).alias("o")).collect()
    assert [r for r in found if r.o != urljoin(r.b, r.h)] == []


def test_netloc(spark):
    inputs = ["http://A.com:80/x", "//H/x", "/x", "mailto:a@b", "http://u:p@h?x", "", None]
    assert values(spark, urls.url_netloc(F.col("s")), inputs) == [urlparse(s or "").netloc.lower() for s in inputs]


@pytest.mark.parametrize(
    ("raw", "clean", "word"),
    [
        ("", "", "empty"),
        ("  ", "https://", "empty"),
        ("  shop.example.com  ", "https://shop.example.com", None),
        ("http://example.com", "http://example.com", None),
        ("ftp://example.com", "ftp://example.com", "protocol 'ftp'"),
        ("https://", "https://", "structure"),
        ("//h.com", "https:////h.com", "structure"),
        ("localhost", "https://localhost", None),
        ("localhost:3000", "localhost:3000", "protocol"),
        ("http://[x", "http://[x", "Malformed"),
        ("http://[::1]", "http://[::1]", "domain name '['"),
        ("http://nodot", "http://nodot", "domain name 'nodot'"),
    ],
)
def test_sanitize_and_validate(spark, raw, clean, word):
    assert values(spark, urls.sanitize_url(F.col("s")), [raw]) == [clean]
    result = values(spark, urls.validate_url(F.col("s")), [raw])[0]
    assert result.is_valid == (word is None)
    assert (word or "") in result.error


def test_private_hosts(spark):
    rng = random.Random(5)
    hosts = ["10.1.2.3", "172.15.0.1", "172.31.0.1", "192.0.0.9", "192.0.0.8", "100.64.0.1", "8.8.8.8", "255.255.255.255"]
    hosts += [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(300)]

    def private(host):
        ip = ipaddress.IPv4Address(host)
        return ip.is_private or ip.is_loopback or ip.is_reserved or ip.is_link_local

    assert values(spark, urls.is_private_host(F.col("s")), hosts) == [private(h) for h in hosts]
    assert values(spark, urls.is_private_host(F.col("s")), ["example.com", "300.1.1.1", None, "01.2.3.4"]) == [False] * 4


def test_display_and_robots_path(spark):
    assert values(spark, urls.domain_display(F.col("s")), ["http://H.com/x", "abc/def"]) == ["H.com", "abc/def"]
    inputs = ["http://h/a b?x=1+2#f", "http://h", "http://h/%7Ea%2Fb%zz", "http://h/é?*~"]

    def expected(url):
        u = urlparse(unquote(url))
        return quote(urlunparse(("", "", u.path, u.params, u.query, u.fragment))) or "/"

    assert values(spark, urls.robots_path(F.col("s")), inputs) == [expected(u) for u in inputs]


def test_addresses_in_other_forms(spark):
    import socket

    rng = random.Random(3)
    parts = lambda n: [rng.choice(["%d", "0%o", "0x%x", "0X%X"]) % rng.choice([0, 1, 10, 127, 172, 192, 255, 256, 65535]) for _ in range(n)]
    hosts = [".".join(parts(rng.randint(1, 5))) for _ in range(400)]
    hosts += ["127.1", "2130706433", "0x7f.0.0.1", "0177.1", "10.65535", "1.2.3.256", "4294967296", "08.1.1.1", "1..2", "0x", "9" * 40]

    def number(host):
        try:
            return int.from_bytes(socket.inet_aton(host), "big")
        except OSError:
            return None

    assert values(spark, urls.ipv4_number(F.col("s")), hosts) == [number(h) for h in hosts]
    assert values(spark, urls.is_private_host(F.col("s")), ["localhost", "LOCALHOST", "127.1", "8.8", None]) == [True, True, True, False, False]


def test_long_relative_paths_are_quick(spark):
    import time

    base = "https://a.example/b/c"
    hrefs = ["x/" * 20_000, "../y/./" * 20_000, "z/../" * 20_000, "../" * 20_000 + "end"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hrefs)], "i int, h string").coalesce(1)
    frame = rows.select("i", urls.resolve_url(F.lit(base), F.col("h")).alias("u"))
    frame.where("i < 0").collect()
    start = time.time()
    found = [r.u for r in frame.orderBy("i").collect()]
    assert time.time() - start < 8
    assert found == [urljoin(base, h) for h in hrefs]


def test_resolve_url_query_is_dealt_to_several_tasks(spark, tmp_path):
    spark.range(50).selectExpr("id AS c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert scalars.resolve_url(spark, str(tmp_path)).rdd.getNumPartitions() > 1
