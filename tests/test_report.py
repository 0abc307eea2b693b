import json
import random
import urllib.robotparser


from pagetables.operators import robots
from pagetables.plans import report

PAGE = "<title>T</title><h1>A</h1><p>Some words</p><a href='/x'>x</a>"


ANSWERS = "page_id bigint, status_code int, content_type string, fetch_error string, execution_time double"


def good_answers(spark, n=9):
    return spark.createDataFrame([(i, 200, "text/html", None, 0.1) for i in range(n)], ANSWERS)


def make_report(spark, pages, responses=None, **options):
    frame = good_answers(spark) if responses is None else spark.createDataFrame(responses, ANSWERS)
    return {
        r.page_id: r for r in report.run_report(pages, frame, scrape_types=("Headings",), **options).collect()
    }


def test_outcomes(spark, pages_of):
    ok = "text/html"
    pages = pages_of(PAGE, PAGE, PAGE, PAGE, " \n", PAGE, PAGE, "<p>none</p>")
    rows = make_report(
        spark,
        pages,
        [
            (0, 200, ok, None, 0.456), (1, 403, ok, None, 0.1), (2, 500, ok, None, 0.1), (3, 429, "application/pdf", None, 0.1),
            (4, 200, ok, None, 0.1), (5, None, None, "timeout", 10.0), (6, None, None, "ssl", 0.1), (7, 200, ok, None, 0.1),
        ],
    )
    assert (rows[0].success, rows[0].record_count, rows[0].execution_time, rows[0].content_type) == (True, 1, 0.46, ok)
    assert rows[0].logs[-1] == "[SUCCESS] Successfully extracted 1 records in 0.46s."
    assert json.loads(rows[0].preview_json) == [
        {"Level": "Heading 1", "Tag": "H1", "Heading Text": "A", "Character Count": 1}
    ]
    assert not rows[1].success and "HTTP 403" in rows[1].error_message and rows[1].content_type == ""
    assert not rows[2].success and "HTTP 500" in rows[2].error_message
    assert rows[3].success and any("429" in line and "WARNING" in line for line in rows[3].logs)
    assert not rows[4].success and "Empty Webpage" in rows[4].error_message and rows[4].status_code == 200
    assert "within 10 seconds" in rows[5].error_message and rows[5].status_code is None
    assert "SSL certificate" in rows[6].error_message
    assert rows[7].success and rows[7].record_count == 0 and "No 'Headings' elements" in rows[7].error_message
    assert rows[7].preview_json is None and rows[7].logs[-1] == "[WARNING] 0 records extracted."


def test_invalid_url_and_broken_link(spark, pages_of):
    bad_url = pages_of(PAGE, url="ftp://x.example")
    row = make_report(spark, bad_url)[0]
    assert not row.success and row.url == "ftp://x.example" and "Invalid protocol 'ftp'" in row.error_message
    assert row.logs[-1].startswith("[ERROR] URL validation failed")
    blank = make_report(spark, pages_of(PAGE, url="  "))[0]
    assert "URL cannot be empty" in blank.error_message and blank.url == "  "

    broken = pages_of(PAGE + "<a href='http://[x'>broken</a>")
    links = report.run_report(broken, good_answers(spark), scrape_types=("Links", "Headings")).collect()
    state = {r.scrape_type: (r.success, r.record_count, r.status_code) for r in links}
    assert state == {"Links": (False, 0, None), "Headings": (True, 1, 200)}


def test_counts_are_there_for_all_kinds(pages_of):
    nested = "<table><tr><td>a<table><tr><td>b</table></table>"
    found = report.record_count(pages_of(PAGE, "", nested)).collect()
    counts = {(r.page_id, r.scrape_type): r.record_count for r in found}
    assert len(counts) == 18
    assert counts[0, "Paragraphs"] == counts[0, "Links"] == counts[1, "Page Title"] == 1
    assert counts[1, "Links"] == counts[2, "Links"] == 0
    assert counts[2, "Tables"] == 3


def test_explode_logs(spark, pages_of):
    lines = report.explode_logs(report.run_report(pages_of(PAGE), good_answers(spark), scrape_types=("Headings",))).orderBy("line_no").collect()
    assert [r.line_no for r in lines] == list(range(1, len(lines) + 1))
    assert (lines[0].level, lines[0].message) == ("INFO", "Scraping process initiated.")


def test_robots_match_the_standard_library(spark):
    rng = random.Random(11)
    agents = ["*", "Mozilla", "otherbot", "zilla"]
    prefixes = ["/", "/a", "/a/b", "/c?x=1", "/é", "", "/a b", "/c"]
    paths = ["", "/", "/a", "/a/b/c", "/c?x=12", "/%C3%A9", "/a%20b", "/ab", "/z", "/c#f"]
    rule_rows, page_rows, files = [], [], {}
    for h in range(60):
        host, lines = f"h{h}.example.com", []
        for g in range(rng.randint(0, 3)):
            agent = rng.choice(agents)
            lines.append(f"User-agent: {agent}")
            for n in range(rng.randint(1, 4)):
                allow, prefix = rng.random() < 0.5, rng.choice(prefixes)
                lines.append(f"{'Allow' if allow else 'Disallow'}: {prefix}")
                rule_rows.append((host, g, agent, n, allow, prefix))
            lines.append("")
        files[host] = lines
        page_rows += [(h * 100 + i, f"http://{host}{p}") for i, p in enumerate(paths)]
    page_rows.append((-1, "http:///x"))
    pages = spark.createDataFrame(page_rows, "page_id bigint, url string")
    rules = spark.createDataFrame(
        rule_rows, "host string, group_no int, agent string, rule_no int, allow boolean, path_prefix string"
    )
    for agent in ("*", robots.BROWSER_AGENT, "OtherBot/2"):
        found = {r.url: r.is_allowed for r in robots.check_robots(pages, rules, agent).collect()}
        assert found.pop("http:///x") is False
        for host, lines in files.items():
            parser = urllib.robotparser.RobotFileParser()
            parser.parse(lines)
            for p in paths:
                url = f"http://{host}{p}"
                assert found[url] == parser.can_fetch(agent, url), (agent, url, lines)


def test_robots_block_a_run(spark, pages_of):
    rules = spark.createDataFrame(
        [("example.com", 1, "*", 1, False, "/")],
        "host string, group_no int, agent string, rule_no int, allow boolean, path_prefix string",
    )
    row = make_report(spark, pages_of(PAGE), rules=rules)[0]
    assert not row.success and "robots.txt policy (Disallowed by https://example.com/robots.txt" in row.error_message
    assert row.logs[-1].startswith("[WARNING] Robots.txt check: ")
    assert robots.robots_blocked(pages_of(PAGE), rules).count() == 1


def test_pages_without_an_answer_fail(spark, pages_of):
    rows = make_report(spark, pages_of(PAGE, PAGE), [(1, None, None, None, None)])
    for r in rows.values():
        assert not r.success and r.status_code is None and r.record_count == 0
        assert r.error_message.endswith("no answer") and not any("Response received" in x for x in r.logs)


def test_html_that_was_already_there(pages_of):
    pages = pages_of(PAGE, " \n", PAGE + "<a href='http://[x'>broken</a>", url="not a url")
    rows = {(r.page_id, r.scrape_type): r for r in report.run_html(pages).collect()}
    assert len(rows) == 18
    good = rows[0, "Headings"]
    assert good.success and good.record_count == 1 and good.url == "not a url" and good.status_code == 200
    assert good.logs == [
        "[INFO] Scraping from local HTML test bench.",
        f"[INFO] Content length: {len(PAGE)} characters.",
        "[INFO] Running parser for 'Headings'...",
        "[SUCCESS] Successfully extracted 1 records in 0.0s.",
    ]
    assert rows[1, "Links"].success and rows[1, "Links"].logs[-1] == "[WARNING] 0 records extracted."
    bad = rows[2, "Links"]
    assert not bad.success and bad.status_code is None and bad.logs[-1].startswith("[ERROR]") and rows[2, "Headings"].success


def test_counts_are_not_capped(pages_of):
    page = "".join(f"<p>paragraph {i}</p>" for i in range(250))
    found = {r.scrape_type: r.record_count for r in report.record_count(pages_of(page)).collect()}
    assert found["Paragraphs"] == 250
    assert {r.scrape_type: r.record_count for r in report.run_html(pages_of(page)).collect()}["Paragraphs"] == 250


def test_rules_that_could_not_be_fetched(spark, pages_of):
    rules = spark.createDataFrame(
        [("example.com", None, None, None, None, None, "timed out")],
        "host string, group_no int, agent string, rule_no int, allow boolean, path_prefix string, fetch_error string",
    )
    row = robots.check_robots(pages_of(PAGE), rules).first()
    assert row.is_allowed
    assert row.reason == "robots.txt could not be fetched (timed out). Defaulting to permissible public access."
    plan = robots.check_robots(pages_of(PAGE), rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 2 and plan.count("Exchange ") <= 2


ROBOTS = [
    "User-agent: *\nDisallow: /a\nAllow: /a/b\n",
    "Disallow: /all\nUser-agent: *\n\nDisallow: /a\n",
    "User-agent: one\nUser-agent: Two # both\nDisallow: /a\nUser-agent: *\nDisallow: /b",
    "User-agent: one\n\nUser-agent: *\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /",
    "USER-AGENT : two\rdisallow:/a%62/%zz+\r\n  \r\nallow: /b\n#c\nDisallow: /b\nsitemap: /a\nfoo: bar\nDisallow: /c",
    "user-agent: one\nallow: \ndisallow: \nuser-agent: two\nrequest-rate: 1/5\n \nDisallow: /c#d\n\n\nDisallow: /b",
    "﻿User-agent: *\nDisallow: /\n\nUser-agent: one\nDisallow: /a?x=é",
    "",
    "# nothing\n\n",
    "User-agent: two\x0bDisallow: /a Disallow: /b",
]


def test_robots_files_match_the_standard_library(spark):
    """The decisions from texts and answers, for agents and paths, against the parser that comes with Python."""
    paths = ["/", "/a", "/a/b", "/ab/%zz+", "/ab/x", "/b", "/c", "/c?d=1", "/all", "/a?x=%C3%A9", "/d"]
    files = [(f"h{i}.example", 200, t, None) for i, t in enumerate(ROBOTS)]
    files += [("no.example", 403, None, None), ("gone.example", 404, "x", None), ("ill.example", 503, None, None), ("off.example", None, None, "timed out")]
    table = spark.createDataFrame(files, "host string, status int, body string, fetch_error string")
    rules = robots.parse_robots(table)
    pages = spark.createDataFrame([(i, f"https://{f[0]}{p}") for f in files for i, p in enumerate(paths)], "page_id bigint, url string")
    for agent in ("*", "one", "TWO/1.0", "three"):
        found = {r.url: (r.is_allowed, r.reason) for r in robots.check_robots(pages, rules, agent).collect()}
        for host, status, text, error in files:
            parser = urllib.robotparser.RobotFileParser()
            parser.disallow_all = status in (403, 503)
            parser.allow_all = status == 404 or error is not None
            parser.parse((text or "").splitlines())
            for p in paths:
                url = f"https://{host}{p}"
                assert found[url][0] == parser.can_fetch(agent, url), (agent, url, text)
        assert found["https://off.example/"][1].startswith("robots.txt could not be fetched (timed out)")
