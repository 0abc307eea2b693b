"""Queries for reports, robots rules, the history table and streams."""

from __future__ import annotations


from pyspark.sql import functions as F

from pagetables.functions import outcome, text
from pagetables.operators import robots
from pagetables.plans import history, report
from pagetables.session import new_folder
from pagetables.sources.history_store import HistoryStore
from pagetables.sources.pages import PAGE_SCHEMA
from pagetables.streaming import jobs

from . import rendered, views
from .registry import query, table
from .views import HEADINGS_SQL, LINKS_SQL, LOG_SQL, PARAGRAPHS_SQL, RESPONSES_SQL, RUNS_SQL, SCRUBBED_SQL, TITLES_SQL

_DROP = SCRUBBED_SQL + ","
# records of all kinds, numbered: (page_id, scrape_type, n, payload)
RECORDS_SQL = f"""{PARAGRAPHS_SQL}, {LINKS_SQL.replace(_DROP, "")}, {HEADINGS_SQL.replace(_DROP, "")},
{TITLES_SQL.replace(_DROP, "")},
records AS (
  SELECT page_id, 'Page Title' AS scrape_type, 1 AS n, json_object('Page Title', page_title, 'Length (Chars)',
    length(page_title), 'Meta Description', meta_description, 'Canonical URL', canonical_url) AS payload FROM titles
  UNION ALL SELECT page_id, 'Headings', record_no, json_object('Level', level, 'Tag', tag, 'Heading Text', heading_text,
    'Character Count', length(heading_text)) FROM headings WHERE heading_text <> ''
  UNION ALL SELECT page_id, 'Links', record_no, json_object('Text', text, 'URL', link_url, 'Type', link_type, 'Target',
    target) FROM links
  UNION ALL SELECT page_id, 'Paragraphs', paragraph_no, json_object('Paragraph #', paragraph_no, 'Paragraph Text',
    paragraph_text, 'Word Count', word_count, 'Character Count', character_count) FROM paragraphs),
kinds AS (SELECT unnest(['Page Title', 'Headings', 'Links', 'Paragraphs', 'Tables', 'Images']) AS scrape_type),
counted AS (
  SELECT p.page_id, p.url, length(p.html) AS page_chars, k.scrape_type, count(r.n)::BIGINT AS found,
    CASE WHEN count(r.n) > 0 THEN '[' || string_agg(CAST(r.payload AS VARCHAR), ',' ORDER BY r.n) FILTER (r.n <= 5) || ']' END
      AS preview
  FROM pages p CROSS JOIN kinds k LEFT JOIN records r ON r.page_id = p.page_id AND r.scrape_type = k.scrape_type
  GROUP BY ALL)"""

FAILURE_SQL = f"""coalesce(CASE fetch_error
    WHEN 'timeout' THEN '⏱️ Connection timeout: The target server at ''' || url || ''' did not respond within 10 seconds.'
    WHEN 'ssl' THEN '{outcome.TLS_ERROR.replace("'", "''")}'
    WHEN 'connection' THEN '❌ Connection Error: Unable to reach ''' || url
      || '''. The domain might be down, invalid, or blocking connections.'
    WHEN 'other' THEN '❌ HTTP Request Exception: other' WHEN 'no answer' THEN '❌ HTTP Request Exception: no answer' END,
  CASE WHEN status_code = 403 THEN '{outcome.HTTP_403}'
    WHEN status_code = 404 THEN '🔍 HTTP 404 Not Found: The requested URL ''' || url || ''' does not exist on the server.'
    WHEN status_code >= 500 THEN '⚠️ Server Error (HTTP ' || status_code
      || '): The remote server encountered an error while processing the request.' END)"""

REPORT_SQL = f"""{RECORDS_SQL}, {RESPONSES_SQL},
answered AS (SELECT c.*, r.* EXCLUDE (page_id, fetch_error), CASE WHEN r.page_id IS NULL THEN 'no answer' ELSE fetch_error END
  AS fetch_error FROM counted c LEFT JOIN (SELECT * FROM responses WHERE page_id % 11 <> 0) r ON r.page_id = c.page_id),
judged AS (SELECT *, {FAILURE_SQL} AS failure FROM answered),
report AS (
  SELECT page_id, failure IS NULL AS success, url, scrape_type, status_code, coalesce(execution_time, 0.0)::DOUBLE AS execution_time,
    CASE WHEN failure IS NULL THEN found ELSE 0 END::BIGINT AS record_count,
    coalesce(failure, CASE WHEN found = 0 THEN 'ℹ️ Notice: No ''' || scrape_type
      || ''' elements were found on this webpage.' END) AS error_message,
    CASE WHEN failure IS NULL THEN content_type ELSE '' END AS content_type,
    CASE WHEN failure IS NULL THEN preview END AS preview_json, failure, page_chars, fetch_error, content_type AS sent_type
  FROM judged)"""

_REPORT_COLUMNS = (
    "page_id success url scrape_type status_code execution_time record_count error_message content_type preview_json"
).split()


def _report(spark, sf_dir):
    """Every eleventh page has no answer."""
    answers = views.responses(spark, sf_dir).where("page_id % 11 <> 0")
    return report.run_report(views.pages(spark, sf_dir), answers)


# -- reports ------------------------------------------------------------------------


@query(f"WITH {RECORDS_SQL} SELECT page_id, scrape_type, found AS record_count FROM counted")
def record_count(spark, sf_dir):
    return report.record_count(views.pages(spark, sf_dir))


@query(f"WITH {REPORT_SQL} SELECT {', '.join(_REPORT_COLUMNS)} FROM report")
def report_join(spark, sf_dir):
    return _report(spark, sf_dir).select(*_REPORT_COLUMNS)


@query(f"WITH {RECORDS_SQL} SELECT page_id, scrape_type, preview AS preview_json FROM counted WHERE preview IS NOT NULL")
def preview_json(spark, sf_dir):
    runs = report.runs(views.pages(spark, sf_dir)).select("page_id", "scrape_type", "preview_json")
    return runs.where("preview_json is not null")


@query(
    f"WITH {RECORDS_SQL} SELECT page_id, scrape_type, n::BIGINT AS record_no, len(json_keys(payload))::BIGINT AS n_fields, "
    "coalesce(payload ->> 'Paragraph Text', payload ->> 'URL', payload ->> 'Heading Text', payload ->> 'Page Title') AS shown "
    "FROM records WHERE n <= 5"
)
def preview_read(spark, sf_dir):
    runs = report.runs(views.pages(spark, sf_dir))
    stored = runs.select(F.struct("page_id", "scrape_type").alias("id"), "preview_json")
    names = ("Paragraph Text", "URL", "Heading Text", "Page Title")
    return history.preview_variants(stored).select(
        "id.page_id",
        "id.scrape_type",
        "record_no",
        F.size(F.variant_get("record", "$", "map<string,variant>")).cast("bigint").alias("n_fields"),
        F.coalesce(*[text.field(F.col("record"), n) for n in names]).alias("shown"),
    )


@query(
    f"WITH {RECORDS_SQL} SELECT page_id, n::BIGINT AS record_no, payload ->> 'URL' AS link_url FROM records "
    "WHERE scrape_type = 'Links' AND n <= 5"
)
def preview_top5(spark, sf_dir):
    from pagetables.operators.extract import extract_links

    return extract_links(views.pages(spark, sf_dir), report.PREVIEW_ROWS).select("page_id", "record_no", "link_url")


# The log of a run, line by line, as SQL over the report.
_LOG_STEPS = [
    "'[INFO] Scraping process initiated.'",
    "'[INFO] URL validated: ' || url",
    "'[INFO] Sending HTTP request to server (Timeout=10s)...'",
    "CASE WHEN fetch_error = 'ssl' THEN '[ERROR] 🔒 SSL Certificate Verification Failed: ssl' "
    "WHEN fetch_error IS NOT NULL THEN '[ERROR] ' || failure END",
    "CASE WHEN fetch_error IS NULL THEN '[INFO] HTTP Response received. Status Code: ' || status_code || ', Content-Type: ' "
    "|| sent_type END",
    "CASE WHEN fetch_error IS NULL AND failure IS NOT NULL THEN '[ERROR] ' || failure END",
    "CASE WHEN failure IS NULL AND status_code <> 200 THEN '[WARNING] ⚠️ Unexpected HTTP Status Code: ' || status_code || '.' END",
    "CASE WHEN failure IS NULL AND sent_type = 'application/pdf' THEN "
    "'[WARNING] Content-Type ''application/pdf'' might not be an HTML document.' END",
    "CASE WHEN failure IS NULL THEN '[INFO] HTML fetched successfully (' || format('{:,}', page_chars) "
    "|| ' bytes). Parsing document...' END",
    "CASE WHEN failure IS NULL THEN '[INFO] Running parser for ''' || scrape_type || '''...' END",
    "CASE WHEN failure IS NULL AND record_count = 0 THEN '[WARNING] 0 records extracted.' "
    "WHEN failure IS NULL THEN '[SUCCESS] Successfully extracted ' || record_count || ' records in ' "
    "|| CAST(CAST(execution_time AS DOUBLE) AS VARCHAR) || 's.' END",
]


@query(
    f"WITH {REPORT_SQL}, steps AS (SELECT page_id, scrape_type, list_filter([{', '.join(_LOG_STEPS)}], "
    "lambda x: x IS NOT NULL) AS logs FROM report), "
    "lines AS (SELECT page_id, scrape_type, unnest(logs) AS line, generate_subscripts(logs, 1)::BIGINT AS line_no FROM steps) "
    r"SELECT page_id, scrape_type, line_no, regexp_extract(line, '^\[([^\]]*)\]', 1) AS level, "
    r"regexp_replace(line, '^\[[^\]]*\] ', '') AS message FROM lines"
)
def explode_logs(spark, sf_dir):
    return report.explode_logs(_report(spark, sf_dir))


@query(
    f"""WITH {REPORT_SQL} SELECT row_number() OVER (ORDER BY page_id, scrape_type) AS id, url, scrape_type, record_count,
  CASE WHEN success THEN 'Success' ELSE 'Failed' END AS status, round(execution_time, 2) AS execution_time,
  '2024-02-01 12:00:00' AS "timestamp",
  CASE WHEN NOT success THEN error_message WHEN record_count = 0 THEN '0 records found' END AS error_message, preview_json
FROM report"""
)
def run_history(spark, sf_dir):
    at = F.to_timestamp(F.lit("2024-02-01 12:00:00"))
    rows = report.history_rows(_report(spark, sf_dir), at)
    return history.with_ids(rows, ["page_id", "scrape_type"])


# Runs on HTML that was already there.
HTML_RUNS_SQL = f"""{RECORDS_SQL}, html_runs AS (SELECT *, CASE WHEN found = 0 THEN 'ℹ️ Notice: No ''' || scrape_type
  || ''' elements were found on this webpage.' END AS error_message FROM counted)"""


@query(
    f"WITH {HTML_RUNS_SQL} SELECT page_id, true AS success, url, scrape_type, 200 AS status_code, 0.0::DOUBLE AS execution_time, "
    "found AS record_count, error_message, 'text/html; charset=utf-8' AS content_type, preview AS preview_json FROM html_runs"
)
def run_html(spark, sf_dir):
    return report.run_html(views.pages(spark, sf_dir)).select(*_REPORT_COLUMNS)


@query(
    f"WITH {HTML_RUNS_SQL}, lines AS (SELECT page_id, scrape_type, unnest(['Scraping from local HTML test bench.', "
    "'Content length: ' || format('{:,}', page_chars) || ' characters.', 'Running parser for ''' || scrape_type || '''...', "
    "CASE WHEN found = 0 THEN '0 records extracted.' ELSE 'Successfully extracted ' || found || ' records in 0.0s.' END]) AS message, "
    "unnest([1, 2, 3, 4])::BIGINT AS line_no, found FROM html_runs) SELECT page_id, scrape_type, line_no, CASE WHEN line_no < 4 "
    "THEN 'INFO' WHEN found = 0 THEN 'WARNING' ELSE 'SUCCESS' END AS level, message FROM lines"
)
def explode_logs_html(spark, sf_dir):
    return report.explode_logs(report.run_html(views.pages(spark, sf_dir)))


@query(
    f"""WITH {rendered.MIXED_SQL}, kinds AS (SELECT unnest(['Page Title', 'Headings', 'Links', 'Paragraphs', 'Tables', 'Images'])
  AS scrape_type), runs AS (SELECT c_custkey AS page_id, k.scrape_type, count(m.record_no)::BIGINT AS n,
  CASE WHEN count(m.record_no) > 0 THEN '[' || string_agg(CAST(m.payload AS VARCHAR), ',' ORDER BY m.record_no) || ']' END AS preview
  FROM customer CROSS JOIN kinds k LEFT JOIN mixed m ON m.page_id = c_custkey AND m.scrape_type = k.scrape_type GROUP BY ALL)
SELECT row_number() OVER (ORDER BY page_id, scrape_type) AS id, 'https://shop.example.com/a/b' AS url, scrape_type,
  n AS record_count, 'Success' AS status, 0.0::DOUBLE AS execution_time, '2024-02-01 12:00:00' AS "timestamp",
  CASE WHEN n = 0 THEN '0 records found' END AS error_message, preview AS preview_json FROM runs"""
)
def run_history_rendered(spark, sf_dir):
    """The history of runs on pages that hold all kinds, nested tables among them."""
    at = F.to_timestamp(F.lit("2024-02-01 12:00:00"))
    rows = report.history_rows(report.run_html(rendered.mixed_pages(spark, sf_dir)), at)
    return history.with_ids(rows, ["page_id", "scrape_type"])


# -- robots ---------------------------------------------------------------------------

# The decision for an agent, from the path after the host.
_FIRST_RULE = {
    "*": "CASE WHEN path LIKE '/fr/1%' THEN true WHEN path LIKE '/fr/%' THEN false WHEN path LIKE '/de/%' THEN true ELSE true END",
    "browser": "CASE WHEN path LIKE '/en/%' THEN false WHEN path LIKE '/es/3%' THEN false ELSE true END",
}


def _robots_sql(agent: str, rule: str) -> str:
    # Hosts with 'www.' in front could not be asked for their rules; every 17th URL has none.
    return f"""SELECT page_id, url, is_allowed, CASE WHEN host = '' THEN 'Cannot verify robots.txt: invalid domain.'
    WHEN starts_with(host, 'www.') THEN 'robots.txt could not be fetched (HTTP Error 500). Defaulting to permissible public access.'
    ELSE (CASE WHEN is_allowed THEN 'Allowed' ELSE 'Disallowed' END) || ' by ' || origin
    || '/robots.txt for user-agent ''{agent}''.' END AS reason
  FROM (SELECT page_id, url, origin, host, host <> '' AND (starts_with(host, 'm.') OR starts_with(host, 'www.') OR ({rule})) AS is_allowed
    FROM (SELECT page_id, url, regexp_extract(url, '^https?://[^/]+') AS origin, regexp_extract(url, '^https?://([^/]+)', 1)
      AS host, regexp_replace(url, '^https?://[^/]+', '') AS path
      FROM (SELECT page_id, CASE WHEN page_id % 17 = 0 THEN 'https:///x' ELSE url END AS url FROM pages)))"""


def _addresses(spark, sf_dir):
    no_host = F.when(F.col("page_id") % 17 == 0, "https:///x")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(no_host, "url").alias("url"))


@query(_robots_sql("*", _FIRST_RULE["*"]))
def robots_check(spark, sf_dir):
    return robots.check_robots(_addresses(spark, sf_dir), views.robots_rules(spark, sf_dir))


@query(_robots_sql("*", _FIRST_RULE["*"]))
def robots_check_files(spark, sf_dir):
    """The same decisions from the files as they were answered."""
    return robots.check_robots(_addresses(spark, sf_dir), robots.parse_robots(views.robots_files(spark, sf_dir)))


@query(f"SELECT * FROM ({_robots_sql(robots.BROWSER_AGENT, _FIRST_RULE['browser'])}) WHERE NOT is_allowed")
def robots_blocked_files(spark, sf_dir):
    return robots.robots_blocked(_addresses(spark, sf_dir), robots.parse_robots(views.robots_files(spark, sf_dir)))


@query(f"SELECT * FROM ({_robots_sql(robots.BROWSER_AGENT, _FIRST_RULE['browser'])}) WHERE NOT is_allowed")
def robots_blocked(spark, sf_dir):
    return robots.robots_blocked(_addresses(spark, sf_dir), views.robots_rules(spark, sf_dir))


# -- history --------------------------------------------------------------------------

_HISTORY = ", ".join(f'"{f.name}"' for f in history.HISTORY_SCHEMA.fields)
_NO_ID = ", ".join(f'"{f.name}"' for f in history.HISTORY_SCHEMA.fields if f.name != "id")
_SAVED = _NO_ID.replace('"execution_time"', 'round("execution_time", 2) AS execution_time')


def _new_runs(spark, sf_dir):
    """Runs without id; ``seq`` gives the order they are saved in."""
    return views.runs(spark, sf_dir).withColumnRenamed("id", "seq")


@query(f"WITH {RUNS_SQL} SELECT row_number() OVER (ORDER BY id) AS id, {_SAVED} FROM runs")
def history_table(spark, sf_dir):
    store = HistoryStore(spark, new_folder(spark, "history"))
    store.append(_new_runs(spark, sf_dir), ["seq"])
    return store.read()


@query(
    f"WITH {RUNS_SQL}, numbered AS (SELECT row_number() OVER (ORDER BY status <> 'Failed', id) AS new_id, * FROM runs) "
    f"SELECT new_id AS id, {_SAVED} FROM numbered"
)
def history_append(spark, sf_dir):
    """Two batches, and the first one once more, which must not show."""
    store = HistoryStore(spark, new_folder(spark, "history"))
    rows = _new_runs(spark, sf_dir)
    failed, good = rows.where("status = 'Failed'"), rows.where("status = 'Success'")
    store.append(failed, ["seq"], batch=0)
    store.append(good, ["seq"], batch=1)
    store.append(failed, ["seq"], batch=0)
    return store.read()


@query(
    f"WITH {RUNS_SQL}, numbered AS (SELECT row_number() OVER (ORDER BY status <> 'Failed', id) AS new_id, * FROM runs) "
    f"SELECT new_id AS id, {_SAVED} FROM numbered WHERE new_id NOT IN (3, (SELECT count(*) FROM runs))"
)
def history_replay(spark, sf_dir):
    """Two batches, a run deleted from each, and both batches once more."""
    store = HistoryStore(spark, new_folder(spark, "history"))
    rows = _new_runs(spark, sf_dir)
    failed, good = rows.where("status = 'Failed'"), rows.where("status = 'Success'")
    store.append(failed, ["seq"], batch=0)
    store.delete(3)
    last = store.append(good, ["seq"], batch=1)
    store.delete(last)
    store.append(failed, ["seq"], batch=0)
    store.append(good, ["seq"], batch=1)
    return store.read()


@query(f"WITH {RUNS_SQL} SELECT {_HISTORY} FROM runs WHERE url ILIKE '%U1_.Example%' OR scrape_type ILIKE '%U1_.Example%'")
def history_search(spark, sf_dir):
    return history.search(views.runs(spark, sf_dir), " U1_.Example ")


@query(f"WITH {RUNS_SQL} SELECT {_HISTORY} FROM runs WHERE status = 'Failed'")
def history_status(spark, sf_dir):
    return history.with_status(views.runs(spark, sf_dir), "Failed")


@query(f"WITH {RUNS_SQL} SELECT {_HISTORY} FROM runs WHERE id = 17")
def history_by_id(spark, sf_dir):
    return history.by_id(views.runs(spark, sf_dir), 17)


@query(
    f"WITH {RUNS_SQL} SELECT {', '.join(chr(34) + c + chr(34) for c in history.DISPLAY_COLUMNS)} FROM runs "
    "WHERE status = 'Success' AND (url ILIKE '%links%' OR scrape_type ILIKE '%links%') ORDER BY id DESC LIMIT 50"
)
def history_recent(spark, sf_dir):
    return history.recent(views.runs(spark, sf_dir), "links", "Success", 50)


@query(f"WITH {RUNS_SQL} SELECT {_HISTORY} FROM runs WHERE id <> 17")
def history_without_id(spark, sf_dir):
    return history.without_id(views.runs(spark, sf_dir), 17)


@query(
    f"WITH {RUNS_SQL}, numbered AS (SELECT row_number() OVER (ORDER BY id) AS new_id, * FROM runs) "
    f"SELECT new_id AS id, {_SAVED} FROM numbered WHERE new_id <> 17 UNION ALL "
    f"SELECT (SELECT count(*) FROM runs) + row_number() OVER (ORDER BY id), {_SAVED} FROM numbered WHERE status = 'Failed'"
)
def history_delete(spark, sf_dir):
    """Delete one run and one that does not exist, then save more."""
    store = HistoryStore(spark, new_folder(spark, "history"))
    rows = _new_runs(spark, sf_dir)
    store.append(rows, ["seq"])
    store.delete(17)
    store.delete(-1)
    store.append(rows.where("status = 'Failed'"), ["seq"])
    return store.read()


@query(
    f"WITH {RUNS_SQL} SELECT (SELECT count(*) FROM runs) + row_number() OVER (ORDER BY id) AS id, {_SAVED} FROM runs "
    "WHERE status = 'Failed'"
)
def history_clear(spark, sf_dir):
    """Clear, then save again: ids are not used twice."""
    store = HistoryStore(spark, new_folder(spark, "history"))
    rows = _new_runs(spark, sf_dir)
    store.append(rows, ["seq"])
    store.clear()
    store.append(rows.where("status = 'Failed'"), ["seq"])
    return store.read()


_STATS = {
    "total_scrapes": "count(*)",
    "successful": "count(*) FILTER (status = 'Success')",
    "failed": "count(*) FILTER (status = 'Failed')",
    "total_records": "coalesce(sum(record_count) FILTER (status = 'Success'), 0)::BIGINT",
    "avg_time": "coalesce(round(avg(execution_time) FILTER (status = 'Success'), 2), 0.0)",
    "success_rate": "CASE WHEN count(*) > 0 THEN round(count(*) FILTER (status = 'Success') * 100.0 / count(*), 1) ELSE 0.0 END",
}


@query(f"WITH {RUNS_SQL} SELECT " + ", ".join(f"{e} AS {n}" for n, e in _STATS.items()) + " FROM runs")
def history_stats(spark, sf_dir):
    return history.stats(views.runs(spark, sf_dir))


def _single_stat(key: str, *names: str) -> None:
    def run(spark, sf_dir):
        return history.stats(views.runs(spark, sf_dir)).select(*names)

    run.__name__ = key
    query(f"WITH {RUNS_SQL} SELECT " + ", ".join(f"{_STATS[n]} AS {n}" for n in names) + " FROM runs")(run)


_single_stat("stats_total", "total_scrapes")
_single_stat("stats_success", "successful")
_single_stat("stats_failed", "failed")
_single_stat("stats_total_records", "total_records")
_single_stat("stats_avg_time", "avg_time")
_single_stat("stats_success_rate", "success_rate")


@query(
    f"WITH {RUNS_SQL} SELECT record_count AS records, printf('%.2fs', execution_time) AS latency, "
    "regexp_extract(url, '^https?://([^/]+)', 1) AS host, split_part(\"timestamp\", ' ', 2) AS time_of_day "
    "FROM runs ORDER BY id DESC LIMIT 1"
)
def page_kpis(spark, sf_dir):
    return history.page_kpis(views.runs(spark, sf_dir))


@query(f"WITH {LOG_SQL} SELECT event_id, ts FROM (SELECT event_id, ts FROM log_lines ORDER BY ts DESC, event_id DESC LIMIT 500)")
def log_tail(spark, sf_dir):
    return history.log_tail(views.log_lines(spark, sf_dir), ["ts", "event_id"]).select("event_id", "ts")


# -- streams --------------------------------------------------------------------------


def _arriving_pages(spark, sf_dir):
    """The pages as a stream of files, be the table one file or a folder of them."""
    # a pattern, because a plain path has to be a folder
    return spark.readStream.schema(PAGE_SCHEMA).parquet(f"{sf_dir}/pages[.]parquet")


@query(f"WITH {RECORDS_SQL} SELECT page_id, scrape_type, n::BIGINT AS record_no, CAST(payload AS VARCHAR) AS payload FROM records")
def stream_extract(spark, sf_dir):
    """The pages as a stream of files; the records of all batches."""
    folder = new_folder(spark, "stream")
    pages = _arriving_pages(spark, sf_dir)
    store = HistoryStore(spark, f"{folder}/history")
    jobs.stream_extract(pages, f"{folder}/records", f"{folder}/checkpoint", store).awaitTermination()
    return spark.read.parquet(f"{folder}/records").drop("batch_id")


@query(f"WITH {RECORDS_SQL} SELECT page_id, scrape_type, n::BIGINT AS record_no, CAST(payload AS VARCHAR) AS payload FROM records")
def stream_extract_repeats(spark, sf_dir):
    """The pages as a stream of several batches, many of them twice or three times, some late: the
    records of each page once."""
    folder = new_folder(spark, "stream")
    pages = views.pages(spark, sf_dir).select(*PAGE_SCHEMA.names, F.timestamp_seconds(F.lit(1_900_000_000) - F.col("page_id") % 3000).alias("seen_at"))
    for number, some in enumerate(("page_id % 2 = 0", "page_id % 3 = 0", "page_id % 2 = 1", "page_id % 5 < 2")):
        pages.where(some).coalesce(1).write.parquet(f"{folder}/in/{number}")
    arriving = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    jobs.stream_extract(
        arriving, f"{folder}/records", f"{folder}/checkpoint", event_time="seen_at", repeats_within="1 hour"
    ).awaitTermination()
    return spark.read.parquet(f"{folder}/records").drop("batch_id")


@query(
    f"WITH {REPORT_SQL} SELECT row_number() OVER (ORDER BY page_id, scrape_type) AS id, url, scrape_type, record_count, "
    "CASE WHEN success THEN 'Success' ELSE 'Failed' END AS status, round(execution_time, 2) AS execution_time, "
    "CASE WHEN NOT success THEN error_message WHEN record_count = 0 THEN '0 records found' END AS error_message, preview_json FROM report"
)
def stream_history(spark, sf_dir):
    """The history of a stream of pages with their answers."""
    folder = new_folder(spark, "stream")
    pages = _arriving_pages(spark, sf_dir)
    store = HistoryStore(spark, f"{folder}/history")
    answers = views.responses(spark, sf_dir).where("page_id % 11 <> 0")
    jobs.stream_extract(pages, f"{folder}/records", f"{folder}/checkpoint", store, responses=answers).awaitTermination()
    return store.read().drop("timestamp")


@query(
    f"WITH {LOG_SQL} SELECT CASE level WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' WHEN 'SUCCESS' THEN 'success' "
    "ELSE 'info' END AS level, count(*) AS n FROM log_lines GROUP BY ALL"
)
def stream_log_counts(spark, sf_dir):
    """The log lines as a stream of files; the counts at its end."""
    folder = new_folder(spark, "log-stream")
    views.log_lines(spark, sf_dir).select("line").write.parquet(f"{folder}/lines")
    lines = spark.readStream.schema("line string").parquet(f"{folder}/lines")
    jobs.stream_log_counts(lines, F.col("line"), f"{folder}/counts", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/counts")


def _arriving_lines(spark, sf_dir, folder):
    """The log lines as a stream of files of six days each; every tenth line comes one file
    late and every tenth four files late."""
    days = F.date_diff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    delay = F.when(F.col("event_id") % 10 == 3, 1).when(F.col("event_id") % 10 == 7, 4).otherwise(0)
    file = F.least(F.greatest(F.floor(days / 6), F.lit(0)), F.lit(4)) + delay
    lines = views.log_lines(spark, sf_dir).select("event_id", "line", file.alias("file"))
    for number in range(9):
        lines.where(F.col("file") == number).drop("file").coalesce(1).write.parquet(f"{folder}/lines/{number}")
    return spark.readStream.schema("event_id bigint, line string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/lines/*")


@query(
    f"WITH {LOG_SQL} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, CASE level WHEN 'ERROR' THEN 'error' "
    "WHEN 'WARNING' THEN 'warning' WHEN 'SUCCESS' THEN 'success' ELSE 'info' END AS level, count(*) AS n FROM log_lines "
    "WHERE event_id % 10 <> 7 AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= "
    "(SELECT date_trunc('second', max(ts)) - INTERVAL 7 DAY FROM log_lines) GROUP BY ALL"
)
def stream_log_windows(spark, sf_dir):
    """Lines per level and hour, lines up to a week late included; hours that are still open at
    the end of the stream, and lines that come later than that, are left out."""
    folder = new_folder(spark, "log-windows")
    lines = _arriving_lines(spark, sf_dir, folder)
    jobs.stream_log_windows(lines, F.col("line"), f"{folder}/out", f"{folder}/checkpoint", "1 hour", "7 days").awaitTermination()
    found = spark.read.schema("window_start timestamp, level string, n bigint").parquet(f"{folder}/out")
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query(
    f"WITH {LOG_SQL} SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS logged_at FROM "
    "(SELECT event_id, date_trunc('second', ts) AS ts FROM log_lines ORDER BY date_trunc('second', ts) DESC, event_id DESC LIMIT 500)"
)
def stream_log_tail(spark, sf_dir):
    """The 500 newest lines of the stream, late ones included."""
    folder = new_folder(spark, "log-tail")
    lines = _arriving_lines(spark, sf_dir, folder)
    jobs.stream_log_tail(lines, F.col("line"), ["event_id"], f"{folder}/tail", f"{folder}/checkpoint").awaitTermination()
    tail = jobs.read_log_tail(spark, f"{folder}/tail")
    return tail.select("event_id", F.date_format("logged_at", "yyyy-MM-dd HH:mm:ss").alias("logged_at"))
