"""Run reports: what happened to each page and kind of records.

A run is one page with one kind. Records are counted and previewed in the page's
row; only those small rows meet the responses and the robots rules, so HTML is
never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import outcome, urls
from ..functions.arrays import explode_items
from ..operators.extract import SCRAPE_TYPES, page_records, record_counts, shown_records
from ..operators.robots import BROWSER_AGENT, with_robots

PREVIEW_ROWS = 5


def preview_json(scrape_type: str) -> Column:
    """First five records of a ``page_records`` row as JSON; null without any."""
    shown = shown_records(scrape_type, PREVIEW_ROWS)
    return F.when(F.size(shown) > 0, F.to_json(shown))


def runs_of(found: DataFrame) -> DataFrame:
    """(page_id, url, page_chars, is_blank, runs) of ``page_records``: counts and previews
    of all kinds."""
    counts = record_counts()
    runs = F.array(
        *[
            F.struct(
                F.lit(t).alias("scrape_type"),
                counts[t].alias("record_count"),
                preview_json(t).alias("preview_json"),
                F.array_contains("unreadable", t).alias("is_broken"),
            )
            for t in SCRAPE_TYPES
        ]
    )
    kept = [c for c in found.columns if c in ("page_id", "url", "raw_url", "page_chars", "is_blank")]
    return found.select(*kept, runs.alias("runs"))


def runs(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    """One row per page and kind: (page_id, scrape_type, record_count, preview_json)."""
    return explode_items(runs_of(page_records(pages, max_records)), F.col("runs"), "page_id").select(
        "page_id", "r.scrape_type", "r.record_count", "r.preview_json"
    )


def record_count(pages: DataFrame, max_records: int | None = None) -> DataFrame:
    """(page_id, scrape_type, record_count), also where there are none."""
    return runs(pages, max_records).select("page_id", "scrape_type", "record_count")


def _line(level: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"[{level}] "), *[F.lit(p) if isinstance(p, str) else p for p in parts])


def addressed(pages: DataFrame) -> DataFrame:
    """Pages with their URL made complete; ``raw_url`` is the one given."""
    return pages.select("page_id", F.col("url").alias("raw_url"), "html").withColumn(
        "url", urls.sanitize_url(F.col("raw_url"))
    )


def _known(scrape_types: tuple[str, ...]) -> None:
    unknown = [t for t in scrape_types if t not in SCRAPE_TYPES]
    if unknown:
        raise ValueError(f"Unknown scraping type '{unknown[0]}'. Supported: {list(SCRAPE_TYPES)}")


def report_of(
    found: DataFrame,
    responses: DataFrame,
    rules: DataFrame | None = None,
    scrape_types: tuple[str, ...] = SCRAPE_TYPES,
    user_agent: str = BROWSER_AGENT,
    timeout: int = outcome.DEFAULT_TIMEOUT,
) -> DataFrame:
    """``run_report`` from the ``page_records`` of ``addressed`` pages."""
    _known(scrape_types)
    facts = runs_of(found).withColumn("check", urls.validate_url(F.col("raw_url")))
    names = ("status_code", "content_type", "fetch_error", "execution_time")
    known = [c for c in names if c in responses.columns]
    facts = facts.join(responses.select("page_id", *known), "page_id", "left")
    for name, kind in zip(names, ("int", "string", "string", "double")):
        if name not in known:
            facts = facts.withColumn(name, F.lit(None).cast(kind))
    unanswered = F.when(F.col("status_code").isNull(), F.lit(outcome.NO_ANSWER))
    facts = facts.withColumn("fetch_error", F.coalesce("fetch_error", unanswered))
    if rules is None:
        facts = facts.select("*", F.lit(True).alias("is_allowed"), F.lit(None).cast("string").alias("reason"))
    else:
        facts = with_robots(facts, rules, user_agent)
    wanted = F.filter("runs", lambda r: r.scrape_type.isin(*scrape_types))
    run = explode_items(facts, wanted, *[c for c in facts.columns if c != "runs"]).select("*", "r.*")
    return run.select(*_report_columns(rules is not None, timeout))


def run_report(
    pages: DataFrame,
    responses: DataFrame,
    rules: DataFrame | None = None,
    scrape_types: tuple[str, ...] = SCRAPE_TYPES,
    max_records: int | None = None,
    user_agent: str = BROWSER_AGENT,
    timeout: int = outcome.DEFAULT_TIMEOUT,
) -> DataFrame:
    """One row per page and kind: success, url, scrape_type, status_code,
    execution_time, record_count, error_message, logs, content_type, preview_json.

    ``responses(page_id, status_code, content_type, fetch_error, execution_time)``, one
    row per page, says how each page was fetched. A page without a row, or without a
    status and an error, was not answered and fails. ``rules`` switches the robots check
    on. Pages that nobody fetched go through ``run_html``.
    """
    found = page_records(addressed(pages), max_records)
    return report_of(found, responses, rules, scrape_types, user_agent, timeout)


def html_report_of(found: DataFrame, scrape_types: tuple[str, ...] = SCRAPE_TYPES) -> DataFrame:
    """``run_html`` from ``page_records``."""
    _known(scrape_types)
    wanted = F.filter("runs", lambda r: r.scrape_type.isin(*scrape_types))
    run = explode_items(runs_of(found), wanted, "page_id", "url", "page_chars").select("*", "r.*")
    ok = ~F.col("is_broken")
    count = F.when(ok, F.col("record_count")).otherwise(0).cast("bigint")
    error = F.when(~ok, F.lit(outcome.PARSE_ERROR)).when(count == 0, outcome.no_records_notice(F.col("scrape_type")))
    return run.select(
        "page_id",
        ok.alias("success"),
        "url",
        "scrape_type",
        F.when(ok, 200).cast("int").alias("status_code"),
        F.lit(0.0).alias("execution_time"),
        count.alias("record_count"),
        error.alias("error_message"),
        html_logs(F.col("page_chars"), F.col("scrape_type"), count, F.col("is_broken")).alias("logs"),
        F.when(ok, F.lit(outcome.HTML_TYPE)).otherwise("").alias("content_type"),
        F.when(ok, F.col("preview_json")).alias("preview_json"),
    )


def run_html(
    pages: DataFrame, scrape_types: tuple[str, ...] = SCRAPE_TYPES, max_records: int | None = None
) -> DataFrame:
    """Runs on HTML that was already there: nothing is requested, so neither the URL
    nor robots rules nor a blank page can fail them. Columns as ``run_report``."""
    return html_report_of(page_records(pages, max_records), scrape_types)


def _report_columns(with_robots: bool, timeout: int) -> list[Column]:
    col = F.col
    url, status = col("url"), col("status_code")
    # The first thing that goes wrong ends the run; later checks do not happen.
    invalid = F.when(~col("check.is_valid"), F.concat(F.lit(outcome.INVALID_URL), col("check.error")))
    denied = F.when(~col("is_allowed"), F.concat(F.lit(outcome.ROBOTS_DENIED), col("reason"), F.lit(").")))
    unfetched = outcome.fetch_error_message(col("fetch_error"), url, timeout)
    refused = outcome.http_error(status, url)
    empty = F.when(col("is_blank"), F.lit(outcome.EMPTY_PAGE))
    broken = F.when(col("is_broken"), F.lit(outcome.PARSE_ERROR))
    error = F.coalesce(invalid, denied, unfetched, refused, empty, broken)
    answered = F.coalesce(invalid, denied, unfetched).isNull()
    fetched = answered & refused.isNull() & empty.isNull()
    count = F.when(error.isNull(), col("record_count")).otherwise(F.lit(0)).cast("bigint")
    elapsed = F.coalesce(outcome.seconds(F.col("execution_time")), F.lit(0.0))

    # The lines of a run, in their order.
    steps: list[Column] = [
        _line("INFO", "Scraping process initiated."),
        F.when(invalid.isNotNull(), _line("ERROR", "URL validation failed: ", col("check.error"))),
        F.when(invalid.isNull(), _line("INFO", "URL validated: ", url)),
    ]
    if with_robots:
        steps += [
            F.when(invalid.isNull(), _line("INFO", "Checking robots.txt permission...")),
            F.when(invalid.isNull() & denied.isNotNull(), _line("WARNING", "Robots.txt check: ", col("reason"))),
            F.when(invalid.isNull() & denied.isNull(), _line("INFO", "Robots.txt check passed: ", col("reason"))),
        ]
    sent = F.coalesce(invalid, denied).isNull()
    steps += [
        F.when(sent, _line("INFO", f"Sending HTTP request to server (Timeout={timeout}s)...")),
        F.when(
            sent & unfetched.isNotNull(),
            F.when(
                col("fetch_error") == "ssl",
                _line("ERROR", "🔒 SSL Certificate Verification Failed: ", col("fetch_error")),
            ).otherwise(_line("ERROR", unfetched)),
        ),
        F.when(
            answered,
            _line(
                "INFO",
                "HTTP Response received. Status Code: ",
                status.cast("string"),
                ", Content-Type: ",
                F.coalesce("content_type", F.lit("")),
            ),
        ),
        F.when(answered, _line("ERROR", refused)),
        F.when(answered & refused.isNull(), _line("WARNING", outcome.status_warning(status))),
        F.when(answered & refused.isNull(), _line("WARNING", outcome.content_type_warning(col("content_type")))),
        F.when(answered & refused.isNull(), _line("ERROR", empty)),
        F.when(
            fetched,
            _line(
                "INFO",
                "HTML fetched successfully (",
                F.format_number("page_chars", 0),
                " bytes). Parsing document...",
            ),
        ),
        F.when(fetched, _line("INFO", "Running parser for '", col("scrape_type"), "'...")),
        F.when(fetched, _line("ERROR", broken)),
        F.when(error.isNull() & (count == 0), _line("WARNING", "0 records extracted.")),
        F.when(
            error.isNull() & (count > 0),
            _line(
                "SUCCESS",
                "Successfully extracted ",
                count.cast("string"),
                " records in ",
                elapsed.cast("string"),
                "s.",
            ),
        ),
    ]
    return [
        col("page_id"),
        error.isNull().alias("success"),
        F.when(invalid.isNotNull(), col("raw_url")).otherwise(url).alias("url"),
        col("scrape_type"),
        # a page that fails while it is read reports no status
        F.when(answered & (broken.isNull() | ~fetched), status).cast("int").alias("status_code"),
        elapsed.alias("execution_time"),
        count.alias("record_count"),
        F.coalesce(error, F.when(count == 0, outcome.no_records_notice(col("scrape_type")))).alias("error_message"),
        F.array_compact(F.array(*steps)).alias("logs"),
        F.when(error.isNull(), F.coalesce("content_type", F.lit(""))).otherwise("").alias("content_type"),
        F.when(error.isNull(), col("preview_json")).alias("preview_json"),
    ]


def html_logs(page_chars: Column, scrape_type: Column, count: Column, is_broken: Column) -> Column:
    """Log lines of a run on HTML that was already there (nothing was fetched)."""
    # The lines of such a run.
    return F.array(
        _line("INFO", "Scraping from local HTML test bench."),
        _line("INFO", "Content length: ", F.format_number(page_chars, 0), " characters."),
        _line("INFO", "Running parser for '", scrape_type, "'..."),
        F.when(is_broken, _line("ERROR", outcome.PARSE_ERROR))
        .when(count == 0, _line("WARNING", "0 records extracted."))
        .otherwise(_line("SUCCESS", "Successfully extracted ", count.cast("string"), " records in 0.0s.")),
    )


def explode_logs(report: DataFrame) -> DataFrame:
    """(page_id, scrape_type, line_no, level, message), one row per log line."""
    return explode_items(report, F.col("logs"), "page_id", "scrape_type").withColumnRenamed("r", "line").select(
        "page_id",
        "scrape_type",
        (F.col("i") + 1).cast("bigint").alias("line_no"),
        F.regexp_extract("line", r"^\[([^\]]*)\]", 1).alias("level"),
        F.regexp_replace("line", r"^\[[^\]]*\] ", "").alias("message"),
    )


def history_rows(report: DataFrame, timestamp: Column) -> DataFrame:
    """Report rows as history rows without an id."""
    ok = F.col("success")
    return report.select(
        "page_id",
        "url",
        "scrape_type",
        "record_count",
        F.when(ok, F.lit("Success")).otherwise("Failed").alias("status"),
        outcome.seconds(F.col("execution_time")).alias("execution_time"),
        F.date_format(timestamp, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(ok & (F.col("record_count") == 0), F.lit(outcome.NO_RECORDS_NOTE))
        .when(~ok, F.col("error_message"))
        .alias("error_message"),
        "preview_json",
    )
