"""Outcome of a run: fetch errors, HTTP status, log lines, export names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank

# Texts a run reports.
INVALID_URL = "❌ Invalid URL: "
ROBOTS_DENIED = "🚫 Scraping disallowed by target website's robots.txt policy ("
HTTP_403 = (
    "🚫 HTTP 403 Forbidden: Access denied by target server. "
    "The website may require authentication or block automated requests."
)
EMPTY_PAGE = "📄 Empty Webpage: The server responded with an empty content body."
TLS_ERROR = (
    "❌ Unable to establish secure HTTPS connection. The website's SSL certificate may be invalid."
)
PARSE_ERROR = "❌ Parsing Error: An unexpected error occurred while parsing HTML: Invalid IPv6 URL"
NO_RECORDS_NOTE = "0 records found"
HTML_TYPE = "text/html; charset=utf-8"
# What a page without an answer is reported with.
NO_ANSWER = "no answer"
DEFAULT_TIMEOUT = 10


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def seconds(time: Column) -> Column:
    """Seconds as they are shown and saved."""
    return F.round(time, 2)


def percent(part: Column, whole: Column) -> Column:
    """Percentage with one digit; 0 of nothing."""
    return F.when(whole > 0, F.round(part / whole * 100, 1)).otherwise(0.0)


def fetch_error_message(fetch_error: Column, url: Column, timeout: int = DEFAULT_TIMEOUT) -> Column:
    """Message for a failed request; null where nothing failed."""
    # The messages.
    return F.when(
        fetch_error.isNotNull(),
        F.when(
            fetch_error == "timeout",
            _text(
                "⏱️ Connection timeout: The target server at '",
                url,
                f"' did not respond within {timeout} seconds.",
            ),
        )
        .when(fetch_error == "ssl", F.lit(TLS_ERROR))
        .when(
            fetch_error == "connection",
            _text(
                "❌ Connection Error: Unable to reach '",
                url,
                "'. The domain might be down, invalid, or blocking connections.",
            ),
        )
        .otherwise(_text("❌ HTTP Request Exception: ", fetch_error)),
    )


def http_error(status_code: Column, url: Column) -> Column:
    """Message for a status that ends the run; null where parsing goes on."""
    return (
        F.when(status_code == 403, F.lit(HTTP_403))
        .when(
            status_code == 404,
            _text("🔍 HTTP 404 Not Found: The requested URL '", url, "' does not exist on the server."),
        )
        .when(
            status_code >= 500,
            _text(
                "⚠️ Server Error (HTTP ",
                status_code.cast("string"),
                "): The remote server encountered an error while processing the request.",
            ),
        )
    )


def status_warning(status_code: Column) -> Column:
    odd = (status_code != 200) & ~status_code.isin(403, 404) & (status_code < 500)
    return F.when(odd, _text("⚠️ Unexpected HTTP Status Code: ", status_code.cast("string"), "."))


def content_type_warning(content_type: Column) -> Column:
    kind = F.coalesce(content_type, F.lit(""))
    is_html = kind.contains("text/html") | kind.contains("application/xhtml")
    return F.when(~is_html, _text("Content-Type '", kind, "' might not be an HTML document."))


def http_outcome(status_code: Column, url: Column, html: Column) -> Column:
    """struct(outcome, error): 'failed' with its message, or 'warning' / 'ok'."""
    error = F.coalesce(http_error(status_code, url), F.when(is_blank(html), F.lit(EMPTY_PAGE)))
    return F.struct(
        F.when(error.isNotNull(), F.lit("failed"))
        .when(status_warning(status_code).isNotNull(), F.lit("warning"))
        .otherwise("ok")
        .alias("outcome"),
        error.alias("error"),
    )


def no_records_notice(scrape_type: Column) -> Column:
    return _text("ℹ️ Notice: No '", scrape_type, "' elements were found on this webpage.")


def log_level(line: Column) -> Column:
    """Class of a log line: errors before warnings before successes."""
    return (
        F.when(line.contains("[ERROR]"), F.lit("error"))
        .when(line.contains("[WARNING]"), F.lit("warning"))
        .when(line.contains("[SUCCESS]"), F.lit("success"))
        .otherwise("info")
    )


_LOG_LINE = r"(?s)^\[([^\]]*)\] \[([^\]]*)\] (.*)\z"


def parse_log_line(line: Column) -> Column:
    """struct(timestamp, level, message) of ``[timestamp] [LEVEL] message``."""
    return F.struct(
        F.try_to_timestamp(F.regexp_extract(line, _LOG_LINE, 1), F.lit("yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        F.regexp_extract(line, _LOG_LINE, 2).alias("level"),
        F.regexp_extract(line, _LOG_LINE, 3).alias("message"),
    )


def time_display(timestamp: Column) -> Column:
    """Time of day of a formatted timestamp; null becomes 'Never'."""
    return F.coalesce(F.element_at(F.split(timestamp, " "), -1), F.lit("Never"))


def export_name(scrape_type: Column, at: Column) -> Column:
    """Name of an export: ``scraped_<type>_<yyyyMMdd_HHmmss>``."""
    slug = F.replace(F.lower(scrape_type), F.lit(" "), F.lit("_"))
    return F.concat_ws("_", F.lit("scraped"), slug, F.date_format(at, "yyyyMMdd_HHmmss"))
