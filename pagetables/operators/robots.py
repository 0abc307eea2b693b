"""Robots rules for a table of URLs.

``parse_robots`` makes the rules from the robots.txt files as they were answered; fetching is
not part of it. ``check_robots`` joins rules and URLs.

``rules(host, group_no, agent, rule_no, allow, path_prefix)`` holds the parsed
robots.txt files; ``group_no`` and ``rule_no`` are file order. A host that answered
401 or 403 has one rule disallowing '/', one that answered 404 has no rules. A host
whose file could not be fetched has a row with the error in the optional column
``fetch_error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.arrays import let

# The agent a run identifies itself with unless told otherwise.
BROWSER_AGENT = (
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) "
    "Chrome/124.0.0.0 Safari/537.36"
)
# The agent that means all, the reason without a host, and the one for a
# file that could not be fetched, before and after the error.
ANY_AGENT = "*"
NO_DOMAIN = "Cannot verify robots.txt: invalid domain."
NOT_FETCHED = ("robots.txt could not be fetched (", "). Defaulting to permissible public access.")


# The fields of a file that form its groups, and where its lines end.
_FIELDS = {"user-agent": "agent", "allow": "rule", "disallow": "rule", "crawl-delay": "other", "request-rate": "other"}
_LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"


def _fields(body: Column) -> Column:
    """array<struct(kind, allow, value)>: the lines that form groups; an empty line ends one."""

    def read(line: Column) -> Column:
        strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
        plain = strip(F.substring_index(line, "#", 1))
        name = F.lower(strip(F.substring_index(plain, ":", 1)))
        raw = strip(F.substr(plain, F.instr(plain, ":") + 1))
        # A plus sign is no blank here, and a percent sign without two digits stays.
        escaped = F.replace(F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
        value = F.when(F.contains(raw, F.lit("%")), F.coalesce(F.try_url_decode(escaped), raw)).otherwise(raw)
        kinds = F.create_map(*[F.lit(x) for f in _FIELDS.items() for x in f])
        known = F.when(F.contains(plain, F.lit(":")), F.try_element_at(kinds, name))
        return F.struct(
            F.when(line == "", F.lit("end")).otherwise(known).alias("kind"), (name == "allow").alias("allow"), value.alias("value")
        )

    return F.filter(F.transform(F.split(body, _LINE_ENDS), read), lambda f: f.kind.isNotNull())


def _groups(body: Column) -> Column:
    """array<struct(agents, rules)> of one file in file order.

    A group begins with the first of neighbouring agent lines and ends at an empty line or
    at the next one; without any line after its agents it is dropped. One without rules
    allows everything."""

    def part(fields: Column, begin: Column, end: Column) -> Column:
        own = F.slice(fields, begin + 1, end - begin)
        agents = F.filter(own, lambda f: f.kind == "agent")
        rest = F.slice(own, F.size(agents) + 1, F.size(own))
        ends = F.array_position(F.transform(rest, lambda f: f.kind), "end").cast("int")
        lines = F.when(ends > 0, F.slice(rest, 1, ends - 1)).otherwise(rest)
        rules = F.transform(
            F.filter(lines, lambda f: f.kind == "rule"), lambda f: F.struct(f.allow.alias("allow"), f.value.alias("path_prefix"))
        )
        anything = F.array(F.struct(F.lit(True).alias("allow"), F.lit("").alias("path_prefix")))
        return F.when(
            F.size(lines) > 0,
            F.struct(
                F.transform(agents, lambda f: f.value).alias("agents"), F.when(F.size(rules) > 0, rules).otherwise(anything).alias("rules")
            ),
        )

    def grouped(fields: Column) -> Column:
        first = lambda j: F.when(j == 0, True).otherwise(F.get(fields, j - 1).kind != "agent")
        begins = F.filter(F.transform(fields, lambda f, j: F.when((f.kind == "agent") & first(j), j)), lambda j: j.isNotNull())
        return let(
            begins,
            lambda b: F.transform(b, lambda at, k: part(fields, at, F.coalesce(F.get(b, k + 1), F.size(fields)))),
        )

    return F.filter(let(_fields(body), grouped), lambda g: g.isNotNull())


def parse_robots(files: DataFrame) -> DataFrame:
    """``rules`` from ``files(host, status, body)`` and, if there, ``fetch_error``.

    A file that was answered is read in its own row. 401, 403 and answers of 500 and above forbid
    everything, other answers of 400 and above nothing. A host without an answer keeps its error."""
    error = F.col("fetch_error") if "fetch_error" in files.columns else F.lit(None).cast("string")
    nothing = F.array(
        F.struct(
            F.array(F.lit(ANY_AGENT)).alias("agents"), F.array(F.struct(F.lit(False).alias("allow"), F.lit("/").alias("path_prefix"))).alias("rules")
        )
    )
    status = F.coalesce("status", F.lit(200))
    found = (
        F.when(error.isNotNull(), F.slice(nothing, 1, 0))
        .when(status.isin(401, 403) | (status >= 500), nothing)
        .when(status >= 400, F.slice(nothing, 1, 0))
        .otherwise(_groups(F.coalesce("body", F.lit(""))))
    )
    groups = files.select("host", error.alias("fetch_error"), F.posexplode_outer(found).alias("group_no", "g"))
    agents = groups.select("host", "fetch_error", "group_no", F.explode_outer("g.agents").alias("agent"), F.col("g.rules").alias("rules"))
    rules = agents.select("host", "fetch_error", "group_no", "agent", F.posexplode_outer("rules").alias("rule_no", "r"))
    return rules.select("host", "group_no", "agent", "rule_no", "r.allow", "r.path_prefix", "fetch_error")


def rules_by_host(rules: DataFrame, user_agent: str) -> DataFrame:
    """(host, rules, fetch_error): the rules that apply to one agent, as an array in file
    order. An array is as long as one robots.txt file.

    The first group naming the agent wins, else the first group for '*'."""
    token = F.lit(user_agent.split("/")[0].lower())
    error = F.col("fetch_error") if "fetch_error" in rules.columns else F.lit(None).cast("string")
    rule = F.struct(
        "rule_no",
        "group_no",
        (F.col("agent") == ANY_AGENT).alias("star"),
        (F.col("allow") | (F.coalesce("path_prefix", F.lit("")) == "")).alias("allow"),
        urls.robots_prefix(F.coalesce("path_prefix", F.lit(""))).alias("prefix"),
    )
    named = (F.col("agent") == ANY_AGENT) | F.contains(token, F.lower("agent"))
    hosts = rules.groupBy("host").agg(
        F.sort_array(F.collect_list(F.when(named, rule))).alias("rules"), F.max(error).alias("fetch_error")
    )
    stars = F.array_distinct(F.transform(F.filter("rules", lambda r: r.star), lambda r: r.group_no))
    own = F.array_min(
        F.transform(F.filter("rules", lambda r: ~F.array_contains("stars", r.group_no)), lambda r: r.group_no)
    )
    chosen = hosts.withColumn("stars", stars).withColumn("group_no", F.coalesce(own, F.array_min("stars")))
    return chosen.select(
        "host",
        F.filter("rules", lambda r: r.group_no == F.col("group_no")).alias("rules"),
        "fetch_error",
    )


def with_robots(rows: DataFrame, rules: DataFrame, user_agent: str = ANY_AGENT) -> DataFrame:
    """The rows with is_allowed and reason for their ``url``.

    One join by host; the first rule in file order whose path is a prefix decides, in the
    row itself. A host with very many rows is split by adaptive execution."""
    clean = urls.sanitize_url(F.col("url"))
    checked = rows.withColumn("_clean", clean).withColumn("_host", urls.url_netloc(F.col("_clean")))
    known = rules_by_host(rules, user_agent).select(
        F.col("host").alias("_host"), F.col("rules").alias("_rules"), F.col("fetch_error").alias("_error")
    )
    joined = checked.join(known, "_host", "left").withColumn("_path", urls.robots_path(F.col("_clean")))
    first = F.get(F.filter("_rules", lambda r: F.startswith("_path", r.prefix)), F.lit(0))
    failed = F.col("_error").isNotNull()
    allowed = failed | F.coalesce(first.allow, F.lit(True))
    address = urls.split_url(F.col("_clean"))
    reason = F.concat(
        F.when(allowed, F.lit("Allowed by ")).otherwise("Disallowed by "),
        address.scheme,
        F.lit("://"),
        address.netloc,
        F.lit(f"/robots.txt for user-agent '{user_agent}'."),
    )
    no_host: Column = F.col("_host") == ""
    return joined.select(
        *rows.columns,
        F.when(no_host, False).otherwise(allowed).alias("is_allowed"),
        F.when(no_host, F.lit(NO_DOMAIN))
        .when(failed, F.concat(F.lit(NOT_FETCHED[0]), "_error", F.lit(NOT_FETCHED[1])))
        .otherwise(reason)
        .alias("reason"),
    )


def check_robots(pages: DataFrame, rules: DataFrame, user_agent: str = ANY_AGENT) -> DataFrame:
    """(page_id, url, is_allowed, reason) for every page; only (page_id, url) is read."""
    return with_robots(pages.select("page_id", "url"), rules, user_agent)


def robots_blocked(pages: DataFrame, rules: DataFrame, user_agent: str = BROWSER_AGENT) -> DataFrame:
    """Pages a run must not extract, with the reason."""
    return check_robots(pages, rules, user_agent).where(~F.col("is_allowed"))
