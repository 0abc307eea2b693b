"""Run history: numbering, search, statistics and previews of a history table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import outcome, urls
from ..functions.arrays import explode_items
from ..session import new_folder

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("url", T.StringType(), False),
        T.StructField("scrape_type", T.StringType(), False),
        T.StructField("record_count", T.LongType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("execution_time", T.DoubleType(), False),
        T.StructField("timestamp", T.StringType(), False),
        T.StructField("error_message", T.StringType(), True),
        T.StructField("preview_json", T.StringType(), True),
    ]
)

# Names the history is shown with, and its limits.
DISPLAY_COLUMNS = {
    "id": "Job ID",
    "timestamp": "Timestamp",
    "url": "Target URL",
    "scrape_type": "Data Type",
    "record_count": "Records",
    "status": "Status",
    "execution_time": "Time (s)",
    "error_message": "Notes / Error",
}
DEFAULT_LIMIT = 100
LOG_CAPACITY = 500


def number_rows(
    rows: DataFrame,
    order: list[str],
    first_id: int,
    partitions: int | None = None,
    folder: str | None = None,
    seen: Observation | None = None,
) -> DataFrame:
    """Add ``id`` = first_id, first_id + 1, … in the given order, without passing all
    rows through one task. ``order`` must tell the rows apart: ties are numbered in any
    order.

    Rows are range-partitioned and written once with their partition number, so a
    lost executor cannot move a row between partitions afterwards. One small count
    per partition then gives the offsets. The result reads ``folder``, which the caller
    may remove when it has used the result. ``seen`` observes the rows as they are written: their
    number ``n`` needs no reading.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(*([partitions] if partitions else []), *order)
    folder = folder or new_folder(spark, "numbering")
    # Observed after the exchange, so that the sampling of ranges is not counted.
    ranged = ranged.withColumn("_part", F.spark_partition_id())
    (ranged.observe(seen, F.count(F.lit(1)).alias("n")) if seen else ranged).write.parquet(folder)
    stored = spark.read.parquet(folder)
    # as many rows as partitions, so one task may order them
    offsets = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn(
            "_offset",
            F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        )
        .select("_part", F.coalesce("_offset", F.lit(0)).alias("_offset"))
    )
    in_part = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (
        stored.withColumn("_row", in_part)
        .join(offsets, "_part")
        .withColumn("id", (F.lit(first_id - 1) + F.col("_offset") + F.col("_row")).cast("bigint"))
        .drop("_part", "_row", "_offset")
    )


def with_ids(
    rows: DataFrame, order: list[str], last_id: int = 0, folder: str | None = None, seen: Observation | None = None
) -> DataFrame:
    """New history rows with ids after the highest one ever given."""
    numbered = number_rows(rows, order, last_id + 1, folder=folder, seen=seen)
    return numbered.select(
        *[
            outcome.seconds(F.col("execution_time")).alias("execution_time") if f.name == "execution_time" else F.col(f.name)
            for f in HISTORY_SCHEMA.fields
        ]
    )


def search(history: DataFrame, keyword: str | None) -> DataFrame:
    """Keyword anywhere in URL or kind, ignoring case; '%' and '_' are wildcards.
    A blank keyword keeps everything."""
    if not keyword or not keyword.strip():
        return history
    pattern = "%" + keyword.strip().replace("\\", "\\\\") + "%"
    return history.where(F.col("url").ilike(pattern) | F.col("scrape_type").ilike(pattern))


def with_status(history: DataFrame, status: str | None) -> DataFrame:
    """Runs of one status; None and 'All' keep everything."""
    return history if not status or status == "All" else history.where(F.col("status") == status)


def recent(
    history: DataFrame, keyword: str | None = None, status: str | None = None, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """Newest runs first, without the previews."""
    found = with_status(search(history, keyword), status)
    return found.select(*DISPLAY_COLUMNS).orderBy(F.desc("id")).limit(limit)


def rename_display(history: DataFrame) -> DataFrame:
    return history.withColumnsRenamed(DISPLAY_COLUMNS)


def by_id(history: DataFrame, run_id: int) -> DataFrame:
    return history.where(F.col("id") == run_id)


def without_id(history: DataFrame, run_id: int) -> DataFrame:
    return history.where(F.col("id") != run_id)


def stats(history: DataFrame) -> DataFrame:
    """All six statistics from one scan."""
    ok = F.col("status") == "Success"
    total = F.count(F.lit(1))
    good = F.count_if(ok)
    return history.agg(
        total.alias("total_scrapes"),
        good.alias("successful"),
        F.count_if(F.col("status") == "Failed").alias("failed"),
        F.coalesce(F.sum(F.when(ok, F.col("record_count"))), F.lit(0)).cast("bigint").alias("total_records"),
        F.coalesce(outcome.seconds(F.avg(F.when(ok, F.col("execution_time")))), F.lit(0.0)).alias("avg_time"),
        outcome.percent(good, total).alias("success_rate"),
    )


def page_kpis(history: DataFrame) -> DataFrame:
    """Records, time, host and time of day of the latest run."""
    latest = history.agg(
        F.max_by(F.struct("record_count", "execution_time", "url", "timestamp"), "id").alias("r")
    )
    url = F.col("r.url")
    return latest.select(
        F.coalesce("r.record_count", F.lit(0)).alias("records"),
        F.concat(F.format_string("%.2f", F.coalesce("r.execution_time", F.lit(0.0))), F.lit("s")).alias("latency"),
        F.when(url.isNull(), F.lit("Standby")).otherwise(urls.domain_display(url)).alias("host"),
        outcome.time_display(F.col("r.timestamp")).alias("time_of_day"),
    )


def preview_rows(history: DataFrame) -> DataFrame:
    """Stored previews back as rows: (id, record_no, record map)."""
    parsed = F.from_json("preview_json", T.ArrayType(T.MapType(T.StringType(), T.StringType())))
    return explode_items(history, parsed, "id").select(
        "id", (F.col("i") + 1).cast("bigint").alias("record_no"), F.col("r").alias("record")
    )


def preview_variants(history: DataFrame) -> DataFrame:
    """Stored previews as rows (id, record_no, record variant): the text is parsed once, and fields are
    read with their types (``text.field``). A text that is not JSON gives no rows."""
    parsed = F.try_variant_get(F.try_parse_json("preview_json"), "$", "array<variant>")
    return explode_items(history, parsed, "id").select(
        "id", (F.col("i") + 1).cast("bigint").alias("record_no"), F.col("r").alias("record")
    )


def log_tail(logs: DataFrame, order: list[str], capacity: int = LOG_CAPACITY) -> DataFrame:
    """The newest events in the order they came."""
    newest = logs.orderBy(*[F.desc(c) for c in order]).limit(capacity)
    return newest.orderBy(*order)


def level_counts(lines: DataFrame, line: Column) -> DataFrame:
    return lines.groupBy(outcome.log_level(line).alias("level")).agg(F.count(F.lit(1)).alias("n"))
