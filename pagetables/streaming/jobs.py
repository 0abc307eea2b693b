"""Incremental jobs: pages and log lines that keep arriving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import outcome
from ..operators.extract import page_reader, records_of
from ..plans.history import LOG_CAPACITY, level_counts, log_tail
from ..plans.report import addressed, history_rows, html_report_of, report_of
from ..session import new_folder, remove_folder
from ..sources.history_store import HistoryStore


def stream_extract(
    pages: DataFrame,
    records_path: str,
    checkpoint: str,
    history: HistoryStore | None = None,
    max_records: int | None = None,
    responses: DataFrame | None = None,
    rules: DataFrame | None = None,
    event_time: str | None = None,
    repeats_within: str = "1 day",
) -> StreamingQuery:
    """Extract every new page and log its runs, then stop when all input is read.

    ``responses`` and ``rules`` are as in ``run_report``; without responses the pages are
    HTML that was already there. A batch's pages are read once, and records and runs
    come from what was read. A batch is written under its own number and replaces itself
    when it is run again, so a restart neither loses nor repeats records.
    """
    read = page_reader(max_records)
    if event_time is not None:
        pages = pages.withWatermark(event_time, repeats_within).dropDuplicatesWithinWatermark(["page_id"]).drop(event_time)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        scratch = new_folder(spark, "stream-batch")
        read(addressed(batch)).write.parquet(scratch)
        found = spark.read.parquet(scratch)
        records_of(found).write.mode("overwrite").parquet(f"{records_path}/batch_id={batch_id}")
        if history is not None:
            report = html_report_of(found) if responses is None else report_of(found, responses, rules)
            history.append(history_rows(report, F.current_timestamp()), ["page_id", "scrape_type"], batch_id)
        remove_folder(spark, scratch)

    return (
        pages.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_log_counts(lines: DataFrame, line: Column, path: str, checkpoint: str) -> StreamingQuery:
    """Running number of log lines per level, in a folder that every batch replaces:
    there are four levels, so neither the state nor the folder grows."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(path)

    return (
        level_counts(lines, line)
        .writeStream.outputMode("complete")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _timed(lines: DataFrame, line: Column) -> DataFrame:
    """The lines with the time they name as ``logged_at`` (null where none can be read)."""
    return lines.withColumn("logged_at", outcome.parse_log_line(line)["timestamp"])


def stream_log_windows(
    lines: DataFrame, line: Column, path: str, checkpoint: str, width: str = "1 hour", late: str = "10 minutes"
) -> StreamingQuery:
    """Number of log lines per level and window of the time that the lines name, as
    (window_start, window_end, level, n) in ``path``.

    A window is written once, when the newest line read is ``late`` past its end, so what is
    kept in state are the windows of that span. Lines that come after their window was
    written, or that name no time, are not counted here; ``stream_log_counts`` counts all.
    The file sink commits whole batches: a restart neither loses nor repeats a window.
    """
    counts = (
        _timed(lines, line)
        .withWatermark("logged_at", late)
        .groupBy(F.window("logged_at", width).alias("w"), outcome.log_level(line).alias("level"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "level", "n")
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_log_tail(
    lines: DataFrame, line: Column, ties: list[str], path: str, checkpoint: str, capacity: int = LOG_CAPACITY
) -> StreamingQuery:
    """The ``capacity`` newest lines by the time they name, then by ``ties``, however late or
    out of order they come; lines that name no time are the oldest.

    A batch's tail is made of the tail before it and the batch, and written under the
    batch's number; a batch that is run again replaces its own. Two tails are kept.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = _timed(batch, line)
        if batch_id:
            known = known.unionByName(spark.read.schema(known.schema).parquet(f"{path}/batch_id={batch_id - 1}"))
        tail = log_tail(known, ["logged_at", *ties], capacity)
        tail.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        remove_folder(spark, f"{path}/batch_id={batch_id - 2}")

    return (
        lines.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_log_tail(spark: SparkSession, path: str) -> DataFrame:
    """The newest tail that ``stream_log_tail`` wrote."""
    tails = spark.read.parquet(path)
    newest = tails.agg(F.max("batch_id").alias("newest"))
    return tails.join(F.broadcast(newest), F.col("batch_id") == F.col("newest")).drop("batch_id", "newest")
