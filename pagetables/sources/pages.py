"""Reading pages."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages from a Parquet table; unused columns and filters reach the scan."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_html_files(spark: SparkSession, path: str, page_id: Column, url: Column) -> DataFrame:
    """Pages from HTML files, one document per file. ``page_id`` and ``url`` are
    expressions over ``path``, the file's location."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html")).select(
        page_id.cast("bigint").alias("page_id"), url.alias("url"), "html"
    )


def write_html_files(pages: DataFrame, path: str) -> None:
    """(page_id, html) as files ``page_id=...`` below ``path``, one document per file: a folder per
    task, not one per page. Rows of one page in a task go to one file; each ends with a line break."""

    def write(rows: Iterator[Row]) -> None:
        store, root = fs.FileSystem.from_uri(path)
        folder = f"{root}/part-{TaskContext.get().partitionId():05d}"
        store.create_dir(folder)
        for page_id, own in groupby(rows, lambda r: r.page_id):
            with store.open_output_stream(f"{folder}/page_id={page_id}.html") as out:
                for row in own:
                    out.write(bytes(row.html or b"") + b"\n")

    pages.select("page_id", F.col("html").cast("binary").alias("html")).sortWithinPartitions("page_id").foreachPartition(write)
