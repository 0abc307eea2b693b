"""Exports of record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_ORDER_MARK = "\ufeff"
# Bounds of a column's width.
MIN_WIDTH, MAX_WIDTH, PADDING = 12, 60, 4


def write_csv(records: DataFrame, path: str) -> None:
    """CSV with a header per part file, which starts with the UTF-8 byte order mark.
    A table without rows gives no bytes."""
    first, *rest = records.columns
    marked = records.select(F.col(f"`{first}`").alias(BYTE_ORDER_MARK + first), *[F.col(f"`{c}`") for c in rest])
    marked.write.csv(
        path,
        header=True,
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(
        path,
        schema=schema,
        header=True,
        escape='"',
        multiLine=True,
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def write_json(records: DataFrame, path: str) -> None:
    """One JSON object per line; nulls are written."""
    records.write.option("ignoreNullFields", "false").json(path)


def _shown_length(value: Column) -> Column:
    return F.length(F.substring_index(value, "\n", 1))


def _shown_value(name: str, kind: str) -> Column:
    value = F.col(f"`{name}`")
    text = value.cast("string")
    # zero and false are shown empty
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        return F.when(value != 0, text).otherwise("")
    if kind == "boolean":
        return F.when(value, F.lit("True")).otherwise("")
    return F.coalesce(text, F.lit(""))


def column_widths(records: DataFrame) -> DataFrame:
    """(column_name, width): longest first line of header and values plus padding,
    kept within bounds. One aggregation over all columns."""
    longest = records.agg(
        *[F.max(_shown_length(_shown_value(c, t))).alias(str(i)) for i, (c, t) in enumerate(records.dtypes)]
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.least(
                F.greatest(
                    F.greatest(F.coalesce(F.col(str(i)), F.lit(0)), _shown_length(F.lit(c))) + PADDING,
                    F.lit(MIN_WIDTH),
                ),
                F.lit(MAX_WIDTH),
            )
            .cast("bigint")
            .alias("width"),
        )
        for i, c in enumerate(records.columns)
    ]
    return longest.select(F.inline(F.array(*entries)))
