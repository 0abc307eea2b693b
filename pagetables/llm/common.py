"""Helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import new_folder


def stored(rows: DataFrame, purpose: str, *folders: str) -> DataFrame:
    """The rows written once to the shared folder and read back: later jobs start
    from the files, also after an executor is lost. ``folders``: columns whose values get
    a folder each."""
    path = new_folder(rows.sparkSession, f"llm-{purpose}")
    rows.write.partitionBy(*folders).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def raw_texts(texts: pa.Array) -> Iterator[bytes | None]:
    """UTF-8 bytes of each text, a few texts at a time."""
    raw = texts.cast(pa.binary())
    for at in range(0, len(raw), 64):
        yield from raw.slice(at, 64).to_pylist()


def split_words(raw: bytes | None) -> list[bytes]:
    """Words of a text: what stands between blanks and U+0009 to U+000D."""
    return raw.split() if raw else []


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Boolean mask of ``size`` places that lie in a window of ``width`` places
    beginning at one of ``starts``."""
    edges = np.zeros(size + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + width, size), -1)
    return np.cumsum(edges[:size]) > 0


def without(rows: DataFrame, *names: str) -> DataFrame:
    """The rows without columns of these names, in any case: an operator's own
    columns take the place of input columns that are named alike."""
    taken = {n.lower() for n in names}
    return rows.select(*[rows[f"`{c}`"] for c in rows.columns if c.lower() not in taken])


def sampled(rows: DataFrame, by: Column, n: int) -> DataFrame:
    """At most ``n`` rows, one for each of the lowest hashes of ``by``: of rows alike in it
    there is one. The hashes are made distinct alone, so that no task sends many rows."""
    hashed = rows.withColumn("_hash", F.pmod(F.xxhash64(by), F.lit(1 << 40)))
    hashes = stored(hashed.select("_hash").distinct(), "hashes")
    total, low = hashes.count(), hashes
    if total > 4 * n:
        low = hashes.where(F.col("_hash") < (1 << 40) * 4 * n // total)
        low = low if low.count() >= n else hashes
    last = low.orderBy("_hash").limit(n).agg(F.max("_hash")).first()[0]
    return hashed.where(F.col("_hash") <= F.lit(last).cast("long")).dropDuplicates(["_hash"]).drop("_hash")
