"""The history table: files that are only added to, safe for several writers and crashes.

* ``claims/<k>``: the k-th claim of a range of ids (batch, first_id, n). It is drafted elsewhere
  and appears whole and only if it is not there, so one writer gets each claim, and each claim
  starts where the one before it ends: ids are never used twice, also when a claim's
  writer dies.
* ``rows/claim=<k>/attempt=<a>``: the rows one attempt wrote for a claim.
* ``closed/<k>``: the attempt that counts, again only if it is not there. Rows of claims that are
  not closed do not show.
* ``deleted``, ``cleared``: one small file for each deletion (an id) and clearing (the highest id
  claimed by then).

A batch that is saved again finds its claim. If it is closed nothing is left to do; if not, its
rows are written once more under the same ids. Deletions hold for ids. So appends, deletions,
clearings and repeats give the same table in any order of the repeats. A range whose writer
died and whose batch never comes again stays unused.

"Only if it is not there" is a hard link on local file systems and a rename without overwriting on
others; the folder has to be in a store where that is atomic, such as HDFS.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..plans import history
from ..session import new_folder, remove_folder

_CLAIM = "claim bigint, batch bigint, first_id bigint, n bigint"
_CLOSED = "claim bigint, attempt string"
_ID = "id bigint"


class HistoryStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _small(self, name: str, schema: str) -> DataFrame:
        """A small table of the store; empty while it is not there."""
        location = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not location.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(location):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/{name}")

    def _publish(self, name: str, **row: int | str | None) -> bool:
        """Make a file of one row appear, whole; False if there is one of that name."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        files = target.getFileSystem(conf)
        files.mkdirs(target.getParent())
        out = files.create(draft, False)
        out.write(json.dumps(row).encode())
        out.close()
        try:
            if files.getUri().getScheme() == "file":
                place = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(place(target), place(draft))
            else:
                options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(draft, target, options)
        except Py4JJavaError as refused:
            if "FileAlreadyExists" not in refused.java_exception.getClass().getName():
                raise
            return False
        finally:
            files.delete(draft, False)
        return True

    def _claim(self, batch: int | None, n: int) -> tuple[int, int]:
        """(claim, first id) for ``n`` rows; those of the batch's own claim if it has one."""
        while True:
            known = self._small("claims", _CLAIM).agg(
                F.max("claim").alias("claim"),
                F.max(F.col("first_id") + F.col("n") - 1).alias("last_id"),
                F.min(F.when(F.col("batch") == F.lit(batch), F.struct("claim", "first_id", "n"))).alias("again"),
            ).first()
            if known.again:
                if n != known.again.n:
                    raise ValueError(f"batch {batch} had {known.again.n} rows and now has {n}")
                return known.again.claim, known.again.first_id
            claim, first = (known.claim or 0) + 1, (known.last_id or 0) + 1
            # Refused if another writer was faster: look again.
            if self._publish(f"claims/{claim:012d}", claim=claim, batch=batch, first_id=first, n=n):
                return claim, first

    def read(self) -> DataFrame:
        """All saved runs that are not deleted; an empty table when nothing was saved."""
        closed = self._small("closed", _CLOSED)
        if closed.isEmpty():
            return self.spark.createDataFrame([], history.HISTORY_SCHEMA)
        schema = f"{history.HISTORY_SCHEMA.toDDL()}, {_CLOSED}"
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/rows").join(closed, ["claim", "attempt"], "left_semi")
        cleared = self._small("cleared", _ID).agg(F.max("id")).first()[0]
        if cleared is not None:
            stored = stored.where(F.col("id") > cleared)
        stored = stored.join(self._small("deleted", _ID).distinct(), "id", "left_anti")
        return stored.select(*history.HISTORY_SCHEMA.names)

    def append(self, rows: DataFrame, order: list[str], batch: int | None = None) -> int:
        """Save ``rows`` (history columns without id) and return the last id given.

        ``order`` must tell all rows apart, so that a batch saved again gets the same
        ids. A batch that is saved again must have the rows it had."""
        scratch = new_folder(self.spark, "numbering")
        seen = Observation()
        numbered = history.with_ids(rows, order, folder=scratch, seen=seen)
        n = seen.get.get("n", 0)
        claim, first = self._claim(batch, n)
        if self._small("closed", _CLOSED).where(F.col("claim") == claim).isEmpty():
            attempt = f"a{uuid.uuid4().hex}"
            folder = f"{self.path}/rows/claim={claim}/attempt={attempt}"
            numbered.withColumn("id", F.col("id") + F.lit(first - 1)).write.parquet(folder)
            if not self._publish(f"closed/{claim:012d}", claim=claim, attempt=attempt):
                remove_folder(self.spark, folder)
        remove_folder(self.spark, scratch)
        return first + n - 1

    def delete(self, run_id: int) -> bool:
        """Delete one run; true also when there is none."""
        return self._publish(f"deleted/{uuid.uuid4().hex}", id=run_id)

    def clear(self) -> bool:
        last = self._small("claims", _CLAIM).agg(F.max(F.col("first_id") + F.col("n") - 1)).first()[0]
        return self._publish(f"cleared/{uuid.uuid4().hex}", id=last or 0)
