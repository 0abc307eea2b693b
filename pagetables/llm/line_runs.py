"""Line deduplication with levelled sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without white space at its ends, A-Z lowered; only keys of at
least ``min_length`` code points count. A key that at least ``min_documents`` documents
hold loses its lines in all of them but the one with the largest id.

The keys are 128-bit hashes. Documents come in batches, those with the largest ids first,
so the first document in which a key is met is the one that keeps it:

1. A batch's hashes, one row each with its largest document and its count of documents,
   are dealt to buckets and sorted once.
2. A merge anti-join with every run leaves the hashes that no earlier batch had. They
   become a new run at level 0; the others are repeats and only their counts are kept.
   Runs are bucketed and sorted tables, so none is shuffled by this.
3. When ``fan`` runs stand at one level they are merged into one at the next, which
   bounds the runs a batch meets by ``fan`` times the levels.
4. The counts of the repeats are added to the runs, again bucket by bucket. Keys with
   too many documents meet the lines; a document gets the sorted places of its lines to
   go and keeps the stretches between them.

Hashes are counted before they are shuffled, so a line that a third of all documents hold is
one row of each task. Where the lines meet the keys, the join is one that adaptive
execution may split. Texts move once, to meet their places.

A null or empty text is one empty line. A null id is one document, smaller than all others.
Rows that share an id are one document. Repeated rows come out as often as they came in.
Very long texts are arrays of lines in their row; every step is linear in the line count. An
empty table gives no rows. Columns that clash with the operator's own are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder, remove_folder
from .common import stored, without

MIN_LENGTH = 40
MIN_DOCUMENTS = 5
BATCHES = 8
FAN = 4
WHITE = " \t\n\x0b\f\r"
NO_ID = -(1 << 63)


def line_hashes(text: Column, min_length: int = MIN_LENGTH) -> Column:
    """One hash per line, null for lines with a short key.

    Each byte of the UTF-8 form is read as one Latin-1 character before lowering. That lowers A-Z,
    and moves the first byte of some characters outside ASCII to another one; the number of
    following bytes still tells which it was, so two keys have one form only if they
    are equal."""
    stripped = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(WHITE)))
    form = lambda line: F.lower(F.decode(line.cast("binary"), "ISO-8859-1"))
    return F.transform(
        stripped, lambda line: F.when(F.length(line) >= min_length, F.unhex(F.md5(form(line).cast("binary"))))
    )


class LineRuns:
    """Sorted runs of hashes, at most ``fan - 1`` at each level after an ``add``."""

    def __init__(self, spark: SparkSession, fan: int = FAN, buckets: int | None = None):
        self.spark, self.fan = spark, fan
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.folder = new_folder(spark, "llm-line-runs")
        self.levels: list[list[str]] = []
        self.tables: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        """A bucketed and sorted table; each bucket is one file where the rows come bucketed."""
        name = f"line_run_{uuid.uuid4().hex}"
        sorted_rows = rows.write.bucketBy(self.buckets, "hash").sortBy("hash").option("path", f"{self.folder}/{name}")
        sorted_rows.format("parquet").saveAsTable(name)
        self.tables.append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """File the hashes of a batch (hash, owner, n: one row per hash) that no run has, and return
        the rows of those that some run has."""
        own = self.spark.table(self._write(batch.repartition(self.buckets, "hash")))
        new = own
        for run in self.runs():
            new = new.join(run.select("hash").hint("merge"), "hash", "left_anti")
        if not self.levels:
            self.levels.append([])
        fresh = self._write(new)
        self.levels[0].append(fresh)
        repeats = own.join(self.spark.table(fresh).select("hash").hint("merge"), "hash", "left_anti")
        self._compact()
        return repeats

    def _compact(self) -> None:
        at = 0
        while at < len(self.levels):
            if len(self.levels[at]) >= self.fan:
                merged = self.spark.table(self.levels[at][0])
                for name in self.levels[at][1:]:
                    merged = merged.union(self.spark.table(name))
                if at + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[at + 1].append(self._write(merged.repartition(self.buckets, "hash")))
                self.levels[at] = []
            at += 1

    def drop(self) -> None:
        """Forget the tables and remove their files."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove_folder(self.spark, self.folder)


def repeated_lines(lines: DataFrame, cuts: list[int], min_documents: int, fan: int = FAN) -> DataFrame:
    """(hash, owner) of the keys that enough documents hold. ``lines``: batch, doc, hash."""
    runs = LineRuns(lines.sparkSession, fan)
    repeats: DataFrame | None = None
    for number in range(len(cuts) + 1):
        in_batch = lines.where(F.col("batch") == number).groupBy("hash")
        known = runs.add(in_batch.agg(F.max("doc").alias("owner"), F.countDistinct("doc").alias("n")))
        repeats = known if repeats is None else repeats.union(known)
    more = repeats.groupBy("hash").agg(F.sum("n").alias("more")).repartition(runs.buckets, "hash")
    more = stored(more, "line-repeats").hint("merge")
    found: DataFrame | None = None
    for run in runs.runs():
        total = run.join(more, "hash", "left").where(F.col("n") + F.coalesce("more", F.lit(0)) >= min_documents)
        found = total if found is None else found.union(total)
    found = stored(found.select("hash", "owner"), "line-keys")
    runs.drop()
    return found


def deduplicate(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_documents: int = MIN_DOCUMENTS,
    batches: int = BATCHES,
    fan: int = FAN,
) -> DataFrame:
    """The documents with their kept lines as text, n_lines (before) and n_dropped."""
    docs = without(docs, "n_lines", "n_dropped", "_doc", "_print", "_places", "_lines")
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.withColumn("_doc", F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID))).withColumn("_print", F.xxhash64(whole))
    # Borders of the batches: equal shares of the documents. Any borders give the same result.
    shares = [i / batches for i in range(1, batches)]
    cuts = keyed.agg(F.percentile_approx("_doc", shares, 1000).alias("c")).first().c if shares else []
    cuts = sorted(set(cuts or []), reverse=True)
    number = sum(((F.col("doc") < cut).cast("int") for cut in cuts), F.lit(0))
    lines = keyed.select(
        F.col("_doc").alias("doc"), F.col("_print").alias("print"), F.posexplode(line_hashes(whole, min_length)).alias("place", "hash")
    )
    lines = lines.where("hash IS NOT NULL").withColumn("batch", number)
    lines = stored(lines, "lines", "batch")
    keys = repeated_lines(lines, cuts, min_documents, fan)
    gone = lines.join(keys, "hash").where("doc <> owner")
    places = gone.groupBy("doc", "print").agg(F.sort_array(F.collect_set("place")).alias("_places"))
    places = places.withColumnsRenamed({"doc": "_doc", "print": "_print"})
    found = keyed.join(places, ["_doc", "_print"], "left").withColumn("_lines", F.split(whole, "\n"))
    # The stretches of lines before, between and after the places, each cut out once.
    starts = F.concat(F.array(F.lit(0)), F.transform("_places", lambda p: p + 1))
    ends = F.concat(F.col("_places"), F.array(F.size("_lines")))
    stretches = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda s: F.slice("_lines", s.a + 1, s.b - s.a))
    return found.select(
        *[
            F.when(F.col("_places").isNull(), F.col(f"`{c}`")).otherwise(F.array_join(F.flatten(stretches), "\n")).alias(c)
            if c == text
            else F.col(f"`{c}`")
            for c in docs.columns
        ],
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_dropped"),
    )
