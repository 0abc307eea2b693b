"""From raw documents to packed training sequences.

Each stage works on what the stage before it kept, written as Parquet and read again.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetables.llm import mixing, packing, quality, simhash, substrings
from pagetables.session import new_folder, set_local_folder

# Parts of their tokens that the toxic domains keep; the others keep what they have. Not
# zero: clean documents carry a little of the posterior of these domains.
TOXIC = {"quality0_toxic1": 0.1, "quality1_toxic1": 0.1}


def _columns(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the present text."""
    n_chars = [c for c in like.columns if c == "n_chars"]
    docs = docs.withColumn("n_chars", F.length("text").cast("long")) if n_chars else docs
    return docs.select(*like.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each class of texts whose fingerprints of
    three-word sequences are linked by at most two differing bits."""
    return simhash.deduplicate(docs, width=3, limit=2)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has. Texts that
    lose words are their kept words joined by one blank."""
    return _columns(substrings.remove_repeats(docs), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says, to the nearest whole number. Rates keep
    the tokens of the clean domains and bring those of the toxic ones down, so a clean
    document stays once and a toxic one goes. The rates meet the targets, their rounding
    does not (``Fit.rounded``, README)."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed, _, _ = mixing.mix(
        docs, labels, ("quality", "toxic"), lambda domains: mixing.targets_by_scale(domains, TOXIC), whole=True
    )
    copies = mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return copies.select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in a sequence."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packed_sequences", packed_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    set_local_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
