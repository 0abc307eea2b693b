"""The operators as registered queries over the given tables, with SQL where SQL can
express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, licenses, line_runs, main_text, mixing, neighbours, oracles, packing, prefix_trie, quality, sharding, simhash, substrings, token_counts

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Shares of the tokens that the mixture should have, by domain.
MIXTURE = {"quality1_toxic0": 0.88, "quality0_toxic0": 0.1, "quality1_toxic1": 0.018, "quality0_toxic1": 0.002}
LABELS = ("quality", "toxic")


@query
def op1_min_cost_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crc = F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).alias("text_crc32")
    own = docs.select(
        "doc_id",
        "text",
        crc,
        sharding.file_number(docs).alias("file_no"),
        F.struct("_metadata.file_path", "_metadata.row_index").alias("place"),
    )
    found, plan = sharding.reshard(own, F.col("file_no"), [F.col("place")], 16)
    found = found.select("doc_id", "text", "text_crc32", "size", "shard", "slot")
    # The digest is that of the shards as they are now: the written ones, read back, and
    # those left, whose texts do not move.
    moved = found.drop("text_crc32")
    path = sharding.rewrite(moved, plan)
    digest = ["doc_id", "size", "text_crc32", "shard", "slot"]
    left = found.where(~F.col("shard").isin(plan.affected)) if plan.affected else found
    written = spark.read.schema(moved.schema).parquet(path).select("doc_id", "size", crc, "shard", "slot")
    return left.select(*digest).union(written).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    mixed, membership, _ = mixing.mix(docs, labels, LABELS, lambda domains: mixing.targets_by_weight(domains, MIXTURE))
    each = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(membership.domains)]
    return mixed.select("doc_id", "n_tokens", *each, "rate", "copies")


@query
def op3_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


@query
def op4_suffix_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op5_min_cut_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs)


@query
def op7_offset_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_sections(docs)
    return counted.withColumn("n_tokens", F.col("n_tokens").cast("long"))


@query
def op8_licence_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    best = F.array_sort(F.filter("licences", lambda x: x.confirmed), lambda a, b: F.sign(b.probability - a.probability).cast("int"))
    scanned = licenses.scan(docs).withColumn("best", best)
    return scanned.select(
        "doc_id",
        F.size("licences").alias("n_accepted"),
        F.size("best").alias("n_confirmed"),
        F.transform("best", lambda x: x.family).alias("families"),
        F.transform("best", lambda x: x.paragraph).alias("paragraphs"),
    )


@query
def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge(docs, measures=quality.MEASURES)
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept")


@query
def op10_multiprobe_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    base, head = conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4
    return prefix_trie.build(table(spark, sf_dir, "conversations"), base, head)


@query
def op12_incremental_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), order)


@query
def op13_levelled_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return line_runs.deduplicate(docs).select("doc_id", "n_lines", "n_dropped", kept)


ORACLES["op4_suffix_automaton_dedup"] = oracles.SUBSTRINGS
ORACLES["op9_quality_cascade"] = oracles.QUALITY
ORACLES["op13_levelled_line_runs"] = oracles.LINES
ORACLES["op12_incremental_centroids"] = oracles.CENTROIDS
ORACLES["op11_prefix_trie"] = oracles.TRIE
