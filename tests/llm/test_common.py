from pyspark.sql import functions as F

from pagetables.llm import common


def texts(spark, rows):
    return spark.createDataFrame([(t,) for t in rows], "t string")


def test_sample_holds_distinct_texts(spark):
    # Thousands of copies of each of a few texts, and others.
    rows = [f"copied {i % 3}" for i in range(6000)] + [f"own {i}" for i in range(500)]
    found = [r.t for r in common.sampled(texts(spark, rows), F.col("t"), 100).collect()]
    assert len(found) == 100 == len(set(found))


def test_sample_of_few_texts_is_not_empty(spark):
    for name in "abcdefgh":
        found = [r.t for r in common.sampled(texts(spark, [name] * 500), F.col("t"), 10).collect()]
        assert found == [name]


def test_sample_has_the_lowest_hashes(spark):
    rows = texts(spark, [f"text {i}" for i in range(1000)])
    order = rows.orderBy(F.pmod(F.xxhash64("t"), F.lit(1 << 40))).limit(20)
    assert {r.t for r in common.sampled(rows, F.col("t"), 20).collect()} == {r.t for r in order.collect()}
    assert common.sampled(rows.limit(0), F.col("t"), 20).count() == 0
