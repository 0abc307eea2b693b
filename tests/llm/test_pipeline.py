import pytest

import corpus_pipeline
from pagetables.llm import queries


@pytest.fixture
def small(spark, docs_of, odd_pairs, prose, tmp_path):
    clean = [(100 + i, prose(40 + i, i)) for i in range(120)]
    toxic = [(300 + i, prose(40, 500 + i) + " vile nasty creature") for i in range(30)]
    copies = [(400 + i, clean[i][1]) for i in range(5)]
    shared = prose(80, "shared")
    passages = [(500 + i, f"{prose(60, 700 + i)} {shared} {prose(10, 800 + i)}") for i in range(3)]
    docs_of(odd_pairs + clean + toxic + copies + passages).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i, _ in clean] + [(i, 1, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        found = stage(spark, docs, small)
        if k < 4:
            assert found.columns == docs.columns
        found.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    clean = set(range(100, 220))
    assert clean <= ids["quality_rules"] and 0 not in ids["quality_rules"] and 10 not in ids["quality_rules"]
    assert clean <= ids["near_duplicates"] and not ids["near_duplicates"] & set(range(400, 405))
    texts = {r.doc_id: r.text for r in kept["repeated_passages"]}
    assert len(texts[500].split()) == 150 and len(texts[501].split()) == 70 == len(texts[502].split())
    assert ids["mixture"] & set(range(300, 330)) == set() and clean <= ids["mixture"]
    assert {r.doc_id for r in kept["packed_sequences"]} == ids["mixture"]


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_empty_documents(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
