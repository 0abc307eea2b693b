import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pagetables.llm import line_runs as L

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(LOW)


def brute(pairs, min_documents=5):
    held = {}
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(-1 if i is None else i)
    out = []
    for i, t in pairs:
        lines, own = (t or "").split("\n"), -1 if i is None else i
        kept = [x for x in lines if len(held.get(key(x), ())) < min_documents or max(held[key(x)]) == own]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def mine(frame):
    return sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in frame.collect()], key=repr)


def corpus(n, seed=0):
    """Documents with lines of their own and lines that from one to all documents share."""
    rng = random.Random(seed)
    shared = [f"Shared line {i} É é ß İ with enough characters to be a key of its own" for i in range(40)]
    out = []
    for i in range(n):
        lines = [f"only in document {i}, line {j}, and long enough to be a key" for j in range(rng.randint(0, 4))]
        lines += [shared[0], "short"] + [shared[int(40 * rng.random() ** 2)] for _ in range(rng.randint(0, 6))]
        lines += [rng.choice([" \t{}\x0b ", "{}"]).format(rng.choice(shared).swapcase()) for _ in range(2)]
        rng.shuffle(lines)
        out.append((i, "\n".join(lines)))
    return out


@pytest.mark.parametrize("batches,fan", [(8, 4), (1, 4), (9, 2)])
def test_against_brute_force(spark, docs_of, batches, fan):
    pairs = corpus(150)
    assert mine(L.deduplicate(docs_of(pairs), batches=batches, fan=fan)) == brute(pairs)


def test_odd_rows(spark, docs_of, odd_pairs):
    line = "a line that stands in very many of the documents"
    pairs = odd_pairs + [(20 + i, f"{line}\n\n{line.upper()}\nend {i}") for i in range(6)]
    pairs += [(25, f"{line}\nother text under an id that is taken"), (25, f"{line}\nother text under an id that is taken")]
    pairs += [(None, line), (None, line + " "), (30, "\n" * 5), (31, (line + "\n") * 3000)]
    frame = docs_of(pairs).withColumn("N_lines", F.lit("clash")).withColumn("hash", F.lit("x")).withColumn("owner", F.lit(1))
    found = L.deduplicate(frame)
    assert {"hash", "owner", "n_lines"} <= set(found.columns)
    assert mine(found) == brute(pairs)


def test_empty_and_all_null(spark, docs_of):
    assert L.deduplicate(docs_of([])).count() == 0
    assert mine(L.deduplicate(docs_of([(1, None), (2, None)]))) == [(1, 1, 0, ""), (2, 1, 0, "")]


def test_keys_differ_where_their_characters_do(spark):
    rows = ["É" * 40, "é" * 40, "K" * 40, "k" * 40, "K" * 40, "Â" * 40, "ñÑ" * 20, "Ññ" * 20, "₂" * 40, "Ⴀ" * 40, "𐐀" * 40, "𐐨" * 40]
    frame = spark.createDataFrame([(r,) for r in rows], "text string")
    found = [r[0][0] for r in frame.select(L.line_hashes(F.col("text"))).collect()]
    forms = {}
    for r, h in zip(rows, found, strict=True):
        forms.setdefault(key(r), set()).add(bytes(h))
    assert all(len(h) == 1 for h in forms.values()) and len(set().union(*forms.values())) == len(forms)


def test_runs_are_levelled_and_not_shuffled(spark):
    runs = L.LineRuns(spark, fan=2)
    batch = lambda a, b: spark.range(a, b).select(F.unhex(F.md5(F.col("id").cast("string"))).alias("hash"), F.lit(1).alias("owner"), F.lit(1).alias("n"))
    sizes = []
    for k in range(5):
        assert runs.add(batch(50 * k, 50 * k + 100)).count() == (50 if k else 0)
        sizes.append([len(level) for level in runs.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1]]
    assert sum(r.count() for r in runs.runs()) == 300
    own, run = spark.table(runs.tables[-2]), runs.runs()[0]
    plan = own.join(run.select("hash").hint("merge"), "hash", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    runs.drop()


def test_query_agrees_with_its_text(spark, docs_of, tmp_path):
    from pagetables.llm import queries

    pairs = corpus(60, 3)
    docs_of(pairs).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op13_levelled_line_runs(spark, str(tmp_path)).collect()
    want = {i: (n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(pairs)}
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in rows} == want
