import numpy as np
from pyspark.sql import functions as F

from pagetables.llm import mixing
from pagetables.llm.linear import Logistic

NAMES = ("quality", "toxic")


def frame_of(spark, tokens, p):
    rows = [(int(t), [float(x) for x in row]) for t, row in zip(tokens, p)]
    return spark.createDataFrame(rows, "n_tokens bigint, posterior array<double>")


def test_rates_match_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.2, 0.3, 0.5], 400)
    tokens = rng.integers(1, 900, 400)
    goal = np.array([0.5, 0.3, 0.2]) * tokens.sum()
    fit = mixing.fit_rates(frame_of(spark, tokens, p), 3, lambda present: goal)
    rates, _ = mixing.rates_after(p, fit.steps)
    assert (rates >= 0).all()
    assert np.abs((p * (rates * tokens)[:, None]).sum(axis=0) - goal).sum() <= 2e-4 * goal.sum()


def test_least_squares_where_targets_cannot_be_met(spark):
    # One document in two domains by halves: the best rate is that of the mean target.
    fit = mixing.fit_rates(frame_of(spark, [10], [[0.5, 0.5]]), 2, lambda present: np.array([20.0, 0.0]))
    rate = mixing.rates_after(np.array([[0.5, 0.5]]), fit.steps)[0][0]
    assert abs(rate - 2.0) < 0.01
    # A domain that should vanish takes its documents with it, and no rate is negative.
    p = [[1.0, 0.0], [0.0, 1.0]]
    fit = mixing.fit_rates(frame_of(spark, [10, 10], p), 2, lambda present: np.array([30.0, -5.0]))
    rates = mixing.rates_after(np.array(p), fit.steps)[0]
    assert abs(rates[0] - 3) < 0.01 and rates[1] == 0


def labelled(docs_of, spark, prose):
    pairs, labels = [], []
    for i in range(400):
        toxic, low = i % 5 == 0, i % 7 == 0
        text = prose(60, i) + (" vile nasty" if toxic else "") + (" junk spam" if low else "")
        pairs.append((i, text))
        labels.append((i, int(not low), int(toxic)))
    return docs_of(pairs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy(docs_of, spark, prose):
    docs, labels = labelled(docs_of, spark, prose)
    membership = mixing.fit_membership(docs, labels.where("doc_id < 250"), NAMES)
    rows = docs.where("doc_id >= 250").join(labels, "doc_id").collect()
    p = membership.posteriors([mixing.word_features(r.text.encode())[0] for r in rows])
    # Each label for itself: few documents are toxic and of low quality.
    for part, truth in (("toxic1", [r.toxic for r in rows]), ("quality0", [1 - r.quality for r in rows])):
        share = sum(p[:, i] for i, d in enumerate(membership.domains) if part in d)
        assert np.mean((share > 0.5) == np.array(truth, dtype=bool)) > 0.9


def test_mix(docs_of, spark, prose):
    docs, labels = labelled(docs_of, spark, prose)
    docs = docs.withColumn("Rate", F.lit("clash"))
    scales = lambda domains: mixing.targets_by_scale(domains, {d: 0.1 for d in domains if d.endswith("toxic1")})
    mixed, membership, fit = mixing.mix(docs, labels, NAMES, scales, whole=True)
    rows = mixed.join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert len(rows) == 400
    assert all(r.copies == (0 if r.toxic else 1) for r in rows)
    assert np.abs(fit.reached - fit.targets).sum() <= 1e-3 * fit.targets.sum()


def test_copies_have_the_rate_as_mean(docs_of, spark, prose):
    docs, labels = labelled(docs_of, spark, prose)
    weights = lambda domains: (lambda present: 2.5 * present)
    mixed, _, _ = mixing.mix(docs, labels, NAMES, weights)
    rows = mixed.collect()
    assert all(abs(r.rate - 2.5) < 0.05 and r.copies in (2, 3) for r in rows)
    assert abs(np.mean([r.copies for r in rows]) - 2.5) < 0.1


def test_odd_rows_and_empty_tables(docs_of, spark, odd_pairs):
    labels = spark.createDataFrame([(3, 1, 0), (3, 1, 0), (4, None, 1), (999, 0, 1)], "doc_id bigint, quality int, toxic int")
    weights = lambda domains: mixing.targets_by_weight(domains, {})
    for rows in (odd_pairs, []):
        for known in (labels, labels.where("false")):
            mixed, membership, _ = mixing.mix(docs_of(rows), known, NAMES, weights)
            assert mixed.count() == len(rows)
            assert len(membership.domains) == 1


def test_logistic_gradient_reaches_separation():
    rows = [np.array([0]), np.array([1]), np.array([], dtype=int), np.array([0, 2]), np.array([1, 2])] * 5
    model = Logistic.fit(rows, np.array([0, 1, 0, 0, 1] * 5), 3, 2)
    assert (model.probabilities(rows).argmax(axis=1) == np.array([0, 1, 0, 0, 1] * 5)).all()


def test_totals_of_rounded_rates(docs_of, spark, prose):
    docs, labels = labelled(docs_of, spark, prose)
    scale = {"quality0_toxic1": 0.1, "quality1_toxic1": 0.1}
    mixed, membership, fit = mixing.mix(docs, labels, NAMES, lambda d: mixing.targets_by_scale(d, scale), whole=True)
    rows = mixed.collect()
    want = sum(r.copies * r.n_tokens * np.array(r.posterior) for r in rows)
    assert np.allclose(fit.rounded, want)
    exact = sum(r.rate * r.n_tokens * np.array(r.posterior) for r in rows)
    assert np.allclose(fit.reached, exact, rtol=1e-3, atol=1.0)


def test_a_labelled_id_gives_one_text_and_a_bounded_row(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id % 3 AS doc_id", "concat('word', id, ' other', id) AS text").repartition(6)
    long = spark.range(1).selectExpr("9 AS doc_id", "array_join(transform(sequence(1, 9000), x -> concat('w', x)), ' ') AS text")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (9, 0)], "doc_id bigint, quality int")
    seen = []
    fit = mixing.Logistic.fit
    monkeypatch.setattr(mixing.Logistic, "fit", lambda x, *rest, **named: seen.append(x) or fit(x, *rest, **named))
    first, again = (mixing.fit_membership(docs.unionByName(long), labels, ("quality",)) for _ in "ab")
    assert sorted(map(len, seen[0])) == [2, 2, 2, mixing.TRAIN_FEATURES]
    assert [x.tolist() for x in seen[0]] == [x.tolist() for x in seen[1]] and first.domains == again.domains
