"""Mixing by soft membership.

A classifier trained on a table of labelled documents gives every document a posterior
over domains (the combinations of labels). Each document then gets a rate of at least
zero, such that the expected tokens of each domain, summed over the corpus at these
rates, match given targets in the least-squares sense.

The rates come from projected gradients with momentum: all start at one; in each round the
executors sum up the domain totals at the present rates, and every document moves
against the gradient and back to zero if below. Distances are measured in the metric of
the corpus' own domain moments and a document's step is scaled by its tokens, so the
step size is one and a round without a rate at zero already solves the problem. A rate
depends on the posterior alone, so the history of the K-component steps, which is all
the driver holds, restores every rate without a join.

The classifier is fitted on at most ``TRAIN_ROWS`` labelled documents, one text of each id and
at most ``TRAIN_FEATURES`` distinct words of a text; posteriors, totals and rates cover all
documents and all words.

Null and empty texts have no tokens; their rate follows their posterior, as for any
document; very long ones are read whole. An empty table gives no rows. Labelled ids without a document are left out, as are labels that are null. A
document labelled twice counts twice. With no labelled documents there is one domain, ``all``.
Rows alike get equal rates. Input columns named like output columns are replaced.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, sampled, split_words, stored, without
from .linear import Logistic

TRAIN_ROWS = 6000
TRAIN_FEATURES = 2048
FEATURES = 1 << 18
# A feature must stand in so many of the labelled documents.
MIN_DOCS = 4
# Marks around a word that are no part of it.
MARKS = b".,!?;:%$*#&\"'()"
ROUNDS = 100
CLOSE = 1e-4


def word_features(raw: bytes | None) -> tuple[np.ndarray, int]:
    """Numbers of the distinct words without marks, and how many words there are."""
    words = split_words(raw.lower()) if raw else []
    distinct = {w.strip(MARKS) for w in set(words)}
    found = np.fromiter(map(zlib.crc32, distinct), np.int64, len(distinct))
    return np.unique(found % FEATURES), len(words)


@dataclass
class Membership:
    """Domains and the classifier that tells them apart (none if there is one domain)."""

    domains: list[str]
    model: Logistic | None

    def posteriors(self, rows: list[np.ndarray]) -> np.ndarray:
        if self.model is None:
            return np.ones((len(rows), 1))
        # A few documents at a time: their features' weights are gathered at once.
        parts = [self.model.probabilities(rows[i : i + 64]) for i in range(0, len(rows), 64)]
        return np.concatenate(parts) if parts else np.empty((0, len(self.domains)))


def fit_membership(
    docs: DataFrame, labels: DataFrame, names: tuple[str, ...], doc_id: str = "doc_id", text: str = "text", train_rows: int = TRAIN_ROWS
) -> Membership:
    """The classifier for the combinations of the label columns ``names``, fitted on the
    ``train_rows`` labelled documents whose ids hash lowest."""
    domain = F.concat_ws("_", *[F.concat(F.lit(n), F.col(n).cast("string")) for n in names])
    known = labels.where(" and ".join(f"{n} is not null" for n in names)).select(
        F.col("doc_id").alias("_id"), domain.alias("domain")
    )
    known = sampled(known, F.struct("_id", "domain"), train_rows)

    def features(texts: pa.Array) -> pa.Array:
        # The numbers are hashes: the lowest are a sample that long texts share.
        return pa.array([word_features(r)[0][:TRAIN_FEATURES] for r in raw_texts(texts)], pa.list_(pa.int32()))

    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text"))
    # At most train_rows ids; of the texts of an id there is one, the one whose hash is lowest.
    one = F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("t")))
    chosen = texts.join(F.broadcast(known), "_id").groupBy("_id", "domain").agg(one.alias("one"))
    rows = chosen.select("domain", F.arrow_udf(features, "array<int>").asNondeterministic()("one.t").alias("f")).collect()
    domains = sorted({r.domain for r in rows})
    if len(domains) < 2:
        return Membership(domains or ["all"], None)
    rows.sort(key=lambda r: (r.domain, r.f))
    number = {d: i for i, d in enumerate(domains)}
    x = [np.array(r.f, dtype=np.int64) for r in rows]
    y = np.array([number[r.domain] for r in rows])
    if len(x) > 100 * MIN_DOCS:
        frequent = np.bincount(np.concatenate(x), minlength=FEATURES) >= MIN_DOCS
        x = [f[frequent[f]] for f in x]
    return Membership(domains, Logistic.fit(x, y, FEATURES, len(domains), penalty=3e-3, rounds=160))


def with_posteriors(docs: DataFrame, membership: Membership, text: str = "text") -> DataFrame:
    """The documents with ``n_tokens`` (words) and ``posterior`` (array by domain)."""
    shared = docs.sparkSession.sparkContext.broadcast(membership)

    def of(texts: pa.Array) -> pa.Array:
        found = [word_features(r) for r in raw_texts(texts)]
        p = shared.value.posteriors([f[0] for f in found])
        kind = pa.struct([("n_tokens", pa.int64()), ("posterior", pa.list_(pa.float64()))])
        return pa.array([{"n_tokens": n, "posterior": row} for (_, n), row in zip(found, p)], kind)

    own = without(docs, "_m", "n_tokens", "posterior", "rate", "copies")
    seen = F.arrow_udf(of, "struct<n_tokens: bigint, posterior: array<double>>").asNondeterministic()
    marked = own.withColumn("_m", seen(F.col(text).cast("string")))
    return marked.select(*[F.col(f"`{c}`") for c in own.columns], "_m.n_tokens", "_m.posterior")


def _table(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    tokens = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
    return tokens, batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def rates_after(posteriors: np.ndarray, steps: list[tuple[np.ndarray, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the steps (gradient step, momentum), and where the next step starts."""
    rates = start = np.ones(len(posteriors))
    for step, momentum in steps:
        before, rates = rates, np.maximum(start - posteriors @ step, 0.0)
        start = rates + momentum * (rates - before)
    return rates, start


@dataclass
class Fit:
    """Steps of the projected gradient with their momentum; domain totals before and
    after, and targets; where rates are rounded to whole numbers, the totals of these."""

    steps: list[tuple[np.ndarray, float]]
    present: np.ndarray
    reached: np.ndarray
    targets: np.ndarray
    rounded: np.ndarray | None = None


def sums(rows: DataFrame, k: int, size: int, of) -> np.ndarray:
    """Sums of the ``size`` numbers that ``of`` makes of tokens and posteriors."""

    def partial(batches):
        out = np.zeros(size)
        for batch in batches:
            out += of(*_table(batch, k)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["t"])

    parts = rows.select("n_tokens", "posterior").mapInArrow(partial, "t array<double>")
    out = np.zeros(size)
    for r in parts.select(F.posexplode("t").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out


def rounded_totals(rows: DataFrame, k: int, fit: Fit) -> np.ndarray:
    """Domain totals of rows (n_tokens, posterior) at rates rounded to the nearest whole
    number, in one aggregation."""
    steps = fit.steps
    return sums(rows, k, k, lambda tokens, p: (np.floor(rates_after(p, steps)[0] + 0.5) * tokens) @ p)


def fit_rates(rows: DataFrame, k: int, targets, rounds: int = ROUNDS, close: float = CLOSE) -> Fit:
    """Steps for rows (n_tokens, posterior). ``targets`` makes the target totals from the
    present ones. Every round is one aggregation of 2 K numbers."""

    def summed(size: int, of) -> np.ndarray:
        return sums(rows, k, size, of)

    moments = summed(k * k, lambda tokens, p: (p * tokens[:, None]).T @ p).reshape(k, k)
    present = moments.sum(axis=1)
    goal = np.asarray(targets(present), dtype=float)
    metric = np.linalg.pinv(moments, rcond=1e-9)
    enough = close * max(1.0, np.abs(goal).sum())
    steps: list[tuple[np.ndarray, float]] = []
    reached = start = present
    pace, error = 1.0, np.inf
    for _ in range(rounds):
        miss = start - goal
        if np.abs(reached - goal).sum() <= enough:
            break
        now = float(miss @ metric @ miss)
        # Momentum that leads uphill is dropped.
        pace = 1.0 if now > error else pace
        error, faster = now, (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        steps.append((metric @ miss, (pace - 1) / faster))
        pace = faster
        own = list(steps)
        totals = summed(2 * k, lambda tokens, p: np.stack(rates_after(p, own)) @ (p * tokens[:, None]))
        moved = np.abs(totals[:k] - reached).sum()
        reached, start = totals[:k], totals[k:]
        if moved <= 0.01 * enough:
            break
    return Fit(steps, present, reached, goal)


def rate_of(fit: Fit, posterior: Column) -> Column:
    k = len(fit.present)

    def of(posteriors: pa.Array) -> pa.Array:
        p = posteriors.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
        return pa.array(rates_after(p, fit.steps)[0])

    return F.arrow_udf(of, "double").asNondeterministic()(posterior)


def targets_by_weight(domains: list[str], weights: dict[str, float]):
    """Targets that share out the present tokens by weights."""
    w = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    if not w.sum():
        w = np.ones(len(domains))
    return lambda present: present.sum() * w / w.sum()


def targets_by_scale(domains: list[str], scales: dict[str, float]):
    """Targets that are multiples of the present totals, 1 unless given."""
    s = np.array([scales.get(d, 1.0) for d in domains])
    return lambda present: present * s


def mix(
    docs: DataFrame,
    labels: DataFrame,
    names: tuple[str, ...],
    targets,
    doc_id: str = "doc_id",
    text: str = "text",
    train_rows: int = TRAIN_ROWS,
    whole: bool = False,
) -> tuple[DataFrame, Membership, Fit]:
    """The documents with n_tokens, posterior, rate and copies. ``targets`` is a function
    of (domains) that makes a function of the present totals.

    ``copies`` is the rate rounded up or down by a hash of the document, such that the
    expectation is the rate; with ``whole`` it is the nearest whole number, whose totals
    miss the targets: ``rounded`` of the fit has them."""
    membership = fit_membership(docs, labels, names, doc_id, text, train_rows)
    marked = with_posteriors(docs, membership, text)
    small = stored(marked.select("n_tokens", "posterior"), "posteriors")
    fit = fit_rates(small, len(membership.domains), targets(membership.domains))
    if whole:
        fit.rounded = rounded_totals(small, len(membership.domains), fit)
    rated = marked.withColumn("rate", rate_of(fit, F.col("posterior")))
    chance = F.pmod(F.xxhash64(F.lit("copies"), F.col(doc_id), F.col(text).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    up = F.lit(0.5) if whole else chance
    return rated.withColumn("copies", F.floor(F.col("rate") + up).cast("int")), membership, fit
