"""Severity of toxic language by cumulative-link ordinal regression.

P(grade > k) = logistic(w.x - theta_k): one weight per hashed word and beginning of a word that
occurs in the document, shared by all ordered thresholds. The expected severity is the sum of
these probabilities. Where labels only say yes or no, the marked documents of the sample are
graded first: features that are far more frequent among marked documents are looked up, and
the marked documents are divided at the thirds of how many of these they hold.

Cases: a null or empty text gets the severity of no features; unlabelled rows do not train;
with no label at all every severity is 0; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.models import (
    FollowTheRegularisedLeader,
    Sparse,
    counted,
    fit,
    grams,
    sample,
    scored,
    sigmoid,
)
from gaugewell.llm.texts import LOWER, NO_LETTER, Words, annotate

#: Steps over the sample in all: a small sample is passed more often, up to the last number.
STEPS, PASSES, MOST_PASSES = 60_000, 5, 60
BUCKET_BITS = 20
#: Labelled rows that the model is fitted on, at most; everything else covers all rows.
SAMPLE_ROWS = 16_000
#: A feature needs as many sampled documents as one in so many, and three at least.
SUPPORT_SHARE = 600
GRADES = 4
#: Beginnings of longer words count as features too, so that derived words of the same stem are known. In bytes:
#: four of them are two letters in some scripts, and common to many stems.
PREFIXES = (4, 6, 8)
#: A document is toxic if a grade above the lowest is at least this likely.
THRESHOLD = 0.25


def features(data: np.ndarray, offsets: np.ndarray) -> Sparse:
    words = Words(LOWER[data], offsets, NO_LETTER)
    owner, names, size = words.documents(), words.names(), words.ends - words.starts
    longer = [(n, size > n) for n in PREFIXES]
    parts = [grams(names, owner, 1, 1), *(grams(words.prefixes(n)[more], owner[more], 1, n) for n, more in longer)]
    found = counted(parts, len(offsets) - 1, BUCKET_BITS)
    found.values = np.ones(len(found.buckets))
    return found


def supported(rows: Sparse) -> Sparse:
    """Without the features of too few documents, which would only learn these by heart."""
    often = rows.counts(np.ones(len(rows.bounds) - 1, bool), 1 << BUCKET_BITS) >= max(3, (len(rows.bounds) - 1) // SUPPORT_SHARE)
    keep, edges = often[rows.buckets], rows.bounds.tolist()
    left = [int(np.count_nonzero(keep[a:b])) for a, b in zip(edges[:-1], edges[1:])]
    return Sparse(np.concatenate([[0], np.cumsum(left, dtype=np.int64)]), rows.buckets[keep], rows.values[keep])


def grades(labels: np.ndarray, rows: Sparse, levels: int) -> np.ndarray:
    """Ordered grades: as labelled, or yes divided by the frequency of telling words.

    Labels of yes and no know one border only, that of any grade above 0. The borders above it come from words that
    tell marked rows from others; a row's words are judged by the other half of the rows, so that none grades itself.
    """
    if len(labels) and labels.max() > 1:
        return np.minimum(labels, levels - 1)
    size, amount = 1 << BUCKET_BITS, np.zeros(len(labels))
    drawn = np.random.default_rng(5).integers(0, 2, len(labels))
    for half in (0, 1):
        others = drawn != half
        inside = rows.counts(others & (labels > 0), size)
        outside = rows.counts(others & (labels <= 0), size)
        yes, no = max(1, int((others & (labels > 0)).sum())), max(1, int((others & (labels <= 0)).sum()))
        telling = (inside >= 3) & (inside / yes > 8 * (outside + 1) / no)
        for a, b in rows.parts():
            owner = np.repeat(np.arange(b - a), np.diff(rows.bounds[a:b + 1]))
            held = np.bincount(owner[telling[rows.buckets[rows.bounds[a]:rows.bounds[b]]]], minlength=b - a)
            amount[a:b] += np.where(others[a:b], 0, held)
    cuts = np.quantile(amount[labels > 0], np.arange(1, levels - 1) / (levels - 1)) if (labels > 0).any() else []
    return np.where(labels > 0, 1 + np.searchsorted(cuts, amount, "left"), 0)


def train(labels: np.ndarray, rows: Sparse) -> dict[str, np.ndarray]:
    rows = supported(rows)
    grade = grades(labels, rows, GRADES)
    penalty = 4.0 * np.sqrt(len(labels) / 12_000)
    model = FollowTheRegularisedLeader(1 << BUCKET_BITS, rate=0.5, smooth=1.0, l1=penalty, l2=0.01)
    theta = np.linspace(1.0, 4.0, GRADES - 1)
    seen = np.full(GRADES - 1, 1.0)
    order = np.random.default_rng(11)
    for _ in range(min(MOST_PASSES, max(PASSES, STEPS // max(1, len(labels))))):
        for r in order.permutation(len(grade)).tolist():
            low, high = rows.bounds[r], rows.bounds[r + 1]
            at, x, y = rows.buckets[low:high], rows.values[low:high].astype(np.float64), grade[r]
            w = model.weights(at)
            over = sigmoid(w @ x - theta)
            above = 1.0 if y == 0 else over[y - 1]  # P(grade >= y)
            beyond = 0.0 if y == GRADES - 1 else over[y]  # P(grade > y)
            model.learn(at, w, (above + beyond - 1.0) * x)
            chance, slope = max(above - beyond, 1e-9), np.zeros(GRADES - 1)
            if y > 0:
                slope[y - 1] = above * (1 - above) / chance
            if y < GRADES - 1:
                slope[y] = -beyond * (1 - beyond) / chance
            seen += slope * slope
            theta = np.maximum.accumulate(theta - 0.3 * slope / np.sqrt(seen) + 1e-4 * np.arange(GRADES - 1))
    return {"weights": model.weights(), "theta": theta}


def _scores(docs: DataFrame, labels: DataFrame, label: str, sample_rows: int, id_col: str, text_col: str):
    """Fit the model; the function from features to the scores."""
    model = fit(sample(docs, labels, label, sample_rows, id_col, text_col), features, train)
    weights = model.get("weights", np.zeros(1 << BUCKET_BITS)).astype(np.float32)
    theta = model.get("theta", np.full(GRADES - 1, np.inf))

    def values(rows: Sparse) -> dict[str, np.ndarray]:
        over = sigmoid(rows.dot(weights)[:, None] - theta)
        edges = np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], axis=1)
        return {"severity": over.sum(axis=1), "grade": (edges[:, :-1] - edges[:, 1:]).argmax(axis=1).astype(np.int32),
                "probability": over[:, 0]}
    return values


def toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
    threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: id, severity (expected grade), grade (likeliest), probability (of any grade above 0), toxic."""
    values = _scores(docs, labels, label, sample_rows, id_col, text_col)
    found = scored(docs, features, values, "severity double, grade int, probability double", id_col, text_col)
    return found.withColumn("toxic", F.col("probability") >= threshold)


def drop_toxic(
    docs: DataFrame, labelled: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS,
    threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that are not toxic by the model of the labelled documents."""
    values = _scores(labelled, labels, label, sample_rows, id_col, text_col)
    rows, given = annotate(
        docs, lambda data, offsets: {"__probability": values(features(data, offsets))["probability"]},
        "__probability double", text_col)
    return rows.where(F.col("__probability") < threshold).select(*given)
