"""Text quality by logistic regression over hashed word n-grams, trained online.

Features are single words and pairs, each once as written and once as its shape (capitals,
small letters, digits, marks), and any pair of equal words, hashed into a fixed number of buckets; a document's values are
damped counts of unit length. Weights come from follow-the-regularised-leader passes over a
bounded labelled sample; a score is one sparse dot product per document, over its whole text.

Cases: a null or empty text scores the intercept; unlabelled and null-labelled rows do not
train; without any label every score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugewell.llm.models import (
    BUCKET_BITS,
    SAMPLE_ROWS,
    FollowTheRegularisedLeader,
    Sparse,
    counted,
    fit,
    grams,
    sample,
    scored,
    sigmoid,
)
from gaugewell.llm.texts import Words

#: Steps over the sample in all: a small sample is passed more often, up to the last number.
STEPS, PASSES, MOST_PASSES = 40_000, 4, 60
THRESHOLD = 0.3
FOLDS = 5


def features(data: np.ndarray, offsets: np.ndarray) -> Sparse:
    words = Words(data, offsets)
    owner, names, shapes = words.documents(), words.names(), words.shapes()
    again = np.flatnonzero((names[1:] == names[:-1]) & (owner[1:] == owner[:-1]))
    parts = [grams(n, owner, size, salt) for n, salt in ((names, 1), (shapes, 2)) for size in (1, 2)]
    found = counted([*parts, (owner[again], np.zeros(len(again), np.uint64))], len(offsets) - 1)
    values = np.log1p(found.values)
    squares = np.concatenate([[0.0], np.cumsum(values * values)])
    norms = np.sqrt(squares[found.bounds[1:]] - squares[found.bounds[:-1]])
    found.values = values / np.repeat(np.where(norms > 0, norms, 1), np.diff(found.bounds))
    return found


def train(labels: np.ndarray, rows: Sparse) -> dict[str, np.ndarray]:
    size = 1 << BUCKET_BITS
    model = FollowTheRegularisedLeader(size + 1, rate=0.5, smooth=1.0, l1=0.02, l2=0.5)
    order = np.random.default_rng(7)
    for _ in range(min(MOST_PASSES, max(PASSES, STEPS // max(1, len(labels))))):
        for r in order.permutation(len(labels)).tolist():
            low, high = rows.bounds[r], rows.bounds[r + 1]
            at = np.append(rows.buckets[low:high], size)
            x = np.append(rows.values[low:high].astype(np.float64), 0.3)  # the intercept
            w = model.weights(at)
            model.learn(at, w, (sigmoid(w @ x) - labels[r]) * x)
    return {"weights": model.weights()}


def fold(id_: Column) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % FOLDS


def quality_scores(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS,
    threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: id, held_out (never trained on), score, predicted."""
    drawn = sample(docs, labels.where(fold(F.col(id_col)) != 0), label, sample_rows, id_col, text_col)
    weights = fit(drawn, features, train).get("weights", np.zeros((1 << BUCKET_BITS) + 1)).astype(np.float32)

    def values(rows: Sparse) -> dict[str, np.ndarray]:
        return {"score": sigmoid(rows.dot(weights) + 0.3 * float(weights[-1]))}

    found = scored(docs, features, values, "score double", id_col, text_col)
    return found.select(
        id_col, (fold(F.col(id_col)) == 0).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
