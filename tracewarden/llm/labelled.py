"""Labelled samples and held-out marks that the two classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether crc32 of the id as text, modulo ``folds``, is 0; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label): at most ``most`` labelled documents that aren't held out, chosen by a hash of the id.

    The sample's ids are of bounded size, so they are broadcast and the documents are not shuffled. An id
    that is labelled more than once counts as 1 if any of its labels is 1; of documents with equal ids, the
    smallest text counts, so the sample never has more rows than ids.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().filter(~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def calibrated(evidence: np.ndarray, labels: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights and offset of a logistic curve from evidence to labels (Platt's targets), by Newton steps."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.hstack([evidence, np.ones((len(evidence), 1))])
    w, damp = np.zeros(x.shape[1]), ridge * np.ones(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (p - target) + damp * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(damp)
        step = np.linalg.solve(curve, grad)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
