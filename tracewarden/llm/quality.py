"""Quality by Bradley-Terry ranking.

A document of label 1 is preferred to one of label 0. The model gives each document a strength, linear in
its features, and the probability that one is preferred to another is the logistic function of the
difference of their strengths; pairs of labelled documents teach the weights by logistic loss on feature
differences. The strength at the quantile that cuts off the share of label 0 becomes the threshold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import common, labelled

#: Bounds of what is learnt from: labelled documents and preference pairs.
SAMPLE, PAIRS = 20_000, 200_000
#: The score of a document at the threshold.
CUT = 0.3
KNOTS = (0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98)
_KINDS = np.zeros(256, np.uint8)  # 0 other symbols
_KINDS[97:123], _KINDS[65:91], _KINDS[48:58], _KINDS[[0x20, *range(9, 14)]], _KINDS[128:], _KINDS[[ord(c) for c in ".,;:!?'\"-()"]] = 1, 2, 3, 4, 5, 6
NAMES = ("log_bytes", "symbols", "lower", "upper", "digits", "blank", "other_letters", "marks", "exclaim", "word_length", "long_words", "distinct_words", "top_word", "repeated_pairs", "distinct_lines", "words_a_line", "same_twice", "ends_symbol", "sentences")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features for each text: shares of kinds of bytes, lengths, and how much repeats."""
    n = len(offsets) - 1
    out = np.zeros((n, len(NAMES)))
    for first, last in common.slices(offsets):
        part, bounds = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        size = np.diff(bounds)
        some = np.maximum(size, 1)
        kinds = _KINDS[part]
        share = [np.diff(np.append(0, np.cumsum(kinds == k))[bounds]) / some for k in range(7)]
        mark = np.diff(np.append(0, np.cumsum(part == 33))[bounds]) / some
        starts, ends, rows = common.word_bounds(part, bounds)
        lengths = ends - starts
        words = np.diff(rows)
        many = np.maximum(words, 1)
        total = lambda x: np.diff(np.append(0, np.cumsum(x))[rows])  # noqa: B023, E731
        hashes = common.word_hashes(common.lowered(part), starts, ends)
        row_of = np.repeat(np.arange(last - first), words)
        pair = np.zeros(len(hashes), np.uint64)
        pair[1:] = common.mix(hashes[1:] ^ (hashes[:-1] * np.uint64(3)))
        inner = np.append(False, row_of[1:] == row_of[:-1]) if len(row_of) else np.zeros(0, bool)
        same = np.append(False, hashes[1:] == hashes[:-1]) & inner if len(hashes) else inner
        last_kind = kinds[ends - 1] if len(ends) else kinds[:0]
        lines = np.append(0, np.cumsum(part == 10))
        n_lines = lines[bounds[1:]] - lines[bounds[:-1]] + 1
        rates = [_repeats(row_of, hashes, last - first), _repeats(row_of[inner], pair[inner], last - first), _line_rate(part, bounds)]
        sentence = np.isin(part[ends - 1], (46, 33, 63)) if len(ends) else np.zeros(0, bool)
        columns = [np.log1p(size), *share[:1], share[1], share[2], share[3], share[4], share[5], share[6], mark, total(lengths) / many, total(lengths > 15) / many, rates[0][0], rates[0][1], 1 - rates[1][0], rates[2], np.log1p(words / n_lines), total(same) / many, total(last_kind == 0) / many, total(sentence) / many]
        out[first:last] = np.stack(columns, 1)
    return out


def _repeats(row_of: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The share of distinct values in each row, and of its most frequent one."""
    order = np.lexsort((values, row_of))
    r, v = row_of[order], values[order]
    start = np.flatnonzero(np.append(True, (v[1:] != v[:-1]) | (r[1:] != r[:-1]))) if len(v) else np.zeros(0, np.int64)
    count = np.diff(np.append(start, len(v)))
    total = np.maximum(np.bincount(row_of, minlength=n), 1)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, r[start], count)
    return np.bincount(r[start], minlength=n) / total, top / total


def _line_rate(part: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The share of distinct lines of each row."""
    cuts = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(part == 10) + 1]))
    cuts = cuts[cuts < len(part)]
    ends = np.append(cuts[1:], len(part))
    row_of = np.searchsorted(bounds, cuts, side="right") - 1
    trimmed = np.where((ends > cuts) & (part[ends - 1] == 10), ends - 1, ends) if len(cuts) else ends[:0]
    if not len(cuts):
        return np.zeros(len(bounds) - 1)
    return _repeats(row_of, common.word_hashes(part, cuts, trimmed), len(bounds) - 1)[0]


@dataclass
class Ranking:
    """Knots of each feature, weights of the expanded features, and the strength that scores ``CUT``."""

    centre: np.ndarray
    scale: np.ndarray
    knots: np.ndarray
    weights: np.ndarray
    threshold: float = 0.0

    def expanded(self, x: np.ndarray) -> np.ndarray:
        """Standardised features and their excess over each knot."""
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.hstack([z, *(np.maximum(0, z - k) for k in self.knots)])

    def strengths(self, x: np.ndarray) -> np.ndarray:
        return self.expanded(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return labelled.sigmoid(self.strengths(x) - self.threshold + np.log(CUT / (1 - CUT)))


def bradley_terry(x: np.ndarray, better: np.ndarray, worse: np.ndarray, ridge: float = 1e-3, rounds: int = 30, block: int = 8192) -> np.ndarray:
    """Weights for which the rows ``better`` of x outrank the rows ``worse``: logistic loss on feature differences, by
    Newton steps whose sums are taken over blocks of pairs."""
    w, n = np.zeros(x.shape[1]), len(better)
    for _ in range(rounds):
        grad, curve = ridge * w, ridge * np.eye(len(w))
        for k in range(0, n, block):
            d = x[better[k : k + block]] - x[worse[k : k + block]]
            p = labelled.sigmoid(d @ w)
            grad = grad - d.T @ (1 - p) / n
            curve += (d * (p * (1 - p))[:, None]).T @ d / n
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS) -> Ranking | float:
    """A ranking from features and labels, or the share of label 1 where one class is missing."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        return float(label.mean()) if len(label) else 0.0
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.clip((x - centre) / scale, -6, 6)
    ranking = Ranking(centre, scale, np.quantile(z, KNOTS, axis=0), np.zeros(0))
    wide = ranking.expanded(x)
    rng = np.random.default_rng(9)
    n = min(pairs, len(good) * len(bad), 40 * len(label))
    ranking.weights = bradley_terry(wide, rng.choice(good, n), rng.choice(bad, n))
    strength = wide @ ranking.weights
    ranking.threshold = float(np.quantile(strength, len(bad) / len(label)))
    return ranking


def _described(table: DataFrame, label: bool) -> DataFrame:
    names = ["doc_id", "label", "x"]

    def run(batches):
        for batch in batches:
            x = features(*common.utf8_buffers(batch.column(1)))
            cells = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.record_batch([batch.column(0), batch.column(2), cells], names=names)

    return table.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, label_col: str = "quality") -> Ranking | float:
    """A ranking from at most ``most`` labelled documents that aren't held out."""
    rows = _described(labelled.sample(docs, labels, label_col, most), True).orderBy("doc_id", "x").collect()  # at most ``most`` rows
    if not rows:
        return 0.0
    return fit(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows]))


def score(docs: DataFrame, ranking: Ranking | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): the quality of every whole text, 0 to 1; predicted at ``CUT``.

    A map without exchange. Null and empty texts have the features of a text without words; repeated rows
    give equal rows; a null id stays null and is not held out; other columns are not read; an empty table
    gives an empty table. With a constant in place of a ranking, that constant is every score.
    """
    texts = common.texts(docs, id_col, text_col)
    if isinstance(ranking, float):
        scored = texts.select("doc_id", F.lit(ranking).alias("score"))
    else:

        def run(batches):
            for batch in batches:
                yield pa.record_batch([batch.column(0), pa.array(ranking.scores(features(*common.utf8_buffers(batch.column(1)))))], names=["doc_id", "score"])

        scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
