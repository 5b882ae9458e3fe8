"""Toxicity by a subsequence string kernel with Nyström landmarks and a support vector machine, trained on labelled sentences.

The kernel of two words compares their subsequences of four letters (a mark before the first letter counts
as one), each weighted by LAMBDA to the length that it spans (gaps included, up to SPAN letters): inserted
or missing characters lower a match instead of ending it. Landmark words span the kernel's space (Nyström).

A training row is a labelled sentence (the text of a document): the mean, in that space, of its few strongest words (WITNESSES), so
the kernel of two sentences is the mean of the kernels of their strongest words. Which words are the strongest is a matter of
the machine itself: it starts from the likeness to the landmarks of toxic sentences, and each round trains a linear machine with squared
hinge loss on all sentences, those of clean ones being what it most wrongly takes for toxic, and chooses again (a
multiple-instance machine). A text is then judged by its strongest words and by how many there are.

The machine's weights over landmarks are sums over letter subsequences, so they are folded into one weight for
each, and scoring a word needs no kernel value: the machine is the same, the sum is only reordered.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import common, labelled

LAMBDA, SPAN, WIDTH, STRIDE = 0.6, 6, 16, 8
#: What is learnt from: at most so many labelled documents and landmark words, half of them from toxic sentences.
SAMPLE, LANDMARKS = 20_000, 240
#: Words of a sentence in its training row, rounds of training, and cost of a clean sentence on the wrong side: the best of SETTINGS by ``choose``.
WITNESSES, ROUNDS, COST = 2, 3, 0.1
#: What ``choose`` compares.
SETTINGS = [{"witnesses": w, "rounds": 3, "cost": c} for w, c in ((2, 0.1), (2, 0.3), (2, 1.0), (1, 0.3))]
_A, _MARK, _TOP = 32, 31, 5
_SLICE = 1 << 20

_CODES = np.zeros(256, np.uint8)
_CODES[97:123] = np.arange(1, 27)
_CODES[128:192] = 27 + np.arange(64) % 4  # the last byte of other letters


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all words, the words' starts in them and the end, each row's first word, and word hashes.

    Case is ignored, and everything but letters is left out of a word, so "i.d.i.o.t" is one word; single letters
    in a row are joined, so "i d i o t" is one too.
    """
    data = common.lowered(data)
    starts, ends, rows = common.word_bounds(data, offsets)
    codes = _CODES[data]
    count = np.append(0, np.cumsum(codes > 0))
    sizes = count[ends] - count[starts]
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    single = sizes == 1
    joined = np.zeros(len(sizes), bool)
    if len(sizes) > 1:
        joined[1:] = single[1:] & single[:-1] & (row_of[1:] == row_of[:-1])
    first = np.flatnonzero(~joined)
    letters = codes[codes > 0]
    bounds = np.append(count[starts][first], count[-1]) if len(first) else np.zeros(1, np.int64)
    hashes = common.word_hashes(letters, bounds[:-1], bounds[1:]) if len(first) else np.zeros(0, np.uint64)
    return letters, bounds, np.append(0, np.cumsum(~joined))[rows], hashes


def windows(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of WIDTH codes (0: none) that cover each word with a mark before it, longer words by overlapping rows, and each word's first row."""
    sizes = ends - starts + 1
    n = 1 + np.maximum(0, -(-(sizes - WIDTH) // STRIDE))
    first = np.cumsum(n) - n
    word = np.repeat(np.arange(len(n)), n)
    at = starts[word] + (np.arange(len(word)) - first[word]) * STRIDE - 1
    place = at[:, None] + np.arange(WIDTH)
    padded = np.append(letters, 0)
    rows = np.where(place < ends[word][:, None], padded[np.minimum(place, len(letters))], 0).astype(np.int32)
    rows[first, 0] = _MARK
    return rows, first


_NORMS = np.array([0.0] + [sum((n - d) * (d - 1) * (d - 2) / 2 * LAMBDA ** (2 * (d + 1)) for d in range(3, min(SPAN, n))) for n in range(1, WIDTH + 1)])
_SCALE = np.where(_NORMS > 0, 1 / np.sqrt(np.where(_NORMS > 0, _NORMS, 1)), 0.0)


def _grams(rows: np.ndarray):
    """(weight, index of the subsequence of four letters, or of one with a 0 in it) of all spans."""
    pairs = {d: rows[:, : WIDTH - d] * _A + rows[:, d:] for d in range(1, SPAN - 2)}
    for d3 in range(3, SPAN):
        n = WIDTH - d3
        for d1 in range(1, d3 - 1):
            for d2 in range(d1 + 1, d3):
                yield LAMBDA ** (d3 + 1), pairs[d1][:, :n] * (_A * _A) + pairs[d3 - d2][:, d2 : d2 + n]


def row_values(rows: np.ndarray, weights: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Sum of the subsequences' weights in each row, scaled by the row's norm (that of a row of its length without repeats)."""
    out = np.zeros(len(rows))
    for k in range(0, len(rows), block):
        some = rows[k : k + block]
        total = np.zeros(len(some), np.float32)
        for factor, index in _grams(some):
            total += weights[index].sum(1) * np.float32(factor)
        out[k : k + block] = total * _SCALE[(some > 0).sum(1)]
    return out


def grams_of(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct subsequences of one row and their scaled weights."""
    parts = [(index.ravel(), np.full(index.size, factor)) for factor, index in _grams(row[None])]
    index, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    whole = (index >= _A**3) & (index // _A**2 % _A > 0) & (index // _A % _A > 0) & (index % _A > 0)
    index, back = np.unique(index[whole], return_inverse=True)
    return index, np.bincount(back, weight[whole], len(index)) * _SCALE[(row > 0).sum()]


def kernel(rows: np.ndarray, marks: np.ndarray, block: int = 1 << 13) -> np.ndarray:
    """The kernel of every row with every landmark."""
    grams = [grams_of(m) for m in marks]
    known = np.unique(np.concatenate([g for g, _ in grams]))
    number = np.full(_A**4, -1, np.int32)
    number[known] = np.arange(len(known))
    weights = np.zeros((len(known), len(marks)), np.float32)
    for k, (index, weight) in enumerate(grams):
        weights[number[index], k] = weight
    out = np.zeros((len(rows), len(marks)), np.float32)
    for k in range(0, len(rows), block):
        some = rows[k : k + block]
        for factor, index in _grams(some):
            found = number[index]
            for j in range(found.shape[1]):
                hit = np.flatnonzero(found[:, j] >= 0)
                out[k + hit] += np.float32(factor) * weights[found[hit, j]]
        out[k : k + block] *= _SCALE[(some > 0).sum(1)][:, None].astype(np.float32)
    return out


def folded(marks: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    """One table with the sum of the landmarks' weights, each times its amount."""
    table = np.zeros(_A**4)
    for mark, amount in zip(marks, amounts, strict=True):
        index, weight = grams_of(mark)
        table[index] += amount * weight
    return table.astype(np.float32)


@dataclass
class Machine:
    """Weights of the letter subsequences, the offset, and the curve from what a text's words say to its score."""

    weights: np.ndarray
    offset: float
    curve: np.ndarray | None = None

    def evidence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each row: its largest word margin, the mean of its _TOP largest, the log of the number of words with
        a positive margin, and their share. A row without letters has the machine's offset as its margins."""
        out = np.zeros((len(offsets) - 1, 4))
        out[:, :2] = min(self.offset, -1.0)
        for first, last in common.slices(offsets, _SLICE):
            letters, bounds, rows, hashes = words_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            if not len(hashes):
                continue
            _, index, back = np.unique(hashes, return_index=True, return_inverse=True)
            cells, begin = windows(letters, bounds[:-1][index], bounds[1:][index])
            value = (np.maximum.reduceat(row_values(cells, self.weights), begin) + self.offset)[back]
            count = np.diff(rows)
            row_of = np.repeat(np.arange(len(count)), count)
            order = np.lexsort((-value, row_of))
            place = np.arange(len(order)) - rows[row_of[order]]
            top = order[place < _TOP]
            some = np.flatnonzero(count)
            mean = np.bincount(row_of[top], value[top], len(count))[some] / np.minimum(count[some], _TOP)
            high = np.bincount(row_of, value > 0, len(count))[some]
            out[first + some] = np.stack([value[order[rows[:-1][some]]], mean, np.log1p(high), high / count[some]], 1)
        return out

    def scores(self, evidence: np.ndarray) -> np.ndarray:
        return labelled.sigmoid(np.hstack([evidence, np.ones((len(evidence), 1))]) @ self.curve)


def strongest(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, most: int = WITNESSES) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` different words of each row with the largest values (ties by the words' hashes): (row, the WIDTH codes
    of the word's strongest stretch). Words too short for evidence are left out."""
    found = [(np.zeros(0, np.int64), np.zeros((0, WIDTH), np.int32))]
    for first, last in common.slices(offsets, _SLICE):
        letters, bounds, rows, hashes = words_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        if not len(hashes):
            continue
        _, index, back = np.unique(hashes, return_index=True, return_inverse=True)
        cells, begin = windows(letters, bounds[:-1][index], bounds[1:][index])
        value = row_values(cells, weights)
        best = np.maximum.reduceat(value, begin)
        word = np.repeat(np.arange(len(index)), np.diff(np.append(begin, len(cells))))
        at = np.flatnonzero(value == best[word])
        at = at[np.unique(word[at], return_index=True)[1]]  # of each word, its first strongest stretch
        row_of = np.repeat(np.arange(last - first), np.diff(rows))
        pairs = np.unique(row_of * len(index) + back)
        row, word = pairs // len(index), pairs % len(index)
        full = (cells[at[word]] > 0).sum(1) > 3
        row, word = row[full], word[full]
        order = np.lexsort((word, -best[word], row))
        row, word = row[order], word[order]
        top = np.arange(len(row)) - np.searchsorted(row, row) < most
        found.append((row[top] + first, cells[at[word[top]]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def sentence_rows(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, marks: np.ndarray, root: np.ndarray, most: int = WITNESSES) -> np.ndarray:
    """The training row of each sentence: the mean of its strongest words in the landmarks' space; 0 without words."""
    row, cells = strongest(data, offsets, weights, most)
    out = np.zeros((len(offsets) - 1, root.shape[1]), np.float32)
    if len(row):
        np.add.at(out, row, (kernel(cells, marks) @ root.astype(np.float32)))
        out /= np.maximum(np.bincount(row, minlength=len(out)), 1)[:, None].astype(np.float32)
    return out


def nystrom(marks: np.ndarray) -> np.ndarray:
    """The landmarks' kernel matrix to the power of -1/2, up to a rotation."""
    own = kernel(marks, marks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-6 * values.max()
    return vectors[:, keep] / np.sqrt(values[keep])


def support_vectors(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 40, block: int = 4096) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine: half the squared norm plus cost times squared hinge loss, by Newton steps
    whose sums are taken over blocks of rows."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.ones(len(w))
    ridge[-1] = 1e-3
    for _ in range(rounds):
        grad, curve = ridge * w, np.diag(ridge)
        for k in range(0, len(x), block):
            some = np.hstack([x[k : k + block].astype(np.float64), np.ones((len(x[k : k + block]), 1))])
            slack = 1 - y[k : k + block] * (some @ w)
            on = np.flatnonzero(slack > 0)
            c = cost[k : k + block][on]
            grad = grad - 2 * some[on].T @ (c * y[k : k + block][on] * slack[on])
            curve += 2 * (some[on] * c[:, None]).T @ some[on]
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def _word_counts(sampled: DataFrame) -> DataFrame:
    """(codes binary, toxic long, clean long): after how many different words each word's row stands in toxic and in clean sampled documents.

    Different words before it, not documents, as copies of a document repeat all its words in one place.
    """

    def run(batches):
        for batch in batches:
            label = np.asarray(batch.column(2))
            data, offsets = common.utf8_buffers(batch.column(1))
            for first, last in common.slices(offsets):
                letters, bounds, rows, hashes = words_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                if not len(hashes):
                    continue
                toxic = label[first + np.repeat(np.arange(last - first), np.diff(rows))] == 1
                before = np.append(np.uint64(0), hashes[:-1])
                before[rows[:-1][rows[:-1] < len(before)]] = 0
                _, index = np.unique(np.stack([hashes, before, toxic.astype(np.uint64)], 1), axis=0, return_index=True)
                cells, begin = windows(letters, bounds[:-1][index], bounds[1:][index])
                word = index[np.repeat(np.arange(len(index)), np.diff(np.append(begin, len(cells))))]
                codes = [c.tobytes() for c in cells.astype(np.uint8)]
                yield pa.record_batch([pa.array(codes, pa.binary()), pa.array(before[word].view(np.int64)), pa.array(toxic[word])], names=["codes", "before", "toxic"])

    places = sampled.mapInArrow(run, "codes binary, before long, toxic boolean").distinct()
    return places.groupBy("codes").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean"))


def _word_values(counts: DataFrame, weights: np.ndarray) -> DataFrame:
    """(codes, value) of word rows."""

    def run(batches):
        for batch in batches:
            rows = np.stack([np.frombuffer(c.as_buffer(), np.uint8) for c in batch.column(0)]).astype(np.int32) if batch.num_rows else np.zeros((0, WIDTH), np.int32)
            yield pa.record_batch([batch.column(0), pa.array(row_values(rows, weights))], names=["codes", "value"])

    return counts.select("codes").mapInArrow(run, "codes binary, value double")


def _word_rows(found: list) -> list[np.ndarray]:
    rows = [np.frombuffer(c, np.uint8).astype(np.int32) for c in dict.fromkeys(bytes(r["codes"]) for r in found)]
    return [r for r in rows if (r > 0).sum() > 3]


def landmark_words(sampled: DataFrame, toxic: int, clean: int, most: int = LANDMARKS) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Landmarks from toxic sentences, strongest first, and from clean ones: at most ``most`` in all.

    The first are the words that stand in many places of toxic sentences and hardly ever in clean ones, by log odds times the
    root of the count; the others the clean words that are most like them. Ties fall by the words' codes. Labels choose landmarks here;
    what landmarks mean is learnt from the sentences.
    """
    counts = common.written(_word_counts(sampled), "words")
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    found = counts.filter(F.col("toxic") >= max(3, round(0.002 * toxic))).withColumn("odds", odds).orderBy(F.desc(F.col("odds") * F.sqrt(F.col("toxic").cast("double"))), "codes")
    positive = _word_rows(found.filter("odds > 3").limit(most // 2).collect()) or _word_rows(found.filter("odds > 0").limit(most // 2).collect())
    if not positive:
        return [], []
    near = _word_values(counts.filter((F.col("clean") > 0) & (odds < 1)), folded(np.stack(positive), np.ones(len(positive))))
    negative = _word_rows(near.orderBy(F.desc("value"), "codes").limit(most // 2).collect())
    common.removed(counts)
    return positive, negative


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, label_col: str = "toxic", cost: float = COST, rounds: int = ROUNDS, witnesses: int = WITNESSES) -> Machine | float:
    """A machine from at most ``most`` labelled documents, or the share of label 1 where one class is missing or no word
    of a toxic sentence can be a landmark.

    The sample is written to the shared folder. Spark counts the words and makes the training rows; the driver gets at
    most LANDMARKS words, and for each sampled document a row of at most LANDMARKS numbers a round and four numbers at the end.
    """
    sampled = common.written(labelled.sample(docs, labels, label_col, most), "sample")
    totals = {r["label"]: r["count"] for r in sampled.groupBy("label").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return toxic / (toxic + clean) if toxic + clean else 0.0
    positive, negative = landmark_words(sampled, toxic, clean)
    if not positive:
        return toxic / (toxic + clean)
    marks = np.stack(positive + negative).astype(np.int32)
    root = nystrom(marks)
    machine = Machine(folded(np.stack(positive), np.ones(len(positive))), 0.0)

    def rows_of(weights: np.ndarray) -> DataFrame:
        def run(batches):
            for batch in batches:
                x = sentence_rows(*common.utf8_buffers(batch.column(1)), weights, marks, root, witnesses)
                yield common.released(pa.record_batch([batch.column(0), batch.column(2), pa.array([v.tobytes() for v in x], pa.binary())], names=["doc_id", "label", "x"]))

        return sampled.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, x binary")

    for _ in range(rounds):
        found = rows_of(machine.weights).toArrow().sort_by("doc_id")
        y = np.where(found.column("label").to_numpy() == 1, 1.0, -1.0)
        x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(len(y), -1)
        w, offset = support_vectors(x, y, cost * np.where(y > 0, clean / toxic, 1.0))
        machine = Machine(folded(marks, root @ w), offset)

    def run(batches):
        for batch in batches:
            seen = machine.evidence(*common.utf8_buffers(batch.column(1)))
            yield pa.record_batch([batch.column(0), batch.column(2), *(pa.array(seen[:, k]) for k in range(4))], names=["doc_id", "label", "a", "b", "c", "d"])

    seen = sampled.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, a double, b double, c double, d double").orderBy("doc_id", "a", "b", "c", "d").collect()
    machine.curve = labelled.calibrated(np.array([[r[k] for k in "abcd"] for r in seen]), np.array([r["label"] for r in seen]))
    common.removed(sampled)
    return machine


def choose(docs: DataFrame, labels: DataFrame, settings: list[dict] = SETTINGS, most: int = SAMPLE, label_col: str = "toxic", folds: int = 4) -> list[tuple[float, int, dict]]:
    """(log loss, errors, setting) of each setting of ``train``, best first, by cross-validation within the rows that may be learnt from.

    Held-out rows take no part: the others fall into ``folds`` by crc32 div 5, and each is judged by a machine trained on the rest.
    """
    open_rows = labels.filter(~labelled.held_out()).withColumn("fold", F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 5) % folds)
    judged = open_rows.select("doc_id", F.col(label_col).cast("int").alias("label"), "fold").dropna()
    out = []
    for setting in settings:
        told = []
        for k in range(folds):
            mine = judged.filter(F.col("fold") == k)
            texts = docs.select("doc_id", "text").join(mine.select("doc_id").distinct(), "doc_id", "left_semi")
            found = score(texts, train(docs, open_rows.filter(F.col("fold") != k).drop("fold"), most, label_col, **setting)).join(mine, "doc_id")
            p = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
            loss = F.sum(-F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p)))
            told.append(found.agg(loss.alias("loss"), F.count_if(F.col("predicted") != F.col("label")).alias("errors"), F.count(F.lit(1)).alias("n")).first())
        out.append((sum(t["loss"] or 0.0 for t in told) / max(1, sum(t["n"] for t in told)), sum(t["errors"] for t in told), setting))
    return sorted(out, key=lambda x: x[:2])


def score(docs: DataFrame, machine: Machine | float, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): the toxicity of every whole text, 0 to 1.

    A map without exchange; every word of a text counts, however long the text. Null and empty texts and
    texts without letters get the score of a text without any matching word; repeated rows give equal
    rows; a null id stays null and is not held out; other columns are not read; an empty table gives an
    empty table. With a constant in place of a machine, that constant is every score.
    """
    texts = common.texts(docs, id_col, text_col)
    if isinstance(machine, float):
        scored = texts.select("doc_id", F.lit(machine).alias("score"))
    else:

        def run(batches):
            for batch in batches:
                data, offsets = common.utf8_buffers(batch.column(1))
                yield common.released(pa.record_batch([batch.column(0), pa.array(machine.scores(machine.evidence(data, offsets)))], names=["doc_id", "score"]))

        scored = texts.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", labelled.held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept(docs: DataFrame, machine: Machine | float, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below the threshold.

    A map without exchange. A null text scores as an empty one.
    """
    if isinstance(machine, float):
        return docs if machine < threshold else docs.limit(0)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            scores = machine.scores(machine.evidence(*common.utf8_buffers(batch.column(at))))
            yield common.released(batch.filter(pa.array(scores < threshold)))

    return docs.mapInArrow(run, docs.schema)
