"""Language-model scores by subword lattices.

A word's lattice holds every way to write it (with the vocabulary's word mark before it) as pieces of an
existing subword vocabulary. The vocabulary's own scores weight the pieces, and a forward recursion in log
space sums the probabilities of all segmentations. Since pieces don't cross words, a text's marginal
probability is the product over its words, and each distinct word's lattice is summed once.

The corpus adapts the model: a word that was counted in the training documents gets its count, and the
lattice spreads a mass of as many counts as there are distinct words over all words, seen or not:
P(w) = (c(w) + V * lattice(w)) / (N + V). The end of a text is a token of its own. The marginal of the lattices
alone is returned beside that score.

Chunks of documents send each distinct word once, and only to the parts of the hash space for which they have words,
so the rows sent and answered are at most the chunks' distinct words; the two totals N and V are one small aggregate.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import common

CHUNK_BYTES = 4 << 20
_BASE = 0x100000001B3 * 2 + 1
_CELLS = 1 << 21
SENT_SCHEMA = "part int, chunk int, words binary, counts binary"
TOLD_SCHEMA = "chunk int, part int, counts binary, lattice binary, tokens long, kinds long"


def default_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_weights(scores: np.ndarray) -> np.ndarray:
    """Natural log probabilities of pieces from a vocabulary's scores.

    The scores of unigram files are log probabilities. Those of merge files are minus the rank of a piece,
    which stands for its frequency by the Zipf-Mandelbrot law, 1 / (rank + 2.7). Either are normalised.
    """
    ranks = len(scores) > 0 and bool((scores == np.round(scores)).all())
    logs = -np.log(2.7 - np.minimum(scores, 0)) if ranks else scores
    most = logs.max()
    return logs - (most + np.log(np.exp(logs - most).sum()))


class Pieces:
    """A sentencepiece vocabulary as a table of byte strings with log probabilities, and lattices over it."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names, scores = [], []
        for i in range(model.get_piece_size()):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece, score = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                names.append(bytes([int(piece[3:5], 16)]))
                scores.append(-float(model.get_piece_size()))  # a byte is rarer than any piece
            elif score > -1e8:  # pieces that the file itself never uses have minus a thousand million
                names.append(piece.encode())
                scores.append(score)
        logs = piece_weights(np.array(scores))
        table: dict[bytes, float] = {}
        for name, value in zip(names, logs.tolist(), strict=True):
            table[name] = max(value, table.get(name, -np.inf))
        self.longest = max(map(len, table))
        keys = np.array([self._hash(name) for name in table], np.uint64)
        self.values = np.append(np.array(list(table.values()), np.float32), np.float32(-np.inf))
        self.slots = np.full(1 << 18, -1, np.int64)
        self.keys = np.append(keys, np.uint64(0))
        todo, step = np.arange(len(keys)), 0
        while len(todo):
            at = (self._slot(keys[todo]) + step) & (len(self.slots) - 1)
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            todo, step = todo[self.slots[at] != todo], step + 1
        self.probes = step

    @staticmethod
    def _hash(name: bytes) -> int:
        out = 0
        for k, b in enumerate(name):
            out += int(common.BYTE_VALUES[b]) * pow(_BASE, k, 1 << 64)
        return (out + len(name) * 0x9E3779B97F4A7C15) % (1 << 64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (common.mix(keys) >> np.uint64(46)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Log probabilities of byte strings by hash; minus infinity for what is no piece."""
        flat = keys.ravel()
        at, found = self._slot(flat), np.full(len(flat), len(self.values) - 1)
        todo = np.arange(len(flat))
        for step in range(self.probes):
            slot = self.slots[(at[todo] + step) & (len(self.slots) - 1)]
            hit = (slot >= 0) & (self.keys[slot] == flat[todo])
            found[todo[hit]] = slot[hit]
            todo = todo[(slot >= 0) & ~hit]
            if not len(todo):
                break
        return self.values[found].reshape(keys.shape)

    def marginals(self, words: list[bytes], mark: bytes = "▁".encode()) -> np.ndarray:
        """The log10 probability of each word, summed over all segmentations of mark + word; minus infinity for an empty word."""
        out = np.full(len(words), -np.inf)
        sizes = np.array([len(w) + len(mark) for w in words], np.int64)
        full = np.array([len(w) > 0 for w in words], bool)
        widths = -(-sizes // 4) * 4
        for width in np.unique(widths[full]).tolist():
            members = np.flatnonzero(full & (widths == width))
            deep = min(width, self.longest)
            step = max(1, _CELLS // (width * deep))
            for k in range(0, len(members), step):
                some = members[k : k + step]
                raw = b"".join((mark + words[i]).ljust(width, b"\0") for i in some.tolist())
                cells = np.frombuffer(raw, np.uint8).reshape(-1, width)
                ends = self._forward(cells, deep)
                out[some] = ends[np.arange(len(some)), sizes[some]] / np.log(10)
        return out

    def _forward(self, cells: np.ndarray, deep: int) -> np.ndarray:
        """alpha[:, j]: log of the summed probabilities of all segmentations of the first j bytes of each row."""
        n, width = cells.shape
        powers, inverse = common._power_tables(width + 1)
        prefix = np.zeros((n, width + 1), np.uint64)
        np.cumsum(common.BYTE_VALUES[cells] * powers[:width], axis=1, out=prefix[:, 1:])
        # edge[:, d - 1, j]: the piece of d bytes that ends at j
        edge = np.full((n, deep, width + 1), -np.inf, np.float32)
        for d in range(1, deep + 1):
            keys = (prefix[:, d:] - prefix[:, : width + 1 - d]) * inverse[: width + 1 - d] + np.uint64(d * 0x9E3779B97F4A7C15 % (1 << 64))
            edge[:, d - 1, d:] = self.look_up(keys)
        alpha = np.full((n, width + 1), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, width + 1):
            d = min(deep, j)
            terms = alpha[:, j - d : j][:, ::-1] + edge[:, :d, j]
            most = terms.max(1)
            safe = np.where(np.isfinite(most), most, 0)
            alpha[:, j] = safe + np.log(np.maximum(np.exp(terms - safe[:, None]).sum(1), 1e-300))
        return alpha


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _tokens(table: pa.Table, folds: int):
    """A chunk's rows and distinct words: (ids, null ids, held out, first word of each row, word numbers, distinct words, their hashes)."""
    ids, null, _, data, offsets = common.ordered_rows(table)
    held = np.array([not n and zlib.crc32(str(i).encode()) % folds == 0 for i, n in zip(ids.tolist(), null.tolist())], bool)
    hashes, words, rows, base = [np.zeros(0, np.uint64)], [], [np.zeros(1, np.int64)], 0
    for first, last in common.slices(offsets):
        part = common.lowered(data[offsets[first] : offsets[last]])
        starts, ends, cut = common.word_bounds(part, offsets[first : last + 1] - offsets[first])
        found = common.word_hashes(part, starts, ends)
        _, index = np.unique(found, return_index=True)
        raw = part.tobytes()
        words += [raw[a:b] for a, b in zip(starts[index].tolist(), ends[index].tolist())]
        hashes += [found[index]]
        rows.append(cut[1:] + base)
        base += len(found)
        hashes.append(found)
    distinct, tokens = np.concatenate(hashes[1::2] or hashes[:1]), np.concatenate(hashes[2::2] or hashes[:1])
    uniq, index = np.unique(distinct, return_index=True)
    return ids, null, held, np.concatenate(rows), np.searchsorted(uniq, tokens), [words[i] for i in index.tolist()], uniq


def _send(table: pa.Table, folds: int, parts: int) -> pa.Table:
    """A row for each part that has some of the chunk's distinct words: those and their counts in training rows. Part 0
    always has a row, which begins with the empty word; that stands for the ends of texts."""
    chunk = table.column("chunk")[0].as_py()
    _, _, held, rows, tokens, words, hashes = _tokens(table, folds)
    trained = np.repeat(~held, np.diff(rows))
    counts = np.bincount(tokens[trained], minlength=len(words)).astype(np.uint32)
    home = np.append(0, common.parts_of(hashes, parts))
    words, counts = [b"", *words], np.append(np.uint32((~held).sum()), counts)
    some, first = np.unique(home, return_index=True)
    cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(words)]))
    return pa.table({"part": pa.array(some.astype(np.int32)), "chunk": pa.array(np.full(len(some), chunk, np.int32)), "words": pa.array([b" ".join(words[a:b]) for a, b in cuts], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary())})


def _count(table: pa.Table, path: str) -> pa.Table:
    """A part's words over all chunks: counts and lattice probabilities in each chunk's own order; and a row for no chunk
    (-1) with the part's totals."""
    counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("counts")]
    words = [w.as_py().split(b" ") if len(c) else [] for w, c in zip(table.column("words"), counts, strict=True)]
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(w, len(known)) for some in words for w in some], np.int64)
    total = np.bincount(which, weights=np.concatenate(counts), minlength=len(known)) if len(which) else np.zeros(0)
    lattice = pieces(path).marginals(list(known)).astype(np.float32)
    ends = np.cumsum([len(c) for c in counts])
    cut = lambda x, kind: [x[which[e - len(c) : e]].astype(kind).tobytes() for c, e in zip(counts, ends)]
    n = len(counts)
    return pa.table({
        "chunk": pa.array(np.append(table.column("chunk").to_numpy(), -1).astype(np.int32)),
        "part": pa.array(np.full(n + 1, table.column("part")[0].as_py(), np.int32)),
        "counts": pa.array([*cut(total, np.int64), None], pa.binary()),
        "lattice": pa.array([*cut(lattice, np.float32), None], pa.binary()),
        "tokens": pa.array([None] * n + [int(total.sum())], pa.int64()),
        "kinds": pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
    })


def _score(table: pa.Table, told: pa.Table, folds: int, n: int, kinds: int) -> pa.Table:
    ids, null, held, rows, tokens, _, _ = _tokens(table, folds)
    told = told.sort_by("part")
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in told.column("counts")])
    lattice = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in told.column("lattice")]).astype(np.float64)
    mass = max(1, kinds)
    base = np.log10(counts + 0.1) - np.log10(n + 0.1 * (kinds + 1))
    own = np.log10(np.maximum(counts + mass * 10.0**lattice, 1e-300)) - np.log10(n + mass)
    # a word that was never counted keeps its lattice's value, however small
    own = np.where(counts > 0, own, np.log10(mass) + lattice - np.log10(n + mass))
    own[0] = np.log10(max(counts[0], 0.1)) - np.log10(n + mass)
    lattice[0] = 0.0  # the end is no piece
    row_of = np.repeat(np.arange(len(ids)), np.diff(rows))
    total = lambda x: np.bincount(row_of, x[1:][tokens], len(ids)) + x[0]
    return pa.table({
        "doc_id": pa.array(ids, pa.int64(), mask=null),
        "held_out": pa.array(held),
        "n_tokens": pa.array(np.diff(rows) + 1, pa.int64()),
        "n_known": pa.array(total((counts > 0).astype(np.float64)).astype(np.int64)),
        "train_tokens": pa.array(np.full(len(ids), n, np.int64)),
        "base_score": pa.array(total(base)),
        "score": pa.array(total(own)),
        "lattice_score": pa.array(total(lattice)),
    })


def score_documents(docs: DataFrame, path: str | None = None, folds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score) of every whole text.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` in lower case (A-Z) and one end. Counts come from rows whose
    crc32 of the id as text is not 0 modulo ``folds``. ``score`` is the log10 of the text's marginal probability
    under the adapted model, ``lattice_score`` that under the vocabulary's scores alone (summed over all segmentations, no
    end), ``base_score`` that of add-0.1 smoothing. A null or empty text is just an end; a word of any length is one
    lattice, in time and memory in proportion to its length; a null id stays null and trains; repeated rows count and are returned each; other columns are not read; an
    empty table gives an empty table; without training rows every count is 0. ``path`` names a vocabulary file
    that is at the same place on all executors.
    """
    path = str(path or default_path())
    total, parts = common.groups_of(docs, text_col)
    chunks = common.in_chunks(docs, max(1, -(-total * common.CHUNK_BYTES // CHUNK_BYTES)), id_col, text_col).groupBy("chunk")
    sent = chunks.applyInArrow(lambda t: common.released(_send(t, folds, parts)), SENT_SCHEMA)
    told = common.written(sent.groupBy("part").applyInArrow(lambda t: common.released(_count(t, path)), TOLD_SCHEMA), "words")
    n, kinds = told.filter("chunk < 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    answers = told.filter("chunk >= 0").select("chunk", "part", "counts", "lattice")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
    return chunks.cogroup(answers.groupBy("chunk")).applyInArrow(lambda t, f: common.released(_score(t, f, folds, n, kinds)), schema)
