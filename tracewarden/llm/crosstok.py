"""Alignment of two tokenizations of the same texts, by windows between whitespace anchors.

A text is tokenized whole by a byte-level vocabulary (A, over a space and the text) and by a sentence-piece model
(B, which adds that space itself). Both token rows must give the text's bytes back. A byte at which tokens of both end
and before whose successor both carry a space mark is an *anchor*; anchors cut a document into windows of token ids,
mostly of a word each. What a window holds (groups, links) depends on its ids alone, so it is worked out once and
remembered under the tuple of its ids; a slice of texts looks up each different window once.

Links are counted corpus-wide in three steps that never bring a document's text or a frequent pair together: a slice
of texts sends each different pair once with its count (combined again before the exchange), the totals come
back by pair, and each slice meets the totals of its own pairs. Tokens are made once; what a document needs
afterwards (places of its pairs in the slice's list, and how often each) is written beside the pairs.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.bpe import _byte_symbols, default_path, ranges
from tracewarden.llm.common import mix, packed_counts, released, texts, unpacked_counts, utf8_buffers, written

#: Bytes of text of a slice, and of the texts that are tokenized in one call.
SLICE_BYTES, _CALL_BYTES = 6 << 20, 1 << 19
#: A pair of ids is one number: the A id times this, plus the B id.
_B_IDS = 1 << 20
#: Windows that a task remembers before it starts afresh, and the most ids of one that is remembered.
_REMEMBERED, _LONGEST = 400_000, 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_SLICED = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, picks binary, times binary, pairs array<long>, counts array<long>"


class Tokens:
    """The bytes of a vocabulary's ids, in one buffer."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(x) for x in entries], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(entries), np.uint8)
        self.spaced = np.array([x[:1] == b" " for x in entries])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[ranges(self.starts[ids], self.lengths[ids])]


class Aligner:
    """Both tokenizers of a task, and the windows that it remembers."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {x["content"] for x in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(_byte_symbols())}
        vocab = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        entries = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            entries[i] = token
        self.a = Tokens(entries)
        self.a_path = a_path
        # without special tokens their strings are plain text
        self.encode_a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={}).encode_ordinary
        pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b = Tokens([bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in range(pieces.get_piece_size()))])
        self.encode_b = lambda batch: pieces.encode(batch, num_threads=1)
        self.a_names = [np.array([f"{i}{mark}" for i in range(len(self.a.lengths))], object) for mark in (",", "|")]
        self.b_names = [np.array([f"{i}{mark}" for i in range(len(self.b.lengths))], object) for mark in (",", ";", "")]
        self._forget()

    def _forget(self) -> None:
        self.known: dict[tuple[bytes, bytes], tuple[str, int, bytes]] = {}

    def tokenized(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts under A and B, and how many each text has."""
        out: list[list[np.ndarray]] = [[], []]
        sizes: list[list[int]] = [[], []]
        first = 0
        while first < len(batch):
            last, n = first, 0
            while last < len(batch) and (n < _CALL_BYTES or last == first):
                n += len(batch[last])
                last += 1
            some = batch[first:last]
            for k, found in enumerate(([self.encode_a(" " + t) for t in some], self.encode_b(some))):
                sizes[k] += map(len, found)
                out[k] += [np.array(x, np.int32) for x in found]
            first = last
        none = np.zeros(0, np.int32)
        return np.concatenate([none, *out[0]]), np.array(sizes[0], np.int64), np.concatenate([none, *out[1]]), np.array(sizes[1], np.int64)

    def windows(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray) -> list[tuple[str, int, bytes]]:
        """(groups as text, their number, codes of the linked pairs) of each window, its ids one after another in ``a`` and ``b``.

        Between two neighbouring ends of either side lies one A and one B token, so the different ends are the links, and the
        ends on both sides are the groups.
        """
        ends_a, ends_b = np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b])
        ends = np.union1d(ends_a, ends_b)
        codes = (a[np.searchsorted(ends_a, ends)].astype(np.int64) * _B_IDS + b[np.searchsorted(ends_b, ends)]).tobytes()
        at = np.searchsorted(ends_b, ends_a)
        shared = np.flatnonzero(ends_b[at] == ends_a)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[shared], last_b[at[shared]] = True, True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        words = np.empty(len(a) + len(b), object)
        words[np.arange(len(a)) + np.append(0, at[shared] + 1)[group_a]] = np.where(last_a, self.a_names[1][a], self.a_names[0][a])
        window_ends = np.cumsum(sizes_b)
        last_b[window_ends - 1] = False
        named = np.where(last_b, self.b_names[1][b], self.b_names[0][b])
        named[window_ends - 1] = self.b_names[2][b[window_ends - 1]]
        words[np.arange(len(b)) + (shared + 1)[group_b]] = named
        flat = words.tolist()
        bounds = np.append(0, np.cumsum(sizes_a + sizes_b)).tolist()
        stops = ends_a[np.cumsum(sizes_a) - 1]
        groups = np.diff(np.append(0, np.searchsorted(ends_a[shared], stops, side="right"))).tolist()
        cuts = (8 * np.append(0, np.searchsorted(ends, stops, side="right"))).tolist()
        return [("".join(flat[bounds[k] : bounds[k + 1]]), groups[k], codes[cuts[k] : cuts[k + 1]]) for k in range(len(groups))]

    def found(self, a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[tuple[str, int, bytes]]:
        """What the given windows hold: remembered under their two rows of ids, or worked out, all new ones together."""
        bytes_a, bytes_b = a.tobytes(), b.tobytes()
        keys = [(bytes_a[i:j], bytes_b[k:m]) for i, j, k, m in zip((4 * first_a).tolist(), (4 * last_a).tolist(), (4 * first_b).tolist(), (4 * last_b).tolist())]
        out = list(map(self.known.get, keys))
        new = [k for k, x in enumerate(out) if x is None]
        if new:
            at = np.array(new)
            sizes_a, sizes_b = (last_a - first_a)[at], (last_b - first_b)[at]
            for k, held, size in zip(new, self.windows(a[ranges(first_a[at], sizes_a)], b[ranges(first_b[at], sizes_b)], sizes_a, sizes_b), (sizes_a + sizes_b).tolist()):
                out[k] = held
                if size <= _LONGEST:
                    self.known[keys[k]] = held
        if len(self.known) > _REMEMBERED:
            self._forget()
        return out


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the runs between bounds."""
    return np.diff(np.append(0, np.cumsum(values))[bounds])


def _matching(tokens: Tokens, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows' tokens give a space and the row's bytes."""
    bounds = np.append(0, np.cumsum(sizes))
    good = _sums(tokens.lengths[ids], bounds) == np.diff(offsets) + 1
    joined = tokens.joined(ids[np.repeat(good, sizes)])
    rows = np.flatnonzero(good)
    lengths = np.diff(offsets)[rows] + 1
    ends = np.cumsum(lengths)
    heads = ends - lengths
    wanted = np.full(len(joined), 0x20, np.uint8)
    body = np.ones(len(joined), bool)
    body[heads] = False
    wanted[body] = data[ranges(offsets[rows], lengths - 1)]
    good[rows] = _sums(joined != wanted, np.append(0, ends)) == 0
    return good


def _windows(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one window of each kind, the kind of every window): equal rows of ids are one kind.

    Kinds are found by a 64-bit hash and each window is compared with its kind's ids; should two kinds ever share a hash,
    another one is taken.
    """
    size_a, size_b = np.diff(np.append(first_a, len(a))), np.diff(np.append(first_b, len(b)))
    seed = np.array([1], np.uint64)
    while True:
        keys = np.zeros(len(first_a), np.uint64)
        for ids, first, size in ((a, first_a, size_a), (b, first_b, size_b)):
            place = (np.arange(len(ids)) - np.repeat(first, size)).astype(np.uint64)
            keys = mix(keys + np.add.reduceat(mix((ids.astype(np.uint64) << np.uint64(32)) + place + seed * _MULTIPLIER), first))
        _, one, kind = np.unique(keys, return_index=True, return_inverse=True)
        same = one[kind]
        if (size_a == size_a[same]).all() and (size_b == size_b[same]).all() and (a == a[ranges(first_a[same], size_a)]).all() and (b == b[ranges(first_b[same], size_b)]).all():
            return one, kind
        seed = seed + np.uint64(1)


def _slice(tool: Aligner, number: int, ids: pa.Array, text: pa.Array, groups: bool) -> pa.RecordBatch:
    """The rows of one slice (see ``aligned``); its first row carries the slice's pairs and their counts."""
    rows = len(text)
    data, offsets = utf8_buffers(text)
    a, sizes_a, b, sizes_b = tool.tokenized(text.to_pylist())
    good = np.diff(offsets) > 0
    good &= _matching(tool.a, a, sizes_a, data, offsets) & _matching(tool.b, b, sizes_b, data, offsets)
    a, b = a[np.repeat(good, sizes_a)], b[np.repeat(good, sizes_b)]
    sizes_a, sizes_b = np.where(good, sizes_a, 0), np.where(good, sizes_b, 0)
    n_groups, n_links = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    names, pairs, counts = [""] * rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
    picks, times = [b""] * rows, [b""] * rows
    if len(a):
        ends_a, ends_b = np.cumsum(tool.a.lengths[a]), np.cumsum(tool.b.lengths[b])
        at = np.searchsorted(ends_b, ends_a)
        shared = np.flatnonzero(ends_b[at] == ends_a)
        # every text begins with a space under both, so that texts end at anchors
        inner = shared[:-1]
        anchors = inner[tool.a.spaced[a[inner + 1]] & tool.b.spaced[b[at[inner] + 1]]]
        first_a, first_b = np.append(0, anchors + 1), np.append(0, at[anchors] + 1)
        one, kind = _windows(a, b, first_a, first_b)
        last_a, last_b = np.append(first_a[1:], len(a)), np.append(first_b[1:], len(b))
        held = tool.found(a, b, first_a[one], first_b[one], last_a[one], last_b[one])
        of_text = np.searchsorted(first_a, np.append(0, np.cumsum(sizes_a)))  # each text's first window
        n_groups = _sums(np.array([h[1] for h in held])[kind], of_text)
        links = np.array([len(h[2]) // 8 for h in held])
        n_links = _sums(links[kind], of_text)
        pairs, place = np.unique(np.frombuffer(b"".join(h[2] for h in held), np.int64), return_inverse=True)
        linked = place[ranges((np.cumsum(links) - links)[kind], links[kind])]
        counts = np.bincount(linked, minlength=len(pairs))
        both, often = np.unique(np.repeat(np.arange(rows), n_links) * len(pairs) + linked, return_counts=True)
        cuts = np.searchsorted(both, np.arange(rows + 1) * len(pairs)).tolist()
        spread = both % len(pairs)
        step = np.diff(spread, prepend=0).astype(np.int32)
        for k in np.flatnonzero(good).tolist():
            lo, hi = cuts[k], cuts[k + 1]
            step[lo] = spread[lo]
            picks[k], times[k] = step[lo:hi].tobytes(), packed_counts(often[lo:hi])
        named = np.array([h[0] for h in held], object)[kind].tolist()
        bounds = of_text.tolist()
        names = [";".join(named[x:y]) for x, y in zip(bounds, bounds[1:])]
    lists = lambda x: pa.array([x, *[None] * (rows - 1)], pa.list_(pa.int64()))
    columns = [pa.array(np.full(rows, number)), ids, pa.array(sizes_a), pa.array(sizes_b), pa.array(n_groups), pa.array(n_links), pa.array([hashlib.sha256(x.encode()).hexdigest() if x else "" for x in names]), pa.array(names if groups else [None] * rows, pa.string()), pa.array(picks, pa.binary()), pa.array(times, pa.binary()), lists(pairs), lists(counts)]
    return pa.record_batch(columns, names=[c.split()[0] for c in _SLICED.split(", ")])


def sliced(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, groups: bool = False, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Documents aligned slice by slice, written to the shared folder: counts by document, its groups' digest (``groups``: and their text),
    and what ``counted_links`` needs. A slice is some ``slice_bytes`` of text of one task, or one longer text."""
    a_path, b_path = os.fspath(a_path or default_path("byte_bpe_50k.json")), os.fspath(b_path or default_path("piece_bpe_32k.model"))

    def run(batches):
        tool, number, kept, size = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, [], 0

        def emit():
            table = pa.Table.from_batches(kept).combine_chunks()
            return released(_slice(tool, number, table.column(0).combine_chunks(), table.column(1).combine_chunks(), groups))

        for batch in batches:
            ends = np.cumsum(np.asarray(pc.binary_length(batch.column(1))).astype(np.int64))
            first = 0
            while first < batch.num_rows:
                before = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + slice_bytes - size, side="right")))
                kept.append(batch.slice(first, last - first))
                size += int(ends[last - 1]) - before
                first = last
                if size >= slice_bytes or first < batch.num_rows:
                    yield emit()
                    number, kept, size = number + 1, [], 0
        if kept:
            yield emit()

    return written(texts(docs, id_col, text_col).mapInArrow(run, _SLICED), "slices")


def pair_counts(slices: DataFrame) -> DataFrame:
    """(pair, links, best): how many links of all documents hold a pair of ids, and whether no other pair of its B id has more."""
    sent = slices.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = sent.groupBy("pair").agg(F.sum("n").alias("links"))
    most = totals.groupBy((F.col("pair") % _B_IDS).alias("b_id")).agg(F.max("links").alias("most"))
    return totals.withColumn("b_id", F.col("pair") % _B_IDS).join(most, "b_id").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def lexicon(slices: DataFrame) -> DataFrame:
    """(a_id, b_id, links, best): the linked pairs of ids of all documents."""
    return pair_counts(slices).select(F.floor(F.col("pair") / _B_IDS).cast("long").alias("a_id"), (F.col("pair") % _B_IDS).alias("b_id"), "links", "best")


def _rated(mine: pa.Table, totals: pa.Table) -> pa.Table:
    """The documents of a slice with the corpus-wide counts of their links."""
    order = np.argsort(np.asarray(totals.column("at")), kind="stable")
    links, best = np.asarray(totals.column("links"))[order], np.asarray(totals.column("best").cast(pa.int8())).astype(np.int64)[order]
    n_best, count_sum = np.zeros(mine.num_rows, np.int64), np.zeros(mine.num_rows, np.int64)
    for k, (picks, times) in enumerate(zip(mine.column("picks"), mine.column("times"), strict=True)):
        if len(picks.as_buffer()):
            at = np.cumsum(np.frombuffer(picks.as_buffer(), np.int32), dtype=np.int64)
            often = unpacked_counts(times.as_buffer(), len(at))
            n_best[k], count_sum[k] = (often * best[at]).sum(), (often * links[at]).sum()
    return released(mine.drop_columns(["slice", "picks", "times"]).append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum)))


def counted_links(slices: DataFrame) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups, n_best, count_sum) of all documents of ``sliced``."""
    sent = slices.filter("pairs IS NOT NULL").select(F.col("slice").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    back = sent.join(pair_counts(slices), "pair").select("of", "at", "links", "best")
    mine = slices.select("slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "picks", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    return mine.groupBy("slice").cogroup(back.groupBy("of")).applyInArrow(_rated, schema)


def align_documents(docs: DataFrame, groups: bool = True, **options) -> DataFrame:
    """Alignment of both tokenizations of every whole text, with corpus-wide link counts.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of A and B between bytes at which tokens of both end. A link is an A token and
    a B token that share a byte; ``count_sum`` adds up how often each link's pair of ids is linked corpus-wide, ``n_best``
    counts links whose pair is its B id's most frequent (ties included). A null or empty text, and one that either
    tokenizer doesn't give back byte by byte, has no tokens: zeros and an empty ``groups``. Null ids stay null, repeated
    rows count each for itself, other columns are not read, an empty table gives an empty table. A text longer than a
    slice is a slice of its own.
    """
    return counted_links(sliced(docs, groups=groups, **options))


def digest(aligned: DataFrame) -> DataFrame:
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
