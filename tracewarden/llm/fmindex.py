"""Substring dedup: an FM-index per shard, searched backwards over a wavelet matrix.

A shard (see ``repeats``) indexes the different segments that share an anchor. Their words become
numbers, the concatenation is sorted by suffixes, and its Burrows-Wheeler transform is kept as a
wavelet matrix of packed bits with counts. All segments then stream through the index at once, from
their last word to their first: one backward step a word, with the match length capped at the window.
The interval of a full match holds every place where the window's words stand; the smallest of them
tells whether the window starts earlier.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import common, repeats

#: Words of the grams that anchor windows.
GRAM = 8
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class BitVector:
    """Bits packed into 64-bit words, with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.append(0, np.cumsum(ones, dtype=np.int64)[:-1]).astype(np.int32 if len(bits) < 1 << 31 else np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Ranks of any symbol in a sequence of numbers: one bit vector a bit of the symbols, zeros before ones at each level."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.levels, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.levels.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start, end = np.zeros_like(at), at
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            ones_start, ones_end = self.levels[k].rank(start), self.levels[k].rank(end)
            start = np.where(one, self.zeros[k] + ones_start, start - ones_start)
            end = np.where(one, self.zeros[k] + ones_end, end - ones_end)
        return end - start


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """The suffixes of ``text`` sorted by at least their first ``depth`` symbols, ties by position, and that depth.

    Prefix doubling: ranks by h symbols give ranks by 2h. Past the end stands a symbol below all others.
    """
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank, h = _ranks(order, text[order]), 1
    while h < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: n - h] = rank[h:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        rank = _ranks(order, key[order])
        h *= 2
        if n and rank[order[-1]] == n - 1:
            break
    return order, h


def _ranks(order: np.ndarray, values: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(np.append(False, values[1:] != values[:-1])) if len(order) else 0
    return rank


class FMIndex:
    """A text of numbers (0 separates pieces) that can be searched backwards for matches of up to ``cap`` symbols."""

    def __init__(self, text: np.ndarray, cap: int):
        self.cap, n = cap, len(text)
        self.order, _ = suffix_array(text, cap + 1)
        size = int(text.max()) + 2 if n else 2
        self.tree = WaveletMatrix(text[self.order - 1], max(1, (size - 1).bit_length()))
        self.counts = np.append(0, np.cumsum(np.bincount(text, minlength=size)))
        # classes of suffixes that share their first cap symbols
        new = np.zeros(n, bool)
        if n:
            new[0] = True
            padded = np.concatenate([text, np.full(cap, -1, text.dtype)])
            todo = np.arange(1, n)
            for k in range(cap):
                differ = padded[self.order[todo] + k] != padded[self.order[todo - 1] + k]
                new[todo[differ]] = True
                todo = todo[~differ]
        self.starts = np.flatnonzero(new)
        self.class_of = np.cumsum(new) - 1
        self.ends = np.append(self.starts[1:], n)
        self.earliest = np.minimum.reduceat(self.order, self.starts) if n else self.order

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the rows of symbol + match."""
        both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.counts[symbol]
        return base + both[: len(lo)], base + both[len(lo) :]

    def streamed(self, pieces: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
        """Matching statistics of pieces, capped: yields (piece, position, length, lo, hi) arrays, from each piece's end backwards.

        ``length`` is the number of symbols from ``position`` on that match somewhere in the text (at most
        ``cap``); lo and hi bound the rows of that match. A piece with a symbol that the text lacks starts
        afresh before it.
        """
        at, live = begins + sizes - 1, np.flatnonzero(sizes > 0)
        lo, hi, length = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(self.order)), np.zeros(len(sizes), np.int64)
        while len(live):
            symbol = pieces[at[live]]
            known = symbol < len(self.counts) - 1
            a, b = self.extend(np.where(known, symbol, 0), lo[live], hi[live])
            gone = ~known | (b <= a)
            if gone.any():
                again = np.flatnonzero(gone & known)
                a[gone], b[gone] = 0, len(self.order)
                a[again], b[again] = self.extend(symbol[again], np.zeros(len(again), np.int64), np.full(len(again), len(self.order)))
                fresh = again[b[again] > a[again]]
                lengths = length[live] + 1
                lengths[gone] = 0
                lengths[fresh] = 1
                empty = again[b[again] <= a[again]]
                a[empty], b[empty] = 0, len(self.order)
            else:
                lengths = length[live] + 1
            full = np.flatnonzero(lengths >= self.cap)
            a[full], b[full] = self.starts[self.class_of[a[full]]], self.ends[self.class_of[b[full] - 1]]
            lo[live], hi[live], length[live] = a, b, np.minimum(lengths, self.cap)
            yield live, at[live], length[live], a, b
            at[live] -= 1
            live = live[at[live] >= begins[live]]


def _search(contents: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, first, last) of words whose windows also start earlier: in a segment before it."""
    words = pa.array(b" ".join(contents).split(b" "), pa.binary()).dictionary_encode()
    sizes = np.fromiter((c.count(b" ") + 1 for c in contents), np.int64, len(contents))
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    filled = np.ones(len(text), bool)
    filled[begins + sizes] = False
    text[filled] = np.asarray(words.indices) + 1
    index = FMIndex(text, window)
    hits = [np.zeros(0, np.int64)]
    for _, at, length, lo, _ in index.streamed(text, begins, sizes):
        full = length >= window
        hits.append(at[full][index.earliest[index.class_of[lo[full]]] < at[full]])
    at = np.concatenate(hits)
    first, last = common.merged_spans(at, at + window)  # segments are apart by a separator, so runs don't join
    piece = np.searchsorted(begins, first, side="right") - 1
    return piece, first - begins[piece], last - begins[piece]


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", hot: int = repeats.HOT) -> DataFrame:
    """Remove every word that a window of ``window`` words covers whose words also start earlier.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Earlier: in a row with a smaller id, or in the same row at
    an earlier start. Returns (doc_id, n_words, n_removed, kept string, spans array<struct<start, end>>):
    the kept words joined by one space and the maximal removed runs in word positions of the input.
    Windows are judged on the input. A null text has no words. A null id counts as greater than every id;
    rows with equal ids count as parts of one document, in a fixed order of their own (so that of
    repeated rows one stays). Other columns are not read; an empty table gives an empty table. Long texts,
    many copies and frequent passages are searched whole.
    """

    def finish(table: pa.Table, whole: np.ndarray, found: tuple) -> pa.Table:
        ids, null, _, data, offsets = common.ordered_rows(table)
        spaced, bounds, first_word = repeats.spaced_words(data, offsets)
        rows, starts, ends = found
        copies = np.flatnonzero(whole)
        order = np.argsort(np.append(rows, copies), kind="stable")
        rows, starts, ends = np.append(rows, copies)[order], np.append(starts, np.zeros(len(copies), np.int64))[order], np.append(ends, np.diff(first_word)[copies])[order]
        edges = np.zeros(len(bounds), np.int32)
        np.add.at(edges, first_word[rows] + starts, 1)
        np.add.at(edges, first_word[rows] + ends, -1)
        keep = np.cumsum(edges[:-1]) == 0
        sizes = np.diff(bounds)
        kept = spaced[np.repeat(keep, sizes)].tobytes()
        cut = np.append(0, np.cumsum(np.where(keep, sizes, 0)))[first_word].tolist()
        n_words, n_kept = np.diff(first_word), np.diff(np.append(0, np.cumsum(keep))[first_word])
        copied = np.asarray(table.column("copied").fill_null(-1))
        n_words = np.where(copied >= 0, copied, n_words)
        first = np.searchsorted(rows, np.arange(len(ids) + 1))
        pairs = [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())]
        spans = [[{"start": 0, "end": n}] if n >= 0 else pairs[a:b] for a, b, n in zip(first, first[1:], copied.tolist())]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=null),
            "n_words": pa.array(n_words.astype(np.int64)),
            "n_removed": pa.array((n_words - n_kept).astype(np.int64)),
            "kept": pa.array([kept[a : max(a, b - 1)].decode() for a, b in zip(cut, cut[1:])], pa.string()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    def covers(text: str) -> int:
        n = len(_WORD.findall(text))
        return n if n >= window else -1

    return repeats.repeated(docs, window, min(GRAM, window), repeats.word_units, covers, True, lambda c, _: _search(c, window), finish, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:bigint,end:bigint>>", id_col, text_col, hot)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
