"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaf of a position holds (rank of the pair that starts there, position); an inner node holds the
smaller of its two children. The root is thus the leftmost pair of lowest rank. A merge changes at
most three leaves, each updated along its path to the root in logarithmic time, and a word is done
when its root says that no pair can be merged. The trees of many words of like length are the rows of
one array, so that a step over all of them is a few numpy operations inside an Arrow batch.
"""

from __future__ import annotations

import gc
import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import released, texts

_NONE = np.int64(1) << np.int64(62)
#: The white space of the vocabulary's normaliser (Unicode White_Space).
_WHITE = r"\t-\r \x85\xa0  -     　"
#: Rows of trees in one array hold at most this many cells.
_CELLS = 1 << 21
#: Words that a task remembers before it starts afresh.
_REMEMBERED = 300_000
_SLICE = 2 << 20


def _byte_symbols() -> list[str]:
    """The visible character of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(0x100 + rest.index(b)) for b in range(256)]


class Vocabulary:
    """A ``tokenizers`` BPE file with a word-end suffix: symbols, pair ranks, normaliser and pre-tokeniser.

    Only what the operator needs is read: NFC, white space to one space, lower case; split by the file's
    pattern; byte-level symbols; merges by rank. Other kinds of files are refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or spec["decoder"] is not None or model["unk_token"] is not None or model["continuing_subword_prefix"] is not None:
            raise ValueError("not a byte-level BPE file with lower-case words and a word-end suffix")
        vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"].replace(r"\s", _WHITE))
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.white = regex.compile(f"[{_WHITE}]+")
        symbols = _byte_symbols()
        self.inner = np.array([vocab.get(c, -1) for c in symbols], np.int64)
        self.final = np.array([vocab.get(c + self.suffix, -1) for c in symbols], np.int64)
        self.tokens = {i: t for t, i in (vocab | self.specials).items()}
        self.size = max(self.tokens) + 2
        keys, merged = [], []
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            keys.append(vocab[left] * self.size + vocab[right])
            merged.append(vocab[left + right])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pairs, self.ranks, self.merged = np.array(keys, np.int64)[order], order.astype(np.int64), np.array(merged, np.int64)
        # a direct table of slots keeps the search for a pair to a few steps
        self.mask = np.int64((1 << 19) - 1)
        self.slots = np.full(int(self.mask) + 1, -1, np.int64)
        todo, shift = np.arange(len(self.pairs)), 0
        while len(todo):
            at = (self._slot(self.pairs[todo]) + shift) & self.mask
            free = todo[self.slots[at] < 0]
            self.slots[(self._slot(self.pairs[free]) + shift) & self.mask] = free
            todo = todo[self.slots[at] != todo]
            shift += 1
        self.probes = shift

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, or _NONE."""
        keys = left * self.size + right
        out = np.full(len(keys), _NONE)
        at, todo = self._slot(keys), np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.probes):
            slot = self.slots[at[todo] & self.mask]
            hit = (slot >= 0) & (self.pairs[slot] == keys[todo])
            out[todo[hit]] = self.ranks[slot[hit]]
            todo = todo[(slot >= 0) & ~hit]
            if not len(todo):
                break
            at[todo] += 1
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _merge_rows(v: Vocabulary, symbols: np.ndarray) -> None:
    """Merge the rows of ``symbols`` (-1: none) in place, each by its own segment tree."""
    n, width = symbols.shape
    depth = width.bit_length() - 1
    kind = np.int32 if depth <= 13 else np.int64
    none = np.iinfo(kind).max
    bits = depth

    def leaves(ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(ranks < _NONE, (ranks << bits) | at, none).astype(kind)

    tree = np.full((n, 2 * width), none, kind)
    ranks = v.pair_ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
    tree[:, width : 2 * width - 1] = leaves(ranks, np.arange(width - 1))
    level = width // 2
    while level:
        np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2], out=tree[:, level : 2 * level])
        level //= 2
    after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
    before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
    after[np.arange(n), (symbols >= 0).sum(1) - 1] = width
    rows = np.flatnonzero(tree[:, 1] < none)
    while len(rows):
        root = tree[rows, 1].astype(np.int64)
        at = root & (width - 1)
        right = after[rows, at].astype(np.int64)
        here = v.merged[root >> bits]
        symbols[rows, at] = here
        symbols[rows, right] = -1
        follow = after[rows, right].astype(np.int64)
        after[rows, at] = follow
        back = follow < width
        before[rows[back], follow[back]] = at[back]
        previous = before[rows, at].astype(np.int64)
        has = previous >= 0
        who, prior = rows[has], previous[has]
        ahead = np.where(back, symbols[rows, np.minimum(follow, width - 1)], -1)
        new = v.pair_ranks(np.concatenate([here, symbols[who, prior]]), np.concatenate([ahead, here[has]]))
        tree[rows, width + right] = none
        tree[rows, width + at] = leaves(new[: len(rows)], at)
        tree[who, width + prior] = leaves(new[len(rows) :], prior)
        for leaf, some in ((right, rows), (at, rows), (prior, who)):
            node = (width + leaf) >> 1
            for _ in range(depth):
                tree[some, node] = np.minimum(tree[some, 2 * node], tree[some, 2 * node + 1])
                node >>= 1
        rows = rows[tree[rows, 1] < none]


def encode_words(v: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of all pre-tokens (UTF-8 bytes), one after another, and the bounds of each."""
    lengths = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum(lengths) - lengths
    kept, counts = np.full(len(data), -1, np.int64), np.zeros(len(words), np.int64)
    widths = np.where(lengths <= 4, 4, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
    for width in np.unique(widths[lengths > 0]).tolist():
        members = np.flatnonzero((widths == width) & (lengths > 0))
        step = max(1, _CELLS // width)
        for k in range(0, len(members), step):
            some = members[k : k + step]
            size = lengths[some]
            filled = np.arange(width) < size[:, None]
            where = (starts[some][:, None] + np.arange(width))[filled]
            symbols = np.full((len(some), width), -1, np.int64)
            symbols[filled] = v.inner[data[where]]
            symbols[np.arange(len(some)), size - 1] = v.final[data[starts[some] + size - 1]]
            _merge_rows(v, symbols)
            kept[where] = symbols[filled]
            counts[some] = (symbols >= 0).sum(1)
    return kept[kept >= 0], np.append(0, np.cumsum(counts))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i] .. starts[i] + lengths[i] - 1 of all i, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Encodes texts as the vocabulary's library does, without special tokens of its own, and decodes again.

    ``known`` numbers the pieces (runs without white space) seen so far; ``flat`` and ``bounds`` hold
    their ids. Once too many are known, they are forgotten before the next batch.
    """

    def __init__(self, path: str):
        self.v = vocabulary(path)
        names = [self.v.tokens.get(i, "").encode() + b" " for i in range(max(self.v.tokens) + 1)]
        self.name_lengths = np.array([len(x) for x in names], np.int64)
        self.name_starts = np.cumsum(self.name_lengths) - self.name_lengths
        self.names = np.frombuffer(b"".join(names), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str | tuple[str], int] = {(name,): k for k, name in enumerate(self.v.specials)}
        self.flat = np.array(list(self.v.specials.values()), np.int64)
        self.bounds = np.arange(len(self.v.specials) + 1)

    def _learn(self, new: list[str]) -> None:
        """Number new pieces and keep their ids."""
        findall = self.v.pattern.findall
        tokens = [[p] if p.isalpha() else findall(p) for p in new]
        number: dict[str, int] = {}
        which = np.array([number.setdefault(t, len(number)) for found in tokens for t in found], np.int64)
        counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
        flat, bounds = encode_words(self.v, [t.encode() for t in number])
        sizes = np.diff(bounds)[which]
        per_piece = np.diff(np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))])
        for k, piece in enumerate(new, len(self.known)):
            self.known[piece] = k
        self.flat = np.concatenate([self.flat, flat[ranges(bounds[which], sizes)]])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(per_piece)])

    def _pieces(self, text: str) -> list[str | tuple[str]]:
        """A text's pieces: special tokens of the raw text, and normalised runs without white space between them."""
        if self.v.special and "<" in text:
            cut = self.v.special.split(text)
            if len(cut) > 1:
                return [p for k, x in enumerate(cut) for p in ([(x,)] if k % 2 else self._plain(x))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # each character by itself becomes lower case: a final sigma is not special
        text = text.replace("Σ", "σ").lower()
        # str.split() also splits at four control characters that aren't white space here
        odd = "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
        return [p for p in self.v.white.split(text) if p] if odd else text.split()

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and each text's bounds."""
        if len(self.known) > _REMEMBERED:
            self._forget()
        pieces, counts = [], []
        for text in batch:
            found = self._pieces(text)
            counts.append(len(found))
            pieces += found
        new = [p for p in dict.fromkeys(pieces) if p not in self.known]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        sizes = np.diff(self.bounds)[at]
        ids = self.flat[ranges(self.bounds[at], sizes)]
        return ids, np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts, dtype=np.int64))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all decoded texts (tokens joined by one space), one after another, and each text's bounds."""
        lengths = self.name_lengths[ids].copy()
        some = bounds[1:] > bounds[:-1]
        lengths[bounds[1:][some] - 1] -= 1  # no space after a text's last token
        return self.names[ranges(self.name_starts[ids], lengths)], np.append(0, np.cumsum(lengths))[bounds]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string): every whole text's token ids (little-endian uint32) and their decoded text.

    ``path`` names the vocabulary file, which must be at the same place on all executors (it is part of
    an installed package). A null or empty text has no ids and decodes to the empty text; repeated rows
    give repeated results; a null id stays null; other columns are not read. The work is a map: no
    exchange, and a batch's texts are the most that a task holds. A piece without blanks is encoded whole, whatever its
    length, in time and memory in proportion to it (some 18 s for 40,000 different letters). An empty table gives an empty table.
    """
    path = os.fspath(path or default_path())

    def run(batches):
        gc.disable()  # millions of remembered tuples, none of them in a cycle
        encoder = Encoder(path)
        for batch in batches:
            ids, text = batch.column(0), batch.column(1)
            lengths = np.maximum(1, np.asarray(pa.compute.binary_length(text)))
            bounds = np.append(0, np.cumsum(lengths))
            first = 0
            while first < len(text):
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + _SLICE, side="right")) - 1)
                last = min(last, len(text))
                tokens, at = encoder.encode(text.slice(first, last - first).to_pylist())
                decoded, ends = encoder.decode(tokens, at)
                packed = pa.py_buffer(tokens.astype("<u4"))
                columns = [ids.slice(first, last - first), pa.Array.from_buffers(pa.large_binary(), last - first, [None, pa.py_buffer(4 * at), packed]), pa.Array.from_buffers(pa.large_string(), last - first, [None, pa.py_buffer(ends), pa.py_buffer(decoded)])]
                columns[1:] = [columns[1].cast(pa.binary()), columns[2].cast(pa.string())]
                yield released(pa.record_batch(columns, names=["doc_id", "ids", "decoded"]))
                first = last

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    """The digest columns of encoded documents."""
    return encoded.select("doc_id", F.expr("cast(length(ids) / 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
