"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words, such as ``1110111``: the hash of the words at its ones
ignores the words at its zeros, so that a hit survives a substituted word there. Seeds of the benchmark
and of the training documents are joined on (mask, hash). Around each hit the two word sequences are laid
on each other and the stretch with the most matches at the allowed rate of substitutions is verified.

The benchmark's seeds also set the bits of a filter of bounded size that goes to every task; a document
position whose seed finds no bit can't hit and is not shuffled. The filter only saves work: hits are found
by the join, which has no bound.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import common

#: The masks. The first finds exact runs; the others step over substitutions.
MASKS = ("11111", "110111", "1110111", "11011011")
#: Bits of the filter for each seed of the benchmark, and the most it may have (32 MB).
FILTER_BITS, FILTER_MOST = 256, 1 << 28
#: The most bytes of a benchmark table that a join broadcasts, and the salts of its keys beyond.
SMALL, SALTS = 16 << 20, 16
_PARTITIONS = 16
_WORDS = np.zeros(256, bool)
_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def normal_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the rows and the rows' bounds. Words are runs of ASCII letters and digits and of all
    non-ASCII characters; upper case A-Z and of the Latin-1 block becomes lower case."""
    data = common.lowered(data)
    if len(data) > 1:
        after = np.flatnonzero(data[:-1] == 0xC3) + 1
        second = data[after]
        data[after] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 32, second)
    blank = np.where(_WORDS[data], data, np.uint8(0x20))
    starts, ends, rows = common.word_bounds(blank, offsets)
    return common.word_hashes(blank, starts, ends), rows


def seed_hashes(words: np.ndarray, mask: str, number: int) -> np.ndarray:
    """The hash of the words under the mask's ones at each position where the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return words[:0]
    out = np.full(n, np.uint64(number + 1))
    for k, bit in enumerate(mask):
        if bit == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return common.mix(out)


def _seeds(words: np.ndarray, rows: np.ndarray):
    """(row, position in the row, seed hash) arrays of every mask; no seed crosses a row's end."""
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    for number, mask in enumerate(MASKS):
        found = seed_hashes(words, mask, number)
        at = np.flatnonzero(row_of[: len(found)] == row_of[len(mask) - 1 : len(mask) - 1 + len(found)]) if len(found) else np.zeros(0, np.int64)
        yield row_of[at], at - rows[row_of[at]], found[at]


def best_stretch(a: np.ndarray, b: np.ndarray, penalty: int = 3) -> tuple[int, int, int]:
    """(first, end, matches) of the stretch of two aligned sequences with the most matches among those that hold
    at most one substitution for ``penalty`` matches, judged over the whole stretch. (0, 0, 0) without a match."""
    same = a == b
    if not same.any():
        return 0, 0, 0
    total = np.append(0, np.cumsum(np.where(same, 1, -penalty)))
    count = np.append(0, np.cumsum(same))
    # the earliest start for each end: the first total that is not above the end's
    starts = np.searchsorted(-np.minimum.accumulate(total), -total)
    end = int(np.argmax(count - count[starts]))
    at = starts[end] + np.flatnonzero(same[starts[end] : end])
    return int(at[0]), int(at[-1]) + 1, len(at)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, words binary): the distinct word sequences, each under its smallest id."""

    def run(batches):
        for batch in batches:
            data, offsets = common.utf8_buffers(batch.column(1))
            words, rows = normal_words(data, offsets)
            yield pa.record_batch([batch.column(0), pa.array([words[a:b].tobytes() for a, b in zip(rows, rows[1:])], pa.binary())], names=["doc_id", "words"])

    found = common.texts(benchmark, item_col, text_col).filter("doc_id is not null").mapInArrow(run, "doc_id long, words binary")
    return found.groupBy("words").agg(F.min("doc_id").alias("item_id")).select("item_id", "words")


def _item_seeds(items: DataFrame, least: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            cells = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)]
            rows = np.append(0, np.cumsum([len(c) if len(c) >= least else 0 for c in cells])).astype(np.int64)
            words = np.concatenate([c for c in cells if len(c) >= least] or [np.zeros(0, np.uint64)])
            for row, at, found in _seeds(words, rows):
                yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(ids[row], pa.int64()), pa.array(at.astype(np.int32)), pa.array(np.diff(rows)[row].astype(np.int32))], names=["seed", "item_id", "at", "size"])

    return items.select("item_id", "words").mapInArrow(run, "seed long, item_id long, at int, size int")


def _probes(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each seed."""
    return seeds & np.uint64(bits - 1), (seeds >> np.uint64(34)) & np.uint64(bits - 1)


def _passing(table: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Positions of seeds whose two bits are set."""
    one, two = _probes(seeds, len(table))
    at = np.flatnonzero(table[one])
    return at[table[two[at]]]


def _filter(seeds: DataFrame, count: int) -> tuple[bytes, int]:
    """The filter's bits for ``count`` seeds, packed and compressed: one bitmap of bounded size from each of at most _PARTITIONS tasks."""
    bits = 1 << int(min(FILTER_MOST, max(1 << 16, FILTER_BITS * count)) - 1).bit_length()

    def run(batches):
        table = np.zeros(bits, bool)
        for batch in batches:
            for probe in _probes(np.asarray(batch.column(0)).view(np.uint64), bits):
                table[probe] = True
        yield pa.record_batch([pa.array([zlib.compress(np.packbits(table).tobytes(), 1)], pa.binary())], names=["bits"])

    whole = np.zeros(bits // 8, np.uint8)
    for row in seeds.select("seed").coalesce(_PARTITIONS).mapInArrow(run, "bits binary").toLocalIterator():
        whole |= np.frombuffer(zlib.decompress(row[0]), np.uint8)
    return zlib.compress(whole.tobytes(), 1), bits


REGIONS_SCHEMA = "doc_id long, start long, words binary, seeds array<bigint>, places array<bigint>"


def _regions(docs: DataFrame, packed: bytes, bits: int, longest: int) -> DataFrame:
    """Stretches of documents around positions whose seeds pass the filter, with their words and those seeds.

    A stretch reaches ``longest`` words (those of the longest item) beyond its outermost seeds, so that it holds all of any item laid on
    one of them; stretches that would overlap are one.
    """
    held = docs.sparkSession.sparkContext.broadcast(packed)  # at most FILTER_MOST / 8 bytes

    def run(batches):
        table = np.unpackbits(np.frombuffer(zlib.decompress(held.value), np.uint8)).astype(bool)
        for batch in batches:
            ids = batch.column(0)
            whole, bounds = common.utf8_buffers(batch.column(1))
            for first, last in common.slices(bounds):
                words, rows = normal_words(whole[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
                got = [(r, p, s) for r, p, s in ((r[k], p[k], s[k]) for r, p, s in _seeds(words, rows) for k in [_passing(table, s)])]
                row, at, seed = (np.concatenate(x) for x in zip(*got, strict=True))
                if not len(row):
                    continue
                order = np.lexsort((at, row))
                row, at, seed = row[order], at[order], seed[order]
                cuts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (at[1:] - at[:-1] > 2 * longest)))
                ends = np.append(cuts[1:], len(row))
                starts = np.maximum(0, at[cuts] - longest)
                stops = np.minimum(np.diff(rows)[row[cuts]], at[ends - 1] + longest)
                base = rows[row[cuts]]
                yield pa.record_batch([
                    ids.slice(first, last - first).take(pa.array(row[cuts])),
                    pa.array(starts.astype(np.int64)),
                    pa.array([words[b + s : b + e].tobytes() for b, s, e in zip(base.tolist(), starts.tolist(), stops.tolist())], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.append(cuts, len(row)).astype(np.int32)), pa.array(seed.view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(np.append(cuts, len(row)).astype(np.int32)), pa.array(at.astype(np.int64))),
                ], names=["doc_id", "start", "words", "seeds", "places"])

    return common.texts(docs).filter("doc_id is not null").mapInArrow(run, REGIONS_SCHEMA)


def _joined(spots: DataFrame, table: DataFrame, key: str, small: bool) -> DataFrame:
    """``spots`` (doc_id, start, ...) joined with a benchmark table on ``key``.

    A small table goes to every task, so no spot moves. A larger one stands under each of SALTS salts, so that
    the spots of a key that a third of all rows hold are dealt over as many tasks.
    """
    if small:
        return spots.join(F.broadcast(table), key)
    dealt = spots.withColumn("salt", F.expr(f"cast(pmod(xxhash64(doc_id, start), {SALTS}) as int)"))
    return dealt.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"]).drop("salt")


def contaminated(docs: DataFrame, benchmark: DataFrame, matches: int = 10, least: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", small: int = SMALL) -> DataFrame:
    """(doc_id, item_id, n_matched, first_word, end_word): documents that hold benchmark passages.

    A document holds an item when a stretch of its words, laid word by word on the item, has at least
    ``matches`` equal words (all words of an item with fewer), with at most one substitution for three
    matches in the stretch as a whole; the whole of what lies on the item is judged, however long. Each pair is reported once, with its best stretch in words of the document. Items with equal
    words count once, under the smallest id; items with fewer than ``least`` words are too short to be
    evidence and match nothing. Null texts are empty and match nothing; rows with a null id can't be
    reported and are left out; rows with equal ids count as one document. Other columns are not read; an
    empty table on either side gives an empty table. A benchmark table of at most ``small`` bytes is broadcast, a
    larger one joined under salted keys; the rows are the same. Writes intermediate tables to the shared folder.
    """
    renamed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items = common.written(_items(benchmark, item_col, item_text_col), "items")
    seeds = common.written(_item_seeds(items, least), "seeds")
    n_seeds, item_bytes = seeds.count(), items.agg(F.sum(F.octet_length("words") + 32)).first()[0] or 0
    longest = items.agg(F.max(F.octet_length("words") / 8).cast("int")).first()[0] or 0
    regions = common.written(_regions(renamed, *_filter(seeds, n_seeds), longest), "regions")
    spots = regions.select("doc_id", "start", F.explode(F.arrays_zip("seeds", "places")).alias("s")).selectExpr("doc_id", "start", "s.seeds as seed", "s.places as place")
    # a seed of a joined table takes some 64 bytes
    aligned = _joined(spots, seeds, "seed", 64 * n_seeds <= small).select("doc_id", "start", "item_id", F.expr("place - start - at").alias("shift"), "size").distinct()
    # rows with equal ids may have regions with equal starts: every one of them is tried. Only words that lie on the item go on
    laid = "substring(words, cast(8 * greatest(shift, 0) as int) + 1, cast(8 * greatest(least(shift + size, length(words) div 8) - greatest(shift, 0), 0) as int))"
    mine = aligned.join(regions.select("doc_id", "start", "words"), ["doc_id", "start"]).selectExpr("doc_id", "start", "item_id", "shift", f"{laid} AS mine")
    both = _joined(mine, items.withColumnRenamed("words", "theirs"), "item_id", item_bytes <= small)

    def verify(batches):
        for batch in batches:
            out = []
            for doc, start, item, shift, mine, theirs in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                a, b = np.frombuffer(mine, np.uint64), np.frombuffer(theirs, np.uint64)
                low = max(0, -shift)
                first, end, same = best_stretch(b[low : low + len(a)], a)
                if same >= min(matches, len(b)):
                    out.append((doc, item, same, start + low + shift + first, start + low + shift + end))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_matched", "first_word", "end_word"])

    hits = both.select("doc_id", "start", "item_id", "shift", "mine", "theirs").mapInArrow(verify, "doc_id long, item_id long, n_matched long, first_word long, end_word long")
    best = F.max(F.struct("n_matched", F.negative("first_word").alias("f"), F.negative("end_word").alias("e"))).alias("b")
    return hits.groupBy("doc_id", "item_id").agg(best).selectExpr("doc_id", "item_id", "b.n_matched", "-b.f as first_word", "-b.e as end_word")
