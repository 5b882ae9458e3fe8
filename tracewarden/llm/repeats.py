"""Routing of repeated content: equal windows of all documents meet in the same shard.

A window is W consecutive units (bytes or words) of one row. Its anchor is its leftmost smallest gram
of m units, so equal windows have equal anchors. Chunks first ask how often each of their anchors occurs
(``common.counted``); anchors that occur once can't hold a repeated window and go no further. The rest
send their run of windows as one *segment* to the anchor's shard: each distinct segment of a chunk once, with
its smallest place in the chunk, packed (``packed_rows``). All visits are one job: the text and the anchors are written to
one exchange each, which every visit reads. So a passage that a third of all rows hold is one entry a chunk. An anchor with more than
``HOT`` occurrences is dealt by whole windows instead, so that many segments around one anchor don't fill a shard.

A shard answers for each entry whether the segment stands earlier elsewhere, or else which windows in it do; it
only has to search where several different segments share an anchor, and works through its entries in slices by anchor, so
its memory doesn't follow what it is sent. The last visit of a chunk finds its segments again and
applies the answers to all their places.

Whole copies are settled on the way (``dealt``). Copies within one batch of the input are settled before the exchange
(``common.first_of_batch``); of what is left, equal texts meet in as many chunks as the root of the number of chunks, chosen by
their document, and only the first row of a text in each of them sends anything. So the copies of one text in a chunk, and the chunks that
send its segments, both grow with the root of the input. Settled rows, and texts that are too short for a window, meet nobody and are
dealt evenly. (Rows of one long text that all lack an id are dealt alike, to one chunk.)

Equal segments are decided by comparing them (in a chunk, after a digest; in a shard, through a dictionary of their bytes), different ones
that share an anchor by the shard's index.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import common

#: Occurrences of an anchor from which its windows are dealt one by one.
HOT = 2000
#: Bytes of segments that a shard works on at once.
SLICE_BYTES = 4 << 20
_PIECE = 1 << 19
_LENGTH = np.uint64(0xD6E8FEB86659FD93)

#: Shards that keep a small cluster busy: no fewer while there are as many chunks.
SHARDS = 64
#: Bytes of a row's segments from which they are compressed.
PACK_BYTES = 256

SEGMENTS_SCHEMA = "shard int, chunk int, blob binary, numbers binary, keys binary"
#: Answers to a chunk: kind 0 what its anchors' totals are (number: the part), kind 1 what a shard (number) found.
ANSWERS_SCHEMA = "chunk int, kind int, number int, totals binary, later binary, owners binary, firsts binary, lasts binary"


@dataclass
class Units:
    """The units of a chunk's rows: row bounds, hash values by range, all bytes, and the byte bounds of runs of units."""

    offsets: np.ndarray
    values: Callable[[int, int], np.ndarray]
    data: np.ndarray
    bounds: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def byte_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(offsets, lambda a, b: common.BYTE_VALUES[data[a:b]], data, lambda first, end: (first, end))


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows with one space after each: (bytes, start of each word and the end, first word of each row)."""
    starts, ends, rows = common.word_bounds(data, offsets)
    lengths = ends - starts
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # a row's word may start where the last row's word ends
    again = starts[1:][starts[1:] == ends[:-1]] if len(starts) else starts
    inside[again] = 0
    plain = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    spaced = np.insert(plain, np.cumsum(lengths), 0x20)
    return spaced, np.append(0, np.cumsum(lengths + 1)), rows


def word_units(data: np.ndarray, offsets: np.ndarray) -> Units:
    spaced, bounds, rows = spaced_words(data, offsets)

    def values(a: int, b: int) -> np.ndarray:
        first = bounds[a]
        return common.word_hashes(spaced[first : bounds[b]], bounds[a:b] - first, bounds[a + 1 : b + 1] - 1 - first)

    return Units(rows, values, spaced, lambda first, end: (bounds[first], bounds[end] - 1))


def _word_sizes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = [np.diff(common.word_bounds(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])[2]) for a, b in common.slices(offsets)]
    return np.concatenate([np.zeros(0, np.int64), *found])


#: How many units each row has.
SIZES = {byte_units: lambda data, offsets: np.diff(offsets), word_units: _word_sizes}


def pieces(offsets: np.ndarray, window: int):
    """Ranges of units to work on at once, with the rows in them: (start, end, row bounds from start, rows).

    Rows of up to _PIECE units stay whole; a longer row comes in pieces that overlap by window - 1 units.
    """
    for first, last in common.slices(offsets, _PIECE):
        if last - first > 1 or offsets[last] - offsets[first] <= 2 * _PIECE:
            yield int(offsets[first]), int(offsets[last]), offsets[first : last + 1] - offsets[first], np.arange(first, last)
            continue
        for a in range(int(offsets[first]), int(offsets[last]) - window + 1, _PIECE):
            b = min(int(offsets[last]), a + _PIECE + window - 1)
            yield a, b, np.array([0, b - a], np.int64), np.array([first])


def segments(units: Units, window: int, gram: int, skip: np.ndarray | None = None, digests: bool = False) -> tuple[np.ndarray, ...]:
    """(row, first unit, end unit, anchor key) of every run of windows with the same anchor, and with ``digests`` a
    hash of its units; units count from the chunk's start. Rows in ``skip`` have none."""
    found = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * (1 + digests)]
    for a, b, offsets, rows in pieces(units.offsets, window):
        if b - a < window:
            continue
        values = units.values(a, b)
        grams = common.gram_hashes(values, gram)
        firsts, ends, at = common.anchors(grams, offsets, window, gram)
        ends = ends + window - 1
        row, key = rows[np.searchsorted(offsets, firsts, side="right") - 1], common.mix(grams[at] ^ _LENGTH)  # smallest grams are small: spread them
        if skip is not None:
            keep = ~skip[row]
            row, firsts, ends, key = row[keep], firsts[keep], ends[keep], key[keep]
        columns = [row, firsts + a, ends + a, key]
        if digests:
            powers, inverse = common._power_tables(len(values) + 1)
            prefix = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * powers[: len(values)], out=prefix[1:])
            columns.append(common.mix((prefix[ends] - prefix[firsts]) * inverse[firsts] + (ends - firsts).astype(np.uint64) * _LENGTH))
        found.append(tuple(columns))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _windows_of(units: Units, window: int, firsts: np.ndarray) -> np.ndarray:
    """The hash of the window at each of the sorted positions."""
    out = np.zeros(len(firsts), np.uint64)
    for a, b, _, _ in pieces(units.offsets, window):
        lo, hi = np.searchsorted(firsts, a), np.searchsorted(firsts, b - window, side="right")
        if hi > lo:
            out[lo:hi] = common.gram_hashes(units.values(a, b), window)[firsts[lo:hi] - a]
    return out


def _differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray, block: int = 1 << 15) -> np.ndarray:
    """Whether the ``sizes`` bytes from each a differ from those from b."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), block):
        n = sizes[k : k + block]
        bad = data[common.spans(a[k : k + block], a[k : k + block] + n)] != data[common.spans(b[k : k + block], b[k : k + block] + n)]
        out[k : k + block] = np.add.reduceat(bad, np.cumsum(n) - n) > 0 if len(bad) else False
    return out


@dataclass
class Places:
    """A chunk's repeated segments. Entry e, in the order in which entries are sent (by shard and first place), goes to ``shard[e]`` under
    ``key[e]`` and first stands at place ``lead[e]``; place p holds entry ``which[p]``: units first[p] to end[p] of row[p]."""

    shard: np.ndarray
    key: np.ndarray
    lead: np.ndarray
    which: np.ndarray
    row: np.ndarray
    first: np.ndarray
    end: np.ndarray


def repeated_places(units: Units, skip: np.ndarray, flags: pa.Table, window: int, gram: int, shards: int) -> Places:
    """The segments of a chunk whose anchors occur more than once anywhere, with equal ones as one entry."""
    row, first, end, key, digest = segments(units, window, gram, skip, digests=True)
    uniq, back = np.unique(key, return_inverse=True)
    level = common.totals_of(flags, len(uniq), np.uint8)[back]
    hot = np.flatnonzero(level > 1)
    if len(hot):  # their windows one by one, by hashes of their own
        hot = hot[np.argsort(first[hot], kind="stable")]
        count = end[hot] - first[hot] - window + 1
        at = common.spans(first[hot], first[hot] + count)
        own = _windows_of(units, window, at)
        cold = np.flatnonzero(level == 1)
        row, first, end = np.append(row[cold], np.repeat(row[hot], count)), np.append(first[cold], at), np.append(end[cold], at + window)
        key, digest = np.append(key[cold], own), np.append(digest[cold], own)
    else:
        cold = np.flatnonzero(level == 1)
        row, first, end, key, digest = row[cold], first[cold], end[cold], key[cold], digest[cold]
    shard = common.parts_of(key, shards)
    low, high = units.bounds(first, end)
    sizes = high - low
    while True:
        order = np.lexsort((first, digest, shard))
        new = np.append(True, (digest[order][1:] != digest[order][:-1]) | (shard[order][1:] != shard[order][:-1]))[: len(order)]
        lead = order[new]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        leader = lead[which]
        again = np.flatnonzero(leader != np.arange(len(leader)))
        odd = again[sizes[again] != sizes[leader[again]]]
        again = again[sizes[again] == sizes[leader[again]]]
        odd = np.append(odd, again[_differing(units.data, low[again], low[leader[again]], sizes[again])])
        if not len(odd):
            sent = np.lexsort((first[lead], shard[lead]))
            rank = np.empty(len(sent), np.int64)
            rank[sent] = np.arange(len(sent))
            lead = lead[sent]
            return Places(shard[lead], key[lead], lead, rank[which], row, first, end)
        digest[odd] = common.mix(digest[odd] + np.uint64(1))  # equal hashes of different bytes


def later_copies(ids: np.ndarray, text: pa.Array, equal_ids: bool) -> np.ndarray:
    """Rows (sorted by id) whose text another row of the chunk has under a smaller id, or under an equal one before it."""
    codes = np.asarray(text.dictionary_encode().indices)
    _, first, back = np.unique(codes, return_index=True, return_inverse=True)
    lead = first[back]
    return (ids > ids[lead]) | (equal_ids & (lead < np.arange(len(ids))))


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values (64 bits, taken as unsigned) in seven bits a byte, the last byte below 128: (bytes, number of bytes of each)."""
    values = values.astype(np.uint64)
    lengths, rest = np.ones(len(values), np.int64), values >> np.uint64(7)
    while rest.any():
        lengths += rest > 0
        rest >>= np.uint64(7)
    at = np.cumsum(lengths) - lengths
    out = np.empty(int(lengths.sum()), np.uint8)
    some, k = np.arange(len(values)), 0
    while len(some):
        more = lengths[some] > k + 1
        out[at[some] + k] = (values[some] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F | more.astype(np.uint8) << 7
        some, k = some[more], k + 1
    return out, lengths


def from_varints(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    at = np.append(0, ends[:-1] + 1)[: len(ends)]
    lengths = ends - at + 1
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(lengths.max(initial=0))):
        some = np.flatnonzero(lengths > k)
        out[some] |= (data[at[some] + k] & 0x7F).astype(np.uint64) << np.uint64(7 * k)
    return out


def _steps(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """What each value is above the one before; at cuts, the value itself."""
    out = values.astype(np.uint64)
    out[1:] -= out[:-1].copy()
    out[cuts] = values[cuts].astype(np.uint64)
    return out


def packed_rows(chunk: int, units: Units, ids: np.ndarray, places: Places) -> pa.Table:
    """One row for each shard with entries: their bytes (compressed where that helps), their anchors, and as varints of each entry
    its size and what its smallest place, as document and position, is above that of the entry before (places ascend, and so do documents)."""
    lead = places.lead
    low, high = units.bounds(places.first[lead], places.end[lead])
    cuts = np.flatnonzero(np.append(True, places.shard[1:] != places.shard[:-1])) if len(lead) else lead
    bounds = np.append(cuts, len(lead))
    numbers, lengths = varints(np.stack([high - low, _steps(ids[places.row[lead]], cuts).view(np.int64), _steps(places.first[lead], cuts).view(np.int64)], 1).ravel())
    ends = np.append(0, np.cumsum(lengths))[3 * bounds].tolist()
    keys = places.key.astype(np.uint32)
    codec, bounds = pa.Codec("zstd", compression_level=1), bounds.tolist()
    blobs = []
    for a, b in zip(bounds, bounds[1:]):
        blob = units.data[common.spans(low[a:b], high[a:b])].tobytes()
        small = codec.compress(blob, asbytes=True) if len(blob) >= PACK_BYTES else blob
        blobs.append(small if len(small) < len(blob) else blob)
    return pa.table({
        "shard": pa.array(places.shard[cuts].astype(np.int32)), "chunk": pa.array(np.full(len(cuts), chunk, np.int32)), "blob": pa.array(blobs, pa.binary()),
        "numbers": pa.array([numbers[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()), "keys": pa.array([keys[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
    })


def unpacked_rows(table: pa.Table) -> pa.Table:
    """The rows of ``packed_rows`` with plain cells: bytes, sizes, anchors, documents and places."""
    keys = table.column("keys")
    counts = np.array([len(x.as_buffer()) // 4 for x in keys], np.int64)
    bounds = np.append(0, np.cumsum(counts))
    numbers = from_varints(np.frombuffer(b"".join(table.column("numbers").to_pylist()), np.uint8)).reshape(-1, 3)
    sizes = numbers[:, 0].astype(np.int32)
    sums = [np.cumsum(numbers[:, k], dtype=np.uint64) for k in (1, 2)]
    heads = bounds[:-1]  # no row is without entries
    docs, places = (x - np.repeat(x[heads] - numbers[heads, k], counts) for k, x in zip((1, 2), sums))
    columns = {"sizes": sizes, "docs": docs.view(np.int64), "places": places.astype(np.int32)}
    codec = pa.Codec("zstd")
    blobs = [x.as_buffer() for x in table.column("blob")]
    plain = np.add.reduceat(sizes, heads, dtype=np.int64).tolist()
    blobs = [x.to_pybytes() if x.size == n else codec.decompress(x, n, asbytes=True) for x, n in zip(blobs, plain)]
    cells = {n: pa.array([c[a:b].tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())], pa.binary()) for n, c in columns.items()}
    return pa.table({"shard": table.column("shard"), "chunk": table.column("chunk"), "blob": pa.array(blobs, pa.binary()), "keys": keys} | cells)


def _cell(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def shard_answers(table: pa.Table, search: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, ...]], equal_ids: bool, most: int = SLICE_BYTES) -> pa.Table:
    """What a shard says to each of its chunks: a byte for each entry (1: the segment stands earlier elsewhere), and
    runs of units (entry, first, last) of the others that are repeated.

    ``search`` gets different segments that share anchors, in the order of their first places, with the documents
    of those, and returns runs (segment, first, last).
    """
    numbers = table.column("chunk").to_numpy()
    blobs = [x.as_buffer() for x in table.column("blob")]
    sizes, keys, docs, places = ([np.frombuffer(x.as_buffer(), kind) for x in table.column(n)] for n, kind in (("sizes", np.int32), ("keys", np.uint32), ("docs", np.int64), ("places", np.int32)))
    starts = np.concatenate([np.cumsum(x, dtype=np.int64) - x for x in sizes])
    counts = np.array([len(x) for x in sizes], np.int64)
    base = np.append(0, np.cumsum(counts))
    home = np.repeat(np.arange(len(counts)), counts)
    sizes, keys, docs, places = (np.concatenate(x) for x in (sizes, keys, docs, places))
    slices = max(1, -(-int(sizes.sum(dtype=np.int64)) // most))
    turn = (keys.astype(np.uint64) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)
    later = np.zeros(len(sizes), np.uint8)
    none = np.zeros(0, np.int64)
    runs = [(none, none, none)]
    for k in range(slices):
        mine = np.flatnonzero(turn == k) if slices > 1 else np.arange(len(sizes))
        known: dict[bytes, int] = {}
        which = np.fromiter((known.setdefault(bytes(blobs[r][a : a + n]), len(known)) for r, a, n in zip(home[mine].tolist(), starts[mine].tolist(), sizes[mine].tolist())), np.int64, len(mine))
        order = np.lexsort((places[mine], numbers[home[mine]], docs[mine]))
        _, first = np.unique(which[order], return_index=True)
        lead = order[first]  # of each segment, its first place
        if equal_ids:
            after = np.ones(len(mine), bool)
            after[lead] = False
        else:
            after = docs[mine] > docs[mine][lead[which]]
        later[mine] = after
        _, back, n = np.unique(keys[mine][lead], return_inverse=True, return_counts=True)
        some = np.flatnonzero(n[back] > 1)
        if not len(some):
            continue
        some = some[np.argsort(first[some])]
        names = list(known)
        owner, a, b = search([names[i] for i in some.tolist()], docs[mine][lead[some]])
        if not len(owner):
            continue
        # runs of a segment go to all entries that hold it and aren't later
        order = np.argsort(owner, kind="stable")
        owner, a, b = some[owner[order]], a[order], b[order]
        order = np.argsort(owner, kind="stable")
        owner, a, b = owner[order], a[order], b[order]
        at = np.flatnonzero(~after)
        lo, hi = np.searchsorted(owner, which[at]), np.searchsorted(owner, which[at], side="right")
        run = common.spans(lo, hi)
        runs.append((np.repeat(mine[at], hi - lo), a[run], b[run]))
    entry, a, b = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(entry, kind="stable")
    entry, a, b = entry[order], a[order], b[order]
    cut = np.searchsorted(entry, base)
    parts = [slice(x, y) for x, y in zip(cut, cut[1:])]
    n = len(counts)
    empty = pa.nulls(n, pa.binary())
    return pa.table({
        "chunk": table.column("chunk"), "kind": pa.array(np.ones(n, np.int32)), "number": table.column("shard"), "totals": empty,
        "later": _cell([later[x:y] for x, y in zip(base, base[1:])]),
        "owners": _cell([(entry[p] - base[k]).astype(np.int32) for k, p in enumerate(parts)]),
        "firsts": _cell([a[p].astype(np.int32) for p in parts]),
        "lasts": _cell([b[p].astype(np.int32) for p in parts]),
    })


def applied(found: pa.Table, places: Places, ids: np.ndarray, offsets: np.ndarray, equal_ids: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The repeated units of a chunk, from the shards' answers to its entries: (row, start, end) within rows."""
    found = found.sort_by("number")
    later, owners, firsts, lasts = ([np.frombuffer(x.as_buffer(), kind) for x in found.column(n)] for n, kind in (("later", np.uint8), ("owners", np.int32), ("firsts", np.int32), ("lasts", np.int32)))
    none = np.zeros(0, np.int64)
    base = np.append(0, np.cumsum([len(x) for x in later])).astype(np.int64)
    if base[-1] != len(places.lead):
        raise ValueError(f"a chunk sent {len(places.lead)} segments and got {base[-1]} answers")
    if not len(places.lead):
        return none, none, none
    later = np.concatenate(later) > 0
    owner = np.concatenate([x + base[k] for k, x in enumerate(owners)])
    a, b = np.concatenate(firsts).astype(np.int64), np.concatenate(lasts).astype(np.int64)
    which, lead = places.which, places.lead[places.which]
    if equal_ids:
        own = np.arange(len(which)) == lead
    else:
        own = ids[places.row] == ids[places.row[lead]]
    whole = np.flatnonzero(later[which] | ~own)
    at = np.flatnonzero(~later[which] & own)
    lo, hi = np.searchsorted(owner, which[at]), np.searchsorted(owner, which[at], side="right")
    run = common.spans(lo, hi)
    at = np.repeat(at, hi - lo)
    row = np.append(places.row[whole], places.row[at])
    starts = np.append(places.first[whole], places.first[at] + a[run]) - offsets[row]
    ends = np.append(places.end[whole], places.first[at] + b[run]) - offsets[row]
    return row, starts, ends


def by_row(rows: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals merged within rows: (row, start, end), sorted."""
    if not len(rows):
        return rows, starts, ends
    width = int(ends.max()) + 2  # rows as separate stretches of one line
    a, b = common.merged_spans(rows * width + starts, rows * width + ends)
    return a // width, a % width, (b - a) + a % width


def shards_for(chunks: int, parts: int) -> int:
    """As few shards as parts, so that a chunk's row for a shard still holds several segments where there are many chunks; as many as chunks in small tables."""
    return min(chunks, max(parts, SHARDS))


def dealt(docs: DataFrame, covers: Callable[[str], int], equal_ids: bool, units: Callable[[np.ndarray, np.ndarray], Units], window: int, chunks: int, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows with ``copied`` and the chunk of each (see above); no text, id or emptiness makes a chunk large."""
    told = common.first_of_batch(common.texts(docs, id_col, text_col, carry), covers, equal_ids, SIZES[units], window)
    meeting = f"xxhash64(xxhash64(text), pmod(xxhash64(doc_id), {max(1, isqrt(chunks))}))"
    return told.withColumn("chunk", F.expr(f"cast(pmod(coalesce(dealt, {meeting}), {chunks}) as int)")).drop("dealt")


def repeated(docs: DataFrame, window: int, gram: int, units: Callable[[np.ndarray, np.ndarray], Units], covers: Callable[[str], int], equal_ids: bool, search: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, ...]], finish: Callable[[pa.Table, np.ndarray, tuple], pa.Table], schema: str, id_col: str, text_col: str, hot: int = HOT, carry: tuple[str, ...] = (), most: int = SLICE_BYTES) -> DataFrame:
    """The three visits of the chunks: count anchors, send segments, apply what ``search`` found in each shard.

    ``covers`` gives the units of a text whose whole copies are removed, or -1; ``equal_ids`` tells whether a row counts as earlier
    than a later row with the same id. ``finish`` gets the chunk's rows, sorted, which of them are whole later
    copies within the chunk, and the intervals by row; rows that were settled before the exchange have ``copied``.
    """
    number, parts = common.groups_of(docs, text_col)
    shards = shards_for(number, parts)
    chunks = dealt(docs, covers, equal_ids, units, window, number, id_col, text_col, carry)

    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        ids, _, text, data, offsets = common.ordered_rows(table)
        *_, key = segments(units(data, offsets), window, gram, later_copies(ids, text, equal_ids))
        keys, counts = np.unique(key, return_counts=True)
        return common.keys_table(chunk, keys, counts, parts)

    def route(key: tuple, table: pa.Table, flags: pa.Table) -> pa.Table:
        ids, _, text, data, offsets = common.ordered_rows(table)
        all_units = units(data, offsets)
        places = repeated_places(all_units, later_copies(ids, text, equal_ids), flags, window, gram, shards)
        return common.released(packed_rows(key[0].as_py(), all_units, ids, places))

    def look(table: pa.Table) -> pa.Table:
        return common.released(shard_answers(unpacked_rows(table), search, equal_ids, most))

    def end(_key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table = common.sorted_rows(table)
        ids, _, text, data, offsets = common.ordered_rows(table)
        whole = later_copies(ids, text, equal_ids)
        kinds = answers.column("kind").to_numpy()
        flags = answers.filter(pa.array(kinds == 0)).select(["number", "totals"]).rename_columns(["part", "totals"])
        all_units = units(data, offsets)
        places = repeated_places(all_units, whole, flags, window, gram, shards)
        found = by_row(*applied(answers.filter(pa.array(kinds == 1)), places, ids, all_units.offsets, equal_ids))
        del places
        verdict: dict[str, int] = {}
        for row in np.flatnonzero(whole).tolist():
            cell = text[row].as_py()
            if cell not in verdict:
                verdict[cell] = covers(cell)
            whole[row] = verdict[cell] >= 0
        return common.released(finish(table, whole, found))

    by_chunk = chunks.groupBy("chunk")
    totals = common.counted(chunks, send, (1, hot))  # asked for twice from one exchange of the keys: a table in between would write the text to a second one
    routed = by_chunk.cogroup(totals.groupBy("chunk")).applyInArrow(route, SEGMENTS_SCHEMA)
    found = routed.groupBy("shard").applyInArrow(look, ANSWERS_SCHEMA)
    none = F.lit(None).cast("binary")
    answers = found.unionByName(totals.select("chunk", F.lit(0).alias("kind"), F.col("part").alias("number"), "totals", *[none.alias(n) for n in ("later", "owners", "firsts", "lasts")]))
    return by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(end, schema)
