"""Suffix-array dedup: longest-previous-factor arrays over the repeated segments of all documents.

In a shard (see ``repeats``), the suffixes that start a window in segments that share an anchor are sorted by their first W bytes. In
that order, the previous and the next suffix of a smaller document are the only candidates for the
longest match in an earlier document, since the common prefix only shrinks with distance. Their common
prefixes give the longest previous factor, capped at W; where it reaches W, the window is a later copy.
The first copy stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.llm import common, repeats

#: Length of the grams that anchor windows: long enough to be rare, short enough for sparse anchors.
GRAM = 20


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` sorted by the ``depth`` bytes that follow each (all inside ``text``); ties by position."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    order = np.argsort(starts, kind="stable")
    for at in [depth - 8, *range((depth - 8) // 8 * 8 - (8 if depth % 8 == 0 else 0), -1, -8)] if depth >= 8 else [0]:
        word = np.zeros(len(starts), np.uint64)
        for k in range(min(8, depth)):
            word = (word << np.uint64(8)) | padded[starts + (at + k)]
        order = order[np.argsort(word[order], kind="stable")]
    return order


def nearest_smaller(values: np.ndarray, back: bool) -> np.ndarray:
    """For each position, the nearest one before (``back``) or after it with a smaller value; -1 or n where none.

    All positions jump at once along each other's candidates: everything between a position and its
    candidate is known not to be smaller, so a candidate that isn't smaller hands on its own.
    """
    n = len(values)
    if not back:
        out = nearest_smaller(values[::-1], True)[::-1]
        return n - 1 - out
    out = np.arange(-1, n - 1)
    todo = np.flatnonzero(out >= 0)
    todo = todo[values[out[todo]] >= values[todo]]
    while len(todo):
        out[todo] = out[out[todo]]
        todo = todo[out[todo] >= 0]
        todo = todo[values[out[todo]] >= values[todo]]
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, block: int = 1 << 16) -> np.ndarray:
    """Length of the common prefix of the suffixes a and b, at most ``most`` (which must lie inside the text)."""
    out = np.empty(len(a), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(text, most)
    for k in range(0, len(a), block):
        same = view[a[k : k + block]] == view[b[k : k + block]]
        whole = same.all(1)
        out[k : k + block] = np.where(whole, most, np.argmin(same, 1))
    return out


def previous_factors(text: np.ndarray, starts: np.ndarray, owner: np.ndarray, cap: int) -> np.ndarray:
    """The longest previous factor of each start, capped: the longest prefix of its suffix that also starts at a
    start with a smaller owner."""
    if not len(starts):
        return np.zeros(0, np.int64)
    order = suffix_order(text, starts, cap)
    place, value = starts[order], owner[order]
    best = np.zeros(len(order), np.int64)
    for near in (nearest_smaller(value, True), nearest_smaller(value, False)):
        has = np.flatnonzero((near >= 0) & (near < len(order)))
        best[has] = np.maximum(best[has], common_prefix(text, place[has], place[near[has]], cap))
    out = np.empty(len(order), np.int64)
    out[order] = best
    return out


def _search(contents: list[bytes], docs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (segment, first, last) of bytes whose windows also start in a segment of a document with a smaller id."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    text = np.frombuffer(b"".join(contents), np.uint8)
    begins = np.cumsum(sizes) - sizes
    windows = sizes - window + 1
    home = np.repeat(np.arange(len(sizes)), windows)
    starts = common.spans(begins, begins + windows)
    hit = previous_factors(text, starts, docs[home], window) >= window
    # maximal runs of such windows inside their segment
    near = np.append(False, home[1:] == home[:-1])
    opens = hit & ~(near & np.append(False, hit[:-1]))
    closes = hit & ~np.append((near & hit)[1:], False)
    first = np.flatnonzero(opens)
    owner = home[first]
    return owner, starts[first] - begins[owner], starts[np.flatnonzero(closes)] - begins[owner] + window


def dedup_factors(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = repeats.HOT, characters: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove every byte that a ``window``-byte string covers which also starts in a document with a smaller id.

    Returns (doc_id, n_bytes, kept binary, spans array<struct<start, end>>): the remaining bytes of the
    UTF-8 text in order and the maximal removed runs in byte positions of the input. Strings are judged on
    the input and never cross documents; overlaps count. A null text counts as empty. A null id counts as
    greater than every id and equal to other null ids; rows with equal ids never remove from each other;
    repeated rows give repeated results. Other columns are not read; an empty table gives an empty table.
    Very long texts are worked on in pieces, without limits on length, copies or matches. With ``characters``,
    ``kept`` leaves out whole characters only, so that it stays UTF-8. Columns named in ``carry`` follow
    under their own names.
    """
    types = {f.name: f.dataType.simpleString() for f in docs.schema}

    def finish(table: pa.Table, whole: np.ndarray, found: tuple) -> pa.Table:
        ids, null, _, data, offsets = common.ordered_rows(table)
        copied = np.asarray(table.column("copied").fill_null(-1))
        rows, starts, ends = found
        copies = np.flatnonzero(whole)
        order = np.argsort(np.append(rows, copies), kind="stable")
        rows, starts, ends = np.append(rows, copies)[order], np.append(starts, np.zeros(len(copies), np.int64))[order], np.append(ends, np.diff(offsets)[copies])[order]
        edges = np.zeros(len(data) + 1, np.int32)
        np.add.at(edges, offsets[rows] + starts, 1)
        np.add.at(edges, offsets[rows] + ends, -1)
        keep = np.cumsum(edges[:-1]) == 0
        if characters and len(data):
            begins = np.flatnonzero((data & 0xC0) != 0x80)
            keep = np.repeat(np.logical_or.reduceat(keep, begins), np.diff(np.append(begins, len(data))))
        kept = data[keep].tobytes()
        bounds = np.append(0, np.cumsum(keep))[offsets].tolist()
        first = np.searchsorted(rows, np.arange(len(ids) + 1))
        pairs = [{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())]
        spans = [[{"start": 0, "end": n}] if n >= 0 else pairs[a:b] for a, b, n in zip(first, first[1:], copied.tolist())]
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=null),
            "n_bytes": pa.array(np.where(copied >= 0, copied, np.diff(offsets))),
            "kept": pa.array([kept[a:b] for a, b in zip(bounds, bounds[1:])], pa.binary()),
            "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        } | {f"carried_{k}": table.column(f"carried_{k}") for k in range(len(carry))})

    def covers(text: str) -> int:
        n = len(text.encode())
        return n if n >= window else -1

    schema = "doc_id long, n_bytes long, kept binary, spans array<struct<start:bigint,end:bigint>>" + "".join(f", carried_{k} {types[c]}" for k, c in enumerate(carry))
    found = repeats.repeated(docs, window, min(GRAM, window), repeats.byte_units, covers, False, lambda c, d: _search(c, d, window), finish, schema, id_col, text_col, hot, carry)
    return found.toDF(*found.columns[:4], *carry)


def digest(deduped: DataFrame) -> DataFrame:
    return deduped.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
