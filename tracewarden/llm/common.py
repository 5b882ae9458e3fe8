"""Shared helpers of the training-data operators: text buffers, hashing kernels and chunk exchanges.

The corpus operators that look for repeated content (substring dedup, LPF dedup, Jaccard join,
LM scoring) all follow one pattern, which keeps every exchange even and bounded:

1. documents are dealt into *chunks* by a hash of the row (one exchange of the text, which Spark
   reuses for every later visit of the same chunk);
2. a chunk sends compact keys to *parts* (ranges of the key's hash space), each distinct key once
   per chunk, so that a key that a third of all rows hold is still one entry per chunk;
3. the parts answer with one or two bytes per key, in the order in which the keys were sent.

The numbers of chunks and parts follow the bytes of text, so that a group stays some megabytes at any
input size. A chunk sends a row only to parts for which it has keys, so there are never more rows than keys
and the exchange is linear in the text: five bytes a key while the keys of a chunk outnumber the parts, and at
most a row (some 60 bytes) a key beyond. Clusters with more memory a core may raise CHUNK_BYTES and
PART_BYTES, which lowers the number of rows.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Order value of a null id: after every id.
NULL_ID = np.iinfo(np.int64).max

#: Text bytes of a chunk, and of the input for each part of the key space.
CHUNK_BYTES, PART_BYTES = 3 << 19, 8 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SEED = 0x5EED


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share (``spark.checkpoint.dir``).

    Where the setting is unset, a session in one process gets a folder of its own; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tracewarden-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write a table into the shared folder and read it again."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the folder of a table that ``written`` returned and nothing reads any more."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id long, text string): only the two columns that count; a null text counts as empty.

    Columns to ``carry`` follow as carried_0, carried_1 and so on.
    """
    extra = [F.col(f"`{c}`").alias(f"carried_{k}") for k, c in enumerate(carry)]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *extra)


def groups_of(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """The numbers of chunks and parts for a table: one pass over the lengths of its texts."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    return max(1, -(-total // CHUNK_BYTES)), max(1, -(-total // PART_BYTES))


def first_of_batch(docs: DataFrame, covers, equal_ids: bool, sizes, least: int) -> DataFrame:
    """Adds ``copied`` (long) and ``dealt`` (long) to (doc_id, text, ...) rows and empties the text of rows that are settled within their batch.

    A row is settled where its batch also holds the whole text under a smaller id (``equal_ids``: or under the
    same id, earlier in the batch) and the text is long enough for the operator to remove it whole:
    ``covers(text)`` is then the number of its units, else -1. ``copied`` is that number, or null. So of a text
    that a third of all rows hold, each batch sends one copy through the exchange and otherwise small rows.

    ``dealt`` is a number of the row's own where it need not meet others: where it is settled or has fewer than ``least`` units
    (``sizes(data, offsets)``), as null, empty and short texts have. Else it is null.
    """
    schema = docs.schema
    names = schema.names

    def run(batches):
        count = np.uint64(TaskContext.get().partitionId()) << np.uint64(40)
        for batch in batches:
            ids = np.asarray(batch.column(0).fill_null(NULL_ID))
            text = batch.column(1)
            data, offsets = utf8_buffers(text)
            view = memoryview(data)
            names_of = [xxhash.xxh3_128_digest(view[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            seen: dict[bytes, int] = {}
            codes = np.array([seen.setdefault(n, len(seen)) for n in names_of], np.int64)
            settled = np.full(len(ids), -1, np.int64)
            if len(seen) < len(codes):
                order = np.lexsort((np.arange(len(ids)), ids, codes))
                first = np.append(True, codes[order][1:] != codes[order][:-1])
                lead = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
                later = ~first & ((ids[order] > ids[order][lead]) | equal_ids)
                verdict: dict[int, int] = {}
                for row in order[later].tolist():
                    code = int(codes[row])
                    if code not in verdict:
                        verdict[code] = covers(text[row].as_py())
                    settled[row] = verdict[code]
                if settled.max() >= 0:
                    text = pa.compute.if_else(pa.array(settled >= 0), "", text)
            alone = (settled >= 0) | (sizes(data, offsets) < least)
            dealt = mix(np.arange(len(ids), dtype=np.uint64) + count).view(np.int64)
            count += np.uint64(len(ids))
            columns = [batch.column(0), text, *batch.columns[2:], pa.array(settled, mask=settled < 0), pa.array(dealt, mask=~alone)]
            yield pa.record_batch(columns, names=[*names, "copied", "dealt"])

    return docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField("copied", T.LongType()), T.StructField("dealt", T.LongType())]))


def in_chunks(docs: DataFrame, chunks: int, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, chunk): rows dealt by a hash of the row, so that no key or source is hot."""
    return texts(docs, id_col, text_col, carry).withColumn("chunk", F.expr(f"cast(pmod(xxhash64(doc_id, text), {chunks}) as int)"))


def sorted_rows(table: pa.Table) -> pa.Table:
    """A chunk's rows by (doc_id, text), nulls last."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def ordered_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Rows of a chunk in (doc_id, text) order, nulls last: (ids with NULL_ID, is_null, text, bytes, offsets).

    The order depends on the rows alone, so that each visit of a chunk, or a task that is run again
    after an executor was lost, sees the same order.
    """
    table = sorted_rows(table)
    ids = table.column("doc_id").combine_chunks()
    text = table.column("text").combine_chunks()
    data, offsets = utf8_buffers(text)
    return np.asarray(ids.fill_null(NULL_ID)), np.asarray(ids.is_null()), text, data, offsets


def utf8_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the int64 offsets of its rows, without a copy where possible."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, raw, payload = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column) or raw is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(raw, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(payload, np.uint8) if payload is not None and payload.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Runs (first, last) of rows of about ``most`` bytes; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _MULTIPLIER)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_B = 0x100000001B3 * 2 + 1
_B_INVERSE = pow(_B, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n, kept between calls."""
    if len(_powers[0]) < n:
        size = max(1 << 16, n + (n >> 2))
        for k, base in enumerate((_B, _B_INVERSE)):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return _LOWER[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words ``[^\\x20\\x09-\\x0D]+`` of each row, and the row's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: differences of a polynomial prefix hash."""
    powers, inverse = _power_tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MULTIPLIER)


def gram_hashes(units: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit hash of every m consecutive units (uint64 each); len(units) - m + 1 values."""
    n = len(units) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size, part = None, 0, _B, 1, units
    factor = 1
    while True:
        if m & size:
            piece = part[done : done + n]
            out = piece * np.uint64(factor) if out is None else out + piece * np.uint64(factor)
            done += size
            factor = factor * power % (1 << 64)
        size *= 2
        if size > m:
            break
        half = size // 2
        part = part[: len(part) - half] + part[half:] * np.uint64(power)
        power = power * power % (1 << 64)
    return mix(out)


_PLACE_BITS = 22


def anchors(grams: np.ndarray, offsets: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their leftmost smallest gram: (first window, end window, anchor position).

    ``offsets`` are the rows' bounds in units; windows never cross rows. Equal windows have the same
    anchor at the same distance wherever they stand, so equal windows meet wherever anchors meet.
    """
    n = int(offsets[-1])
    bits = np.uint64(_PLACE_BITS)  # the same for all ranges, so that ties fall alike everywhere
    if n >> _PLACE_BITS:
        raise ValueError(f"a range of {n} units is too long for anchors")
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none
    width = window - m + 1
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: n - window + 1], low[width - size : width - size + n - window + 1])
    low = low[: n - window + 1]
    at = (low & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
    lengths = np.diff(offsets)
    valid = np.zeros(n - window + 2, np.int8)
    rows = lengths >= window
    np.add.at(valid, offsets[:-1][rows], 1)
    np.add.at(valid, offsets[1:][rows] - window + 1, -1)
    good = np.cumsum(valid[:-1], dtype=np.int8) > 0
    change = np.empty(len(at), bool)
    change[0] = True
    change[1:] = (at[1:] != at[:-1]) | (good[1:] != good[:-1])
    row_starts = offsets[:-1][rows]
    change[row_starts] = True
    firsts = np.flatnonzero(change)
    ends = np.append(firsts[1:], len(at))
    keep = good[firsts]
    return firsts[keep], ends[keep], at[firsts[keep]]


@lru_cache(maxsize=1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


def released(out):
    """``out``, after the memory that a group's work has left unused went back to the system: workers are reused."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)
    return out


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part (range of the hash space) of sorted or unsorted 64-bit keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


KEYS_SCHEMA = "part int, chunk int, keys binary, counts binary"
FLAGS_SCHEMA = "chunk int, part int, totals binary"


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each; those from 255 on are 255 there and follow as eight bytes each."""
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[counts >= 255].astype("<i8").tobytes()


def unpacked_counts(blob: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, "<i8", offset=n)
    return counts


def keys_table(chunk: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.Table:
    """A chunk's distinct sorted keys as one row for each part that has some: the low 32 bits of each key, and its count."""
    bounds = np.searchsorted(parts_of(keys, parts), np.arange(parts + 1)) if parts < len(keys) else None
    if bounds is None:  # fewer keys than parts
        some, first = np.unique(parts_of(keys, parts), return_index=True)
        cuts = list(zip(first.tolist(), [*first[1:].tolist(), len(keys)]))
    else:
        some = np.flatnonzero(np.diff(bounds))
        cuts = [(bounds[p], bounds[p + 1]) for p in some]
    low = keys.astype(np.uint32)
    return pa.table({"part": pa.array(some.astype(np.int32)), "chunk": pa.array(np.full(len(some), chunk, np.int32)), "keys": pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()), "counts": pa.array([packed_counts(counts[a:b]) for a, b in cuts], pa.binary())})


def count_part(table: pa.Table, limits: tuple[int, ...] | None = None) -> pa.Table:
    """Total counts of a part's keys over all chunks, sent back to each chunk in its own order.

    Without ``limits``, as two bytes (at most 65535, which orders the rest alike); with them, as one byte: how many of
    the limits the total is above. Two keys with the same low 32 bits in one part share a total; a total is thus never
    too low, and every chunk sees the same one.
    """
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")]
    counts = [unpacked_counts(x.as_buffer(), len(k)) for x, k in zip(table.column("counts"), keys, strict=True)]
    _, back = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(back, weights=np.concatenate(counts))
    totals = np.minimum(totals, 65535).astype(np.uint16) if limits is None else np.searchsorted(np.array(limits), totals).astype(np.uint8)
    totals = totals[back]
    ends = np.cumsum([len(x) for x in keys])
    pieces = [totals[e - len(x) : e].tobytes() for x, e in zip(keys, ends, strict=True)]
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "totals": pa.array(pieces, pa.binary())})


def totals_of(flags: pa.Table, n: int, kind: type = np.uint16) -> np.ndarray:
    """The parts' answers, in the order of the chunk's sorted distinct keys."""
    flags = flags.sort_by("part")
    found = [np.frombuffer(x.as_buffer(), kind) for x in flags.column("totals")]
    totals = np.concatenate(found) if found else np.zeros(0, kind)
    if len(totals) != n:
        raise ValueError(f"a chunk sent {n} keys and got {len(totals)} answers")
    return totals


def counted(chunks: DataFrame, send, limits: tuple[int, ...] | None = None) -> DataFrame:
    """(chunk, part, totals): what ``send`` (a chunk's table to ``keys_table``) asks for, counted over all chunks (see ``count_part``)."""
    keys = chunks.groupBy("chunk").applyInArrow(lambda t: released(send(t)), KEYS_SCHEMA)
    return keys.groupBy("part").applyInArrow(lambda t: released(count_part(t, limits)), FLAGS_SCHEMA)


def spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All positions of the ranges [first, last), one range after the other."""
    n = last - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as maximal runs, sorted; touching intervals become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.append(True, starts[1:] > reach[:-1])
    last = np.append(first[1:], True)
    return starts[first], reach[last]
