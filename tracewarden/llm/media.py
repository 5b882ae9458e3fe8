"""Media columns: lossless PNG images in binary columns, read back with checks, and cosine-transform hashes.

A payload is stored as 8-bit grey samples, 64 a row. Encoding writes the signature and the IHDR, IDAT
and IEND chunks with their CRC-32; decoding tests the signature, every chunk's CRC, the Adler-32 inside
the zlib stream and the length, and then undoes the row filters with numpy.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewarden.llm.common import texts

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
NONE, SUB, UP, AVERAGE, PAETH = range(5)
WIDTH = 64
_IDAT = 1 << 20


class MediaError(ValueError):
    """A stored image that fails a test of its format."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _paeth(left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """The neighbour nearest to left + up - corner, in that order at a tie (int16 arrays)."""
    by_left, by_up = np.abs(up - corner), np.abs(left - corner)
    by_corner = np.abs(left + up - 2 * corner)
    return np.where((by_left <= by_up) & (by_left <= by_corner), left, np.where(by_up <= by_corner, up, corner))


def filtered(image: np.ndarray, kind: int) -> np.ndarray:
    """All rows of a grey image with one filter applied."""
    if kind == NONE:
        return image
    left, up = np.zeros_like(image), np.zeros_like(image)
    left[:, 1:], up[1:] = image[:, :-1], image[:-1]
    if kind == SUB:
        return image - left
    if kind == UP:
        return image - up
    if kind == AVERAGE:
        return image - ((left.astype(np.uint16) + up) >> 1).astype(np.uint8)
    corner = np.zeros_like(image)
    corner[1:, 1:] = image[:-1, :-1]
    return image - _paeth(left.astype(np.int16), up.astype(np.int16), corner.astype(np.int16)).astype(np.uint8)


def encode_png(image: np.ndarray, filters: tuple[int, ...] = (NONE, SUB, UP), level: int = 1) -> bytes:
    """A grey 8-bit PNG. Each row gets the filter of ``filters`` with the least sum of absolute differences."""
    height, width = image.shape
    forms = [filtered(image, kind) for kind in filters]
    if len(forms) == 1:
        chosen, rows = np.full(height, filters[0], np.uint8), forms[0]
    else:
        cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64) for x in forms]
        best = np.argmin(cost, 0)
        chosen = np.array(filters, np.uint8)[best]
        rows = np.choose(best[:, None], forms)
    body = np.empty((height, width + 1), np.uint8)
    body[:, 0], body[:, 1:] = chosen, rows
    packed = zlib.compress(body.data, level)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0))
    data = b"".join(_chunk(b"IDAT", packed[k : k + _IDAT]) for k in range(0, len(packed), _IDAT))
    return SIGNATURE + head + data + _chunk(b"IEND", b"")


def unfiltered(kinds: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Undo the row filters of a grey image: runs of rows with the same filter at a time.

    Sub is a running sum along a row and Up one along a column, both modulo 256. Average and Paeth
    depend on the left, upper and corner samples, so a run of them is solved diagonal by diagonal:
    all samples of equal row + column are independent of each other.
    """
    height, width = rows.shape
    if kinds.size and kinds.max() > PAETH:
        raise MediaError("unknown row filter")
    out = rows.copy()
    cuts = np.flatnonzero(np.diff(kinds)) + 1
    for first, last in zip(np.append(0, cuts), np.append(cuts, height), strict=True):
        kind, block = kinds[first], out[first:last]
        above = out[first - 1] if first else np.zeros(width, np.uint8)
        if kind == SUB:
            np.cumsum(block, axis=1, dtype=np.uint8, out=block)
        elif kind == UP:
            block[0] += above
            np.cumsum(block, axis=0, dtype=np.uint8, out=block)
        elif kind in (AVERAGE, PAETH):
            n = last - first
            framed = np.zeros((n + 1, width + 1), np.int16)
            framed[0, 1:] = above
            for step in range(n + width - 1):
                row = np.arange(max(0, step - width + 1), min(n, step + 1))
                col = step - row
                left, up, corner = framed[row + 1, col], framed[row, col + 1], framed[row, col]
                guess = (left + up) >> 1 if kind == AVERAGE else _paeth(left, up, corner)
                framed[row + 1, col + 1] = (block[row, col] + guess) & 255
            block[:] = framed[1:, 1:]
    return out


def decode_png(stored: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG; MediaError where a checksum or the structure is wrong."""
    view = memoryview(stored)
    if bytes(view[:8]) != SIGNATURE:
        raise MediaError("no PNG signature")
    at, shape, packed, ended = 8, None, [], False
    while at < len(view) and not ended:
        if at + 12 > len(view):
            raise MediaError("cut chunk")
        length, kind = struct.unpack(">I", view[at : at + 4])[0], bytes(view[at + 4 : at + 8])
        if at + 12 + length > len(view):
            raise MediaError("cut chunk")
        data = view[at + 8 : at + 8 + length]
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack(">I", view[at + 8 + length : at + 12 + length])[0]:
            raise MediaError(f"wrong CRC of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", data)
            if (depth, color, interlace) != (8, 0, 0):
                raise MediaError("not an 8-bit grey image")
            shape = (height, width)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"IEND":
            ended = True
        elif kind[0] < 0x60:
            raise MediaError(f"unknown critical chunk {kind!r}")
        at += 12 + length
    if shape is None or not ended:
        raise MediaError("no IHDR or IEND chunk")
    try:
        raw = zlib.decompress(b"".join(packed))  # tests the stream's Adler-32
    except zlib.error as e:
        raise MediaError(str(e)) from None
    if len(raw) != shape[0] * (shape[1] + 1):
        raise MediaError("wrong number of samples")
    body = np.frombuffer(raw, np.uint8).reshape(shape[0], shape[1] + 1)
    return unfiltered(body[:, 0], body[:, 1:])


@lru_cache(maxsize=2)
def _cosines(n: int, k: int) -> np.ndarray:
    """The first k rows of the n-point type-II cosine transform."""
    return np.cos(np.pi * (2 * np.arange(n) + 1) * np.arange(k)[:, None] / (2 * n))


def cosine_hash(image: np.ndarray, side: int = 32, low: int = 8) -> str:
    """A hash of the low frequencies: the image averaged down to side x side samples, its cosine transform's
    low x low corner, and one bit for each coefficient: whether it is above the median. Hexadecimal."""
    height, width = image.shape
    rows = np.arange(side + 1) * height / side
    cols = np.arange(side + 1) * width / side
    # sums over fractional boxes by linear interpolation of the running sums
    along = np.zeros((height + 1, width))
    np.cumsum(image, axis=0, out=along[1:])
    at = rows.astype(np.int64)
    part = (rows - at)[:, None]
    along = np.diff(along[at] * (1 - part) + along[np.minimum(at + 1, height)] * part, axis=0)
    across = np.zeros((side, width + 1))
    np.cumsum(along, axis=1, out=across[:, 1:])
    at = cols.astype(np.int64)
    part = cols - at
    small = np.diff(across[:, at] * (1 - part) + across[:, np.minimum(at + 1, width)] * part, axis=1) * (side * side / (height * width))
    c = _cosines(side, low)
    corner = np.round(c @ small @ c.T, 6).ravel()
    bits = corner > np.median(corner[1:])
    return np.packbits(bits).tobytes().hex()


def payload_image(payload: bytes, width: int = WIDTH) -> np.ndarray:
    """The payload with bytes 0 appended up to a positive multiple of the row width, as rows."""
    n = max(1, -(-len(payload) // width)) * width
    image = np.zeros(n, np.uint8)
    image[: len(payload)] = np.frombuffer(payload, np.uint8)
    return image.reshape(-1, width)


def hamming(a: str, b: str) -> int:
    """Differing bits of two hashes."""
    return (int(a, 16) ^ int(b, 16)).bit_count()


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """(doc_id, n_bytes, media binary): each whole text's UTF-8 bytes as a PNG column.

    A null text counts as empty and gives one row of zero samples; a null id stays null; repeated rows
    give repeated rows; other columns are not read; an empty table gives an empty table. One map without
    exchange, one text at a time, so a task holds a batch and one image.
    """

    def run(batches):
        for batch in batches:
            ids, sizes, media, held = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                payload = text.as_py().encode()
                stored = encode_png(payload_image(payload), level=level)
                ids.append(doc)
                sizes.append(len(payload))
                media.append(stored)
                held += len(stored)
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    ids, sizes, media, held = [], [], [], 0
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return texts(docs, id_col, text_col).mapInArrow(run, MEDIA_SCHEMA)


def media_features(media: DataFrame) -> DataFrame:
    """Read a ``to_media`` column back, test it and describe it.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature): all
    from the stored bytes; ``feature`` is the cosine hash, 16 hexadecimal digits. A null image gives nulls; of a
    damaged one, what is read from its samples is null and ``damage`` says why, so that one image doesn't end the job.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "damage"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, size, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not cell.is_valid:
                    rows.append((doc, size, None, None, None, None, None, None, None))
                    continue
                stored = cell.as_py()
                whole = (len(stored), hashlib.sha256(stored).hexdigest())
                try:
                    image = decode_png(stored)
                except MediaError as e:
                    rows.append((doc, size, None, None, None, *whole, None, str(e)))
                    continue
                payload = image.tobytes()
                rows.append((doc, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *whole, cosine_hash(image), None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, damage string")
