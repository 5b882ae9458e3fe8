"""Extraction in batches of bounded size."""

import pyarrow as pa

from tracewarden.operators import extract


def test_events_come_in_small_batches():
    """A file's events may end in the next batch; the rows are those of one large batch, and a file without events gives none."""
    files = [("a.py", "python", "import os\n" * 7), ("b.py", "python", ""), ("c.ts", "typescript", "f(x);\n" * 5), ("d.py", "python", "g(y)\n" * 4)]
    given = [pa.record_batch([pa.array(c, pa.string()) for c in zip(*part, strict=True)], names=["path", "language", "content"]) for part in (files[:3], files[3:])]
    small, whole = list(extract.event_batches(given, 3)), list(extract.event_batches(given))
    assert [b.num_rows for b in whole] == [16] and max(b.num_rows for b in small) == 3
    assert [r for b in small for r in b.to_pylist()] == whole[0].to_pylist()
    assert list(extract.event_batches(given[:0])) == []
