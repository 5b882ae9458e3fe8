"""FM-index and LPF dedup, the Jaccard join and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import common, decontaminate, fmindex, lpf, repeats, sigtree

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string"


def lpf_brute(rows, w):
    first, out = {}, {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - w + 1):
            first[b[i : i + w]] = min(first.get(b[i : i + w], 1 << 62), d)
    for d, t in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - w + 1):
            if first[b[i : i + w]] < d:
                m[i : i + w] = b"\1" * w
        out[d] = (len(b), sum(m), sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1])), hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest())
    return out


def fm_brute(rows, w):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        words = re.findall(WORD, t or "")
        m = [0] * len(words)
        for i in range(len(words) - w + 1):
            k = tuple(words[i : i + w])
            if k in seen:
                m[i : i + w] = [1] * w
            seen.add(k)
        out[d] = (len(words), sum(m), hashlib.sha256(" ".join(x for x, y in zip(words, m) if not y).encode()).hexdigest())
    return out


def jaccard_brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(WORD, (t or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), root(d)) for d in sets}


def passages(seed=5):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab cdé") for _ in range(60)) for _ in range(12)]
    rows = []
    for d in range(100):
        t = "".join(rng.choice(pool)[rng.randint(0, 20) : rng.randint(30, 60)] if rng.random() < 0.7 else "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 6)))
        rows.append((d, "a" * rng.randint(0, 200) if rng.random() < 0.1 else t))
    rows += [(d + 1000, t) for d, t in rows[:40]] + [(5000, None), (5001, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("window,hot", [(20, 2000), (50, 3)])
def test_lpf(spark, window, hot):
    rows = passages()
    got = {r[0]: tuple(r[1:]) for r in lpf.digest(lpf.dedup_factors(spark.createDataFrame(rows, SCHEMA), window, hot=hot)).collect()}
    assert got == lpf_brute(rows, window)


def test_lpf_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lpf.dedup_factors(empty).count() == 0
    text = "é" * 40 + "tail of the text, long enough to be a string of its own kind"
    df = spark.createDataFrame([(None, text, 1), (None, text, 2), (3, text, 3), (3, text, 4)], "doc_id long, text string, chunk int")
    rows = lpf.dedup_factors(df, 50, characters=True, carry=("chunk",)).orderBy("chunk").collect()
    assert [r["chunk"] for r in rows] == [1, 2, 3, 4]
    # null ids are later than id 3 and equal to each other; equal ids don't remove from each other
    assert [bool(r["kept"]) for r in rows] == [False, False, True, True]


def test_lpf_factors():
    text = np.frombuffer(b"banana-bananas", np.uint8)
    starts, owner = np.array([0, 1, 2, 7, 8, 9]), np.array([0, 0, 0, 1, 1, 1])
    assert lpf.previous_factors(text, starts, owner, 5).tolist() == [0, 0, 0, 5, 5, 4]
    values = np.array([3, 1, 4, 1, 5, 0, 2])
    assert lpf.nearest_smaller(values, True).tolist() == [-1, -1, 1, -1, 3, -1, 5]
    assert lpf.nearest_smaller(values, False).tolist() == [1, 5, 3, 5, 5, 7, 7]


@pytest.mark.parametrize("window,hot", [(10, 2000), (20, 3)])
def test_fm_index(spark, window, hot):
    rng = random.Random(7)
    pool = [[rng.choice(["a", "b", "cé", "dd", "x\x85y"]) for _ in range(40)] for _ in range(10)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(pool)[rng.randint(0, 12) : rng.randint(15, 40)] if rng.random() < 0.7 else [rng.choice("pqrst") for _ in range(rng.randint(0, 20))]
        w = ["z"] * rng.randint(0, 60) if rng.random() < 0.1 else w
        rows.append((d, "".join(x + rng.choice([" ", "  ", "\n", "\t "]) for x in w)))
    rows += [(d + 1000, t) for d, t in rows[:40]] + [(5000, None)]
    got = {r[0]: tuple(r[1:]) for r in fmindex.digest(fmindex.dedup_substrings(spark.createDataFrame(rows, SCHEMA), window, hot=hot)).collect()}
    assert got == fm_brute(rows, window)


def test_wavelet_ranks_and_search():
    rng = np.random.default_rng(1)
    sequence = rng.integers(0, 13, 500)
    tree = fmindex.WaveletMatrix(sequence, 4)
    at, symbol = rng.integers(0, 501, 200), rng.integers(0, 13, 200)
    assert tree.rank(symbol, at).tolist() == [int((sequence[:a] == c).sum()) for a, c in zip(at, symbol)]
    text = np.append(rng.integers(1, 4, 300), 0)
    index = fmindex.FMIndex(text, 4)
    pattern = np.append(rng.integers(1, 5, 40), 0)[:40]  # 4 is unknown to the text
    found = {int(p): (int(n), int(hi - lo)) for _, at, length, low, high in index.streamed(pattern, np.array([0]), np.array([40])) for p, n, lo, hi in zip(at, length, low, high)}
    plain = ",".join(map(str, text.tolist()))
    for p, (n, rows) in found.items():
        if n:
            piece = pattern[p : p + n]
            hits = sum((text[i : i + n] == piece).all() for i in range(len(text) - n + 1))
            assert hits == rows > 0, (p, n, plain)
        else:
            assert pattern[p] == 4


@pytest.mark.parametrize("half", [16384, 20])
def test_jaccard(spark, half):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 80))] for _ in range(20)]
    rows = []
    for d in range(300):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            i = rng.randrange(len(w)) if w else 0
            w[i : i + (rng.random() < 0.7)] = [rng.choice(vocabulary)] * (rng.random() < 0.7)
        rows.append((d, " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One\ttwo")]
    got = {r[0]: tuple(r[1:]) for r in sigtree.jaccard_groups(spark.createDataFrame(rows, SCHEMA), half=half).collect()}
    assert got == jaccard_brute(rows)


def test_jaccard_edges(spark):
    assert sigtree.jaccard_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f")]
    got = sigtree.jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] is None, r["component_id"]) for r in got) == [(False, 4), (False, 4), (True, 4), (True, 4)]


def test_jaccard_copies_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 2000)
    words = [f"w{i}" for i in range(40)]
    rows = [(d, " ".join(words)) for d in range(3, 200)] + [(d, " ".join(words[:38])) for d in (1, 300)] + [(d, f"alone {d} a b c d e") for d in range(400, 420)]
    got = {r[0]: tuple(r[1:]) for r in sigtree.jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == jaccard_brute(rows) and got[150] == (36, 1)


def test_jaccard_near_copies_under_null_ids(spark):
    words = [f"w{i}" for i in range(100)]
    text = lambda a, b, base=words: " ".join(["x"] * a + base[a : len(base) - b] + ["y"] * b)
    other = [f"v{i}" for i in range(100)]
    # 5 and 6 link only through the null row between them; the last two rows link without any id
    rows = [(5, text(0, 0)), (None, text(8, 0)), (6, text(8, 12)), (7, "a b c"), (None, text(0, 0, other)), (None, text(5, 0, other))]
    named = [(k if d is None else d, t) for k, (d, t) in enumerate(rows, 100)]
    brute = jaccard_brute(named)
    assert {brute[d][1] for d in (5, 101, 6)} == {5} and {brute[d][1] for d in (104, 105)} == {104}
    assert {d: c for d, (_, c) in jaccard_brute([r for r in rows if r[0]]).items()} == {5: 5, 6: 6, 7: 7}
    got = sigtree.jaccard_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (0, 5), (5, 5), (6, 5), (7, 7)]


def test_jaccard_halves_by_bytes(spark):
    members = spark.createDataFrame([(1, 1000), (1, 1000), (1, 1000), (7, 10), (7, 10)], "comp long, n long")
    assert {tuple(r) for r in sigtree._blocks(members, "blocks", 16384, 8000).collect()} == {(1, 3), (7, 1)}
    assert {tuple(r) for r in sigtree._blocks(members, "blocks", 2, 1 << 30).collect()} == {(1, 2), (7, 1)}
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join("zz" if rng.random() < 0.03 else w for w in base)) for d in range(60)]
    got = {r[0]: tuple(r[1:]) for r in sigtree.jaccard_groups(spark.createDataFrame(rows, SCHEMA), half_bytes=4000).collect()}
    assert got == jaccard_brute(rows)


def test_jaccard_clusters_of_one_candidate_group(spark):
    # texts drift word by word, so that neighbours link and the group falls into clusters where the drift jumps
    words = [f"w{i}" for i in range(400)]
    rows, at = [], 0
    rng = random.Random(10)
    for d in range(150):
        at += rng.choice([1, 1, 2, 9, 10])
        rows.append((d, " ".join(words[at % 300 : at % 300 + 70])))
    rng.shuffle(rows)
    for half in (5, 25):
        got = {r[0]: tuple(r[1:]) for r in sigtree.jaccard_groups(spark.createDataFrame(rows, SCHEMA), half=half).collect()}
        assert got == jaccard_brute(rows)
    assert 1 < len({c for _, c in got.values()}) < 100


def test_decontaminate(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(12, 50))] for _ in range(20)]
    docs, planted = [], set()
    for d in range(200):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        if d % 4 == 0:
            k = rng.randrange(len(items))
            piece = list(items[k])
            if d % 8 == 0:  # one word in nine is another one
                piece[4::9] = ["zz"] * len(piece[4::9])
            at = rng.randrange(len(w))
            w[at:at] = piece
            planted.add((d, k))
        docs.append((d, ", ".join(w).upper() if d % 3 == 0 else " ".join(w)))
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(77, None), (78, "too short"), (79, " ".join(items[3]))], "item_id long, text string")
    got = decontaminate.contaminated(spark.createDataFrame(docs + [(998, None), (None, "x")], SCHEMA), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == planted
    assert decontaminate.contaminated(spark.createDataFrame([], SCHEMA), bench).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame(docs, SCHEMA), bench.limit(0)).count() == 0


def test_best_stretch():
    rng = np.random.default_rng(5)
    for n in range(1, 40):
        for share in (0.3, 0.6, 0.75, 0.9):
            same = rng.random(n) < share
            most = max(int(same[i:j].sum()) for i in range(n) for j in range(i, n + 1) if same[i:j].sum() >= 3 * (~same[i:j]).sum())
            first, end, matches = decontaminate.best_stretch(np.zeros(n), np.where(same, 0, 1))
            assert matches == most == same[first:end].sum() and matches >= 3 * (end - first - matches)


def test_decontaminate_at_the_rate(spark):
    items = {k: [f"i{k}x{i}" for i in range(n)] for k, n in enumerate((59, 40, 22, 22, 40))}
    changed = {0: range(3, 59, 4), 1: range(3, 40, 4), 2: range(9, 13), 3: range(8, 14), 4: range(2, 40, 3)}
    docs = [(k, " ".join(["before"] * 9 + ["zz" if i in changed[k] else w for i, w in enumerate(x)] + ["after"] * 9)) for k, x in items.items()]
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in items.items()], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.contaminated(spark.createDataFrame(docs, SCHEMA), bench).collect())
    # six words of 22 (8 equal on each side) and every third word are more than one substitution for three matches
    assert got == [(0, 0, 45, 9, 68), (1, 1, 30, 9, 48), (2, 2, 18, 9, 31)]


def test_equal_texts_fill_no_chunk(spark):
    """A third of all rows null, a third one short text, and copies of one long text in every partition: chunks stay even."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = spark.range(0, 24_000, 1, 40).selectExpr("id AS doc_id", f"CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'n/a' WHEN id % 600 = 2 THEN '{long}' ELSE concat(id, ' ', repeat(cast(id AS string) || ' ', 30)) END AS text")
    for units, window, equal_ids in ((repeats.byte_units, 50, False), (repeats.word_units, 20, True)):
        found = repeats.dealt(rows, lambda t: len(t), equal_ids, units, window, 64, "doc_id", "text")
        sizes = sorted(r["count"] for r in found.groupBy("chunk").count().collect())
        assert len(sizes) == 64 and sizes[-1] < 2 * sizes[32] and sum(sizes) == 24_000
        copies = [r["count"] for r in found.filter(F.col("text") == long).groupBy("chunk").count().collect()]
        assert len(copies) >= 4  # not in one chunk


def test_copies_in_many_partitions(spark):
    """Copies, short texts and nulls over many partitions, against brute force."""
    base = [(i, ["alpha beta gamma " * 12, None, "n/a", " ".join(f"v{i % 7}{j}" for j in range(30))][i % 4]) for i in range(160)]
    df = spark.createDataFrame(base, SCHEMA).repartition(12)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in lpf.digest(lpf.dedup_factors(df)).collect()}
    assert got == {d: tuple(v) for d, v in lpf_brute(base, 50).items()}


def shuffled_bytes(spark):
    """Bytes that all stages of the session have written to exchanges so far."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}


@pytest.mark.parametrize("operator", ["lpf", "fm"])
def test_text_is_exchanged_once(spark, operator):
    """Texts without repeats: one copy of them and five bytes an anchor go to disk, not a copy for each job."""
    rng = random.Random(8)
    rows = [(d, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-+", k=30)) for _ in range(200))) for d in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    known = shuffled_bytes(spark)
    found = lpf.digest(lpf.dedup_factors(df)) if operator == "lpf" else fmindex.digest(fmindex.dedup_substrings(df))
    assert all(r["n_removed"] == 0 for r in found.collect())
    written = sum(n for stage, n in shuffled_bytes(spark).items() if stage not in known)
    assert written < 1.6 * sum(len(t) for _, t in rows)


def test_rows_of_segments_grow_with_the_text():
    """Ten times the text has ten times the chunks; a chunk's segments still share rows at 50 GB of text (8 MB of text have some 130,000)."""
    total = 50_000_000_000
    chunks, parts = -(-total // common.CHUNK_BYTES), -(-total // common.PART_BYTES)
    assert repeats.shards_for(chunks, parts) == parts < chunks / 5
    assert [repeats.shards_for(n, max(1, n // 5)) for n in (1, 60, 100, 1000)] == [1, 60, 64, 200]


def test_segments_travel_packed():
    rng = np.random.default_rng(9)
    text = rng.choice(np.frombuffer(b"the of and in to a is ", np.uint8), 40_000).astype(np.uint8)
    units = repeats.byte_units(text, np.arange(0, 40_001, 1000))
    ids = np.sort(np.append(rng.integers(-(1 << 62), 1 << 62, 38), [np.iinfo(np.int64).min, common.NULL_ID]))
    row, first, end, key, digest = repeats.segments(units, 50, 20, digests=True)
    totals = np.ones(len(np.unique(key)), np.uint8)  # all occur more than once
    flags = pa.table({"part": [0], "totals": pa.array([totals.tobytes()], pa.binary())})
    for shards in (1, 7, 5000):
        places = repeats.repeated_places(units, np.zeros(40, bool), flags, 50, 20, shards)
        packed = repeats.packed_rows(3, units, ids, places)
        plain = repeats.unpacked_rows(packed)
        low, high = places.first[places.lead], places.end[places.lead]
        cells = {"blob": text[common.spans(low, high)], "sizes": (high - low).astype(np.int32), "keys": places.key.astype(np.uint32), "docs": ids[places.row[places.lead]], "places": low.astype(np.int32)}
        for name, values in cells.items():
            assert b"".join(plain.column(name).to_pylist()) == values.tobytes()
        assert plain.column("shard").to_pylist() == np.unique(places.shard).tolist() and set(plain.column("chunk").to_pylist()) == {3}
        size = lambda table: sum(len(x) for n in table.column_names[2:] for x in table.column(n).to_pylist())
        assert size(packed) < (0.65 if shards < 10 else 1.0) * size(plain)
    values = np.array([0, 127, 128, 16_383, 16_384, (1 << 63) - 1, -1, -(1 << 63)], np.int64)
    assert repeats.from_varints(repeats.varints(values)[0]).view(np.int64).tolist() == values.tolist()
    assert len(repeats.from_varints(np.zeros(0, np.uint8))) == 0


def test_decontaminate_long_items(spark):
    """The whole stretch that lies on an item is judged: 120 equal words, then every second one replaced."""
    item = [f"w{i}" for i in range(200)]
    doc = [w if i < 120 or i % 2 == 0 else f"x{i}" for i, w in enumerate(item)]
    lead = [f"z{i}" for i in range(500)]
    docs = [(1, " ".join(doc)), (2, " ".join(lead + doc + lead)), (3, " ".join(lead + doc[100:]))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(f"q{i}" for i in range(12)))], "item_id long, text string")
    for small in (decontaminate.SMALL, 0):
        got = sorted(tuple(r) for r in decontaminate.contaminated(spark.createDataFrame(docs, SCHEMA), bench, small=small).collect())
        # the last word is a replaced one: the stretch ends before it
        assert got[:2] == [(1, 7, 160, 0, 199), (2, 7, 160, 500, 699)]
        assert got[2][:2] == (3, 7) and got[2][3] == 500
