"""Kernels, fits and joins against plain versions of their definitions, and the edges that all operators share."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_repeats import SCHEMA, fm_brute, jaccard_brute, lpf_brute
from tracewarden.llm import bpe, common, decontaminate, fmindex, labelled, lattice, lpf, media, quality, repeats, sigtree, toxicity, warc


def plain_words(text):
    lower = {i: i + 32 for i in [*range(65, 91), *(c for c in range(0xC0, 0xDF) if c != 0xD7)]}
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").translate(lower))


def contaminated_brute(docs, items, matches=10, least=5):
    """Every document laid on every item at every shift that a seed of equal words joins: the best stretch."""
    first = {}
    for k, t in sorted(items, key=lambda r: r[0]):
        first.setdefault(tuple(plain_words(t)), k)
    out = {}
    for d, t in docs:
        w = plain_words(t)
        for item, k in first.items():
            if len(item) < least:
                continue
            best = None
            for shift in range(-len(item) + 1, len(w)):
                low, high = max(0, -shift), min(len(item), len(w) - shift)
                same = [item[i] == w[i + shift] for i in range(low, high)]
                hit = any(all(same[i + j] for j, b in enumerate(m) if b == "1") for m in decontaminate.MASKS for i in range(len(same) - len(m) + 1))
                if not hit:
                    continue
                for i, j in itertools.combinations(range(len(same) + 1), 2):
                    n = sum(same[i:j])
                    if same[i] and same[j - 1] and n >= 3 * (j - i - n) and n >= min(matches, len(item)):
                        best = max(best or (0,), (n,))
            if best:
                out[d, k] = best[0]
    return out


def test_decontaminate_against_all_alignments(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(4, 24)))) for k in range(12)]
    docs = []
    for d in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        if d % 2:
            piece = rng.choice(items)[1].split()
            piece = piece[rng.randint(0, 4) : rng.randint(8, 24)]
            for _ in range(rng.randint(0, 3) if piece else 0):
                piece[rng.randrange(len(piece))] = "other"
            at = rng.randint(0, len(w))
            w[at:at] = piece
        docs.append((d, " ".join(w)))
    docs += [(1000 + d, "so " + items[0][1] + " it ends") for d in range(80)]  # a passage that a third of all rows hold
    want = contaminated_brute(docs, items)
    assert len(want) > 90
    for small in (decontaminate.SMALL, 0):
        got = decontaminate.contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), small=small).collect()
        assert {(r["doc_id"], r["item_id"]): r["n_matched"] for r in got} == want


def kernel_brute(a, b):
    """The sum over pairs of equal subsequences of four of LAMBDA to the lengths that both span, each word scaled by its norm."""

    def weights(row):
        row, out = [int(c) for c in row if c], {}
        for at in itertools.combinations(range(len(row)), 4):
            span = at[-1] - at[0] + 1
            if span <= toxicity.SPAN:
                key = tuple(row[i] for i in at)
                out[key] = out.get(key, 0) + toxicity.LAMBDA**span
        return out

    def norm(row):  # of a word of this length whose letters all differ
        n = int((row > 0).sum())
        return sum(toxicity.LAMBDA ** (2 * (at[-1] - at[0] + 1)) for at in itertools.combinations(range(n), 4) if at[-1] - at[0] < toxicity.SPAN) ** 0.5

    x, y = weights(a), weights(b)
    scale = norm(a) * norm(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / scale if scale else 0.0


def coded(words):
    raw = " ".join(words).encode()
    letters, bounds, _, _ = toxicity.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return toxicity.windows(letters, bounds[:-1], bounds[1:])[0]


def test_kernel_against_enumeration():
    rows = coded(["idiot", "id.iot", "idioot", "idxiot", "stupid", "banana", "aaaa", "ab", "moron", "mroon"])
    got = toxicity.kernel(rows, rows)
    for i, j in itertools.product(range(len(rows)), repeat=2):
        assert got[i, j] == pytest.approx(kernel_brute(rows[i], rows[j]), abs=1e-4)
    assert got[0, 1] == got[0, 0] >= 1 and got[0, 3] > 0.4 > got[0, 4]  # repeated letters lift a word above its norm


def test_sentence_rows_are_means_of_strongest_words():
    marks = coded(["idiot", "stupid", "moron"])
    root = toxicity.nystrom(marks)
    weights = toxicity.folded(marks, np.ones(3))
    texts = ["the idiot saw a stupdi tree idiot", "trees", "", "of it"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    got = toxicity.sentence_rows(data, offsets, weights, marks, root)
    mapped = lambda words: np.mean([[kernel_brute(r, m) for m in marks] for r in coded(words)], axis=0) @ root
    assert np.allclose(got[0], mapped(["idiot", "stupdi"]), atol=1e-3)
    assert np.allclose(got[1], mapped(["trees"]), atol=1e-3)
    assert not got[2:].any()


def test_machine_against_gradient_descent():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    y = np.where(x @ [1.0, -2, 0.5, 0] + 0.3 * rng.normal(size=300) > 0.2, 1.0, -1.0)
    cost = np.where(y > 0, 2.0, 1.0)
    w, b = toxicity.support_vectors(x, y, cost, block=64)
    v = np.zeros(5)
    for _ in range(40_000):
        slack = np.maximum(0, 1 - y * (x @ v[:4] + v[4]))
        pull = -2 * cost * y * slack
        v -= 2e-4 * (np.append(v[:4], 1e-3 * v[4]) + np.append(x.T @ pull, pull.sum()))
    assert np.allclose(np.append(w, b), v, atol=1e-3)


def test_bradley_terry_against_gradient_descent():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    strength = x @ [2.0, -1, 0.5]
    pairs = rng.integers(0, 80, (500, 2))
    first = rng.random(500) < 1 / (1 + np.exp(strength[pairs[:, 1]] - strength[pairs[:, 0]]))
    better, worse = np.where(first, pairs.T[0], pairs.T[1]), np.where(first, pairs.T[1], pairs.T[0])
    w = quality.bradley_terry(x, better, worse, block=64)
    v = np.zeros(3)
    for _ in range(20_000):
        d = x[better] - x[worse]
        v -= 0.05 * (1e-3 * v - d.T @ (1 - 1 / (1 + np.exp(-d @ v))) / len(d))
    assert np.allclose(w, v, atol=1e-4)


def test_lattice_score_is_the_model(spark):
    docs = [(1, "The cat the"), (2, "cat on zzyzx ñ"), (3, ""), (4, None), (5, "on on")]
    got = {r["doc_id"]: r for r in lattice.score_documents(spark.createDataFrame(docs, SCHEMA)).collect()}
    words = {d: (t or "").lower().split() for d, t in docs}
    train = [w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 10 for w in [*ws, ""]]
    n, v = len(train), len(set(train))
    pieces = lattice.pieces(lattice.default_path())
    for d, ws in words.items():
        marginal = [float(pieces.marginals([w.encode()])[0]) for w in ws]
        assert got[d]["lattice_score"] == pytest.approx(sum(marginal), abs=1e-3)
        own = [np.log10((train.count(w) + v * 10**m) / (n + v)) for w, m in zip(ws, marginal)] + [np.log10(max(train.count(""), 0.1) / (n + v))]
        assert got[d]["score"] == pytest.approx(sum(own), abs=1e-3)


def test_rows_sent_are_bounded_by_keys():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 64, 5000, dtype=np.uint64))
    counts = rng.integers(1, 1000, len(keys))
    for parts in (4, 4000, 400_000):
        table = common.keys_table(3, keys, counts, parts)
        assert table.num_rows <= min(parts, len(keys))
        sizes = [len(x.as_py()) // 4 for x in table.column("keys")]
        assert sum(sizes) == len(keys)
        assert np.concatenate([common.unpacked_counts(c.as_py(), n) for c, n in zip(table.column("counts"), sizes)]).tolist() == counts.tolist()
    words = pa.table({"doc_id": pa.array([1, 2]), "text": ["one two three", "two four"], "chunk": pa.array([0, 0], pa.int32())})
    for parts in (4, 4000):
        sent = lattice._send(words, 10, parts)
        assert sent.num_rows <= min(parts, 5) and b"" in sent.column("words")[0].as_py().split(b" ")


def test_counts_have_no_cap():
    keys = np.array([7, 9 << 40], np.uint64)
    tables = [common.keys_table(c, keys, np.array([80_002, 1]), 1) for c in range(3)]
    told = common.count_part(pa.concat_tables(tables), (1, 2000))
    assert [np.frombuffer(x.as_py(), np.uint8).tolist() for x in told.column("totals")] == [[2, 1]] * 3


def test_anchor_keys_are_even():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 110, 200_000).astype(np.uint8)
    *_, key = repeats.segments(repeats.byte_units(data, np.array([0, len(data)])), 50, 20)
    share = np.bincount(common.parts_of(key, 20), minlength=20) / len(key)
    assert share.max() < 0.07


@pytest.mark.parametrize("operator", ["lpf", "fm"])
def test_long_texts_and_frequent_passages(spark, operator):
    rng = random.Random(5)
    letters = "abcdefgh "
    passage = "".join(rng.choice(letters) for _ in range(90)) + " the end of it all and then some more words to go on for a while yet until twenty are there "
    long_text = "".join(rng.choice(letters) for _ in range(600_000)) + passage + "ab " * 180_000
    rows = [(1, long_text), (2, long_text[300_000:900_000] + "x" + long_text[:2000])] + [(d, f"{d} " + passage + f" {d * 7}") for d in range(3, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    if operator == "lpf":
        found = lpf.digest(lpf.dedup_factors(df, 50, hot=40))
        assert {r[0]: tuple(r[1:]) for r in found.collect()} == lpf_brute(rows, 50)
    else:
        found = fmindex.digest(fmindex.dedup_substrings(df, 20, hot=40))
        assert {r[0]: tuple(r[1:]) for r in found.collect()} == fm_brute(rows, 20)


def test_shards_in_slices_answer_alike():
    rng = np.random.default_rng(6)
    families = [bytes(rng.integers(97, 123, 90).astype(np.uint8)) for _ in range(40)]  # segments of a family share windows and an anchor
    contents = [f[a : a + 60] for f in families for a in (0, 7, 20)]
    table = {"shard": [0, 0], "chunk": [1, 2], "blob": [b"".join(contents), b"".join(contents[::2])]}
    keys = np.repeat(np.array([zlib.crc32(f) for f in families], np.uint32), 3)
    docs = rng.integers(0, 50, len(contents))
    cells = lambda pick: {"sizes": np.full(len(pick), 60, np.int32).tobytes(), "keys": keys[pick].tobytes(), "docs": docs[pick].tobytes(), "places": np.arange(len(pick), dtype=np.int32).tobytes()}
    one, two = cells(np.arange(len(contents))), cells(np.arange(0, len(contents), 2))
    table |= {n: [one[n], two[n]] for n in one}
    told = [repeats.shard_answers(pa.table(table), lambda c, d: lpf._search(c, d, 20), False, most) for most in (1 << 20, 500)]
    assert told[0].equals(told[1]) and any(told[0].column("owners").to_pylist())


CLASH = "doc_id long, text string, chunk int, part int, label int, n long, d1 long, shard int, label_2 string"


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, 3, 4, 5, 6, "x") for d, t in rows], CLASH)


OPERATORS = {
    "op1": lambda df: media.media_features(media.to_media(df)),
    "op2": lambda df: decontaminate.contaminated(df, df.sparkSession.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")),
    "op4": sigtree.jaccard_groups,
    "op5": fmindex.dedup_substrings,
    "op7": lattice.score_documents,
    "op8": lpf.dedup_factors,
    "op10": bpe.encode_documents,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_columns_nulls_repeats_and_empty_tables(spark, name):
    text = "One two three four five six seven eight nine ten. " * 3
    rows = [(1, text), (1, text), (None, text), (2, None), (None, None), (3, ""), (3, "other words"), (4, "é" * 3000)]
    run = OPERATORS[name]
    plain = sorted(map(str, run(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert sorted(map(str, run(clashing(spark, rows)).collect())) == plain
    assert len(plain) == (1 if name == "op2" else len(rows))
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classifiers_with_clashing_columns_and_equal_ids(spark):
    docs = [(d, f"word{d % 7} " * 5 + ("horrid wretch" if d % 3 == 0 else "gentle breeze")) for d in range(120)]
    docs += [(3, "another text under the same id")] * 50
    labels = spark.createDataFrame([(d, int(d % 3 == 0), int(d % 3 > 0), "x") for d in range(120)] + [(3, 1, 0, "y")], "doc_id long, toxic int, quality int, text string")
    df = clashing(spark, docs)
    sample = labelled.sample(df, labels, "toxic", 1000)
    assert sample.count() == sample.select("doc_id").distinct().count()
    for module, name in ((toxicity, "toxic"), (quality, "quality")):
        model = module.train(df, labels)
        scores = module.score(df, model).collect()
        assert len(scores) == len(docs) and all(0 <= r["score"] <= 1 for r in scores)
        assert module.score(df.limit(0), model).count() == 0
    assert toxicity.kept(df, toxicity.train(df, labels)).columns == df.columns


def test_quality_cuts_at_the_quantile():
    x = np.arange(20, dtype=float)[:, None] * np.ones((1, 2))
    label = np.repeat([0, 1], [6, 14])
    ranking = quality.fit(np.vstack([x, x]), np.append(label, label))  # ties: every text twice
    assert (ranking.scores(x) >= quality.CUT).tolist() == (label == 1).tolist()


def test_damaged_media_give_nulls(spark):
    good = media.encode_png(media.payload_image(b"some payload"))
    bad = bytearray(good)
    bad[45] ^= 1
    rows = media.media_features(spark.createDataFrame([(1, 12, good), (2, 12, bytes(bad)), (3, 12, None)], media.MEDIA_SCHEMA)).orderBy("doc_id").collect()
    assert rows[0]["damage"] is None and rows[0]["payload_sha256"]
    assert rows[1]["damage"] and rows[1]["payload_sha256"] is None and rows[1]["media_bytes"] == len(good)
    assert rows[2]["damage"] is None and rows[2]["media_bytes"] is None


def test_longer_records_come_together(spark, tmp_path):
    rng = random.Random(1)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))
    pages = spark.createDataFrame([(1, "u", noise, 9), (2, "u", "small", 9), (3, "u", noise, 9)], "page_id long, url string, html string, chunk int")
    warc.write_records(pages, str(tmp_path / "w"), chunk=5000)
    records = spark.read.schema(warc.RECORDS_SCHEMA).parquet(str(tmp_path / "w"))
    whole = {r["whole"]: r["n"] for r in records.groupBy("whole").agg(F.count_distinct("record_id").alias("n")).collect()}
    assert whole == {True: 2, False: 1}
    got = sorted(tuple(r)[:2] + tuple(r)[3:] for r in warc.read_records(records.repartition(5)).collect())
    assert got == [(1, 200_000, "revisit", 3), (2, 5, "response", None), (3, 200_000, "response", None)]


def test_shared_folder_is_set(spark):
    assert common.shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    table = common.written(spark.range(3), "gone")
    path = table.inputFiles()[0]
    common.removed(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def test_jaccard_with_null_and_clashing_ids(spark):
    rows = [(d, " ".join(f"w{i + d // 2}" for i in range(40))) for d in range(8)]
    assert {r[0]: tuple(r[1:]) for r in sigtree.jaccard_groups(clashing(spark, rows)).collect()} == jaccard_brute(rows)
