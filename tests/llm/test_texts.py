"""Media, WARC, BPE, LM scores and the classifiers."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewarden.llm import bpe, labelled, lattice, media, quality, toxicity, warc

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("filters", [(k,) for k in range(5)] + [(0, 1, 2), (0, 1, 2, 3, 4)])
def test_png_round_trip(filters):
    rng = np.random.default_rng(0)
    for height in (1, 2, 37):
        image = (rng.integers(0, 256, (height, 64)) if height < 30 else np.add.outer(np.arange(height), np.arange(64) * 3) % 256).astype(np.uint8)
        assert (media.decode_png(media.encode_png(image, filters)) == image).all()


def test_png_tests_its_checksums():
    stored = bytearray(media.encode_png(media.payload_image(b"some payload" * 30)))
    for at in (0, 20, 60, len(stored) - 3):
        broken = bytearray(stored)
        broken[at] ^= 1
        with pytest.raises(media.MediaError):
            media.decode_png(bytes(broken))
    with pytest.raises(media.MediaError):
        media.decode_png(bytes(stored[:-5]))


def test_media_columns(spark):
    rows = [(1, "héllo"), (2, None), (3, ""), (4, "x" * 100_000), (None, "héllo"), (1, "héllo")]
    got = media.media_features(media.to_media(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == 6
    for r in got:
        text = next((t or "") for d, t in rows if d == r["doc_id"]).encode()
        payload = text.ljust(max(1, -(-len(text) // 64)) * 64, b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["n_bytes"] == 6}) == 1
    near = np.tile(np.arange(64, dtype=np.uint8), (64, 1))
    assert media.hamming(media.cosine_hash(near), media.cosine_hash(near + 1)) <= 4


def test_warc(spark):
    pages = [(1, "http://a", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 700_000), (6, "u", "é"), (None, "u", "same"), (7, "u", "one"), (7, "u", "one"), (7, "u", "two")]
    got = warc.archived(spark.createDataFrame(pages, "page_id long, url string, html string"), chunk=1000).collect()
    rows = sorted(((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(1, "same", "revisit", 2), (2, "same", "response", None), (3, "", "revisit", 4), (4, "", "response", None), (5, "x" * 700_000, "response", None), (6, "é", "response", None), (0, "same", "response", None), (7, "one", "response", None), (7, "one", "response", None), (7, "two", "response", None)]
    assert rows == sorted(((p, len(t.encode()), digest(t), k, o) for p, t, k, o in want), key=str)
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_hot_payloads(spark):
    html = lambda i: ("hot", None, "", f"<p>{i // 2}</p>", f"<b>{i}</b>")[i % 5 if i % 3 else 0]
    pages = [(i, "u", html(i)) for i in range(3000)] + [(None, "u", "hot"), (2997, "u", "hot")]
    for least in (0, 1):
        largest = {}
        for page, _, text in pages:
            if page is not None and len(text or "") >= least:
                largest[text or ""] = max(page, largest.get(text or "", page))
        want = sorted((p if p is not None else -1, len(t or ""), o if p is not None and (o := largest.get(t or "", p)) > p else None) for p, _, t in pages)
        df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(20)
        got = warc.archived(df, at_least=least).collect()
        assert sorted(((r["page_id"] if r["page_id"] is not None else -1, r["payload_bytes"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
        assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in got)


def test_cosine_hash_against_sums():
    """The hash from its definition: shares of pixels in boxes, then the transform's double sums."""
    rng, side, low = np.random.default_rng(5), 32, 8
    for height, width in ((1, 64), (3, 64), (32, 32), (45, 70), (100, 64)):
        image = rng.integers(0, 256, (height, width)).astype(np.uint8)

        def shares(n):
            return [[max(0.0, min(k + 1, (i + 1) * n / side) - max(k, i * n / side)) for k in range(n)] for i in range(side)]

        down, right = shares(height), shares(width)
        small = [[sum(down[i][y] * right[j][x] * float(image[y, x]) for y in range(height) if down[i][y] for x in range(width) if right[j][x]) * side * side / (height * width) for j in range(side)] for i in range(side)]
        cosine = [[math.cos(math.pi * (2 * x + 1) * u / (2 * side)) for x in range(side)] for u in range(low)]
        corner = [round(sum(small[y][x] * cosine[u][y] * cosine[v][x] for y in range(side) for x in range(side)), 6) for u in range(low) for v in range(low)]
        middle = sorted(corner[1:])[len(corner[1:]) // 2]
        assert media.cosine_hash(image) == f"{int(''.join('1' if c > middle + 1e-5 else '0' for c in corner), 2):016x}"


def test_warc_damage():
    chunks = list(warc.record_chunks(1, memoryview(b"payload " * 1000), None, "http://a", 64))
    reader = warc.RecordReader()
    for c in chunks[:-1]:
        reader.feed(c)
    with pytest.raises(warc.WarcError):
        reader.result()


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(1)
    letters = "aAbcΣσ İß<|>'sé́é 　\x1c\x85 漢字1２٣½\t\n😀!?."
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += ["<|startoftext|>a <|endoftext|>", "a<|endoftext|>b", "", " ", "x" * 5000, "ab" * 3000, "<|ENDOFTEXT|>", "It's 12 o'clock, don't you'll we've"]
    got = {r["doc_id"]: r for r in bpe.encode_documents(spark.createDataFrame([*enumerate(texts), (999_999, None)], SCHEMA)).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[k]["ids"], "<u4").tolist() == ids, text
        assert got[k]["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bytes(got[999_999]["ids"]) == b"" and got[999_999]["decoded"] == ""


def test_lattice_scores(spark):
    pieces = lattice.pieces(lattice.default_path())
    known = {int(k): float(v) for k, v in zip(pieces.keys, pieces.values)}
    for word in ("the", "thndouha", "ñez", "漢字", "x" * 40):
        b = ("▁" + word).encode()
        sums = [1.0] + [0.0] * len(b)
        for j in range(1, len(b) + 1):
            sums[j] = sum(sums[i] * math.exp(known.get(pieces._hash(b[i:j]), -math.inf)) for i in range(max(0, j - pieces.longest), j))
        assert pieces.marginals([word.encode()])[0] == pytest.approx(math.log10(sums[-1]), abs=1e-4)
    rng = random.Random(2)
    docs = [(d, " ".join(rng.choice(["The", "cat", "sat", "on", f"w{rng.randint(0, 50)}"]) for _ in range(rng.randint(0, 30)))) for d in range(200)] + [(500, None)]
    got = {r["doc_id"]: r for r in lattice.score_documents(spark.createDataFrame(docs, SCHEMA)).collect()}
    tokens = {d: re.findall(r"\S+", (t or "").lower()) + [""] for d, t in docs}
    counts = collections.Counter()
    for d, w in tokens.items():
        if zlib.crc32(str(d).encode()) % 10:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    for d, w in tokens.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(counts[x] > 0 for x in w), n, zlib.crc32(str(d).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        own = sum(math.log10((counts[x] + v * (10 ** float(pieces.marginals([x.encode()])[0]) if x else 0)) / (n + v)) for x in w if counts[x])
        assert r["score"] <= own + 1e-3
    assert lattice.score_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def _labelled(spark, make, name):
    rng = random.Random(6)
    docs = [(d, make(rng, d % 3 == 0)) for d in range(600)]
    labels = [(d, int(d % 3 == 0)) for d in range(600)] + [(None, 1), (9999, None)]
    return spark.createDataFrame(docs + [(700, None), (701, ""), (None, "x")], SCHEMA), spark.createDataFrame(labels, f"doc_id long, {name} int")


def _accuracy(rows):
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    return sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) / len(held)


def test_toxicity(spark):
    syllables = ["ba", "re", "to", "mi", "na", "lu", "ke", "so", "di", "pa"]

    def make(rng, toxic):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(10, 60))]
        if toxic:
            for _ in range(3):
                w = rng.choice(["blockhead", "wretch", "scoundrel"])
                k = rng.randrange(1, len(w))
                words.insert(rng.randrange(len(words)), rng.choice([w, w, w, w[:k] + "." + w[k:], w + "s"]))
        return " ".join(words)

    docs, labels = _labelled(spark, make, "toxic")
    machine = toxicity.train(docs, labels)
    rows = toxicity.score(docs, machine).collect()
    assert len(rows) == 603 and all(0 <= r["score"] <= 1 for r in rows) and _accuracy(rows) > 0.9
    odd = spark.createDataFrame([(1, "bare s.c.o.u.n.d.r.e.l toto scoundxrel naba scoundrrel"), (2, "bare toto naba kesodi")], SCHEMA)
    a, b = (r["score"] for r in toxicity.score(odd, machine).orderBy("doc_id").collect())
    assert a > 0.5 > b
    assert toxicity.kept(docs, machine).columns == docs.columns
    assert {r["score"] for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), machine).count() == 0


def test_string_kernel_is_the_folded_machine():
    rng = np.random.default_rng(3)
    rows = np.zeros((30, toxicity.WIDTH), np.int32)
    rows[:, 0] = 31
    rows[:, 1:9] = rng.integers(1, 27, (30, 8))
    own = toxicity.kernel(rows, rows[:10])
    amounts = rng.normal(size=10)
    assert np.allclose(toxicity.row_values(rows, toxicity.folded(rows[:10], amounts)), own @ amounts, atol=1e-4)
    assert np.allclose(own[:10], own[:10].T, atol=1e-5)


def test_quality(spark):
    def make(rng, good):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 80))]
        return " ".join(words) + "." if good else " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in words)

    docs, labels = _labelled(spark, make, "quality")
    ranking = quality.train(docs, labels)
    rows = quality.score(docs, ranking).collect()
    assert len(rows) == 603 and all(0 <= r["score"] <= 1 for r in rows) and _accuracy(rows) > 0.95
    assert quality.score(docs.limit(0), ranking).count() == 0
    assert {r["score"] for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.0}


def test_choice_of_settings(spark):
    """Settings are compared on an inner fold: labels of held-out rows change nothing, and a setting that can't learn comes last."""
    names = "array('anna', 'bert', 'carl', 'dora', 'emil', 'fritz', 'gerda', 'hugo', 'ida', 'jan', 'karla')"
    docs = spark.range(400).selectExpr("id AS doc_id", f"if(id % 4 = 0, concat('well ', {names}[id % 11], ' scumbag said ', {names}[id % 7]), concat('a fine day ', {names}[id % 11], ' by the lake ', {names}[id % 5])) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 AS int) AS toxic")
    held = labelled.held_out()
    wrong = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    settings = [{"cost": 1e-9}, {"cost": 1.0}]
    found = toxicity.choose(docs, labels, settings, folds=2)
    assert found == toxicity.choose(docs, wrong, settings, folds=2)
    assert found[0][2] == {"cost": 1.0} and found[0][1] == 0
