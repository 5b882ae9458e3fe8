"""Cross-tokenizer alignment against a plain version that uses the vocabulary files' own libraries."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewarden.llm import crosstok

SF = "/root/testdata/sf0.001"


def aligned_brute(rows):
    a_tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tool.encode_special_tokens = True
    b_tool = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    symbols, n = {chr(b): b for b in plain}, 0
    for b in range(256):
        if b not in plain:
            symbols[chr(256 + n)], n = b, n + 1
    kept, counts = [], Counter()
    for doc_id, text in rows:
        a = b = []
        if text:
            a = [(i, bytes(symbols[c] for c in a_tool.id_to_token(i))) for i in a_tool.encode(" " + text, add_special_tokens=False).ids]
            b = [(i, bytes([int(b_tool.id_to_piece(i)[3:5], 16)]) if b_tool.is_byte(i) else b_tool.id_to_piece(i).replace("▁", " ").encode()) for i in b_tool.encode(text)]
            if not b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + text).encode():
                a = b = []
        spans = []
        for side in (a, b):
            at, found = 0, []
            for i, x in side:
                found.append((at, at + len(x), i))
                at += len(x)
            spans.append(found)
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in spans))
            low = cut
        links = [(i, j) for s, e, i in spans[0] for u, v, j in spans[1] if s < v and u < e] if len(a) < 400 else None
        if links is None:  # the same by a moving start
            links, k = [], 0
            for s, e, i in spans[0]:
                while spans[1][k][1] <= s:
                    k += 1
                m = k
                while m < len(b) and spans[1][m][0] < e:
                    links.append((i, spans[1][m][2]))
                    m += 1
        counts.update(links)
        kept.append((doc_id, len(a), len(b), groups, links))
    most = Counter()
    for (i, j), n in counts.items():
        most[j] = max(most[j], n)
    return [(d, na, nb, len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, x in kept]


def run(spark, rows, **options):
    found = crosstok.align_documents(spark.createDataFrame(rows, "doc_id long, text string"), **options)
    return sorted(map(tuple, crosstok.digest(found).collect()), key=str)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 20000").collect()]
    assert run(spark, rows, slice_bytes=50_000) == sorted(aligned_brute(rows), key=str)


def test_edges(spark):
    rng = random.Random(5)
    odd = [None, "", " ", "  two  spaces ", "▁ mark", "<s>[INST]</s><|endoftext|> plain", "tab\tand\nline\n\n  end", "日本語のテキスト。 漢字 かな", "naïve café Ünïcödé 😀👩‍👩‍👧 ok", "<0x41> bytes", "\x00\x01 zero", "a" * 3000, " " * 5000, "ab " * 4000, "é combining", "١٢٣ 456 7.8", " nbsp　wide"]
    odd += ["".join(rng.choice("ab 日é.\n 9<>|▁") for _ in range(rng.randint(1, 80))) for _ in range(120)]
    rows = [(k, t) for k, t in enumerate(odd)] + [(None, "null id twice"), (None, "null id twice"), (3, odd[3])]
    want = sorted(aligned_brute(rows), key=str)
    for size in (1, 300, 1 << 20):  # a text a slice, some, all
        assert run(spark, rows, slice_bytes=size) == want


def test_groups_and_lexicon(spark):
    docs = spark.createDataFrame([(1, "hello hello there", "x")], "doc_id long, text string, groups string")
    found = crosstok.align_documents(docs).first()
    assert hashlib.sha256(found.groups.encode()).hexdigest() == found.groups_sha256 and found.groups.count(";") == found.n_groups - 1
    pairs = crosstok.lexicon(crosstok.sliced(docs))
    assert pairs.agg(F.sum("links")).first()[0] == found.n_links
    assert run(spark, []) == []


def test_reseeded_windows():
    """Windows that share a hash are told apart: a hash that ignores the ids is replaced until all kinds are even."""
    import numpy as np

    from tracewarden.llm import crosstok as C

    a, b = np.array([1, 2, 1, 3, 1, 2], np.int32), np.array([7, 8, 7, 9, 7, 8], np.int32)
    first = np.array([0, 2, 4])
    real, calls = C.mix, []

    def weak(x):
        calls.append(1)
        return np.zeros_like(x) if len(calls) <= 4 else real(x)

    C.mix = weak
    try:
        one, kind = C._windows(a, b, first, first)
    finally:
        C.mix = real
    assert len(one) == 2 and kind[0] == kind[2] != kind[1] and len(calls) > 4
