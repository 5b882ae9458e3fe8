"""The pipeline's stages, each on its own input, against plain versions; and the registration of all queries."""

import corpus_pipeline
import __spark_entry__
from tests.llm.test_brute import contaminated_brute
from tests.llm.test_repeats import jaccard_brute, lpf_brute
from tracewarden.llm import registry, toxicity

SF = "/root/testdata/sf0.001"


def test_registered():
    names = [*registry.queries()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, len(names) + 1))
    assert "pipeline" in __spark_entry__.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "lpf_dedup", "decontaminate", "bpe"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        after = out.collect()
        plain = [(r["doc_id"], r["text"]) for r in before]
        if name == "jaccard_join":
            groups = jaccard_brute(plain)
            assert {r["doc_id"] for r in after} == {d for d, (_, c) in groups.items() if c == d}
        elif name == "lpf_dedup":
            assert len(after) == len(before)
            removed = {d: v[1] for d, v in lpf_brute(plain, 50).items()}
            size = {d: len(t.encode()) for d, t in plain}
            for r in after:  # whole characters only: up to three bytes more at each end of a run
                assert 0 <= len(r["text"].encode()) - (size[r["doc_id"]] - removed[r["doc_id"]]) <= 6 * (removed[r["doc_id"]] // 50 + 1)
                assert r["n_chars"] == len(r["text"])
        else:
            assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(after) > 0.6 * len(before)
        docs = spark.createDataFrame(after, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


PASSAGE = "the quick brown fox jumps over the lazy dog while seven grey geese watch from afar"


def tables(spark, folder, docs):
    """A data folder with a few documents, labels and benchmark items; documents carry columns that operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, chunk int, kept string, spans string, copied long"
    rows = [(d, t, "en", None, len(t or ""), 1, "k", None, None) for d, t in docs]
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    marks = [(1000 + k, 1, int(k % 4 == 0)) for k in range(160)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (3, "too short")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"{folder}"


def test_stages_on_hard_rows(spark, tmp_path):
    """Nulls, empty and repeated rows, equal ids, clashing columns: every stage against a plain version of it on its own input."""
    names = ["anna", "bert", "carl", "dora", "emil", "fritz", "gerda", "hugo", "ida", "jan", "karla"]
    docs = [(1000 + k, f"well {names[k % 11]} scumbag said {names[k % 7]} number {k}" if k % 4 == 0 else f"a fine day {names[k % 11]} number {k} by the {names[k % 5]} lake with {k * 7} boats") for k in range(160)]
    docs += [(1, None), (2, ""), (3, "a fine day by the lake, we said, and " + PASSAGE), (4, f"{PASSAGE} twice and more words around it for good measure {'x' * 60}"), (5, "same text in two rows"), (5, "same text in two rows"), (6, "one id"), (6, "with two texts"), (None, "no id at all")]
    docs += [(7, "long " * 400 + "tail of seven"), (8, "long " * 400 + "tail of eight"), (9, "é" * 80), (10, "é" * 80)]
    folder = tables(spark, tmp_path / "hard", docs)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    key = lambda rows: sorted((str(r["doc_id"]), str(r["text"])) for r in rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = frame.collect()
        out = stage(spark, frame, folder)
        assert out.schema.names == frame.schema.names
        after = out.collect()
        if name == "toxicity":
            score = toxicity.score(frame, toxicity.train(frame, labels)).collect()
            bad = {(r["doc_id"]) for r in score if r["predicted"]}
            assert len(bad & {1000 + k for k in range(0, 160, 4)}) > 30 and not bad - {1000 + k for k in range(0, 160, 4)}
            assert key(after) == key(r for r in before if r["doc_id"] not in bad)
        elif name == "jaccard_join":
            groups = jaccard_brute([(r["doc_id"], r["text"]) for r in before if r["doc_id"] is not None and r["doc_id"] not in (5, 6)])
            gone = {d for d, (_, c) in groups.items() if c != d}
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - gone
        elif name == "lpf_dedup":
            assert len(after) == len(before) and all(r["n_chars"] == len(r["text"]) and r["chunk"] == 1 and r["kept"] == "k" for r in after)
            texts = {r["doc_id"]: r["text"] for r in after}
            assert texts[3].endswith(PASSAGE) and PASSAGE not in texts.get(4, "") and texts[1] == ""
        else:
            leaks = contaminated_brute([(r["doc_id"], r["text"] or "") for r in before if r["doc_id"] is not None], [(1, PASSAGE), (3, "too short")])
            assert (3, 1) in leaks
            assert key(after) == key(r for r in before if r["doc_id"] not in {d for d, _ in leaks})
        frame = spark.createDataFrame(after, frame.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, frame, folder).count() == frame.count()


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "none", [])).collect() == []
