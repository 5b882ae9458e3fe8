"""The corpus pipeline: five filters and transforms over the documents, each a job over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewarden.llm import bpe, decontaminate, lpf, sigtree, toxicity
from tracewarden.llm.common import load, written

#: SQL can't express trained scores, similarity components and merges of tokens; tests/llm holds them against brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: documents that the string-kernel machine rejects go."""
    return toxicity.kept(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates, the document with the smallest id stays.

    Rows without an id can't be named by a group and stay.
    """
    groups = sigtree.jaccard_groups(docs)
    return docs.join(groups.filter("component_id < doc_id").select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: later copies of 50-byte strings are cut out of the texts, whole characters at a time."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    safe = {c: f"carried_column_{k}" for k, c in enumerate(rest)}  # names that no operator uses
    kept = lpf.dedup_factors(docs.withColumnsRenamed(safe), window=50, characters=True, carry=tuple(safe.values()))
    kept = kept.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.char_length("text").cast("long"))
    return kept.select("doc_id", "text", "n_chars", *[F.col(new).alias(c) for c, new in safe.items()]).select(*[F.col(f"`{c}`") for c in docs.columns])


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark passage go."""
    found = decontaminate.contaminated(docs, load(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding of what is left."""
    return bpe.digest(bpe.encode_documents(docs))


STAGES = [("toxicity", clean), ("jaccard_join", distinct), ("lpf_dedup", first_copies), ("decontaminate", unleaked), ("bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
