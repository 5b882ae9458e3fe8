"""The subpackage's registered queries and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewarden.llm import bpe, chat, crosstok, decontaminate, fmindex, lattice, lpf, media, oracle, quality, repair, sigtree, toxicity, warc
from tracewarden.llm.common import load


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.to_media(load(spark, sf_dir, "documents")))


def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, load(spark, sf_dir, "labels")))


def op4_signature_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.jaccard_groups(load(spark, sf_dir, "documents"), size=5, num=75, den=100)


def op5_fm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.digest(fmindex.dedup_substrings(load(spark, sf_dir, "documents"), window=20))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(load(spark, sf_dir, "pages"))


def op7_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_documents(load(spark, sf_dir, "documents"))


def op8_lpf_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf.digest(lpf.dedup_factors(load(spark, sf_dir, "documents"), window=50))


def op9_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, load(spark, sf_dir, "labels")))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode_documents(load(spark, sf_dir, "documents")))


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstok.digest(crosstok.align_documents(load(spark, sf_dir, "documents"), groups=False))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.repair(repair.damage(load(spark, sf_dir, "conversations"))))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.ranges_of_windows(chat.with_probe(load(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": op1_media,
        "op2_spaced_seeds": op2_spaced_seeds,
        "op3_string_kernel": op3_string_kernel,
        "op4_signature_tree": op4_signature_tree,
        "op5_fm_index": op5_fm_index,
        "op6_warc": op6_warc,
        "op7_subword_lattice": op7_subword_lattice,
        "op8_lpf_dedup": op8_lpf_dedup,
        "op9_bradley_terry": op9_bradley_terry,
        "op10_bpe": op10_bpe,
        "op11_cross_tokenizer": op11_cross_tokenizer,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_chat_format": op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.texts()
