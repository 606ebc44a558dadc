"""The operators' queries over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chatformat, html_text, langid, mixing, neardup, packing, pii, prefixes, quality, secrets, spelling, toxicity, twins, vectors
from .base import table


def tokenizer_files() -> tuple[str, str]:
    """The vocabulary file for ``tokenizers`` and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), width=4, percent=80).drop("t")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_files())


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings"), limit=0.95)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.detect(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.shared(table(spark, sf_dir, "conversations"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.checked(table(spark, sf_dir, "conversations"), *tokenizer_files())


QUERIES = {
    "op1_quality": op1_quality,
    "op2_neardup": op2_neardup,
    "op3_html_text": op3_html_text,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_packing": op6_packing,
    "op7_vectors": op7_vectors,
    "op8_langid": op8_langid,
    "op9_pii": op9_pii,
    "op10_secrets": op10_secrets,
    "op11_spelling": op11_spelling,
    "op12_prefixes": op12_prefixes,
    "op13_chat": op13_chat,
}

ORACLE_SQL: dict[str, str] = {"op11_spelling": twins.SPELLING, "op12_prefixes": twins.PREFIXES, "op13_chat": twins.FORMATTED}
