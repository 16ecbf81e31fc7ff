"""The registered queries of the text operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    bpe,
    collocations,
    exact,
    fingerprints,
    licences,
    mixing,
    ngram_join,
    packing,
    pii,
    quality,
    suffixes,
    tokens,
    whitening,
)
from plumbline.llm.rows import table

#: The tokenizer whose ids are packed.
TOKENIZER = "word_bpe_49k.json"
#: The tokenizer whose tokens are counted.
RANKS = "byte_bpe_50k.tiktoken"


def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, folder, "documents"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, folder, "documents"))


def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licences(table(spark, folder, "documents"))


def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.exact_groups(table(spark, folder, "documents"))
    return found.drop("__file", "__row")


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    found = ngram_join.linked(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    found = mixing.mix(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    file = public_tokenizers.path(RANKS)
    return tokens.token_counts(table(spark, folder, "documents"), file, public_tokenizers.PATTERN)


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op10_pack(spark: SparkSession, folder: str) -> DataFrame:
    file = public_tokenizers.path(TOKENIZER)
    return packing.pack(table(spark, folder, "documents"), file)


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    file = public_tokenizers.path(RANKS)
    return bpe.digests(table(spark, folder, "documents"), file, public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_licences": op3_licences,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_mix_sources": op6_mix_sources,
    "op7_token_counts": op7_token_counts,
    "op8_quality": op8_quality,
    "op9_personal_data": op9_personal_data,
    "op10_pack": op10_pack,
    "op11_collocations": op11_collocations,
    "op12_whitening": op12_whitening,
    "op13_byte_bpe": op13_byte_bpe,
}
