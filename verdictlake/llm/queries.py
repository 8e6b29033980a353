"""The registered queries of this subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, html_extract, itemsets, language_id, mixing, phrases, quality_rules, secret_scan, sharding, simhash_dedup, suffix_dedup, token_codes, vector_dedup
from .common import table

#: Shards of op5_sharding.
SHARDS = 16


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False, digests=True
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.shard_names(SHARDS)).select("doc_id", "slot", "shard")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.duplicate_groups(table(spark, sf_dir, "documents"), radius=3)
    return groups.select("doc_id", simhash_dedup.hexadecimal().alias("fingerprint"), "component_id")


def op9_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_codes.write_codes(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_codes.read_documents(files)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", language_id.held_out())
    model = language_id.fit(docs.where("not held_out"))
    return language_id.predict(docs, model, keep=("doc_id", "held_out"))


def op11_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itemsets.digest(itemsets.closed_itemsets(table(spark, sf_dir, "sale_lines").where("flag <> 'returned'"), least=8, per=2000))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents"), length=400).drop("spans")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=10, top=2000)


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1_mixing aims at, which SQL can express: sizes, and the targets of sources."""
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op4_quality_rules, which SQL can express."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_html_extract": op2_html_extract,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_quality_rules": op4_quality_rules,
    "op5_sharding": op5_sharding,
    "op6_secret_scan": op6_secret_scan,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_simhash": op8_simhash,
    "op9_token_codes": op9_token_codes,
    "op10_language_id": op10_language_id,
    "op11_itemsets": op11_itemsets,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_phrases": op13_phrases,
    "mixing_targets": mixing_targets,
    "quality_base_counts": quality_base_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op5_sharding": sharding.oracle_sql(SHARDS),
    "op6_secret_scan": secret_scan.oracle_sql(),
    "op7_vector_dedup": vector_dedup.ORACLE_SQL,
    "op11_itemsets": itemsets.ORACLE_SQL,
    "op13_phrases": phrases.ORACLE_SQL,
    "mixing_targets": mixing.TARGETS_SQL,
    "quality_base_counts": quality_rules.BASE_SQL,
}
