"""A corpus pipeline over ``documents``: language, near-duplicates, secrets, mixture, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdictlake.llm import byte_bpe, language_id, mixing, secret_scan, simhash_dedup
from verdictlake.llm.common import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: no letters, or two languages nearly as likely."""
    model = language_id.fit(docs.where(~language_id.held_out()))
    kept = language_id.predict(docs, model, keep=tuple(COLUMNS))
    return kept.where("not lang_rejected").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, a similarity of 0.8) the row with the smallest doc_id stays; of rows that are alike one."""
    return simhash_dedup.without_near_copies(docs, similarity=0.8).select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret found is replaced by a mark; the documents stay."""
    return secret_scan.redact(docs).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: documents are left out, stay, or come twice."""
    return mixing.mix(docs).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture, with digests of the ids and of the bytes they decode to."""
    return byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True, digests=True)


STAGES = [
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", token_stage),
]

#: Compression, a dynamic programme and BPE merges are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
