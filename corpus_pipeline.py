"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, decontamination, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. ``run``
writes each stage's rows as Parquet in the session's shared folder and reads them back for the next stage.

Defined results: an empty ``documents`` table goes through as an empty table; null texts fail the quality rules and go;
extra columns are carried to the last stage, which returns doc_id, n_tokens, ids and text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontam, line_dedup, ngram_join, quality
from corvane.llm.common import table
from corvane.session import stored

#: Bytes of the table of frequent pieces. Less than by default, since the driver has held four other stages' plans before; pieces
#: beyond are folded where they stand, with the same result.
HELD_BYTES = 24 << 20

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned decision list keep."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document or line has."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least doc_id."""
    return ngram_join.representatives(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    added = ("__n_words__", "__spans__", "__items__")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), added=added)
    return found.where(~decontam.contaminated(decontam.n_hit("__spans__"), F.col("__n_words__"))).drop(*added)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the text that the ids decode to."""
    tokenizer = bpe.Tokenizer(spark, bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)
    coded = tokenizer.encode(docs.select("doc_id", "text"), most=HELD_BYTES)
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark_decontamination),
    ("byte_bpe", tokenization),
]
#: Learned rules, minimum hashes and merges aren't expressed in SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
