"""From documents to packed sequences: language, exact copies, near copies, benchmark passages, packing.

Each stage takes what its predecessor kept and, but for the last, returns the
columns of ``documents`` and any others, whatever their names. ``run`` writes
each stage's rows and reads them again.

In all stages rows are told apart by doc_id (null too) and text, so a row is
judged by its own text though others share its id; of rows equal in both, one
stays after the second stage. Null and blank texts go in the first stage. An
empty table gives empty results. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm.common import discard, scratch
from auditloom.llm.decontamination import drop_contaminated
from auditloom.llm.exact_dedup import drop_exact_duplicates
from auditloom.llm.language_id import keep_identified
from auditloom.llm.minhash_dedup import drop_near_duplicates
from auditloom.llm.packing import pack
from auditloom.llm.queries import table, vocabulary


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those with letters, of which one language has half of the probability or more."""
    return keep_identified(docs, vocabulary("piece_bpe_32k.model"))


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of equal texts: one with a doc_id, then the longest, then the least doc_id."""
    return drop_exact_duplicates(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of near copies (similarity 0.8 or more): the least doc_id."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark (10 words in a row, or a whole shorter item)."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a row for each piece."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("language_id", identify), ("exact_dedup", dedup_exact), ("minhash_dedup", dedup_near), ("decontamination", decontaminate), ("packing", packed)]

#: SQL has no language model, no tokenizer and no linear program: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes once the next one's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
