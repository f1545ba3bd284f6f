"""A corpus pipeline of the operators in claimspark.llm; each stage works on what the one before kept.

Defined cases of all stages: columns other than doc_id, text, source and lang are carried as they
are, whatever their names; a fully repeated row is a row of its own until exact deduplication keeps
one; an empty table goes through as an empty table; no text is cut before its last kept word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimspark.llm import exact_dedup, language_id, mixing, packing, simhash
from claimspark.llm._common import discard, settled, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in some language; those without letters go.

    Null and empty texts have no letters. Rows with a null lang or id are not learned from but
    judged like all others; if nothing can be learned, all texts with letters stay.
    """
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space: the longest, then smallest id.

    A null id comes after all ids; of rows that tie, one stays.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of SimHash links: one with its smallest id.

    Documents with null or shared ids are told apart by their texts, so each component keeps one.
    """
    return simhash.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one that a source's target ends in is cut there.

    A null source is a source, the last one; documents without a label have the weight 1, also if
    labels is empty.
    """
    return mixing.apply_mix(docs, mixing.label_quality(table(spark, sf_dir, "labels")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in which sequence.

    A document that the mix took several times is packed as often, under one id; a null id is carried.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has no tokenizer, hash of shingles or trained model: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again.

    What a stage wrote on its way, and the stage before it, are deleted once its result is written.
    """
    docs, written = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            discard(spark, written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
