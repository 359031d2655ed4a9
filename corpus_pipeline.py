"""Corpus pipeline: stages over `documents`, each calling one operator and passing on what it keeps.

`run` applies the stages in turn. SQL can't express them (a fitted classifier, a fitted language
model, signatures, a tokenizer), so ORACLE_SQL is None and tests compare each stage with a
brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomline.llm import langid, minhash, packing, quality
from loomline.llm.common import cut, stored, table
from loomline.llm.queries import tokenizer_path
from loomline.session import discard


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quadratic discriminant doesn't reject; it learns from all labels."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the hierarchical classifier recognises."""
    return langid.keep(docs, langid.fit(docs, "text", "lang"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    A row goes if its own text links, directly or not, with a text under a smaller id. Rows of one
    id and text are one document, told more than once: all stay or all go. Rows without an id, and
    texts without a word, stay."""
    gone = cut(minhash.near_duplicates(docs, size=5).where("not kept").select(F.col("doc_id").alias("_id"), "text_hash"))
    return docs.join(gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("text_hash")), "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("language", keep_language), ("near_dedup", drop_near_copies), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what a stage keeps is stored, since the next reads it more than once, and
    deleted once the next one's is."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
