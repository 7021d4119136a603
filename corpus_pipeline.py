"""A training corpus from raw documents: language, toxicity, exact dedup, near dedup, packing.

Each stage gets what its predecessor kept, all but the last return the columns of ``documents``. A stage's models and counts
come from its own input.

In every stage null and empty texts count as texts without a word, rows with a null doc_id are documents, columns that the
stage doesn't need go along whatever their names, and an empty table gives an empty result. What becomes of repeated rows
stands with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import shingles
from lodestone.llm.common import Scratch, read_table
from lodestone.llm.exact import kept_rows
from lodestone.llm.language import identify
from lodestone.llm.packing import pack_documents, read_tokenizer
from lodestone.llm.queries import vocabulary
from lodestone.llm.toxicity import tag_toxicity


def _restored(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col(f"_carried{i}").alias(c) for i, c in enumerate(docs.columns)))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language; those without any letter (null and empty ones too) go. Repeated rows stay as they are.

    Where no language could be learned, all with a letter stay.
    """
    found = identify(docs, carry=True)
    text = F.col(f"_carried{docs.columns.index('text')}")
    return _restored(found.where((F.col("lang_pred") != "und") | text.rlike(r"\p{L}")), docs)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger does not call toxic; null and empty texts and repeated rows are scored like others."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return _restored(tag_toxicity(docs, labels, carry=True).where("predicted = 0"), docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts (null and empty ones are equal), of repeated rows one."""
    return kept_rows(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near copies link (five words, 0.8), the document with the smallest doc_id, ties by hash of the text.

    Texts without a word and rows with a null doc_id stay. Rows of one doc_id are judged apart, each by its own text.
    """
    return shingles.without_near_copies(docs, words=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all token pieces in sequences of 2048 tokens; an empty text is one piece, repeated rows are packed each."""
    return pack_documents(docs, read_tokenizer(vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("language", by_language),
    ("toxicity", by_toxicity),
    ("exact dedup", without_copies),
    ("near dedup", without_near_copies),
    ("packing", packed),
]

#: Learned models are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next reads it, and dropped when that is written."""
    scratch, docs, before = Scratch(spark, "pipeline"), read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before:
            scratch.drop(before)
        before = name.replace(" ", "-")
    return STAGES[-1][1](spark, docs, sf_dir)
