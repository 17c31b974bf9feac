"""The corpus pipeline: five stages over the documents, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kelpwood.llm import exact_dedup, packing, quality, similar_texts, toxicity
from kelpwood.llm.queries import tokenizer
from kelpwood.llm.shared import passing, shared_folder, stored, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are
    judged as texts without words; repeated rows get equal verdicts."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go. Null and empty texts have the score of a
    text without words; without labels nothing is learned, and all stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays. Null equals empty;
    a null id is smaller than any other; rows repeated with the same id stay or go together."""
    return exact_dedup.drop_copies(docs)


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more), the document
    with the smallest doc_id stays. Texts without words are equal; a null id is larger than any other."""
    return similar_texts.drop_similar_texts(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences; a null or empty text is the end id alone."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_civil),
    ("exact_dedup", keep_distinct),
    ("near_dedup", keep_unlike),
    ("packing", pack),
]

#: Trained models and packing can't be written as SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table; the result of the last. What a stage
    stores on its way goes as soon as its own result is written.

    Defined results: null texts count as empty; an empty table, or one of which
    nothing is left after a stage, gives an empty result; further columns go
    along up to the last stage, whatever their names; rows repeated with the
    same id and text are one document, and stay or go together until they are
    packed; of equal texts the largest doc_id stays, of near copies the smallest.
    """
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for name, stage in STAGES:
        with passing(spark):
            docs = stored(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
