"""A corpus from documents to token ids in five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Stages that hand whole texts to Python as their last step return what they have written themselves, in Arrow batches
of bounded bytes.
Language ID has a learned model and near-duplicate classes are components of a graph, so there is no SQL for the
whole; tests hold the stages against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedge.llm import languages, mixing, neardups, pieces, substrings
from sedge.llm.work import discard, settled, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, written to lang where that is null; those without a letter go.
    Where no labelled text is there to learn from, those with a letter stay."""
    return written(languages.with_language(docs, languages.train(docs)), "language_id")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least doc_id; different texts of one doc_id are judged apart."""
    return neardups.without_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that windows of 50 words repeat from documents of smaller doc_id."""
    return settled("substring_dedup", lambda: substrings.cleaned(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it: never, once or twice."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document."""
    return written(pieces.encode_texts(docs, pieces.model_path()), "encode")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(f"pipeline-{name}", lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
