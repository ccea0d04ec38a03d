"""From documents to packed sequences: language, near duplicates, personal data, mixing, packing.

Edge cases, for every stage: null, empty and very long texts and nulls in any other column are taken as they
are, columns beyond those of ``documents`` are dropped, and an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import language, mixing, neardup, packing, pii
from tidemark.sources.checkpoints import shared_folder


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, ``lang`` being what their text is identified as; the mix goes by it.

    Those without a letter go, null and empty texts among them. Repeated rows stay. If nothing can be learned, ``lang`` stays.
    """
    return language.keep_identified(docs, relabel=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8).

    The one of smallest doc_id stays, null last; of rows that tie (repeated rows among them) any one. Documents without words are like no other.
    """
    return neardup.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; repeated rows each."""
    return pii.scrub(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document; each identified language of a source is a pool with its source's weight.

    A document without words is never taken, rows that are alike share their draws one to one.
    """
    return mixing.mixed_documents(docs, by_language=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence; an empty text is its end mark alone."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", identify_language),
    ("neardup", drop_near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Sketches, hash draws and tokens can't be written in SQL; tests hold the rows of the language,
#: near-duplicate and PII stages against brute force, mixing against its plan and packing against its tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet in the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
