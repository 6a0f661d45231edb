"""Pipeline of the training-data operators over documents.

quality classifier, near-duplicates, benchmark decontamination, personal data, SentencePiece encoding.  Each stage works
on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm.common import remove, shared_dir, table, workspace
from shelfmark.llm.compression_quality import keep_good, learn
from shelfmark.llm.dart_minhash import keep_one
from shelfmark.llm.decontaminate import drop_contaminated
from shelfmark.llm.suffix_pieces import MODEL, encode_documents
from shelfmark.llm.surrogates import pseudonymise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts (score of 0.5 or more)."""
    return keep_good(docs, learn(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars follows the text."""
    out = pseudonymise(docs).drop("__n_entities")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, round_trip."""
    return encode_documents(docs, public_tokenizers.path(MODEL), ("doc_id", "lang", "source"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("personal_data", personal_data),
    ("sentencepiece", encode),
]
#: Signatures, compression and merges have no SQL form; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of what they write to the shared folder only the last result stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with workspace():
            out = stage(spark, docs, sf_dir)
            target = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
            out.write.parquet(target)
        docs = spark.read.parquet(target)
        if before:
            remove(spark, before)
        before = target
    return docs
