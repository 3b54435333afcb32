"""The corpus pipeline: language, near-duplicates, personal data, mixture, packing; every stage from the Parquet of the one before.

Cases, in every stage: a null text is the empty text, whose language is rejected, so nulls go in the first stage; a null doc_id, source or
lang is kept; rows repeated are near-duplicates of each other and one stays; extra columns, whatever their names, are kept up to the
last stage; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import langid, mixing, neardup, packing, pii
from gleanery.session import drop_folder, shared_folder


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    return langid.keep_identified(docs, langid.train(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard similarity 0.8 or more) stays."""
    return neardup.keep_representatives(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it are replaced."""
    return pii.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, in the order of its shards and of the places in them."""
    return mixing.mix(docs, ordered=True, labels=False)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a packed sequence."""
    return packing.packed_digest(packing.pack_documents(docs))


STAGES = [("language_id", identify), ("simhash_near_dedup", deduplicate), ("pii", sanitise), ("source_mixing", mix), ("best_fit_packing", pack)]
#: Fingerprints and tokens have no SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; tables between stages go to the session's shared folder, and each goes once the next one is written."""
    at = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), None
    for i, (name, stage) in enumerate(STAGES):
        here = f"{at}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(here), here
    return docs
