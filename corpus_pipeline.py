"""From raw documents to packed token sequences: five stages, each written as Parquet and read again.

Language identification drops what it rejects, exact de-duplication and near de-duplication leave one document
of every group, personal data are replaced by surrogates, and what is left is packed into sequences.  Every
stage works on all rows that its predecessor kept.  All stages but the last return the columns of their input;
rows with a null text are rejected by the first stage, empty tables pass through, extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm import bloomdedup, harmonic, hyperminhash, langid, surrogates
from presslens.llm.common import staged


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; learns from all labelled rows that are not held out."""
    return langid.keep_identified(docs, langid.fit(docs.filter(~langid.held_out())))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return bloomdedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return hyperminhash.drop_near_copies(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data; ``n_chars`` follows the new text."""
    out = surrogates.with_surrogates(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return harmonic.pack_documents(docs)


STAGES = [("language identification", language), ("exact de-duplication", exact_copies),
          ("near de-duplication", near_copies), ("personal data", personal_data), ("packing", packing)]

#: Nearest centroids, surrogates and token ids cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
