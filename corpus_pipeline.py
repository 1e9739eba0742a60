"""A corpus pipeline: five stages over the documents table, each on what the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage as Parquet in the shared checkpoint
folder and reads it again, so a lost executor never costs more than one stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, language, secrets, simhash
from tidemark.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents in no language that the labels know go, and so do texts that are null or without a letter.

    Rows with a null doc_id, source or lang are judged like any other; repeated rows stay or go together.
    """
    return language.clean(docs, docs).select(*COLUMNS)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each component of near copies, the document of the smallest doc_id stays.

    Rows with a null doc_id stay; so do all rows that repeat the doc_id which stays, if their text belongs to the component.
    """
    return simhash.keep_one(docs).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a window of an item go; null texts have no words and stay.

    Without a benchmark row, or with null and empty items alone, all documents stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: found secrets are masked in the text, which stays; every row stays, null texts as they are."""
    return secrets.masked(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: doc_id and token ids, with digests of the ids and of what they decode to; null text is empty: no ids."""
    return bpe.tokenised(docs, bpe.public_vocabulary())


STAGES = [("language", identified), ("simhash", deduplicated), ("decontaminate", decontaminated), ("secrets", without_secrets), ("bpe", encoded)]

#: Language ID is a fitted model and SimHash needs XXH64: no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; returns the last one's rows.

    A stage's Parquet goes once the next one is written. The last one's stays in the checkpoint folder: it is what the
    returned DataFrame reads. An empty table gives an empty one.
    """
    docs = table(spark, sf_dir, "documents").select(*[F.col(c) for c in COLUMNS])
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if before is not None:
            removed(spark, before)
        before = path
    return docs
