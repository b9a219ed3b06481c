"""The corpus pipeline: stages over the documents table, each written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from panelspark.llm import bpe, langid, packing, pii, simhash
from panelspark.llm.common import ship
from panelspark.session import shared_folder

#: Chunks that a worker of the last stage remembers: the stages before it have grown the JVM.
MEMO = 150_000


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; a null language is filled with the one told."""
    ship(spark)
    return langid.identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    ship(spark)
    return simhash.one_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked, and what discloses it removed or generalised."""
    ship(spark)
    return pii.sanitised(docs, whole=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in windows: a row per piece, its ids as 32-bit numbers."""
    ship(spark)
    return packing.pack(docs, bpe.word_bpe_path(), memo=MEMO)


STAGES = [
    ("language", identify),
    ("near_duplicates", deduplicate),
    ("personal_data", sanitise),
    ("packing", pack),
]

#: No stage can be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents. Each stage's rows are stored in the shared folder, so a
    lost executor costs one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
