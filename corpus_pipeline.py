"""Corpus preparation in five stages; belongs to the subpackage ``glossa.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet in the cluster's shared folder and read again as the next
stage's documents.  All stages but the last return the columns of documents.

quality rules   documents that the rules reject leave
line dedup      recurring line templates leave the texts (n_chars follows)
simhash         one row of each group of near-duplicates stays
mixing          rows appear as often as the mix takes them (0, 1 or 2 times)
packing         one row per piece: doc_id, piece, start, length, ids_crc32,
                sequence_id, offset

Stages handle null, empty and long texts, repeated rows, empty tables and
further columns as their operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import line_templates, mixing, packing, quality_rules, simhash
from glossa.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring_lines(docs).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=simhash.SHINGLE, bits=simhash.BITS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Fingerprints, trades and packings have no SQL; tests hold each stage against its brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/corpus-pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
