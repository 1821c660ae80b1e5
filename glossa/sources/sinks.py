"""Sinks and reloads between jobs.

Every intermediate the reference pickles or writes as CSV/NumPy is a
parquet table here, partitioned by the column later jobs filter on.  All but
the summary are published by manifest (``versions``): rewriting a store never
destroys the one before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.session import ensure_checkpoint_dir
from glossa.sources import versions
from glossa.sources.buckets import bucket_count, open_bucketed, write_bucketed
from glossa.sources.tables import PREDICTION_COLUMNS, require_columns

MODEL_WEIGHT_COLUMNS = ["feature_id", "ratio", "w"]
MODEL_PARAM_COLUMNS = ["alpha", "C", "intercept", "n_features"]


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for a job's intermediate tables below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def write_splits(split_df: DataFrame, path: str) -> None:
    """One table, partitioned by split (train / validation / test)."""
    require_columns(split_df, ["doc_id", "label", "split"])
    versions.publish(split_df, path, ["split"])


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    return versions.published(spark, path)


def read_split(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Partition pruning reads only the requested split."""
    return read_splits(spark, path).filter(F.col("split") == name)


def write_features(presence: DataFrame, path: str) -> None:
    """Sparse binary matrix as ``(split, doc_id, feature_id)``, sorted by document inside files."""
    require_columns(presence, ["split", "doc_id", "feature_id"])
    rows = presence.select("split", "doc_id", "feature_id").repartition("split", "doc_id").sortWithinPartitions("doc_id", "feature_id")
    versions.publish(rows, path, ["split"])


def read_features(spark: SparkSession, path: str, split: str) -> DataFrame:
    return versions.published(spark, path).filter(F.col("split") == split).select("doc_id", "feature_id")


def write_feature_store(presence: DataFrame, weights: DataFrame, path: str) -> None:
    """Presence (split, doc_id, feature_id) and the features' columns (feature_id, ratio, ...), both bucketed by feature."""
    require_columns(presence, ["split", "doc_id", "feature_id"])
    require_columns(weights, ["feature_id"])
    spark = presence.sparkSession
    write_bucketed(presence.select("split", "doc_id", "feature_id"), f"{path}/presence", ["feature_id"])
    write_bucketed(weights, f"{path}/weights", ["feature_id"])
    width = weights.agg(F.coalesce(F.max("feature_id") + 1, F.lit(0)).cast("long").alias("width"))
    width.withColumn("buckets", F.lit(bucket_count(spark))).coalesce(1).write.parquet(f"{path}/store")  # last: the store is whole


def read_feature_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Presence and feature columns; a join of the two on feature_id reads them without an exchange."""
    buckets = spark.read.parquet(f"{path}/store").first()["buckets"]
    return tuple(open_bucketed(spark, f"{path}/{name}", ["feature_id"], buckets) for name in ("presence", "weights"))


def feature_vectors(spark: SparkSession, path: str, split: str, value: str | None = None) -> DataFrame:
    """(doc_id, features): the store as sparse vectors for other learners; values 1, or the features' column ``value``.

    Documents without any feature have no row, as in the store.
    """
    from pyspark.ml.linalg import SparseVector, VectorUDT

    width = int(spark.read.parquet(f"{path}/store").first()["width"])
    presence, weights = read_feature_store(spark, path)
    rows = presence.filter(F.col("split") == split)
    rows = rows.join(weights.select("feature_id", F.col(value).cast("double").alias("v")), "feature_id") if value else rows.withColumn("v", F.lit(1.0))
    pairs = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("feature_id").cast("int").alias("i"), "v"))).alias("p"))
    to_vector = F.udf(lambda i, v: SparseVector(width, i, v), VectorUDT())
    return pairs.select("doc_id", to_vector("p.i", "p.v").alias("features"))


def vocabulary(spark: SparkSession, path: str, build: Callable[[], DataFrame], reuse: bool = True) -> DataFrame:
    """Reuse the stored vocabulary when present, else build and store it."""
    if not reuse or versions.current(spark, path) is None:
        versions.publish(build(), path)
    return versions.published(spark, path)


def save_model(weights: DataFrame, params: DataFrame, path: str) -> None:
    """Weight table and one-row parameter table, published together."""
    require_columns(weights, MODEL_WEIGHT_COLUMNS)
    require_columns(params, MODEL_PARAM_COLUMNS)
    version = versions.new_version(path)
    weights.write.parquet(f"{version}/weights")
    params.coalesce(1).write.parquet(f"{version}/params")
    versions.commit(weights.sparkSession, path, version)


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A11 reload with the key check of the reference."""
    version = versions.require_current(spark, path)
    weights = spark.read.parquet(f"{version}/weights")
    params = spark.read.parquet(f"{version}/params")
    require_columns(weights, MODEL_WEIGHT_COLUMNS, "Saved weights lack")
    require_columns(params, MODEL_PARAM_COLUMNS, "Saved parameters lack")
    row = params.first().asDict()
    width = weights.agg(F.count(F.lit(1)).alias("n"), F.max("feature_id").alias("last")).first()
    if width["n"] != row["n_features"] or (width["last"] is not None and width["last"] >= row["n_features"]):
        raise ValueError(f"saved weights have {width['n']} features up to id {width['last']}, the parameters say {row['n_features']}")
    return weights, row


def write_predictions(pred: DataFrame, path: str) -> None:
    """The unified predictions table; a model that is written again replaces its rows, the other models stay."""
    require_columns(pred, ["model", "text", "label", "prediction"])
    versions.publish_parts(pred.select(*[c for c in PREDICTION_COLUMNS if c in pred.columns]), path, "model")


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The latest predictions of every model."""
    return versions.published_parts(spark, path)


def write_summary(summary: DataFrame, path: str) -> None:
    """The bucket summary as one CSV file (models x 5 buckets rows, small by construction)."""
    summary.orderBy("bucket_id", "model").coalesce(1).write.mode("overwrite").option("header", True).csv(path)
