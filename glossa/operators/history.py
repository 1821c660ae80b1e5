"""Training-history analysis and per-epoch losses.

Per-row scoring logs ``(epoch, row_id, logit, label)`` reduce to one row per
epoch; everything after that works on the small history table (one row per
epoch, bounded by the number of epochs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.scores import bce_with_logits, sigmoid_label
from glossa.operators.sequence import assign_batches
from glossa.session import cut_lineage
from glossa.sources.tables import require_columns, require_rows

HISTORY_COLUMNS = ["epoch", "train_loss", "val_loss", "val_accuracy"]


def scored_rows(log: DataFrame) -> DataFrame:
    """Per-row loss (B23) and correctness of the ``sigmoid >= 0.5`` rule."""
    return log.withColumn("loss", bce_with_logits("logit", "label")).withColumn(
        "correct", (sigmoid_label("logit") == F.col("label")).cast("int"))


def weighted_loss(log: DataFrame) -> DataFrame:
    """Per epoch the sample-weighted mean loss and accuracy (= plain row means)."""
    s = scored_rows(log)
    return s.groupBy("epoch").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("loss").alias("val_loss"),
        F.avg(F.col("correct").cast("double")).alias("val_accuracy"),
    )


def batch_mean_loss(log: DataFrame, batch_size: int = 64, order: str = "row_id") -> DataFrame:
    """Unweighted mean of batch means; batches are consecutive blocks per epoch."""
    s = assign_batches(scored_rows(log), batch_size, [order], partition_by=["epoch"])
    per_batch = s.groupBy("epoch", "batch").agg(F.avg("loss").alias("batch_loss"))
    return per_batch.groupBy("epoch").agg(F.avg("batch_loss").alias("train_loss"), F.count(F.lit(1)).alias("batches"))


def history_from_log(log: DataFrame, batch_size: int = 64) -> DataFrame:
    """The history table ``(epoch, train_loss, val_loss, val_accuracy)`` from a scoring log."""
    train = batch_mean_loss(log, batch_size).select("epoch", "train_loss")
    val = weighted_loss(log).select("epoch", "val_loss", "val_accuracy")
    return train.join(val, "epoch")


def check_history(history: DataFrame) -> DataFrame:
    """A2 + A4 on a history table."""
    require_columns(history, HISTORY_COLUMNS, "History lacks")
    # a few rows per epoch, computed once for the probe and the caller
    return require_rows(cut_lineage(history), "no epochs in the history")


def improved_epochs(history: DataFrame) -> DataFrame:
    """``improved`` = val_loss strictly below every earlier epoch's (first epoch true)."""
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best_before = F.min("val_loss").over(w)
    return history.withColumn("improved", F.coalesce(F.col("val_loss") < best_before, F.lit(True)))


def best_epoch(history: DataFrame) -> DataFrame:
    """The lowest val_loss, earliest epoch on ties; plus the best accuracy epoch."""
    return history.agg(
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"),
        F.min("val_loss").alias("best_val_loss"),
        F.min_by("epoch", F.struct(-F.col("val_accuracy"), F.col("epoch"))).alias("best_accuracy_epoch"),
        F.max("val_accuracy").alias("best_val_accuracy"),
    )


def history_long(history: DataFrame) -> DataFrame:
    """Long form ``(epoch, metric, value)`` by unpivot."""
    return history.unpivot("epoch", ["train_loss", "val_loss", "val_accuracy"], "metric", "value")


def append_history(row: DataFrame, path: str) -> None:
    """Append one epoch row to the history table (parquet, append mode)."""
    require_columns(row, HISTORY_COLUMNS, "History row lacks")
    row.select(*HISTORY_COLUMNS).write.mode("append").parquet(path)
