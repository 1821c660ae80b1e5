"""Model comparison on a unified predictions table.

Input: ``(model, doc_id, text, label, prediction, ...)``.  One scan feeds
every aggregate; grids of fixed size (2x2 labels, 5 length buckets) are
generated per model with ``explode`` instead of a join, and empty cells are
kept (samples 0, accuracy null) like ``observed=False``.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import (LENGTH_LABELS, correct_flag, length_bucket_id, length_bucket_label, percent_label,
                                   word_count)

BINARY_LABELS = [0, 1]


def _correct(df: DataFrame) -> F.Column:
    return correct_flag("label", "prediction")


def accuracy(pred: DataFrame) -> DataFrame:
    """Samples and accuracy per model (all labels count)."""
    return pred.groupBy("model").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(_correct(pred).cast("double")).alias("accuracy"),
    )


def confusion(pred: DataFrame) -> DataFrame:
    """D11 long form: the fixed 2x2 grid per model, rows true label, columns predicted.

    Labels outside {0, 1} are ignored here (they still count in accuracy).
    """
    cells = [F.struct(F.lit(y).alias("label"), F.lit(p).alias("prediction"), F.count_if(
        (F.col("label") == y) & (F.col("prediction") == p)).alias("n")) for y in BINARY_LABELS for p in BINARY_LABELS]
    return pred.groupBy("model").agg(F.array(*cells).alias("cells")).select("model", F.inline("cells"))


def confusion_wide(pred: DataFrame) -> DataFrame:
    """D11 wide form: tn, fp, fn, tp per model in one pass."""
    y, p = F.col("label"), F.col("prediction")
    return pred.groupBy("model").agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def with_length_bucket(pred: DataFrame, text_col: str = "text") -> DataFrame:
    """B15 + B16 columns."""
    return pred.withColumn("word_count", word_count(text_col)).withColumn("bucket_id", length_bucket_id("word_count"))


def accuracy_by_length(pred: DataFrame) -> DataFrame:
    """D12 + C11 + F3 + F5: every model x every bucket, empty buckets kept.

    Columns ``model, bucket_id, length_bucket, samples, accuracy``, ordered by
    bucket order then model.
    """
    b = with_length_bucket(pred)
    agg = b.groupBy("model", "bucket_id").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(_correct(b).cast("double")).alias("accuracy"),
    )
    # the model list comes from the (small) aggregate, not from a second scan of the predictions
    grid = agg.select("model").distinct().select(
        "model", F.explode(F.sequence(F.lit(0), F.lit(len(LENGTH_LABELS) - 1))).alias("bucket_id"))
    out = grid.join(agg, ["model", "bucket_id"], "left").select(
        "model", "bucket_id", length_bucket_label("bucket_id").alias("length_bucket"),
        F.coalesce("samples", F.lit(0)).cast("bigint").alias("samples"), "accuracy")
    return out.orderBy("bucket_id", "model")


def accuracy_pivot(summary: DataFrame, models: Sequence[str]) -> DataFrame:
    """one row per bucket (fixed bucket list), one accuracy column per model."""
    return summary.groupBy("bucket_id", "length_bucket").pivot("model", list(models)).agg(F.first("accuracy"))


def same_examples(pred: DataFrame, models: Sequence[str]) -> DataFrame:
    """For every pair of models, examples missing on either side and label disagreements.

    One groupBy on ``doc_id`` pivots each model's rows of the example into
    columns; every model pair is then a handful of conditional counts in a
    single aggregate (no self join, no pair rows).  An example is missing if
    the model has no row of it.  Present on both sides, it mismatches unless
    both hold it equally often with one and the same label (null labels agree
    with null labels only).
    """
    models = list(models)
    value = F.coalesce(F.col("label").cast("string"), F.lit("null"))
    one = F.when(F.min(value) == F.max(value), F.concat_ws("x", F.count(F.lit(1)), F.min(value))).otherwise(F.lit("mixed"))
    examples = pred.groupBy("doc_id", "model").agg(one.alias("held"))
    wide = examples.groupBy("doc_id").pivot("model", models).agg(F.first("held"))
    aggs = []
    pairs = list(combinations(models, 2))
    for a, b in pairs:
        ca, cb = F.col(f"`{a}`"), F.col(f"`{b}`")
        aggs += [
            F.count_if(ca.isNull() & cb.isNotNull()).alias(f"{a}|{b}|missing_left"),
            F.count_if(ca.isNotNull() & cb.isNull()).alias(f"{a}|{b}|missing_right"),
            F.count_if(ca.isNotNull() & cb.isNotNull() & ((ca != cb) | (ca == "mixed"))).alias(f"{a}|{b}|label_mismatch"),
        ]
    row = wide.agg(*aggs)
    stacked = F.explode(F.array(*[
        F.struct(F.lit(a).alias("model_left"), F.lit(b).alias("model_right"),
                 F.col(f"`{a}|{b}|missing_left`").alias("missing_left"),
                 F.col(f"`{a}|{b}|missing_right`").alias("missing_right"),
                 F.col(f"`{a}|{b}|label_mismatch`").alias("label_mismatch"))
        for a, b in pairs]))
    out = row.select(stacked.alias("s")).select("s.*")
    return out.withColumn("same_examples", (F.col("missing_left") + F.col("missing_right") + F.col("label_mismatch")) == 0)


def align_check(expected: DataFrame, observed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Full outer join on the key, counts of rows on one side only and label mismatches."""
    e = expected.select(key, F.col("label").alias("_le"))
    o = observed.select(key, F.col("label").alias("_lo"))
    j = e.join(o, key, "full_outer")
    return j.agg(
        F.count_if(F.col("_lo").isNull()).alias("only_expected"),
        F.count_if(F.col("_le").isNull()).alias("only_observed"),
        F.count_if(F.col("_le").isNotNull() & F.col("_lo").isNotNull() & (F.col("_le") != F.col("_lo"))).alias(
            "label_mismatch"),
    ).withColumn("aligned", (F.col("only_expected") + F.col("only_observed") + F.col("label_mismatch")) == 0)


def model_comparison(pred: DataFrame) -> DataFrame:
    """Samples, accuracy (+ percent label, B26) and confusion counts per model, one pass."""
    y, p = F.col("label"), F.col("prediction")
    out = pred.groupBy("model").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(correct_flag(y, p).cast("double")).alias("accuracy"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 1) & (p == 1)).alias("tp"),
    )
    return out.withColumn("accuracy_label", percent_label("accuracy"))
