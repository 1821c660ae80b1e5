"""Naive-Bayes feature statistics and weighting.

Counts are alpha-free and computed once; any number of smoothing values is a
projection on the same count table (the reference recomputes them in every
grid cell).  Class frequencies use conditional aggregation in one pass
instead of two class filters, and Spark's partial (map-side) aggregation
folds a frequent feature inside each task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import explode_items
from glossa.plans.hotjoin import split_join
from glossa.session import cut_lineage


def check_alpha(alpha: float) -> None:
    if alpha <= 0:
        raise ValueError(f"smoothing needs a positive alpha, got {alpha}")


def check_training_labels(df: DataFrame, label_col: str = "label") -> None:
    """Labels only 0/1 and both classes present (one aggregation row)."""
    row = df.agg(
        F.count_if(~F.col(label_col).isin(0, 1) | F.col(label_col).isNull()).alias("bad"),
        F.count_if(F.col(label_col) == 1).alias("pos"),
        F.count_if(F.col(label_col) == 0).alias("neg"),
    ).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} training rows have a label other than 0 or 1")
    if not row["pos"] or not row["neg"]:
        raise ValueError("training rows of one class only")


def doc_features(docs: DataFrame, features_col: str = "features", feature_col: str = "feature") -> DataFrame:
    """(doc_id, label, features[]) -> one row per present feature (already distinct per doc)."""
    return explode_items(docs, features_col, feature_col, "doc_id", "label")


def class_doc_freq(feature_rows: DataFrame, feature_col: str = "feature", label_col: str = "label") -> DataFrame:
    """D6 without alpha: per feature, documents of each class that contain it."""
    y = F.col(label_col).cast("long")
    return feature_rows.groupBy(feature_col).agg(
        F.sum(y).alias("n_pos"),
        F.sum(F.lit(1) - y).alias("n_neg"),
    )


def log_count_ratio(counts: DataFrame, alpha: float = 1.0, materialize: bool = True) -> DataFrame:
    """``ln((p/|p|_1) / (q/|q|_1))`` with p = n_pos + alpha, q = n_neg + alpha.

    The two smoothed totals are one global aggregate read as two scalars.
    The count table feeds both the totals and the per-feature rows, so it is
    materialised once (reliable checkpoint, one row per feature) instead of
    re-running tokenising and counting for the second consumer.
    """
    check_alpha(alpha)
    if materialize:
        counts = cut_lineage(counts)
    pos_total, neg_total = smoothed_totals(counts, alpha)
    a = F.lit(float(alpha))
    p = (F.col("n_pos") + a) / F.lit(pos_total)
    q = (F.col("n_neg") + a) / F.lit(neg_total)
    return counts.withColumn("ratio", F.log(p / q))


def smoothed_totals(counts: DataFrame, alpha: float) -> tuple[float, float]:
    """``sum(n_pos) + alpha * V`` and ``sum(n_neg) + alpha * V`` (one aggregate row, two scalars)."""
    row = counts.agg(F.sum("n_pos").alias("sp"), F.sum("n_neg").alias("sn"), F.count(F.lit(1)).alias("v")).first()
    v = row["v"] or 0
    return float((row["sp"] or 0) + alpha * v), float((row["sn"] or 0) + alpha * v)


def ratios_for_alphas(counts: DataFrame, alphas: Sequence[float], key_col: str = "feature",
                      materialize: bool = True) -> DataFrame:
    """H2 helper: one ratio column per alpha from one count table (``ratio_0``, ``ratio_1`` ...)."""
    if materialize:
        counts = cut_lineage(counts)
    out = counts
    for i, alpha in enumerate(alphas):
        check_alpha(alpha)
        pos_total, neg_total = smoothed_totals(counts, alpha)
        a = F.lit(float(alpha))
        p = (F.col("n_pos") + a) / F.lit(pos_total)
        q = (F.col("n_neg") + a) / F.lit(neg_total)
        out = out.withColumn(f"ratio_{i}", F.log(p / q))
    return out


def first_step(ratio, cost: float) -> Column:
    """H2 helper: what a present feature adds to the score after one diagonal Newton step from zero weights.

    On ratio-weighted presences r the squared-hinge objective with cost C has,
    at zero, the gradient -2 C r (n_pos - n_neg) and the curvature
    1 + 2 C r^2 (n_pos + n_neg) in each feature (bias left out); the score
    adds weight times r.  Needs the columns ``n_pos`` and ``n_neg``.
    """
    square = F.lit(2.0 * cost) * ratio * ratio
    return square * (F.col("n_pos") - F.col("n_neg")) / (F.lit(1.0) + square * (F.col("n_pos") + F.col("n_neg")))


def class_rows(df: DataFrame, label: int, label_col: str = "label") -> DataFrame:
    """The rows of one class."""
    return df.filter(F.col(label_col) == label)


def weight_features(feature_ids: DataFrame, ratio: DataFrame, key_col: str = "feature_id") -> DataFrame:
    """Presence x ratio, rows of frequent features spread over several tasks."""
    return split_join(feature_ids, ratio.select(key_col, F.col("ratio").alias("value")), key_col)


def feature_space_violations(feature_ids: DataFrame, weights: DataFrame, key_col: str = "feature_id") -> DataFrame:
    """Feature ids of the data that the weight table does not know (must be empty)."""
    return feature_ids.select(key_col).join(weights.select(key_col), key_col, "left_anti")


def feature_space_by_split(featured: DataFrame, nb_vocab: DataFrame) -> DataFrame:
    """C8 for data that were not encoded with the model's vocabulary: per split the presence entries, those that the
    vocabulary does not know, and the documents that hold such an entry (doc_id, split, features).

    Unknown entries are counted per document first, so the last exchange carries one row per split and task.
    """
    rows = explode_items(featured, "features", "feature", "doc_id", "split")
    looked = rows.join(nb_vocab.select("feature", F.lit(1).alias("_known")), "feature", "left")
    each = looked.groupBy("split", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_known").isNull()).alias("bad"))
    return each.groupBy("split").agg(F.sum("n").alias("features"), F.sum("bad").alias("unknown_features"),
                                     F.count_if(F.col("bad") > 0).alias("docs_with_unknown"))
