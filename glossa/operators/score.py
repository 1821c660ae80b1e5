"""Scoring: linear NB-SVM scores, batch scoring with a pluggable model, single texts.

A linear model is a weight table ``(feature_id, ratio, w)`` plus a one-row
parameter table (intercept).  Scores are an equi join of presence rows with
the weights and a sum per document; documents without any known feature
keep the intercept through a left join back to the document list.  Any
other model (an ONNX network, a remote transformer) plugs in as a callable
applied by ``mapInPandas``: loaded once per Python worker, fed Arrow batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.functions.scores import probability_label, svm_label
from glossa.functions.text import correct_flag
from glossa.operators.nb import feature_space_violations


def effective_weights(model: DataFrame) -> DataFrame:
    """Weight per feature on binary presence: ``ratio * w`` (NB-scaled SVM weight)."""
    return model.select("feature_id", (F.col("ratio") * F.col("w")).alias("u"))


def linear_scores(presence: DataFrame, docs: DataFrame, model: DataFrame, intercept: float = 0.0,
                  key: str = "doc_id") -> DataFrame:
    """``score = b + sum_j u_j`` over the features present in each document.

    ``presence`` holds (key, feature_id) rows; ``docs`` is the document list
    (every document gets a score, featureless ones exactly ``b``).
    """
    u = effective_weights(model)
    sums = presence.join(u, "feature_id").groupBy(key).agg(F.sum("u").alias("_s"))
    return docs.join(sums, key, "left").withColumn(
        "score", F.coalesce(F.col("_s"), F.lit(0.0)) + F.lit(float(intercept))).drop("_s")


def check_feature_space(presence: DataFrame, model: DataFrame) -> None:
    """Refuse to score data with features the model does not know."""
    if not feature_space_violations(presence, model).isEmpty():
        raise ValueError("presence rows name features that the model lacks")


def nbsvm_predict(presence: DataFrame, docs: DataFrame, model: DataFrame, intercept: float = 0.0,
                  model_name: str = "NB-SVM", check: bool = True) -> DataFrame:
    """H4: feature-space check, linear score, sign rule (B19), correct flag; predictions table rows."""
    if check:
        check_feature_space(presence, model)
    scored = linear_scores(presence, docs, model, intercept)
    out = scored.withColumn("prediction", svm_label("score")).withColumn("model", F.lit(model_name))
    if "label" in out.columns:
        out = out.withColumn("correct", correct_flag("label", "prediction"))
    return out


# ------------------------------------------------------------------ pluggable models (H5-H7)

_LOADED: dict[str, object] = {}


def loaded(key: str, load_model: Callable[[], object]) -> object:
    """The model of ``key``, loaded on first use in this Python worker.

    Called through the imported module: a dictionary reached from a pickled
    closure would be a new one in every task.
    """
    if key not in _LOADED:
        _LOADED[key] = load_model()
    return _LOADED[key]


def batch_score(df: DataFrame, load_model: Callable[[], Callable[[pd.DataFrame], np.ndarray]],
                input_cols: Sequence[str], keep_cols: Sequence[str] = ("doc_id",),
                batch_size: int = 1024, model_key: str | None = None) -> DataFrame:
    """H5: probabilities from any model, in Arrow batches.

    ``load_model()`` runs once per Python worker and ``model_key`` (a name for
    the model; by default one for this call); the returned callable maps a pandas frame of ``input_cols`` to positive-class
    probabilities (shape (n,)) or class logits (shape (n, k); softmax, then
    the 2- or 3-class rule of B21).  ``batch_size`` bounds rows per call.
    """
    keep_cols = list(keep_cols)
    fields = [df.schema[c] for c in keep_cols]
    schema = T.StructType(fields + [T.StructField("probability_positive", T.DoubleType(), True)])
    key = model_key or uuid.uuid4().hex

    def run(batches):
        from glossa.operators import score

        model = score.loaded(key, load_model)
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start:start + batch_size]
                out = np.asarray(model(part[list(input_cols)]), dtype=float)
                if out.ndim == 2:
                    z = out - out.max(axis=1, keepdims=True)
                    p = np.exp(z)
                    p /= p.sum(axis=1, keepdims=True)
                    out = p[:, 2] / (p[:, 0] + p[:, 2] + 1e-9) if p.shape[1] == 3 else p[:, 1]
                res = part[keep_cols].copy()
                res["probability_positive"] = out
                yield res

    return df.select(*keep_cols, *[c for c in input_cols if c not in keep_cols]).mapInPandas(run, schema)


def evaluate_scored(scored: DataFrame, labels: DataFrame | None = None, model_name: str = "model",
                    key: str = "doc_id") -> DataFrame:
    """H6: prediction by ``p >= 0.5`` (B22), correct flag (B17), predictions-table columns."""
    out = scored.withColumn("prediction", probability_label("probability_positive"))
    if labels is not None:
        out = out.join(labels, key)
    if "label" in out.columns:
        out = out.withColumn("correct", correct_flag("label", "prediction"))
    return out.withColumn("model", F.lit(model_name))


def predict_single_text(spark, text: str, featurize: Callable[[DataFrame], DataFrame]) -> tuple[int, float]:
    """H7: (label, probability) for one text through the same DataFrame pipeline."""
    one = spark.createDataFrame([(0, text)], "doc_id long, text string")
    row = featurize(one).select("prediction", "probability_positive").first()
    return int(row["prediction"]), float(row["probability_positive"])
