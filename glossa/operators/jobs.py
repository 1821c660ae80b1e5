"""The training and the evaluation job of the NB-SVM (H2-H4, H6): grid, refit, save; load, check, score, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import score, svm
from glossa.operators.evaluate import align_check
from glossa.sources import sinks

Part = tuple[DataFrame, DataFrame]  # presence rows (key, feature_id), documents (key, label)


def train(training: Part, validation: Part, ratios: DataFrame, cells: Sequence[svm.Cell], alphas: Sequence[float], path: str,
          key: str = "doc_id", tol: float = 1e-4, max_iter: int = 200) -> list[dict]:
    """Grid over ``cells`` (``alphas``: each cell's smoothing), refit of the best one, saved under ``path``; the grid's rows."""
    matrix = svm.Matrix(*training, ratios, key)
    rows, fitted = svm.grid_search(matrix, ratios, cells, *validation, key=key, tol=tol, max_iter=max_iter)
    best = next(r["cell_no"] for r in rows if r["is_best"])
    one = [cells[best]]
    if len(cells) > 1:
        fitted = svm.fit(matrix, ratios, one, tol, max_iter)
    width = ratios.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    sinks.save_model(svm.weight_table(fitted, one), svm.parameter_row(fitted, one, alphas[best], width), path)
    return rows


def evaluate(spark: SparkSession, path: str, presence: DataFrame, docs: DataFrame, n_features: int, key: str = "doc_id",
             model_name: str = "NB-SVM", out_path: str | None = None) -> DataFrame:
    """Predictions of the saved model for ``docs`` (key, label), after the width (C8) and alignment (C7) checks; written if ``out_path``."""
    weights, params = sinks.load_model(spark, path)
    if params["n_features"] != n_features:
        raise ValueError(f"the data have {n_features} features, the model {params['n_features']}")
    out = score.nbsvm_predict(presence, docs, weights, params["intercept"], model_name)
    aligned = align_check(docs, out, key).first()
    if not aligned["aligned"]:
        raise ValueError(f"predictions do not match the documents: {aligned.asDict()}")
    if out_path:
        sinks.write_predictions(out, out_path)
    return out
