"""CSV scan, validation checks, score functions, NB ratio properties, batch scoring."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from glossa.functions import scores as sc
from glossa.operators import nb, score
from glossa.sources import tables

CSV = '''text,label
"A film, with ""quotes"" and<br />a break
over two lines",1
"back\\ and ""word""",0
"   leading spaces",1
"trailing \\""",0
plain,1
'''


def test_csv_edge_rows(spark):
    d = tempfile.mkdtemp(prefix="glossa-csv-")
    path = os.path.join(d, "train.csv")
    with open(path, "w") as f:
        f.write(CSV)
    df = tables.read_labelled_csv(spark, path)
    rows = df.collect()
    assert len(rows) == 5
    assert rows[0]["text"] == 'A film, with "quotes" and<br />a break\nover two lines'
    assert rows[2]["text"] == "   leading spaces"
    ok = tables.validate_corpus(df)
    assert dict(ok.dtypes)["label"] == "tinyint"


def test_validation_messages(spark):
    bad = spark.createDataFrame([("a", 1), ("b", 3)], "text string, label int")
    with pytest.raises(ValueError, match="other than 0 or 1"):
        tables.validate_corpus(bad)
    miss = spark.createDataFrame([("a", 1), (None, 0)], "text string, label int")
    with pytest.raises(ValueError, match="lack a text"):
        tables.validate_corpus(miss)
    with pytest.raises(ValueError, match="Columns not found: label, text"):
        tables.require_columns(spark.range(1), ["text", "label"])
    q = tables.quarantine(bad).collect()
    assert [r["text"] for r in q] == ["b"]


def test_score_functions(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (-3.0,)], "z double")
    rows = df.select(sc.sigmoid_label("z").alias("a"), sc.svm_label("z").alias("b"),
                     sc.bce_with_logits("z", F.lit(1)).alias("l")).collect()
    assert [r["a"] for r in rows] == [1, 1, 0]  # sigmoid(0) = 0.5 is positive
    assert [r["b"] for r in rows] == [0, 1, 0]  # decision 0 is negative
    assert abs(rows[2]["l"] - (3.0 + math.log1p(math.exp(-3.0)))) < 1e-12
    lg = spark.createDataFrame([([1.0, 0.0, 3.0],), ([0.2, 0.9],)], "l array<double>")
    p = lg.select(sc.positive_probability(sc.softmax("l")).alias("p")).collect()
    e = [math.exp(x - 3) for x in (1.0, 0.0, 3.0)]
    z = sum(e)
    assert abs(p[0]["p"] - (e[2] / z) / (e[0] / z + e[2] / z + 1e-9)) < 1e-12
    assert abs(p[1]["p"] - math.exp(0.9) / (math.exp(0.2) + math.exp(0.9))) < 1e-12


def test_ratio_antisymmetric_under_label_flip(spark):
    rows = spark.createDataFrame([(1, 1, ["a", "b"]), (2, 0, ["b", "c"]), (3, 1, ["a"])],
                                 "doc_id long, label int, features array<string>")
    r1 = {r["feature"]: r["ratio"] for r in nb.log_count_ratio(nb.class_doc_freq(nb.doc_features(rows)), 0.5).collect()}
    flipped = rows.withColumn("label", 1 - F.col("label"))
    r2 = {r["feature"]: r["ratio"] for r in nb.log_count_ratio(nb.class_doc_freq(nb.doc_features(flipped)), 0.5).collect()}
    for k in r1:
        assert abs(r1[k] + r2[k]) < 1e-12
    # direct statement: p = (n_pos + a) / sum, q = (n_neg + a) / sum
    p = {"a": 2.5, "b": 1.5, "c": 0.5}
    q = {"a": 0.5, "b": 1.5, "c": 1.5}
    for k in p:
        assert abs(r1[k] - math.log((p[k] / 4.5) / (q[k] / 3.5))) < 1e-12
    with pytest.raises(ValueError):
        nb.log_count_ratio(nb.class_doc_freq(nb.doc_features(rows)), 0.0)


def test_linear_scores_keep_featureless_docs(spark):
    presence = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "doc_id long, feature_id long")
    docs = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, label int")
    model = spark.createDataFrame([(0, 0.5, 2.0), (1, -1.0, 1.0)], "feature_id long, ratio double, w double")
    got = {r["doc_id"]: (r["score"], r["prediction"], r["correct"])
           for r in score.nbsvm_predict(presence, docs, model, intercept=0.25).collect()}
    assert got == {1: (0.25, 1, 1), 2: (-0.75, 0, 1), 3: (0.25, 1, 1)}
    bad = spark.createDataFrame([(1, 7)], "doc_id long, feature_id long")
    with pytest.raises(ValueError):
        score.nbsvm_predict(bad, docs, model)


def test_batch_score_with_logits_model(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, 3.0), (2, 2.0, 0.0, 0.0)], "doc_id long, a double, b double, c double")

    def load():
        import numpy as np
        return lambda pdf: pdf[["a", "b", "c"]].to_numpy()

    out = {r["doc_id"]: r["probability_positive"] for r in score.batch_score(df, load, ["a", "b", "c"]).collect()}
    e = [math.exp(x - 3) for x in (0.0, 1.0, 3.0)]
    z = sum(e)
    assert abs(out[1] - (e[2] / z) / (e[0] / z + e[2] / z + 1e-9)) < 1e-12
    ev = score.evaluate_scored(score.batch_score(df, load, ["a", "b", "c"]), model_name="m")
    assert {r["doc_id"]: r["prediction"] for r in ev.collect()} == {1: 1, 2: 0}
