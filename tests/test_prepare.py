"""Whole preparation job, comparison run, row identity, history append, label checks, single text."""

import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from glossa.functions import text as tx
from glossa.operators import history as hist
from glossa.operators import nb
from glossa.operators.prepare import compare_models, prepare_corpus
from glossa.operators.score import predict_single_text
from glossa.sources import tables
from glossa.sources.versions import published


def test_prepare_corpus_end_to_end(spark):
    d = tempfile.mkdtemp(prefix="glossa-prep-")
    docs = tables.labelled_documents(spark, SF001).select("text", F.col("label").cast("int").alias("label"))
    a = docs.filter(F.length("text") % 2 == 0)
    b = docs.filter(F.length("text") % 2 == 1)
    a.write.parquet(f"{d}/a")
    b.write.parquet(f"{d}/b")
    meta = prepare_corpus({"train_file": spark.read.parquet(f"{d}/a"), "test_file": spark.read.parquet(f"{d}/b")},
                          f"{d}/out").first()
    n = docs.count()
    assert meta["train_samples"] + meta["validation_samples"] + meta["test_samples"] == n
    splits = published(spark, f"{d}/out/splits")
    assert splits.select("doc_id").distinct().count() == n
    assert set(r["origin"] for r in splits.select("origin").distinct().collect()) == {"train_file", "test_file"}
    vocab = published(spark, f"{d}/out/vocabulary")
    assert vocab.count() == meta["total_features"]
    feats = published(spark, f"{d}/out/features")
    assert feats.join(vocab, "feature_id", "left_anti").count() == 0
    assert spark.read.json(f"{d}/out/metadata").first()["labels"].asDict() == {"negative": 0, "positive": 1}


def test_row_identity_is_stable_and_unique(spark):
    d = tempfile.mkdtemp(prefix="glossa-id-")
    d = f"{d}/t"
    spark.createDataFrame([("same", 1), ("same", 0), ("other", 1)], "text string, label int").coalesce(1).write.parquet(d)
    ids1 = sorted(r["doc_id"] for r in tables.with_row_identity(spark.read.parquet(d)).collect())
    ids2 = sorted(r["doc_id"] for r in tables.with_row_identity(spark.read.parquet(d)).collect())
    assert ids1 == ids2 and len(set(ids1)) == 3


def test_compare_models_and_history_append(spark):
    d = tempfile.mkdtemp(prefix="glossa-cmp-")
    a = spark.createDataFrame([("x y", 1, 1), ("z", 0, 1)], "text string, label int, prediction int")
    b = spark.createDataFrame([("x y", 1, 0), ("z", 0, 0)], "text string, label int, prediction int")
    out = compare_models({"A": a, "B": b}, f"{d}/summary")
    acc = {r["model"]: r["accuracy"] for r in out["comparison"].collect()}
    assert acc == {"A": 0.5, "B": 0.5}
    assert out["summary"].count() == 10 and out["pivot"].count() == 5
    row = spark.createDataFrame([(1, 0.5, 0.4, 0.8)], "epoch int, train_loss double, val_loss double, val_accuracy double")
    hist.append_history(row, f"{d}/hist")
    hist.append_history(row.withColumn("epoch", F.lit(2)), f"{d}/hist")
    assert spark.read.parquet(f"{d}/hist").count() == 2


def test_training_label_checks(spark):
    ok = spark.createDataFrame([(1,), (0,)], "label int")
    nb.check_training_labels(ok)
    with pytest.raises(ValueError, match="one class"):
        nb.check_training_labels(spark.createDataFrame([(1,), (1,)], "label int"))
    with pytest.raises(ValueError, match="other than 0 or 1"):
        nb.check_training_labels(spark.createDataFrame([(1,), (2,)], "label int"))


def test_single_text_prediction(spark):
    weights = spark.createDataFrame([("great", 2.0), ("bad", -3.0)], "feature string, ratio double")

    def featurize(df):
        occ = tx.explode_items(df.select("doc_id", tx.feature_set(tx.tokenize("text")).alias("f")), "f", "feature", "doc_id")
        s = occ.join(weights, "feature").groupBy("doc_id").agg(F.sum("ratio").alias("z"))
        z = F.coalesce(F.col("z"), F.lit(0.0))
        out = df.select("doc_id").join(s, "doc_id", "left")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        return out.select((p >= 0.5).cast("int").alias("prediction"), p.alias("probability_positive"))

    label, prob = predict_single_text(spark, "A GREAT film!", featurize)
    assert label == 1 and prob > 0.8
    label, prob = predict_single_text(spark, "Bad, bad.", featurize)
    assert label == 0 and prob < 0.1
