"""Sink round trips (split, features, vocabulary reuse, model key check, predictions, summary) and the stream scorer."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from glossa.sources import sinks, versions


def _tmp():
    return tempfile.mkdtemp(prefix="glossa-sink-")


def test_split_and_feature_round_trip(spark):
    d = _tmp()
    split_df = spark.createDataFrame([(1, 1, "train"), (2, 0, "test")], "doc_id long, label int, split string")
    sinks.write_splits(split_df, f"{d}/splits")
    assert [r["doc_id"] for r in sinks.read_split(spark, f"{d}/splits", "test").collect()] == [2]
    pres = spark.createDataFrame([("train", 1, 5), ("train", 1, 2), ("test", 2, 7)], "split string, doc_id long, feature_id long")
    sinks.write_features(pres, f"{d}/features")
    got = sorted(tuple(r) for r in sinks.read_features(spark, f"{d}/features", "train").collect())
    assert got == [(1, 2), (1, 5)]


def test_vocabulary_reuse(spark):
    d = _tmp()
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(0, "a")], "token_id long, token string")

    assert sinks.vocabulary(spark, f"{d}/v", build).count() == 1
    assert sinks.vocabulary(spark, f"{d}/v", build).count() == 1
    assert len(calls) == 1


def test_model_round_trip_and_key_check(spark):
    d = _tmp()
    w = spark.createDataFrame([(0, 0.5, 1.0)], "feature_id long, ratio double, w double")
    p = spark.createDataFrame([(0.1, 0.05, 0.2, 1)], "alpha double, C double, intercept double, n_features long")
    sinks.save_model(w, p, f"{d}/m")
    weights, params = sinks.load_model(spark, f"{d}/m")
    assert weights.count() == 1 and params["intercept"] == 0.2
    damaged = versions.new_version(f"{d}/m")
    w.drop("ratio").write.parquet(f"{damaged}/weights")
    p.write.parquet(f"{damaged}/params")
    assert sinks.load_model(spark, f"{d}/m")[1]["intercept"] == 0.2  # not committed yet
    versions.commit(spark, f"{d}/m", damaged)
    with pytest.raises(ValueError, match="Saved weights lack"):
        sinks.load_model(spark, f"{d}/m")


def test_predictions_and_summary_sinks(spark):
    d = _tmp()
    pred = spark.createDataFrame([("A", 1, "t", 1, 1), ("B", 1, "t", 1, 0)],
                                 "model string, doc_id long, text string, label int, prediction int")
    sinks.write_predictions(pred, f"{d}/pred")
    sinks.write_predictions(pred.filter("model = 'A'").withColumn("prediction", F.lit(0)), f"{d}/pred")
    back = {r["model"]: r["prediction"] for r in sinks.read_predictions(spark, f"{d}/pred").collect()}
    assert back == {"A": 0, "B": 0}  # A replaced, B kept
    summary = spark.createDataFrame([("A", 1, "101-200 words", 3, 0.5), ("A", 0, "1-100 words", 2, 1.0)],
                                    "model string, bucket_id int, length_bucket string, samples long, accuracy double")
    sinks.write_summary(summary, f"{d}/summary")
    files = [f for f in os.listdir(f"{d}/summary") if f.endswith(".csv")]
    assert len(files) == 1
    lines = open(f"{d}/summary/{files[0]}").read().splitlines()
    assert lines[0].startswith("model,") and lines[1].startswith("A,0,")


def test_stream_scoring_equals_batch(spark):
    from glossa.streaming.scoring import read_scored, score_stream, text_stream

    d = _tmp()
    src = f"{d}/in"
    spark.createDataFrame([(1, 0, "good film"), (1, 1, "bad")], "conv_id long, turn long, text string") \
        .write.parquet(f"{src}/part1")
    schema = spark.read.parquet(f"{src}/part1").schema

    def score(b):
        return b.select("conv_id", "turn", F.length("text").alias("n"))

    q, out = score_stream(text_stream(spark, f"{src}/part1", schema), score, out_path=f"{d}/out",
                          checkpoint=f"{d}/ckpt")
    q.awaitTermination()
    got = sorted((r["conv_id"], r["turn"], r["n"]) for r in read_scored(spark, out).collect())
    assert got == [(1, 0, 9), (1, 1, 3)]
