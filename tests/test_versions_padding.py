"""Publishing by manifest (failures at every point) and batch-local padding against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import sequence as seq
from glossa.sources import sinks, versions


def test_a_job_that_dies_leaves_the_last_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        versions.published(spark, path)
    versions.publish(spark.range(3).toDF("i"), path)
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("i"))
    with pytest.raises(Exception, match="lost"):
        versions.publish(broken, path)
    assert versions.published(spark, path).count() == 3
    unseen = versions.new_version(path)  # dies between write and commit
    spark.range(9).toDF("i").write.parquet(unseen)
    reader = versions.published(spark, path)
    assert reader.count() == 3
    versions.commit(spark, path, unseen)
    assert versions.published(spark, path).count() == 9 and reader.count() == 3  # an open reader ends with its version
    versions.publish(versions.published(spark, path).filter("i < 5"), path)  # a table made from itself
    assert versions.published(spark, path).count() == 5


def test_model_is_never_half_new(spark, tmp_path):
    path = f"{tmp_path}/m"
    w = spark.createDataFrame([(0, 0.5, 1.0)], "feature_id long, ratio double, w double")
    p = spark.createDataFrame([(0.1, 0.05, 0.2, 1)], "alpha double, C double, intercept double, n_features long")
    sinks.save_model(w, p, path)
    bad = p.withColumn("intercept", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.save_model(w.unionByName(w.withColumn("feature_id", F.lit(1).cast("long"))), bad, path)
    weights, params = sinks.load_model(spark, path)
    assert weights.count() == 1 and params["intercept"] == 0.2


def test_parts_are_replaced_one_by_one(spark, tmp_path):
    path = f"{tmp_path}/p"
    rows = [(m, str(i), i % 2, 0) for m in ("01", "1", "x/y z") for i in range(3)]
    df = spark.createDataFrame(rows, "model string, text string, label int, prediction int")
    sinks.write_predictions(df, path)
    sinks.write_predictions(df.filter("model = '01' and label = 1").withColumn("prediction", F.lit(7)), path)
    sinks.write_predictions(df.filter("false"), path)
    got = {(r["model"], r["prediction"]): r["n"] for r in sinks.read_predictions(spark, path).groupBy("model", "prediction").agg(F.count("*").alias("n")).collect()}
    assert got == {("01", 7): 1, ("1", 0): 3, ("x/y z", 0): 3}
    with pytest.raises(ValueError, match="null"):
        sinks.write_predictions(df.withColumn("model", F.lit(None).cast("string")), path)


@pytest.mark.parametrize("size, batch_rows", [(1, 3), (7, 3), (64, 10_000), (7, 10_000)])
def test_batches_are_padded_to_their_own_longest(spark, size, batch_rows):
    rng = random.Random(size)
    rows = [(i, [rng.randrange(1, 99) for _ in range(rng.choice([0, 1, 2, 5, 30]))], f"t{i}") for i in range(150)] + [(150, None, "none")]
    df = spark.createDataFrame(rows, "doc_id long, input_ids array<bigint>, extra string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    try:
        padded = seq.pad_batches(df, size)
        got = {r["doc_id"]: (r["batch"], r["input_ids"], r["extra"]) for r in padded.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = sorted(rows, key=lambda r: (len(r[1]) if r[1] is not None else -1, r[0]))
    want = {}
    for at in range(0, len(order), size):
        part = order[at:at + size]
        width = max(len(r[1] or []) for r in part)
        want.update({i: (at // size, [*(ids or []), *[0] * (width - len(ids or []))], x) for i, ids, x in part})
    assert got == want
    cells = seq.padding_cells(padded).first()
    tokens = sum(len(r[1] or []) for r in rows)
    assert cells["tokens"] == tokens and cells["padded_by_batch"] == sum(len(v[1]) for v in want.values()) - tokens
    assert cells["padded_globally"] == 30 * len(rows) - tokens and cells["n_batches"] == -(-len(rows) // size)


def test_no_rows_give_no_batches(spark):
    empty = spark.createDataFrame([], "doc_id long, input_ids array<bigint>")
    assert seq.pad_batches(empty, 4).collect() == []
    assert seq.padding_cells(seq.pad_batches(empty, 4)).first()["padded_globally"] == 0
