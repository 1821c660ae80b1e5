"""Splittable CSV, bucketed feature store, mergeable pooling and the split join."""

import csv
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import nb, vectors
from glossa.plans import hotjoin
from glossa.sources import csvsplit, sinks, tables


def _csv(path, rows, end="\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
        out.writerow(["label", "extra", "text"])
        out.writerows(rows)


def _texts(seed, n):
    rng = random.Random(seed)
    parts = ["plain", 'say "hi"', "two\nlines", "\n", ",", '"', "été", "a\n\n\nb", '""\n""', "x" * 90, " pad ", "1,2\n3"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(n)]


@pytest.mark.parametrize("size", [17, 31, 64, 101, 300, 1 << 20])
def test_csv_cut_anywhere_gives_the_same_rows(spark, tmp_path, size):
    texts = _texts(size, 60)
    _csv(tmp_path / "a.csv", [(k % 2, f"e{k}", t) for k, t in enumerate(texts)])
    _csv(tmp_path / "b.csv", [(1, "", "one\nmore"), (0, "z", "y" * 400 + "\n" + "z" * 400)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        whole = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(
            "label int, extra string, text string").csv(str(tmp_path))
        want = sorted((r["text"], r["label"]) for r in whole.collect())
        df = tables.read_labelled_csv(spark, str(tmp_path))
        assert sorted((r["text"], r["label"]) for r in df.collect()) == want and len(want) == 62
        n = csvsplit._lines(spark, str(tmp_path)).rdd.getNumPartitions()
        assert n > 10 if size < 100 else n >= 1
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
            spark.conf.unset(k)


def test_csv_carriage_returns_and_bad_labels(spark, tmp_path):
    _csv(tmp_path / "a.csv", [(1, "", "a b"), (0, "", "c")], end="\r\n")
    assert sorted((r["text"], r["label"]) for r in tables.read_labelled_csv(spark, str(tmp_path)).collect()) == [("a b", 1), ("c", 0)]
    (tmp_path / "bad").mkdir()
    _csv(tmp_path / "bad" / "a.csv", [("x", "", "a")])
    with pytest.raises(Exception, match="x"):
        tables.read_labelled_csv(spark, str(tmp_path / "bad")).collect()


def test_feature_store_joins_without_exchange(spark, tmp_path):
    presence = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"),
                                           F.floor(F.col("id") / 10).alias("doc_id"), F.pmod(F.col("id") * 7, F.lit(50)).alias("feature_id")).distinct()
    weights = spark.range(0, 50).select(F.col("id").alias("feature_id"), (F.col("id") * 0.5).alias("ratio"))
    sinks.write_feature_store(presence, weights, str(tmp_path / "store"))
    p, w = sinks.read_feature_store(spark, str(tmp_path / "store"))
    joined = p.join(w.hint("merge"), "feature_id")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == presence.count()
    got = {r["doc_id"]: r["features"] for r in sinks.feature_vectors(spark, str(tmp_path / "store"), "test", "ratio").collect()}
    want = {}
    for r in presence.filter("split = 'test'").collect():
        want.setdefault(r["doc_id"], {})[r["feature_id"]] = r["feature_id"] * 0.5
    assert {k: dict(zip(v.indices.tolist(), v.values.tolist())) for k, v in got.items()} == want
    assert all(v.size == 50 for v in got.values())


def test_pooling_states_merge(spark, monkeypatch):
    rng = np.random.default_rng(3)
    table = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    occ = [(d, p, int(rng.integers(0, 40))) for d in range(6) for p in range([1, 3, 500, 40, 7, 2000][d])]
    proj = [0.7, -30.0, 2.0, 11.0]
    monkeypatch.setattr(vectors, "HELD", 2)
    out = vectors.attention_pool(spark.createDataFrame(occ, "doc_id long, pos int, token_id long").repartition(7),
                                 spark.createDataFrame(table, "token_id long, vec array<double>"), F.array(*[F.lit(x) for x in proj]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    got = {r["doc_id"]: r["context"] for r in out.collect()}
    vecs = dict(table)
    for d in range(6):
        v = np.array([vecs[t] for k, _, t in occ if k == d])
        e = v @ np.array(proj)
        w = np.exp(e - e.max())
        assert np.allclose(got[d], w @ v / w.sum(), rtol=1e-9)


def test_split_join_is_the_join_and_spreads_the_hot_key(spark):
    rows = spark.range(0, 40_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(7)).when(F.col("id") % 1000 == 1, F.lit(None))
                                         .otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))).cast("long").alias("k"))
    table = spark.range(0, 4000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).unionByName(spark.createDataFrame([(7, -1)], "k long, v long"))
    assert hotjoin.hot_keys(rows, "k") == [7]
    for how in ("inner", "left"):
        want, got = rows.join(table, "k", how), hotjoin.split_join(rows, table, "k", how, salts=8)
        assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).isEmpty()
    for name, value in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}.items():
        spark.conf.set(name, value)
    try:
        joined = hotjoin.split_join(rows, table.groupBy("k").agg(F.max("v").alias("v")), "k", salts=64)
        sizes = joined.groupBy(F.spark_partition_id()).count().collect()
        counts = sorted(r["count"] for r in sizes)
        assert counts[-1] <= 2 * counts[len(counts) // 2] + 2000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert hotjoin.split_join(rows.filter("false"), table, "k").count() == 0


def test_weighting_equals_a_plain_join(spark):
    ids = spark.createDataFrame([(d, f) for d in range(600) for f in (0, d + 1)], "doc_id long, feature_id long")
    ratio = spark.createDataFrame([(f, math.log(f + 2.0)) for f in range(700)], "feature_id long, ratio double")
    got = {(r["doc_id"], r["feature_id"]): r["value"] for r in nb.weight_features(ids, ratio).collect()}
    assert got == {(d, f): math.log(f + 2.0) for d in range(600) for f in (0, d + 1)}
