"""Sequence/NB vocabularies, dense index, stratified split invariants."""

import random

from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.operators import split, vocab
from glossa.plans.ranking import dense_index


def _tok(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.select("doc_id", tx.tokenize("text").alias("tokens"))


def test_sequence_vocabulary_is_sorted_dense_and_order_free(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abzéß0") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(40)]
    used = sorted({w for t in texts for w in t.split()})
    sv = vocab.seq_vocabulary(_tok(spark, texts))
    rows = sorted(tuple(r) for r in sv.select("token_id", "token").collect())
    assert rows == list(enumerate(vocab.RESERVED_TOKENS + used))
    probes = [[rng.choice(used + ["never-seen", "??"]) for _ in range(n)] for n in (0, 1, 6, 30)]
    probe = spark.createDataFrame(list(enumerate(probes)), "doc_id long, tokens array<string>")
    got = {r["doc_id"]: r["token_ids"] for r in vocab.token_ids(probe, sv).collect()}
    number = {w: i for i, w in rows}
    assert got == {k: [number.get(w, vocab.UNK_ID) for w in ws] for k, ws in enumerate(probes)}
    again = vocab.seq_vocabulary(_tok(spark, texts[::-1]).repartition(3))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sv.collect()))


def test_nb_vocabulary_order_and_lookup(spark):
    t = _tok(spark, ["b a", "a c", "c"])
    v = vocab.nb_vocabulary(t)
    rows = [(r["feature_id"], r["kind"], r["w1"], r["w2"]) for r in v.orderBy("feature_id").collect()]
    assert rows == [(0, "unigram", "a", None), (1, "unigram", "b", None), (2, "unigram", "c", None),
                    (3, "bigram", "a", "c"), (4, "bigram", "b", "a")]
    probe = spark.createDataFrame([(0, ["b", "a", "z"]), (1, ["z"])], "doc_id long, tokens array<string>")
    feats = probe.select("doc_id", tx.feature_set("tokens").alias("features"))
    got = {r["doc_id"]: r["feature_ids"] for r in vocab.feature_ids(feats, v).collect()}
    assert got == {0: [0, 1, 4], 1: []}
    sizes = vocab.vocab_sizes(v).first()
    assert (sizes["unigram_features"], sizes["bigram_features"], sizes["total_features"]) == (3, 2, 5)


def test_dense_index_matches_window_and_groups(spark):
    from pyspark.sql import Window

    df = spark.range(0, 5000).select((F.col("id") % 7).alias("g"), F.md5(F.col("id").cast("string")).alias("k"))
    ours = dense_index(df, ["k"], index_col="i", partition_by=["g"], partitions=5, group_size_col="n")
    w = Window.partitionBy("g").orderBy("k")
    ref = df.select("g", "k", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy("g")).alias("n"))
    assert sorted(map(tuple, ours.select("g", "k", "i", "n").collect())) == sorted(map(tuple, ref.collect()))
    flat = dense_index(df.select("k"), ["k"], index_col="i", partitions=3, start=10)
    got = sorted(r["i"] for r in flat.collect())
    assert got == list(range(10, 5010))


def test_stratified_split_invariants(spark):
    from conftest import SF01
    from glossa.sources.tables import labelled_documents

    docs = labelled_documents(spark, SF01).select("doc_id", "label")
    s = split.stratified_split(docs)
    assert s.count() == docs.count()
    assert s.select("doc_id").distinct().count() == docs.count()
    counts = {(r["split"], r["label"]): r["samples"] for r in split.split_counts(s).collect()}
    for label in (0, 1):
        n = sum(v for (sp, lb), v in counts.items() if lb == label)
        assert counts.get(("test", label), 0) == n * 50 // 100
        assert counts.get(("test", label), 0) + counts.get(("validation", label), 0) == n * 55 // 100
    assert sum(v for (sp, _), v in counts.items() if sp == "test") == 199
    again = split.stratified_split(docs.repartition(5))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, s.collect()))
    hold = split.holdout_split(docs, 0.1)
    hc = {(r["split"], r["label"]): r["samples"] for r in split.split_counts(hold).collect()}
    for label in (0, 1):
        n = hc.get(("validation", label), 0) + hc.get(("train", label), 0)
        assert hc.get(("validation", label), 0) == -(-n // 10)


def test_dense_index_hot_group_spans_ranges(spark):
    """One group holds two thirds of the rows: positions stay exact and the group is cut over ranges."""
    from pyspark.sql import Window

    df = spark.range(0, 6000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(F.lit(99)).alias("g"),
                                     F.md5(F.col("id").cast("string")).alias("k"))
    ours = dense_index(df, ["k"], index_col="i", partition_by=["g"], partitions=6)
    ref = df.select("g", "k", (F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).alias("i"))
    assert sorted(map(tuple, ours.select("g", "k", "i").collect())) == sorted(map(tuple, ref.collect()))
    hot = df.repartitionByRange(6, "g", "k").filter("g = 99").select(F.spark_partition_id().alias("p")).distinct()
    assert hot.count() >= 3
