"""Bit filters drop no match, and few others pass."""

from pyspark.sql import functions as F

from glossa.operators import membership, vocab


def test_no_match_is_lost_and_few_others_pass(spark, monkeypatch):
    monkeypatch.setattr(membership, "BITS", 1 << 17)
    keys = spark.range(0, 4000).select(F.concat(F.lit("k"), "id").alias("k"))
    rows = spark.range(0, 40_000).select(F.concat(F.lit("k"), "id").alias("k"), "id").unionByName(
        spark.createDataFrame([(None, -1)], "k string, id long"))
    bits = membership.bit_filter(keys, F.col("k"))
    maybe = membership.maybe_members(rows, F.col("k"), bits)
    absent = membership.surely_absent(rows, F.col("k"), bits)
    assert maybe.columns == absent.columns == rows.columns
    assert maybe.filter("id between 0 and 3999").count() == 4000
    others = maybe.filter("id >= 4000").count()
    assert others < 0.05 * 36_000  # 4,000 keys in 131,072 bits: 3 %
    assert absent.count() == 40_001 - 4000 - others
    assert bits.count() <= (1 << 17) // 512


def test_empty_filter(spark):
    rows = spark.range(5)
    bits = membership.bit_filter(rows.filter("false"), F.col("id"))
    assert membership.maybe_members(rows, F.col("id"), bits).count() == 0
    assert membership.surely_absent(rows, F.col("id"), bits).count() == 5


def test_unknown_tokens_equal_a_plain_anti_join(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "zz"]), (2, []), (3, ["q", "a", "zz", "zz"])], "doc_id long, tokens array<string>")
    known = spark.createDataFrame([(4, "a"), (5, "b")], "token_id long, token string")
    got = sorted((r["doc_id"], r["token"]) for r in vocab.oov_tokens(docs, known).collect())
    assert got == [(1, "zz"), (3, "q"), (3, "zz"), (3, "zz")]
