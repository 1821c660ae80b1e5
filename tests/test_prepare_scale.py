"""What the preparation job moves and repeats: plans and stores that decide its time on large tables."""

import tempfile

from pyspark.sql import functions as F

from glossa.functions import text as tx
from glossa.operators import prepare
from glossa.operators.vocab import feature_id_rows, nb_vocabulary
from glossa.plans import catalog
from glossa.plans.ranking import dense_index


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_lookup_joins_by_hash_and_keeps_the_rows(spark, monkeypatch):
    docs = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["y", "z"]), ("c", []), ("d", None)], "doc_id string, tokens array<string>")
    path = f"{tempfile.mkdtemp(prefix='glossa-look-')}/v"
    nb_vocabulary(docs.filter("doc_id = 'a'")).write.parquet(path)
    vocab = spark.read.parquet(path)
    featured = docs.select("doc_id", tx.feature_set("tokens").alias("features"))
    hashed = feature_id_rows(featured, prepare.hashed_lookup(vocab))
    assert "ShuffledHashJoin" in plan_of(hashed) and "SortMergeJoin" not in plan_of(hashed)
    # x 0, y 1, x y 2, y x 3
    assert sorted(map(tuple, hashed.collect())) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 1)]
    monkeypatch.setattr(prepare, "HASHED_ROWS", 0)
    assert "ShuffledHashJoin" not in plan_of(feature_id_rows(featured, prepare.hashed_lookup(vocab)))


def test_query_counts_tokens_before_its_join(spark):
    d = tempfile.mkdtemp(prefix="glossa-prep-")
    texts = [(i, f"w{i % 7} it’s w{i % 3} don’t", "en") for i in range(40)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    out = catalog.QUERIES["prepare_corpus"](spark, d)
    optimized = out._jdf.queryExecution().optimizedPlan().toString()
    lines = optimized.splitlines()
    join = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
    assert not any("size(tokens" in line for line in lines[:join]) and any("size(tokens" in line for line in lines[join:])
    rows = out.collect()
    assert len(rows) == 50 and {r["n_tokens"] for r in rows} == {6}  # w0 it s w0 do not


def test_apostrophes_without_a_map_of_every_character(spark):
    df = spark.createDataFrame([("won’t CAN'T shan't ain’t he doesn’t xn't",), ("",), (None,), ("‘plain’ n't",)], "t string")
    out = df.select(tx.expand_contractions(F.lower("t")).alias("t"))
    assert "translate(" not in plan_of(out)
    assert [r["t"] for r in out.collect()] == ["will not can not shall not is not he does not x not", "", None, "‘plain' n't"]


def test_dense_index_keeps_its_ranges_as_a_table(spark):
    df = spark.createDataFrame([(k, None if k % 5 == 0 else k % 2) for k in range(50)], "k long, g int")
    out = dense_index(df, ["k"], index_col="i", partition_by=["g"], partitions=4, group_size_col="n")
    assert "ExistingRDD" not in plan_of(out)
    assert any("/landed-" in f for f in out.inputFiles())
    got = {(r["g"], r["k"]): (r["i"], r["n"]) for r in out.collect()}
    for g in (None, 0, 1):
        ks = [k for k in range(50) if (None if k % 5 == 0 else k % 2) == g]
        assert [got[g, k] for k in ks] == [(i, len(ks)) for i in range(len(ks))]
