"""The evaluation job reads the saved model through its manifest."""

import random

from glossa.plans import catalog


def _tables(spark, folder, n=60):
    rng = random.Random(5)
    words = {0: ["bad", "poor", "dull", "plain"], 1: ["good", "fine", "rich", "plain"]}
    rows = [(i, " ".join(rng.choice(words[i % 2]) for _ in range(6))) for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")


def test_svm_predict_reads_the_published_parameters(spark, tmp_path):
    _tables(spark, str(tmp_path))
    rows = catalog.QUERIES["svm_predict"](spark, str(tmp_path)).collect()
    assert len(rows) == 30 and all(r["converged"] for r in rows)
    assert all(r["correct"] for r in rows)
