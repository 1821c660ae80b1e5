"""The fitting samples are bounded in rows, also where a doc_id repeats."""

import pytest
from pyspark.sql import functions as F

from glossa.llm import cotraining


@pytest.mark.parametrize("texts", [1, 3000])
def test_a_repeated_doc_id_does_not_fill_the_driver(spark, monkeypatch, texts):
    hot = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit("hot "), (F.col("id") % texts).cast("string")).alias("text"))
    docs = spark.range(100, 300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(hot).withColumns({"lang": F.lit("en"), "source": F.lit("a")})
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    taken, featured = [], cotraining._featured

    def counted(df, keep):
        taken.append(df.count())
        return featured(df, keep)

    monkeypatch.setattr(cotraining, "_featured", counted)
    cotraining.fit(docs, labels, fit_rows=201, pool_rows=201)
    assert 190 <= taken[0] <= (201 if texts == 1 else 500)
