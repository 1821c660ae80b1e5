"""Tables landed in loops have the estimate of their files, not of the plans they came from."""

from pyspark.sql import functions as F

from glossa.session import land


def _estimate(df):
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def test_estimate_stays_of_the_size_of_the_files(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10).alias("k"))
    for _ in range(20):
        other = df.groupBy("k").agg(F.max("id").alias("m"))
        df = land(df.join(other, "k").select("id", F.pmod("m", F.lit(10)).alias("k")))
    assert _estimate(df) < 1_000_000
    assert df.count() == 1000


def test_empty_table_lands(spark):
    df = land(spark.range(0).select("id", F.lit("x").alias("s")))
    assert df.columns == ["id", "s"] and df.count() == 0
