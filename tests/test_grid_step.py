"""One diagonal Newton step of the squared hinge: against its definition, and C decides labels."""

import numpy as np
from pyspark.sql import functions as F

from glossa.operators import nb


def test_first_step_equals_gradient_over_curvature(spark):
    rng = np.random.default_rng(3)
    x = (rng.random((60, 5)) < 0.4).astype(float)
    y = rng.integers(0, 2, 60)
    r = rng.normal(size=5)
    rows = [(int(x[y == 1, j].sum()), int(x[y == 0, j].sum()), float(r[j]), j) for j in range(5)]
    df = spark.createDataFrame(rows, "n_pos long, n_neg long, r double, j int")
    z = x * r
    for cost in (0.05, 1.0, 20.0):
        gradient = -2 * cost * (z * (2 * y - 1)[:, None]).sum(axis=0)
        curvature = 1 + 2 * cost * (z * z).sum(axis=0)
        got = df.select("j", nb.first_step(F.col("r"), cost).alias("w")).orderBy("j").collect()
        np.testing.assert_allclose([g["w"] for g in got], -gradient / curvature * r, rtol=1e-12, atol=1e-15)


def test_cost_decides_between_a_frequent_and_a_sure_feature(spark):
    df = spark.createDataFrame([(30, 20, 1.0), (0, 2, -1.0)], "n_pos long, n_neg long, r double")
    low, high = df.agg(F.sum(nb.first_step(F.col("r"), 0.001)), F.sum(nb.first_step(F.col("r"), 100.0))).first()
    assert low > 0 > high
