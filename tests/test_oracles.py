"""Every registered query with SQL against DuckDB on sf0.001 (the driver compares at sf0.01);
queries without SQL must at least run.  The training-data queries have tests of their own."""

import pytest

from __spark_entry__ import entry, queries
from glossa.plans import catalog
from oracle_harness import compare

from conftest import SF001


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name):
    r = compare(spark, name, SF001)
    assert r["spark_rows"] == r["duck_rows"], r
    assert r["hash_match"], r
    assert r["types_match"], r["types"]


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_rows_only(spark, name):
    out = queries()[name](spark, SF001)
    assert out.count() > 0
    if "converged" in out.columns:
        assert out.filter("not converged").isEmpty()


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["feature", "kind", "n_pos", "n_neg", "ratio"]
    assert df.count() > 0
