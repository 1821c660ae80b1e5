"""Plan checks: pruned scans, no Python node in the token path, no single-task window over data."""

from conftest import SF001
from glossa.plans import catalog


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_token_path_is_python_free_and_pruned(spark):
    plan = _plan(catalog._docs_counts(spark, SF001))
    assert "EvalPython" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert "ReadSchema: struct<doc_id:bigint,quality:int>" in plan
    # no inferred size(...) > 0 filter re-running the tokeniser below the join
    assert "size(array_distinct" not in plan


def test_no_unpartitioned_window_over_data(spark):
    # every window in the split / vocabulary plans runs over the small block table,
    # whose rows come from an aggregate, never over documents or tokens directly
    for name in ("stratified_split", "nb_vocabulary", "batch_mean_loss"):
        plan = _plan(catalog.QUERIES[name](spark, SF001))
        for line in plan.splitlines():
            if "Window [" in line:
                assert "_gl_" in line, (name, line)
