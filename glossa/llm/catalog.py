"""Registered queries of the training-data operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from glossa.llm import (bpe, collocations, cotraining, cover_tree, language_id, line_templates, mixing, packing, quality_rules, secret_scan,
                        simhash, url_filter, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_redirect_filter": url_filter.op1_redirect_filter,
    "op2_line_templates": line_templates.op2_line_templates,
    "op3_entropy_secrets": secret_scan.op3_entropy_secrets,
    "op4_language_id": language_id.op4_language_id,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_cotraining": cotraining.op6_cotraining,
    "op7_simhash": simhash.op7_simhash,
    "op8_pivotal_mix": mixing.op8_pivotal_mix,
    "op9_genetic_packing": packing.op9_genetic_packing,
    "op10_cover_tree": cover_tree.op10_cover_tree,
    "op11_shifted_cholesky": whitening.op11_shifted_cholesky,
    "op12_bpe_codec": bpe.op12_bpe_codec,
    "op13_hat_trie": collocations.op13_hat_trie,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_redirect_filter": url_filter.ORACLE_SQL,
    "op2_line_templates": line_templates.ORACLE_SQL,
    "op3_entropy_secrets": secret_scan.ORACLE_SQL,
    "op5_quality_rules": quality_rules.ORACLE_SQL,
    "op10_cover_tree": cover_tree.ORACLE_SQL,
    "op13_hat_trie": collocations.ORACLE_SQL,
}
