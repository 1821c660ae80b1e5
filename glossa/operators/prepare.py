"""The whole preparation job (H8) and the whole model comparison.

Preparation: corpora are validated (A2-A5), keyed by origin, file and row
(A6) and pooled (G1); ids and labels alone are split exactly (E1); text is
joined to its split, tokenised once and written partitioned by split, which
every later step reads by partition.  The vocabulary is built from the
training part only (D3), presence features are looked up for every part
(C1), and splits, features, vocabulary and metadata are written (A7-A10).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import feature_set, tokenize
from glossa.operators import evaluate as ev
from glossa.operators.metadata import DEFAULT_PARTS, run_metadata, union_corpora, write_metadata
from glossa.operators.split import stratified_split
from glossa.operators.vocab import feature_id_rows, nb_vocabulary
from glossa.sources import sinks
from glossa.sources.tables import require_unique, union_results, validate_corpus, with_row_identity

#: Vocabulary rows of a join partition up to which the lookup builds a hash table (about 100 bytes a row).
HASHED_ROWS = 1_500_000


def pool_corpora(corpora: Mapping[str, DataFrame]) -> DataFrame:
    """A2-A6 + G1: one table with ``doc_id`` (unique over all corpora) and ``origin``.

    Corpora without ids get them from origin, file and row; where only some
    bring their own, or of different types, all ids become strings.
    """
    keyed = {name: with_row_identity(df, name) for name, df in corpora.items()}
    checked = {name: validate_corpus(df) for name, df in keyed.items()}
    if len({df.schema["doc_id"].dataType for df in checked.values()}) > 1:
        checked = {name: df.withColumn("doc_id", F.col("doc_id").cast("string")) for name, df in checked.items()}
    return require_unique(union_corpora(checked))


def hashed_lookup(vocab: DataFrame) -> DataFrame:
    """The stored vocabulary, to be joined by hash tables where a partition of it surely fits one, else by merging.

    A merge join sorts the presence rows, many times the vocabulary's, by their
    strings; the features are distinct, so their partitions are even.
    """
    width = int(vocab.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vocab.hint("shuffle_hash") if vocab.count() <= HASHED_ROWS * width else vocab


def prepare_corpus(corpora: Mapping[str, DataFrame], out_dir: str, seed: int = 42,
                   tokenizer: Callable[[Column], Column] = tokenize,
                   parts: Sequence[tuple[str, float]] = DEFAULT_PARTS) -> DataFrame:
    """H8: returns the metadata row; writes splits, features, vocabulary, metadata under ``out_dir``.

    ``splits`` holds doc_id, label, text, origin and tokens, partitioned by split.
    """
    pooled = pool_corpora(corpora)
    assigned = stratified_split(pooled.select("doc_id", "label"), parts=parts, seed=seed).select("doc_id", "split")
    # the whole shuffle width: tokenising costs far more a byte than what adaptive execution sizes partitions for
    width = int(pooled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = (pooled.select("doc_id", "label", "text", "origin").repartition(width, "doc_id")
              .join(assigned.repartition(width, "doc_id"), "doc_id"))
    sinks.write_splits(joined.withColumn("tokens", tokenizer(F.col("text"))), f"{out_dir}/splits")
    split_df = sinks.read_splits(pooled.sparkSession, f"{out_dir}/splits")
    vocab = sinks.vocabulary(pooled.sparkSession, f"{out_dir}/vocabulary",
                             lambda: nb_vocabulary(split_df.filter(F.col("split") == "train")), reuse=False)
    featured = split_df.select("doc_id", "split", feature_set("tokens").alias("features"))
    sinks.write_features(feature_id_rows(featured, hashed_lookup(vocab), keep_cols=("split",)), f"{out_dir}/features")
    files = {name: sorted(df.inputFiles()) for name, df in corpora.items()}
    meta = run_metadata(split_df, vocab, seed=seed, parts=parts, sources=files)
    write_metadata(meta, f"{out_dir}/metadata")
    return meta


def require_same_examples(pred: DataFrame, models: Sequence[str]) -> DataFrame:
    """C6 as a condition: refuse tables whose examples or labels differ between models."""
    keyed = pred if "doc_id" in pred.columns else pred.withColumn("doc_id", F.md5(F.coalesce("text", F.lit(""))))
    if len(models) > 1:
        bad = [f"{r['model_left']} and {r['model_right']}" for r in ev.same_examples(keyed, models).collect() if not r["same_examples"]]
        if bad:
            raise ValueError(f"not the same examples: {'; '.join(bad)}")
    return pred


def compare_models(results: Mapping[str, DataFrame], summary_path: str | None = None) -> dict[str, DataFrame]:
    """Emptiness (A4) and same-example (C6) checks, then accuracy + confusion, bucket summary and pivot."""
    pred = require_same_examples(union_results(results), list(results))
    summary = ev.accuracy_by_length(pred)
    out = {
        "comparison": ev.model_comparison(pred),
        "confusion": ev.confusion(pred),
        "summary": summary,
        "pivot": ev.accuracy_pivot(summary, list(results)),
    }
    if summary_path:
        sinks.write_summary(summary, summary_path)
    return out
