"""Run metadata and corpus set operations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Label names written into the metadata.
LABEL_NAMES = {"negative": 0, "positive": 1}
DEFAULT_PARTS = (("test", 0.50), ("validation", 0.05))


def split_method(parts: Sequence[tuple[str, float]] = DEFAULT_PARTS) -> str:
    """The split in words, in the order train, validation, test, as the fractions have it."""
    share = {"train": 1 - sum(f for _, f in parts), **dict(parts)}
    return "stratified " + ", ".join(f"{100 * share[n]:g}% {n}" for n in ("train", "validation", "test") if n in share) + " split"


def run_metadata(split_df: DataFrame, nb_vocab: DataFrame, seed: int = 42,
                 parts: Sequence[tuple[str, float]] = DEFAULT_PARTS, sources: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """A10: one row of sizes, seed, feature counts and, if given, the files of each origin."""
    sizes = split_df.agg(
        F.count_if(F.col("split") == "train").alias("train_samples"),
        F.count_if(F.col("split") == "validation").alias("validation_samples"),
        F.count_if(F.col("split") == "test").alias("test_samples"),
    )
    feats = nb_vocab.agg(
        F.count_if(F.col("kind") == "unigram").alias("unigram_features"),
        F.count_if(F.col("kind") == "bigram").alias("bigram_features"),
        F.count(F.lit(1)).alias("total_features"),
    )
    labels = F.struct(*[F.lit(v).alias(k) for k, v in LABEL_NAMES.items()])
    files = [F.struct(*[F.array(*map(F.lit, v)).alias(k) for k, v in sources.items()]).alias("source_files")] if sources else []
    f = feats.first()
    return sizes.select(
        F.lit(split_method(parts)).alias("split_method"), F.lit(seed).alias("seed"), "train_samples", "validation_samples",
        "test_samples", *[F.lit(f[c]).cast("bigint").alias(c) for c in ("unigram_features", "bigram_features",
                                                                         "total_features")],
        labels.alias("labels"), *files)


def write_metadata(meta: DataFrame, path: str) -> None:
    """A10 sink: the single metadata row as JSON."""
    meta.coalesce(1).write.mode("overwrite").json(path)


def union_corpora(corpora: Mapping[str, DataFrame]) -> DataFrame:
    """G1: union all (no de-duplication) with an ``origin`` column; columns matched by name."""
    out = None
    for origin, df in corpora.items():
        part = df.withColumn("origin", F.lit(origin))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no corpora given")
    return out
