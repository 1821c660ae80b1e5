"""Exact stratified splits and seeded shuffles.

Rows are ranked inside each class by ``md5('<seed>|<doc_id>')`` (ties by
id) with the distributed dense index, so a class holding most rows is still
ranked by many tasks.  Cut points use integer arithmetic on parts per
million, so ``floor(0.55 * n)`` cannot be hit by binary rounding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.plans.ranking import dense_index

_PPM = 1_000_000


def seeded_hash(seed: int | str, *parts: str | Column) -> Column:
    """``md5('<seed>|<part1>|<part2>...')`` as a hex string."""
    cols = [F.lit(str(seed))]
    for p in parts:
        cols.append(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"))
    return F.md5(F.concat_ws("|", *cols))


def _ppm(fraction: float) -> int:
    if not 0 <= fraction <= 1:
        raise ValueError("fractions must lie in [0, 1]")
    return int(round(fraction * _PPM))


def _cut(n_col: str, ppm: int, ceil: bool = False) -> Column:
    """``floor(n * ppm / 1e6)`` (or ceil) in exact integer arithmetic."""
    bump = _PPM - 1 if ceil else 0
    return F.expr(f"div(CAST({n_col} AS BIGINT) * {ppm} + {bump}, {_PPM})")


def stratified_split(docs: DataFrame, parts: Sequence[tuple[str, float]] = (("test", 0.50), ("validation", 0.05)),
                     rest: str = "train", seed: int = 42, label_col: str = "label", id_col: str = "doc_id",
                     ceil: bool = False) -> DataFrame:
    """In each class the first ``floor(f1 n_c)`` rows by hash go to part 1,
    the next ``floor((f1+f2) n_c) - floor(f1 n_c)`` to part 2, the rest to ``rest``.

    One pass replaces the reference's two-stage split (45/5/50 by default).
    With ``ceil`` the cut points round up (used by the hold-out, E2).
    """
    hashed = docs.withColumn("_gl_h", seeded_hash(seed, id_col))
    ranked = dense_index(hashed, ["_gl_h", id_col], index_col="_gl_rank", partition_by=[label_col], start=1,
                         group_size_col="_gl_class_n")
    expr = None
    total = 0.0
    for name, fraction in parts:
        total += fraction
        cond = F.col("_gl_rank") <= _cut("_gl_class_n", _ppm(min(total, 1.0)), ceil)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = expr.otherwise(F.lit(rest))
    return ranked.withColumn("split", expr).drop("_gl_h", "_gl_rank", "_gl_class_n")


def holdout_split(docs: DataFrame, fraction: float = 0.1, seed: int = 42, label_col: str = "label",
                  id_col: str = "doc_id") -> DataFrame:
    """``ceil(fraction * n_c)`` rows of each class become validation, the rest train."""
    return stratified_split(docs, (("validation", fraction),), rest="train", seed=seed, label_col=label_col,
                            id_col=id_col, ceil=True)


def split_counts(split_df: DataFrame) -> DataFrame:
    """Samples per split and label."""
    return split_df.groupBy("split", "label").agg(F.count(F.lit(1)).alias("samples"))


def seeded_shuffle(df: DataFrame, seed: int = 42, epoch: int = 0, id_col: str = "doc_id",
                   pos_col: str = "shuffle_pos") -> DataFrame:
    """a reproducible permutation: position in the order of ``md5(seed|epoch|id)``."""
    hashed = df.withColumn("_gl_h", seeded_hash(seed, F.lit(epoch), id_col))
    return dense_index(hashed, ["_gl_h", id_col], index_col=pos_col).drop("_gl_h")
