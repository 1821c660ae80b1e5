"""Column helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst may copy an expression into each of its uses, also into lambdas
    that run once per array element; a one-element transform binds it.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the runs of other characters than space and \\x09-\\x0D."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def sealed(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns that no operator's own can clash with, and their names by the original ones."""
    inner = {c: f"_in_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*inner.values()), inner


def unsealed(inner: dict[str, str]) -> list[Column]:
    """The original columns again, for a select."""
    return [F.col(v).alias(c) for c, v in inner.items()]


def text_hashes(column: str) -> list[Column]:
    """Two independent 64-bit hashes, ``hash`` and ``hash2``: together an identity for any number of texts."""
    return [F.xxhash64(column).alias("hash"), F.xxhash64(F.lit("second"), column).alias("hash2")]


def numbered(df: DataFrame, name: str = "nr", block: int = 4_096) -> DataFrame:
    """``df`` plus 0, 1, ... among rows equal in all columns; a row held by a third of the table fills no task.

    Equal rows are counted and made again from their count, ``block`` at a
    time, so the numbers are the same however the table is divided.
    """
    counted = df.groupBy(*df.columns).agg((F.count("*") - 1).alias("_last"))
    blocks = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.lit(block).cast("long"))))
    spread = blocks.repartition(*df.columns, "_from")
    return spread.withColumn(name, F.explode(F.sequence("_from", F.least("_last", F.col("_from") + block - 1)))).drop("_last", "_from")
