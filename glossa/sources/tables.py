"""Scans of the input tables and the validation checks of the ingest step.

Schemas are explicit, never inferred.  Checks run as one aggregation pass
and hand back the offending rows as a DataFrame instead of pulling them to
the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossa.sources.csvsplit import csv_records, parse_records

CORPUS_SCHEMA = T.StructType([
    T.StructField("text", T.StringType(), True),
    T.StructField("label", T.IntegerType(), True),
])

PREDICTION_COLUMNS = ["model", "doc_id", "text", "label", "prediction", "probability_positive", "correct"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table: ``<sf_dir>/<name>.parquet``."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


TEXT_PARTITIONS = "spark.glossa.text.partitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioning of text scans for CPU-heavy per-row work (regex tokenising).

    Files of many row groups are split well by the scan itself: unset, the
    session setting ``spark.glossa.text.partitions`` adds nothing.  Set, it is
    the number of hash partitions on ``keys``, for tables that are one small
    unsplittable file.
    """
    partitions = df.sparkSession.conf.get(TEXT_PARTITIONS, None)
    return df.repartition(int(partitions), *keys) if partitions else df


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str, *cols: str) -> DataFrame:
    """Scan of a text table (only ``key`` and ``cols``) spread for tokenising."""
    return spread(table(spark, sf_dir, name).select(key, *cols), key)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs``: documents with a label (``label = quality``), (doc_id, text, label TINYINT).

    Only the two needed document columns are scanned; the join on doc_id is
    broadcast when the label table is small by file statistics, otherwise a
    shuffle join (Spark decides from the measured size).
    """
    documents = text_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("tinyint").alias("label"))
    return documents.join(labels, "doc_id")


def read_labelled_csv(spark: SparkSession, path: str, schema: T.StructType = CORPUS_SCHEMA) -> DataFrame:
    """A1: labelled CSV with quoted multi-line texts, scanned in byte ranges by many tasks.

    The header names the columns: required names that it lacks are refused
    (A2), further columns are dropped, and the order is free.
    """
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    require_columns(header, schema.fieldNames())
    known = {f.name: f for f in schema}
    found = T.StructType([known.get(c, T.StructField(c, T.StringType(), True)) for c in header.columns])
    return parse_records(csv_records(spark, path), found).select(*schema.fieldNames())


def land_parquet(df: DataFrame, path: str) -> DataFrame:
    """Write once, read back: turns an unsplittable source into a splittable one."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def require_columns(df: DataFrame, required: Iterable[str], what: str = "Columns not found") -> None:
    """Metadata-only check; message lists missing names sorted, comma-joined."""
    missing = set(required).difference(df.columns)
    if missing:
        raise ValueError(f"{what}: {', '.join(sorted(missing))}")


def label_problems(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """A3 in one pass: counts of null texts/labels and of labels outside {0, 1}."""
    bad_label = F.col(label_col).isNotNull() & ~F.col(label_col).isin(0, 1)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(text_col).isNull() | F.col(label_col).isNull()).alias("missing"),
        F.count_if(bad_label).alias("bad_label"),
    )


def quarantine(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Rows that would fail A3 (kept as data, never collected)."""
    return df.filter(F.col(text_col).isNull() | F.col(label_col).isNull() | ~F.col(label_col).isin(0, 1))


def validate_corpus(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """A2-A5: check columns, nulls, label domain and emptiness; return typed rows.

    The single collected row is the three counters of ``label_problems``.
    """
    require_columns(df, [text_col, label_col])
    stats = label_problems(df, text_col, label_col).first()
    if stats["rows"] == 0:
        raise ValueError("no rows in the corpus")
    if stats["missing"]:
        raise ValueError(f"{stats['missing']} rows lack a text or a label")
    if stats["bad_label"]:
        raise ValueError(f"{stats['bad_label']} rows have a label other than 0 or 1")
    return normalize_types(df, text_col, label_col)


def normalize_types(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """A5: text as string, label as tinyint."""
    return df.withColumn(text_col, F.col(text_col).cast("string")).withColumn(label_col, F.col(label_col).cast("tinyint"))


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """A4: refuse an empty input (one-row probe, not a count)."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def with_row_identity(df: DataFrame, origin: str = "", id_col: str = "doc_id") -> DataFrame:
    """A stable key for corpora without one: md5 of origin, file and row position.

    ``df`` must be a direct file scan (``_metadata``).  The key is unique by
    construction, also over several corpora pooled under different origins,
    and needs neither a ranking nor a shuffle.
    """
    if id_col in df.columns:
        return df
    place = F.concat_ws("|", F.lit(origin), F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    return df.select("*", F.md5(place).alias(id_col))


def require_unique(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Refuse a table in which a key names two rows."""
    if not df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return df


def union_results(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Per-model prediction tables as one table with a ``model`` column.

    Missing columns (no ``correct`` for NB, no probability for most) are
    filled with nulls, ``correct`` recomputed where absent.
    """
    from glossa.functions.text import correct_flag

    out = None
    for model, frame in frames.items():
        require_columns(frame, ["text", "label", "prediction"])
        require_rows(frame, f"no predictions of {model}")
        part = frame.withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no result tables given")
    if "probability_positive" not in out.columns:
        out = out.withColumn("probability_positive", F.lit(None).cast("double"))
    if "correct" not in out.columns:
        out = out.withColumn("correct", F.lit(None).cast("int"))
    out = out.withColumn("correct", F.coalesce(F.col("correct").cast("int"), correct_flag("label", "prediction")))
    cols = [c for c in PREDICTION_COLUMNS if c in out.columns]
    return out.select(*cols, *[c for c in out.columns if c not in cols])
