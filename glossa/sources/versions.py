"""Tables published by manifest: a reader sees the last whole version, whatever becomes of a writer.

A writer fills a fresh folder ``<path>/versions/<uuid>`` and then appends one
file to ``<path>/manifest`` that names it.  That file appears by a single
rename (or put) and holds all its rows, so a version is visible entirely or
not at all; a job that dies earlier leaves the version before in place.
Nothing is overwritten, so readers that began with an older version finish
with it.  A path may hold several parts (models, say) that are replaced one
by one: the latest entry of each part counts.  Of two writers that end at the
same time the one with the greater folder name counts, for every reader.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "number long, part string, folder string"
PART = "_gl_part"


def new_version(path: str) -> str:
    """A fresh folder to write to; invisible until ``commit``."""
    return f"{path.rstrip('/')}/versions/{uuid.uuid4().hex}"


def entries(spark: SparkSession, path: str) -> dict[str | None, tuple[int, str]]:
    """Number and folder of each part's latest version (one entry a part); empty if nothing is published."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path.rstrip('/')}/manifest")
    except AnalysisException as e:  # any other failure must not look like an empty store
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    latest = rows.groupBy("part").agg(F.max(F.struct("number", "folder")).alias("last"))
    return {r["part"]: (r["last"]["number"], r["last"]["folder"]) for r in latest.collect()}


def commit(spark: SparkSession, path: str, version: str, parts: Sequence[str | None] = (None,)) -> None:
    """Make the folder ``version`` the latest of ``parts``, all at once."""
    number = 1 + max((n for n, _ in entries(spark, path).values()), default=0)
    rows = [(number, part, version.rsplit("/", 1)[1]) for part in parts]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(f"{path.rstrip('/')}/manifest")


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the latest version of a path without parts."""
    found = entries(spark, path).get(None)
    return f"{path.rstrip('/')}/versions/{found[1]}" if found else None


def require_current(spark: SparkSession, path: str) -> str:
    folder = current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"nothing is published at {path}")
    return folder


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write ``df`` as the latest version of ``path``."""
    version = new_version(path)
    df.write.partitionBy(*partition_by).parquet(version)
    commit(df.sparkSession, path, version)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The latest version."""
    return spark.read.parquet(require_current(spark, path))


def publish_parts(df: DataFrame, path: str, part: str) -> None:
    """Write ``df``; every value of ``part`` that it holds (few: models, runs) is replaced, the others stay."""
    version = new_version(path)
    # a prefix keeps names made of digits from being read back as numbers
    keyed = df.withColumn(PART, F.concat(F.lit("p:"), F.col(part).cast("string")))
    keyed.write.partitionBy(PART).parquet(version)
    written = df.sparkSession.read.schema(keyed.schema).parquet(version)  # a table without rows has no files to tell its columns
    names = [r[0] for r in written.select(F.col(part).cast("string")).distinct().collect()]
    if None in names:
        raise ValueError(f"{part} is null in some rows")
    if names:
        commit(df.sparkSession, path, version, sorted(names))


def published_parts(spark: SparkSession, path: str) -> DataFrame:
    """All parts, each of its latest version; only their folders are read."""
    by_folder: dict[str, list[str]] = {}
    for part, (_, folder) in entries(spark, path).items():
        by_folder.setdefault(folder, []).append(f"p:{part}")
    if not by_folder:
        raise FileNotFoundError(f"nothing is published at {path}")
    out = None
    for folder, names in sorted(by_folder.items()):
        df = spark.read.parquet(f"{path.rstrip('/')}/versions/{folder}").filter(F.col(PART).isin(names)).drop(PART)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
