"""Splittable scan of CSV files with quoted newlines (A1).

Spark's ``multiLine`` reader gives a whole file to one task.  Here the files
are read as plain lines, in byte ranges, and put together again:

1. one aggregation counts the quote characters of each range.  The running
   parity over a file's ranges says whether a range begins inside a quoted
   field.  The driver holds one entry per range, as it does for every scan;
2. each task joins its lines to records, from the parity its range begins
   with: a record ends where a line ends outside quotes.  What a range holds of
   records that begin in an earlier one or end in a later one are fragments,
   which only meet by their record in a small shuffle;
3. records are parsed in the JVM by ``from_csv``.

Quotes inside quoted fields are doubled (RFC 4180); a quote inside an unquoted
field is not allowed.  Blank lines outside quotes are skipped, as is the first
record of each file (the header), and a carriage return at a record's end.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _range_starts(lines: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """Per byte range: does it begin inside quotes, and the start of the range that its first record begins in."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = quotes % 2
    rows = lines.groupBy("path", "start").agg(F.sum(odd).alias("odd")).orderBy("path", "start").collect()
    out, path, inside, owner = {}, None, False, 0
    for r in rows:
        if r["path"] != path:
            path, inside, owner = r["path"], False, 0
        out[path, r["start"]] = (inside, owner if inside else r["start"])
        if not inside or r["odd"]:  # a record begins in this range: at its start, or behind the line that closes the open one
            owner = r["start"]
        inside ^= bool(r["odd"] % 2)
    return out


RECORD = T.StructType([T.StructField("path", T.StringType()), T.StructField("owner", T.LongType()), T.StructField("start", T.LongType()),
                       T.StructField("whole", T.BooleanType()), T.StructField("header", T.BooleanType()), T.StructField("record", T.StringType())])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files as strings (column ``record``), without headers."""
    lines = _lines(spark, path)
    starts = spark.sparkContext.broadcast(_range_starts(lines))  # one entry per byte range

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, inside, borrowed, owner, held, first = None, False, False, 0, [], False

        def row(whole: bool, text: str) -> tuple:
            return (key[0], owner, key[1], whole, first, text)

        for pdf in batches:
            out = []
            for path_, start, value in zip(pdf["path"], pdf["start"], pdf["value"]):
                if (path_, start) != key:
                    if held:
                        out.append(row(False, "\n".join(held)))
                    key, held = (path_, start), []
                    inside, owner = starts.value[key]
                    borrowed, first = inside, not inside and start == 0
                held.append(value)
                if value.count('"') % 2:
                    inside = not inside
                if not inside:
                    out.append(row(not borrowed, "\n".join(held)))
                    # the next record is this range's own
                    borrowed, held, owner, first = False, [], key[1], False
            yield pd.DataFrame(out, columns=RECORD.fieldNames())
        if held:
            yield pd.DataFrame([row(False, "\n".join(held))], columns=RECORD.fieldNames())

    pieces = lines.mapInPandas(join, RECORD)
    fragments = pieces.filter("not whole").groupBy("path", "owner").agg(
        F.max("header").alias("header"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda x: x["record"]), "\n").alias("record"))
    records = pieces.filter("whole").select("header", "record").unionByName(fragments.select("header", "record"))
    ended = F.regexp_replace("record", "\r$", "")
    return records.filter("not header").select(ended.alias("record")).filter("record <> ''")


def parse_records(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` from CSV records; a record that does not fit fails the job."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = F.from_csv("record", ddl, {"escape": '"', "mode": "FAILFAST", "multiLine": "true"})
    return records.select(parsed.alias("r")).select("r.*")
