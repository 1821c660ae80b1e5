"""Membership filters as distributed bit arrays (C4 and joins against few keys).

Every key sets one of ``BITS`` bits.  The bits are built by partial
aggregation and are 16 MB in all (rows of 64 bytes), whatever the number of
keys, which is a proven bound for a broadcast.  A row whose bit
is not set cannot match and leaves before the shuffle of the join that
follows; the join itself decides about the rest, so results never change.
With n keys a row without a match stays with a chance of about n / ``BITS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.session import land

BITS = 1 << 27


_CHUNK = 64           # bytes of a row of the filter


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITS))


def bit_filter(keys: DataFrame, key: Column) -> DataFrame:
    """The bits of all non-null ``key`` values, landed in rows of ``_CHUNK`` bytes: (f_chunk, f_bits); rows without a bit are left out."""
    placed = keys.filter(key.isNotNull()).select((_place(key)).alias("p"))
    whole = placed.groupBy(F.floor(F.col("p") / 32_768).alias("b")).agg(F.bitmap_construct_agg(F.col("p") % 32_768).alias("bits"))
    rows = whole.select("b", "bits", F.explode(F.sequence(F.lit(0), F.lit(4096 // _CHUNK - 1))).alias("c"))
    cut = rows.select((F.col("b") * (4096 // _CHUNK) + F.col("c")).alias("f_chunk"),
                      F.substring("bits", F.col("c") * _CHUNK + 1, F.lit(_CHUNK)).alias("f_bits"))
    return land(cut.filter(F.col("f_bits") != F.lit(bytes(_CHUNK))))


def _joined(rows: DataFrame, key: Column, bits: DataFrame, how: str) -> tuple[DataFrame, Column]:
    """Rows with their chunk of the filter, and whether their bit is set."""
    placed = rows.withColumn("f_place", _place(key))
    found = placed.join(F.broadcast(bits), F.floor(F.col("f_place") / (8 * _CHUNK)) == F.col("f_chunk"), how)
    byte = F.conv(F.hex(F.substring("f_bits", (F.floor(F.col("f_place") / 8) % _CHUNK).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    at = (F.col("f_place") % 8).cast("int")
    return found, F.call_function("shiftright", byte, at).bitwiseAND(1) == 1


def maybe_members(rows: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """The rows whose key may be among the filter's keys: all that are, and a few that are not."""
    found, is_set = _joined(rows, key, bits, "inner")
    return found.filter(key.isNotNull() & is_set).select(*rows.columns)


def surely_absent(rows: DataFrame, key: Column, bits: DataFrame) -> DataFrame:
    """The other rows: none of their keys is among the filter's."""
    found, is_set = _joined(rows, key, bits, "left")
    return found.filter(key.isNull() | F.coalesce(~is_set, F.lit(True))).select(*rows.columns)
