"""Sequence encoding for the recurrent model's data path.

Ids are framed per row; padding is a view computed from one global maximum
(a one-row aggregate) or from the maximum of each batch of rows of like length,
and batches are consecutive blocks of the dense index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.vocab import BOS_ID, EOS_ID, PAD_ID, token_ids
from glossa.plans.ranking import dense_index
from glossa.session import cut_lineage

MAX_SEQ_LEN = 400


def frame_ids(ids, max_seq_len: int = MAX_SEQ_LEN) -> Column:
    """Keep ``max_seq_len - 2`` ids, then [BOS] ... [EOS]."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.concat(F.array(F.lit(BOS_ID).cast("bigint")), F.slice(c, 1, max_seq_len - 2),
                    F.array(F.lit(EOS_ID).cast("bigint")))


def pad_ids(ids, length, pad_value: int = PAD_ID) -> Column:
    """Right-pad to ``length`` (a column or int)."""
    c = F.col(ids) if isinstance(ids, str) else ids
    n = F.lit(length) if isinstance(length, int) else (F.col(length) if isinstance(length, str) else length)
    return F.concat(c, F.array_repeat(F.lit(pad_value).cast("bigint"), F.greatest(n - F.size(c), F.lit(0))))


def true_length(ids, pad_value: int = PAD_ID) -> Column:
    """Number of non-pad entries."""
    c = F.col(ids) if isinstance(ids, str) else ids
    return F.size(F.filter(c, lambda x: x != F.lit(pad_value)))


def encode(tokenized: DataFrame, seq_vocab: DataFrame, max_seq_len: int = MAX_SEQ_LEN,
           keep_cols: tuple[str, ...] = ("label",)) -> DataFrame:
    """H9 without padding: (doc_id, label, input_ids) framed sequences."""
    # only tokens that the frame keeps are looked up
    head = tokenized.withColumn("tokens", F.slice("tokens", 1, max(max_seq_len - 2, 0)))
    ids = token_ids(head, seq_vocab, keep_cols=keep_cols)
    return ids.select("doc_id", *keep_cols, frame_ids("token_ids", max_seq_len).alias("input_ids"))


def pad_to_longest(encoded: DataFrame, ids_col: str = "input_ids", pad_value: int = PAD_ID) -> DataFrame:
    """Pad every row to the longest framed sequence of the whole table (one scalar aggregate).

    The encoded rows are materialised first, so the length scan and the
    padding read them instead of repeating the id lookup.
    """
    encoded = cut_lineage(encoded)
    longest = encoded.agg(F.max(F.size(ids_col)).alias("n")).first()["n"] or 0
    return encoded.withColumn(ids_col, pad_ids(ids_col, int(longest), pad_value))


def assign_batches(df: DataFrame, batch_size: int, order: list[str], partition_by: list[str] | None = None,
                   batch_col: str = "batch") -> DataFrame:
    """Consecutive blocks of ``batch_size`` rows in ``order`` (per group if given)."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    ranked = dense_index(df, order, index_col="_gl_row", partition_by=partition_by)
    return ranked.withColumn(batch_col, F.floor(F.col("_gl_row") / F.lit(batch_size)).cast("bigint")).drop("_gl_row")


def _pad_rows(rows: pa.Table, ids_col: str, batch_col: str, pad_value: int) -> pa.RecordBatch:
    """Whole batches, each of the width of its longest row: ids scattered into one flat array."""
    rows = rows.combine_chunks()
    at = rows.schema.get_field_index(ids_col)
    ids = rows.column(at).chunk(0)
    lengths = np.diff(ids.offsets.to_numpy().astype(np.int64))
    number = rows[batch_col].to_numpy()
    starts = np.append(0, np.flatnonzero(np.diff(number)) + 1)
    width = np.repeat(np.maximum.reduceat(lengths, starts), np.diff(np.append(starts, len(number))))
    ends = np.cumsum(width)
    flat = np.full(int(ends[-1]), pad_value, dtype=np.int64)
    first, given = ends - width, np.cumsum(lengths) - lengths
    values = ids.flatten().to_numpy(zero_copy_only=False)
    flat[np.arange(len(values)) + np.repeat(first - given, lengths)] = values
    padded = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))
    return rows.set_column(at, pa.field(ids_col, padded.type), padded).to_batches()[0]


def pad_batches(encoded: DataFrame, batch_size: int, ids_col: str = "input_ids", key: str = "doc_id", batch_col: str = "batch",
                pad_value: int = PAD_ID) -> DataFrame:
    """B13 by batch: rows in order of length, ``batch_size`` to a batch, each padded to its batch's longest row.

    The order is exact over the whole table (ties by ``key``), so batches hold
    rows of like length and little is padded.  A batch is padded in one piece
    within a task; a task holds one Arrow batch and the rows of one open batch.
    Empty ids get the batch's padding only; an empty table gives an empty one.
    """
    sized = encoded.withColumn("_gl_len", F.size(ids_col))
    placed = assign_batches(sized, batch_size, ["_gl_len", key], batch_col=batch_col)
    placed = placed.select(*encoded.columns, batch_col).withColumn(ids_col, F.coalesce(ids_col, F.array().cast("array<bigint>")))

    def pad(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of the last batch seen, which may go on
        for part in parts:
            if not part.num_rows:
                continue
            rows = pa.Table.from_batches([part])
            rows = rows if held is None else pa.concat_tables([held, rows])
            number = rows[batch_col].to_numpy()
            open_from = int(np.flatnonzero(number == number[-1])[0])
            if open_from:
                yield _pad_rows(rows.slice(0, open_from), ids_col, batch_col, pad_value)
            held = rows.slice(open_from)
        if held is not None:
            yield _pad_rows(held, ids_col, batch_col, pad_value)

    grouped = placed.repartition(batch_col).sortWithinPartitions(batch_col)
    return grouped.mapInArrow(pad, placed.schema)


def padding_cells(padded: DataFrame, ids_col: str = "input_ids", batch_col: str = "batch", pad_value: int = PAD_ID) -> DataFrame:
    """One row: n_rows, n_batches, tokens, and the cells of padding by batch and to one length for the whole table."""
    each = padded.select(batch_col, F.size(ids_col).cast("bigint").alias("w"), true_length(ids_col, pad_value).cast("bigint").alias("n"))
    n, tokens = F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))
    return each.agg(n.alias("n_rows"), F.count_distinct(batch_col).alias("n_batches"), tokens.alias("tokens"),
                    (F.coalesce(F.sum("w"), F.lit(0)) - tokens).alias("padded_by_batch"),
                    (F.coalesce(F.max("w"), F.lit(0)) * n - tokens).alias("padded_globally"))
