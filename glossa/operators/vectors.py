"""Token vectors and pooling.

Vectors are rows ``(token, vec ARRAY<FLOAT>)``.  The lookup is a left join
on the token; unknown tokens get a small deterministic vector derived from
md5 (the reference draws unseeded noise, so only the three-way rule is
comparable), [PAD] gets zeros.  Pooling folds vectors into mergeable softmax
states, so neither (occurrence x dimension) rows nor a document's vectors are
ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.vocab import PAD_TOKEN

NOISE_SCALE = 0.01


def hash_vector(token, dim: int, scale: float = NOISE_SCALE) -> Column:
    """Deterministic vector in ``[-scale, scale)``: entry k from md5(token|k)."""
    t = F.col(token) if isinstance(token, str) else token

    def entry(k):
        h = F.conv(F.substring(F.md5(F.concat(t, F.lit("|"), k.cast("string"))), 1, 8), 16, 10).cast("double")
        return ((h / F.lit(4294967295.0) - F.lit(0.5)) * F.lit(2 * scale)).cast("float")

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), entry)


def lookup_vectors(seq_vocab: DataFrame, pretrained: DataFrame, dim: int) -> DataFrame:
    """``(token_id, token, source, vec)`` for every vocabulary entry.

    source is 'pad' (zeros), 'pretrained' (joined vector) or 'random'.
    """
    j = seq_vocab.join(pretrained.select("token", F.col("vec").alias("_pv")), "token", "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    source = (F.when(F.col("token") == PAD_TOKEN, F.lit("pad"))
              .when(F.col("_pv").isNotNull(), F.lit("pretrained")).otherwise(F.lit("random")))
    vec = (F.when(F.col("token") == PAD_TOKEN, zeros)
           .when(F.col("_pv").isNotNull(), F.col("_pv")).otherwise(hash_vector("token", dim)))
    return j.select("token_id", "token", source.alias("source"), vec.alias("vec"))


def halves_sum(vec, hidden: int) -> Column:
    """``v[:H] + v[H:]`` (the two directions of a bidirectional output)."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.zip_with(F.slice(v, 1, hidden), F.slice(v, hidden + 1, hidden), lambda a, b: a + b)


HELD = 4_096          # documents whose partial states a task holds at once


def _merged(m: float, z: float, total: np.ndarray, m2: float, z2: float, total2: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Two softmax states (maximum, sum of exponentials, weighted sum) as one: both rescaled to the larger maximum."""
    top = max(m, m2)
    a, b = math.exp(m - top), math.exp(m2 - top)
    return top, a * z + b * z2, a * total + b * total2


def attention_pool(occurrences: DataFrame, vectors: DataFrame, projection: Column, key: str = "doc_id",
                   id_col: str = "token_id") -> DataFrame:
    """E5: ``context = sum_t softmax_t(v_t . p) v_t`` per document.

    ``occurrences`` are (key, pos, token_id) rows; ``projection`` is an array
    column (one row broadcast).  Every task folds its rows into one state per
    document (at most ``HELD`` at once), and the states of a document are
    merged in a stream: no task gathers a document's vectors.
    """
    # a token's occurrences in a document share energy and vector: one row with their number
    counted = occurrences.groupBy(key, id_col).agg(F.count(F.lit(1)).alias("_n"))
    j = counted.join(vectors.select(id_col, "vec"), id_col)
    j = j.withColumn("_e", F.aggregate(F.zip_with("vec", projection, lambda a, b: a * b), F.lit(0.0),
                                       lambda acc, x: acc + x))
    kind = occurrences.schema[key].dataType.simpleString()
    state = f"`{key}` {kind}, m double, z double, total array<double>"

    def rows(states: dict) -> pd.DataFrame:
        return pd.DataFrame({key: list(states), "m": [s[0] for s in states.values()], "z": [s[1] for s in states.values()],
                             "total": [s[2] for s in states.values()]})

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states: dict = {}
        for pdf in batches:
            for k, n, vec, e in zip(pdf[key], pdf["_n"], pdf["vec"], pdf["_e"]):
                own = (float(e), float(n), n * np.asarray(vec, dtype=np.float64))
                states[k] = _merged(*states[k], *own) if k in states else own
                if len(states) > HELD:
                    yield rows(states)
                    states = {}
        if states:
            yield rows(states)

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, own = None, None
        for pdf in batches:
            done: dict = {}
            for k, m, z, total in zip(pdf[key], pdf["m"], pdf["z"], pdf["total"]):
                if own is not None and k == at:
                    own = _merged(*own, m, z, np.asarray(total))
                    continue
                if own is not None:
                    done[at] = own[2] / own[1]
                at, own = k, (m, z, np.asarray(total))
            if done:
                yield pd.DataFrame({key: list(done), "context": list(done.values())})
        if own is not None:
            yield pd.DataFrame({key: [at], "context": [own[2] / own[1]]})

    parts = j.select(key, "_n", "vec", "_e").mapInPandas(fold, state)
    return parts.repartition(key).sortWithinPartitions(key).mapInPandas(merge, f"`{key}` {kind}, context array<double>")
