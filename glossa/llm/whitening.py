"""Embedding whitening by shifted CholeskyQR (operator 11).

Vectors become integer vectors x = floor(256 c); the fit list holds each
distinct x once, as a table in the shared folder.  A Gram pass sums A'A over
the centred rows inside tasks and then by cell of the d x d matrix.  The first
Gram matrix is shifted, so that its Cholesky factor exists however badly the
columns are conditioned; every further pass solves the rows against the
factors found so far (triangular solves in blocks, nothing written) and
factors the Gram matrix of the result, until that is a projection.  A = Q R
with the composed R; R's singular values and right vectors give eigenvalues
and components of the covariance, without ever forming it.  The driver holds
d x d numbers, whatever the number of rows.

Defined cases: rows whose vector is null or holds a null or non-finite entry
are left out; shorter vectors (empty ones too) count as ending in zeros, long
ones are as wide as the widest; entries of x beyond +-2^48 are taken as that;
a deviation beyond 64 bits is null; components without variance (fewer
distinct vectors than components, constant columns, one row) are not returned;
equal eigenvalues are numbered in any order; repeated rows count once in the
fit and are returned each; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import read_table, sealed, unsealed
from glossa.session import land

SCALE = 256
COMPONENTS = 4
LIMIT = 1 << 48
MAX_ROUNDS = 8
SETTLED = 1e-12
_RUN = 8_192          # rows solved at once
_UNIT = 2.0 ** -53


@dataclass
class Whitening:
    """What the fit found; arrays of at most d x d numbers."""

    n: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray   # one column each
    rounds: int
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums]) if self.n else np.zeros(len(self.sums))


def integer_vectors(df: DataFrame, column: str, out: str = "x") -> DataFrame:
    """Rows of ``df`` whose vector is whole, with the vector of longs ``out``, all of one width."""
    v, inf = F.col(column), F.lit(float("inf"))
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == inf))
    kept = df.filter(v.isNotNull() & ~bad)
    bound = F.lit(float(LIMIT))
    kept = kept.withColumn(out, F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, bound), -bound)).cast("long")))
    width = kept.agg(F.max(F.size(column)).alias("widest"), F.min(F.size(column)).alias("least")).first()
    if width["widest"] != width["least"]:
        pad = F.lit(width["widest"]) - F.size(out)
        kept = kept.withColumn(out, F.concat(F.col(out), F.array_repeat(F.lit(0).cast("long"), pad)))
    return kept


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def _sums(fit: DataFrame) -> list[int]:
    """Exact sum of every dimension."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = _matrix(batch.column(0)).sum(axis=0, dtype=np.int64)  # a batch of LIMIT entries stays below 2^63
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "s"])

    rows = fit.select("x").mapInArrow(add, "i long, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(r["s"]) for r in sorted(rows)]


def solve_rows(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of the upper triangular ``factor``, by forward substitution."""
    t, out = rows.T, np.empty((rows.shape[1], rows.shape[0]))
    for j in range(len(factor)):
        out[j] = (t[j] - factor[:j, j] @ out[:j]) / factor[j, j]
    return out.T


def _gram(fit: DataFrame, width: int, change: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over the fit list of change(rows)' change(rows): one width x width matrix a task, summed by cell in a shuffle."""
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float64)
            for k in range(0, len(x), _RUN):
                q = change(x[k:k + _RUN])
                total += q.T @ q
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "g"])

    out = np.zeros((width, width))
    for r in fit.select("x").mapInArrow(products, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["g"]
    return out


def _factor(gram: np.ndarray, n: int, shifted: bool) -> np.ndarray:
    """Upper Cholesky factor; shifted where asked for, or where the matrix is not positive definite."""
    d = len(gram)
    if not shifted:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    shift = 11 * (n * d + d * (d + 1)) * _UNIT * np.linalg.norm(gram, 2)
    return np.linalg.cholesky(gram + shift * np.eye(d)).T


def fit_whitening(fit: DataFrame, components: int = COMPONENTS, max_rounds: int = MAX_ROUNDS) -> Whitening:
    """Whitening of a landed table of distinct vectors ``x`` (array of longs of one width)."""
    n = fit.count()
    sums = _sums(fit) if n else []
    d = len(sums)
    model = Whitening(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)), 0, 0.0)
    if not d:
        return model
    mean = model.mean
    factors: list[np.ndarray] = []
    composed = np.eye(d)
    for _ in range(max_rounds):
        known = fit.sparkSession.sparkContext.broadcast(factors)  # rounds x d x d numbers

        def orthogonal(x: np.ndarray) -> np.ndarray:
            q = x - mean
            for r in known.value:
                q = solve_rows(q, r)
            return q

        gram = _gram(fit, d, orthogonal)
        if not factors:
            model.trace = float(np.trace(gram)) / n
            if model.trace == 0:
                return model
        elif np.abs(gram @ gram - gram).max() <= SETTLED:
            break
        factors = [*factors, _factor(gram, n, shifted=not factors)]
        composed = factors[-1] @ composed
        model.rounds += 1
    _, sigma, rows = np.linalg.svd(composed)
    keep = [k for k in range(min(components, d)) if sigma[k] > sigma[0] * d * 2.0 ** -46]
    vectors = rows[keep].T
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(keep))])
    model.eigenvalues, model.components = sigma[keep] ** 2 / n, vectors
    scaled = vectors / np.sqrt(model.eigenvalues)
    spread = _gram(fit, len(keep), lambda x: (x - mean) @ scaled) / n
    model.identity_error = float(np.abs(spread - np.eye(len(keep))).max())
    return model


def _row_values(model: Whitening):
    mean, sums = model.mean, model.sums
    scaled = model.components / np.sqrt(model.eigenvalues)
    n, d = model.n, len(sums)

    @F.pandas_udf("deviation long, whitened array<double>")
    def udf(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, d), dtype=np.int64)
        most = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
        if most * most * max(d, 1) < 1 << 63:
            off = n * x - np.array(sums, dtype=np.int64)
            deviation = (off * off).sum(axis=1).tolist()
        else:  # exact in integers of any size
            deviation = [sum((n * a - s) ** 2 for a, s in zip(row.tolist(), sums)) for row in x]
        fits = [v if v < 1 << 63 else None for v in deviation]
        return pd.DataFrame({"deviation": pd.array(fits, dtype="Int64"), "whitened": list((x - mean) @ scaled)}, index=vectors.index)

    return udf


def whiten(df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per whole vector and component: the columns of ``df``, then component, n, deviation, whitened, explained, identity_error."""
    inner, at = sealed(df)
    rows = integer_vectors(inner, at[column])
    model = fit_whitening(land(rows.select("x").distinct()), components)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]) if len(model.eigenvalues) else F.array().cast("array<double>")
    out = rows.withColumn("v", _row_values(model)("x"))
    out = out.select(*inner.columns, "v.deviation", F.posexplode(F.arrays_zip(F.col("v.whitened").alias("w"), shares.alias("e"))).alias("k", "c"))
    return out.select(*unsealed(at), (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                      F.col("c.w").alias("whitened"), F.col("c.e").alias("explained"), F.lit(model.identity_error).alias("identity_error"))


def op11_shifted_cholesky(spark, sf_dir) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("embedding")
