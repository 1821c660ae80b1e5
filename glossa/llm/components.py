"""Connected components of an edge table by alternating star contraction.

Every round turns each node's neighbourhood into a star around its smallest
known neighbour, first over larger neighbours, then over smaller ones; every
step is a table of its own, so no round inherits plans or size estimates; the
number of rounds grows with the logarithm of the component's size, not with
its diameter.  Only grouped minima (combined before the shuffle) and
equi-joins against them are used.  A hub may own a third of all edges: the
minima are materialised first, so both join inputs are plain exchanges, whose
hot partitions adaptive execution splits.  No edge reaches the driver, but
for the count and checksum that tell when a round changed nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.session import land


def _stars(pairs: DataFrame) -> DataFrame:
    """(u, v) with ``m``, the smallest of u and its v; u may own any number of rows."""
    least = pairs.groupBy(F.col("u").alias("mu")).agg(F.min("v").alias("m"))
    least = land(least.select("mu", F.least("mu", "m").alias("m")))
    return pairs.join(least, F.col("u") == F.col("mu"))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges``; root = smallest node of its component.

    Nodes need an ordering; rows with a null end and loops are left out
    (a node with loops only does not appear).  Empty input: empty result.
    """
    cut = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    cut = land(cut)
    state = _state(cut)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = cut.unionByName(cut.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = land(large)
        star = _stars(large)
        small = star.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            star.select("u", F.col("m").alias("v")))
        cut = land(small.distinct())
        now = _state(cut)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cut.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return cut.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def stars(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Inside a task: every set that the boolean matrix ``near`` links between ids ``a`` and ``b``, as a star.

    A star is (members, smallest member repeated): as many edges as members,
    whatever the number of links.
    """
    fresh_rows, fresh_cols, out = near.any(axis=1), near.any(axis=0), []
    if a is b:
        fresh_rows &= near.sum(axis=1) > 1  # a point is near itself
    for s in np.flatnonzero(fresh_rows):
        if not fresh_rows[s]:
            continue
        members, rows = [], np.array([s])
        while len(rows):
            fresh_rows[rows] = False
            cols = np.flatnonzero(near[rows].any(axis=0) & fresh_cols)
            fresh_cols[cols] = False
            members += [a[rows], b[cols]]
            rows = np.flatnonzero(near[:, cols].any(axis=1) & fresh_rows) if len(cols) else cols
        got = np.unique(np.concatenate(members))
        if len(got) > 1:
            out.append((got[1:], np.full(len(got) - 1, got[0])))
    return out
