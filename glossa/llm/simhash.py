"""SimHash near-dedup with vantage-point trees (operator 7).

Fingerprints of whole texts are made in Arrow batches.  Equal fingerprints are
one point.  Two fingerprints within ``bits`` bits agree in at least one of
``bits + 1`` slices, so there is one vantage-point tree for each slice, over
the Hamming distance of the slice's values and with a tolerance of zero: a
node sends values within its radius to one side, the others to the other, and
no point is copied.  Each point goes to exactly one shard of each tree, and
each linked pair meets in at least one, whatever the number of points.  A
shard is searched by a tree over all 64 bits, where points within ``bits`` of
a boundary (the triangle inequality's bound) go to both sides, down to blocks
that are compared bit by bit.  Of a block only a spanning star of each linked
set leaves the task, never all pairs of a group; the stars meet in distributed
connected components.

The slice trees part the possible values, not a sample; only how finely they
part them follows the number of points.  A shard beyond ``SHARD`` points (a
hot slice value) is dealt again by the slices of its remaining bits, and where
those are hot as well into blocks, pairs of which go to tasks of their own.

Defined cases: null, empty and blank texts have fingerprint zero and link like
any other; long texts are hashed in runs of bounded memory; texts with fewer
words than a shingle are one shingle; rows with a null doc_id take part, and
component_id is the smallest non-null doc_id (null if there is none); repeated
rows are linked; of tied rows (equal doc_id and text) ``keep_one`` keeps any
one; empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import read_table, sealed, text_hashes, unsealed
from glossa.llm.components import components, stars
from glossa.session import land

SHINGLE = 3
BITS = 3
SEED = 42
SHARD = 65_536        # points of a shard that one task searches
LEAF = 1_024          # points a shard is meant to hold
BLOCK = 2_048         # points compared bit by bit
SLICE_BITS = 16       # of a slice, at most
_RUN = 65_536         # shingles hashed at once


# ------------------------------------------------------------- fingerprints

def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a whole text; memory beyond the text's own is bounded."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    joined = b" ".join(ws)
    lengths = np.fromiter(map(len, ws), dtype=np.int64, count=len(ws))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    width = min(shingle, len(ws))
    starts, ends = starts[: len(ws) - width + 1], ends[width - 1:]
    counts, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest
    for k in range(0, len(starts), _RUN):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k:k + _RUN].tolist(), ends[k:k + _RUN].tolist())], dtype=">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts)).view(">u8")[0])


def fingerprints(shingle: int):
    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64).view(np.int64), index=texts.index)

    return udf


# ------------------------------------------------------- vantage-point tree

def build_tree(sample: np.ndarray, scale: float, leaf: int, bits: int, seed: int = 0) -> list:
    """Nodes (vantage point, radius, inner child, outer child), leaves as None; node 0 is the root.

    ``sample`` stands for ``scale`` times as many points.  A node is split
    where the two sides, overlap included, promise the least later work.
    """
    rng = np.random.default_rng(seed)
    nodes: list = [None]
    todo = [(0, sample)]
    while todo:
        at, pts = todo.pop()
        if len(pts) * scale <= leaf or len(pts) < 8:
            continue
        best = None
        for p in rng.choice(pts, size=min(8, len(pts)), replace=False):
            cum = np.cumsum(np.bincount(np.bitwise_count(pts ^ p), minlength=65)) / len(pts)
            inner, outer = np.append(cum[bits:], np.ones(bits)), 1 - cum
            cost = inner ** 1.6 + outer ** 1.6
            r = int(np.argmin(cost))
            if max(inner[r], outer[r]) < 0.97 and (best is None or cost[r] < best[0]):
                best = (cost[r], p, r)
        if best is None:
            continue
        _, p, r = best
        d = np.bitwise_count(pts ^ p)
        nodes[at] = (int(p), r, len(nodes), len(nodes) + 1)
        todo += [(len(nodes), pts[d <= r + bits]), (len(nodes) + 1, pts[d > r])]
        nodes += [None, None]
    return nodes


def route(points: np.ndarray, nodes: list, bits: int):
    """(leaf, indexes of its points) for every leaf that any point reaches."""
    todo = [(0, np.arange(len(points)))]
    while todo:
        at, idx = todo.pop()
        if not len(idx):
            continue
        if nodes[at] is None:
            yield at, idx
            continue
        p, r, inner, outer = nodes[at]
        d = np.bitwise_count(points[idx] ^ np.uint64(p))
        todo += [(inner, idx[d <= r + bits]), (outer, idx[d > r])]


# ------------------------------------------------------------ inside a task

def shard_stars(a: np.ndarray, b: np.ndarray | None, bits: int) -> pd.DataFrame:
    """Stars of the links inside ``a`` (b None) or between ``a`` and ``b``."""
    pts = a if b is None else np.concatenate([a, b])
    side = np.zeros(len(pts), dtype=bool)
    side[len(a):] = True
    share = max(1, len(pts) // 16_384)
    found: list = []
    for _, idx in route(pts, build_tree(pts[::share], share, BLOCK, bits), bits):
        own = idx if b is None else idx[~side[idx]]
        other = own if b is None else idx[side[idx]]
        for i in range(0, len(own), BLOCK):
            one = pts[own[i:i + BLOCK]]
            for j in range(i if b is None else 0, len(other), BLOCK):
                two = one if b is None and i == j else pts[other[j:j + BLOCK]]
                found += stars(np.bitwise_count(one[:, None] ^ two[None, :]) <= bits, one, two)
    if not found:
        return pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})
    both = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], axis=1), axis=0)
    return pd.DataFrame({"u": both[:, 0].copy().view(np.int64), "v": both[:, 1].copy().view(np.int64)})


def slice_tree(width: int, leaves: int, seed: int = 0) -> np.ndarray:
    """Leaf number of every value of ``width`` bits, in a vantage-point tree of about ``leaves`` leaves.

    Every node parts its values at the distance from a vantage value that
    halves them best; a leaf's values are at most one side of each boundary.
    """
    rng = np.random.default_rng(seed)
    todo, out = [(np.arange(1 << width, dtype=np.int64), leaves)], np.zeros(1 << width, dtype=np.int32)
    number = 0
    while todo:
        values, want = todo.pop()
        if want > 1 and len(values) > 1:
            near = np.bitwise_count(values ^ rng.choice(values))
            cum = np.cumsum(np.bincount(near))[:-1]
            inner = near <= int(np.argmin(np.abs(2 * cum - len(values))))
            share = min(max(round(want * inner.sum() / len(values)), 1), want - 1)
            todo += [(values[inner], share), (values[~inner], want - share)]
            continue
        out[values] = number
        number += 1
    return out


def _width(bits: int, total: int) -> int:
    return min(SLICE_BITS, total // (bits + 1))


def _piece(values: np.ndarray, number: int, width: int) -> np.ndarray:
    return (values >> np.uint64(number * width)) & np.uint64((1 << width) - 1)


def deal(points: DataFrame, bits: int, leaves: int) -> DataFrame:
    """(shard, fp): every point once in each of the ``bits + 1`` slice trees."""
    width = _width(bits, 64)
    leaf_of = points.sparkSession.sparkContext.broadcast(slice_tree(width, leaves))  # 2 ** SLICE_BITS numbers at most

    def route_batch(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy(dtype=np.int64)
            for s in range(bits + 1):
                leaf = leaf_of.value[_piece(fp.view(np.uint64), s, width).astype(np.int64)]
                yield pd.DataFrame({"shard": np.int64(s) << 32 | leaf.astype(np.int64), "fp": fp})

    return points.select("fp").mapInPandas(route_batch, "shard long, fp long")


def deal_again(hot: DataFrame, bits: int) -> DataFrame:
    """(shard, value, piece, sub, fp): points of hot shards, by their slice's value and once by each slice of the other bits."""
    width = _width(bits, 64)
    rest_bits = 64 - width
    fine = _width(bits, rest_bits)

    def split_batch(batches):
        for pdf in batches:
            fp = pdf["fp"].to_numpy(dtype=np.int64)
            own = (pdf["shard"].to_numpy(dtype=np.int64) >> 32).astype(np.uint64) * np.uint64(width)
            bare = fp.view(np.uint64)
            value = (bare >> own) & np.uint64((1 << width) - 1)
            high = np.where(own + np.uint64(width) >= 64, np.uint64(0), (bare >> ((own + np.uint64(width)) & np.uint64(63))) << own)
            rest = (bare & ((np.uint64(1) << own) - np.uint64(1))) | high
            for piece in range(bits + 1):
                sub = _piece(rest, piece, fine)
                yield pd.DataFrame({"shard": pdf["shard"], "value": value.astype(np.int64), "piece": np.int32(piece), "sub": sub.astype(np.int64), "fp": fp})

    return hot.mapInPandas(split_batch, "shard long, value long, piece int, sub long, fp long")


def _search(bits: int):
    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return shard_stars(pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64), None, bits)

    return search


def _search_pairs(bits: int):
    def search(key, pdf):
        own = pdf["own"].to_numpy()
        fp = pdf["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        i, j = key[-2], key[-1]
        return shard_stars(fp, None, bits) if i == j else shard_stars(fp[own == i], fp[own == j], bits)

    return search


def _parted(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of groups of at most SHARD rows, and rows of the larger ones with their number of rows."""
    big = land(rows.groupBy(*keys).agg(F.count("*").alias("rows_here")).filter(F.col("rows_here") > SHARD))
    return rows.join(big, keys, "left_anti"), rows.join(big, keys)


def links(points: DataFrame, bits: int) -> DataFrame:
    """(u, v): edges that connect exactly what the links within ``bits`` connect; ``points`` has distinct longs ``fp``."""
    edge = "u long, v long"
    leaves = max(points.count() // LEAF, 1)
    fit, hot = _parted(land(deal(points, bits, min(leaves, 1 << SLICE_BITS))), ["shard"])
    out = fit.groupBy("shard").applyInPandas(_search(bits), edge)
    if hot.isEmpty():
        return out
    keys = ["shard", "value", "piece", "sub"]
    fit, hot = _parted(land(deal_again(hot.select("shard", "fp"), bits)), keys)
    out = out.unionByName(fit.groupBy(*keys).applyInPandas(_search(bits), edge))
    if hot.isEmpty():
        return out
    parts = F.ceil(F.col("rows_here") / SHARD).cast("int")
    dealt = hot.withColumn("own", F.pmod(F.xxhash64("fp"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    tasks = dealt.select(*keys, "fp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return out.unionByName(tasks.groupBy(*keys, "i", "j").applyInPandas(_search_pairs(bits), edge))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """doc_id, ``fp`` (long), ``hash`` and ``hash2`` (of the text) and ``component_id`` per row of ``docs``."""
    prints = land(docs.select("doc_id", *text_hashes("text"), fingerprints(shingle)(F.col("text")).alias("fp")))
    points = land(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(points, bits), "u", "v")
    placed = points.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy(F.col("root").alias("g")).agg(F.min("least").alias("component_id"))
    placed = land(placed.join(names, F.col("root") == F.col("g")).select(F.col("fp").alias("p_fp"), "component_id", "root"))
    return prints.join(placed, F.col("fp") == F.col("p_fp")).drop("p_fp")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row of each group of near-duplicates (smallest doc_id, nulls last), with all columns of ``docs``."""
    found = near_duplicates(docs.select("doc_id", "text"), shingle, bits)
    ordered = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash", "hash2")
    kept = found.groupBy("root").agg(F.min(ordered).alias("first")).select(
        F.col("first.doc_id").alias("k_id"), F.col("first.hash").alias("k_hash"), F.col("first.hash2").alias("k_hash2"))
    kept = kept.withColumn("k_key", F.xxhash64("k_id", "k_hash"))
    out, at = sealed(docs)
    doc_id = F.col(at["doc_id"])
    out = out.withColumns(dict(zip(("hash", "hash2"), text_hashes(at["text"])))).withColumn("key", F.xxhash64(doc_id, F.col("hash"))).join(
        kept, (F.col("key") == F.col("k_key")) & doc_id.eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash"))
        & (F.col("hash2") == F.col("k_hash2")), "left_semi")
    # equal rows (same doc_id and text) have the same key: one of them stays
    out = out.withColumn("nth", F.row_number().over(Window.partitionBy("key", "hash2").orderBy("key")))
    return out.filter("nth = 1").select(*unsealed(at))


def op7_simhash(spark, sf_dir) -> DataFrame:
    out = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
