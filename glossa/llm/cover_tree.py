"""Embedding near-dedup by dual traversal of cover trees (operator 10).

Vectors are scaled to length one, so that cosine >= t means a distance of at
most sqrt(2 - 2 t).  Equal vectors of a label are one point with a weight.

Upper levels: a group (first a label, then a cell) of more than ``BLOCK``
points gets a net of nested centers from a bounded sample of its points, one
center a block, at most ``FAN``; every point lives in the cell of its nearest
center, and levels follow until no cell is larger than a block, so the cells
grow in number with the data.  A point visits another cell of its group only
if it may hold a partner: the point must be within the cell's covering radius
plus the limit of its center, and within the limit of the half-space in which
that center is nearer than the point's own.  Of two cells one sends its points
to the other; visitors are compared with the points that live there, never
with each other.  Data without structure prune nothing this way; then all
blocks of a label meet.  Cells that no level divides are dealt into blocks and
pairs of blocks.  Lower levels: inside a task both blocks get cover trees;
node pairs are pruned by the same bound and what is left is compared exactly.

A task returns each point's number of linked vectors and spanning stars of
linked sets, never pairs; stars meet in distributed connected components.

Defined cases: a null label, a null, empty or zero vector and one with null or
non-finite components link with nothing; vectors of different lengths do not
link; repeated rows are vectors like others and link; a null vec_id takes
part, component_id is the smallest non-null vec_id; empty table: empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import read_table
from glossa.llm.components import components, stars
from glossa.session import land

COSINE = 0.93
BLOCK = 4_096         # points of a cell that one task holds of each side
FAN = 256             # cells that one level makes of a group at most
LEVELS = 6            # levels of cells; larger cells are left to pairs of blocks
SAMPLE = 4_096        # expected points of a group that its net is fitted on (documented bound)
CHUNK = 16_384        # points that one task sends to cells
GROUP = ["label", "dim", "path"]
LEAF = 128
CHILDREN = 64
_SLACK = 1e-9


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of the rows of x (unit vectors) to the rows of y."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


def nested_centers(points: np.ndarray, wanted: int) -> np.ndarray:
    """Rows of nested nets with halving radii, coarse first, cut at ``wanted`` centers."""
    chosen = [0]
    near = distance(points, points[[0]])[:, 0]
    radius = 2.0
    while len(chosen) < min(wanted, len(points)) and radius > 1e-3:
        radius /= 2
        while len(chosen) < wanted:
            far = np.flatnonzero(near > radius)
            if not len(far):
                break
            chosen.append(int(far[0]))
            near = np.minimum(near, distance(points, points[[far[0]]])[:, 0])
    return np.array(chosen)


class Node:
    """A cover-tree node: center, covering radius, and children or the rows it holds."""

    __slots__ = ("center", "radius", "children", "rows")

    def __init__(self, x: np.ndarray, rows: np.ndarray):
        self.center, self.rows, self.children = x[rows[0]], rows, []
        self.radius = float(distance(x[rows], self.center[None, :]).max())


def build(x: np.ndarray) -> Node:
    """Levels with halving radii; points that no net of ``CHILDREN`` centers covers share a last child."""
    root = Node(x, np.arange(len(x)))
    todo = [(root, 1.0)]
    while todo:
        node, radius = todo.pop()
        if len(node.rows) <= LEAF or node.radius < 1e-6 or radius < 1e-3:
            continue
        left, groups = node.rows, []
        while len(left) and len(groups) < CHILDREN:
            inside = distance(x[left], x[left[:1]])[:, 0] <= radius
            groups.append(left[inside])
            left = left[~inside]
        if len(groups) == 1 and not len(left):
            todo.append((node, radius / 2))
            continue
        node.children = [Node(x, g) for g in groups]
        todo += [(c, radius / 2) for c in node.children]
        if len(left):
            node.children.append(Node(x, left))  # stays a leaf: its points are as far apart as this level goes
    return root


def near_pairs(a: Node, b: Node | None, limit: float):
    """Pairs of leaves of two trees (or of one, b None) that may hold points within ``limit``."""
    todo = [(a, a if b is None else b)]
    while todo:
        p, q = todo.pop()
        if p is not q and distance(p.center[None, :], q.center[None, :])[0, 0] > p.radius + q.radius + limit + _SLACK:
            continue
        if not p.children and not q.children:
            yield p, q
        elif p is q:
            todo += [(c, d) for i, c in enumerate(p.children) for d in p.children[i:]]
        elif p.children and (not q.children or p.radius >= q.radius):
            todo += [(c, q) for c in p.children]
        else:
            todo += [(p, c) for c in q.children]


def compare(x: np.ndarray, xid: np.ndarray, xw: np.ndarray, y: np.ndarray | None, yid, yw, cosine: float) -> pd.DataFrame:
    """cid, links, root: linked vectors of other points per point (root null), and star edges (links 0)."""
    own = y is None
    y, yid, yw = (x, xid, xw) if own else (y, yid, yw)
    nx, ny, found = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    if len(x) and len(y):
        for p, q in near_pairs(build(x), None if own else build(y), float(np.sqrt(2 - 2 * cosine))):
            for i in range(0, len(p.rows), 2_048):
                r = p.rows[i:i + 2_048]
                for j in range(i if p is q else 0, len(q.rows), 2_048):
                    same = p is q and i == j
                    c = r if same else q.rows[j:j + 2_048]
                    near = x[r] @ y[c].T >= cosine
                    if same:
                        near |= near.T
                        np.fill_diagonal(near, False)
                    if not near.any():
                        continue
                    nx[r] += near @ yw[c]
                    if not same:
                        (nx if own else ny)[c] += xw[r] @ near
                    else:
                        np.fill_diagonal(near, True)
                    ids = xid[r]
                    found += stars(near, ids, ids if same else yid[c])
    out = [pd.DataFrame({"cid": xid[nx > 0], "links": nx[nx > 0], "root": pd.Series(np.full((nx > 0).sum(), -1, np.int64))})]
    if not own:
        out.append(pd.DataFrame({"cid": yid[ny > 0], "links": ny[ny > 0], "root": pd.Series(np.full((ny > 0).sum(), -1, np.int64))}))
    if found:
        both = np.unique(np.stack([np.concatenate(z) for z in zip(*found)], axis=1), axis=0)
        out.append(pd.DataFrame({"cid": both[:, 0], "links": np.zeros(len(both), np.int64), "root": both[:, 1]}))
    return pd.concat(out, ignore_index=True)


def _matrix(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in column])
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes_of(vectors: DataFrame) -> DataFrame:
    """cid, label, embedding, dim, times, least: the distinct usable vectors of each label."""
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    usable = vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(fine).filter(some)
    grouped = usable.groupBy("label", "embedding").agg(F.count("*").alias("times"), F.min("vec_id").alias("least"))
    return land(grouped.withColumns({"dim": F.size("embedding"), "cid": F.monotonically_increasing_id()}))


def visits(dots: np.ndarray, centers: np.ndarray, lives: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest center of every row of ``dots`` (points x centers), and which cells it is sent to.

    A partner of x in cell j is no nearer to x's center i than to j's, so the
    angle between x and the half-space of j, whose sine is
    (x.ci - x.cj) / |ci - cj|, is at most that of the threshold.  A point that
    lives in the group goes to its own cell and, of each two cells, only one
    way; a visitor goes wherever it may have partners.
    """
    near = dots.argmax(axis=1)
    own, gap = dots[np.arange(len(dots)), near][:, None], distance(centers, centers)
    np.fill_diagonal(gap, 1.0)
    sent = own - dots <= (np.sqrt(1 - cosine * cosine) + _SLACK) * gap[near]
    other = np.arange(len(centers))[None, :]
    oneway = (near[:, None] < other) ^ ((near[:, None] + other) % 2 == 1)
    sent &= ~lives[:, None] | oneway | (near[:, None] == other)
    return near, sent


def next_level(placed: DataFrame, sizes: DataFrame, level: int, cosine: float, block: int, sample: int) -> DataFrame:
    """The points of groups with more than ``block`` inhabitants, in the cells of those groups."""
    big = sizes.filter(F.col("homes") > block).withColumns({
        "fan": F.least(F.lit(FAN), F.ceil(F.col("homes") / block)).cast("int"), "chunks": F.ceil((F.col("homes") + F.col("guests")) / CHUNK).cast("int")})
    points = placed.join(big, GROUP)
    luck = F.pmod(F.xxhash64("embedding", F.lit(f"net {level}")), F.lit(1 << 30))
    picked = points.filter(F.col("lives") & (luck < F.lit(float(sample)) / F.col("homes") * (1 << 30)))
    types = dict(placed.dtypes)
    group = ", ".join(f"{c} {types[c]}" for c in GROUP)

    def net(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid", ignore_index=True)
        x = _matrix(pdf["embedding"])
        chosen = nested_centers(x, int(pdf["fan"].iloc[0]))
        return pdf.iloc[chosen].assign(cell=np.arange(len(chosen), dtype=np.int32))[[*GROUP, "cell", "embedding", "chunks"]]

    nets = land(picked.select(*GROUP, "cid", "embedding", "fan", "chunks").groupBy(*GROUP).applyInPandas(
        net, f"{group}, cell int, embedding {types['embedding']}, chunks int"))
    fresh = points.select(*placed.columns, F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int").alias("chunk"), F.lit(-1).alias("cell"))
    spread = nets.select(F.lit(-1).cast("long").alias("cid"), "label", "dim", "embedding", F.lit(0).cast("long").alias("times"), "path",
                         F.lit(False).alias("lives"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "cell")

    def send(pdf: pd.DataFrame) -> pd.DataFrame:
        heads, rows = pdf[pdf["cell"] >= 0].sort_values("cell"), pdf[pdf["cell"] < 0].reset_index(drop=True)
        if not len(rows):
            return rows.assign(far=0.0)[out]
        if not len(heads):  # no point of the group was drawn: one cell
            return rows.assign(path=rows["path"] + "/0", far=0.0)[out]
        centers, x, parts = _matrix(heads["embedding"]), _matrix(rows["embedding"]), []
        for i in range(0, len(rows), 4_096):
            dots = x[i:i + 4_096] @ centers.T
            lives = rows["lives"].to_numpy(bool)[i:i + 4_096]
            near, sent = visits(dots, centers, lives, cosine)
            r, c = np.nonzero(sent)
            part = rows.iloc[r + i]
            parts.append(part.assign(path=part["path"] + np.char.add("/", c.astype(str)).astype(object), lives=lives[r] & (near[r] == c),
                                     far=np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots[r, c]))))
        return pd.concat(parts, ignore_index=True)[out]

    out = [*placed.columns, "far"]
    sent = land(fresh.unionByName(spread).groupBy(*GROUP, "chunk").applyInPandas(send, ", ".join(f"{c} {types[c]}" for c in placed.columns) + ", far double"))
    radii = land(sent.filter("lives").groupBy(*GROUP).agg(F.max("far").alias("radius")))
    limit = F.lit(float(np.sqrt(2 - 2 * cosine)) + _SLACK)
    return land(sent.join(radii, GROUP).filter(F.col("lives") | (F.col("far") <= F.col("radius") + limit)).select(*placed.columns))


def cells_of(points: DataFrame, cosine: float = COSINE, block: int = BLOCK, sample: int = SAMPLE, levels: int = LEVELS) -> DataFrame:
    """Points with their cell (label, dim, path) and whether they live there or visit, and the cell's homes and guests."""
    todo, done = points.withColumns({"path": F.lit(""), "lives": F.lit(True)}), []
    for level in range(levels + 1):
        sizes = land(todo.groupBy(*GROUP).agg(F.count_if("lives").alias("homes"), F.count_if(~F.col("lives")).alias("guests")))
        last = level == levels or sizes.filter(F.col("homes") > block).isEmpty()
        done.append(todo.join(sizes if last else sizes.filter(F.col("homes") <= block), GROUP))
        if last:
            break
        todo = next_level(todo, sizes, level, cosine, block, sample)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def tasks_of(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each point once for every pair of blocks (``visit``, k1, k2) it takes part in, on a side.

    Blocks of inhabitants meet each other (k1 <= k2, with themselves on side
    0 only) and every block of visitors (k2).
    """
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    upto = lambda n: F.slice(F.sequence(F.lit(0), F.col(n)), 1, F.col(n))
    task = lambda visit, one, two, side: F.struct(F.lit(visit).alias("visit"), one.alias("k1"), two.alias("k2"), side.alias("side"))
    b = F.col("blk")
    dealt = cells.withColumns({"hb": blocks("homes"), "gb": blocks("guests")}).withColumn(
        "blk", F.pmod(F.xxhash64("cid"), F.when(F.col("lives"), F.col("hb")).otherwise(F.col("gb"))).cast("int"))
    living = F.concat(F.transform(upto("hb"), lambda k: task(False, F.least(b, k), F.greatest(b, k), (k < b).cast("int"))),
                      F.transform(upto("gb"), lambda m: task(True, b, m, F.lit(0))))
    visiting = F.transform(upto("hb"), lambda k: task(True, k, b, F.lit(1)))
    return dealt.select(*GROUP, "cid", "times", "embedding", F.explode(F.when(F.col("lives"), living).otherwise(visiting)).alias("t")).select(
        *GROUP, "t.*", "cid", "times", "embedding")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of ``vectors`` (vec_id, label, embedding)."""
    classes = classes_of(vectors)
    tasks = tasks_of(cells_of(classes.select("cid", "label", "dim", "embedding", "times"), cosine, block), block)

    def search(key, pdf):
        side = pdf["side"].to_numpy()
        x = _matrix(pdf["embedding"])
        cid, w = pdf["cid"].to_numpy(np.int64), pdf["times"].to_numpy(np.int64)
        own = not key[3] and key[4] == key[5]
        a, b = side == 0, side == 1
        return compare(x[a], cid[a], w[a], None if own else x[b], cid[b], w[b], cosine)

    found = land(tasks.groupBy(*GROUP, "visit", "k1", "k2").applyInPandas(search, "cid long, links long, root long"))
    links = found.groupBy(F.col("cid").alias("l_cid")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("root >= 0").select("cid", "root"), "cid", "root").withColumnRenamed("root", "c_root")
    placed = classes.join(links, F.col("cid") == F.col("l_cid"), "left").join(roots, F.col("cid") == F.col("node"), "left").select(
        F.col("label").alias("p_label"), F.col("embedding").alias("p_embedding"), "least",
        (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("c_root", "cid").alias("c_root"))
    names = placed.groupBy(F.col("c_root").alias("g_root")).agg(F.min("least").alias("component_id"))
    placed = placed.join(names, F.col("c_root") == F.col("g_root")).select("p_label", "p_embedding", "n_links", "component_id")
    out = vectors.select("vec_id", "label", "embedding").join(
        placed, (F.col("label") == F.col("p_label")) & (F.col("embedding") == F.col("p_embedding")), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                     F.when(F.col("p_label").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op10_cover_tree(spark, sf_dir) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS c FROM links GROUP BY x)
SELECT vec_id, coalesce(c, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings e LEFT JOIN counts ON counts.x = e.vec_id LEFT JOIN least ON least.x = e.vec_id
"""
