"""Cells of the cover tree: every linked pair meets once, and points stay out of cells without partners."""

import numpy as np
import pytest
import reference as ref
from pyspark.sql import functions as F

from glossa.llm import cover_tree


def _table(spark, x, label):
    return spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))],
                                 "vec_id long, embedding array<float>, label int")


def _clusters(seed, groups, each, dims, spread):
    rng = np.random.default_rng(seed)
    x = np.repeat(rng.normal(size=(groups, dims)), each, axis=0)
    return (x + rng.normal(scale=spread, size=x.shape)).astype(np.float32)


def _check(spark, x, label, block):
    got = {r["vec_id"]: r for r in cover_tree.near_duplicates(_table(spark, x, label), block=block).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= cover_tree.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    roots = ref.components(len(x), np.argwhere(np.triu(near)).tolist())
    for i in range(len(x)):
        assert (got[i]["n_links"], got[i]["component_id"]) == (near[i].sum(), roots[i])
    assert near.any()


def test_no_point_misses_a_cell_that_holds_a_partner():
    rng = np.random.default_rng(5)
    for dims in (2, 3, 8, 32):
        x = rng.normal(size=(600, dims))
        x = np.concatenate([x, x + rng.normal(scale=0.25, size=x.shape)])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centers = x[cover_tree.nested_centers(x, 24)]
        for lives in (np.ones(len(x), bool), np.zeros(len(x), bool)):
            near, sent = cover_tree.visits(x @ centers.T, centers, lives, 0.93)
            a, b = np.nonzero((x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool))
            met = sent[a, near[b]].astype(int)
            if lives[0]:
                met = np.where(near[a] == near[b], 1, met + sent[b, near[a]])
            assert (met == 1).all()


def test_several_levels_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "FAN", 4)
    x = _clusters(1, 40, 20, 12, 0.25)
    _check(spark, x, np.where(np.arange(len(x)) % 7 == 0, 1, 0), 24)


def test_one_tight_cluster_is_left_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "LEVELS", 2)
    _check(spark, np.concatenate([_clusters(2, 1, 300, 8, 0.001), _clusters(3, 30, 3, 8, 0.1)]), np.zeros(390, int), 32)


def test_clustered_points_visit_few_cells(spark):
    x = _clusters(4, 64, 60, 32, 0.05)
    points = cover_tree.classes_of(_table(spark, x, np.zeros(len(x), int))).select("cid", "label", "dim", "embedding", "times")
    cells = cover_tree.cells_of(points, block=64)
    n, homes = cells.agg(F.count("*"), F.count_if("lives")).first()
    assert homes == len(x) and n < 1.5 * len(x)
    blocks = cover_tree.tasks_of(cells, 64)
    assert blocks.count() < 6 * len(x)  # all pairs of blocks: 60 rows a point


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0], 0)], [(1, None, 0), (2, [0.0], 0), (None, [1.0], 0), (3, [1.0], None)]])
def test_few_or_no_points(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = cover_tree.near_duplicates(df, block=1).collect()
    assert len(got) == len(rows) and all(r["n_links"] == 0 for r in got)
