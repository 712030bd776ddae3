"""Exact neighbours over cells against all pairs, and how few cells are visited."""

import numpy as np
import pytest

from waymark.operators import vectors as v


def clustered(n, groups, width, seed, spread=0.05):
    r = np.random.default_rng(seed)
    x = r.normal(size=(groups, width))[r.integers(0, groups, n)] + r.normal(size=(n, width)) * spread
    x[::11] = x[5]  # many of one vector
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frame(spark, x, name):
    return spark.createDataFrame([(f"{name}{i:04d}", [float(y) for y in row], str(i % 3)) for i, row in enumerate(x)], "id string, vec array<double>, group string")


@pytest.fixture(params=[(12, 0.05, 4), (700, 1.0, 1024)])
def sides(spark, request, monkeypatch):
    monkeypatch.setattr(v, "BLOCK", 40)
    groups, spread, rows = request.param
    monkeypatch.setattr(v, "CELL_ROWS", rows)
    q, p = clustered(60, groups, 10, 1, spread), clustered(700, groups, 10, 1, spread)
    return frame(spark, q, "q"), frame(spark, p, "p"), np.round(q @ p.T, 9)


def test_nearest_equals_all_pairs(sides):
    q, p, sims = sides
    got = {(r.id, r.rank): (r.nbr, r.similarity) for r in v.nearest(q, p, 7).collect()}
    assert len(got) == 60 * 7
    for i in range(60):
        order = sorted(range(700), key=lambda j: (-sims[i, j], j))[:7]
        assert [got[f"q{i:04d}", k + 1][0] for k in range(7)] == [f"p{j:04d}" for j in order]
        assert [got[f"q{i:04d}", k + 1][1] for k in range(7)] == pytest.approx([sims[i, j] for j in order], abs=1e-9)


def test_own_point_is_left_out_and_few_points_are_all_given(spark, sides):
    _, p, _ = sides
    got = v.nearest(p.limit(5), p.limit(5), 9).collect()
    assert len(got) == 20 and all(r.id != r.nbr for r in got)
    assert v.nearest(p, p.limit(0), 3).collect() == [] and v.similar_pairs(p, p.limit(0), 0.5).collect() == []


def test_pairs_and_sweep_equal_all_pairs(sides):
    q, p, sims = sides
    want = {(f"q{i:04d}", f"p{j:04d}") for i, j in zip(*np.nonzero(sims > 0.9))}
    rows = v.similar_pairs(q, p, 0.9).collect()
    assert {(r.id, r.nbr) for r in rows} == want and len(rows) == len(want)
    same = (np.arange(60) % 3)[:, None] == (np.arange(700) % 3)[None, :]
    for r in v.threshold_sweep(q, p, [0.3, 0.9, 0.999]).collect():
        assert (r.predicted, r.true) == ((sims >= r.threshold).sum(), (same & (sims >= r.threshold)).sum())


def test_few_cells_are_visited(spark, monkeypatch):
    monkeypatch.setattr(v, "CELL_ROWS", 4)
    q, p = (frame(spark, clustered(n, 30, 24, 3, 0.02), name) for n, name in ((200, "q"), (3000, "p")))
    index = v.cells(p.select("id", "vec"))
    assert len(index.centres) == v.CENTRES and index.sizes.sum() == 3000
    met = v._visits(q.select("id", "vec"), index, lambda x, _: index.bounds(x) >= 0.9 - 1e-8).count()
    assert 0 < met < 0.1 * 200 * (index.sizes > 0).sum()
    rows = v.similar_pairs(q, p, 0.9).count()
    x, y = (np.array([r.vec for r in df.orderBy("id").select("vec").collect()]) for df in (q, p))
    assert rows == (np.round(x @ y.T, 9) > 0.9).sum() > 1000
