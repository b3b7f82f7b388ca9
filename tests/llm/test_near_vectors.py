import math

import numpy as np
import pytest

from basalt.llm import near_vectors
from basalt.llm.components import connected_components, join_labels


def brute(rows, cosine=0.9):
    """id -> (links, component) by all pairs."""
    units = []
    for i, v in rows:
        ok = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if ok else None)
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine:
                links[a] += 1
                links[b] += 1
                label[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, n, least.get(find(k)), i is not None and least[find(k)] == i) for k, ((i, _), n) in enumerate(zip(rows, links, strict=True))), key=str)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return sorted(map(tuple, near_vectors.near_duplicate_vectors(df, **more).collect()), key=str)


def clusters(n, dim, seed, decay=1.0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim)) * decay ** np.arange(dim)
    near = base[rng.integers(0, len(base), n - len(base))]
    near = near + rng.normal(size=near.shape) * decay ** np.arange(dim) * rng.choice([0.02, 0.25, 0.5], (len(near), 1))
    return np.vstack([base, near]).astype(np.float32)


@pytest.mark.parametrize(("dim", "decay", "tile"), [(16, 1.0, 8192), (16, 1.0, 40), (12, 0.6, 30), (1, 1.0, 50), (3, 1.0, 25)])
def test_same_as_all_pairs(spark, monkeypatch, dim, decay, tile):
    monkeypatch.setattr(near_vectors, "TILE_ROWS", tile)
    monkeypatch.setattr(near_vectors.near_links, "__defaults__", (near_vectors.AXES, tile))
    rows = [(i * 3 % 1000, v.tolist()) for i, v in enumerate(clusters(240, dim, dim, decay))]
    assert run(spark, rows) == brute(rows)


def uneven(n, seed=0, dim=8):
    """Vectors that spread along two axes mostly, with near pairs planted at all distances around the threshold."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)) * np.array([1, 1] + [0.02] * (dim - 2))
    near = base + rng.normal(size=base.shape) * rng.uniform(0, 0.2, (n, 1)) * np.array([1, 1] + [0.02] * (dim - 2))
    return np.vstack([base, near]).astype(np.float32)


def test_grids_part_vectors(spark, monkeypatch):
    """Every block is joined by its own grid, guests of neighbouring cells included, and pairs that several blocks find count once."""
    monkeypatch.setattr(near_vectors, "GRIDDED", (4,))
    vectors = uneven(200)
    plan = near_vectors.Plan(near_vectors.units_of([v.tobytes() for v in vectors], 8), 0.002)
    assert len(plan.grids) == len(plan.blocks) > 1
    units = near_vectors.units_of([v.tobytes() for v in vectors], 8)
    a = plan.rotated(units)
    seen = {}
    for block in range(len(plan.blocks)):
        cells = plan._cells(a, block, plan.grids[block])
        for i, j in plan.near(block, units, units, True, 0.999):
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                seen[p, q] = seen.get((p, q), 0) + 1
                assert np.abs(cells[p] - cells[q]).max() <= 1
    want = {(p, q) for p in range(400) for q in range(p + 1, 400) if units[p] @ units[q] >= 0.999}
    assert set(seen) == want and set(seen.values()) == {1} and len(want) > 50
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    assert run(spark, rows, cosine=0.999) == brute(rows, 0.999)


def test_blocks_decide(monkeypatch):
    """Pairs that no block has within its share are never verified, and few others are."""
    rng = np.random.default_rng(2)
    units = rng.normal(size=(1500, 64))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    plan = near_vectors.Plan(units, 0.2)
    assert not plan.grids and max(map(len, plan.blocks)) <= near_vectors.AXES
    a = plan.rotated(units)
    for block, own in enumerate(plan.blocks):
        got = np.concatenate([i * 1500 + j for i, j in plan.candidates(block, a, a)])
        gap = ((a[:, None, own] - a[None, :, own]) ** 2).sum(axis=2)
        assert set(np.flatnonzero(gap.reshape(-1) <= plan.shares[block])) <= set(got.tolist())
        assert len(got) < 0.02 * 1500 * 1500


def test_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.5]
    rows = [(1, v), (2, v), (2, v), (3, [2.0, 4.0, 6.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [1.0, None, 1.0]), (8, [float("nan"), 1.0, 1.0]), (9, [float("inf"), 1.0, 1.0]), (None, v), (10, w), (11, [1.0, 2.0]), (12, [1e-38, 2e-38, 3e-38]), (13, [-0.0, 1.0, 0.0]), (14, [0.0, 1.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, [1.0], "k", 2)], "vec_id bigint, embedding array<double>, KEY string, n_links int")
    assert near_vectors.near_duplicate_vectors(df).collect() == [(1, 0, 1, True)]


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(80)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    label = np.arange(6000)
    join_labels(label, np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: int(label[x]) for x in nodes}
