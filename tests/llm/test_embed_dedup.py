from __future__ import annotations

import math

import numpy as np

from verispark.llm import embed_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    """(vec_id, n_links, component_id, kept) of rows with different ids."""
    unit = {}
    for i, v, label in rows:
        if v and label is not None and i is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, np.float32).astype(np.float64)
            unit[i] = (label, x / np.linalg.norm(x))
    near = {i: [] for i, _, _ in rows}
    for i, (a, x) in unit.items():
        near[i] = [j for j, (b, y) in unit.items() if i != j and a == b and len(x) == len(y) and x @ y >= cosine]
    out = set()
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min(seen) if i is not None else None
        out.add((i, len(near[i]), least, least == i))
    return out


def planted(seed=3, dims=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(500, dims))
    out = [(i, v, i % 3) for i, v in enumerate(base)]
    for k in range(300):  # near copies, chains, scaled copies, one group of a third of a label
        at = int(rng.integers(0, 12)) if k % 2 else 1
        noise = rng.normal(size=dims) * np.linalg.norm(base[at]) * 0.12 / math.sqrt(dims)
        out.append((1000 + k, (base[at] + noise) * (1 + k % 4), at % 3))
    out += [(2000 + k, base[7], 1) for k in range(40)]
    return [(i, [float(x) for x in v], label) for i, v, label in out]


def test_no_link_is_missed(spark, rows):
    odd = [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [math.nan] * 16, 1), (3004, [None] + [1.0] * 15, 1), (3005, [1.0] * 16, None),
           (3006, [1.0] * 16, None), (3007, [1.0] * 8, 2), (3008, [1.0] * 8, 2), (3009, [math.inf] + [0.0] * 15, 1), (3010, [-0.0, 1.0], 1), (3011, [0.0, 1.0], 1)]
    table = [*planted(), *odd]
    for cell_rows, block in ((1024, 1024), (20, 32)):
        got = embed_dedup.near_duplicate_vectors(rows(SCHEMA, *table), cell_rows=cell_rows, block=block)
        assert {tuple(r) for r in got.collect()} == brute(table)


def test_defined_results(rows):
    one = [1.0, 0.0, 0.0]
    table = [(10, one, 1), (10, [0.0, 1.0, 0.0], 1), (20, [1.0, 0.01, 0.0], 1), (30, [0.01, 1.0, 0.0], 1), (None, one, 1), (7, one, 2), (20, [1.0, 0.01, 0.0], 1)]
    got = embed_dedup.near_duplicate_vectors(rows(SCHEMA, *table)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [(10, 2, 10, True), (10, 1, 10, True), (20, 2, 10, False), (20, 2, 10, False), (30, 1, 10, False), (None, 0, None, True), (7, 0, 7, True)], key=str)
    assert embed_dedup.near_duplicate_vectors(rows(SCHEMA)).count() == 0
    extra = rows("vec_id long, embedding array<double>, label string, node long, cell int, links int, rep int, copies int", (1, one, "a", 1, 2, 3, 4, 5), (2, [1e300, 1e298, 0.0], "a", 1, 2, 3, 4, 5))
    assert {tuple(r) for r in embed_dedup.near_duplicate_vectors(extra).collect()} == {(1, 1, 1, True), (2, 1, 1, False)}


def test_visits_hold_all_partners_and_few_cells_for_clustered_rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 32))
    x = np.repeat(centres, 60, axis=0) + rng.normal(size=(720, 32)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = embed_dedup.spherical_kmeans(x, 12)
    apart = np.sqrt(np.maximum(2 - 2 * found @ found.T, 0))
    home, visits = embed_dedup.placements(x, found, apart, 0.98)
    assert len(found) == 12 and np.allclose(np.linalg.norm(found, axis=1), 1)
    for i, j in zip(*np.nonzero(x @ x.T >= 0.98)):
        assert home[j] in visits[i]
    assert np.mean([len(v) for v in visits]) < 2


def test_block_classes_join_over_slices():
    rng = np.random.default_rng(6)
    steps = np.cumsum(np.full(600, 0.15))  # a chain on a circle: only neighbours link
    x = np.stack([np.cos(steps * 0.01), np.sin(steps * 0.01)], axis=1)
    order = rng.permutation(600)
    links, root = embed_dedup.block_classes(x[order], x[order], order, order, np.ones(600, np.int64), math.cos(0.0016))
    assert set(root) == {0} and links[order == 0] == 1 and sorted(links)[2] == 2
