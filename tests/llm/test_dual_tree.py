from __future__ import annotations

import math

import numpy as np

from verispark.llm import dual_tree

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, asked, k):
    usable = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in asked:
        if q in usable:
            scored = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_matches_brute_force(spark, rows):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 12))
    vectors = [(i, [float(x) for x in centres[i % 5] + rng.normal(size=12) * 0.1]) for i in range(900)]
    vectors += [(1000 + i, [0.5] * 12) for i in range(300)]  # one hot vector, ties by id
    vectors += [(2000, None), (2001, []), (2002, [math.nan] * 12), (2003, [math.inf] + [0.0] * 11), (2004, [None] + [1.0] * 11), (2005, [-0.001] * 12)]
    table = rows(SCHEMA, *vectors, extra=True)
    asked = [i for i, _ in vectors if i % 50 == 0]
    got = dual_tree.top_k(table, table.filter("vec_id % 50 = 0"), k=5, pivots=8, chunk=100, group=7)
    assert {tuple(r) for r in got.collect()} == brute(vectors, asked, 5)


def test_fewer_rows_than_k_and_empty_tables(rows):
    table = rows(SCHEMA, (0, [1.0, 2.0]), (1, [1.0, 0.0]), (None, [9.0, 9.0]))
    got = dual_tree.top_k(table, table.filter("vec_id = 0"), k=5)
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 256 * 256)]
    assert dual_tree.top_k(rows(SCHEMA), rows(SCHEMA)).count() == 0
    assert dual_tree.top_k(table, table.filter("vec_id > 5")).count() == 0


def test_walk_leaves_out_node_pairs_and_stays_exact(monkeypatch):
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.normal(c * 400, 20, (400, 4)) for c in (-2, -1, 0, 1, 2)]).astype(np.int64)
    asked = data[:40]
    done = []
    real = dual_tree.products
    monkeypatch.setattr(dual_tree, "products", lambda a, b: done.append(len(a) * len(b)) or real(a, b))
    ids = np.arange(len(data))
    row, found, score = dual_tree.walk(ids[:40], asked, np.full(40, -(1 << 62)), ids, data, 3)
    assert sum(done) < 0.6 * len(asked) * len(data)
    whole = asked @ data.T
    for q in range(40):
        whole[q, q] = -(1 << 62)
        want = sorted(range(len(data)), key=lambda j: (-whole[q, j], j))[:3]
        assert found[row == q].tolist() == want and score[row == q].tolist() == [whole[q, j] for j in want]


def test_covering_radii():
    rng = np.random.default_rng(8)
    points = rng.normal(size=(2000, 6))
    todo = [dual_tree.cover_tree(points)]
    while todo:
        node = todo.pop()
        assert np.linalg.norm(points[node.rows] - node.centre, axis=1).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        todo += node.children
