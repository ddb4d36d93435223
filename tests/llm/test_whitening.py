from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest

from verispark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors):
    """n, sums, x per row, and the covariance in exact numbers."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, dims = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(dims)]
    cov = [[sum(Fraction(n * r[i] - sums[i], n) * Fraction(n * r[j] - sums[j], n) for r in x) / n for j in range(dims)] for i in range(dims)]
    return n, sums, x, cov


def test_planes_count_exactly():
    rng = np.random.default_rng(1)
    for high in (5, 3000, 1 << 40):
        y = rng.integers(0, high, size=(130, 4))
        y[:, 2] = 0  # a dimension without bits
        bits = np.array([int(v).bit_length() for v in y.max(axis=0)])
        got = {(i, j): v for i, j, v in whitening.weighted(whitening.common_bits(whitening.bit_planes(y, bits)), bits)}
        for i in range(4):
            for j in range(i, 4):
                assert got[i, j] == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j]))


def test_matches_exact_arithmetic(spark, rows):
    rng = np.random.default_rng(3)
    vectors = [[float(c) for c in v] for v in rng.normal(size=(300, 6)) * [1, 2, 3, 4, 0.5, 0.1]]
    bad = [(1000, None), (1001, []), (1002, [None] + [1.0] * 5), (1003, [math.nan] * 6), (1004, [math.inf] * 6), (1005, [1.0] * 5), (1006, [1e30] * 6)]
    table = rows(SCHEMA, *enumerate(vectors), *bad, (None, vectors[0]), (5, vectors[1]), extra=True)
    got = whitening.whiten(table.repartition(5), wanted=4).collect()
    n, sums, x, cov = brute([*vectors, vectors[0], vectors[1]])
    exact = np.array([[float(v) for v in r] for r in cov])
    values, axes = np.linalg.eigh(exact)
    assert len(got) == n * 4 and {r["n"] for r in got} == {n} and max(r["identity_error"] for r in got) < 1e-9
    per = {(r["vec_id"], r["component"]): r for r in got if r["vec_id"] not in (None, 5)}
    for i, v in enumerate(x[:300]):
        if i == 5:
            continue
        off = np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)])
        for k in range(1, 5):
            row = per[i, k]
            assert row["deviation"] == sum((n * c - s) ** 2 for c, s in zip(v, sums)) == int(row["deviation_wide"])
            assert abs(row["whitened"]) == pytest.approx(abs(off @ axes[:, -k]) / math.sqrt(values[-k]), abs=1e-9)
            assert row["explained"] == pytest.approx(values[-k] / np.trace(exact), rel=1e-9)
    # One sign for all rows.
    for k in range(1, 5):
        mine = np.array([per[i, k]["whitened"] for i in range(300) if i != 5])
        ref = np.array([np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)]) @ axes[:, -k] for i, v in enumerate(x[:300]) if i != 5])
        assert abs(np.corrcoef(mine, ref)[0, 1]) > 1 - 1e-9


def test_wide_deviation_and_no_variance(rows):
    wide = whitening.whiten(rows(SCHEMA, *[(i, [(-1.0) ** i * 2.0**40, float(i % 3)]) for i in range(40)]), wanted=2).collect()
    assert {r["component"] for r in wide} >= {1} and all(r["deviation"] is None and r["deviation_wide"] > 2**63 for r in wide)
    assert whitening.whiten(rows(SCHEMA, (1, [1.0, 2.0]), (2, [1.0, 2.0]))).count() == 0
    assert whitening.whiten(rows(SCHEMA, (1, [1.0, 2.0]))).count() == 0
    empty = whitening.whiten(rows(SCHEMA))
    assert empty.count() == 0 and empty.columns == whitening.whiten(rows(SCHEMA, (1, [1.0]), (2, [2.0]))).columns
    flat = whitening.whiten(rows(SCHEMA, *[(i, [float(i), 7.0, 2.0 * i]) for i in range(9)])).collect()
    assert {r["component"] for r in flat} == {1} and flat[0]["explained"] == pytest.approx(1.0)
