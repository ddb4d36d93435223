"""Cases of the fourth round's findings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from verispark.llm import dual_tree
from verispark.operators import vectors as vc


def test_block_search_copies_no_vector_for_a_visit(spark, monkeypatch):
    """each row is written once, in even partitions, however many queries visit its cell."""
    monkeypatch.setattr(vc, "PART_ROWS", 100)
    vectors = np.random.default_rng(4).standard_normal((900, 6)).round(3)
    vectors[300:] = vectors[300]  # one big cell
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "chunk_id long, embedding array<double>").repartition(3)
    found = vc.knn_search(corpus, corpus.withColumnRenamed("chunk_id", "query_id"), 3, strategy="blocks")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan and "FlatMapCoGroupsInPandas" not in plan
    gaps = np.linalg.norm(vectors[:, None] - vectors[None], axis=2).round(vc.DIST_DIGITS)
    near = [sorted(range(900), key=lambda j, row=row: (row[j], j))[:3] for row in gaps]
    assert {(r.query_id, r["rank"], r.doc_id) for r in found.collect()} == {(i, n + 1, j) for i, ids in enumerate(near) for n, j in enumerate(ids)}
    placed = corpus.select(F.col("chunk_id").alias("doc_id"), F.col("embedding").alias("vec"), F.lit(7).alias("cell"))
    blocks = vc._blocks(placed, "doc_id", 900).select(F.spark_partition_id().alias("part"), "ids")
    rows = [r.n for r in blocks.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).collect()]
    assert sum(rows) == 900 and len(rows) >= 8 and max(rows) < 250


def test_walk_meets_many_leaves_in_few_products(monkeypatch):
    """where nothing can be ruled out, small leaves are not met one by one."""
    rng = np.random.default_rng(9)
    data = (100 * rng.standard_normal((3000, 16))).astype(np.int64)
    data[2000:2100] = data[7]  # ties by id
    calls, real = [], dual_tree.products
    monkeypatch.setattr(dual_tree, "products", lambda a, b: calls.append(len(a)) or real(a, b))
    ids = rng.permutation(3000) * 3
    row, found, score = dual_tree.walk(ids[:600], data[:600], np.full(600, -(1 << 62)), ids, data, 5)
    assert len(calls) <= 8 and max(calls) <= dual_tree.GROUP
    whole = data[:600] @ data.T
    whole[np.arange(600), np.arange(600)] = -(1 << 62)
    for q in range(600):
        want = np.lexsort((ids, -whole[q]))[:5]
        assert found[row == q].tolist() == ids[want].tolist() and score[row == q].tolist() == whole[q][want].tolist()


def test_bounds_of_many_nodes_and_trees_far_from_the_origin():
    """bounds taken together are those of the pairs, and rounding at large offsets neither loses rows nor stops a split."""
    rng = np.random.default_rng(10)
    nodes = [dual_tree.Node(rng.standard_normal(5) * 50, float(r), np.arange(1)) for r in range(6)]
    want = [[dual_tree.bound(a, b) for b in nodes[2:]] for a in nodes[:2]]
    assert np.allclose(dual_tree.bounds(nodes[:2], nodes[2:]), want, rtol=1e-12)
    points = 1e9 + rng.integers(0, 3, (1000, 4)).astype(np.float64)
    todo = [dual_tree.cover_tree(points)]
    while todo:
        node = todo.pop()
        assert np.linalg.norm(points[node.rows] - node.centre, axis=1).max() <= node.radius
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
        todo += node.children


def test_vectors_of_different_lengths_become_rows():
    vectors = pd.Series([[1.5, -0.001], None, [], [2.0], [math.inf, 1.0, 1.0], [math.nan], np.array([0.25, 0.5], np.float32)])
    usable, rows = dual_tree.to_integers(vectors)
    assert usable.tolist() == [True, False, False, True, False, False, True]
    assert rows.tolist() == [[384, -1], [512, 0], [64, 128]]
    packed = pd.Series([r.tobytes() for r in rows[:2]] + [np.array([7, 8, 9]).tobytes()])
    assert dual_tree.unpack(packed, 3).tolist() == [[384, -1, 0], [512, 0, 0], [7, 8, 9]]
