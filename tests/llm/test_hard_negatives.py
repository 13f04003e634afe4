"""Hard negatives against brute force over whole numbers."""

import math

import numpy as np
import pytest

from scanloom.llm import hard_negatives
from scanloom.llm import queries as llm

SCHEMA = "vec_id long, embedding array<float>, label int, row int, key string, slots int"


def contract(rows, anchor=lambda i: i % 100 == 0):
    """The rows as the contract words them; rows are (vec_id, vector, label)."""
    part = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, (i, v, label) in enumerate(part):
        if not anchor(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for m, (j, w, other) in enumerate(part) if m != k and len(w) == len(v)]
        scored.sort()
        for s, j, _ in [x for x in scored if x[2] == label][:5]:
            hard = [(t, n) for t, n, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s][:10]
            out += [(i, j, r, n, -s, -t) for r, (t, n) in enumerate(hard, 1)]
    return sorted(out)


def vectors(rng, n, d, centres=6, noise=0.4):
    x = rng.normal(size=(centres, d))[rng.integers(0, centres, n)] + noise * rng.normal(size=(n, d))
    return (x / np.maximum(np.sqrt((x * x).sum(1)), 1e-9)[:, None]).astype(np.float32).astype(float).tolist()


def mined(spark, rows, tmp_path, **limits):
    table = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    if not limits:
        table.write.parquet(f"{tmp_path}/embeddings.parquet")
        return sorted(map(tuple, llm.op13_hard_negatives(spark, str(tmp_path)).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))
    label = llm.F.when(llm.F.col("vec_id") % 7 == 0, (llm.F.col("label") + 1) % 10).otherwise(llm.F.col("label"))
    found = hard_negatives.mine(table.withColumn("label", label), llm.F.col("vec_id") % 100 == 0, **limits)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("limits", [{}, {"block_rows": 40, "group_rows": 3, "sample": 400}])
def test_query_equals_brute_force(spark, tmp_path, limits):
    rng = np.random.default_rng(1)
    x = vectors(rng, 1500, 12)
    rows = [(int(i * 4), v, int(k)) for i, (v, k) in enumerate(zip(x, rng.integers(0, 10, 1500)))]
    # copies and ties: equal vectors of one label and of others, under ids of their own
    rows += [(10_000 + i, x[3], i % 3) for i in range(300)]
    assert mined(spark, rows, tmp_path, **limits) == contract(rows)


@pytest.mark.parametrize("limits", [{}, {"block_rows": 5, "group_rows": 2, "sample": 60}])
def test_odd_rows(spark, tmp_path, limits):
    rng = np.random.default_rng(2)
    x = vectors(rng, 60, 4, 2)
    rows = [(i * 10, v, i % 2) for i, v in enumerate(x)]
    rows += [(None, x[0], 1), (700, None, 1), (800, x[1], None), (900, [], 1), (910, [], 1), (903, [], 2), (1000, [None, 1.0, 1.0, 1.0], 1), (1100, [float("nan")] * 4, 1), (1200, [float("inf")] * 4, 0)]
    # other dimensions, zero vectors, a lonely label, repeated rows and large components
    rows += [(1300, [0.5, 0.25], 1), (1310, [0.5, 0.5], 1), (1320, [0.1, 0.5], 2), (1400, [0.0] * 4, 1), (1500, x[5], 9), (100, x[10], 0), (100, x[10], 0), (1600, [30000.0, -20000.0, 1.5, 0.0], 1), (1601, [29000.0, 20000.0, 1.5, 0.0], 1), (1602, [20000.0, 0.0, 1.5, 0.0], 0)]
    assert mined(spark, rows, tmp_path, **limits) == contract(rows)


def test_empty_table_and_types(spark):
    none = spark.createDataFrame([], SCHEMA)
    found = hard_negatives.mine(none, llm.F.col("vec_id") % 100 == 0)
    assert found.count() == 0
    assert dict(found.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}


def test_intervals_hold_all_products_and_prune():
    rng = np.random.default_rng(3)
    x = np.floor(256 * np.array(vectors(rng, 3000, 16, 30, 0.05)))
    a, b = x[:200], x[200:]
    trees = []
    for rows, lowest in ((a, 16), (b, 32)):
        order, depth = hard_negatives.tree_order(rows, lowest)
        trees.append(hard_negatives.Balls(rows[order], depth))
    anchors, block = trees
    score = anchors.x @ block.x.T
    least = np.sort(score, 1)[:, -5]
    i, j = hard_negatives.node_pairs(anchors, block, least, np.full(len(a), np.inf))
    ga, gb = anchors.levels[-1][0], block.levels[-1][0]
    held = np.zeros(score.shape, bool)
    for p, q in zip(i, j):
        held[ga[p] : ga[p + 1], gb[q] : gb[q + 1]] = True
    assert held[score >= least[:, None]].all()
    assert held.mean() < 0.75
