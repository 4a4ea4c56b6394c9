import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm.topk import NONE, threshold_topk, topk

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(x * 256) for x in v]
            ok[i] = min(ok.get(i, q), q)
    out = []
    for i, q in ok.items():
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok.items() if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, max(-(1 << 63), min(-s, (1 << 63) - 1))) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def run(spark, rows, k=5, size=64):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk(df, F.col("vec_id") % 50 == 0, k, rows_a_block=size).collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.2, 16).round(2 if seed else 6).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(20)]  # ties
    assert run(spark, rows) == brute(rows, 5)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (50, []), (None, [1.0, 1.0]), (7, [-3.0, 0.5]), (7, [-3.0, 0.5]), (8, [0.0, 0.0]), (100, [0.0, 0.0]), (9, [1e9, -1e9]), (150, [1e9, 3.0])]
    assert run(spark, rows) == brute(rows, 5)


def test_no_candidates(spark):
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def test_it_stops_early():
    """One row far ahead in every list: the bound falls below it after a few entries."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, (5000, 8)).astype(float)
    x[:5] = 1000
    lists = np.argsort(x, axis=0, kind="stable").T
    ids, scores, scored = threshold_topk(np.ones(8), -1, np.arange(5000), x, lists, 5, NONE)
    assert ids.tolist() == [0, 1, 2, 3, 4] and scored < 500


def test_large_components_are_exact(spark):
    rows = [(0, [3e7, 1.0]), (1, [3e7, 1.0]), (2, [3e7, -1.0])]
    assert run(spark, rows) == brute(rows, 5)
