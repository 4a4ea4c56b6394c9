import numpy as np
import pytest

from spanloom.llm import quality as Q


def test_tables_learn_a_step_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(Q.FEATURES)))
    step, cross = x[:, 3] > 0.6, (x[:, 1] > 0.5) != (x[:, 2] > 0.5)
    assert ((Q.train(x[:3000], step[:3000].astype(float)).score(x[3000:]) > 0.5) == step[3000:]).mean() > 0.97  # a bin of 32 lies across the step
    m = Q.train(x[:3000], cross[:3000].astype(float))
    assert (1, 2) in m.pairs and ((m.score(x[3000:]) > 0.5) == cross[3000:]).mean() > 0.9


def test_score_is_a_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.random((500, len(Q.FEATURES)))
    m = Q.train(x, (x[:, 0] + x[:, 1] > 1).astype(float))
    row = x[7]
    total = m.base + sum(t[np.searchsorted(e, row[j], side="right")] for j, (e, t) in enumerate(zip(m.edges, m.tables)))
    total += sum(t[np.searchsorted(m.pair_edges[a], row[a], side="right"), np.searchsorted(m.pair_edges[b], row[b], side="right")] for (a, b), t in zip(m.pairs, m.pair_tables))
    assert m.score(x)[7] == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("y", [[], [1.0] * 3, [0.0] * 3])
def test_one_class_or_none(y):
    m = Q.train(np.zeros((len(y), len(Q.FEATURES))), np.array(y))
    assert m.score(np.zeros((1, len(Q.FEATURES))))[0] == pytest.approx(y[0] if y else 0.5, abs=1e-6)


@pytest.mark.parametrize("text", [None, "", " \n", "a", "😀", "word " * 50_000, "\u0000"])
def test_features_are_finite(text):
    f = Q.features(text)
    assert f.shape == (len(Q.FEATURES),) and np.isfinite(f).all()


def test_held_out_accuracy(spark, sf_dir):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [r for r in Q.op5_quality(spark, sf_dir).collect() if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held) > 0


def test_labels_of_held_out_rows_are_not_learned(spark, table):
    import zlib

    from oddrows import DOCUMENTS

    rows = [(i, "fine words here" if i % 2 else "BAD!! BAD!!", "en", "s", 1) for i in range(300)]
    labels = [(i, int(i % 2 if zlib.crc32(str(i).encode()) % 3 != 1 else 1 - i % 2), 0) for i in range(300)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)]
    table("labels", labels, "doc_id long, quality int, toxic int")
    got = Q.op5_quality(spark, table("documents", rows, DOCUMENTS)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got)


def test_odd_rows(spark, odd, table):
    from oddrows import ODD

    table("labels", [], "doc_id long, quality int, toxic int")
    rows = Q.op5_quality(spark, odd).collect()
    assert len(rows) == len(ODD) and {r.score for r in rows} == {0.5}


def test_query_against_loops(spark, sf_dir):
    """Every score from the tables one row at a time, with bins found by bisection."""
    import math
    import zlib
    from bisect import bisect_right

    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    m = Q.learned(docs, labels, Q.may_learn())
    assert len(m.pairs) == Q.PAIRS and all(len(t) == len(e) + 1 for e, t in zip(m.edges, m.tables))
    got = {r.doc_id: r for r in Q.op5_quality(spark, sf_dir).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = [float(v) for v in Q.features(r.text)]
        margin = m.base + sum(t[bisect_right(e.tolist(), v)] for e, t, v in zip(m.edges, m.tables, x))
        margin += sum(t[bisect_right(m.pair_edges[a].tolist(), x[a]), bisect_right(m.pair_edges[b].tolist(), x[b])] for (a, b), t in zip(m.pairs, m.pair_tables))
        want = 1 / (1 + math.exp(-max(-30, min(30, margin))))
        assert got[r.doc_id].score == pytest.approx(want, abs=1e-9) and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)
        assert got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_first_cut_is_the_best_of_all():
    """The cut of a feature's bins with the largest gain, from all cuts that leave enough rows."""
    draw = np.random.default_rng(5)
    for _ in range(50):
        k = int(draw.integers(2, 12))
        g, h, n = draw.normal(size=k), draw.random(k) + 0.1, draw.integers(0, 20, k)
        part = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
        gains = {c: part(0, c) + part(c, k) - part(0, k) for c in range(1, k) if min(n[:c].sum(), n[c:].sum()) >= Q.LEAF_ROWS}
        cut, gain = Q._split(g, h, n)
        assert gain == pytest.approx(max(gains.values(), default=0.0)) and (cut in gains if gains else cut == 0)
