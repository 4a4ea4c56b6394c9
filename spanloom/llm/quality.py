"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over quantile bins, and a few pairs of features
have a table over the product of coarser bins. Training goes round the features again
and again; each visit fits a shallow tree of one feature's bins (two splits) to the
logistic loss and adds a small part of its leaves to that feature's table. The pairs that
explain most of what is left are then boosted in the same way with one split on each of
their features. A score is the sigmoid of a sum of table entries, a vector addition a
feature for a whole batch.

Training: ``SAMPLE_ROWS`` labelled documents at most, those of least id hash; every text
is read whole, both in training and in scoring.

Defined cases: a null text counts as empty; an empty text has all features 0 and gets a
score like any other. A null quality is no label; labels of a repeated doc_id are
averaged, half or more counting as 1. Without labelled rows, or with one class alone,
all scores are the share of label 1 (0.5 without any). Repeated rows are scored alike.
Columns beside the named ones are ignored, and passed on as they are by ``keep_good``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import bound_batches, crc32_mod, map_batches, read, slices

SAMPLE_ROWS = 20_000
BINS = 32
PAIR_BINS = 8
PAIRS = 10
ROUNDS = 120
RATE = 0.15
LEAF_ROWS = 8

FEATURES = (
    "log_bytes", "word_bytes", "upper_share", "symbol_share", "digit_share", "stop_share", "shout_share", "odd_share", "non_ascii_share",
    "distinct_words", "top_word_share", "line_words", "repeated_lines", "packed_share", "symbol_word_share", "capital_word_share", "bar_share", "control_share",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_UPPER, _LOWER = _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
_CLASSES = np.stack([
    _UPPER, _UPPER + _LOWER, _class(bytes(range(48, 58))), _class(b".,;:"), _class(b"!?"), _class(b"#$%&*+=<>@\\^_`{|}~"),
    _class(bytes(range(128, 256))), _class(bytes(x for x in range(33, 127) if not chr(x).isalnum())), _class(b"|"), _class(bytes([*range(9), *range(14, 32), 127])),
])


def features(text: str | None) -> np.ndarray:
    """The values of ``FEATURES``."""
    raw = (text or "").encode()
    out = np.zeros(len(FEATURES))
    words = raw.split()
    if not words:
        return out
    n, w = len(raw), len(words)
    upper, letters, digits, stops, shouts, odd, wide, symbols, bars, control = _CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    counted = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    tails = Counter(x[-1] for x in words)
    marked = sum(c for x, c in tails.items() if x < 128 and not chr(x).isalnum() and x not in b".,;:)\"'")
    capital = sum(c for x, c in counted.items() if len(x) > 1 and x.isupper())
    return np.array([
        np.log1p(n), (n - w) / w, upper / max(letters, 1), symbols / n, digits / n, stops / w, shouts / w, odd / n, wide / n,
        len(counted) / w, max(counted.values()) / w, w / len(lines), 1 - len(set(lines)) / len(lines), len(zlib.compress(raw, 1)) / n, marked / w, capital / w, bars / w, control / n,
    ])


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, j], side="right")]
        if self.pairs:
            coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for j in {i for p in self.pairs for i in p}}
            for (a, b), table in zip(self.pairs, self.pair_tables):
                out += table[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[int, float]:
    """The bin to cut in front of, and the gain, of the best cut of a row of bins; 0 if there is none."""
    gs, hs, ns = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    ok = (ns >= LEAF_ROWS) & (n.sum() - ns >= LEAF_ROWS)
    if not ok.any():
        return 0, 0.0
    gain = np.where(ok, gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1), -np.inf)
    best = int(gain.argmax())
    return best + 1, float(gain[best])


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leaf values, by bin, of a tree of two cuts at most."""
    cut, gain = _split(g, h, n)
    cuts = [0, len(g)]
    if gain > 0:
        halves = [(0, cut), (cut, len(g))]
        more = [_split(g[a:b], h[a:b], n[a:b]) for a, b in halves]
        cuts.append(cut)
        side = int(more[1][1] > more[0][1])
        if more[side][1] > 0:
            cuts.append(halves[side][0] + more[side][0])
    cuts.sort()
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leaf values of the best tree that cuts one axis of a table and each side along the other."""
    best, best_gain = np.zeros_like(g), 0.0
    for turned in (False, True):
        a, b, c = (x.T if turned else x for x in (g, h, n))
        for cut in range(1, len(a)):
            gain, leaves = 0.0, []
            for part in (slice(0, cut), slice(cut, len(a))):
                at, more = _split(a[part].sum(0), b[part].sum(0), c[part].sum(0))
                at = at if more > 0 else 0
                for piece in (slice(0, at), slice(at, a.shape[1])) if at else (slice(0, a.shape[1]),):
                    gs, hs = a[part, piece].sum(), b[part, piece].sum()
                    leaves.append((part, piece, gs / (hs + 1)))
                    gain += gs**2 / (hs + 1)
            if gain > best_gain:
                out = np.zeros_like(a)
                for part, piece, v in leaves:
                    out[part, piece] = v
                best, best_gain = (out.T if turned else out), gain
    return best


def train(x: np.ndarray, y: np.ndarray) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Model(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), [], [])
    m = Model(float(np.log(share / (1 - share))), [_edges(x[:, j], BINS) for j in range(x.shape[1])], [])
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, m.tables)]
    f = np.full(len(y), m.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, table in enumerate(m.tables):
            if len(table) > 1:
                g, h = slopes()
                step = RATE * _tree(np.bincount(bins[j], g, len(table)), np.bincount(bins[j], h, len(table)), rows[j])
                table += step
                f += step[bins[j]]

    m.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.pair_edges)]
    sizes = [len(e) + 1 for e in m.pair_edges]

    def grid(a: int, b: int, v: np.ndarray | None) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    gains = {}
    for a, b in combinations(range(x.shape[1]), 2):
        if sizes[a] > 1 and sizes[b] > 1:
            at_g, at_h = grid(a, b, g), grid(a, b, h)
            gains[a, b] = float((_pair_tree(at_g, at_h, grid(a, b, None)) * at_g).sum())
    m.pairs = sorted(gains, key=lambda p: (-gains[p], p))[:PAIRS]
    m.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in m.pairs]
    for _ in range(ROUNDS // 2):
        for (a, b), table in zip(m.pairs, m.pair_tables):
            g, h = slopes()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h), grid(a, b, None))
            table += step
            f += step[coarse[a], coarse[b]]
    return m


def learned(docs: DataFrame, labels: DataFrame, may_learn: Column) -> Model:
    """A model of the labelled documents for whose doc_id ``may_learn`` holds."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # of SAMPLE_ROWS rows at most

    def rows(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "y": batch.column(2), "x": pa.array([features(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))}

    found = map_batches(texts, rows, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    order = np.lexsort((*x.T, found["doc_id"].to_numpy()))
    return train(x[order], found["y"].to_numpy(float)[order])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "score": pa.array(_scores(shared.value, batch.column(1)), pa.float64())}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, "doc_id long, score double")


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    return model.score(np.array([features(t) for t in column.to_pylist()]).reshape(-1, len(FEATURES)))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array(_scores(shared.value, batch.column(at)) >= least))

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def may_learn() -> Column:
    return crc32_mod(F.col("doc_id"), 3) != 1


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, learned(docs, read(spark, sf_dir, "labels"), may_learn()))
    return out.select("doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_quality": op5_quality}
ORACLES: dict[str, str] = {}
