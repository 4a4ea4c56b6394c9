"""Exact top-k search by the threshold algorithm over sorted per-dimension lists.

Vectors become integers, floor(256 x). Rows are dealt into blocks of bounded size by a
hash of their id; a block's index holds its matrix and, for every dimension, the list of
its rows sorted by that component. A query reads the lists from the end that its sign
prefers, all to the same depth, scores each row on first sight, and stops when the
threshold, the score that a row with the last seen value in every list would have, is
less than its k-th best score. Rows that tie with the k-th best are still looked for, as
a smaller id wins.

Scale: queries are a stated set, held against all rows in blocks: a row of the join is
one block of queries and one block of the index, both of bounded size, and no pair of
vectors is ever a row. A first pass over each query's own block gives it a bound that
lets the other blocks stop early. Blocks give back k rows a query at most.

Defined cases: vectors that are null or hold null, NaN or infinite components take no
part, nor do rows without an id. Vectors are held against those of the same length.
Rows that repeat an id count once, with the least of their vectors. A query with fewer
than k candidates gets them all; scores beyond 64 bits are returned as the
limit of 64 bits; with none, no row. Ties go to the smaller id. An empty
table gives no rows. Only the id and vector columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import checkpoint, read

ROWS_A_BLOCK = 4096
QUERIES_A_BLOCK = 4096
START_DEPTH = 4
NONE = -(1 << 63)


def quantised(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of longs), one row an id."""
    v = F.col(vector_col)
    good = v.isNotNull() & F.col(id_col).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * 256).cast("long"))
    return rows.where(good).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def _best_first(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:  # lexsort has no order for Python's integers
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])), np.int64)
    return np.lexsort((ids, -scores))


def threshold_topk(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, lists: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ids and scores of the k best rows that reach ``bound``, and how many rows were scored.

    x: the rows' components; lists: for each dimension the row numbers by component,
    ascending; ids ascending.
    """
    n = len(x)
    rising, falling = np.flatnonzero(q > 0), np.flatnonzero(q < 0)  # read from the end, from the start
    seen = ids == own
    best_ids, best = np.empty(0, np.int64), np.empty(0, x.dtype)
    depth, last, scored = START_DEPTH, 0, 0
    while True:
        # Once most rows have been met, or for a query of zeros, whose rows all score 0, the rest is as soon scored as sought.
        if not len(rising) + len(falling) or 2 * scored > n or depth >= n:
            fresh = np.flatnonzero(~seen)
            got = (x @ q)[fresh]
        else:
            met = np.zeros(n, bool)
            met[lists[rising, n - depth : n - last]] = True
            met[lists[falling, last:depth]] = True
            fresh = np.flatnonzero(met & ~seen)
            got = x[fresh] @ q
        seen[fresh] = True
        scored += len(fresh)
        keep = got >= bound
        best_ids, best = np.concatenate((best_ids, ids[fresh[keep]])), np.concatenate((best, got[keep]))
        if len(best) > k:
            order = _best_first(best_ids, best)[:k]
            best_ids, best = best_ids[order], best[order]
        if seen.all():
            break
        threshold = (q[rising] * x[lists[rising, n - depth], rising]).sum() + (q[falling] * x[lists[falling, depth - 1], falling]).sum()
        if threshold < bound or (len(best) >= k and threshold < best.min()):
            break
        last, depth = depth, depth * 4
    order = _best_first(best_ids, best)
    return best_ids[order], best[order], scored


def _packed(x: np.ndarray) -> bytes:
    """The numbers in the fewest of 2, 4 or 8 bytes each that hold them all."""
    top = max(-int(x.min(initial=0)), int(x.max(initial=0)))
    return np.ascontiguousarray(x.astype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)).tobytes()


def _unpacked(raw: bytes, n: int, m: int) -> np.ndarray:
    return np.frombuffer(raw, f"i{len(raw) // (n * m)}" if n * m else np.int64).reshape(n, m)


def _blocks(rows: DataFrame, n: int, name: str, lists: bool) -> DataFrame:
    """dim, one of ``n`` block numbers, and the block's ids, components and sorted lists as bytes."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        dim = group.column("dim")[0].as_py()
        x = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), dim)[order]
        out = {"dim": pa.array([dim], pa.int32()), name: group.column(name)[:1].combine_chunks(), "ids": [ids[order].tobytes()], "x": [_packed(x)]}
        if lists:
            out["lists"] = [_packed(np.argsort(x, axis=0, kind="stable").T)]
        return pa.table(out)

    dealt = rows.withColumn("dim", F.size("v")).withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))
    return checkpoint(dealt.groupBy("dim", name).applyInArrow(run, f"dim int, {name} int, ids binary, x binary" + ", lists binary" * lists))


def _numbers(*arrays: np.ndarray) -> list[np.ndarray]:
    """Both as floats if every sum of products is exact in them, else as Python integers."""
    x, q = ([max(-int(a.min(initial=0)), int(a.max(initial=0))) for a in arrays])
    kind = np.float64 if x * q * max(1, arrays[0].shape[1]) < 1 << 53 else object
    return [a.astype(kind) for a in arrays]


def _held(asked: DataFrame, index: DataFrame, k: int, only_bounds: bool) -> DataFrame:
    """Blocks of queries, each with the number of the block it is held against, against the index.

    query_id, vec_id, score of the k best of the block; or dim, part and each query's k-th best score.
    """
    keys = ["dim", "block", "part"]
    schema = "dim int, part int, bounds binary" if only_bounds else "query_id long, vec_id long, score long"

    def run(queries: pa.Table, block: pa.Table) -> pa.Table:
        if not queries.num_rows or not block.num_rows:
            return pa.table({f.split()[0]: pa.array([], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[f.split()[1]]) for f in schema.split(", ")})
        of = lambda t, c: t.column(c)[0].as_py()
        dim, ids, q_ids = of(block, "dim"), np.frombuffer(of(block, "ids"), np.int64), np.frombuffer(of(queries, "q_ids"), np.int64)
        x, q = _numbers(_unpacked(of(block, "x"), len(ids), dim), _unpacked(of(queries, "q_x"), len(q_ids), dim))
        bounds = np.frombuffer(of(queries, "bounds"), np.int64) if of(queries, "bounds") else np.full(len(q_ids), NONE)
        lists = _unpacked(of(block, "lists"), dim, len(ids))
        found = [threshold_topk(q[i], q_ids[i], ids, x, lists, k, int(bounds[i]))[:2] for i in range(len(q_ids))]
        if only_bounds:
            kth = np.array([max(NONE, min(int(s[-1]), -NONE - 1)) if len(s) == k else NONE for _, s in found], np.int64)
            return pa.table({"dim": pa.array([dim], pa.int32()), "part": pa.array([of(queries, "part")], pa.int32()), "bounds": [kth.tobytes()]})
        scores = [max(NONE, min(int(s), -NONE - 1)) for _, f in found for s in f]
        return pa.table({"query_id": np.repeat(q_ids, [len(f) for f, _ in found]), "vec_id": np.concatenate([f for f, _ in found]), "score": pa.array(scores, pa.int64())})

    placed = index.join(asked.select(*keys), ["dim", "block"])  # a copy of the block for each block of queries
    placed = placed.select(*[F.col(c).alias(c) for c in placed.columns])
    return asked.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInArrow(run, schema)


def topk(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score. ``is_query`` is a condition on vec_id."""
    vectors = checkpoint(quantised(rows, id_col, vector_col))
    queries = vectors.where(is_query)
    n, m = (max(1, -(-df.count() // size)) for df, size in ((vectors, rows_a_block), (queries, QUERIES_A_BLOCK)))
    index = _blocks(vectors, n, "block", lists=True)
    asked = _blocks(queries, m, "part", lists=False).withColumnsRenamed({"ids": "q_ids", "x": "q_x"})
    bounds = _held(asked.withColumn("block", F.pmod("part", F.lit(n))).withColumn("bounds", F.lit(None).cast("binary")), index, k, only_bounds=True)
    every = asked.join(bounds, ["dim", "part"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    found = _held(every, index, k, only_bounds=False)
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

QUERIES = {"op1_topk": op1_topk}
ORACLES = {"op1_topk": ORACLE}
