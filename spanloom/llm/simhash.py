"""SimHash near-duplicate groups by multi-index hashing.

Fingerprints: majority bits of the XXH64 hashes of word shingles. A fingerprint of
more than 64 bits takes its further words from a mixed hash of the same shingle.

Linking: each fingerprint is cut into segments. By the pigeonhole principle two
fingerprints that differ in at most r bits agree, up to a small radius, on one
segment. Every fingerprint is stored in one table entry per segment ("home") and
looks up the Hamming ball around each of its segment values ("probe"); matches are
verified on the complete distance. Of two values that differ in one bit exactly one
has a 0 there, so a ball of radius 1 needs only the flips from 0 to 1.

Scale: only distinct fingerprints are linked, so exact copies cost one row however
many there are. Star links to a few centres of each table entry are merged first;
after that only pairs of different components are looked for, so a large group of
near copies gives links in proportion to its members, not to its pairs.

Near copies (``keep_one``): fingerprints only find candidates there, by tables keyed by
several segments each; a pair is linked by the exact Jaccard similarity of its shingles.

Defined cases: null and empty texts, and texts of white space only, have the
fingerprint zero and are linked like any other. Repeated rows and ties share a
fingerprint and a component. A null id takes part but is never a component's
smallest id unless the component has no other. Only the id and text columns are
read, so further columns of any name are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import bound_batches, checkpoint, map_batches, read

_CHUNK = 1 << 16
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).reshape(-1).view(np.uint64)


@dataclass(frozen=True)
class Segment:
    """``width`` bits from bit ``shift`` of fingerprint word ``word``, looked up to ``radius`` 0 or 1."""

    word: int
    shift: int
    width: int
    radius: int


@dataclass(frozen=True)
class Scheme:
    shingle: int
    seed: int
    words: int
    distance: int
    segments: tuple[Segment, ...]
    distinct: bool = False  # each shingle counts once, however often it is repeated
    tables: tuple[tuple[int, ...], ...] = ()  # segments that make up the key of each table, if not each one alone


#: 64 bits, 4 differing bits: radii 1, 1, 0 sum to 4 - 3 + 1, so no pair is missed.
EXACT_4 = Scheme(4, 42, 1, 4, (Segment(0, 0, 22, 1), Segment(0, 22, 21, 1), Segment(0, 43, 21, 0)))


def _parts(n: int) -> Scheme:
    """64 bits in ``n`` segments, of which 4 differing bits leave n - 4 alone: a table for each n - 4 of them, of radius 0."""
    ends = [64 * i // n for i in range(n + 1)]
    segments = tuple(Segment(0, a, b - a, 0) for a, b in zip(ends, ends[1:]))
    return Scheme(4, 42, 1, 4, segments, tables=tuple(combinations(range(n), n - 4)))


def exact_scheme(n: int) -> Scheme:
    """A scheme for ``n`` distinct fingerprints that finds all pairs of 4 differing bits; only the width of its keys depends on n.

    Keys of 21 bits in 3 tables, of 26 in 35, of 32 in 70, so that an entry holds some 8 by chance.
    """
    return EXACT_4 if n <= 1 << 24 else _parts(7) if n <= 1 << 29 else _parts(8)


#: Bits of a fingerprint for near copies, whatever the number of documents, in words; the least Jaccard similarity, as a fraction.
NEAR_WORDS, NEAR = 6, (4, 5)
#: Sets of that similarity have the cosine 2 * 0.8 / 1.8 at least, an angle of 0.1515 half turns: the share of bits that differ.
NEAR_SHARE = 0.1515
#: Candidates differ in so many of all bits at most, 0.24 of them, and in so many of their first word's, 0.39 of them: chance rejects next to none.
NEAR_DISTANCE, CHECK_WORDS, CHECK_DISTANCE = 92, 1, 25
#: Words of a set's parities.
ODD_WORDS = 4
#: Of pairs at exactly the least similarity, so many may not be looked at.
MISSED = 0.001


def _missed(tables: int, width: int) -> float:
    """The chance that a pair at the least similarity agrees in none of the tables, over how many bits differ by chance."""
    bits, out = 64 * NEAR_WORDS, 0.0
    for d in range(bits + 1):
        log = math.lgamma(bits + 1) - math.lgamma(d + 1) - math.lgamma(bits - d + 1) + d * math.log(NEAR_SHARE) + (bits - d) * math.log(1 - NEAR_SHARE)
        out += math.exp(log) * (1 - (1 - d / bits) ** width) ** tables
    return out


def near_scheme(n: int) -> Scheme:
    """A scheme to look for near copies among ``n`` documents: five words, a Jaccard similarity of 0.8 or more.

    The fingerprint and what is accepted don't depend on ``n``. Only the look-up does: the key of
    a table is made of several segments, some 6 bits less than it takes to number the documents, 12
    at least, so that a table entry holds some 128 of them at most by chance; there are as many
    tables as it takes for all but ``MISSED`` of the pairs at the least similarity to meet in one.
    """
    width = min(32, max(12, (n.bit_length() - 5) // 2 * 2))
    tables = 1
    while _missed(tables, width) > MISSED:
        tables += 1 + tables // 16
    segments = tuple(Segment(i // 32, i % 32 * 2, 2, 0) for i in range(32 * NEAR_WORDS))
    draw = random.Random(width)
    keys = tuple(tuple(sorted(draw.sample(range(len(segments)), width // 2))) for _ in range(tables))
    return Scheme(5, 42, NEAR_WORDS, NEAR_DISTANCE, segments, distinct=True, tables=keys)


def _mix(h: np.ndarray, k: int) -> np.ndarray:
    """The splitmix64 finaliser of ``h`` moved by ``k`` steps."""
    z = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set, lowest bit first."""
    lanes = _SPREAD[h.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0)  # a lane holds 255 at most
    return sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)


def shingle_hashes(text: str | None, scheme: Scheme = EXACT_4) -> np.ndarray:
    """The hashes of the text's shingles, sorted and each once if the scheme counts them so; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(scheme.shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    cuts = map(slice, starts.tolist(), ends.tolist())
    shingles = map(joined.__getitem__, cuts)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(scheme.seed)), np.uint64, len(starts))
    return np.unique(hashes) if scheme.distinct else hashes


def _majority(hashes: np.ndarray, words: int) -> list[int]:
    counts = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), _CHUNK):
        h = hashes[at : at + _CHUNK]
        for w in range(words):
            counts[w] += _bit_counts(_mix(h, w) if w else h)
    return [int(np.packbits(2 * c > len(hashes), bitorder="little").view(np.int64)[0]) for c in counts]


def fingerprint(text: str | None, scheme: Scheme = EXACT_4) -> list[int]:
    """The fingerprint's words as signed 64-bit numbers."""
    return _majority(shingle_hashes(text, scheme), scheme.words)


def fingerprints(docs: DataFrame, scheme: Scheme = EXACT_4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (array of longs), one row per row of ``docs``."""

    def rows(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "fp": pa.array([fingerprint(x, scheme) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), rows, "doc_id long, fp array<long>")


def _value(fp: Column, s: Segment) -> Column:
    return F.shiftrightunsigned(fp[s.word], s.shift).bitwiseAND(F.lit((1 << s.width) - 1))


def _key(number: int, value: Column) -> Column:
    return value.bitwiseOR(F.lit(number << 40).cast("long"))


def _tables(scheme: Scheme) -> tuple[tuple[int, ...], ...]:
    return scheme.tables or tuple((i,) for i in range(len(scheme.segments)))


def _table_value(fp: Column, scheme: Scheme, table: tuple[int, ...]) -> Column:
    """The bits of the table's segments, one behind the other."""
    out, at = F.lit(0).cast("long"), 0
    for s in (scheme.segments[i] for i in table):
        out, at = out.bitwiseOR(F.shiftleft(_value(fp, s), at)), at + s.width
    return out


def _homes(fp: Column, scheme: Scheme) -> Column:
    return F.array(*[_key(i, _table_value(fp, scheme, t)) for i, t in enumerate(_tables(scheme))])


def _ball(number: int, value: Column, width: int) -> Column:
    """The keys of all values with one 0 of ``value`` flipped to 1."""
    flips = F.array(*[F.lit(1 << b).cast("long") for b in range(width)])
    return F.transform(F.filter(flips, lambda bit: value.bitwiseAND(bit) == 0), lambda bit: _key(number, value.bitwiseOR(bit)))


def _probes(fp: Column, scheme: Scheme) -> Column:
    """The homes and, for tables of one segment of radius 1, the ball around its value."""
    return F.concat(_homes(fp, scheme), *[_ball(i, _value(fp, scheme.segments[t[0]]), scheme.segments[t[0]].width) for i, t in enumerate(_tables(scheme)) if len(t) == 1 and scheme.segments[t[0]].radius])


#: So many edges at most, 16 bytes each, are finished in one task.
LOCAL_EDGES = 200_000


def _finish(edges: DataFrame) -> DataFrame:
    """node, root by union-find in one task; only for edges of a checked number."""

    def run(batches):
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = top(a), top(b)
                up[max(a, b)] = min(a, b)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(top, nodes), pa.int64())], names=["node", "root"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """node, root of every node that has an edge (a, b) to another.

    Each round every node goes over to the neighbour of least hash if that is less than
    its own; the hash changes with the round, so the graph shrinks by a constant factor
    whatever its shape. What is left below ``local_edges`` is finished in one task.
    """
    edges = checkpoint(edges.select("a", "b").where("a <> b").distinct())
    roots, n, left = None, 0, edges.count()
    while left > local_edges:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("node"))  # noqa: E731, B023
        step = checkpoint(both.groupBy("a").agg(F.min(rank("b")).alias("best")).select(F.col("a").alias("node"), F.least(F.col("best"), rank("a"))["node"].alias("up")))
        roots = _climb(roots, step)
        up = lambda c: step.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}"))  # noqa: E731, B023
        edges = checkpoint(edges.join(up("a"), "a").join(up("b"), "b").where("up_a <> up_b").select(F.least("up_a", "up_b").alias("a"), F.greatest("up_a", "up_b").alias("b")).distinct())
        n, left = n + 1, edges.count()
    return _climb(roots, _finish(edges).withColumnRenamed("root", "up"))


def _climb(roots: DataFrame | None, step: DataFrame) -> DataFrame:
    """node, root after every root has gone up by ``step`` (node, up)."""
    if roots is None:
        return step.select("node", F.col("up").alias("root"))
    return checkpoint(roots.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")))


_CENTRES = 3
_SALTS = 32
#: A component of so many members is large: its members are never held against each other.
LARGE = 64


def _labelled(nodes: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with comp from ``first`` (node, root), those of small components and those of large ones."""
    comps = nodes.join(first, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
    large = first.groupBy(F.col("root").alias("comp")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LARGE).select("comp", F.lit(True).alias("large"))
    comps = checkpoint(comps.join(large, "comp", "left"))
    return comps.where("large is null").drop("large"), comps.where("large").drop("large")


def _several(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (key, comp and more) of both in entries that hold two components or more."""
    comps = left.select("key", "comp").union(right.select("key", "comp")).groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    keys = checkpoint(comps.where("lo <> hi").select("key"))
    return tuple(x.join(keys, "key", "left_semi") for x in (left, right))


def link(nodes: DataFrame, scheme: Scheme = EXACT_4) -> DataFrame:
    """node, root for the distinct fingerprints ``nodes`` (node long, fp).

    Matches of a lookup are verified inside the joins, which therefore give out near pairs
    only: first those with a few centres of each table entry, then those of different
    components of the first. Two members of one large component never meet there, but where
    an entry holds another large component too.
    """
    flat = lambda c: [F.col("fp")[i].alias(f"{c}{i}") for i in range(scheme.words)]
    near = _differ(scheme.words) <= scheme.distance

    keyed = nodes.select(F.col("node").alias("a"), *flat("a"), F.explode(_homes(F.col("fp"), scheme)).alias("key"))
    pick = lambda i: F.min(F.struct(F.xxhash64("a", F.lit(i)).alias("h"), F.col("a").alias("b"), *[F.col(f"a{j}").alias(f"b{j}") for j in range(scheme.words)])).alias(f"c{i}")
    centres = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[pick(i) for i in range(_CENTRES)]).where("n > 1")
    # Each centre once: the hash that chose it doesn't count.
    one = [F.col(f"c{i}").dropFields("h") for i in range(_CENTRES)]
    centres = centres.select(F.col("key").alias("key_b"), F.explode(F.array_distinct(F.array(*one))).alias("c")).select("key_b", "c.*")
    stars = keyed.join(centres, (F.col("key") == F.col("key_b")) & (F.col("a") != F.col("b")) & near).select("a", "b")
    first = checkpoint(components(stars))

    small, large = _labelled(nodes, first)
    probes = lambda d: d.select("comp", "fp", F.explode(_probes(F.col("fp"), scheme)).alias("key"))
    homes = lambda d: d.select("comp", "fp", F.explode(_homes(F.col("fp"), scheme)).alias("key"))

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        left = left.select(F.col("comp").alias("a"), *flat("a"), "key")
        right = right.select(F.col("comp").alias("b"), *flat("b"), F.col("key").alias("key_b"))
        met = left.join(right, (F.col("key") == F.col("key_b")) & (F.col("a") != F.col("b")) & near)
        return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    found = pairs(probes(small), homes(small))
    if not large.isEmpty():
        found = found.union(pairs(probes(small), homes(large))).union(pairs(probes(large), homes(small))).union(pairs(*_several(probes(large), homes(large))))
    second = components(found)
    up = second.select(F.col("node").alias("comp"), F.col("root").alias("top"))
    return small.union(large).join(up, "comp", "left").select("node", F.coalesce("top", "comp").alias("root"))


#: So many frequent fingerprints, 9 bytes each, are broadcast.
BROADCAST_FREQUENT = 100_000


def near_duplicates(docs: DataFrame, scheme: Scheme | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id (the smallest id reachable over links), one row per row of ``docs``."""
    prints = checkpoint(fingerprints(docs, scheme or EXACT_4, id_col, text_col))
    node = (lambda c: c[0]) if (scheme or EXACT_4).words == 1 else F.xxhash64  # noqa: E731  equal fingerprints, equal node
    nodes = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).select(node(F.col("fp")).alias("node"), "fp", "first_id", "n"))
    scheme = scheme or exact_scheme(nodes.count())
    roots = nodes.join(link(nodes.select("node", "fp"), scheme), "node").select("node", "root", "first_id", F.col("n").alias("copies"))
    # A large component's members are dealt out by salt; most fingerprints have a component of their own.
    least = roots.groupBy("root").agg(F.min("first_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))).repartition("root", "salt").select("root", "salt", "least")
    salted = roots.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int"))
    ids = salted.join(least.hint("merge"), ["root", "salt"], "left").select("node", F.coalesce("least", "first_id").alias("component_id"), "copies")
    # So are the rows of a fingerprint of many copies, each salt of which has a row of its own.
    own = F.when(F.col("copies") >= LARGE, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    ids = ids.select("node", "component_id", F.explode(own).alias("salt"))
    frequent = nodes.where(F.col("n") >= LARGE).select("node", F.lit(True).alias("frequent"))
    frequent = F.broadcast(frequent) if frequent.count() <= BROADCAST_FREQUENT else frequent
    rows = prints.withColumn("node", node(F.col("fp"))).join(frequent, "node", "left")
    rows = rows.withColumn("salt", F.when(F.col("frequent"), F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS))).otherwise(F.lit(0)).cast("int"))
    return rows.join(ids, ["node", "salt"]).select("doc_id", "fp", "component_id")


def alike(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Which of the other sets have the least Jaccard similarity to ``a`` or more; all sorted and not empty."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    every = np.concatenate(others)
    hits = a[np.minimum(np.searchsorted(a, every), len(a) - 1)] == every
    both = np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)
    return NEAR[1] * both >= NEAR[0] * (len(a) + sizes - both)


def _parity(hashes: np.ndarray) -> np.ndarray:
    """Whether the number of hashes in each of 64 ``ODD_WORDS`` buckets is odd, as words."""
    buckets = (hashes >> np.uint64(20)) % np.uint64(64 * ODD_WORDS)
    return np.packbits(np.bincount(buckets.astype(np.int64), minlength=64 * ODD_WORDS) & 1, bitorder="little").view(np.int64)


def _sketches(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """id, h, node (a hash of the set of shingles), fp, odd (parities), size (of the set), from id, h and text."""

    def run(batch: pa.RecordBatch) -> dict:
        sets = [shingle_hashes(x, scheme) for x in batch.column(2).to_pylist()]
        node = [xxhash.xxh64_intdigest(x.tobytes()) - (1 << 63) for x in sets]
        fp, odd = [_majority(x, scheme.words) for x in sets], [_parity(x).tolist() for x in sets]
        longs = pa.list_(pa.int64())
        return {"id": batch.column(0), "h": batch.column(1), "node": pa.array(node, pa.int64()), "fp": pa.array(fp, longs), "odd": pa.array(odd, longs), "size": pa.array(map(len, sets), pa.int64())}

    return map_batches(rows, run, "id long, h long, node long, fp array<long>, odd array<long>, size long")


_CHECKS = [f"f{i}" for i in range(CHECK_WORDS)] + [f"p{i}" for i in range(ODD_WORDS)]


def _entries(nodes: DataFrame, scheme: Scheme, tables: range, more: tuple[str, ...] = ()) -> DataFrame:
    """key, node, comp, size, the longs ``more`` and the words to check (fingerprint: f0 and so on, parities: p0 and so on): a row for each of the ``tables``."""
    bits_of = lambda t: [64 * scheme.segments[i].word + scheme.segments[i].shift + b for i in t for b in range(scheme.segments[i].width)]
    chosen = np.array([bits_of(scheme.tables[i]) for i in tables if i < len(scheme.tables)])
    powers = 1 << np.arange(chosen.shape[1], dtype=np.int64)
    numbers, plain = np.array([i for i in tables if i < len(scheme.tables)], np.int64) << 40, ("node", "comp", "size", *more)

    def run(batch: pa.RecordBatch) -> dict:
        fp, odd = (np.array(batch.column(i).to_pylist(), np.int64).reshape(-1, n) for i, n in ((0, scheme.words), (1, ODD_WORDS)))
        bits = np.unpackbits(fp.view(np.uint8), axis=1, bitorder="little")
        out = {"key": np.stack([bits[:, t] @ powers for t in chosen], axis=1) | numbers}
        out |= {x: batch.column(x).to_numpy() for x in plain}
        out |= dict(zip(_CHECKS, [*fp.T[:CHECK_WORDS], *odd.T]))
        return {x: pa.array(v.reshape(-1) if x == "key" else np.repeat(v, len(chosen)), pa.int64()) for x, v in out.items()}

    return map_batches(nodes.select("fp", "odd", *plain), run, ", ".join(f"{x} long" for x in ["key", *plain, *_CHECKS]))


def _differ(words: int, a: str = "a", b: str = "b") -> Column:
    """How many bits of a0 and so on differ from those of b0 and so on."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(words)])


def _named(x: str, of: str = "") -> list[Column]:
    """The columns of an entry under names that begin or end with ``x``."""
    plain = {"node": x, "comp": f"comp_{x}", "size": f"size_{x}"} | {c: f"{x}_{c}" for c in _CHECKS}
    return [F.col(of + c).alias(n) for c, n in plain.items()]


def _may() -> Column:
    """Whether the entries a and b may have the least similarity, and are of different components."""
    # The similarity is the smaller size over the larger one at most; of the hashes of both sets together, a ninth at most are in one alone, and each makes one parity differ at most.
    sizes = F.least("size_a", "size_b") * NEAR[1] >= F.greatest("size_a", "size_b") * NEAR[0]
    odd = _differ(ODD_WORDS, "a_p", "b_p") * (NEAR[0] + NEAR[1]) <= (F.col("size_a") + F.col("size_b")) * (NEAR[1] - NEAR[0])
    return (F.col("comp_a") != F.col("comp_b")) & sizes & odd & (_differ(CHECK_WORDS, "a_f", "b_f") <= CHECK_DISTANCE)


def _pairs(left: DataFrame, right: DataFrame, which: Column | None = None) -> DataFrame:
    """a, b, comp_a, comp_b of the entries that share a key, fulfil ``which`` and may have the least similarity."""
    left, right = (d.select(F.col("key").alias(f"key_{x}"), *_named(x)) for d, x in ((left, "a"), (right, "b")))
    which = _may() if which is None else which & _may()
    return left.join(right, (F.col("key_a") == F.col("key_b")) & which).select("a", "b", "comp_a", "comp_b").distinct()


def _centred(entries: DataFrame, order: list[Column]) -> DataFrame:
    """The same, but each entry against the first of its key by ``order`` only."""
    centre = F.first(F.struct("node", "comp", "size", *_CHECKS)).over(W.partitionBy("key").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    both = entries.withColumn("c", centre).select(*_named("a"), *_named("b", "c."))
    return both.where(_may()).select("a", "b", "comp_a", "comp_b").distinct()


def _within(pairs: DataFrame, nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs whose whole fingerprints are near enough, with their distance, far."""
    whole = lambda x: nodes.select(F.col("node").alias(x), *[F.col("fp")[i].alias(f"{x}{i}") for i in range(scheme.words)])
    both = pairs.join(whole("a"), "a").join(whole("b"), "b").withColumn("far", _differ(scheme.words))
    return both.where(F.col("far") <= scheme.distance).select("a", "b", "comp_a", "comp_b", "far")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """The ``pairs`` of the least Jaccard similarity or more. Sets are made again from the texts of those in a pair only."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = checkpoint(wanted.join(nodes, "node").select("node", "id", "h"))
    wanted = F.broadcast(wanted) if wanted.count() <= LOCAL_EDGES else wanted
    # Repeated rows have one text.
    found = texts.join(wanted, ["id", "h"]).select("node", "text").dropDuplicates(["node"])

    def make(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column(0), "hashes": pa.array([shingle_hashes(x, scheme).tobytes() for x in batch.column(1).to_pylist()], pa.binary())}

    sets = checkpoint(map_batches(found, make, "node long, hashes binary"))
    size, n = sets.agg(F.coalesce(F.sum(F.octet_length("hashes")), F.lit(0))).first()[0], pairs.count()
    blocks = max(1, -(-size // BLOCK_BYTES), math.isqrt(n // BLOCK_PAIRS) + 1)
    # A set goes once to each pair of blocks that needs it, not once to each pair of sets.
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(blocks))
    held = pairs.select((block("a") * blocks + block("b")).alias("g"), "a", "b", "comp_a", "comp_b")
    needs = held.select("g", F.col("a").alias("node")).union(held.select("g", F.col("b").alias("node"))).distinct()
    none = lambda c: F.lit(None).cast("long").alias(c)
    needs = needs.join(sets, "node").select("g", F.col("node").alias("a"), none("b"), none("comp_a"), none("comp_b"), "hashes")
    both = needs.unionByName(held.withColumn("hashes", F.lit(None).cast("binary")))
    dealt = both.repartition("g").sortWithinPartitions("g", F.col("b").isNotNull(), "a")
    bound_batches(pairs.sparkSession)
    return dealt.mapInArrow(_compare, "a long, b long")


#: Sets that are compared in one place: a pair of blocks has twice so many bytes of them, and so many pairs, on average.
BLOCK_BYTES, BLOCK_PAIRS = 1 << 22, 1 << 14


def _compare(batches):
    """The components of the similar pairs. Rows come by pair of blocks: first its sets (node, hashes), then its pairs."""
    held: dict[int, np.ndarray] = {}
    current = None
    for batch in batches:
        g, a, b, comp_a, comp_b = (batch.column(i).fill_null(0).to_numpy() for i in range(5))
        hashes, is_pair = batch.column(5), batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        runs = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (is_pair[1:] != is_pair[:-1])]) if len(g) else []
        good = np.zeros(len(g), bool)
        for at, end in zip(runs, [*runs[1:], len(g)]):
            if g[at] != current:
                current = g[at]
                held.clear()
            if not is_pair[at]:
                held[int(a[at])] = np.frombuffer(hashes[at].as_py(), np.uint64)
            else:
                good[at:end] = alike(held[int(a[at])], [held[int(x)] for x in b[at:end]])
        keep = [pa.array(x[good]) for x in (comp_a, comp_b)]
        yield pa.RecordBatch.from_arrays(keep, names=["a", "b"])


#: Tables of the two rounds in which a node is held against one centre only.
_STAR_TABLES, _HUB_TABLES = range(6), range(6, 16)


def _near_groups(nodes: DataFrame, texts: DataFrame, scheme: Scheme) -> DataFrame:
    """node, root: the components of the pairs that meet in a table and have the least similarity.

    At first each node is held against the nearest centre that it meets, then against the
    nearest hub, a centre of many, so that a large group is one component before the others,
    pairs of different components, are looked for: in a third of the tables, and in the rest,
    so that next to all of a group's members are joined before most tables are looked at.
    """
    rank = F.xxhash64("node")

    def verified(pairs: DataFrame) -> DataFrame:
        return checkpoint(_verified(checkpoint(pairs), nodes, texts, scheme))

    def star(entries: DataFrame, order: list[Column]) -> DataFrame:
        met = _within(_centred(entries, order), nodes, scheme)
        nearest = met.groupBy("a").agg(F.min(F.struct("far", F.xxhash64("b").alias("rank"), "b", "comp_a", "comp_b")).alias("c"))
        return verified(nearest.select("a", "c.b", "c.comp_a", "c.comp_b"))

    def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
        """node, root after the components ``links`` are joined."""
        up = components(links).select(F.col("node").alias("root"), F.col("root").alias("top"))
        return checkpoint(roots.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")))

    links = star(_entries(nodes.withColumn("comp", F.col("node")), scheme, _STAR_TABLES), [rank])
    roots = joined(nodes.select("node", F.col("node").alias("root")), links)
    degree = links.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    hubs = checkpoint(nodes.join(roots.withColumnRenamed("root", "comp"), "node").join(degree, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long"))))
    roots = joined(roots, star(_entries(hubs, scheme, _HUB_TABLES, ("degree",)), [F.col("degree").desc(), rank]))

    third = -(-len(scheme.tables) // 3)
    once = F.col("a") < F.col("b")
    for tables in (range(third), range(third, len(scheme.tables))):
        small, large = _labelled(nodes, roots)
        ours = _entries(small, scheme, tables)
        found = _pairs(ours, ours, once)
        if not large.isEmpty():
            theirs = _entries(large, scheme, tables)
            found = found.union(_pairs(ours, theirs)).union(_pairs(*_several(theirs, theirs), once))
        roots = joined(roots, verified(_within(found, nodes, scheme)))
    return roots


def keep_one(docs: DataFrame, scheme: Scheme | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of least id and hash of its text.

    Rows that repeat an id are told apart by their texts; of those that repeat both one is left.

    Fingerprints only find candidates; a pair is linked if the exact Jaccard similarity of the
    hashes of its shingles is 0.8 or more. A row without an id is placed by a hash of its text,
    which is less than any id.
    """
    scheme = scheme or near_scheme(docs.count())
    own = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(text_col).bitwiseOR(F.lit(-(1 << 63)))).alias(_ROW_ID)
    rows = docs.select(own, F.xxhash64(text_col).alias(_ROW_HASH), *docs.columns)
    texts = rows.select(F.col(_ROW_ID).alias("id"), F.col(_ROW_HASH).alias("h"), F.col(text_col).alias("text"))
    prints = checkpoint(_sketches(texts, scheme))
    nodes = checkpoint(prints.groupBy("node").agg(F.min(F.struct("id", "h", "fp", "odd", "size")).alias("least")).select("node", "least.*"))
    roots = _near_groups(nodes, texts, scheme)
    kept = nodes.select("node", "id", "h").join(roots, "node").groupBy("root").agg(F.min(F.struct("id", "h")).alias("least")).select("least.id", "least.h", F.lit(True).alias("stays"))
    # Most rows stay and are the only ones of their id and text. The others are joined to the texts, so that these needn't be shuffled.
    others = prints.groupBy("id", "h").agg(F.count(F.lit(1)).alias("n")).join(kept, ["id", "h"], "left").where("stays is null or n > 1")
    others = checkpoint(others.select(F.col("id").alias(_ROW_ID), F.col("h").alias(_ROW_HASH), "stays"))
    known = F.broadcast(others) if others.count() <= BROADCAST_ROWS else others
    key = [_ROW_ID, _ROW_HASH]
    first = W.partitionBy(*key).orderBy(text_col)
    repeated = rows.join(known.where("stays").select(*key), key).withColumn(_ROW_NO, F.row_number().over(first)).where(F.col(_ROW_NO) == 1)
    return rows.join(known.select(*key), key, "left_anti").select(*docs.columns).union(repeated.select(*docs.columns))


#: So many rows that go or repeat, 17 bytes each, are broadcast.
BROADCAST_ROWS = 500_000
_ROW_ID, _ROW_HASH, _ROW_NO = "__row_id", "__row_hash", "__row_no"


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_neardup": op8_simhash_neardup}
ORACLES: dict[str, str] = {}
