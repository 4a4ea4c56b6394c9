"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

1. Targets. Sources in code point order (null last) weigh 1, 2, 3, repeating, and share
   all words; a target stops at ``MAX_EPOCHS`` times its source's words, the excess going
   to the others by weight. The limit of that resharing is a water level: with sources
   ordered by cap / weight, the first k are full and the rest get weight times the level.
2. Blocks. A source's documents, in the order of md5(doc_id), form a stream of words cut
   into blocks of ``BLOCK`` words (the last may be shorter).
3. Schedule. Slot i of the mix has the van der Corput point of i (its bits reversed); the
   cumulative shares of the sources map it to a source. A source's slots are ranked, and
   its j-th slot takes block j modulo its number of blocks. A slot beyond the source's
   target is void, the last one is cut to the target, and the few slots by which the
   point set falls short of a share stand at the end, without a number.
4. Places. ``taken`` says where in the mix a document first stands (``first_slot``; -1 if
   at the end or nowhere) and in how many slots (``slots``). ``mixed_rows`` puts each copy
   of a document at the first slot its pass over the source takes of it, and writes the mix
   in slot order, in shards of equally many slots.

Scale: no window runs over a whole source. Stream positions and slot ranks are made in
two levels, inside buckets (1/4096 of the md5 range) or chunks of slots, then over the
buckets' totals. Blocks join slots on (source, block), at most ``BLOCK`` documents each.
Only the source table, one row a source, is ordered as a whole.

Defined cases: a null or white text has size 0, takes 0 and stands in no slot. A null doc_id is placed like
the empty id. Repeated rows are separate rows of the stream; rows equal in doc_id, source
and size are interchangeable there. Columns other than doc_id, source and text are not
read. An empty table gives no rows; if all sizes are 0, all targets are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.common import WORD_RE, checkpoint, read

BLOCK = 64
MAX_EPOCHS = 3
CHUNK = 1 << 14
POINT_BITS = 52
CELL_BITS = 12
#: Up to so many sources their shares are broadcast; beyond that they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")


def _source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, k (a name of the source that is never null), place, bucket."""
    d = docs.select("doc_id", "source", _size().alias("size"), _source_key().alias("k"))
    d = d.withColumn("place", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return d.withColumn("bucket", F.substring("place", 1, 3))


def targets(sizes: DataFrame) -> DataFrame:
    """One row a source: its words, target, blocks and slots, and its band lo to hi of the points."""
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("k", "source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * MAX_EPOCHS)

    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    open_words = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("level", open_words / open_weight)
    # The first source that the level doesn't fill has the level of all that aren't full.
    s = s.withColumn("level", F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")))

    some = F.col("source_size") > 0
    s = s.withColumn("words", F.least("cap", F.rint("target").cast("long"))).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    s = s.withColumn("rest", F.when(some, F.col("words") % F.col("source_size")).otherwise(F.lit(0).cast("long")))
    s = s.withColumn("slots", F.when(some, F.floor(F.col("words") / F.col("source_size")) * F.col("blocks") + F.ceil(F.col("rest") / BLOCK)).otherwise(F.lit(0).cast("long")))
    s = s.withColumn("upto", F.sum("slots").over(by_name.rowsBetween(W.unboundedPreceding, 0))).withColumn("all_slots", F.sum("slots").over(whole))
    edge = lambda c: F.floor(c / F.col("all_slots") * float(1 << POINT_BITS)).cast("long")
    return s.withColumn("lo", edge(F.col("upto") - F.col("slots"))).withColumn("hi", edge(F.col("upto")))


def schedule(sources: DataFrame) -> DataFrame:
    """k, slot (place in the mix; null at its end), rank (from 0 in the source), block, round (pass over the source), upto (words taken of it)."""
    live = sources.where("slots > 0").select("k", "source_size", "blocks", "rest", "slots", "lo", "hi", "all_slots")
    chunks = live.agg(F.max("all_slots").alias("n")).where("n > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))).alias("chunk"), "n")
    first = F.col("chunk") * CHUNK
    # As many tasks as asked for: the few rows of chunks would else be put into one before explode.
    spread = chunks.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk")
    slots = spread.select("chunk", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("n")) - 1)).alias("slot"))
    slots = slots.withColumn("point", F.conv(F.reverse(F.lpad(F.bin("slot"), POINT_BITS, "0")), 2, 10).cast("long"))
    slots = slots.withColumn("cell", F.shiftright("point", POINT_BITS - CELL_BITS))
    cell = lambda c: F.shiftright(c, POINT_BITS - CELL_BITS)
    bands = live.where("lo < hi").select("k", "lo", "hi", "blocks", "rest", "slots", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    # Merge joins by hint: the planner sees the size before explode, and would broadcast all slots.
    hit = slots.join(bands.hint("merge"), "cell").where("point >= lo and point < hi")
    hit = checkpoint(hit.select("k", "chunk", "slot", "blocks", "rest", "slots"))

    # The windows leave their rows dealt by k; dealt anew, the joins don't bring a whole source to one task.
    counts = hit.groupBy("k", "chunk").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("skipped", F.sum("n").over(W.partitionBy("k").orderBy("chunk").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    ranked = hit.withColumn("rank", F.row_number().over(W.partitionBy("k", "chunk").orderBy("slot")) - 1).join(counts.select("k", "chunk", "skipped").repartition("k", "chunk").hint("merge"), ["k", "chunk"])
    ranked = ranked.select("k", "slot", (F.col("rank") + F.col("skipped")).alias("rank"), "blocks", "rest", "slots")
    late = live.join(counts.groupBy("k").agg(F.sum("n").alias("have")), "k", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    late = late.where("have < slots").select("k", F.lit(None).cast("long").alias("slot"), F.explode(F.sequence("have", F.col("slots") - 1)).alias("rank"), "blocks", "rest", "slots")

    s = ranked.unionByName(late).where("rank < slots")
    last = (F.col("rank") == F.col("slots") - 1) & (F.col("rest") > 0)
    s = s.withColumn("block", F.col("rank") % F.col("blocks"))
    return s.select("k", "slot", "rank", "block", F.floor(F.col("rank") / F.col("blocks")).alias("round"), F.when(last, F.col("rest") - F.col("block") * BLOCK).otherwise(F.lit(BLOCK).cast("long")).alias("upto"))


def stream(sizes: DataFrame) -> DataFrame:
    """``sizes`` with off, the words before each document in its source's stream."""
    here = W.partitionBy("k", "bucket").orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    totals = sizes.groupBy("k", "bucket").agg(F.sum("size").alias("n"))
    totals = totals.withColumn("skipped", F.sum("n").over(W.partitionBy("k").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    d = sizes.withColumn("off", F.sum("size").over(here) - F.col("size")).join(totals.select("k", "bucket", "skipped").repartition("k", "bucket"), ["k", "bucket"])
    return d.select("doc_id", "k", "size", (F.col("off") + F.col("skipped")).alias("off"))


def mix(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """The mix: a row for each piece of a document in a slot: k, slot, rank, round, block, doc_id, size, off, words."""
    d = stream(sizes).where("size > 0")
    pieces = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("off") / BLOCK), F.floor((F.col("off") + F.col("size") - 1) / BLOCK))))
    start = F.col("block") * BLOCK
    pieces = pieces.withColumn("a", F.greatest(F.col("off") - start, F.lit(0))).withColumn("b", F.least(F.col("off") + F.col("size") - start, F.lit(BLOCK)))
    m = pieces.join(schedule(sources).hint("merge"), ["k", "block"]).withColumn("words", F.least("b", "upto") - F.col("a"))
    return m.where("words > 0").select("k", "slot", "rank", "round", "block", "doc_id", "size", "off", "words")


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot, slots: one row per row of ``docs``."""
    sizes = checkpoint(sized(docs))
    sources = checkpoint(targets(sizes))
    none, nowhere = F.lit(0).cast("long"), F.lit(None).cast("long")
    got = mix(sizes, sources).select("k", "off", "doc_id", "size", "words", "slot", "rank")
    got = got.unionByName(stream(sizes).where("size > 0").select("k", "off", "doc_id", "size", none.alias("words"), nowhere.alias("slot"), nowhere.alias("rank")))
    got = got.groupBy("k", "off", "doc_id", "size").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("rank").alias("slots"))
    got = got.unionByName(sizes.where("size = 0").select("k", none.alias("off"), "doc_id", "size", none.alias("taken"), nowhere.alias("first_slot"), none.alias("slots")))
    shares = sources.select("k", "source_size", "target")
    shares = F.broadcast(shares) if shares.count() <= BROADCAST_SOURCES else shares
    return got.join(shares, "k").select("doc_id", "size", "source_size", "target", "taken", F.coalesce("first_slot", F.lit(-1)).alias("first_slot"), "slots")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` in the order of the mix, each as often as the mix takes it.

    A pass over a source that takes at least half of a document's words takes the whole
    document, else none of it. The rows stand in shards of equally many slots, in slot order
    in each; those at the end without a slot come last. Documents without words go.
    """
    alike = ["__k", "__size", "__id"]
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id")
    sizes = checkpoint(sized(docs))
    sources = checkpoint(targets(sizes))
    copies = mix(sizes, sources).groupBy("k", "off", "doc_id", "size", "round").agg(F.sum("words").alias("words"), F.min("slot").alias("__slot"), F.min("rank").alias("__first"))
    copies = copies.where("2 * words >= size").select(F.col("k").alias("__k"), F.col("size").alias("__size"), name, F.col("off").alias("__off"), "__slot", "__first")
    copies = copies.withColumn("__rank", F.dense_rank().over(W.partitionBy(*alike).orderBy("__off")))
    rows = docs.withColumns({"__k": _source_key(), "__size": _size(), "__id": name})
    rows = rows.withColumn("__no", F.row_number().over(W.partitionBy(*alike).orderBy("text")))
    # The numbers of equal rows are compared but aren't a key, so the texts stay where the window left them.
    placed = rows.join(copies.hint("merge"), alike).where(F.col("__no") - F.col("__rank") == 0)
    # Slots are equal in words, so a shard's place follows from the slot: no sample of the rows has to be sorted.
    n, shards = sources.agg(F.max("all_slots")).first()[0] or 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.coalesce(F.floor(F.col("__slot") / n * shards).cast("int"), F.lit(shards - 1))
    dealt = placed.repartitionById(shards, F.least(shard, F.lit(shards - 1)))
    return dealt.sortWithinPartitions(F.col("__slot").asc_nulls_last(), "__k", "__first", "__off").select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(read(spark, sf_dir, "documents"))


#: Words are counted without slots: whole passes over the stream, and the stream's start once more.
#: Places come from the schedule, with points summed from bits and each rank joined to its blocks.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS own_level
  FROM s WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT min_by(own_level, 3 * source_size / weight) AS level FROM l WHERE own_level * weight <= 3 * source_size),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM l, v),
w AS (SELECT *, least(3 * source_size, CAST(round_even(target, 0) AS BIGINT)) AS words FROM t),
p AS (SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS off FROM d),
b AS (SELECT *, (source_size + 63) // 64 AS blocks, words % source_size AS rest, words // source_size * ((source_size + 63) // 64) + (words % source_size + 63) // 64 AS n FROM w WHERE source_size > 0),
e AS (SELECT *, sum(n) OVER (ORDER BY source NULLS LAST) AS upto, sum(n) OVER () AS total FROM b),
band AS (SELECT *, floor(CAST(upto - n AS DOUBLE) / total * 4503599627370496.0) AS lo, floor(CAST(upto AS DOUBLE) / total * 4503599627370496.0) AS hi FROM e),
slot AS (SELECT i, list_sum([((i >> x) & 1) << (51 - x) FOR x IN range(52)]) AS point FROM (SELECT unnest(range((SELECT CAST(max(total) AS BIGINT) FROM band))) AS i)),
hit AS (SELECT source, i, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS r FROM slot JOIN band ON point >= lo AND point < hi),
ranks AS (SELECT source, blocks, rest, n, unnest(range(CAST(n AS BIGINT))) AS r FROM band),
mix AS (
  SELECT ranks.source, ranks.r % blocks AS block, hit.i AS slot, CASE WHEN ranks.r = n - 1 AND rest > 0 THEN rest ELSE (ranks.r % blocks + 1) * 64 END AS far
  FROM ranks LEFT JOIN hit ON hit.source IS NOT DISTINCT FROM ranks.source AND hit.r = ranks.r),
piece AS (SELECT doc_id, source, size, off, unnest(range(off // 64, (off + size - 1) // 64 + 1)) AS block FROM p WHERE size > 0),
stands AS (
  SELECT q.doc_id, q.source, q.off, min(slot) AS first_slot, count(*) AS slots FROM piece q JOIN mix ON mix.source IS NOT DISTINCT FROM q.source AND mix.block = q.block
  WHERE far > greatest(q.off, q.block * 64) GROUP BY q.doc_id, q.source, q.off)
SELECT p.doc_id, p.size, w.source_size, w.target,
       CASE WHEN w.source_size = 0 THEN CAST(0 AS BIGINT)
            ELSE CAST(w.words // w.source_size * p.size + greatest(0, least(p.off + p.size, w.words % w.source_size) - p.off) AS BIGINT) END AS taken,
       coalesce(first_slot, -1) AS first_slot, coalesce(slots, 0) AS slots
FROM p JOIN w ON p.source IS NOT DISTINCT FROM w.source
LEFT JOIN stands ON p.size > 0 AND stands.doc_id IS NOT DISTINCT FROM p.doc_id AND stands.source IS NOT DISTINCT FROM p.source AND stands.off = p.off
"""

QUERIES = {"op2_mixing": op2_mixing}
ORACLES = {"op2_mixing": ORACLE}
