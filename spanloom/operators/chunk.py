"""Documents: chunks by size and blank line, and the roll-up of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.spans import once as _with
from spanloom.functions.types import ENTITIES

CHUNK_CHARS = 10_000


def chunk_ends(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Where chunks end, with a 0 in front.

    A chunk ends behind the last blank line that lies wholly inside ``size`` characters
    and past their first quarter, else after ``size`` characters. An empty text has one
    empty chunk.
    """
    if size <= 0:
        raise ValueError("a chunk must have characters")

    def ends(n: Column) -> Column:
        def end(at: Column, back: Column) -> Column:
            """``back`` is the window from ``at`` on, reversed: its first blank line is the last one."""
            blank = lambda behind: F.when((behind > 0) & (F.length(back) - behind - 1 > size // 4), at + F.length(back) - behind + 1).otherwise(at + size)
            return F.when(at + size >= n, n).otherwise(_with(F.instr(back, F.lit("\n\n")), blank))

        def step(acc: Column, _: Column) -> Column:
            at = acc["at"]
            more = _with(F.reverse(F.substring(text, at + 1, F.lit(size))), lambda back: end(at, back))
            grown = _with(more, lambda e: F.struct(e.alias("at"), F.concat(acc["ends"], F.array(e)).alias("ends")))
            return F.when(at >= n, acc).otherwise(grown)

        steps = F.sequence(F.lit(1), F.greatest(F.ceil(n * 4 / size), F.lit(1)).cast("int") + 1)
        start = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("ends"))
        return F.when(n == 0, F.array(F.lit(0), F.lit(0))).otherwise(F.aggregate(steps, start, step, lambda acc: acc["ends"]))

    return _with(F.length(text), ends)


def explode_chunks(docs: DataFrame, key: str, text_col: str = "text", size: int = CHUNK_CHARS, also: tuple[str, ...] = ()) -> DataFrame:
    """A row a chunk: key, the columns ``also``, chunk_index, label, text_offset, text. A null text counts as empty."""
    d = docs.select(key, *also, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    d = d.withColumn("__ends", chunk_ends(F.col("__text"), size))
    d = d.select(key, *also, "__text", "__ends", F.posexplode_outer(F.slice("__ends", F.lit(2), F.size("__ends"))).alias("chunk_index", "__end"))
    start = F.get("__ends", F.col("chunk_index"))
    return d.select(key, *also, "chunk_index", F.concat(F.lit("chunk "), (F.col("chunk_index") + 1).cast("string")).alias("label"), start.alias("text_offset"), F.substring("__text", start + 1, F.col("__end") - start).alias("text"))


def rebased(entities: Column, offset: Column) -> Column:
    return F.transform(entities, lambda e: e.withField("start", e["start"] + offset).withField("end", e["end"] + offset)).cast(ENTITIES)


def rollup(results: DataFrame, *keys: str) -> DataFrame:
    """A row a document (equal keys, null among them) from the results of its chunks (with chunk_index and text_offset).

    Score, level and route are those of the chunk with the highest score, the first on
    ties; groups and layers are united, entities stand in chunk order with their places
    in the whole text, the top entity is the surest, the first on ties.
    """
    r = results.withColumn("entities", rebased(F.col("entities"), F.col("text_offset")))

    def ordered(c: str) -> Column:
        """The chunks' values of a column, by chunk."""
        values = F.collect_list(F.struct("chunk_index", F.col(c).alias("x")))
        return F.transform(F.array_sort(values, lambda a, b: a["chunk_index"] - b["chunk_index"]), lambda s: s["x"])

    timed = [c for c in ("processing_time_ms",) if c in results.columns]
    out = r.groupBy(*keys).agg(
        F.max_by(F.struct("score", "sensitivity_level", "routing_suggestion"), F.struct("score", -F.col("chunk_index"))).alias("best"),
        F.flatten(ordered("entities")).alias("entities"),
        F.array_distinct(F.flatten(ordered("layers_invoked"))).alias("layers_invoked"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("category_groups_found")))).alias("category_groups_found"),
        F.max_by(F.struct("top_category", "top_confidence"), F.struct("top_confidence", -F.col("chunk_index"))).alias("first"),
        F.count(F.lit(1)).alias("chunk_count"),
        *[F.sum(c).alias(c) for c in timed],
    )
    return out.select(
        *keys, F.col("best.score").alias("score"), F.col("best.sensitivity_level").alias("sensitivity_level"), F.col("best.routing_suggestion").alias("routing_suggestion"),
        "category_groups_found", F.col("first.top_category").alias("top_category"), F.col("first.top_confidence").alias("top_confidence"),
        F.size("entities").alias("entity_count"), "layers_invoked", "chunk_count", "entities", *timed,
    )
