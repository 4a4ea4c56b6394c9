"""Progress by layer, and analysis of arriving texts. Both keep no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.plans.engine import Engine


def progress(engine: Engine, df: DataFrame, key: str, text_col: str = "text", **how) -> DataFrame:
    """A row an event: key, seq, layer (null in the last), entities, is_final, and in the last the score, level and route.

    The events of a text: after the scan, after the rules, after the model if it was
    asked, and the result.
    """
    chosen = tuple(how.get("layers") or engine.options.layers)
    layered = engine.layered(df.select(key, text_col), text_col, **how)
    keep = ("after_scan", "after_rules", "after_model", "asked")
    done = engine.finished(layered.withColumns({f"__{c}": F.col(c) for c in keep}), text_col, **how)
    none = F.lit(None)

    def event(layer: str | None, entities: str, final: bool):
        return F.struct(
            F.lit(layer).cast("string").alias("layer"), F.col(entities).alias("entities"), F.lit(final).alias("is_final"),
            (F.col("score") if final else none).cast("int").alias("score"), (F.col("sensitivity_level") if final else none).cast("string").alias("sensitivity_level"),
            (F.col("routing_suggestion") if final else none).cast("string").alias("routing_suggestion"),
        )

    events = [event("REGEX", "__after_scan", False)] if {"REGEX", "NER"} & set(chosen) else []
    events += [event("RULES", "__after_rules", False)] if "RULES" in chosen else []
    asked = F.when(F.col("__asked"), F.array(event("LLM", "__after_model", False))).otherwise(F.slice(F.array(event("LLM", "__after_model", False)), 1, 0))
    every = F.concat(*([F.array(*events)] if events else []), asked, F.array(event(None, "entities", True)))
    return done.select(key, F.posexplode(every).alias("seq", "e")).select(key, "seq", "e.*")


def analyze_arriving(engine: Engine, stream: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The plan of a batch over a stream of texts; to be written in append mode."""
    if not stream.isStreaming:
        raise ValueError("this takes a stream; analyze() takes a table")
    return engine.analyze(stream, text_col, **how)
