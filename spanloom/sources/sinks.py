"""Results as JSON, as one line, and as the shape that is safe to send."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _entities(digits: int, with_text: bool) -> Column:
    def one(e: Column) -> Column:
        fields = [e["text"].alias("text")] if with_text else []
        return F.struct(*fields, e["category"].alias("category"), e["category_group"].alias("category_group"), F.round(e["confidence"], digits).alias("confidence"), e["detection_layer"].alias("detection_layer"), e["start"].alias("start"), e["end"].alias("end"))

    return F.transform("entities", one)


def as_json() -> Column:
    """A result with its entities and their text; confidences to two places."""
    return F.to_json(F.struct("text_hash", "score", "sensitivity_level", "routing_suggestion", "entity_count", "layers_invoked", F.col("profile_ids").alias("profiles_active"), _entities(2, True).alias("entities")))


def as_wire(with_text: bool = False) -> Column:
    """A result without the text of its entities, unless asked for; confidences to four places."""
    return F.to_json(
        F.struct(
            "score", F.col("sensitivity_level").alias("level"), F.col("routing_suggestion").alias("routing"), "entity_count", "category_groups_found", "top_category",
            F.round("top_confidence", 4).alias("top_confidence"), "layers_invoked", "profile_ids", "text_hash", _entities(4, with_text).alias("entities"),
        ),
        {"ignoreNullFields": "false"},
    )


def as_summary() -> Column:
    best = F.when(F.col("top_category").isNull(), "").otherwise(F.format_string(" | %s (%.2f)", "top_category", "top_confidence"))
    return F.concat(F.col("sensitivity_level"), F.format_string(" (%d) | ", "score"), F.col("routing_suggestion"), F.format_string(" | %d entities", "entity_count"), best)


def entity_table(results: DataFrame, key: str) -> DataFrame:
    """A row an entity, its text cut to 18 characters."""
    e = results.select(key, F.explode("entities").alias("e"))
    shown = F.when(F.length("e.text") > 18, F.concat(F.substring("e.text", 1, 18), F.lit("…"))).otherwise(F.col("e.text"))
    return e.select(key, shown.alias("entity"), "e.category", F.format_string("%.2f", "e.confidence").alias("confidence"), F.col("e.detection_layer").alias("layer"))


def mapping_json(mapping: str = "mapping") -> Column:
    return F.to_json(F.col(mapping))


def mapping_from_json(raw: Column) -> Column:
    from spanloom.functions.types import MAPPING

    return F.from_json(raw, MAPPING)


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A JSON object a line, in files of the folder ``path``."""
    rows.write.mode("overwrite").json(path)


def report_lines(metrics: DataFrame, name: str = "dataset") -> Column:
    """A line of text for each row of evaluation metrics."""
    return F.format_string("%s: precision %.1f%%, recall %.1f%%, F1 %.1f%% (TP %d FP %d FN %d TN %d)", name, F.col("precision") * 100, F.col("recall") * 100, F.col("f1") * 100, "tp", "fp", "fn", "tn")
