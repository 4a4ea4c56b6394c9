"""Score, level, route and summary columns of an array of entities."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.bank import DEFAULT_WEIGHT

LOCAL_GROUPS = ("PRIVILEGE", "MNPI")


def weight(group: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, w in weights.items():
        out = F.when(group == name, F.lit(float(w))).otherwise(out)
    return out


def score(entities: Column, weights: Mapping[str, float]) -> Column:
    """The sum of weight times confidence, half to even, 100 at most."""
    total = F.aggregate(entities, F.lit(0.0), lambda s, e: s + weight(e["category_group"], weights) * e["confidence"])
    return F.least(F.lit(100), F.rint(total).cast("int"))


def level(points: Column) -> Column:
    return F.when(points == 0, "NONE").when(points <= 20, "LOW").when(points <= 50, "MEDIUM").when(points <= 80, "HIGH").otherwise("CRITICAL")


def has_group(entities: Column, *groups: str) -> Column:
    return F.exists(entities, lambda e: e["category_group"].isin(*groups))


def route(entities: Column, points: Column) -> Column:
    return F.when(has_group(entities, *LOCAL_GROUPS), "LOCAL_ONLY").when(has_group(entities, "PHI") | (points > 30), "REDACT_CLOUD").otherwise("CLOUD_OK")


def top(entities: Column) -> Column:
    """The surest entity, the first on ties; null if there is none."""
    return F.aggregate(F.slice(entities, F.lit(2), F.size(entities)), F.try_element_at(entities, F.lit(1)), lambda best, e: F.when(e["confidence"] > best["confidence"], e).otherwise(best))


def groups(entities: Column) -> Column:
    return F.sort_array(F.array_distinct(F.transform(entities, lambda e: e["category_group"])))


def text_hash(text: Column, digits: int = 16) -> Column:
    return F.concat(F.lit("sha256:"), F.substring(F.sha2(text, 256), 1, digits))
