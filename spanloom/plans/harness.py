"""Trying patterns out, and the checks of requests from outside."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.catalog import Pattern, Profile, Registry, Rule
from spanloom.functions import spans as S
from spanloom.operators.scan import scan


def try_patterns(spark: SparkSession, patterns: Iterable[Pattern], texts: Sequence[str], least: float = 0.5, rules: Iterable[Rule] = ()) -> DataFrame:
    """A row a match of at least the least score: idx, text, category, start, end, confidence, found."""
    df = spark.createDataFrame(list(enumerate(texts)), "idx int, text string")
    d = scan(df, list(patterns), list(rules), least=least).select("idx", "text", F.explode("spans").alias("s"))
    found = S.cut(F.col("text"), F.col("s.start"), F.col("s.end"))
    return d.select("idx", "text", "s.category", "s.start", "s.end", "s.confidence", found.alias("found")).orderBy("idx", "start", "end")


def allowed_profile(requested: str | None, default: str, registry: Registry | None = None) -> Profile:
    """The profile that a request names, the default if it names none; ValueError if it isn't registered."""
    registry = registry or Registry()
    name = requested or default
    if name not in registry.ids():
        raise ValueError(f"unknown profile {name!r}; there are {', '.join(sorted(registry.ids()))}")
    return registry.get(name)
