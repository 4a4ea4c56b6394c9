"""Evaluation of detections against labelled examples.

An example has id, expected (array of types), category (true_positive, or a kind of
negative) and detected (array of types).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.bank import GENERIC_TYPES

NEGATIVE = ("true_negative", "adversarial_negative")
MAX_MEDIAN_MS = 100.0


def detected_types(entities: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(entities, lambda e: e["category"])))


def outcomes(examples: DataFrame, ignore: Iterable[str] = GENERIC_TYPES) -> DataFrame:
    """``examples`` with outcome: a positive is tp if an expected type was detected, else fn; a negative is fp if a type outside ``ignore`` was, else tn."""
    ignored = F.array(*map(F.lit, ignore)).cast("array<string>")
    wrong = F.size(F.array_except("detected", ignored)) > 0
    negative = F.col("category").isin(*NEGATIVE)
    hit = F.arrays_overlap("expected", "detected")
    return examples.withColumn("outcome", F.when(negative, F.when(wrong, "fp").otherwise("tn")).otherwise(F.when(hit, "tp").otherwise("fn")))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def metrics(scored: DataFrame, *by: str, times: str | None = None) -> DataFrame:
    """A row a group: n, tp, fp, fn, tn, precision, recall, f1; 0 for a quotient by 0. times: a column that says for how many examples a row stands."""
    n = F.lit(1).cast("long") if times is None else F.col(times)
    many = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    counts = scored.groupBy(*by).agg(many(n).alias("n"), *[many(F.when(F.col("outcome") == o, n)).alias(o) for o in ("tp", "fp", "fn", "tn")])
    out = counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def per_type(examples: DataFrame, *by: str) -> DataFrame:
    """A row a type: tp and fn count expected types of positives, fp detected types of negatives."""
    negative = F.col("category").isin(*NEGATIVE)
    found = F.transform("detected", lambda t: F.struct(t.alias("type"), F.lit("fp").alias("what")))
    asked = F.transform("expected", lambda t: F.struct(t.alias("type"), F.when(F.array_contains("detected", t), "tp").otherwise("fn").alias("what")))
    # One pass over the examples; an inner explode would have them worked out for a filter of its own.
    every = examples.select(*by, F.explode_outer(F.when(negative, found).when(~negative, asked)).alias("t")).where("t IS NOT NULL")
    return every.select(*by, "t.type", "t.what").groupBy(*by, "type").agg(*[F.count_if(F.col("what") == w).alias(w) for w in ("tp", "fp", "fn")])


def latency(values: DataFrame, value: str, *by: str) -> DataFrame:
    """A row a group: n, median, p95 (the greatest value of fewer than 20, else by the (n + 1) p rule)."""
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    upto = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0) if by else W.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    ranked = counts.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(every))
    at = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col(value)))  # noqa: E731  the value of that rank from 1
    h = F.lit(0.95) * (F.col("n") + 1)
    out = ranked.groupBy(*by, "n").agg(at(F.floor((F.col("n") + 1) / 2)).alias("a"), at(F.floor(F.col("n") / 2) + 1).alias("b"), at(F.floor(h)).alias("x"), at(F.least(F.floor(h) + 1, F.col("n"))).alias("y"), F.max(value).alias("top"))
    p95 = F.when(F.col("n") < 20, F.col("top")).otherwise(F.col("x") + (h - F.floor(h)) * (F.col("y") - F.col("x")))
    return out.select(*by, "n", ((F.col("a") + F.col("b")) / 2).alias("median"), p95.alias("p95"))


def gates(report: DataFrame, target: Column, median: str | None = None) -> DataFrame:
    """``report`` with met_precision, and met_latency if it has a median."""
    out = report.withColumn("met_precision", F.col("precision") >= target)
    return out.withColumn("met_latency", F.col(median) < MAX_MEDIAN_MS) if median else out


def search_factors(examples: DataFrame, layers: Sequence[str], least: float = 0.5, factors: Sequence[float] = tuple(i / 10 for i in range(1, 11))) -> DataFrame:
    """A row a layer: the factor of its confidences with the best mean F1 over datasets, the smallest on ties.

    ``examples`` has dataset, expected, category and entities. The factors are tried in one
    job. What differs in nothing that decides an outcome (expected types; types, layers and
    confidences found) is counted and tried once.
    """
    decisive = F.sort_array(F.array_distinct(F.transform("entities", lambda e: F.struct(e["category"].alias("category"), e["detection_layer"].alias("detection_layer"), e["confidence"].alias("confidence")))))
    examples = examples.select("dataset", "expected", "category", decisive.alias("entities")).groupBy("dataset", "expected", "category", "entities").agg(F.count(F.lit(1)).alias("times"))
    tries = F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.lit(float(f)).alias("factor")) for x in layers for f in factors]))
    rows = examples.withColumn("t", tries).select("*", "t.layer", "t.factor").drop("t")
    weighed = F.filter("entities", lambda e: F.when(e["detection_layer"] == F.col("layer"), F.least(F.lit(1.0), e["confidence"] * F.col("factor"))).otherwise(e["confidence"]) >= least)
    by_set = metrics(outcomes(rows.withColumn("detected", detected_types(weighed))), "layer", "factor", "dataset", times="times")
    mean = by_set.groupBy("layer", "factor").agg(F.avg(F.round("f1", 12)).alias("f1"))
    best = mean.groupBy("layer").agg(F.max_by(F.struct("factor", "f1"), F.struct(F.round("f1", 9), -F.col("factor"))).alias("b"))
    return best.select("layer", "b.factor", "b.f1")


def compare_models(scored: DataFrame, targets: dict[str, float]) -> DataFrame:
    """A row a model: its precision in each dataset and how many targets it meets, the most first. From outcomes with model and dataset."""
    m = metrics(scored, "model", "dataset")
    target = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))])
    met = F.count_if(F.col("precision") >= F.coalesce(F.try_element_at(target, F.col("dataset")), F.lit(2.0))).alias("targets_met")
    each = [F.max(F.when(F.col("dataset") == d, F.col("precision"))).alias(d) for d in sorted(targets)]
    return m.groupBy("model").agg(*each, met, F.avg("f1").alias("mean_f1")).where(F.col("model").isNotNull()).orderBy(F.col("targets_met").desc(), F.col("mean_f1").desc(), "model")
