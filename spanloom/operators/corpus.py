"""Made-up labelled examples, and their conversion to chat rows."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "id string, text string, expected array<string>, category string"
MIN_EXAMPLES = 50
SHARES = {"true_positive": 0.6, "true_negative": 0.2, "adversarial_negative": 0.2}

_NAMES = ("Avery Holt", "Jordan Reyes", "Casey Lind", "Morgan Vance", "Riley Stone")
_PLACES = ("the harbour office", "the north branch", "the annual meeting", "the training day")
#: Domain, category, template, expected types.
_TEMPLATES = (
    ("legal", "true_positive", "Outside counsel told {name} about Case No. {n2}-cv-{n5}.", ("COUNSEL_COMMUNICATION", "CASE_NUMBER")),
    ("legal", "true_positive", "Privileged and confidential: memo {n5} for {name}.", ("PRIVILEGE_MARKER",)),
    ("legal", "true_positive", "The litigation hold of {name} covers DOC-{n4}-{n5}.", ("LITIGATION_MARKER", "BATES_NUMBER")),
    ("legal", "true_negative", "{name} booked room {n2} at {place}.", ()),
    ("legal", "adversarial_negative", "{name} counselled visitors at {place} on day {n2}.", ()),
    ("therapy", "true_positive", "Session {n2}: {name} takes sertraline {n2} mg daily.", ("SESSION_MARKER", "MEDICATION")),
    ("therapy", "true_positive", "Patient {name}, DOB: 03/04/19{n2}.", ("PATIENT_NAME", "DATE_OF_BIRTH")),
    ("therapy", "true_positive", "Progress note {n5}: suicidal ideation denied by {name}.", ("SESSION_MARKER", "CLINICAL_RISK_FLAG")),
    ("therapy", "true_negative", "{name} took {n2} photographs at {place}.", ()),
    ("therapy", "adversarial_negative", "{name} was patient at {place} for {n2} hours.", ()),
    ("finance", "true_positive", "MNPI: acquiring the firm of {name} at ${n2}/share.", ("MNPI_MARKER", "MA_ACTIVITY", "DEAL_VALUE")),
    ("finance", "true_positive", "Term sheet {n5} of {name}: {n2}% carry and a hurdle rate.", ("FINANCIAL_TERMS", "CARRY_TERMS")),
    ("finance", "true_positive", "{name}: blackout period until day {n2}, do not distribute.", ("INSIDER_MARKER", "DISTRIBUTION_RESTRICTION")),
    ("finance", "true_negative", "{name} sold {n2} tickets for {place}.", ()),
    ("finance", "adversarial_negative", "{name} acquired a taste for tea at {place}, cup {n2}.", ()),
)
DOMAINS = tuple(dict.fromkeys(t[0] for t in _TEMPLATES))


def generate(spark: SparkSession, domain: str, n: int = 200, seed: int = 42) -> DataFrame:
    """``n`` examples of a domain, 60 of 100 positive and 20 each of the kinds of negatives, in a shuffled order that the seed fixes."""
    if domain not in DOMAINS:
        raise ValueError(f"unknown domain {domain!r}; there are {', '.join(DOMAINS)}")
    if n < MIN_EXAMPLES:
        raise ValueError(f"at least {MIN_EXAMPLES} examples")
    draw = random.Random(f"{domain}-{seed}")
    counts = {"true_positive": int(n * SHARES["true_positive"]), "true_negative": int(n * SHARES["true_negative"])}
    counts["adversarial_negative"] = n - sum(counts.values())
    rows = []
    for category, k in counts.items():
        own = [t for t in _TEMPLATES if t[:2] == (domain, category)]
        for i in range(k):
            _, _, text, expected = own[i % len(own)]
            text = text.format(name=draw.choice(_NAMES), place=draw.choice(_PLACES), n2=draw.randint(10, 99), n4=draw.randint(1000, 9999), n5=draw.randint(10000, 99999))
            rows.append((text, list(expected), category))
    draw.shuffle(rows)
    return spark.createDataFrame([(f"{domain}-{i:04d}", *r) for i, r in enumerate(rows)], SCHEMA)


def as_chat(question: str = "List the sensitive spans of the text as JSON.") -> Column:
    """An example as a JSON row of system, user and assistant; a positive's expected types each span the whole text."""
    found = F.transform("expected", lambda t: F.struct(t.alias("category"), F.col("text").alias("span_text"), F.lit(0.95).alias("confidence"), F.lit("").alias("reasoning")))
    answer = F.to_json(F.struct(F.when(F.col("category") == "true_positive", found).otherwise(F.slice(found, 1, 0)).alias("detections")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.to_json(F.struct(F.array(message("system", F.lit(question)), message("user", F.col("text")), message("assistant", answer)).alias("messages")))


def split(rows: DataFrame, order: Sequence[str], share: float = 0.9, *by: str) -> DataFrame:
    """``rows`` with part: train for the first whole number of rows in ``share`` of a group, in order, else validation."""
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    return rows.withColumn("part", F.when(F.row_number().over(group.orderBy(*order)) <= F.floor(F.count(F.lit(1)).over(group) * share), "train").otherwise("validation"))
