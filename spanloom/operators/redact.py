"""Redaction with reversible tokens, and its undoing."""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom import bank
from spanloom.functions.spans import cut, once
from spanloom.operators.score import text_hash

logger = logging.getLogger(__name__)


def resolve_labels(profile: str | None, labels: Iterable[str] | None) -> list[str]:
    """The caller's labels, else the profile's, else the general ones."""
    if labels is not None:
        return list(labels)
    return [*bank.REDACTED_BY_DEFAULT, *bank.REDACTED_BESIDES.get(profile or "", ())]


def expand_labels(labels: Iterable[str]) -> list[str]:
    """Entity types of labels. Upper case or an underscore marks a type itself; other unknown labels are left out."""
    out: list[str] = []
    for label in labels:
        if label in bank.REDACTION_LABELS:
            out += bank.REDACTION_LABELS[label]
        elif label.isupper() or "_" in label:
            out.append(label)
        else:
            logger.warning("redaction label %r is unknown and left out", label)
    return list(dict.fromkeys(out))


def label_of(category: Column) -> Column:
    """The first label that has the type, else the type in capitals without underscores."""
    out = F.replace(F.initcap(F.replace(F.lower(category), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
    for label, types in reversed(bank.REDACTION_LABELS.items()):
        out = F.when(category.isin(*types), F.lit(label)).otherwise(out)
    return out


def targets(entities: Column, types: list[str]) -> Column:
    """The entities of the types, by start and the longest first, without those that begin inside the last kept one."""
    wanted = F.filter(entities, lambda e: e["category"].isin(*types)) if types else F.slice(entities, 1, 0)
    plain = F.transform(wanted, lambda e, i: F.struct(e["start"].alias("start"), (-e["end"]).alias("far"), i.alias("i"), e["end"].alias("end"), e["category"].alias("category")))
    ordered = F.array_sort(plain)
    step = lambda kept, e: F.when((F.size(kept) == 0) | (e["start"] >= F.try_element_at(kept, F.lit(-1))["end"]), F.concat(kept, F.array(e))).otherwise(kept)
    return once(ordered, lambda x: F.aggregate(x, F.slice(x, 1, 0), step))


def token(category: Column, value: Column, salt: Column) -> Column:
    return F.concat(F.lit("["), label_of(category), F.lit("_"), F.substring(F.sha2(F.concat(salt, value), 256), 1, 6), F.lit("]"))


def redact(text: Column, entities: Column, types: list[str], salt: Column, profile: str, labels: list[str], created_at: Column | None = None) -> tuple[Column, Column]:
    """The text with tokens in the place of entities, and the mapping back."""
    kept = targets(entities, types)
    parts = F.transform(kept, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), cut(text, e["start"], e["end"]).alias("value"), token(e["category"], cut(text, e["start"], e["end"]), salt).alias("token")))

    def splice(acc: Column, p: Column) -> Column:
        return F.struct(F.concat(acc["out"], cut(text, acc["at"], p["start"]), p["token"]).alias("out"), p["end"].alias("at"))

    done = F.aggregate(parts, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), splice, lambda acc: F.concat(acc["out"], cut(text, acc["at"], F.length(text))))
    # A token that two values share keeps the later one.
    last = F.aggregate(parts, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["token"]), F.create_map(p["token"], p["value"])))
    made = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'+00:00'") if created_at is None else created_at
    mapping = F.struct(last.alias("tokens"), F.array(*map(F.lit, labels)).cast("array<string>").alias("categories_redacted"), F.lit(profile).alias("profile_id"), text_hash(text).alias("text_hash"), made.alias("created_at"))
    return done, mapping


def unredact(text: Column, tokens: Column) -> Column:
    """The text with every token replaced by its value, the longest tokens first."""
    entries = F.array_sort(F.transform(F.map_entries(tokens), lambda e: F.struct((-F.length(e["key"])).alias("n"), e["key"].alias("key"), e["value"].alias("value"))))
    return F.aggregate(entries, text, lambda out, e: F.replace(out, e["key"], e["value"]))
