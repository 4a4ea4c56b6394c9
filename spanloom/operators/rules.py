"""Rules over the entities of a scan: boost those inside a match, else mint a new one."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import bank
from spanloom.catalog import Pattern, Rule
from spanloom.functions.spans import by_start, cut, no_entities, put
from spanloom.functions.types import ENTITIES
from spanloom.operators.scan import scanned

_ENTITY = pa.struct([("text", pa.string()), ("category", pa.string()), ("category_group", pa.string()), ("confidence", pa.float64()), ("detection_layer", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("metadata", pa.map_(pa.string(), pa.string()))])
_GROUPS = {c: g for g, members in bank.ENTITY_GROUPS.items() for c in members}


def _reaches(e: Column, h: Column) -> Column:
    """The hit raises the entity: same category, holds it, surer."""
    return (e["category"] == h["category"]) & (e["start"] >= h["start"]) & (e["end"] <= h["end"]) & (e["confidence"] < h["confidence"])


def _same(e: Column, h: Column) -> Column:
    return (e["category"] == h["category"]) & (e["start"] == h["start"]) & (e["end"] == h["end"])


def apply_rules(text: Column, entities: Column, hits: Column) -> Column:
    """The entities after all hits, in rule order and from left to right, by start.

    A hit raises every entity that it reaches. One that raised none becomes an entity of
    its own, unless its rule only boosts or an entity of its span and category is there.
    Entities that rules made are not raised by later hits.
    """

    def raised(e: Column, h: Column) -> Column:
        marked = e.withField("confidence", h["confidence"]).withField("metadata", put(e["metadata"], ("boosted_by_rule", h["rule"]), ("context_matched", h["context"])))
        return F.when(_reaches(e, h), marked).otherwise(e)

    def minted(h: Column) -> Column:
        return F.struct(
            cut(text, h["start"], h["end"]).alias("text"), h["category"].alias("category"), h["group"].alias("category_group"), h["confidence"].alias("confidence"),
            F.lit("RULES").alias("detection_layer"), h["start"].alias("start"), h["end"].alias("end"),
            F.create_map(F.lit("rule_id"), h["rule"], F.lit("context_matched"), h["context"].cast("string")).alias("metadata"),
        )

    def step(acc: Column, h: Column) -> Column:
        taken = F.exists(acc["old"], lambda e: _reaches(e, h) | _same(e, h)) | F.exists(acc["new"], lambda e: _same(e, h))
        old = F.transform(acc["old"], lambda e: raised(e, h)).cast(ENTITIES)
        new = F.when(h["boost_only"] | taken, acc["new"]).otherwise(F.concat(acc["new"], F.array(minted(h)).cast(ENTITIES)))
        return F.struct(old.alias("old"), new.alias("new"))

    start = F.struct(entities.cast(ENTITIES).alias("old"), no_entities().alias("new"))
    merged = F.aggregate(hits, start, step, lambda acc: by_start(F.concat(acc["old"], acc["new"])))
    return F.when(F.size(hits) > 0, merged).otherwise(by_start(entities))


# The same in the scan's own pass, for each text by itself: what comes out of a scan is not worked
# out again by each filter and column above it, as a column expression is.


def _kept(spans: list[tuple]) -> list[tuple]:
    """The spans of ``spans.without_overlaps``."""
    kept: list[tuple] = []
    for s in sorted(spans, key=lambda s: (s[0], s[4])):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
        elif _rank(s) > _rank(kept[-1]):
            kept[-1] = s
    return kept


def _rank(s: tuple) -> tuple:
    return s[1] - s[0], s[3], bank.GROUP_PRIORITY.get(_GROUPS.get(s[2], "PII"), 0)


def _ruled(text: str, entities: list[tuple], hits: list[tuple]) -> list[tuple]:
    """The entities of ``apply_rules``."""
    if not hits:
        return entities
    old, new = list(entities), []
    for _, a, b, rule, category, group, confidence, context, boost_only in hits:
        context = "true" if context else "false"
        taken = False
        for i, e in enumerate(old):
            if e[1] == category and e[5] >= a and e[6] <= b:
                if e[3] < confidence:
                    taken = True
                    marks = [x for x in e[7] if x[0] not in ("boosted_by_rule", "context_matched")]
                    old[i] = (*e[:3], confidence, *e[4:7], [*marks, ("boosted_by_rule", rule), ("context_matched", context)])
                elif e[5] == a and e[6] == b:
                    taken = True
        if not boost_only and not taken and not any(e[1] == category and e[5] == a and e[6] == b for e in new):
            new.append((text[a:b], category, group, confidence, "RULES", a, b, [("rule_id", rule), ("context_matched", context)]))
    return sorted(old + new, key=lambda e: e[5])


def _maker(ruled: bool, scan_too: bool) -> Callable[[str, list, list], tuple[list, ...]]:
    def made(text: str, spans: list[tuple], hits: list[tuple]) -> tuple[list, ...]:
        found = [(text[a:b], category, _GROUPS.get(category, "PII"), confidence, layer, a, b, []) for a, b, category, confidence, _, layer in _kept(spans)]
        after = _ruled(text, found, hits) if ruled else found
        return (found, after) if scan_too else (after,)

    return made


def entities(df: DataFrame, patterns: list[Pattern], rules: list[Rule], text_col: str = "text", least: float = 0.0, context_boost: float = 0.0, timed: bool = False, scan_too: bool = True) -> DataFrame:
    """``df`` with after_scan (if ``scan_too``), the entities without overlaps, after_rules, those after the rules, and error."""
    columns = [("after_scan", _ENTITY)] * scan_too + [("after_rules", _ENTITY)]
    return scanned(df, patterns, rules, _maker(bool(rules), scan_too), columns, text_col, least, context_boost, timed)
