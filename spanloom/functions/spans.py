"""Column expressions over arrays of spans and entities. All of them are row-local."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom import bank
from spanloom.functions.types import ENTITIES, ENTITY


def lookup(key: Column, groups: Mapping[str, tuple[str, ...]], default: str | None) -> Column:
    """The name in ``groups`` under which the key is listed."""
    out = F.lit(default).cast("string")
    for name, members in groups.items():
        out = F.when(key.isin(*members), F.lit(name)).otherwise(out)
    return out


def entity_group(category: Column) -> Column:
    return lookup(category, bank.ENTITY_GROUPS, "PII")


def priority(group: Column) -> Column:
    return reduce(lambda out, g: F.when(group == g, F.lit(bank.GROUP_PRIORITY[g])).otherwise(out), bank.GROUP_PRIORITY, F.lit(0))


def cut(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] in code points."""
    return F.substring(text, start + 1, end - start)


def no_entities() -> Column:
    return F.array().cast(ENTITIES)


def without_overlaps(spans: Column) -> Column:
    """A sweep by start: of a span and the last kept one that it overlaps the longer stays, then the surer, then that of the greater group, then the earlier."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s.alias("s"))))
    rank = lambda s: F.struct(s["end"] - s["start"], s["confidence"], priority(entity_group(s["category"])))

    def step(kept: Column, x: Column) -> Column:
        s, last = x["s"], F.try_element_at(kept, F.lit(-1))
        apart = (F.size(kept) == 0) | (s["start"] >= last["end"])
        return (
            F.when(apart, F.concat(kept, F.array(s)))
            .when(rank(s) > rank(last), F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s)))
            .otherwise(kept)
        )

    return F.aggregate(ordered, F.slice(spans, 1, 0), step)


def as_entities(text: Column, spans: Column) -> Column:
    """Spans of a scan as entities."""

    def one(s: Column) -> Column:
        return F.struct(
            cut(text, s["start"], s["end"]).alias("text"),
            s["category"].alias("category"),
            entity_group(s["category"]).alias("category_group"),
            s["confidence"].alias("confidence"),
            s["layer"].alias("detection_layer"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("metadata"),
        )

    return F.transform(spans, one).cast(ENTITIES)


def with_fields(entity: Column, **fields: Column) -> Column:
    return reduce(lambda e, f: e.withField(f, fields[f]), fields, entity)


def by_start(entities: Column) -> Column:
    """In order of start, else as they stand."""

    def ordered(x: Column) -> Column:
        numbered = F.transform(x, lambda e, i: F.struct(e["start"].alias("start"), i.alias("i")))
        return F.transform(F.sort_array(numbered), lambda n: F.element_at(x, n["i"] + 1))

    return once(entities, ordered)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def put(metadata: Column, *pairs: tuple[str, Column]) -> Column:
    """A map with some entries set."""
    names = [n for n, _ in pairs]
    return F.map_concat(F.map_filter(metadata, lambda k, v: ~k.isin(*names)), F.create_map(*[x for n, v in pairs for x in (F.lit(n), v.cast("string"))]))


def typed(entity: Column) -> Column:
    return entity.cast(ENTITY)
