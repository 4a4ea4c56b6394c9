"""A model's second opinion on ambiguous texts: gate, prompt, call, validation, merge."""

from __future__ import annotations

import json
import logging
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import bank
from spanloom.functions.spans import lookup
from spanloom.functions.types import ENTITIES
from spanloom.operators.score import LOCAL_GROUPS, has_group

ANSWER = "struct<detections:array<struct<category:string,span_text:string,confidence:double,reasoning:string>>>"
SHOWN = 8
FRAME = (
    "Find text that the categories below describe. Quote each span exactly as it stands in the text. "
    "Leave out what is routine or public, and answer with an empty list when unsure. "
    'Answer in JSON: {"detections": [{"category": "...", "span_text": "...", "confidence": 0.0, "reasoning": "..."}]}'
)
logger = logging.getLogger(__name__)


class LocalhostOnlyError(ValueError):
    """The model's address isn't on this machine."""


def check_local(endpoint: str) -> None:
    if urlparse(endpoint).hostname not in ("localhost", "127.0.0.1", "::1"):
        raise LocalhostOnlyError(f"texts are only sent to this machine, not to {endpoint!r}")


@dataclass(frozen=True)
class ModelOptions:
    enabled: bool = False
    model: str = ""
    endpoint: str = "http://localhost:11434"
    timeout_ms: int = 5000
    max_retries: int = 2
    quality: str = "fast"
    between: tuple[int, int] = (20, 60)


class LocalClient:
    """A model server on this machine. A prompt gives the answer's text; None if there is none."""

    def __init__(self, options: ModelOptions, model: str):
        check_local(options.endpoint)
        self.options, self.model = options, model

    def __call__(self, prompt: str) -> str | None:
        body = {"model": self.model, "prompt": prompt, "stream": False, "format": "json", "options": {"temperature": 0}}
        for n in range(self.options.max_retries + 1):
            try:
                request = urllib.request.Request(f"{self.options.endpoint}/api/generate", json.dumps(body).encode(), {"Content-Type": "application/json"})
                with urllib.request.urlopen(request, timeout=self.options.timeout_ms / 1000) as reply:
                    raw = json.loads(reply.read())["response"]
            except OSError as e:  # the server can't be reached: trying again won't help
                logger.warning("no answer: %s", e)
                return None
            except (ValueError, KeyError):
                raw = None
            if raw is not None and is_answer(raw):
                return raw
            time.sleep(0.1 * 2**n)
        return None


def is_answer(raw: str) -> bool:
    """The text is JSON of the right form."""
    try:
        found = json.loads(raw)["detections"]
        return all(isinstance(d["category"], str) and isinstance(d["span_text"], str) and d["span_text"] and 0 <= d["confidence"] <= 1 for d in found)
    except (ValueError, KeyError, TypeError):
        return False


def gate(entities: Column, points: Column, between: tuple[int, int] = (20, 60)) -> Column:
    """The text is ambiguous: no group that stays local, and a middling score."""
    return ~has_group(entities, *LOCAL_GROUPS) & points.between(*between)


def categories(entities: Column) -> Column:
    return F.array_distinct(F.transform(entities, lambda e: e["category"]))


def narrowed(entities: Column, allowed: tuple[str, ...]) -> Column:
    """The allowed categories that aren't found yet."""
    return F.array_except(F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>"), categories(entities))


def prompt(text: Column, entities: Column, allowed: tuple[str, ...]) -> Column:
    """The question for a text; null if nothing is left to ask for."""
    left = narrowed(entities, allowed)
    shown = F.transform(F.slice(entities, 1, SHOWN), lambda e: F.format_string("- %s @ [%d:%d] (conf=%.2f)", e["category"], e["start"], e["end"], e["confidence"]))
    rest = F.size(entities) - SHOWN
    lines = F.when(F.size(entities) == 0, "(none)").otherwise(F.concat(F.array_join(shown, "\n"), F.when(rest > 0, F.concat(F.lit("\n- and "), rest.cast("string"), F.lit(" more"))).otherwise("")))
    covered = F.array_sort(F.array_intersect(categories(entities), F.array(*map(F.lit, allowed)) if allowed else F.array().cast("array<string>")))
    asked = F.concat(
        F.lit(f"{FRAME}\n\nAlready found:\n"), lines, F.lit("\n\nDon't report these categories again: "), F.when(F.size(covered) == 0, "(none)").otherwise(F.array_join(covered, ", ")),
        F.lit("\nReport only these categories: "), F.array_join(left, ", "), F.lit("\n\nText:\n"), text, F.lit("\n\nAnswer:\n"),
    )
    return F.when(F.size(left) > 0, asked)


def nothing(prompt: str) -> str:
    """A client that finds nothing."""
    return '{"detections": []}'


def ask(df: DataFrame, prompt_col: str, make_client: Callable[[], Callable[[str], str | None]], answer_col: str = "raw") -> DataFrame:
    """``df`` with the answers' text; null where the prompt is null or the client has no answer. One client a task."""
    at, names = df.columns.index(prompt_col), df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{answer_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make_client()

        def answer(question: str | None) -> str | None:
            try:
                return client(question) if question is not None else None
            except Exception as e:  # a failed call leaves the other layers' result
                logger.warning("the model failed: %s", e)
                return None

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(answer, batch.column(at).to_pylist()), pa.string())], names=[*names, answer_col])

    return df.mapInArrow(run, schema)


def proposals(text: Column, raw: Column) -> Column:
    """The entities of an answer: of a known category, with a span that stands in the text (its first place), confidence in 0 to 1."""
    found = F.coalesce(F.from_json(raw, ANSWER)["detections"], F.array().cast("array<struct<category:string,span_text:string,confidence:double,reasoning:string>>"))
    group = lambda d: lookup(d["category"], bank.MODEL_GROUPS, None)
    sound = F.filter(found, lambda d: group(d).isNotNull() & (F.length(d["span_text"]) > 0) & (F.instr(text, d["span_text"]) > 0) & d["confidence"].isNotNull())

    def one(d: Column) -> Column:
        start = F.instr(text, d["span_text"]) - 1
        return F.struct(
            d["span_text"].alias("text"), d["category"].alias("category"), group(d).alias("category_group"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), d["confidence"])).alias("confidence"),
            F.lit("LLM").alias("detection_layer"), start.alias("start"), (start + F.length(d["span_text"])).alias("end"), F.create_map(F.lit("reasoning"), F.coalesce(d["reasoning"], F.lit(""))).alias("metadata"),
        )

    return F.transform(sound, one).cast(ENTITIES)


def merge(entities: Column, proposed: Column) -> Column:
    """The entities, then each proposal whose span and category are new and that overlaps no entity of its category."""

    def step(acc: Column, p: Column) -> Column:
        same = lambda e: (e["category"] == p["category"]) & (e["start"] == p["start"]) & (e["end"] == p["end"])
        over = lambda e: (e["category"] == p["category"]) & (p["start"] < e["end"]) & (e["start"] < p["end"])
        known = F.exists(acc, same) | F.exists(entities, over)
        return F.when(known, acc).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(proposed, entities, step)
