"""The engine: texts in, entities, score, level and route out; redaction; documents.

A plan is one narrow stage: a scan in Arrow batches that also sees to overlaps and rules,
then column expressions over arrays of entities. Nothing is shuffled unless a document's
chunks are rolled up.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import catalog
from spanloom.catalog import ModelRegistry, Pattern, Profile, Registry
from spanloom.functions import spans as S
from spanloom.operators import chunk, model, redact, score
from spanloom.operators.calibrate import Calibrator
from spanloom.operators.rules import entities

#: Columns that ``analyze`` adds.
RESULT = (
    "text_hash", "entities", "score", "sensitivity_level", "category_groups_found", "top_category", "top_confidence", "entity_count", "layers_invoked", "profile_ids", "routing_suggestion", "error",
)


@dataclass(frozen=True)
class Options:
    profiles: tuple[str, ...] = ("legal", "therapy")
    layers: tuple[str, ...] = ("REGEX", "NER", "RULES")
    min_confidence: float = 0.5
    context_boost: float = 0.0
    #: Adds processing_time_ms, the time of a text's scan; results then differ from run to run.
    timed: bool = False
    model: model.ModelOptions = field(default_factory=model.ModelOptions)


class Engine:
    """Analysis and redaction with a set of profiles.

    person_patterns: patterns for the type PERSON, of which none is built in.
    client: makes the model's client on an executor; by default one for a server on this
    machine if the options enable it.
    """

    def __init__(self, profiles: Sequence[str | Profile] | None = None, options: Options | None = None, registry: Registry | None = None, calibrator: Calibrator | None = None, client: Callable | None = None, person_patterns: Iterable[Pattern] = (), models: ModelRegistry | None = None):
        self.options, self.registry, self.calibrator = options or Options(), registry or Registry(), calibrator or Calibrator()
        self.profiles = [self.registry.get(p) for p in (profiles if profiles is not None else self.options.profiles)]
        self.person_patterns, self.models = tuple(person_patterns), models or ModelRegistry()
        self._client = client

    def _client_maker(self) -> Callable:
        if self._client is not None:
            return self._client
        o = self.options.model
        name = o.model or self.models.get("classification", o.quality)
        model.check_local(o.endpoint)
        return lambda: model.LocalClient(o, name)

    def _active(self, profiles: Sequence[str | Profile] | None) -> list[Profile]:
        return [self.registry.get(p) for p in profiles] if profiles is not None else self.profiles

    def layered(self, df: DataFrame, text_col: str = "text", profiles: Sequence[str | Profile] | None = None, layers: Sequence[str] | None = None, min_confidence: float | None = None, scan_too: bool = True) -> DataFrame:
        """``df`` with the entities after each layer (after_scan if ``scan_too``, after_rules, after_model), whether the model was asked (asked), and error."""
        active = self._active(profiles)
        chosen = tuple(layers) if layers is not None else self.options.layers + (("LLM",) if self.options.model.enabled or self._client else ())
        least = self.options.min_confidence if min_confidence is None else min_confidence
        scans, ruled = bool({"REGEX", "NER"} & set(chosen)), "RULES" in chosen
        patterns = catalog.active_patterns(active, self.person_patterns) if scans else []
        rules = catalog.active_rules(active) if ruled else []
        text = F.coalesce(F.col(text_col), F.lit(""))

        d = entities(df, patterns, rules, text_col, least, self.options.context_boost, self.options.timed, scan_too)
        if self.options.timed:
            d = d.withColumnRenamed("scan_ms", "processing_time_ms")
        if "LLM" not in chosen:
            return d.withColumn("after_model", F.col("after_rules")).withColumn("asked", F.lit(False))

        weights = catalog.active_weights(active)
        d = d.withColumn("asked", model.gate(F.col("after_rules"), score.score(F.col("after_rules"), weights), self.options.model.between))
        proposed = []
        for i, p in enumerate(p for p in active if p.model_categories):
            question, answer = f"__question_{i}", f"__answer_{i}"
            d = d.withColumn(question, F.when(F.col("asked"), model.prompt(text, F.col("after_rules"), p.model_categories)))
            d = model.ask(d, question, self._client_maker(), answer).drop(question)
            proposed.append(answer)
        found = F.concat(*[model.proposals(text, F.col(a)) for a in proposed]) if proposed else S.no_entities()
        return d.withColumn("after_model", S.by_start(model.merge(F.col("after_rules"), found))).drop(*proposed)

    def finished(self, d: DataFrame, text_col: str, profiles: Sequence[str | Profile] | None = None, layers: Sequence[str] | None = None, min_confidence: float | None = None) -> DataFrame:
        """The result columns from the columns of ``layered``."""
        active = self._active(profiles)
        chosen = tuple(layers) if layers is not None else self.options.layers
        least = self.options.min_confidence if min_confidence is None else min_confidence
        text = F.coalesce(F.col(text_col), F.lit(""))
        sure = F.filter(self.calibrator.apply(F.col("after_model")), lambda e: e["confidence"] >= least)
        d = d.withColumn("entities", sure)
        d = d.withColumn("score", score.score(F.col("entities"), catalog.active_weights(active)))
        invoked = F.array(*[F.lit(x) for x in ("REGEX", "NER", "RULES") if x in chosen]).cast("array<string>")
        best = score.top(F.col("entities"))
        return d.withColumns(
            {
                "text_hash": score.text_hash(text),
                "sensitivity_level": score.level(F.col("score")),
                "category_groups_found": score.groups(F.col("entities")),
                "top_category": best["category"],
                "top_confidence": F.coalesce(best["confidence"], F.lit(0.0)),
                "entity_count": F.size("entities"),
                "layers_invoked": F.when(F.col("asked"), F.concat(invoked, F.array(F.lit("LLM")))).otherwise(invoked),
                "profile_ids": F.array(*[F.lit(p.id) for p in active]).cast("array<string>"),
                "routing_suggestion": score.route(F.col("entities"), F.col("score")),
            }
        ).drop("after_scan", "after_rules", "after_model", "asked")

    def analyze(self, df: DataFrame, text_col: str = "text", profiles: Sequence[str | Profile] | None = None, layers: Sequence[str] | None = None, min_confidence: float | None = None) -> DataFrame:
        """``df`` with the columns ``RESULT``. Columns of those names that ``df`` has are replaced."""
        result = (*RESULT, *["processing_time_ms"] * self.options.timed)
        plain = df.drop(*[c for c in df.columns if c in (*result, "scan_ms", "spans", "hits", "after_scan", "after_rules", "after_model", "asked")])
        d = self.layered(plain, text_col, profiles, layers, min_confidence, scan_too=False)
        return self.finished(d, text_col, profiles, layers, min_confidence).select(*plain.columns, *result)

    def analyze_texts(self, spark: SparkSession, texts: Sequence[str | None], tasks: int = 4, **how) -> DataFrame:
        """A row a text, with idx in the order given; a text that failed has error with its index."""
        if tasks < 1:
            raise ValueError("there must be a task")
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "idx int, text string")
        out = self.analyze(rows.repartition(tasks) if len(texts) > 1 else rows, **how)
        failure = F.when(F.col("error").isNotNull(), F.struct(F.col("idx").alias("index"), "error.error", "error.error_type"))
        return out.withColumn("error", failure).orderBy("idx")

    def redact(self, df: DataFrame, text_col: str = "text", profile: str | Profile | None = None, labels: Iterable[str] | None = None, salt: Column | str | None = None, created_at: Column | None = None, min_confidence: float | None = None) -> DataFrame:
        """``df`` with redacted and mapping. Without a salt each call draws its own."""
        p = self.registry.get(profile) if profile is not None else self.profiles[0]
        found = self.analyze(df, text_col, [p], min_confidence=min_confidence)
        return self._redacted(found, text_col, p, labels, salt, created_at).select(*df.columns, "redacted", "mapping")

    def _redacted(self, found: DataFrame, text_col: str, p: Profile, labels: Iterable[str] | None, salt: Column | str | None, created_at: Column | None) -> DataFrame:
        chosen = redact.resolve_labels(p.id, labels)
        salt = F.lit(secrets.token_hex(8)) if salt is None else F.lit(salt) if isinstance(salt, str) else salt
        done, mapping = redact.redact(F.coalesce(F.col(text_col), F.lit("")), F.col("entities"), redact.expand_labels(chosen), salt, p.id, chosen, created_at)
        return found.withColumns({"redacted": done, "mapping": mapping})

    @staticmethod
    def unredact(df: DataFrame, text_col: str = "redacted", mapping_col: str = "mapping", out_col: str = "restored") -> DataFrame:
        return df.withColumn(out_col, redact.unredact(F.col(text_col), F.col(f"{mapping_col}.tokens")))

    def analyze_documents(self, docs: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = chunk.CHUNK_CHARS, strictest_route: bool = False, **how) -> DataFrame:
        """A row a document: the roll-up of its chunks' results, with the hash of the whole text.

        A document is a key and a text, so texts that share a key or have none are documents of
        their own. Rows equal in both are one, whose entities stand once a row.
        """
        hashed = self._hashed(docs, text_col, "__document")
        parts = self.analyze(chunk.explode_chunks(hashed, key, text_col, size, ("__document",)), **how)
        out = chunk.rollup(parts, key, "__document")
        if strictest_route:
            out = out.withColumn("routing_suggestion", F.when(score.has_group(F.col("entities"), *score.LOCAL_GROUPS), "LOCAL_ONLY").when(score.has_group(F.col("entities"), "PHI") | (F.col("score") > 30), "REDACT_CLOUD").otherwise("CLOUD_OK"))
        return out.withColumnRenamed("__document", "text_hash")

    @staticmethod
    def _hashed(docs: DataFrame, text_col: str, name: str) -> DataFrame:
        return docs.withColumn(name, score.text_hash(F.coalesce(F.col(text_col), F.lit("")), 64))

    def redact_documents(self, docs: DataFrame, key: str = "doc_id", text_col: str = "text", profile: str | Profile | None = None, labels: Iterable[str] | None = None, salt: Column | str | None = None, created_at: Column | None = None, size: int = chunk.CHUNK_CHARS) -> DataFrame:
        """A row a row of ``docs``: key, text, redacted, mapping, from the entities of its chunks."""
        p = self.registry.get(profile) if profile is not None else self.profiles[0]
        found = self.analyze_documents(docs, key, text_col, size, profiles=[p]).select(F.col(key).alias("__key"), "text_hash", "entities")
        hashed = self._hashed(docs.select(key, text_col), text_col, "__document")
        found = hashed.join(found, (F.col("__document") == F.col("text_hash")) & F.col(key).eqNullSafe(F.col("__key")))
        return self._redacted(found, text_col, p, labels, salt, created_at).select(key, text_col, "redacted", "mapping")

    def required_models(self, tier: str = "fast") -> list[str]:
        return self.models.required(tier)
