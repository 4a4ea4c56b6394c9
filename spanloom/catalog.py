"""Profiles, their recognizers and rules, and the registry that holds them.

A profile's parts are plain rows, so a profile from a YAML file or from code is as good
as a built-in one and nothing has to be imported on executors.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from spanloom import bank


class ProfileNotFoundError(KeyError):
    """No profile of that id."""


class ProfileValidationError(ValueError):
    """A profile whose parts don't fit."""


@dataclass(frozen=True)
class Pattern:
    recognizer: str
    category: str
    name: str
    score: float
    regex: str
    context: tuple[str, ...] = ()
    layer: str = "REGEX"


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    group: str
    regex: str
    confidence: float = 0.85
    window: int = 200
    boost: float = 0.05
    boost_only: bool = False
    context: tuple[str, ...] = ()
    enabled: bool = True
    flags: int = re.IGNORECASE
    name: str = ""
    description: str = ""


@dataclass(frozen=True)
class Profile:
    id: str
    name: str = ""
    version: str = "0.1.0"
    description: str = ""
    patterns: tuple[Pattern, ...] = ()
    rules: tuple[Rule, ...] = ()
    weights: dict[str, float] = field(default_factory=dict)
    categories: tuple[str, ...] = ()
    model_categories: tuple[str, ...] = ()

    def __post_init__(self):
        for x in (*self.patterns, *self.rules):
            try:
                re.compile(x.regex)
            except re.error as e:
                raise ProfileValidationError(f"{self.id}: {x.regex!r}: {e}") from e
        if unknown := [r.id for r in self.rules if r.group not in bank.GROUP_PRIORITY] + [g for g in self.weights if g not in bank.GROUP_PRIORITY]:
            raise ProfileValidationError(f"{self.id}: unknown group in {unknown}")


def _patterns(profile: str) -> tuple[Pattern, ...]:
    own = {name: (category, words) for p, name, category, words in bank.RECOGNIZERS if p == profile}
    return tuple(Pattern(r, own[r][0], name, score, regex, own[r][1]) for r, name, score, regex in bank.PATTERNS if r in own)


def _rules(profile: str) -> tuple[Rule, ...]:
    return tuple(Rule(i, c, g, regex, conf, window, boost, only, context) for p, i, c, g, conf, window, boost, only, context, regex in bank.RULES if p == profile)


def _builtin(row: tuple) -> Profile:
    i, name, description, weights = row
    patterns = _patterns("therapy") + _patterns(i) if i == "therapy-pro" else _patterns(i)
    return Profile(i, name, "0.1.0", description, patterns, _rules(i), weights, tuple(dict.fromkeys(p.category for p in patterns)), bank.MODEL_CATEGORIES.get(i, ()))


class Registry:
    """Profiles by id. An id with a prefix, as in ``vendor-legal``, finds the profile ``legal``."""

    def __init__(self, profiles: Iterable[Profile] = ()):
        self._profiles = {p.id: p for p in (*map(_builtin, bank.PROFILES), *profiles)}

    def register(self, profile: Profile) -> None:
        """Add a profile, or put it in the place of one of the same id."""
        self._profiles[profile.id] = profile

    def ids(self) -> list[str]:
        return list(self._profiles)

    def get(self, profile: str | Profile) -> Profile:
        if isinstance(profile, Profile):
            return profile
        known = [profile, *(profile[m.end() :] for m in re.finditer("-", profile))]
        for k in known:
            if k in self._profiles:
                return self._profiles[k]
        raise ProfileNotFoundError(f"profile {profile!r} isn't registered; there are {', '.join(self._profiles)}")

    def listing(self, spark: SparkSession) -> DataFrame:
        """A row a profile: id, name, version, description, categories, groups."""
        rows = [(p.id, p.name, p.version, p.description, list(p.categories), sorted(p.weights)) for p in self._profiles.values()]
        return spark.createDataFrame(rows, "id string, name string, version string, description string, categories array<string>, groups array<string>")

    def patterns(self, spark: SparkSession) -> DataFrame:
        """A row a pattern of a profile."""
        rows = [(p.id, i, x.recognizer, x.category, x.name, float(x.score), x.regex) for p in self._profiles.values() for i, x in enumerate(p.patterns)]
        return spark.createDataFrame(rows, "profile string, ord int, recognizer string, category string, name string, score double, regex string")

    def rules(self, spark: SparkSession) -> DataFrame:
        """A row a rule of a profile."""
        rows = [(p.id, i, x.id, x.category, x.group, float(x.confidence), x.window, float(x.boost), x.boost_only, list(x.context), x.regex) for p in self._profiles.values() for i, x in enumerate(p.rules)]
        return spark.createDataFrame(rows, "profile string, ord int, id string, category string, group string, confidence double, window int, boost double, boost_only boolean, context array<string>, regex string")


def active_patterns(profiles: list[Profile], hooks: Iterable[Pattern] = ()) -> list[Pattern]:
    """The patterns that profiles ask for, in order, each once, then the generic ones."""
    asked = {c for p in profiles for c in p.categories} | set(bank.GENERIC_ASKED)
    generic = [Pattern(r, c, n, s, x) for r, c, n, s, x in bank.GENERIC_PATTERNS] if profiles else []
    return [p for p in dict.fromkeys([*(x for p in profiles for x in p.patterns), *hooks, *generic]) if p.category in asked]


def active_rules(profiles: list[Profile]) -> list[Rule]:
    return [r for p in profiles for r in p.rules if r.enabled]


def active_weights(profiles: list[Profile]) -> dict[str, float]:
    """The greatest weight of each group."""
    out: dict[str, float] = {}
    for p in profiles:
        for g, w in p.weights.items():
            out[g] = max(w, out.get(g, w))
    return out


def profile_from_yaml(path: str | Path) -> Profile:
    """A profile of rules only, from a YAML file."""
    import yaml

    data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(data, dict) or "id" not in data:
        raise ProfileValidationError(f"{path}: a profile needs an id")
    try:
        rules = tuple(
            Rule(
                r["id"], r["category"], r["category_group"], r["pattern"], float(r.get("confidence", 0.85)), int(r.get("context_window", 200)),
                float(r.get("context_confidence_boost", 0.05)), False, tuple(r.get("context_patterns", ())), name=r.get("name", r["id"]), description=r.get("description", ""),
            )
            for r in data.get("rules", [])
        )
    except KeyError as e:
        raise ProfileValidationError(f"{path}: a rule lacks {e}") from e
    weights = {g: float(w) for g, w in data.get("scoring_weights", {}).items()}
    return Profile(data["id"], data.get("name", data["id"]), str(data.get("version", "0.1.0")), data.get("description", ""), (), rules, weights, tuple(r.category for r in rules))


class ModelRegistry:
    """Model names by role and tier; an override by role wins."""

    def __init__(self, overrides: dict[str, str] | None = None):
        self._overrides = dict(overrides or {})

    def _tier(self, tier: str) -> dict[str, str]:
        if tier not in bank.MODEL_TIERS:
            raise ValueError(f"unknown tier {tier!r}; there are {', '.join(bank.MODEL_TIERS)}")
        return bank.MODEL_TIERS[tier]

    def get(self, role: str, tier: str = "fast") -> str:
        if role in self._overrides:
            return self._overrides[role]
        roles = self._tier(tier)
        if role not in roles:
            raise KeyError(f"tier {tier!r} has no model for the role {role!r}")
        return roles[role]

    def required(self, tier: str = "fast") -> list[str]:
        return list(dict.fromkeys(self._overrides.get(role, model) for role, model in self._tier(tier).items()))
