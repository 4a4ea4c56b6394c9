"""Calibration of confidences by detection layer: linear, Platt and isotonic."""

from __future__ import annotations

import json
import logging
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.spans import put
from spanloom.functions.types import ENTITIES, LAYERS

METHODS = ("linear", "platt", "isotonic")
logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class LayerCalibration:
    method: str = "linear"
    params: dict = field(default_factory=dict)
    fitted_at: str = ""
    notes: str = ""


#: A model's confidences count less than those of the other layers.
DEFAULT = {"REGEX": LayerCalibration(params={"factor": 1.0}), "NER": LayerCalibration(params={"factor": 1.0}), "RULES": LayerCalibration(params={"factor": 1.0}), "LLM": LayerCalibration(params={"factor": 0.7})}


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def linear(raw: Column, factor: float = 1.0) -> Column:
    return clamp(raw * F.lit(float(factor)))


def platt(raw: Column, a: float, b: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(float(a)) * raw + F.lit(float(b))))


def isotonic(raw: Column, breakpoints: list) -> Column:
    """Linear between the points, level outside; as it is with fewer than two points."""
    points = sorted((float(x), float(y)) for x, y in breakpoints)
    if len(points) < 2:
        return raw
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:]))):
        inside = F.lit(y0) if x1 == x0 else F.lit(y0) + (raw - F.lit(x0)) * F.lit(y1 - y0) / F.lit(x1 - x0)
        out = F.when(raw <= x1, inside).otherwise(out)
    return clamp(F.when(raw <= points[0][0], F.lit(points[0][1])).otherwise(out))


def calibrated(raw: Column, how: LayerCalibration) -> Column:
    p = how.params
    if how.method == "linear":
        return linear(raw, p.get("factor", 1.0))
    if how.method == "platt":
        return platt(raw, p.get("a", -1.0), p.get("b", 0.0))
    return isotonic(raw, p.get("breakpoints", []))


class Calibrator:
    """How each layer's confidences are corrected; layers that aren't named stay as they are."""

    def __init__(self, layers: dict[str, LayerCalibration] | None = None, version: str = "1", datasets: tuple[str, ...] = (), notes: str = ""):
        self.layers = dict(DEFAULT if layers is None else layers)
        self.version, self.datasets, self.notes = version, tuple(datasets), notes

    def apply(self, entities: Column) -> Column:
        """The entities with corrected confidences; a changed one keeps its first value as raw_confidence."""

        changing = [layer for layer, how in self.layers.items() if how.method != "linear" or how.params.get("factor", 1.0) != 1.0]

        def one(e: Column) -> Column:
            raw = e["confidence"]
            value = raw
            for layer, how in self.layers.items():
                value = F.when(e["detection_layer"] == layer, calibrated(raw, how)).otherwise(value)
            kept = F.when(F.map_contains_key(e["metadata"], "raw_confidence"), e["metadata"]).otherwise(put(e["metadata"], ("raw_confidence", raw)))
            stays = raw.between(0.0, 1.0) & ~(e["detection_layer"].isin(*changing) if changing else F.lit(False))
            return F.when(stays | (value == raw), e).otherwise(e.withField("confidence", value).withField("metadata", kept))

        return F.transform(entities, one).cast(ENTITIES)

    def to_dict(self) -> dict:
        return {"version": self.version, "datasets": list(self.datasets), "notes": self.notes, "layers": {k: asdict(v) for k, v in self.layers.items()}}

    @classmethod
    def from_dict(cls, data: dict) -> Calibrator:
        layers = {}
        for name, x in data.get("layers", {}).items():
            if name in LAYERS and x.get("method") in METHODS:
                layers[name] = LayerCalibration(x["method"], x.get("params", {}), x.get("fitted_at", ""), x.get("notes", ""))
            else:
                logger.warning("calibration of %s is unknown and left out", name)
        return cls(layers, str(data.get("version", "1")), tuple(data.get("datasets", ())), data.get("notes", ""))

    def save(self, path: str | Path) -> None:
        Path(path).write_text(json.dumps(self.to_dict(), indent=2), encoding="utf-8")

    @classmethod
    def load(cls, path: str | Path) -> Calibrator:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))
