"""Reading documents, labelled examples and options."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import bank
from spanloom.operators.model import ModelOptions
from spanloom.plans.engine import Options


class UnsupportedDocumentFormatError(ValueError):
    """A file of a format that isn't read."""

    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix
        self.hint = "convert it to text first" if suffix in bank.UNSUPPORTED else "only text and Markdown are read"
        super().__init__(f"{path}: {suffix or 'no suffix'} isn't supported; {self.hint}")


class ConfigError(ValueError):
    """A file of options that can't be used."""


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1)


def document_format(path: Column) -> Column:
    """text, markdown, or null if the format isn't read."""
    out = F.lit(None).cast("string")
    for s, name in bank.FORMATS.items():
        out = F.when(suffix(path) == s, name).otherwise(out)
    return out


def read_documents(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """path, format, text, error of files. Bytes that aren't UTF-8 become U+FFFD; strict: an unsupported file raises."""
    if strict and not any(c in path for c in "*?[{") and Path(path).is_file():
        name = Path(path)
        if name.suffix.lower() not in bank.FORMATS:
            raise UnsupportedDocumentFormatError(path, name.suffix.lower())
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = document_format(F.col("path"))
    problem = F.concat(F.lit("unsupported format: "), suffix(F.col("path")))
    text = F.when(kind.isNotNull(), F.make_valid_utf8(F.col("content").cast("string")))
    if strict:
        text = F.when(kind.isNull(), F.raise_error(problem).cast("string")).otherwise(text)
    return files.select("path", kind.alias("format"), text.alias("text"), F.when(kind.isNull(), problem).alias("error"))


EXAMPLE = "id string, text string, expected_entities array<struct<type:string,start:int,end:int>>, expected_level string, category string, notes string"


def parse_examples(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Labelled examples of JSON lines; blank lines and those that start with # are skipped."""
    trimmed = F.trim(F.regexp_replace(F.col(line_col), r"^\s+|\s+$", ""))
    rows = lines.where((trimmed != "") & ~trimmed.startswith("#")).select(F.from_json(trimmed, EXAMPLE).alias("e")).select("e.*")
    types = F.array_sort(F.array_distinct(F.transform(F.coalesce("expected_entities", F.array().cast("array<struct<type:string,start:int,end:int>>")), lambda x: x["type"])))
    return rows.select("id", "text", types.alias("expected"), F.coalesce("expected_level", F.lit("NONE")).alias("expected_level"), F.coalesce("category", F.lit("true_positive")).alias("category"), F.coalesce("notes", F.lit("")).alias("notes"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return parse_examples(spark.read.text(path))


#: Where options are looked for without a path.
OPTION_FILES = (Path("spanloom.yaml"), Path.home() / ".config" / "spanloom" / "spanloom.yaml")


def load_options(path: str | Path | None = None) -> Options:
    """Options of a YAML file; without a path of the first of ``OPTION_FILES`` that is there, else the general ones."""
    path = path or next((p for p in OPTION_FILES if p.exists()), None)
    if path is None:
        return Options()
    import yaml

    path = Path(path)
    if not path.exists():
        raise ConfigError(f"{path}: no such file")
    data = yaml.safe_load(path.read_text(encoding="utf-8"))
    if not isinstance(data, dict):
        raise ConfigError(f"{path}: options must be a mapping")
    layers, llm = data.get("layers", {}), data.get("layers", {}).get("llm", {})
    base = Options()
    return Options(
        profiles=tuple(data.get("profiles", base.profiles)),
        layers=tuple(name for name in base.layers if layers.get(name.lower(), True)),
        min_confidence=float(data.get("scoring", {}).get("min_confidence", base.min_confidence)),
        context_boost=float(data.get("scoring", {}).get("context_boost", base.context_boost)),
        model=ModelOptions(
            bool(llm.get("enabled", False)), llm.get("model", ""), llm.get("endpoint", "http://localhost:11434"), int(llm.get("timeout_ms", 5000)),
            int(llm.get("max_retries", 2)), llm.get("quality", "fast"), tuple(llm.get("ambiguous_score_range", (20, 60))),
        ),
    )
