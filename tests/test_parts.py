import json
import math

import pytest
from pyspark.sql import functions as F

from spanloom.operators import calibrate, corpus, evaluate, score
from spanloom.operators.calibrate import Calibrator, LayerCalibration
from spanloom.plans.engine import Engine, Options
from spanloom.sources import files, sinks
from spanloom.streaming.events import analyze_arriving, progress

ENTITY = "named_struct('text', 'x', 'category', 'C', 'category_group', '{}', 'confidence', {}d, 'detection_layer', '{}', 'start', 0, 'end', 1, 'metadata', cast(map() as map<string,string>))"


def entities(*rows):
    return F.expr("array(" + ", ".join(ENTITY.format(*r) for r in rows) + ")") if rows else F.expr("slice(array(" + ENTITY.format("PII", 1, "NER") + "), 1, 0)")


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# ---- score


@pytest.mark.parametrize(("rows", "weights", "want"), [([], {}, 0), ([("PII", 0.5, "NER")], {"PII": 15.0}, 8), ([("PII", 0.5, "NER")], {"PII": 5.0}, 2), ([("PII", 0.5, "NER")], {}, 5), ([("PHI", 1.0, "NER")] * 9, {"PHI": 28.0}, 100)])
def test_score(spark, rows, weights, want):
    assert value(spark, score.score(entities(*rows), weights)) == want


@pytest.mark.parametrize(("points", "want"), [(0, "NONE"), (1, "LOW"), (20, "LOW"), (21, "MEDIUM"), (50, "MEDIUM"), (51, "HIGH"), (80, "HIGH"), (81, "CRITICAL"), (100, "CRITICAL")])
def test_level(spark, points, want):
    assert value(spark, score.level(F.lit(points))) == want


@pytest.mark.parametrize(("group", "points", "want"), [("PRIVILEGE", 1, "LOCAL_ONLY"), ("MNPI", 1, "LOCAL_ONLY"), ("PHI", 1, "REDACT_CLOUD"), ("PII", 30, "CLOUD_OK"), ("PII", 31, "REDACT_CLOUD")])
def test_route(spark, group, points, want):
    assert value(spark, score.route(entities((group, 1, "NER")), F.lit(points))) == want


# ---- calibration


@pytest.mark.parametrize("raw", [0.0, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 1.0])
def test_calibration_values(spark, raw):
    points = [(0.8, 0.7), (0.2, 0.1), (0.5, 0.6)]
    x = F.lit(raw)
    inside = lambda a, b, p, q: p + (raw - a) * (q - p) / (b - a)
    want = 0.1 if raw <= 0.2 else inside(0.2, 0.5, 0.1, 0.6) if raw <= 0.5 else inside(0.5, 0.8, 0.6, 0.7) if raw <= 0.8 else 0.7
    assert value(spark, calibrate.isotonic(x, points)) == pytest.approx(want)
    assert value(spark, calibrate.platt(x, -3.0, 1.0)) == pytest.approx(1 / (1 + math.exp(-3 * raw + 1)))
    assert value(spark, calibrate.linear(x, 1.5)) == pytest.approx(min(1, raw * 1.5))


def test_calibration_edges(spark):
    assert value(spark, calibrate.platt(F.lit(1.0), 1e6, 0.0)) == 0.0 and value(spark, calibrate.platt(F.lit(1.0), -1e6, 0.0)) == 1.0
    assert value(spark, calibrate.isotonic(F.lit(0.3), [(0.5, 0.9)])) == 0.3


def test_calibrator_keeps_the_first_value(spark):
    out = value(spark, Calibrator({"LLM": LayerCalibration(params={"factor": 0.5})}).apply(entities(("PII", 0.8, "LLM"), ("PII", 0.8, "NER"))))
    assert [(e.confidence, e.metadata.get("raw_confidence")) for e in out] == [(0.4, "0.8"), (0.8, None)]


def test_calibrator_file(tmp_path):
    path = tmp_path / "c.json"
    Calibrator(version="2", datasets=("a",)).save(path)
    assert Calibrator.load(path).to_dict() == Calibrator(version="2", datasets=("a",)).to_dict()
    data = json.loads(path.read_text())
    data["layers"] |= {"MAGIC": data["layers"]["LLM"], "NER": {"method": "other"}}
    assert set(Calibrator.from_dict(data).layers) == {"REGEX", "RULES", "LLM"}


# ---- evaluation


def test_metrics_of_nothing(spark):
    df = spark.createDataFrame([("a", "tn")], "dataset string, outcome string")
    r = evaluate.metrics(df, "dataset").first()
    assert (r.precision, r.recall, r.f1, r.tn) == (0.0, 0.0, 0.0, 1)


@pytest.mark.parametrize("n", [1, 2, 5, 19, 20, 37, 100])
def test_latency(spark, n):
    import random
    import statistics

    xs = [random.Random(n * 1000 + i).randint(0, 50) / 2 for i in range(n)]
    r = evaluate.latency(spark.createDataFrame([(x,) for x in xs], "ms double"), "ms").first()
    want = max(xs) if n < 20 else statistics.quantiles(xs, n=20)[18]
    assert r.median == statistics.median(xs) and r.p95 == pytest.approx(want)


def test_per_type(spark):
    df = spark.createDataFrame([("true_positive", ["A", "B"], ["A"]), ("true_negative", [], ["C"])], "category string, expected array<string>, detected array<string>")
    assert {r.type: (r.tp, r.fp, r.fn) for r in evaluate.per_type(df).collect()} == {"A": (1, 0, 0), "B": (0, 0, 1), "C": (0, 1, 0)}


def test_factor_search_prefers_the_smallest(spark):
    e = entities(("PII", 0.9, "REGEX"))
    df = spark.range(1).select(F.lit("d").alias("dataset"), F.array(F.lit("C")).alias("expected"), F.lit("true_positive").alias("category"), e.alias("entities"))
    r = evaluate.search_factors(df, ["REGEX"]).first()
    assert (r.factor, r.f1) == (0.6, 1.0)


# ---- made-up corpora


@pytest.mark.parametrize("domain", corpus.DOMAINS)
def test_corpus(spark, domain):
    a, b = (corpus.generate(spark, domain, 100, seed=1).collect() for _ in range(2))
    assert a == b and len({r.id for r in a}) == 100
    assert [sum(r.category == c for r in a) for c in corpus.SHARES] == [60, 20, 20]
    df = spark.createDataFrame(a)
    found = Engine([domain]).analyze(df).withColumn("detected", evaluate.detected_types(F.col("entities")))
    m = evaluate.metrics(evaluate.outcomes(found)).first()
    assert m.recall == 1.0 and m.fp == 0


def test_corpus_limits(spark):
    for bad in (lambda: corpus.generate(spark, "nothing"), lambda: corpus.generate(spark, "legal", 10)):
        with pytest.raises(ValueError):
            bad()


def test_chat_rows(spark):
    row = json.loads(corpus.generate(spark, "legal", 50).where("category = 'true_positive'").select(corpus.as_chat().alias("c")).first().c)
    assert [m["role"] for m in row["messages"]] == ["system", "user", "assistant"]
    assert json.loads(row["messages"][2]["content"])["detections"][0]["span_text"] == row["messages"][1]["content"]


def test_split(spark):
    parts = corpus.split(spark.range(25), ["id"]).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"train": 22, "validation": 3}


# ---- sources and sinks


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes(b"ok \xff\xfe end")
    (tmp_path / "b.md").write_text("# hi")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert rows["a.TXT"].text == b"ok \xff\xfe end".decode("utf-8", "replace") and rows["b.md"].format == "markdown"
    assert rows["c.pdf"].text is None and ".pdf" in rows["c.pdf"].error
    with pytest.raises(files.UnsupportedDocumentFormatError) as e:
        files.read_documents(spark, str(tmp_path / "c.pdf"), strict=True)
    assert e.value.suffix == ".pdf"


def test_examples(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('# note\n\n{"id": "1", "text": "t", "expected_entities": [{"type": "B"}, {"type": "A", "start": 0}]}\n{"id": "2", "text": "u", "category": "true_negative"}\n')
    rows = {r.id: r for r in files.read_examples(spark, str(tmp_path / "x.jsonl")).collect()}
    assert rows["1"].expected == ["A", "B"] and rows["1"].category == "true_positive" and rows["2"].expected == []


def test_options(tmp_path):
    assert files.load_options() == Options()
    path = tmp_path / "o.yaml"
    path.write_text("profiles: [finance]\nlayers: {ner: false, llm: {enabled: true, ambiguous_score_range: [0, 90]}}\nscoring: {min_confidence: 0.0}\n")
    o = files.load_options(path)
    assert (o.profiles, o.layers, o.min_confidence, o.model.between) == (("finance",), ("REGEX", "RULES"), 0.0, (0, 90))
    for bad in ("- a\n", None):
        path.write_text(bad) if bad else path.unlink()
        with pytest.raises(files.ConfigError):
            files.load_options(path)


def test_sinks(spark):
    r = Engine(["finance"]).analyze_texts(spark, ["MNPI", "nothing"])
    wire = [json.loads(x.w) for x in r.select(sinks.as_wire().alias("w")).collect()]
    assert "text" not in wire[0]["entities"][0] and wire[1]["top_category"] is None
    assert json.loads(r.select(sinks.as_json().alias("j")).first().j)["entities"][0]["text"] == "MNPI"
    assert r.select(sinks.as_summary().alias("s")).first().s.startswith("MEDIUM (29) | LOCAL_ONLY | 1 entities | MNPI_MARKER (0.97)")
    assert sinks.entity_table(r, "idx").first().entity == "MNPI"


def test_reports(spark, tmp_path):
    m = evaluate.metrics(spark.createDataFrame([("a", "tp"), ("a", "fp")], "dataset string, outcome string"), "dataset")
    assert m.select(sinks.report_lines(m).alias("x")).first().x == "a: precision 50.0%, recall 100.0%, F1 66.7% (TP 1 FP 1 FN 0 TN 0)"
    sinks.write_jsonl(m, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_times(spark):
    e = Engine(["finance"], Options(timed=True))
    r = e.analyze_texts(spark, ["MNPI"]).first()
    assert r.processing_time_ms > 0
    d = e.analyze_documents(spark.createDataFrame([(1, "MNPI " * 50)], "doc_id long, text string"), size=50).first()
    assert d.processing_time_ms > 0 and d.chunk_count == 5


def test_options_are_looked_for(tmp_path, monkeypatch):
    path = tmp_path / "spanloom.yaml"
    path.write_text("profiles: [finance]")
    monkeypatch.setattr(files, "OPTION_FILES", (tmp_path / "none.yaml", path))
    assert files.load_options().profiles == ("finance",)


# ---- streams


def test_progress(spark):
    df = spark.createDataFrame([(1, "Privileged note with counsel.")], "doc_id long, text string")
    rows = progress(Engine(["legal"]), df, "doc_id").orderBy("seq").collect()
    assert [(r.seq, r.layer, r.is_final) for r in rows] == [(0, "REGEX", False), (1, "RULES", False), (2, None, True)]
    assert rows[2].score > 0 and rows[0].score is None


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["MNPI", "nothing", "strictly confidential", None])]
    df = spark.createDataFrame(rows, "idx int, text string")
    df.write.parquet(str(tmp_path / "in"))
    e = Engine(["finance"])
    stream = analyze_arriving(e, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.select("idx", "score", "routing_suggestion").writeStream.outputMode("append").format("memory").queryName("arrived").start()
    q.processAllAvailable()
    q.stop()
    batch = e.analyze(df).select("idx", "score", "routing_suggestion")
    assert sorted(map(tuple, spark.table("arrived").collect())) == sorted(map(tuple, batch.collect()))
    with pytest.raises(ValueError):
        analyze_arriving(e, df)
