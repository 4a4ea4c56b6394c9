import pytest
from pyspark.sql import functions as F

from spanloom import bank
from spanloom.catalog import Pattern, Profile, ProfileNotFoundError, ProfileValidationError, Registry, Rule, profile_from_yaml
from spanloom.operators.model import LocalhostOnlyError, ModelOptions, check_local, is_answer
from spanloom.operators.scan import compiled, find, needed
from spanloom.plans.engine import RESULT, Engine, Options

TEXTS = [
    "Privileged and confidential: outside counsel reviewed Case No. 21-cv-12345.",
    "Patient John Smith, DOB: 01/02/1980, takes sertraline 50 mg daily.",
    "The picnic is on Saturday.",
    "",
    None,
]


@pytest.fixture(scope="module")
def results(spark):
    return [r.asDict() for r in Engine(["legal", "therapy"]).analyze_texts(spark, TEXTS).collect()]


def test_order_and_columns(results):
    assert [r["idx"] for r in results] == [0, 1, 2, 3, 4]
    assert set(RESULT) <= set(results[0])


def test_groups_and_routes(results):
    assert [r["routing_suggestion"] for r in results] == ["LOCAL_ONLY", "REDACT_CLOUD", "CLOUD_OK", "CLOUD_OK", "CLOUD_OK"]
    assert "PRIVILEGE" in results[0]["category_groups_found"] and results[1]["category_groups_found"] == ["PHI"]


def test_nothing_found(results):
    for r in results[2:]:
        assert (r["score"], r["sensitivity_level"], r["entity_count"], r["top_category"], r["top_confidence"]) == (0, "NONE", 0, None, 0.0)


def test_offsets_are_code_points(spark):
    text = "😀😀 MNPI é"
    e = Engine(["finance"]).analyze_texts(spark, [text]).first()["entities"][0]
    assert (e.start, e.end, text[e.start : e.end], e.text) == (3, 7, "MNPI", "MNPI")


def test_no_texts(spark):
    assert Engine(["legal"]).analyze_texts(spark, []).count() == 0


def test_tasks_must_be_positive(spark):
    with pytest.raises(ValueError):
        Engine(["legal"]).analyze_texts(spark, ["a"], tasks=0)


def test_columns_of_equal_names_are_replaced_and_others_kept(spark):
    df = spark.createDataFrame([(1, "MNPI", 7, "x")], "doc_id long, text string, score int, spans string")
    r = Engine(["finance"]).analyze(df).first()
    assert r["doc_id"] == 1 and r["score"] > 7 and "spans" not in r.asDict()


def test_repeated_rows(spark):
    df = spark.createDataFrame([(1, "MNPI"), (1, "MNPI")], "doc_id long, text string")
    a, b = Engine(["finance"]).analyze(df).collect()
    assert a == b


def test_failure_of_one_row_is_contained(spark):
    from spanloom.operators.scan import scan

    bad = Pattern("Bad", "BAD", "bad", 0.9, "x", context=(1,))  # no string: looking for it fails where the pattern matches
    out = scan(spark.createDataFrame([(0, "ax"), (1, "b")], "idx int, text string"), [bad], context_boost=0.1).orderBy("idx").collect()
    assert out[0].error.error_type == "AttributeError" and out[0].spans == [] and out[1].error is None


def test_layers(spark):
    text = "Privileged note: insider tip, MNPI."
    only = Engine(["legal", "finance"]).analyze_texts(spark, [text], layers=["REGEX"]).first()
    assert only["layers_invoked"] == ["REGEX"] and {e.detection_layer for e in only["entities"]} == {"REGEX"}
    rules = Engine(["legal", "finance"]).analyze_texts(spark, [text], layers=["RULES"]).first()
    assert {e.detection_layer for e in rules["entities"]} == {"RULES"}


def test_zero_confidence_is_a_value(spark):
    low = Profile("low", patterns=(Pattern("Low", "LOW", "low", 0.1, "zebra"),), categories=("LOW",))
    e = Engine([low])
    assert e.analyze_texts(spark, ["zebra"]).first()["entity_count"] == 0
    assert e.analyze_texts(spark, ["zebra"], min_confidence=0.0).first()["entity_count"] == 1


# ---- rules


def rule(**more) -> Profile:
    r = Rule("r", "PATIENT_NAME", "PHI", r"\bpatient\b", 0.93, 300, 0.07, context=("session",), **more)
    p = Pattern("P", "PATIENT_NAME", "p", 0.6, "patient")
    return Profile("p", patterns=(p,) if more.get("boost_only") is None else (), rules=(r,), weights={"PHI": 28.0}, categories=("PATIENT_NAME",))


def test_rule_boosts_an_entity_inside_its_match(spark):
    e = Engine([rule()]).analyze_texts(spark, ["the patient in session"]).first()["entities"]
    assert len(e) == 1 and e[0].confidence == 1.0 and e[0].metadata["boosted_by_rule"] == "r" and e[0].metadata["context_matched"] == "true"


def test_rule_mints(spark):
    e = Engine([rule(boost_only=False)]).analyze_texts(spark, ["the patient waits"]).first()["entities"]
    assert [(x.detection_layer, x.confidence, x.text) for x in e] == [("RULES", 0.93, "patient")]


def test_boost_only_rule_does_not_mint(spark):
    assert Engine([rule(boost_only=True)]).analyze_texts(spark, ["the patient waits"]).first()["entity_count"] == 0


def test_rules_against_a_loop(spark):
    """Sequential semantics, written as a loop, on made-up matches."""
    import random

    draw = random.Random(5)
    words = ["alpha", "beta", "alpha beta", "gamma"]
    patterns = tuple(Pattern("X", "C1" if i % 2 else "C2", str(i), 0.5 + i / 20, w) for i, w in enumerate(words))
    rules = tuple(Rule(f"r{i}", "C1" if i % 2 else "C2", "PHI", w, 0.5 + draw.random() / 2, 10, 0.1, i % 3 == 2, ("delta",)) for i, w in enumerate(["alpha", "alpha beta gamma", "beta", "beta gamma", "gamma"]))
    p = Profile("x", patterns=patterns, rules=rules, categories=("C1", "C2"))
    texts = [" ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(draw.randint(1, 9))) for _ in range(60)]
    got = Engine([p]).layered(spark.createDataFrame(list(enumerate(texts)), "idx int, text string"), min_confidence=0.0).orderBy("idx").collect()
    for row in got:
        spans, hits = find(row.text, compiled(patterns, rules), 0.0)
        old = [[e.category, e.start, e.end, e.confidence] for e in row.after_scan]
        new = []
        for h in sorted(hits, key=lambda h: (h["ord"], h["start"])):
            raised = [e for e in old if e[0] == h["category"] and e[1] >= h["start"] and e[2] <= h["end"] and e[3] < h["confidence"]]
            there = any(e[:3] == [h["category"], h["start"], h["end"]] for e in old + new)
            for e in raised:
                e[3] = h["confidence"]
            if not raised and not there and not h["boost_only"]:
                new.append([h["category"], h["start"], h["end"], h["confidence"]])
        assert [[e.category, e.start, e.end, e.confidence] for e in row.after_rules] == sorted(old + new, key=lambda e: e[1])


# ---- the scan


@pytest.mark.parametrize("pattern", bank.PATTERNS, ids=lambda p: p[1])
def test_needed_strings_are_in_every_match(pattern):
    import re

    samples = " ".join([*TEXTS[:3], "CEO Smith Dr. Reyes $5 million 5.5x EBITDA Fund IV insider list CPT 90837 PTSD trauma history 20% carry DOC-1234-567 BATES 123456 session 12 progress note"])
    for m in re.finditer(pattern[3], samples, re.IGNORECASE):
        assert any(x in m.group().lower() for x in needed(pattern[3]) or {""})


def test_prefilter_changes_nothing():
    import re

    patterns = tuple(Pattern(r, r, n, s, x) for r, n, s, x in bank.PATTERNS)
    text = " ".join([*TEXTS[:3], "The ſettlement agreement, MNPI, $5 million; CEO Smith; 5.5x EBITDA; Fund IV"])
    spans, _ = find(text, compiled(patterns, ()), 0.0)
    assert sorted((s["ord"], s["start"], s["end"]) for s in spans) == sorted((i, m.start(), m.end()) for i, p in enumerate(patterns) for m in re.finditer(p.regex, text, re.IGNORECASE))


# ---- catalog


def test_bank_sizes():
    assert (len(bank.PATTERNS), len(bank.RULES), len(bank.RECOGNIZERS), sum(map(len, bank.ENTITY_GROUPS.values())), len(bank.REDACTION_LABELS)) == (160, 20, 35, 50, 23)


def test_registry(spark):
    r = Registry()
    assert r.ids() == ["legal", "therapy", "therapy-pro", "finance"]
    assert r.get("vendor-legal").id == "legal" and r.get("vendor-therapy-pro").id == "therapy-pro"
    with pytest.raises(ProfileNotFoundError):
        r.get("nothing")
    r.register(Profile("own", rules=(Rule("a", "A", "PII", "a+"),)))
    assert r.listing(spark).count() == 5
    with pytest.raises(ProfileValidationError):
        Profile("bad", patterns=(Pattern("B", "B", "b", 1.0, "("),))


def test_yaml_profile(spark, tmp_path):
    path = tmp_path / "hr.yaml"
    path.write_text("id: hr\nscoring_weights: {CONFIDENTIAL: 20}\nrules:\n  - {id: pay, pattern: 'salary of \\$\\d+', category: PAY, category_group: CONFIDENTIAL, context_patterns: [offer]}\n")
    p = profile_from_yaml(path)
    assert (p.rules[0].confidence, p.rules[0].window, p.rules[0].boost, p.patterns) == (0.85, 200, 0.05, ())
    r = Engine([p]).analyze_texts(spark, ["The offer has a salary of $90."]).first()
    assert [(e.category, round(e.confidence, 2)) for e in r["entities"]] == [("PAY", 0.9)] and r["score"] == 18


# ---- the model


def ask(spark, raw, text="the patient's session notes mention Robin Vale, medication", **options):
    return Engine(["therapy"], Options(**options), client=lambda: lambda prompt: raw).analyze_texts(spark, [text]).first()


def test_model_adds_validated_spans(spark):
    raw = '{"detections": [{"category": "PROVIDER_NAME", "span_text": "Robin Vale", "confidence": 0.9}, {"category": "NOPE", "span_text": "the", "confidence": 0.9}, {"category": "PROVIDER_NAME", "span_text": "absent", "confidence": 0.9}]}'
    r = ask(spark, raw)
    assert r["layers_invoked"][-1] == "LLM"
    assert [(e.text, round(e.confidence, 2), e.metadata["raw_confidence"]) for e in r["entities"] if e.detection_layer == "LLM"] == [("Robin Vale", 0.63, "0.9")]


@pytest.mark.parametrize("raw", [None, "", "no json", "{}", '{"detections": null}'])
def test_bad_answers_add_nothing(spark, raw):
    assert not [e for e in ask(spark, raw)["entities"] if e.detection_layer == "LLM"]


def test_client_that_fails(spark):
    def client():
        def call(prompt):
            raise OSError("down")

        return call

    r = Engine(["therapy"], client=client).analyze_texts(spark, ["session notes only"]).first()
    assert r["entity_count"] == 1


def test_gate_keeps_privileged_texts_from_the_model(spark):
    def client():
        def call(prompt):
            return '{"detections": [{"category": "CASE_NUMBER", "span_text": "Privileged", "confidence": 1.0}]}'

        return call

    r = Engine(["legal"], Options(model=ModelOptions(between=(0, 100))), client=client).analyze_texts(spark, ["Privileged and confidential"]).first()
    assert "LLM" not in r["layers_invoked"]


def test_only_local_addresses():
    check_local("http://127.0.0.1:1")
    with pytest.raises(LocalhostOnlyError):
        check_local("https://models.example.com")
    with pytest.raises(LocalhostOnlyError):
        Engine(["therapy"], Options(model=ModelOptions(enabled=True, endpoint="http://10.0.0.1")))._client_maker()


def test_answer_form():
    assert is_answer('{"detections": []}') and not is_answer('{"detections": [{"category": "A", "span_text": "", "confidence": 1}]}')
    assert not is_answer('{"detections": [{"category": "A", "span_text": "a", "confidence": 2}]}')


# ---- redaction


@pytest.mark.parametrize("profile", ["legal", "therapy", "finance"])
def test_redaction_round_trip(spark, profile):
    rows = [(i, t) for i, t in enumerate([*TEXTS, "CEO Smith wrote to CEO Smith at a.b@c.org, SSN: 123-45-6789, Goldman Sachs."])]
    df = spark.createDataFrame(rows, "idx int, text string")
    out = Engine.unredact(Engine([profile]).redact(df, salt="s")).collect()
    assert all((r.text or "") == r.restored for r in out)


def test_tokens(spark):
    import re

    df = spark.createDataFrame([(1, "CEO Smith met CEO Smith.")], "idx int, text string")
    e = Engine(["legal"])
    a = e.redact(df).first()
    assert len(set(re.findall(r"\[[A-Za-z]+_[0-9a-f]{6}\]", a.redacted))) == 1 and "Smith" not in a.redacted
    assert a.redacted != e.redact(df).first().redacted
    assert e.redact(df, labels=["Email"]).first().redacted == "CEO Smith met CEO Smith."
    assert e.redact(df, labels=["EXECUTIVE_NAME"]).first().mapping.categories_redacted == ["EXECUTIVE_NAME"]


def test_earliest_target_wins(spark):
    from spanloom.operators.redact import targets

    e = "named_struct('text', '', 'category', 'A', 'category_group', 'PII', 'confidence', 1d, 'detection_layer', 'REGEX', 'start', {}, 'end', {}, 'metadata', map('a', 'b'))"
    df = spark.range(1).select(F.expr(f"array({e.format(4, 20)}, {e.format(0, 5)}, {e.format(0, 3)})").alias("e"))
    assert [(t.start, t.end) for t in df.select(targets(F.col("e"), ["A"]).alias("t")).first().t] == [(0, 5)]


# ---- documents


@pytest.mark.parametrize(("text", "size", "want"), [("A" * 400 + "\n\n" + "B" * 400, 500, [(0, 402), (402, 400)]), ("A" * 1200, 500, [(0, 500), (500, 500), (1000, 200)]), ("", 500, [(0, 0)]), (None, 500, [(0, 0)]), ("a\n\n" + "b" * 20, 10, [(0, 10), (10, 10), (20, 3)]), ("x" * 8 + "\n\n" + "y" * 10, 10, [(0, 10), (10, 10)])])
def test_chunks(spark, text, size, want):
    from spanloom.operators.chunk import explode_chunks

    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = explode_chunks(df, "doc_id", size=size).orderBy("chunk_index").collect()
    assert [(r.text_offset, len(r.text)) for r in got] == want and "".join(r.text for r in got) == (text or "")


def test_chunk_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        Engine(["legal"]).analyze_documents(spark.createDataFrame([(1, "a")], "doc_id long, text string"), size=0)


def test_document_offsets_and_worst_chunk(spark):
    text = "Nothing here.\n\n" * 40 + "Outside counsel. MNPI."
    r = Engine(["legal", "finance"]).analyze_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), size=200).first()
    assert r.score == 57 and r.routing_suggestion == "LOCAL_ONLY" and all(text[e.start : e.end] == e.text for e in r.entities) and len(r.text_hash) == 71


def test_repeated_documents(spark):
    df = spark.createDataFrame([(1, "MNPI"), (1, "MNPI"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.entity_count for r in Engine(["finance"]).analyze_documents(df).collect()} == {1: 2, 2: 0}


def test_document_redaction(spark):
    text = "Nothing.\n\n" * 30 + "Write to a@b.org."
    r = Engine(["legal"]).redact_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), size=100, salt="s").first()
    assert "a@b.org" not in r.redacted and r.redacted.startswith("Nothing.")


def test_documents_without_a_key_or_with_an_equal_one_stay_apart(spark):
    df = spark.createDataFrame([(None, "MNPI a@b.org"), (None, "nothing"), (None, None), (3, "MNPI"), (3, "x@y.org and MNPI")], "doc_id long, text string")
    got = Engine(["finance"]).analyze_documents(df).collect()
    assert sorted((r.doc_id or 0, r.entity_count) for r in got) == [(0, 0), (0, 0), (0, 2), (3, 1), (3, 2)] and len({r.text_hash for r in got}) == 5
    done = Engine(["legal"]).redact_documents(df, salt="s").collect()
    assert len(done) == 5 and not any("@" in (r.redacted or "") for r in done)


# ---- every pattern and rule


def test_samples_reach_every_pattern_and_rule():
    import re

    from spanloom.catalog import active_patterns, active_rules
    from spanloom.plans import queries as Q

    profiles = [Registry().get(p) for p in Q.EVERY]
    patterns, rules = active_patterns(profiles), active_rules(profiles)
    assert {(p.recognizer, p.name) for p in patterns} >= {x[:2] for x in bank.PATTERNS} and {r.id for r in rules} == {x[1] for x in bank.RULES}
    assert [p.name for i, p in enumerate(patterns) if not any(re.search(p.regex, x, re.IGNORECASE) for x in Q.PATTERN_TEXTS[3 * i : 3 * i + 2])] == []
    assert [r.id for i, r in enumerate(rules) if not any(re.search(r.regex, x, r.flags) for x in Q.RULE_TEXTS[3 * i : 3 * i + 2])] == []
    bank_of = compiled(tuple(patterns), tuple(rules))
    spans = [find(x, bank_of, 0.0)[0] for x in Q.PATTERN_TEXTS]
    assert {s["ord"] for row in spans for s in row} == set(range(len(patterns)))
    assert {h["ord"] for x in Q.RULE_TEXTS for h in find(x, bank_of, 0.0)[1]} == set(range(len(rules)))
