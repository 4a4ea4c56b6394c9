"""The queries of this repository over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.catalog import Pattern, Profile, Registry, active_patterns, active_rules, active_weights
from spanloom.functions import spans as S
from spanloom.functions.types import ENTITIES
from spanloom.operators import calibrate, chunk, corpus, evaluate, model, redact, score
from spanloom.operators.scan import dealt, scan, spread
from spanloom.plans import oracle as O
from spanloom.plans import samples
from spanloom.plans.engine import Engine, Options
from spanloom.sources import files, sinks
from spanloom.streaming.events import progress

ALL = ["legal", "therapy", "finance"]
PRO = ["legal", "therapy-pro", "finance"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: a text an order."""
    return dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).selectExpr("o_orderkey AS doc_id", f"{O.TEXT} AS text")


def thousandths(c: Column) -> Column:
    return F.round(c * 1000).cast("int")


def shown(e: Column) -> Column:
    return F.concat(e["category"], F.lit("@"), e["start"].cast("string"), F.lit("-"), e["end"].cast("string"), F.lit(":"), thousandths(e["confidence"]).cast("string"), e["detection_layer"])


def result_row(df: DataFrame) -> DataFrame:
    """The columns of the SQL's result."""
    return df.select(
        "doc_id", "score", F.col("sensitivity_level").alias("level"), F.col("routing_suggestion").alias("route"), F.col("entity_count").alias("n"), "top_category",
        F.array_join("category_groups_found", ",").alias("groups"), F.array_join(F.transform("entities", shown), ";").alias("entities"),
    )


RESULT = "SELECT doc_id, score, level, route, n, top_category, groups, entities FROM result"

# ---- the scan


def _scan_query(profile: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = scan(sentences(spark, sf_dir), active_patterns([Registry().get(profile)]), least=0.5)
        return d.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.ord").alias("ord"), F.col("s.category").alias("category"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), thousandths(F.col("s.confidence")).alias("confidence"))

    return run


for _p in ("legal", "therapy", "therapy-pro", "finance"):
    query(f"scan_spans_{_p.replace('-', '_')}", O.sql(O.scan_ctes([_p]), 'SELECT doc_id, ord, category, s AS start, CAST(e AS INTEGER) AS "end", CAST(round(confidence * 1000) AS INTEGER) AS confidence FROM raw'))(_scan_query(_p))

#: A profile for the made-up documents, of expressions that mean the same in every engine.
CORPUS = (
    Pattern("Corpus", "EMAIL_ADDRESS", "email", 0.9, r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"),
    Pattern("Corpus", "IP_ADDRESS", "ip", 0.8, r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
    Pattern("Corpus", "CREDIT_CARD", "card", 0.7, r"[0-9]{16}"),
    Pattern("Corpus", "LICENSE_LINE", "license", 0.6, r"licensed under[^\n]*"),
)


def _corpus_sql(table: str, key: str, text: str) -> str:
    parts = [O.matches(p.regex, f"{O.quoted(p.category)} AS category") for p in CORPUS]
    return O.sql([f"t AS MATERIALIZED (SELECT {key} AS doc_id, {text} AS text FROM {table})", "raw AS (" + " UNION ALL ".join(parts) + ")"], 'SELECT doc_id, category, s AS start, CAST(s + length(v) AS INTEGER) AS "end", v AS found FROM raw')


def _scan_table(df: DataFrame) -> DataFrame:
    d = scan(df, list(CORPUS))
    return d.select("doc_id", "text", F.explode("spans").alias("s")).select("doc_id", F.col("s.category").alias("category"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), S.cut(F.col("text"), F.col("s.start"), F.col("s.end")).alias("found"))


@query("scan_spans_corpus", _corpus_sql("documents", "doc_id", "text"))
def scan_spans_corpus(spark, sf_dir):
    return _scan_table(spread(read(spark, sf_dir, "documents").select("doc_id", "text")))


@query("scan_spans_pages", _corpus_sql("pages", "page_id", "html"))
def scan_spans_pages(spark, sf_dir):
    return _scan_table(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


#: A turn with its speaker's address in front.
_TURN = "concat(role, ' mail', CAST(conv_id AS STRING), '@example.org: ', text)"


@query("scan_spans_conversations", _corpus_sql("conversations", "conv_id * 1000 + turn", _TURN))
def scan_spans_conversations(spark, sf_dir):
    return _scan_table(read(spark, sf_dir, "conversations").selectExpr("conv_id * 1000 + turn AS doc_id", f"{_TURN} AS text"))


EVERY = ["legal", "therapy", "therapy-pro", "finance"]


def sample_texts(regexes: list[str], words: list[tuple[str, ...]]) -> list[str]:
    """For each expression: what it matches, another alternative beside a context word, and the first inside a longer word."""
    out = []
    for regex, context in zip(regexes, words):
        first, second = samples.example(regex), samples.example(regex, 1)
        out += [f"Note: {first} .", f"{(context or ('as',))[0]} - {second} , see 12", f"x{first}x"]
    return out


PATTERN_TEXTS = sample_texts([p.regex for p in active_patterns([Registry().get(p) for p in EVERY])], [p.context for p in active_patterns([Registry().get(p) for p in EVERY])])
RULE_TEXTS = sample_texts([r.regex for r in active_rules([Registry().get(p) for p in EVERY])], [r.context for r in active_rules([Registry().get(p) for p in EVERY])])


def _samples(spark: SparkSession, sf_dir: str, texts: list[str]) -> DataFrame:
    """doc_id, text: one of the texts an order, in turn."""
    one = F.element_at(F.array(*map(F.lit, texts)), (F.col("o_orderkey") % len(texts) + 1).cast("int"))
    return dealt(read(spark, sf_dir, "orders").select("o_orderkey")).select(F.col("o_orderkey").alias("doc_id"), one.alias("text"))


def _samples_sql(texts: list[str]) -> str:
    return f"t AS MATERIALIZED (SELECT o_orderkey AS doc_id, list_extract([{', '.join(map(O.quoted, texts))}], CAST(o_orderkey % {len(texts)} + 1 AS INTEGER)) AS text FROM orders)"


@query("pattern_samples", O.sql(O.scan_ctes(EVERY, 0.0, _samples_sql(PATTERN_TEXTS)), 'SELECT doc_id, ord, category, s AS start, CAST(e AS INTEGER) AS "end", CAST(round(confidence * 1000) AS INTEGER) AS confidence FROM raw'))
def pattern_samples(spark, sf_dir):
    d = scan(_samples(spark, sf_dir, PATTERN_TEXTS), active_patterns([Registry().get(p) for p in EVERY]))
    s = F.col("s")
    return d.select("doc_id", F.explode("spans").alias("s")).select("doc_id", s["ord"].alias("ord"), s["category"].alias("category"), s["start"].alias("start"), s["end"].alias("end"), thousandths(s["confidence"]).alias("confidence"))


@query("rule_samples", O.sql([_samples_sql(RULE_TEXTS), *O.hit_ctes(EVERY)], 'SELECT doc_id, rule, category, s AS start, CAST(e AS INTEGER) AS "end", context, CAST(round(conf * 1000) AS INTEGER) AS confidence FROM hits'))
def rule_samples(spark, sf_dir):
    d = scan(_samples(spark, sf_dir, RULE_TEXTS), [], active_rules([Registry().get(p) for p in EVERY]))
    h = F.col("h")
    return d.select("doc_id", F.explode("hits").alias("h")).select("doc_id", h["rule"].alias("rule"), h["category"].alias("category"), h["start"].alias("start"), h["end"].alias("end"), h["context"].alias("context"), thousandths(h["confidence"]).alias("confidence"))


@query("analyze_samples", O.sql(O.results(PRO, source=_samples_sql(PATTERN_TEXTS)), RESULT))
def analyze_samples(spark, sf_dir):
    return result_row(Engine(PRO).analyze(_samples(spark, sf_dir, PATTERN_TEXTS)))


@query("dedup_overlaps", O.sql([*O.scan_ctes(ALL), *O.dedup_ctes()], 'SELECT doc_id, category, s AS start, CAST(e AS INTEGER) AS "end", CAST(round(confidence * 1000) AS INTEGER) AS confidence, v AS found FROM kept'))
def dedup_overlaps(spark, sf_dir):
    d = Engine(ALL).layered(sentences(spark, sf_dir), layers=["REGEX"])
    e = F.col("e")
    return d.select("doc_id", F.explode("after_scan").alias("e")).select("doc_id", e["category"].alias("category"), e["start"].alias("start"), e["end"].alias("end"), thousandths(e["confidence"]).alias("confidence"), e["text"].alias("found"))


@query("group_lookup", O.sql(O.scan_ctes(ALL), f"SELECT category, {O.group()} AS grp, CAST({O.priority(O.group())} AS INTEGER) AS priority, count(*) AS n FROM raw GROUP BY category"))
def group_lookup(spark, sf_dir):
    d = scan(sentences(spark, sf_dir), active_patterns([Registry().get(p) for p in ALL]), least=0.5)
    g = S.entity_group(F.col("category"))
    return d.select(F.explode("spans.category").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")).select("category", g.alias("grp"), S.priority(g).alias("priority"), "n")


# ---- the rules


@query("rule_context", O.sql([O.ORDERS, *O.hit_ctes(["legal", "therapy-pro", "finance"])], 'SELECT doc_id, rule, category, s AS start, CAST(e AS INTEGER) AS "end", context, CAST(round(conf * 1000) AS INTEGER) AS confidence FROM hits'))
def rule_context(spark, sf_dir):
    d = scan(sentences(spark, sf_dir), [], active_rules([Registry().get(p) for p in ("legal", "therapy-pro", "finance")]))
    h = F.col("h")
    return d.select("doc_id", F.explode("hits").alias("h")).select("doc_id", h["rule"].alias("rule"), h["category"].alias("category"), h["start"].alias("start"), h["end"].alias("end"), h["context"].alias("context"), thousandths(h["confidence"]).alias("confidence"))


def _after_rules(spark, sf_dir) -> DataFrame:
    e = F.col("e")
    d = Engine(PRO).layered(sentences(spark, sf_dir), scan_too=False).select("doc_id", F.explode("after_rules").alias("e"))
    return d.select("doc_id", e["category"].alias("category"), e["category_group"].alias("grp"), e["start"].alias("start"), e["end"].alias("end"), thousandths(e["confidence"]).alias("confidence"), e["detection_layer"].alias("layer"), e["metadata"].alias("metadata"))


_ENTS = 'SELECT doc_id, category, grp, s AS start, CAST(e AS INTEGER) AS "end", CAST(round(confidence * 1000) AS INTEGER) AS confidence FROM ents'


@query("rule_boost", O.sql(O.entities(PRO), f"{_ENTS} WHERE layer = 'REGEX'"))
def rule_boost(spark, sf_dir):
    return _after_rules(spark, sf_dir).where("layer = 'REGEX'").drop("layer", "metadata")


@query("rule_mint", O.sql(O.entities(PRO), f"{_ENTS} WHERE layer = 'RULES'"))
def rule_mint(spark, sf_dir):
    return _after_rules(spark, sf_dir).where("layer = 'RULES'").drop("layer", "metadata")


# ---- results


def _analyze_query(profiles: list[str], least: float = 0.5):
    return lambda spark, sf_dir: result_row(Engine(profiles).analyze(sentences(spark, sf_dir), min_confidence=least))


query("analyze_legal", O.sql(O.results(["legal"]), RESULT))(_analyze_query(["legal"]))
query("analyze_therapy", O.sql(O.results(["therapy"]), RESULT))(_analyze_query(["therapy"]))
query("analyze_therapy_pro", O.sql(O.results(["therapy-pro"]), RESULT))(_analyze_query(["therapy-pro"]))
query("analyze_finance", O.sql(O.results(["finance"]), RESULT))(_analyze_query(["finance"]))
query("analyze_multi_profile", O.sql(O.results(ALL), RESULT))(_analyze_query(ALL))
query("min_confidence_filter", O.sql(O.results(ALL, 0.93), RESULT))(_analyze_query(ALL, 0.93))


@query("level_routing", O.sql(O.results(ALL), "SELECT level, route, count(*) AS n, min(score) AS low, max(score) AS high FROM result GROUP BY level, route"))
def level_routing(spark, sf_dir):
    r = Engine(ALL).analyze(sentences(spark, sf_dir))
    return r.groupBy(F.col("sensitivity_level").alias("level"), F.col("routing_suggestion").alias("route")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high"))


@query("layer_subset", O.sql([*O.scan_ctes(ALL), *O.dedup_ctes(), "hits AS (SELECT NULL::BIGINT AS doc_id, '' AS category, 0 AS s, 0 AS e, 0::DOUBLE AS conf, 0 AS k, false AS boost_only, '' AS grp, '' AS v WHERE false)", *O.rule_ctes(), *O.result_ctes(ALL)], RESULT))
def layer_subset(spark, sf_dir):
    return result_row(Engine(ALL).analyze(sentences(spark, sf_dir), layers=["REGEX"]))


@query("top_entity", O.sql(O.results(ALL), "SELECT doc_id, top_category FROM result WHERE n > 0"))
def top_entity(spark, sf_dir):
    return Engine(ALL).analyze(sentences(spark, sf_dir)).where("entity_count > 0").select("doc_id", "top_category")


@query("text_hash", "SELECT doc_id, 'sha256:' || substr(sha256(text), 1, 16) AS text_hash, 'sha256:' || sha256(text) AS document_hash FROM documents")
def text_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", score.text_hash(F.col("text")).alias("text_hash"), score.text_hash(F.col("text"), 64).alias("document_hash"))


@query("weight_merge", "SELECT * FROM (VALUES ('CONFIDENTIAL', 10.0::DOUBLE), ('MNPI', 30.0::DOUBLE), ('PHI', 32.0::DOUBLE), ('PII', 15.0::DOUBLE), ('PRIVILEGE', 30.0::DOUBLE)) AS w(grp, weight)")
def weight_merge(spark, sf_dir):
    return spark.createDataFrame(sorted(active_weights([Registry().get(p) for p in ("legal", "therapy", "therapy-pro", "finance")]).items()), "grp string, weight double")


@query("profile_listing", "SELECT * FROM (VALUES ('legal', 10, 'CONFIDENTIAL,PII,PRIVILEGE', 39, 4), ('therapy', 10, 'CONFIDENTIAL,PHI,PII', 40, 4), ('therapy-pro', 14, 'CONFIDENTIAL,PHI,PII', 77, 8), ('finance', 10, 'CONFIDENTIAL,MNPI,PII', 44, 4)) AS p(id, n_categories, groups, n_patterns, n_rules)")
def profile_listing(spark, sf_dir):
    r = Registry()
    p, q = (x.groupBy(F.col("profile").alias("id")).agg(F.count(F.lit(1)).cast("int").alias(n)) for x, n in ((r.patterns(spark), "n_patterns"), (r.rules(spark), "n_rules")))
    return r.listing(spark).select("id", F.size("categories").alias("n_categories"), F.array_join("groups", ",").alias("groups")).join(p, "id").join(q, "id")


# ---- the model

#: What a model would say of the texts, as one answer for all.
ANSWER = '{"detections": [{"category": "PROVIDER_NAME", "span_text": "Robin Vale", "confidence": 0.9, "reasoning": "a name"}, {"category": "SESSION_MARKER", "span_text": "session notes", "confidence": 1.0}, {"category": "OTHER", "span_text": "The", "confidence": 0.9}, {"category": "MEDICATION", "span_text": "not there", "confidence": 0.9}, {"category": "MEDICATION", "span_text": "medication", "confidence": 0.8, "reasoning": ""}]}'


@query("llm_gate", O.sql(O.results(["therapy"]), "SELECT doc_id, score, score BETWEEN 20 AND 60 AND NOT contains(groups, 'PRIVILEGE') AND NOT contains(groups, 'MNPI') AS asked FROM result"))
def llm_gate(spark, sf_dir):
    e = Engine(["therapy"])
    d = e.layered(sentences(spark, sf_dir))
    points = score.score(F.col("after_rules"), active_weights(e.profiles))
    return d.select("doc_id", points.alias("score"), model.gate(F.col("after_rules"), points).alias("asked"))


_PROPOSED = (
    "said AS (SELECT * FROM (VALUES (1, 'PROVIDER_NAME', 'Robin Vale', 0.9::DOUBLE), (2, 'SESSION_MARKER', 'session notes', 1.0::DOUBLE), (5, 'MEDICATION', 'medication', 0.8::DOUBLE)) AS a(i, category, span, confidence))",
    "asked AS (SELECT doc_id, text FROM result WHERE score BETWEEN 20 AND 60 AND NOT contains(groups, 'PRIVILEGE') AND NOT contains(groups, 'MNPI'))",
    "placed AS (SELECT doc_id, a.*, CAST(instr(text, span) - 1 AS INTEGER) AS s, CAST(instr(text, span) - 1 + length(span) AS INTEGER) AS e FROM asked, said a WHERE contains(text, span))",
    "merged AS (SELECT p.* FROM placed p WHERE NOT EXISTS (SELECT 1 FROM ents x WHERE x.doc_id = p.doc_id AND x.category = p.category AND p.s < x.e AND x.s < p.e))",
)


@query("llm_merge", O.sql([*O.results(["therapy"]), *_PROPOSED], "SELECT doc_id, category, s AS start, CAST(e AS INTEGER) AS \"end\", CAST(round(confidence * 700) AS INTEGER) AS confidence, span AS found FROM merged WHERE confidence * 0.7 >= 0.5"))
def llm_merge(spark, sf_dir):
    said = ANSWER
    r = Engine(["therapy"], client=lambda: lambda prompt: said).analyze(sentences(spark, sf_dir))
    e = F.col("e")
    # The inner explode would have the entities worked out for a filter of its own.
    found = r.select("doc_id", F.explode_outer("entities").alias("e")).where(e["detection_layer"] == "LLM")
    return found.select("doc_id", e["category"].alias("category"), e["start"].alias("start"), e["end"].alias("end"), thousandths(e["confidence"]).alias("confidence"), e["text"].alias("found"))


@query("category_narrowing", O.sql(O.results(["therapy"]), "SELECT t.doc_id, array_to_string(list_sort(list_filter(['CLINICAL_RISK_FLAG', 'DATE_OF_BIRTH', 'DIAGNOSIS_CODE', 'INSURANCE_ID', 'MEDICATION', 'PATIENT_NAME', 'PROVIDER_NAME', 'PSYCHOTHERAPY_NOTE_MARKER', 'SESSION_MARKER', 'SSN'], lambda x: NOT list_contains(coalesce(cats, []), x))), ',') AS missing FROM t LEFT JOIN sums USING (doc_id)"))
def category_narrowing(spark, sf_dir):
    e = Engine(["therapy"])
    return e.layered(sentences(spark, sf_dir)).select("doc_id", F.array_join(F.array_sort(model.narrowed(F.col("after_rules"), e.profiles[0].model_categories)), ",").alias("missing"))


# ---- calibration

_RAW = "(event_id % 1000) / 1000.0"
POINTS = [[0.2, 0.1], [0.5, 0.6], [0.8, 0.7]]


def _calibrated(how: calibrate.LayerCalibration):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, "events").select("event_id", F.round(calibrate.calibrated(F.expr(f"cast({_RAW} as double)"), how), 9).alias("calibrated"))

    return run


_CAL = "SELECT event_id, round({}, 9) AS calibrated FROM (SELECT event_id, CAST((event_id % 1000) / 1000.0 AS DOUBLE) AS raw FROM events)"
query("calibrate_linear", _CAL.format("greatest(0, least(1, raw * 1.4::DOUBLE))"))(_calibrated(calibrate.LayerCalibration("linear", {"factor": 1.4})))
query("calibrate_platt", _CAL.format("1 / (1 + exp(-4.0::DOUBLE * raw + 1.5::DOUBLE))"))(_calibrated(calibrate.LayerCalibration("platt", {"a": -4.0, "b": 1.5})))
query("calibrate_isotonic", _CAL.format("CASE WHEN raw <= 0.2 THEN 0.1 WHEN raw <= 0.5 THEN 0.1 + (raw - 0.2::DOUBLE) * 0.5::DOUBLE / 0.3::DOUBLE WHEN raw <= 0.8 THEN 0.6::DOUBLE + (raw - 0.5::DOUBLE) * 0.1::DOUBLE / 0.3::DOUBLE ELSE 0.7 END"))(_calibrated(calibrate.LayerCalibration("isotonic", {"breakpoints": POINTS})))


# ---- redaction

SALT = "00112233aabbccdd"
#: The types that the profile legal redacts, by label.
_LABELS = {c: label for label in redact.resolve_labels("legal", None) for c in redact.expand_labels([label])}
_TARGETS = [
    "wanted AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC, origin, place) AS n FROM sure WHERE category IN (" + ", ".join(map(O.quoted, _LABELS)) + "))",
    "sweep AS (SELECT doc_id, n, s, e, v, category, true AS stays, e AS far FROM wanted WHERE n = 1 UNION ALL SELECT x.doc_id, x.n, x.s, x.e, x.v, x.category, x.s >= y.far, CASE WHEN x.s >= y.far THEN x.e ELSE y.far END FROM sweep y JOIN wanted x ON x.doc_id = y.doc_id AND x.n = y.n + 1)",
    "tokens AS (SELECT *, '[' || CASE category " + " ".join(f"WHEN {O.quoted(c)} THEN {O.quoted(x)}" for c, x in _LABELS.items()) + f" END || '_' || substr(sha256('{SALT}' || v), 1, 6) || ']' AS token, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS behind FROM sweep WHERE stays)",
    "spliced AS (SELECT doc_id, string_agg(substr(text, behind + 1, s - behind) || token, '' ORDER BY s) AS head, max(e) AS far, string_agg(DISTINCT token || '=' || v, ';' ORDER BY token || '=' || v) AS mapping FROM tokens JOIN t USING (doc_id) GROUP BY doc_id)",
]


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(["legal"]).redact(sentences(spark, sf_dir), salt=SALT, created_at=F.lit("2024-01-01T00:00:00+00:00"))


@query("redact_fixed_salt", O.sql([*O.results(["legal"]), *_TARGETS], "SELECT t.doc_id, coalesce(head || substr(text, far + 1), text) AS redacted, coalesce(mapping, '') AS mapping FROM t LEFT JOIN spliced USING (doc_id)"))
def redact_fixed_salt(spark, sf_dir):
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("mapping.tokens"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return _redacted(spark, sf_dir).select("doc_id", "redacted", pairs.alias("mapping"))


@query("unredact_roundtrip", O.sql([O.ORDERS], "SELECT doc_id, text AS restored FROM t"))
def unredact_roundtrip(spark, sf_dir):
    return Engine.unredact(_redacted(spark, sf_dir)).select("doc_id", "restored")


@query("mapping_json_roundtrip", O.sql([*O.results(["legal"]), *_TARGETS], "SELECT doc_id, mapping FROM spliced"))
def mapping_json_roundtrip(spark, sf_dir):
    back = sinks.mapping_from_json(sinks.mapping_json())["tokens"]
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries(back), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return _redacted(spark, sf_dir).where(F.size("mapping.tokens") > 0).select("doc_id", pairs.alias("mapping"))


# ---- documents

SIZE = 2000
#: Documents of several lines in two blocks, so that both kinds of chunk ends occur.
_TWO = "replace(text, chr(10), chr(10) || chr(10))"
_CHUNKS = [
    f"t AS MATERIALIZED (SELECT doc_id, {_TWO} AS text FROM documents)",
    "c AS (SELECT doc_id, 0 AS i, 0 AS pos, text FROM t)",
    f"z AS (SELECT doc_id, i, pos, text, substr(text, pos + 1, {SIZE}) AS win, length(text) AS n FROM c UNION ALL SELECT doc_id, i + 1, nxt, text, substr(text, nxt + 1, {SIZE}), n FROM (SELECT doc_id, i, text, n, "
    f"CASE WHEN pos + {SIZE} >= n THEN n WHEN strpos(reverse(win), chr(10) || chr(10)) > 0 AND length(win) - strpos(reverse(win), chr(10) || chr(10)) - 1 > {SIZE // 4} THEN pos + length(win) - strpos(reverse(win), chr(10) || chr(10)) + 1 ELSE pos + {SIZE} END AS nxt FROM z) WHERE nxt < n)",
    "ch AS (SELECT doc_id, i, pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY i), n) AS far, text FROM z)",
]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query("chunk_documents", O.sql(_CHUNKS, "SELECT doc_id, i AS chunk_index, 'chunk ' || (i + 1) AS label, pos AS text_offset, sha256(substr(text, pos + 1, far - pos)) AS hash FROM ch"))
def chunk_documents(spark, sf_dir):
    c = chunk.explode_chunks(_documents(spark, sf_dir), "doc_id", size=SIZE)
    return c.select("doc_id", "chunk_index", "label", "text_offset", F.sha2("text", 256).alias("hash"))


#: Long documents: the texts of each customer's orders, a line each.
_LONG = [
    O.ORDERS.replace("t AS MATERIALIZED (SELECT o_orderkey AS doc_id", "lines AS MATERIALIZED (SELECT o_custkey AS cust, o_orderkey AS ok"),
    "docs AS MATERIALIZED (SELECT cust AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ok) AS text FROM lines GROUP BY cust)",
    "z AS (SELECT doc_id, 0 AS i, 0 AS pos, text, substr(text, 1, 300) AS win, length(text) AS n FROM docs UNION ALL SELECT doc_id, i + 1, nxt, text, substr(text, nxt + 1, 300), n FROM (SELECT doc_id, i, text, n, "
    "CASE WHEN pos + 300 >= n THEN n WHEN strpos(reverse(win), chr(10) || chr(10)) > 0 AND length(win) - strpos(reverse(win), chr(10) || chr(10)) - 1 > 75 THEN pos + length(win) - strpos(reverse(win), chr(10) || chr(10)) + 1 ELSE pos + 300 END AS nxt FROM z) WHERE nxt < n)",
    "ch AS MATERIALIZED (SELECT doc_id AS doc, i, pos, substr(text, pos + 1, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY i), n) - pos) AS text FROM z)",
]
_LONG_TEXT = "t AS MATERIALIZED (SELECT doc * 10000 + i AS doc_id, text FROM ch)"


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").isNull().alias("last"), "o_orderkey"))).alias("keys"))
    return orders.selectExpr("o_custkey AS doc_id", f"array_join(transform(keys.o_orderkey, o_orderkey -> {O.TEXT}), '\n\n') AS text")


@query(
    "document_rollup",
    O.sql(
        [*_LONG, *O.results(["legal", "finance"], source=_LONG_TEXT)],
        "SELECT r.doc_id // 10000 AS doc_id, max(score) AS score, arg_max(level, score * 100000 - r.doc_id % 10000) AS level, arg_max(route, score * 100000 - r.doc_id % 10000) AS route, CAST(sum(n) AS INTEGER) AS n, count(*) AS chunks, "
        "first(d.hash) AS hash FROM result r JOIN (SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM docs) d ON d.doc_id = r.doc_id // 10000 GROUP BY r.doc_id // 10000",
    ),
)
def document_rollup(spark, sf_dir):
    r = Engine(["legal", "finance"]).analyze_documents(_long(spark, sf_dir), size=300)
    return r.select("doc_id", "score", F.col("sensitivity_level").alias("level"), F.col("routing_suggestion").alias("route"), F.col("entity_count").alias("n"), F.col("chunk_count").alias("chunks"), F.col("text_hash").alias("hash"))


#: The targets of whole documents: the chunks' entities at their places in the document.
_LONG_TARGETS = [
    "placed AS (SELECT ch.doc AS doc_id, category, v, s + pos AS s, e + pos AS e, origin, i * 10000 + place AS place FROM sure JOIN ch ON sure.doc_id = ch.doc * 10000 + ch.i)",
    *[x.replace("FROM sure ", "FROM placed ").replace("JOIN t USING", "JOIN docs USING") for x in _TARGETS],
]


@query("redact_documents", O.sql([*_LONG, *O.results(["legal"], source=_LONG_TEXT), *_LONG_TARGETS], "SELECT docs.doc_id, coalesce(head || substr(text, far + 1), text) AS redacted, text AS restored FROM docs LEFT JOIN spliced USING (doc_id)"))
def redact_documents(spark, sf_dir):
    r = Engine(["legal"]).redact_documents(_long(spark, sf_dir), size=300, salt=SALT)
    return Engine.unredact(r).select("doc_id", "redacted", "restored")


_LONG_RAW = 'SELECT doc_id // 10000 AS doc_id, category, s + pos AS start, CAST(e + pos AS INTEGER) AS "end", v AS found FROM sure JOIN ch ON sure.doc_id = ch.doc * 10000 + ch.i'


@query("document_entities", O.sql([*_LONG, *O.results(["legal", "finance"], source=_LONG_TEXT)], _LONG_RAW))
def document_entities(spark, sf_dir):
    e = F.col("e")
    r = Engine(["legal", "finance"]).analyze_documents(_long(spark, sf_dir), size=300).select("doc_id", F.explode("entities").alias("e"))
    return r.select("doc_id", e["category"].alias("category"), e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("found"))


@query("document_formats", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' WHEN 2 THEN 'text' END AS format FROM documents")
def document_formats(spark, sf_dir):
    path = F.concat(F.lit("/in/Doc "), F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".txt", ".MD", ".Log", ".pdf", ""))), (F.col("doc_id") % 5 + 1).cast("int")))
    return read(spark, sf_dir, "documents").select("doc_id", files.document_format(path).alias("format"))


# ---- evaluation

#: Each text is an example; its template says what should be found.
_EXPECTED = "CASE o_orderkey % 12 WHEN 0 THEN 'COUNSEL_COMMUNICATION' WHEN 1 THEN 'LITIGATION_MARKER' WHEN 2 THEN 'PATIENT_NAME' WHEN 3 THEN 'SSN' WHEN 4 THEN 'CPT_CODE' WHEN 5 THEN 'MNPI_MARKER' WHEN 6 THEN 'CARRY_TERMS' ELSE '' END"
_SET = "CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END"
_EXAMPLES = f"ex AS MATERIALIZED (SELECT o_orderkey AS doc_id, {_SET} AS dataset, {_EXPECTED} AS want FROM orders)"
_FLAGS = (
    "found AS (SELECT doc_id, list_distinct(list(category)) AS cats FROM sure GROUP BY doc_id)",
    "flags AS (SELECT ex.*, coalesce(cats, []) AS cats, CASE WHEN want = '' THEN CASE WHEN len(list_filter(coalesce(cats, []), lambda x: x NOT IN ('PERSON', 'EMAIL_ADDRESS', 'PHONE_NUMBER'))) > 0 THEN 'fp' ELSE 'tn' END ELSE CASE WHEN list_contains(coalesce(cats, []), want) THEN 'tp' ELSE 'fn' END END AS outcome FROM ex LEFT JOIN found USING (doc_id))",
)


def _examples(spark: SparkSession, sf_dir: str, detected: bool = True) -> DataFrame:
    t = dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")).selectExpr("o_orderkey AS doc_id", f"{O.TEXT} AS text", f"{_SET} AS dataset", f"{_EXPECTED} AS want")
    t = t.select("doc_id", "text", "dataset", F.filter(F.array("want"), lambda x: x != "").alias("expected"), F.when(F.col("want") == "", "true_negative").otherwise("true_positive").alias("category"))
    r = Engine(["legal", "therapy"]).analyze(t)
    return r.withColumn("detected", evaluate.detected_types(F.col("entities"))) if detected else r


_METRICS = "count(*) AS n, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn, count(*) FILTER (outcome = 'tn') AS tn"


@query("eval_metrics", O.sql([*O.results(["legal", "therapy"]), _EXAMPLES, *_FLAGS, f"m AS (SELECT dataset, {_METRICS} FROM flags GROUP BY dataset)", "pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM m)"], "SELECT dataset, n, tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1, p >= 0.9 AS met_precision FROM pr"))
def eval_metrics(spark, sf_dir):
    m = evaluate.gates(evaluate.metrics(evaluate.outcomes(_examples(spark, sf_dir)), "dataset"), F.lit(0.9))
    return m.select("dataset", "n", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "met_precision")


@query("eval_per_recognizer", O.sql([*O.results(["legal", "therapy"]), _EXAMPLES, *_FLAGS, "what AS (SELECT unnest(cats) AS type, 'fp' AS w FROM flags WHERE want = '' UNION ALL SELECT want, outcome FROM flags WHERE want <> '')"], "SELECT type, count(*) FILTER (w = 'tp') AS tp, count(*) FILTER (w = 'fp') AS fp, count(*) FILTER (w = 'fn') AS fn FROM what GROUP BY type"))
def eval_per_recognizer(spark, sf_dir):
    return evaluate.per_type(_examples(spark, sf_dir))


@query("eval_any_category", O.sql([*O.results(["legal", "therapy"]), _EXAMPLES, *_FLAGS], "SELECT dataset, count(*) FILTER (want = '' AND len(cats) > 0) AS fp, count(*) FILTER (want = '' AND len(cats) = 0) AS tn FROM flags GROUP BY dataset"))
def eval_any_category(spark, sf_dir):
    return evaluate.metrics(evaluate.outcomes(_examples(spark, sf_dir), ignore=()), "dataset").select("dataset", "fp", "tn")


@query("latency_quantiles", "SELECT event_type, n, round(CASE WHEN n % 2 = 1 THEN xs[(n + 1) // 2] ELSE (xs[n // 2] + xs[n // 2 + 1]) / 2 END, 6) AS median, round(CASE WHEN n < 20 THEN xs[n] ELSE xs[CAST(floor(0.95 * (n + 1)) AS BIGINT)] + (0.95 * (n + 1) - floor(0.95 * (n + 1))) * (xs[CAST(floor(0.95 * (n + 1)) AS BIGINT) + 1] - xs[CAST(floor(0.95 * (n + 1)) AS BIGINT)]) END, 6) AS p95 FROM (SELECT event_type, count(value) AS n, list_sort(list(value)) AS xs FROM events WHERE value IS NOT NULL GROUP BY event_type)")
def latency_quantiles(spark, sf_dir):
    return evaluate.latency(read(spark, sf_dir, "events"), "value", "event_type").select("event_type", "n", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


_TRIED = (
    "tries AS (SELECT * FROM (VALUES ('REGEX'), ('RULES')) AS l(layer), (SELECT unnest(range(1, 11)) / 10 AS factor))",
    "seen AS (SELECT s.doc_id, t.layer, t.factor, list_distinct(list(s.category)) AS cats FROM sure s, tries t WHERE CASE WHEN s.layer = t.layer THEN least(1.0, s.confidence * t.factor) ELSE s.confidence END >= 0.5 GROUP BY s.doc_id, t.layer, t.factor)",
    "fl AS (SELECT t.layer, t.factor, ex.dataset, CASE WHEN want = '' THEN CASE WHEN len(list_filter(coalesce(cats, []), lambda x: x NOT IN ('PERSON', 'EMAIL_ADDRESS', 'PHONE_NUMBER'))) > 0 THEN 'fp' ELSE 'tn' END ELSE CASE WHEN list_contains(coalesce(cats, []), want) THEN 'tp' ELSE 'fn' END END AS outcome FROM ex CROSS JOIN tries t LEFT JOIN seen s ON s.doc_id = ex.doc_id AND s.layer = t.layer AND s.factor = t.factor)",
    f"m AS (SELECT layer, factor, dataset, {_METRICS} FROM fl GROUP BY layer, factor, dataset)",
    "f AS (SELECT layer, factor, avg(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) AS f1 FROM m GROUP BY layer, factor)",
)


@query("grid_search", O.sql([*O.results(["legal", "therapy"]), _EXAMPLES, *_TRIED], "SELECT layer, factor, round(f1, 6) AS f1 FROM f QUALIFY row_number() OVER (PARTITION BY layer ORDER BY round(f1, 9) DESC, factor) = 1"))
def grid_search(spark, sf_dir):
    return evaluate.search_factors(_examples(spark, sf_dir, detected=False), ("REGEX", "RULES")).select("layer", "factor", F.round("f1", 6).alias("f1"))


_MODELS = (
    "fm AS (SELECT 'm' || k AS model, dataset, CASE WHEN outcome = 'tp' AND doc_id % (k + 2) = 0 THEN 'fn' WHEN outcome = 'tn' AND doc_id % (k + 3) = 0 THEN 'fp' ELSE outcome END AS outcome FROM flags, (SELECT unnest([1, 2, 3]) AS k))",
    f"mm AS (SELECT model, dataset, {_METRICS} FROM fm GROUP BY model, dataset)",
)


@query("model_comparison", O.sql([*O.results(["legal", "therapy"]), _EXAMPLES, *_FLAGS, *_MODELS], "SELECT model, round(max(CASE WHEN dataset = 'even' THEN tp / (tp + fp) END), 9) AS even, round(max(CASE WHEN dataset = 'odd' THEN tp / (tp + fp) END), 9) AS odd, count(*) FILTER (tp / (tp + fp) >= CASE dataset WHEN 'even' THEN 0.7 ELSE 0.6 END) AS targets_met FROM mm GROUP BY model"))
def model_comparison(spark, sf_dir):
    scored = evaluate.outcomes(_examples(spark, sf_dir)).select("doc_id", "dataset", "outcome", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k"))
    worse = F.when((F.col("outcome") == "tp") & (F.col("doc_id") % (F.col("k") + 2) == 0), "fn").when((F.col("outcome") == "tn") & (F.col("doc_id") % (F.col("k") + 3) == 0), "fp").otherwise(F.col("outcome"))
    m = evaluate.compare_models(scored.select(F.concat(F.lit("m"), F.col("k").cast("string")).alias("model"), "dataset", worse.alias("outcome")), {"even": 0.7, "odd": 0.6})
    return m.select("model", F.round("even", 9).alias("even"), F.round("odd", 9).alias("odd"), "targets_met")


@query("positional_split", "SELECT doc_id, lang, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= floor(count(*) OVER (PARTITION BY lang) * 0.9) THEN 'train' ELSE 'validation' END AS part FROM documents")
def positional_split(spark, sf_dir):
    return corpus.split(read(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"], 0.9, "lang")


# ---- sinks, batches, streams


@query("json_sink", O.sql(O.results(ALL), "SELECT doc_id, level || ' (' || score || ') | ' || route || ' | ' || n || ' entities' AS line FROM result"))
def json_sink(spark, sf_dir):
    back = F.from_json(sinks.as_json(), "struct<score:int,sensitivity_level:string,routing_suggestion:string,entity_count:int>")
    r = Engine(ALL).analyze(sentences(spark, sf_dir)).select("doc_id", back.alias("j"))
    return r.select("doc_id", F.format_string("%s (%d) | %s | %d entities", "j.sensitivity_level", "j.score", "j.routing_suggestion", "j.entity_count").alias("line"))


@query("wire_shape", O.sql(O.results(ALL), "SELECT doc_id, score, level, route, n, entities FROM result"))
def wire_shape(spark, sf_dir):
    kind = f"struct<score:int,level:string,routing:string,entity_count:int,entities:{ENTITIES.replace('detection_layer', 'layer').replace('text:string,', '').replace(',metadata:map<string,string>', '')}>"
    raw = sinks.as_wire()
    r = Engine(ALL).analyze(sentences(spark, sf_dir)).select("doc_id", F.from_json(F.replace(raw, F.lit("detection_layer"), F.lit("layer")), kind).alias("j"))
    entity = lambda e: F.concat(e["category"], F.lit("@"), e["start"].cast("string"), F.lit("-"), e["end"].cast("string"), F.lit(":"), thousandths(e["confidence"]).cast("string"), e["layer"])
    return r.select("doc_id", "j.score", "j.level", F.col("j.routing").alias("route"), F.col("j.entity_count").alias("n"), F.array_join(F.transform("j.entities", entity), ";").alias("entities"))


@query("summary_sink", O.sql(O.results(["legal"]), "SELECT doc_id, level || ' (' || score || ') | ' || route || ' | ' || n || ' entities' || CASE WHEN top_category IS NULL THEN '' ELSE ' | ' || top_category || ' (' || printf('%.2f', list_max(confs)) || ')' END AS summary FROM result LEFT JOIN sums USING (doc_id, n)"))
def summary_sink(spark, sf_dir):
    return Engine(["legal"]).analyze(sentences(spark, sf_dir)).select("doc_id", sinks.as_summary().alias("summary"))


@query("labelled_examples", "SELECT 'doc-' || doc_id AS id, text, CASE WHEN doc_id % 3 = 0 THEN 'A,B' ELSE '' END AS expected, CASE WHEN doc_id % 2 = 0 THEN 'true_negative' ELSE 'true_positive' END AS category FROM documents WHERE doc_id % 7 <> 6")
def labelled_examples(spark, sf_dir):
    found = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("B").alias("type")), F.struct(F.lit("A").alias("type"))))
    row = F.to_json(F.struct(F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), "text", found.alias("expected_entities"), F.when(F.col("doc_id") % 2 == 0, "true_negative").alias("category")))
    lines = read(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 7 == 6, F.concat(F.lit("# "), row)).otherwise(row).alias("value"))
    return files.parse_examples(lines).select("id", "text", F.array_join("expected", ",").alias("expected"), "category")


@query("stream_progress", O.sql(O.results(ALL), "SELECT t.doc_id, x.seq, x.layer, CASE x.seq WHEN 0 THEN coalesce(k.n, 0) ELSE coalesce(e.n, 0) END AS n FROM t CROSS JOIN (VALUES (0, 'REGEX'), (1, 'RULES'), (2, 'final')) AS x(seq, layer) LEFT JOIN (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id) k ON k.doc_id = t.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM ents GROUP BY doc_id) e ON e.doc_id = t.doc_id"))
def stream_progress(spark, sf_dir):
    return progress(Engine(ALL), sentences(spark, sf_dir), "doc_id").select("doc_id", "seq", F.coalesce("layer", F.lit("final")).alias("layer"), F.size("entities").cast("long").alias("n"))


#: A profile that fails where a text has the word dock: what should be a context word is no string.
#: In texts with an address, the e-mail and the phone number, known to every profile, cover the numbers.
FAILING = Profile("failing", categories=("NUMBER", "DOCK"), patterns=(Pattern("Number", "NUMBER", "number", 0.9, "[0-9]+"), Pattern("Dock", "DOCK", "dock", 0.9, "dock", context=(1,))))


@query("batch_errors", O.sql([O.ORDERS], "SELECT doc_id, CASE WHEN contains(text, 'dock') THEN 'AttributeError' ELSE '' END AS error_type, CASE WHEN contains(text, 'dock') THEN 0 WHEN contains(text, '@') THEN 2 ELSE CAST(len(regexp_extract_all(text, '[0-9]+')) AS INTEGER) END AS n FROM t"))
def batch_errors(spark, sf_dir):
    r = Engine([FAILING], Options(context_boost=0.1)).analyze(sentences(spark, sf_dir), layers=["REGEX"])
    return r.select("doc_id", F.coalesce("error.error_type", F.lit("")).alias("error_type"), F.col("entity_count").alias("n"))


@query("layers_invoked", O.sql(O.results(["therapy"]), "SELECT doc_id, CASE WHEN score BETWEEN 20 AND 60 AND NOT contains(groups, 'PRIVILEGE') AND NOT contains(groups, 'MNPI') THEN 'REGEX,NER,RULES,LLM' ELSE 'REGEX,NER,RULES' END AS layers FROM result"))
def layers_invoked(spark, sf_dir):
    r = Engine(["therapy"], client=lambda: lambda prompt: '{"detections": []}').analyze(sentences(spark, sf_dir))
    return r.select("doc_id", F.array_join("layers_invoked", ",").alias("layers"))


@query("corpus_generation", "SELECT * FROM (VALUES ('finance', 'adversarial_negative', 40), ('finance', 'true_negative', 40), ('finance', 'true_positive', 120), ('legal', 'adversarial_negative', 40), ('legal', 'true_negative', 40), ('legal', 'true_positive', 120), ('therapy', 'adversarial_negative', 40), ('therapy', 'true_negative', 40), ('therapy', 'true_positive', 120)) AS c(domain, category, n)")
def corpus_generation(spark, sf_dir):
    made = [corpus.generate(spark, d).select(F.lit(d).alias("domain"), "category") for d in corpus.DOMAINS]
    return made[0].unionByName(made[1]).unionByName(made[2]).groupBy("domain", "category").agg(F.count(F.lit(1)).cast("int").alias("n"))


__all__ = ["ORACLES", "QUERIES", "Options"]
