"""The engine's semantics as DuckDB SQL, for comparison: set formulas and recursive CTEs, not folds."""

from __future__ import annotations

from spanloom import bank, catalog
from spanloom.catalog import Registry

#: One text an order, so that every profile has something to find. Valid in Spark and in DuckDB.
TEXT = """CASE o_orderkey % 12
 WHEN 0 THEN concat('Privileged and confidential: outside counsel reviewed 21-cv-', CAST(10000 + o_custkey % 90000 AS STRING), ' and the settlement agreement.')
 WHEN 1 THEN concat('Litigation hold: preserve DOC-', CAST(1000 + o_custkey % 9000 AS STRING), '-', CAST(100 + o_custkey % 900 AS STRING), '. CEO Smith settled for $', CAST(o_custkey AS STRING), ' million.')
 WHEN 2 THEN concat('Session ', CAST(o_custkey % 100 AS STRING), ': patient Jane Doe, DOB: 01/02/19', CAST(10 + o_custkey % 90 AS STRING), ', sertraline ', CAST(o_custkey AS STRING), ' mg daily.')
 WHEN 3 THEN concat('Progress note: suicidal ideation denied, treatment plan kept. Dr. Alan Reyes, SSN: 123-45-', CAST(1000 + o_custkey % 9000 AS STRING), '.')
 WHEN 4 THEN concat('CPT 90837, claim ', CAST(o_custkey AS STRING), ': Major Depressive Disorder, minor client with trauma history and PTSD, guardian present in session.')
 WHEN 5 THEN concat('MNPI: acquiring the target at $', CAST(o_custkey AS STRING), '/share, strictly confidential, 5.5x EBITDA.')
 WHEN 6 THEN concat('Term sheet ', CAST(o_custkey AS STRING), ': 20% carry, hurdle rate, Fund IV, Goldman Sachs; do not distribute, insider list.')
 WHEN 7 THEN concat('Write to user', CAST(o_custkey AS STRING), '@example.com or call 555-123-', CAST(1000 + o_custkey % 9000 AS STRING), '.')
 WHEN 8 THEN concat('Order ', CAST(o_custkey AS STRING), ' left the dock on time.')
 WHEN 9 THEN concat('Legal advice of counsel on the merger with Lazard: valuation of $', CAST(o_custkey AS STRING), ' million, attorney-client privilege, blackout period.')
 WHEN 10 THEN concat('Work product doctrine covers exhibit ', CAST(o_custkey % 100 AS STRING), '; the attorney kept it for trial. Motion to compel, complaint, deposition.')
 ELSE concat('The patient waited ', CAST(o_custkey AS STRING), ' minutes; session notes mention therapist Robin Vale and medication.') END"""

ORDERS = f"t AS MATERIALIZED (SELECT o_orderkey AS doc_id, {TEXT} AS text FROM orders)"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _lookup(column: str, groups: dict, default: str) -> str:
    whens = " ".join(f"WHEN {column} IN ({', '.join(map(quoted, members))}) THEN {quoted(g)}" for g, members in groups.items())
    return f"CASE {whens} ELSE {default} END"


def group(column: str = "category") -> str:
    return _lookup(column, bank.ENTITY_GROUPS, "'PII'")


def priority(column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN {quoted(g)} THEN {n}" for g, n in bank.GROUP_PRIORITY.items()) + " END"


def matches(regex: str, extra: str, source: str = "t") -> str:
    """Every match of a regular expression: doc_id, extra columns, text, s (start), v (its text)."""
    x = quoted("(?i)" + regex)
    return (
        f"SELECT doc_id, {extra}, text, CAST(list_sum(list_transform(gs[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda z: length(z))), 0) AS INTEGER) AS s, ms[i] AS v "
        f"FROM (SELECT doc_id, text, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, text, regexp_extract_all(text, {x}) AS ms, string_split_regex(text, {x}) AS gs FROM {source} WHERE regexp_matches(text, {x})))"
    )


def scan_ctes(profiles: list[str], least: float = 0.5, source: str = ORDERS) -> list[str]:
    """t, and raw: the spans of a scan: doc_id, ord, category, confidence, text, s, v, e."""
    active = [Registry().get(p) for p in profiles]
    parts = [matches(p.regex, f"{i} AS ord, {quoted(p.category)} AS category, CAST({p.score} AS DOUBLE) AS confidence") for i, p in enumerate(catalog.active_patterns(active)) if p.score >= least]
    return [source, "raw AS MATERIALIZED (SELECT *, s + length(v) AS e FROM (" + "\nUNION ALL ".join(parts) + "))"]


def dedup_ctes() -> list[str]:
    """kept: the spans that stay, from raw, with rn, their number in the text."""
    wins = "(o.e - o.s, o.confidence, o.pr) > (w.e - w.s, w.confidence, w.pr)"
    pick = lambda c: f"CASE WHEN o.s < w.e AND NOT {wins} THEN w.{c} ELSE o.{c} END AS {c}"
    return [
        f"o AS MATERIALIZED (SELECT *, {priority(group())} AS pr, row_number() OVER (PARTITION BY doc_id ORDER BY s, ord) AS rn FROM raw)",
        "w AS (SELECT doc_id, rn, rn AS island, s, e, v, text, category, confidence, pr FROM o WHERE rn = 1 UNION ALL "
        f"SELECT o.doc_id, o.rn, CASE WHEN o.s >= w.e THEN o.rn ELSE w.island END AS island, {', '.join(map(pick, ('s', 'e', 'v', 'text', 'category', 'confidence', 'pr')))} FROM w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)",
        "kept AS MATERIALIZED (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, island ORDER BY rn DESC) = 1)",
    ]


def hit_ctes(profiles: list[str]) -> list[str]:
    """hits: rule matches with k, their number in the text, and conf, which has the boost."""
    parts = []
    for i, r in enumerate(catalog.active_rules([Registry().get(p) for p in profiles])):
        near = f"lower(substr(text, greatest(s - {r.window}, 0) + 1, least(length(text), e + {r.window}) - greatest(s - {r.window}, 0)))"
        there = " OR ".join(f"contains({near}, {quoted(c.lower())})" for c in r.context) or "false"
        extra = f"{i} AS ord, {quoted(r.id)} AS rule, {quoted(r.category)} AS category, {quoted(r.group)} AS grp, CAST({r.confidence} AS DOUBLE) AS base, CAST({r.boost} AS DOUBLE) AS boost, {str(r.boost_only).lower()} AS boost_only"
        parts.append(f"SELECT *, ({there}) AS context FROM (SELECT *, s + length(v) AS e FROM ({matches(r.regex, extra)}))")
    return ["hits AS MATERIALIZED (SELECT *, CASE WHEN context THEN least(1.0, base + boost) ELSE base END AS conf, row_number() OVER (PARTITION BY doc_id ORDER BY ord, s) AS k FROM (" + "\nUNION ALL ".join(parts) + "))"]


def rule_ctes() -> list[str]:
    """ents: doc_id, category, grp, confidence, layer, s, e, v, origin, place after the rules."""
    return [
        "c AS MATERIALIZED (SELECT e.doc_id, e.rn, h.k, h.conf, greatest(e.confidence, coalesce(max(h.conf) OVER (PARTITION BY e.doc_id, e.rn ORDER BY h.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS earlier "
        "FROM kept e JOIN hits h ON h.doc_id = e.doc_id AND h.category = e.category AND e.s >= h.s AND e.e <= h.e)",
        "raised AS (SELECT doc_id, rn, max(conf) AS conf FROM c GROUP BY doc_id, rn)",
        "used AS (SELECT DISTINCT doc_id, k FROM c WHERE conf > earlier)",
        "minted AS (SELECT h.* FROM hits h ANTI JOIN used u ON u.doc_id = h.doc_id AND u.k = h.k WHERE NOT boost_only AND NOT EXISTS (SELECT 1 FROM kept e WHERE e.doc_id = h.doc_id AND e.category = h.category AND e.s = h.s AND e.e = h.e) "
        "QUALIFY row_number() OVER (PARTITION BY h.doc_id, h.category, h.s, h.e ORDER BY k) = 1)",
        f"ents AS MATERIALIZED (SELECT k.doc_id, k.category, {group('k.category')} AS grp, greatest(k.confidence, coalesce(r.conf, 0)) AS confidence, 'REGEX' AS layer, k.s, k.e, k.v, 0 AS origin, k.rn AS place "
        "FROM kept k LEFT JOIN raised r ON r.doc_id = k.doc_id AND r.rn = k.rn UNION ALL SELECT doc_id, category, grp, conf, 'RULES', s, e, v, 1, k FROM minted)",
    ]


def result_ctes(profiles: list[str], least: float = 0.5) -> list[str]:
    """result: one row a text: doc_id, score, level, route, n, top_category, groups, entities."""
    weights = catalog.active_weights([Registry().get(p) for p in profiles])
    weight = "CASE grp " + " ".join(f"WHEN {quoted(g)} THEN {float(w)}" for g, w in weights.items()) + f" ELSE {bank.DEFAULT_WEIGHT} END"
    order = "ORDER BY s, origin, place"
    return [
        f"sure AS (SELECT * FROM ents WHERE confidence >= {least})",
        f"sums AS (SELECT doc_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(CAST({weight} AS DOUBLE) * confidence {order})), lambda a, b: a + b) AS total, count(*) AS n, list(category {order}) AS cats, list(confidence {order}) AS confs, "
        f"array_to_string(list_sort(list_distinct(list(grp))), ',') AS groups, array_to_string(list(category || '@' || s || '-' || e || ':' || CAST(round(confidence * 1000) AS INTEGER) || layer {order}), ';') AS entities FROM sure GROUP BY doc_id)",
        "scored AS (SELECT t.doc_id, t.text, least(100, CAST(round_even(coalesce(total, 0), 0) AS INTEGER)) AS score, CAST(coalesce(n, 0) AS INTEGER) AS n, cats[list_position(confs, list_max(confs))] AS top_category, coalesce(groups, '') AS groups, coalesce(entities, '') AS entities FROM t LEFT JOIN sums USING (doc_id))",
        "result AS (SELECT *, CASE WHEN score = 0 THEN 'NONE' WHEN score <= 20 THEN 'LOW' WHEN score <= 50 THEN 'MEDIUM' WHEN score <= 80 THEN 'HIGH' ELSE 'CRITICAL' END AS level, "
        "CASE WHEN contains(groups, 'PRIVILEGE') OR contains(groups, 'MNPI') THEN 'LOCAL_ONLY' WHEN contains(groups, 'PHI') OR score > 30 THEN 'REDACT_CLOUD' ELSE 'CLOUD_OK' END AS route FROM scored)",
    ]


def sql(ctes: list[str], select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select


def entities(profiles: list[str], least: float = 0.5, source: str = ORDERS) -> list[str]:
    return [*scan_ctes(profiles, least, source), *dedup_ctes(), *hit_ctes(profiles), *rule_ctes()]


def results(profiles: list[str], least: float = 0.5, source: str = ORDERS) -> list[str]:
    return [*entities(profiles, least, source), *result_ctes(profiles, least)]
