"""DuckDB SQL fragments that derive the same tables and expressions as the plans, written independently of them."""

from __future__ import annotations

_SYMBOLS = """
use0 AS (SELECT l_partkey AS id, CAST(count(*) AS INTEGER) AS n, max(l_shipdate) AS created_at FROM lineitem GROUP BY 1),
day0 AS (SELECT max(l_shipdate) AS as_of FROM lineitem),
sym0 AS (
  SELECT p_partkey AS id, p_name AS name,
    CASE p_type WHEN 'ECONOMY' THEN 'component' WHEN 'SMALL' THEN 'function' WHEN 'MEDIUM' THEN 'hook' WHEN 'PROMO' THEN 'type' WHEN 'STANDARD' THEN 'interface' ELSE 'class' END AS type,
    lower(p_brand) AS category, p_type || ' ' || p_name || ' by ' || p_brand AS description,
    'src/' || (['components','common','shared','utils','hooks','tests','demo','example'])[CAST((p_partkey // 7) % 8 AS INTEGER) + 1] || '/' || (p_partkey // 7) || '/' || CASE WHEN p_partkey % 7 = 0 THEN 'index.tsx' ELSE 'p' || p_partkey || '.tsx' END AS path,
    CAST(p_partkey % 4 AS INTEGER) AS status, string_split(p_name, ' ') AS props, ['use' || p_type] AS hooks,
    '{"props":["' || array_to_string(string_split(p_name, ' '), '","') || '"],"hooks":["use' || p_type || '"]}' AS meta_json
  FROM part),
sym AS (SELECT sym0.*, coalesce(n, 0) AS usage_count, created_at, date_diff('second', created_at, as_of) / 86400.0 AS age,
    regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS base
  FROM sym0 LEFT JOIN use0 USING (id) CROSS JOIN day0),
onl AS (SELECT * FROM sym WHERE status = 2)"""

_VECTORS = """,
vec AS (SELECT sym.*, embedding FROM sym JOIN embeddings ON vec_id = id % (SELECT count(*) FROM embeddings)),
cosv AS (SELECT vec.*, CASE WHEN len(embedding) > 0 THEN list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.q AS DOUBLE[])) ELSE 0 END AS similarity FROM vec, (SELECT embedding AS q FROM embeddings WHERE vec_id = {q}) q)"""


def symbols(body: str, vector: int | None = None, extra: str = "") -> str:
    return "WITH " + _SYMBOLS + (_VECTORS.format(q=vector) if vector is not None else "") + (",\n" + extra if extra else "") + "\n" + body


def usage() -> str:
    return "greatest(0.0, least(1.0, log10(usage_count + 1.0) / 3.0))"


def recency() -> str:
    return "(CASE WHEN created_at IS NULL THEN 0.4 WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.8 WHEN age <= 90 THEN 0.6 WHEN age <= 180 THEN 0.4 ELSE 0.25 END)"


def common() -> str:
    return "(CASE WHEN contains(lower(path), '/common/') OR contains(lower(path), '/shared/') THEN 1.0 ELSE 0.35 END)"


def tokens(query: str) -> str:
    return f"list_distinct(regexp_extract_all(lower('{query}'), '[a-z0-9_]{{2,}}'))"


def overlap(query: str) -> str:
    hay = "lower(name || ' ' || description || ' ' || path)"
    n = f"CAST(len(list_filter({tokens(query)}, lambda t: contains({hay}, t))) AS DOUBLE)"
    size = f"CAST(len({tokens(query)}) AS DOUBLE)"
    return f"(CASE WHEN {n} >= 4 AND {n} / {size} >= 0.45 THEN 0.78 WHEN {n} >= 3 AND {n} / {size} >= 0.30 THEN 0.68 WHEN {n} >= 2 AND {n} / {size} >= 0.18 THEN 0.56 ELSE 0.0 END)"


def match(query: str) -> str:
    q = query.lower()
    return f"(CASE WHEN lower(name) = '{q}' THEN 1.0 WHEN contains(lower(name), '{q}') THEN 0.85 WHEN contains(lower(description), '{q}') THEN 0.65 WHEN {overlap(query)} > 0 THEN {overlap(query)} ELSE 0.2 END)"


def label(query: str) -> str:
    q = query.lower()
    return f"(CASE WHEN lower(name) = '{q}' THEN 'exact_name' WHEN contains(lower(name), '{q}') THEN 'name_contains' WHEN contains(lower(description), '{q}') THEN 'description_contains' WHEN {overlap(query)} > 0 THEN 'token_overlap' ELSE 'weak' END)"


def total(text: str, bonus: str = "0.0") -> str:
    return f"round(CAST({text} AS DOUBLE) * 0.5 + CAST({usage()} AS DOUBLE) * 0.3 + CAST({recency()} AS DOUBLE) * 0.1 + CAST({common()} AS DOUBLE) * 0.1 + CAST({bonus} AS DOUBLE), 3)"


def is_demo(strict: bool = False) -> str:
    parts = ["/examples/", "/one-ui-demo/", "/example/"] + (["/demos/", "/demo/"] if strict else [])
    return "(" + " OR ".join(f"contains(lower(path), '{p}')" for p in parts) + ")"


def is_index() -> str:
    return "regexp_matches(lower(base), '^index\\.(js|ts|tsx|jsx)$')"


def reusable() -> str:
    parts = ["/story/", ".story.", "/stories/", ".stories.", "__mocks__", ".mock.", "/fixtures/", "/tests/", "__tests__", "/test/", ".test.", ".spec."]
    names = " OR ".join(f"starts_with(lower(name), '{n}')" for n in ("demo", "example", "fixture", "mock"))
    return f"(NOT ({is_demo(True)} OR " + " OR ".join(f"contains(lower(path), '{p}')" for p in parts) + f") AND NOT ({names}))"


def ilike(words: list[str]) -> str:
    return "(" + " OR ".join(f"{c} ILIKE '%{w}%'" for w in words for c in ("name", "description", "path", "meta_json")) + ")"


def fts(words: list[str]) -> str:
    """Score, null unless every word occurs in name (1.0), description (0.4) or path (0.2)."""
    has = lambda f, w: f"list_contains(string_split_regex(lower({f}), '[^\\p{{L}}\\p{{N}}_]+'), '{w}')"
    best = [f"(CASE WHEN {has('name', w)} THEN 1.0 WHEN {has('description', w)} THEN 0.4 WHEN {has('path', w)} THEN 0.2 ELSE 0.0 END)" for w in words]
    s = f"(CAST({' + '.join(best)} AS DOUBLE) / {float(len(words))})"
    return f"(CASE WHEN {' AND '.join(b + ' > 0' for b in best)} THEN {s} / ({s} + 1) END)"


def literal(query: str, words: list[str]) -> str:
    q = query.strip().lower()
    hits = " OR ".join(f"contains(lower(name), '{w}') OR contains(lower(base), '{w}')" for w in words) or "false"
    return f"(lower(name) = '{q}' OR contains(lower(path), '{q}') OR {hits})"


def priority(score: str, lit: str) -> str:
    return f"round(greatest(0.0, CAST({score} AS DOUBLE) + CASE WHEN {lit} THEN 0.22 ELSE 0.0 END + CASE WHEN {is_index()} THEN 0.18 ELSE 0.0 END - CASE WHEN {is_demo()} THEN 0.18 ELSE 0.0 END), 3)"
