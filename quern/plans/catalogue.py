"""The engine's queries, each with DuckDB SQL for the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.config import DEFAULT
from quern.functions import hashes, paths, render, scoring, sql, text
from quern.operators import chunking, context, evals, merge, ranking, relations, retrieval
from quern.sources import bridge, files, sinks
from quern.sources.store import Snapshots
from quern.sources.embedder import embedder, hashed
from quern.streaming import enrich

from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col
QUERY, WORDS, VEC = "red widget", ["red", "widget"], 7
LONG = "small red ring widget bolt by brand"
SENTENCE = "Looking for a component related to: red, widget"
LITERALS = ["looking", "for", "related", "red", "widget"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(x) -> F.Column:
    return F.round(x, 6)


# Scans, filters and predicates


@query(O.symbols("SELECT id, name, type, category, path, usage_count FROM onl WHERE type IN ('component', 'hook')"))
def scan_status_type(spark, d):
    return retrieval.online(bridge.symbols(spark, d), ["component", "hook"]).select("id", "name", "type", "category", "path", "usage_count")


@query(O.symbols(f"SELECT id, path FROM sym WHERE {O.reusable()}"))
def filter_reusable(spark, d):
    return bridge.symbols(spark, d).where(paths.is_reusable(c("name"), c("path"))).select("id", "path")


@query(O.symbols(f"SELECT id, {O.is_demo()} AS demo, {O.is_demo(True)} AS demo_strict FROM sym"))
def filter_demo(spark, d):
    return bridge.symbols(spark, d).select("id", paths.is_demo(c("path")).alias("demo"), paths.is_demo(c("path"), True).alias("demo_strict"))


@query(O.symbols(f"SELECT id, path FROM sym WHERE {O.is_index()}"))
def filter_index_file(spark, d):
    return bridge.symbols(spark, d).where(paths.is_index_file(c("path"))).select("id", "path")


@query(O.symbols("SELECT id FROM onl WHERE list_has_all(list_transform(list_concat(props, hooks), lambda x: lower(x)), ['red', 'usemedium'])"))
def struct_contains(spark, d):
    pool = retrieval.structure_pool([c("props"), c("hooks")])
    return retrieval.online(bridge.symbols(spark, d)).where(retrieval.has_structure([" Red ", "useMEDIUM"], pool)).select("id")


@query(O.symbols(f"SELECT id FROM sym WHERE {O.ilike(['d_w'])}"))
def ilike_multi(spark, d):
    return bridge.symbols(spark, d).where(retrieval.ilike_any("d_w")).select("id")


@query(O.symbols(f"SELECT id, usage_count FROM onl WHERE {O.ilike([QUERY, *WORDS])} ORDER BY usage_count DESC, id LIMIT 20"))
def token_any(spark, d):
    return retrieval.keyword_search(bridge.symbols(spark, d), QUERY, WORDS).select("id", "usage_count")


@query(O.symbols("SELECT id, category FROM onl WHERE contains(lower(category), 'brand#1')"))
def category_contains(spark, d):
    return retrieval.online(bridge.symbols(spark, d)).where(F.contains(F.lower("category"), F.lit("brand#1"))).select("id", "category")


@query(O.symbols("SELECT count(*) AS n FROM vec WHERE embedding IS NOT NULL AND status = 2", VEC))
def vector_present(spark, d):
    return retrieval.online(bridge.symbols(spark, d, True)).where(c("embedding").isNotNull()).agg(F.count("*").alias("n"))


@query(O.symbols(f"SELECT id, {O.literal(QUERY, WORDS)} AS literal FROM sym"))
def strong_literal(spark, d):
    return bridge.symbols(spark, d).select("id", scoring.strong_literal(QUERY, c("name"), c("path")).alias("literal"))


@query(O.symbols("SELECT id, list_filter(['RED ', 'useSMALL', 'nut'], lambda r: list_contains(list_transform(list_concat(props, hooks), lambda x: lower(x)), lower(trim(r)))) AS matched FROM sym"))
def matched_required(spark, d):
    return bridge.symbols(spark, d).select("id", retrieval.matched_required(["RED ", "useSMALL", "nut"], F.concat("props", "hooks")).alias("matched"))


# Scalar functions


@query(O.symbols(f"SELECT id, CAST({O.match(QUERY)} AS DOUBLE) AS score, {O.label(QUERY)} AS label FROM sym"))
def text_match(spark, d):
    m = scoring.text_match(QUERY, c("name"), c("description"), c("path"))
    return bridge.symbols(spark, d).select("id", m["score"].alias("score"), m["label"].alias("label"))


@query(O.symbols(f"SELECT id, CAST({O.overlap(LONG)} AS DOUBLE) AS overlap FROM sym"))
def token_overlap(spark, d):
    return bridge.symbols(spark, d).select("id", scoring.token_overlap(LONG, c("name"), c("description"), c("path")).alias("overlap"))


@query(O.symbols(f"SELECT id, round(CAST({O.usage()} AS DOUBLE), 6) AS score FROM sym"))
def usage_score(spark, d):
    return bridge.symbols(spark, d).select("id", r6(scoring.usage_score(c("usage_count"))).alias("score"))


@query(O.symbols(f"SELECT id, CAST({O.recency()} AS DOUBLE) AS score, CAST(floor(age) AS BIGINT) AS days FROM sym"))
def recency_score(spark, d):
    j = bridge.symbols(spark, d).crossJoin(F.broadcast(bridge.as_of(spark, d)))
    return j.select("id", scoring.recency_score(c("created_at"), c("as_of")).alias("score"), F.floor(scoring.age_days(c("created_at"), c("as_of"))).alias("days"))


@query(O.symbols(f"SELECT id, CAST({O.common()} AS DOUBLE) AS score FROM sym"))
def common_path(spark, d):
    return bridge.symbols(spark, d).select("id", scoring.path_score(c("path")).alias("score"))


@query(O.symbols("SELECT id, CAST(least(0.05 * len(list_filter(props, lambda p: contains('red small widget ring', lower(p)))), 0.2) AS DOUBLE) AS bonus FROM sym"))
def callee_bonus(spark, d):
    return bridge.symbols(spark, d).select("id", scoring.callee_bonus("red small widget ring", c("props")).alias("bonus"))


@query("SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{2,}')) AS t FROM conversations".replace("AS t", "AS tokens").replace("list_distinct(", "list_sort(list_distinct(").replace("{2,}'))", "{2,}')))"))
def search_tokens(spark, d):
    return bridge.table(spark, d, "conversations").select("conv_id", "turn", F.array_sort(text.search_tokens(c("text"))).alias("tokens"))


_GENERIC = "[" + ", ".join(f"'{w}'" for w in text.GENERIC_WORDS) + "]"
_LIT_GENERIC = "[" + ", ".join(f"'{w}'" for w in text.LITERAL_GENERIC) + "]"


@query(f"SELECT p_partkey, list_sort(list_filter(list_distinct(regexp_extract_all(lower(p_name || ' hook Utils page'), '[a-z0-9_]{{2,}}')), lambda t: NOT list_contains({_GENERIC}, t))) AS keywords FROM part")
def query_keywords(spark, d):
    return bridge.table(spark, d, "part").select("p_partkey", F.array_sort(text.query_keywords(F.concat("p_name", F.lit(" hook Utils page")))).alias("keywords"))


@query(f"SELECT p_partkey, list_sort(list_filter(list_distinct(regexp_extract_all(lower(p_name || ' hook of it'), '[a-z0-9_]+')), lambda t: len(t) >= 3 AND NOT list_contains({_LIT_GENERIC}, t))) AS tokens FROM part")
def literal_tokens(spark, d):
    return bridge.table(spark, d, "part").select("p_partkey", F.array_sort(text.literal_tokens(F.concat("p_name", F.lit(" hook of it")))).alias("tokens"))


@query(O.symbols("SELECT id, 'Type: ' || type || chr(10) || 'Name: ' || name || chr(10) || 'Description: ' || description || chr(10) || 'Hooks: ' || array_to_string(hooks, ', ') || chr(10) || 'Side effects: none' AS doc FROM sym"))
def embed_doc(spark, d):
    none = F.array().cast("array<string>")
    return bridge.symbols(spark, d).select("id", text.embed_doc(c("type"), c("name"), c("description"), F.lit(""), none, c("hooks"), none).alias("doc"))


@query(O.symbols("SELECT id, lower(name || ' ' || path || ' ' || description || ' ' || meta_json) AS haystack FROM sym"))
def search_text(spark, d):
    return bridge.symbols(spark, d).select("id", text.search_text(c("name"), c("path"), c("description"), c("meta_json")).alias("haystack"))


_ASKED = ["Input onChange", "radio group", "string formatter", "modal  popup 弹窗", "下拉框 选择器", "nav MENU", "file upload", "imgs in a list", "loading spinner 加载", "useDebounce hook"]
_GROUPS = "(SELECT CAST(k AS INTEGER) AS k, words FROM (SELECT unnest(range(" + str(len(text.SYNONYMS)) + ")) AS k, unnest([" + ", ".join("[" + ", ".join(f"'{w}'" for w in g) + "]" for g in text.SYNONYMS) + "]) AS words))"


@query(f"""WITH q AS (SELECT p_partkey, ([{", ".join(f"'{x}'" for x in _ASKED)}])[p_partkey % {len(_ASKED)} + 1] || ' ' || p_name AS query FROM part),
tried AS (SELECT p_partkey, query, k, list_filter(words, lambda w: contains(lower(query), w))[1] AS hit, list_filter(words, lambda w: NOT contains(lower(query), w))[1] AS sub FROM q, {_GROUPS}),
made AS (SELECT p_partkey, query, k, trim(regexp_replace(regexp_replace(query, hit, sub, 'gi'), '\\s+', ' ', 'g')) AS variant FROM tried WHERE hit IS NOT NULL AND sub IS NOT NULL),
best AS (SELECT p_partkey, arg_min(variant, k) AS variant FROM made WHERE variant <> query GROUP BY p_partkey)
SELECT p_partkey, variant FROM q LEFT JOIN best USING (p_partkey)""")
def synonym_variant(spark, d):
    asked = F.element_at(text.strings(_ASKED), (c("p_partkey") % len(_ASKED) + 1).cast("int"))
    return bridge.table(spark, d, "part").select("p_partkey", text.synonym_variant(F.concat(asked, F.lit(" "), c("p_name"))).alias("variant"))


_NOISY = ["帮我找找一个", "有没有现成的 ", "请推荐一下", "可复用的封装好的", "util实现 Hook", ""]


@query(f"SELECT p_partkey, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(q, '^帮我找(找)?(一个|一下)?', ''), '^有没有(现成的)?', ''), '^请推荐(一个|一下)?', ''), '可复用', ''), '现成的', ''), '封装好的', ''), '(组件|函数|hook|工具|util)(实现)?', '', 'gi'), ' ') AS query FROM (SELECT p_partkey, ([{', '.join(repr(x) for x in _NOISY)}])[p_partkey % {len(_NOISY)} + 1] || p_name || ' 组件' AS q FROM part)")
def strip_noise(spark, d):
    prefix = F.element_at(text.strings(_NOISY), (c("p_partkey") % len(_NOISY) + 1).cast("int"))
    return bridge.table(spark, d, "part").select("p_partkey", text.strip_noise(F.concat(prefix, c("p_name"), F.lit(" 组件"))).alias("query"))


@query("""SELECT page_id, list_extract(list_filter(string_split(lower(url), '/'), lambda s: s IN ('apis','types','hooks','utils','pages','services','modules','widgets','features','selectors','components')), -1) AS category, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages""")
def infer_category_path(spark, d):
    return bridge.table(spark, d, "pages").select("page_id", paths.category_from_path(c("url")).alias("category"), paths.basename(c("url")).alias("base"))


@query(O.symbols("SELECT id, list_extract(list_filter(string_split(lower(path), '/'), lambda s: s IN ('apis','types','hooks','utils','pages','services','modules','widgets','features','selectors','components')), -1) AS by_path, CASE WHEN starts_with(lower(hooks[1]), 'use') THEN 'hook' END AS by_name FROM sym"))
def infer_category_name(spark, d):
    return bridge.symbols(spark, d).select("id", paths.category_from_path(c("path")).alias("by_path"), paths.category_from_name(F.element_at("hooks", 1)).alias("by_name"))


@query(O.symbols("SELECT id, CASE WHEN contains(type, 'hook') THEN ['hook'] WHEN contains(type, 'type') THEN ['type', 'interface'] WHEN contains(type, 'class') THEN ['class'] WHEN contains(type, 'component') THEN ['component'] ELSE ['component'] END AS types FROM sym"))
def infer_types(spark, d):
    return bridge.symbols(spark, d).select("id", paths.infer_types(c("name"), c("type")).alias("types"))


@query("SELECT doc_id, sha256(text) AS hash, nullif(substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160), '') AS summary FROM documents")
def chunk_summary(spark, d):
    return bridge.table(spark, d, "documents").select("doc_id", hashes.file_hash(c("text")).alias("hash"), text.summary(c("text")).alias("summary"))


@query("SELECT conv_id, turn, sha256(CAST(conv_id AS VARCHAR) || '#' || turn || chr(10) || text) AS hash FROM conversations")
def chunk_hash(spark, d):
    return bridge.table(spark, d, "conversations").select("conv_id", "turn", hashes.chunk_hash(c("conv_id").cast("string"), c("turn"), c("text")).alias("hash"))


# Vectors, full text, fusion, ranking


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.q AS DOUBLE[])), 6) AS similarity FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) q")
def cosine_all(spark, d):
    e = bridge.table(spark, d, "embeddings").crossJoin(F.broadcast(bridge.query_vector(spark, d, VEC)))
    return e.select("vec_id", r6(scoring.cosine(c("embedding"), c("q"))).alias("similarity"))


@query("SELECT vec_id, round(s, 6) AS similarity FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q.q AS DOUBLE[])) AS s FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) q ORDER BY s DESC, vec_id LIMIT 20) WHERE s >= 0 ORDER BY s DESC, vec_id LIMIT 10")
def vector_topk(spark, d):
    top = retrieval.vector_topk(bridge.table(spark, d, "embeddings"), bridge.query_vector(spark, d, VEC), 10, key="vec_id")
    return top.select("vec_id", r6(c("similarity")).alias("similarity"))


@query(O.symbols("SELECT id, round(similarity, 6) AS similarity FROM cosv WHERE status = 2 AND type = 'component' AND similarity >= 0.1 ORDER BY similarity DESC, id LIMIT 8", VEC))
def vector_topk_typed(spark, d):
    rows = retrieval.online(bridge.symbols(spark, d, True), ["component"])
    return retrieval.vector_topk(rows, bridge.query_vector(spark, d, VEC), 8, 0.1).select("id", r6(c("similarity")).alias("similarity"))


@query(O.symbols("""SELECT id, CASE WHEN max(s) >= 0.5 THEN arg_max('label' || k, s) END AS category, round(max(s), 6) AS similarity FROM (
  SELECT v.id, k.vec_id AS k, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(k.embedding AS DOUBLE[])) AS s FROM vec v, (SELECT vec_id, embedding FROM embeddings WHERE vec_id < 12) k) GROUP BY id""", VEC))
def category_argmax(spark, d):
    k = bridge.table(spark, d, "embeddings").where("vec_id < 12").select(F.concat(F.lit("label"), c("vec_id").cast("string")).alias("label"), c("embedding").alias("vector"), c("vec_id").alias("position"))
    return ranking.best_category(bridge.symbols(spark, d, True).select("id", "embedding"), k).withColumn("similarity", r6(c("similarity")))


@query(O.symbols(f"SELECT id, round({O.fts(WORDS)}, 6) AS score FROM onl WHERE {O.fts(WORDS)} > 0"))
def fts_score(spark, d):
    return retrieval.fulltext(bridge.symbols(spark, d), WORDS, limit=None).select("id", r6(c("score")).alias("score"))


@query(O.symbols(f"SELECT id, round({O.fts(['brand', 'small'])}, 6) AS score FROM onl WHERE {O.fts(['brand', 'small'])} > 0 ORDER BY {O.fts(['brand', 'small'])} DESC, id LIMIT 15"))
def fts_topk(spark, d):
    return retrieval.fulltext(bridge.symbols(spark, d), ["brand", "small"], limit=15).select("id", r6(c("score")).alias("score"))


_FUSED = f"""
ft AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) - 1 AS rank FROM (SELECT id, {O.fts(WORDS)} AS s FROM onl WHERE {O.fts(WORDS)} > 0 AND type IN ('component') ORDER BY s DESC, id LIMIT 20)),
vt AS (SELECT id, row_number() OVER (ORDER BY similarity DESC, id) - 1 AS rank FROM (SELECT id, similarity FROM (SELECT id, similarity FROM cosv WHERE status = 2 AND type IN ('component') ORDER BY similarity DESC, id LIMIT 40) WHERE similarity >= 0 ORDER BY similarity DESC, id LIMIT 20)),
fused AS (SELECT id, coalesce(1.0 / (60 + CAST(v.rank AS DOUBLE)), 0) + coalesce(1.0 / (60 + CAST(f.rank AS DOUBLE)), 0) AS rrf, v.rank AS vr, f.rank AS fr FROM vt v FULL JOIN ft f USING (id))"""


@query(O.symbols("SELECT id, round(rrf, 6) AS rrf, CAST(vr AS INTEGER) AS vec_rank, CAST(fr AS INTEGER) AS text_rank FROM fused", VEC, _FUSED))
def rrf_fuse(spark, d):
    s = bridge.symbols(spark, d, True)
    near = retrieval.vector_topk(retrieval.online(s, ["component"]), bridge.query_vector(spark, d, VEC), 20)
    near = retrieval.ranked(near.select("id", "similarity"), [F.desc("similarity"), c("id")], "rank")
    full = retrieval.ranked(retrieval.fulltext(s, WORDS, types=["component"], limit=20).select("id", "score"), [F.desc("score"), c("id")], "rank")
    return retrieval.rrf(near, full).select("id", r6(c("rrf")).alias("rrf"), "vec_rank", "text_rank")


@query(O.symbols(f"SELECT id, {O.total(O.match(QUERY))} AS score, {O.label(QUERY)} AS matched_by FROM onl"))
def rank_keyword(spark, d):
    return ranking.rank_keyword(retrieval.online(bridge.symbols(spark, d)), QUERY, bridge.as_of(spark, d)).select("id", "score", "matched_by")


_SEM_BONUS = f"least(0.05 * len(list_filter(props, lambda p: contains('{QUERY}', lower(p)))), 0.2)"
_SIM = "greatest(0.0, least(1.0, similarity))"
_SEM_REASON = f"coalesce(nullif(concat_ws(' + ', CASE WHEN {_SIM} >= 0.55 THEN 'high semantic similarity' WHEN {_SIM} >= 0.4 THEN 'semantically related' END, CASE WHEN {O.usage()} >= 0.6 THEN 'often used' END, CASE WHEN {O.common()} >= 1 THEN 'in a shared path' END, CASE WHEN {_SEM_BONUS} > 0 THEN 'calls match' END), ''), 'overall relevance')"


@query(O.symbols(f"SELECT id, {O.total(_SIM, _SEM_BONUS)} AS score, {_SEM_REASON} AS reason FROM cosv WHERE status = 2", VEC))
def rank_semantic(spark, d):
    s = retrieval.online(bridge.symbols(spark, d, True)).crossJoin(F.broadcast(bridge.query_vector(spark, d, VEC)))
    s = s.withColumn("similarity", scoring.cosine(c("embedding"), c("q"))).withColumn("callee_names", c("props"))
    return ranking.rank_semantic(s, QUERY, bridge.as_of(spark, d)).select("id", "score", "reason")


_KW = f"kw AS (SELECT *, {O.total(O.match(QUERY))} AS score FROM onl)"
_PRI = _KW + f", pri AS (SELECT *, {O.priority('score', O.literal(QUERY, WORDS))} AS priority FROM kw)"


@query(O.symbols("SELECT id, score, priority FROM pri", None, _PRI))
def priority(spark, d):
    k = ranking.rank_keyword(retrieval.online(bridge.symbols(spark, d)), QUERY, bridge.as_of(spark, d))
    return k.select("id", "score", scoring.priority(c("score"), scoring.strong_literal(QUERY, c("name"), c("path")), c("path")).alias("priority"))


def _penalty(source: str) -> str:
    return f"SELECT *, CASE WHEN NOT {O.is_index()} AND bool_or({O.is_index()}) OVER (PARTITION BY dir) THEN round(greatest(0.0, priority - 0.25), 3) ELSE priority END AS final FROM {source}"


@query(O.symbols("SELECT id, priority, final FROM fin", None, _PRI + f", fin AS ({_penalty('pri')})"))
def dir_index_penalty(spark, d):
    k = ranking.rank_keyword(retrieval.online(bridge.symbols(spark, d)), QUERY, bridge.as_of(spark, d))
    k = k.withColumn("priority", scoring.priority(c("score"), scoring.strong_literal(QUERY, c("name"), c("path")), c("path")))
    return ranking.directory_penalty(k).select("id", "priority", "final")


_REC = _FUSED + f""",
rec AS (SELECT sym.*, rrf, vr, fr, {O.total('rrf')} AS score FROM sym JOIN fused USING (id)),
pri AS (SELECT *, {O.priority('score', O.literal(SENTENCE, LITERALS))} AS priority FROM rec),
fin AS ({_penalty('pri')})"""


@query(O.symbols("SELECT id, name, path, final, round(rrf, 6) AS rrf FROM fin ORDER BY final DESC, priority DESC, score DESC, fin.rrf DESC, vr NULLS LAST, fr NULLS LAST, id LIMIT 6", VEC, _REC))
def recommend(spark, d):
    out = ranking.recommend(bridge.symbols(spark, d, True), QUERY, WORDS, bridge.query_vector(spark, d, VEC), bridge.as_of(spark, d), SENTENCE, ["component"])
    return out.select("id", "name", "path", "final", r6(c("rrf")).alias("rrf"))


_SEARCH = f"found AS (SELECT * FROM onl WHERE {O.ilike([QUERY, *WORDS])} ORDER BY usage_count DESC, id LIMIT 20), good AS (SELECT *, {O.total(O.match(QUERY))} AS score FROM found WHERE {O.reusable()})"


@query(O.symbols("SELECT id, name, path, usage_count, score FROM good WHERE score >= 0.45 ORDER BY score DESC, usage_count DESC, id LIMIT 20", None, _SEARCH))
def search_symbols_kw(spark, d):
    return ranking.search_symbols(bridge.symbols(spark, d), QUERY, WORDS, bridge.as_of(spark, d)).select("id", "name", "path", "usage_count", "score")


_NEAR = f"near AS (SELECT * FROM (SELECT * FROM (SELECT * FROM cosv WHERE status = 2 ORDER BY similarity DESC, id LIMIT 40) WHERE similarity >= 0 ORDER BY similarity DESC, id LIMIT 20) WHERE {O.reusable()})"


@query(O.symbols(f"""SELECT * FROM (
  SELECT id, name, score, round(similarity, 6) AS similarity, true AS semantic FROM (SELECT *, {O.total(_SIM)} AS score FROM near) WHERE score >= 0.45
  UNION ALL SELECT id, name, score, NULL, false FROM (SELECT * FROM good WHERE score >= 0.45 ORDER BY score DESC, usage_count DESC, id LIMIT 20) WHERE (SELECT count(*) FROM near) = 0)
  ORDER BY score DESC, similarity DESC NULLS LAST, id LIMIT 20""", VEC, _NEAR + ", " + _SEARCH))
def search_symbols_sem(spark, d):
    out = ranking.search_semantic(bridge.symbols(spark, d, True), QUERY, WORDS, bridge.query_vector(spark, d, VEC), bridge.as_of(spark, d))
    return out.select("id", "name", "score", r6(c("similarity")).alias("similarity"), "semantic")


@query(O.symbols(f"SELECT id, score FROM (SELECT *, {O.total(O.match('red'))} AS score FROM (SELECT * FROM (SELECT * FROM onl ORDER BY usage_count DESC, id LIMIT 100) WHERE list_has_all(list_transform(list_concat(props, hooks), lambda x: lower(x)), ['red']) ORDER BY usage_count DESC, id LIMIT 20))"))
def search_structure(spark, d):
    rows = retrieval.search_by_structure(bridge.symbols(spark, d), ["red"])
    return ranking.rank_keyword(rows, "red", bridge.as_of(spark, d)).select("id", "score")


@query(O.symbols("SELECT id, name, type, path, usage_count FROM onl WHERE name = 'red widget' ORDER BY id LIMIT 1"))
def symbol_detail(spark, d):
    return retrieval.symbol_detail(bridge.symbols(spark, d), "red widget").select("id", "name", "type", "path", "usage_count")


# Chunks and context


@query()
def chunk_docs(spark, d):
    return chunking.chunk_documents(bridge.documents(spark, d))


@query("SELECT source || '/' || doc_id AS path, length(text) AS chars, CAST(greatest(1, ceil((length(text) - 100) / 500.0)) AS INTEGER) AS chunks FROM documents")
def chunk_stats(spark, d):
    x = bridge.fixed_chunks(spark, d)
    return x.groupBy("path").agg(F.max(c("chunk_index") * 500 + F.length("content")).alias("chars"), F.count("*").cast("int").alias("chunks"))


_CHUNKS = """ch AS (SELECT doc_id, path, CAST(i AS INTEGER) AS chunk_index, n AS chunk_count, substring(text, CAST(i * 500 + 1 AS BIGINT), 600) AS content FROM (
  SELECT doc_id, path, text, n, unnest(range(n)) AS i FROM (SELECT doc_id, source || '/' || doc_id AS path, text, CAST(greatest(1, ceil((length(text) - 100) / 500.0)) AS INTEGER) AS n FROM documents))),
hits AS (SELECT *, round((doc_id % 97) / 97.0, 6) AS similarity FROM ch WHERE doc_id % 50 = 3 AND chunk_index = 1)"""


def _hits(chunks: DataFrame) -> DataFrame:
    return chunks.where((c("doc_id") % 50 == 3) & (c("chunk_index") == 1)).withColumn("similarity", F.round((c("doc_id") % 97) / F.lit(97.0), 6))


@query(f"WITH {_CHUNKS} SELECT DISTINCT ch.path, ch.chunk_index FROM ch JOIN hits h ON ch.path = h.path AND ch.chunk_index BETWEEN greatest(0, h.chunk_index - 1) AND h.chunk_index + 1")
def neighbours(spark, d):
    x = bridge.fixed_chunks(spark, d)
    return context.neighbours(_hits(x), x.select("path", "chunk_index"))


@query(f"WITH {_CHUNKS} SELECT DISTINCT ch.path, ch.chunk_index FROM ch JOIN hits h ON ch.path = h.path AND abs(ch.chunk_index - h.chunk_index) <= 2")
def neighbours_window(spark, d):
    x = bridge.fixed_chunks(spark, d)
    return context.neighbours_window(x, (c("doc_id") % 50 == 3) & (c("chunk_index") == 1), 2).select("path", "chunk_index")


_GATHER = _CHUNKS + """,
near AS (SELECT DISTINCT ch.* FROM ch JOIN hits h ON ch.path = h.path AND abs(ch.chunk_index - h.chunk_index) <= 1),
uni AS (SELECT path, chunk_index, chunk_count, content, similarity, 0 AS src FROM hits UNION ALL SELECT path, chunk_index, chunk_count, content, NULL, 1 FROM near),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, chunk_index ORDER BY src) AS k FROM uni) WHERE k = 1),
ren AS (SELECT *, '[source: ' || path || ' · part ' || (chunk_index + 1) || '/' || chunk_count || CASE WHEN similarity IS NOT NULL THEN ' · similarity ' || printf('%.2f', similarity) ELSE '' END || ']' || chr(10) || content AS rendered FROM one),
tot AS (SELECT *, row_number() OVER o AS rn, sum(length(rendered)) OVER (o ROWS UNBOUNDED PRECEDING) AS total_chars FROM ren WINDOW o AS (ORDER BY src, similarity DESC NULLS LAST, path, chunk_index)),
kept AS (SELECT * FROM tot WHERE rn <= 12 AND (rn = 1 OR total_chars <= 6000))"""


def _gathered(spark, d) -> DataFrame:
    x = bridge.fixed_chunks(spark, d)
    h = _hits(x).select("path", "chunk_index", "chunk_count", "content", "similarity")
    return context.gather(h, context.neighbours(h, x.select("path", "chunk_index", "chunk_count", "content")).select("path", "chunk_index", "chunk_count", "content"))


@query(f"WITH {_GATHER} SELECT path, chunk_index, src FROM one")
def context_dedup(spark, d):
    return _gathered(spark, d).select("path", "chunk_index", "src")


@query(f"WITH {_GATHER} SELECT path, chunk_index, CAST(rn AS INTEGER) AS rn, CAST(total_chars AS BIGINT) AS total_chars, (SELECT count(*) FROM tot) > (SELECT count(*) FROM kept) AS truncated FROM kept")
def context_budget(spark, d):
    return context.budget(_gathered(spark, d)).select("path", "chunk_index", "rn", "total_chars", "truncated")


@query(f"WITH {_GATHER} SELECT string_agg(rendered, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn) AS context, count(*) AS chunks, (SELECT count(*) FROM tot) > count(*) AS truncated FROM kept")
def context_text(spark, d):
    return context.context_text(context.budget(_gathered(spark, d)))


# Evaluation

_RUNS = """
jud AS (SELECT source AS query_id, CAST(doc_id AS VARCHAR) AS name, greatest(0, least(2, quality * 2 - toxic)) AS rel, doc_id FROM labels JOIN documents USING (doc_id)),
exp0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS k FROM jud) WHERE k <= 3),
ret AS (SELECT query_id, name, row_number() OVER (PARTITION BY query_id ORDER BY doc_id * 7919 % 101, doc_id) AS pos FROM jud),
r AS (SELECT *, pos - 1 AS i FROM ret WHERE pos <= 60),
q AS (SELECT DISTINCT query_id FROM jud),
m AS (SELECT q.query_id,
  (SELECT count(*) FROM exp0 e WHERE e.query_id = q.query_id AND rel >= 1) AS want,
  (SELECT count(*) FROM exp0 e WHERE e.query_id = q.query_id AND rel >= 1 AND name IN (SELECT name FROM r WHERE r.query_id = q.query_id AND i < 10)) AS hit,
  (SELECT count(*) FROM exp0 e WHERE e.query_id = q.query_id AND rel >= 1 AND name IN (SELECT name FROM r WHERE r.query_id = q.query_id AND i < 50)) AS hit50,
  (SELECT min(i) FROM r WHERE r.query_id = q.query_id AND i < 10 AND name IN (SELECT name FROM exp0 e WHERE e.query_id = q.query_id AND rel >= 1)) AS first,
  (SELECT coalesce(sum((2.0 ** rel - 1) / log2(i + 2)), 0) FROM r JOIN exp0 e ON e.query_id = r.query_id AND e.name = r.name WHERE r.query_id = q.query_id AND i < 10) AS dcg,
  (SELECT coalesce(sum((2.0 ** rel - 1) / log2(n + 1)), 0) FROM (SELECT rel, row_number() OVER (ORDER BY rel DESC) AS n FROM exp0 e WHERE e.query_id = q.query_id) WHERE n <= 10) AS idcg,
  (SELECT count(*) > 0 FROM r JOIN exp0 e ON e.query_id = r.query_id AND e.name = r.name WHERE r.query_id = q.query_id AND i = 0 AND rel = 2) AS top1 FROM q),
ev AS (SELECT query_id, CASE WHEN want = 0 THEN 1.0 ELSE CAST(hit AS DOUBLE) / want END AS recall, CASE WHEN want = 0 THEN 1.0 ELSE CAST(hit50 AS DOUBLE) / want END AS recall50,
  coalesce(1.0 / (first + 1), 0) AS mrr, CASE WHEN idcg = 0 THEN 1.0 ELSE dcg / idcg END AS ndcg, top1 FROM m)"""


def _runs(spark, d) -> DataFrame:
    j = bridge.judgements(spark, d)
    w = lambda *o: Window.partitionBy("query_id").orderBy(*o)
    e = j.withColumn("k", F.row_number().over(w("doc_id"))).where("k <= 3").groupBy("query_id").agg(F.collect_list(F.struct("name", "rel")).alias("expected"))
    r = j.withColumn("k", F.row_number().over(w(c("doc_id") * 7919 % 101, "doc_id"))).where("k <= 60")
    r = r.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("returned"))
    tag = F.when(F.length("query_id") > 4, "zh").otherwise("en")
    return r.join(e, "query_id").withColumn("tags", F.array(tag, F.lit("component")))


def _evaluated(spark, d) -> DataFrame:
    return evals.evaluate(_runs(spark, d))


@query(f"WITH {_RUNS} SELECT query_id, round(recall, 6) AS recall_main, round(recall50, 6) AS recall_wide FROM ev")
def recall_at_k(spark, d):
    return _evaluated(spark, d).select("query_id", r6(c("recall_main")).alias("recall_main"), r6(c("recall_wide")).alias("recall_wide"))


@query(f"WITH {_RUNS} SELECT query_id, round(mrr, 6) AS mrr FROM ev")
def mrr_at_k(spark, d):
    return _evaluated(spark, d).select("query_id", r6(c("mrr")).alias("mrr"))


@query(f"WITH {_RUNS} SELECT query_id, round(ndcg, 6) AS ndcg FROM ev")
def ndcg_at_k(spark, d):
    return _evaluated(spark, d).select("query_id", r6(c("ndcg")).alias("ndcg"))


@query(f"WITH {_RUNS} SELECT query_id, top1 FROM ev")
def top1(spark, d):
    return _evaluated(spark, d).select("query_id", "top1")


_SUMMARY = "SELECT round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg, round(avg(CASE WHEN recall > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage, round(avg(CASE WHEN top1 THEN 1.0 ELSE 0.0 END), 6) AS top1, 0.0 AS fp_rate, count(*) FILTER (recall = 0) AS zero_recall FROM ev"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select([r6(c(x)).alias(x) if t == "double" else c(x) for x, t in df.dtypes])


@query(f"WITH {_RUNS} {_SUMMARY}".replace("0.0 AS fp_rate", "CAST(0 AS DOUBLE) AS fp_rate"))
def fp_rate(spark, d):
    return _rounded(evals.summarise(_evaluated(spark, d)))


@query(f"WITH {_RUNS} SELECT tag, count(*) AS queries, round(avg(recall), 6) AS recall, count(*) FILTER (recall = 0) AS zero_recall FROM (SELECT *, unnest([CASE WHEN length(query_id) > 4 THEN 'zh' ELSE 'en' END, 'component']) AS tag FROM ev) GROUP BY tag")
def recall_by_tag(spark, d):
    return _rounded(evals.recall_by_tag(_evaluated(spark, d)))


_FAIL = """CASE WHEN doc_id % 5 = 0 THEN 'found' WHEN doc_id % 2 = 1 THEN 'no_semantic_recall' WHEN doc_id % 3 = 1 THEN 'reusability_filtered' WHEN doc_id % 7 = 1 THEN 'structure_filtered' WHEN doc_id % 11 <> 1 THEN 'ranked_below_topk' ELSE 'quality_gate_rejected' END"""


def _classified(spark, d) -> DataFrame:
    some = lambda keep: F.when(keep, F.array("doc_id")).otherwise(F.array().cast("array<bigint>"))
    i = c("doc_id")
    kind = evals.classify_failure(i, some(i % 2 != 1), some(i % 3 != 1), some(i % 7 != 1), some(i % 11 == 1), some(i % 5 == 0))
    return bridge.judgements(spark, d).select("doc_id", kind.alias("failure"))


@query(f"SELECT doc_id, {_FAIL} AS failure FROM labels JOIN documents USING (doc_id)")
def failure_class(spark, d):
    return _classified(spark, d)


@query(f"SELECT failure, count(*) AS n FROM (SELECT {_FAIL} AS failure FROM labels JOIN documents USING (doc_id)) WHERE failure <> 'found' GROUP BY failure")
def failure_counts(spark, d):
    return _classified(spark, d).where("failure <> 'found'").groupBy("failure").agg(F.count("*").alias("n"))


@query(f"WITH {_RUNS}, a AS (SELECT avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM ev), b AS (SELECT avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM ev WHERE length(query_id) > 4) SELECT metric, round(value, 6) AS value, round(baseline, 6) AS baseline, round(value - baseline, 6) AS delta FROM (SELECT 'recall' AS metric, a.recall AS value, b.recall AS baseline FROM a, b UNION ALL SELECT 'mrr', a.mrr, b.mrr FROM a, b UNION ALL SELECT 'ndcg', a.ndcg, b.ndcg FROM a, b)")
def baseline_delta(spark, d):
    e = _evaluated(spark, d)
    out = evals.baseline_delta(evals.summarise(e), evals.summarise(e.where(F.length("query_id") > 4)))
    return _rounded(out.where(c("metric").isin("recall", "mrr", "ndcg")))


# Mutations

_OLD = "old AS (SELECT id, name, path, 'h' || (id % 10) AS semantic_hash, CASE WHEN id % 3 = 0 THEN NULL ELSE [1.0] END AS embedding, usage_count, status FROM sym WHERE id % 5 <> 0)"
_NEW = "new AS (SELECT id, name, path, CASE WHEN id % 13 = 0 THEN NULL WHEN id % 7 = 0 THEN 'changed' ELSE 'h' || (id % 10) END AS semantic_hash, CASE WHEN id % 11 = 0 THEN [2.0] END AS embedding FROM sym WHERE id % 4 <> 0)"


def _old(spark, d) -> DataFrame:
    h = F.concat(F.lit("h"), (c("id") % 10).cast("string"))
    return bridge.symbols(spark, d).where("id % 5 <> 0").select("id", "name", "path", h.alias("semantic_hash"), F.when(c("id") % 3 != 0, F.array(F.lit(1.0))).alias("embedding"), "usage_count", "status", F.sha2(c("path"), 256).alias("file_hash"))


def _new(spark, d) -> DataFrame:
    h = F.when(c("id") % 13 == 0, F.lit(None)).when(c("id") % 7 == 0, "changed").otherwise(F.concat(F.lit("h"), (c("id") % 10).cast("string")))
    return bridge.symbols(spark, d).where("id % 4 <> 0").select("id", "name", "path", h.alias("semantic_hash"), F.when(c("id") % 11 == 0, F.array(F.lit(2.0))).alias("embedding"), F.lit(0).alias("usage_count"), F.lit(1).alias("status"), F.sha2(c("name"), 256).alias("file_hash"))


_MERGE = """mer AS (SELECT coalesce(o.id, n.id) AS id, coalesce(o.usage_count, 0) AS usage_count,
  CASE WHEN n.path IS NULL THEN o.embedding WHEN n.embedding IS NOT NULL THEN n.embedding WHEN n.semantic_hash <> o.semantic_hash THEN NULL ELSE o.embedding END[1] AS vector,
  CAST(CASE WHEN n.path IS NULL THEN o.status WHEN n.embedding IS NOT NULL THEN 2 WHEN o.path IS NULL THEN 1 WHEN n.semantic_hash <> o.semantic_hash THEN 1 WHEN o.embedding IS NOT NULL THEN 2 ELSE 1 END AS INTEGER) AS status
  FROM old o FULL JOIN new n ON o.path = n.path AND o.name = n.name)""".replace("CASE WHEN n.path IS NULL THEN o.embedding", "list_extract(CASE WHEN n.path IS NULL THEN o.embedding").replace("ELSE o.embedding END[1]", "ELSE o.embedding END, 1)")


@query(O.symbols("SELECT id, usage_count, CAST(vector AS DOUBLE) AS vector, status FROM mer", None, f"{_OLD}, {_NEW}, {_MERGE}"))
def merge_symbols(spark, d):
    return merge.merge_symbols(_old(spark, d), _new(spark, d)).select("id", "usage_count", F.try_element_at("embedding", F.lit(1)).alias("vector"), "status")


@query(O.symbols("SELECT status, count(*) AS n, count(vector) AS vectors FROM mer GROUP BY status", None, f"{_OLD}, {_NEW}, {_MERGE}"))
def merge_status(spark, d):
    return merge.merge_symbols(_old(spark, d), _new(spark, d)).groupBy("status").agg(F.count("*").alias("n"), F.count("embedding").alias("vectors"))


@query(O.symbols("SELECT id, CAST(CASE WHEN id % 6 = 1 AND id % 4 = 0 THEN 0 WHEN id % 6 IN (1, 2) AND id % 4 = 0 THEN 0 ELSE status END AS INTEGER) AS status, CASE WHEN id % 6 IN (1, 2) AND id % 4 = 0 THEN true ELSE false END AS cleared FROM old", None, _OLD))
def soft_delete(spark, d):
    touched = bridge.symbols(spark, d).where("id % 6 IN (1, 2)").select("path")
    out = merge.soft_delete(_old(spark, d), _new(spark, d).select("path", "name"), touched)
    return out.select("id", "status", c("file_hash").isNull().alias("cleared"))


@query(O.symbols("SELECT id, CASE WHEN id % 9 = 4 THEN 'moved/' || path ELSE path END AS path FROM sym"))
def rename_paths(spark, d):
    s = bridge.symbols(spark, d)
    return merge.rename_paths(s.select("id", "path"), s.where("id % 9 = 4").select("path", F.concat(F.lit("moved/"), "path").alias("new_path")))


@query(O.symbols("SELECT id, usage_count + coalesce(n, 0) AS usage_count FROM sym LEFT JOIN (SELECT user_id, CAST(count(*) AS INTEGER) AS n FROM events WHERE event_type = 'purchase' GROUP BY user_id) ON user_id = id"))
def inc_usage(spark, d):
    log = bridge.table(spark, d, "events").where("event_type = 'purchase'").select(c("user_id").alias("id"))
    return merge.add_usage(bridge.symbols(spark, d).select("id", "usage_count"), log)


@query(O.symbols("SELECT id, CAST(CASE WHEN id % 10 IN (3, 4) THEN 1 ELSE status END AS INTEGER) AS status, embedding IS NOT NULL AND id % 10 NOT IN (3, 4) AS has_vector FROM old", None, _OLD))
def force_invalidate(spark, d):
    gone = spark.createDataFrame([("h3",), ("h4",)], "semantic_hash string")
    return merge.invalidate(_old(spark, d), gone).select("id", "status", c("embedding").isNotNull().alias("has_vector"))


@query(f"WITH {_CHUNKS} SELECT path, chunk_index, length(content) AS chars FROM ch WHERE doc_id % 20 <> 1 UNION ALL SELECT source || '/' || doc_id, 0, length(text) FROM documents WHERE doc_id % 20 = 1")
def replace_doc(spark, d):
    x = bridge.fixed_chunks(spark, d).select("path", "chunk_index", "content")
    new = bridge.documents(spark, d).where("doc_id % 20 = 1").select("path", F.lit(0).alias("chunk_index"), "content")
    return merge.replace_documents(x, new).select("path", "chunk_index", F.length("content").alias("chars"))


@query("SELECT source || '/' || doc_id AS path FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 1")
def changed_files(spark, d):
    now = bridge.documents(spark, d).select("path", "doc_id", hashes.file_hash(c("content")).alias("file_hash"))
    stored = now.where("doc_id % 3 <> 0").select("path", F.when(c("doc_id") % 4 == 1, "old").otherwise(c("file_hash")).alias("file_hash"))
    return merge.changed_files(now, stored).select("path")


@query("SELECT count(*) AS total, count(*) FILTER (doc_id % 3 = 0 OR doc_id % 4 = 1) AS changed, count(*) FILTER (NOT (doc_id % 3 = 0 OR doc_id % 4 = 1)) AS skipped FROM documents")
def hash_diff(spark, d):
    now = bridge.documents(spark, d).select("path", "doc_id", hashes.file_hash(c("content")).alias("file_hash"))
    stored = now.where("doc_id % 3 <> 0").select("path", F.when(c("doc_id") % 4 == 1, "old").otherwise(c("file_hash")).alias("file_hash"))
    s = stored.withColumnRenamed("file_hash", "stored_hash")
    same = c("file_hash").eqNullSafe(c("stored_hash"))
    return now.join(s, "path", "left").agg(F.count("*").alias("total"), F.count_if(~same).alias("changed"), F.count_if(same).alias("skipped"))


@query("SELECT DISTINCT sha256(event_type || props) AS semantic_hash FROM events")
def distinct_hashes(spark, d):
    return bridge.jobs(spark, d).select("semantic_hash").where("length(semantic_hash) > 0").distinct()


@query(O.symbols("SELECT o.id, k.id AS donor FROM old o LEFT JOIN (SELECT semantic_hash, min(id) AS id FROM old WHERE status = 2 AND embedding IS NOT NULL GROUP BY 1) k USING (semantic_hash) WHERE o.status = 1", None, _OLD))
def reuse_vectors(spark, d):
    o = _old(spark, d)
    known = o.where("status = 2").withColumn("embedding", F.when(c("embedding").isNotNull(), F.array(c("id").cast("double"))))
    return merge.reuse_vectors(o.where("status = 1"), known).select("id", F.try_element_at("reused", F.lit(1)).cast("bigint").alias("donor"))


# Relations

_EDGES = "ed AS (SELECT DISTINCT a.l_partkey AS caller, b.l_partkey AS callee FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey WHERE a.l_orderkey % 10 = 0)"


def _edges(spark, d) -> DataFrame:
    li = bridge.table(spark, d, "lineitem").where("l_orderkey % 10 = 0")
    a, b = li.select("l_orderkey", c("l_partkey").alias("caller")), li.select("l_orderkey", c("l_partkey").alias("callee"))
    return a.join(b, "l_orderkey").where("caller <> callee").select("caller", "callee").distinct()


@query("""WITH calls AS (SELECT 'f' || (l_orderkey % 50) AS file, 'n' || (l_partkey % 40) AS name FROM lineitem WHERE l_orderkey % 100 = 0),
exports AS (SELECT DISTINCT 'f' || (p_partkey % 50) AS file, 'n' || (p_partkey % 40) AS name FROM part)
SELECT DISTINCT e.name AS caller, e.file AS caller_path, t.name AS callee, t.file AS callee_path FROM calls k JOIN exports e ON e.file = k.file JOIN exports t ON t.name = k.name WHERE e.name <> t.name OR e.file <> t.file""")
def call_edges(spark, d):
    tag = lambda p, x, n: F.concat(F.lit(p), (c(x) % n).cast("string"))
    calls = bridge.table(spark, d, "lineitem").where("l_orderkey % 100 = 0").select(tag("f", "l_orderkey", 50).alias("file"), tag("n", "l_partkey", 40).alias("name"))
    exports = bridge.table(spark, d, "part").select(tag("f", "p_partkey", 50).alias("file"), tag("n", "p_partkey", 40).alias("name")).distinct()
    return relations.call_edges(calls, exports)


@query(f"WITH {_EDGES} SELECT callee, list(caller ORDER BY caller) AS callers FROM (SELECT *, row_number() OVER (PARTITION BY callee ORDER BY caller) AS k FROM ed) WHERE k <= 20 GROUP BY callee")
def callers_top20(spark, d):
    top = relations.first_k(_edges(spark, d), ["callee"], ["caller"])
    return top.groupBy("callee").agg(F.array_sort(F.collect_list("caller")).alias("callers"))


@query("""WITH exports AS (SELECT DISTINCT 'src/d' || (p_partkey % 9) || '/' || CASE WHEN p_partkey % 2 = 0 THEN 'index.ts' ELSE 'm' || (p_partkey % 5) || '.tsx' END AS file, 'n' || (p_partkey % 30) AS name FROM part),
imports AS (SELECT DISTINCT 'src/d' || (p_partkey % 9) || '/index.ts' AS file, 'n' || (p_partkey % 30) AS name, '../d' || (p_partkey % 7) || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '/m' || (p_partkey % 5) END AS spec FROM part),
files AS (SELECT DISTINCT file FROM exports),
tries AS (SELECT i.file, i.name, i.spec, replace(i.spec, '../', 'src/') || s.s AS target, s.k FROM imports i, (SELECT unnest(['', '.ts', '.tsx', '.js', '.jsx', '/index.ts', '/index.tsx', '/index.js', '/index.jsx']) AS s, unnest(range(9)) AS k) s),
res AS (SELECT file, name, spec, arg_min(target, k) AS target FROM tries WHERE target IN (SELECT file FROM files) GROUP BY 1, 2, 3)
SELECT DISTINCT e.name AS importer, r.file AS importer_path, r.name, r.target FROM res r JOIN exports s ON s.file = r.target AND s.name = r.name JOIN exports e ON e.file = r.file""")
def import_edges(spark, d):
    n = lambda k: (c("p_partkey") % k).cast("string")
    p = bridge.table(spark, d, "part")
    file = F.concat(F.lit("src/d"), n(9), F.lit("/"), F.when(c("p_partkey") % 2 == 0, "index.ts").otherwise(F.concat(F.lit("m"), n(5), F.lit(".tsx"))))
    exports = p.select(file.alias("file"), F.concat(F.lit("n"), n(30)).alias("name")).distinct()
    spec = F.concat(F.lit("../d"), n(7), F.when(c("p_partkey") % 3 == 0, "").otherwise(F.concat(F.lit("/m"), n(5))))
    imports = p.select(F.concat(F.lit("src/d"), n(9), F.lit("/index.ts")).alias("file"), F.concat(F.lit("n"), n(30)).alias("name"), spec.alias("specifier")).distinct()
    return relations.import_edges(relations.resolve_imports(imports, exports.select(c("file").alias("path"))), exports)


# Further predicates, projections and sinks


@query(O.symbols("SELECT id FROM sym WHERE contains(lower(name || ' ' || path || ' ' || description || ' ' || meta_json), 'red widget') OR len(list_filter(['red', 'small', 'usemedium'], lambda t: contains(lower(name || ' ' || path || ' ' || description || ' ' || meta_json), t))) >= 2"))
def two_tokens(spark, d):
    return retrieval.two_tokens(bridge.symbols(spark, d), QUERY, ["red", "small", "usemedium"]).select("id")


@query(O.symbols("""SELECT id, round(CAST(greatest(0.0, least(1.0, log10(usage_count + 1.0) / 3.0)) AS DOUBLE), 6) AS usage, CAST(CASE WHEN contains(path, '/common/') OR contains(path, '/shared/') THEN 1.0 ELSE 0.35 END AS DOUBLE) AS common,
list_sort(list_distinct(regexp_extract_all(lower(description), '[a-z0-9_]{2,}'))) AS tokens, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS self FROM vec""", VEC))
def sql_functions(spark, d):
    sql.register(spark)
    s = bridge.symbols(spark, d, True)
    return s.selectExpr("id", "round(usage_score(usage_count), 6) AS usage", "path_score(path) AS common", "array_sort(search_tokens(description)) AS tokens", "round(cosine_sim(embedding, embedding), 6) AS self")


@query("SELECT vec_id, len(embedding) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 3) + CAST(0 AS DOUBLE) AS total FROM embeddings WHERE vec_id % 10 <> 3")
def parse_vector(spark, d):
    raw = F.when(c("vec_id") % 10 == 3, F.lit("[1.0, null]")).otherwise(F.to_json(F.transform("embedding", lambda x: x.cast("double"))))
    v = bridge.table(spark, d, "embeddings").select("vec_id", scoring.parse_vector(raw).alias("v")).where("v IS NOT NULL")
    return v.select("vec_id", F.size("v").cast("bigint").alias("dims"), (F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 3) + F.lit(0.0)).alias("total"))


@query("""SELECT '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}' AS json FROM part""")
def json_rows(spark, d):
    return render.as_json(bridge.table(spark, d, "part").select("p_partkey", "p_name"))


@query(O.symbols("SELECT id, 'Type: ' || type || chr(10) || 'Name: ' || name || chr(10) || 'Description: ' || name || chr(10) || 'Hooks: none' || chr(10) || 'Side effects: none' AS doc FROM sym"))
def query_embed_doc(spark, d):
    return bridge.symbols(spark, d).select("id", text.query_embed_doc(c("name"), c("type")).alias("doc"))


@query(O.symbols("SELECT id, type || ' ' || name || chr(10) || category || chr(10) || path || chr(10) || description || chr(10) || 'props: ' || array_to_string(props, ', ') || chr(10) || 'hooks: ' || array_to_string(hooks, ', ') AS doc FROM sym"))
def row_embed_text(spark, d):
    return bridge.symbols(spark, d).select("id", text.row_embed_text(c("name"), c("type"), c("category"), c("path"), c("description"), {"props": c("props"), "hooks": c("hooks")}, F.lit("")).alias("doc"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https:/') THEN substring(url, 8) ELSE url END AS shown FROM pages")
def display_path(spark, d):
    return bridge.table(spark, d, "pages").select("page_id", paths.display_path(c("url"), "https:").alias("shown"))


@query("SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^\\s+', '')) AS text FROM conversations")
def normalize_text(spark, d):
    return bridge.table(spark, d, "conversations").select("conv_id", "turn", text.normalize(c("text")).alias("text"))


@query("SELECT p_partkey, printf('%.1f%%', round(p_size * 1.0 / 50 * 100, 1)) AS share FROM part")
def percent(spark, d):
    return bridge.table(spark, d, "part").select("p_partkey", render.percent(c("p_size") / F.lit(50.0)).alias("share"))


@query("SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 AND conv_id % 2 = 0 THEN 'cached' ELSE 'computed ' || role END AS value FROM conversations")
def cache_lookup(spark, d):
    q = bridge.table(spark, d, "conversations").select("conv_id", "turn", "role")
    now = F.timestamp_seconds(F.lit(1_000_000))
    store = q.where("conv_id % 3 = 0").select("conv_id", F.lit("cached").alias("value"), F.timestamp_seconds(F.when(c("conv_id") % 2 == 0, 1_000_001).otherwise(999_999)).alias("expires_at")).distinct()
    return files.with_cache(q, store, "conv_id", lambda miss: miss.withColumn("value", F.concat(F.lit("computed "), "role")), now).select("conv_id", "turn", "role", "value")


@query("SELECT semantic_hash, event_id FROM (SELECT sha256(event_type || props) AS semantic_hash, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, sha256(event_type || props)) AS k FROM events) WHERE k <= 100")
def last_failures(spark, d):
    e = bridge.table(spark, d, "events").select(F.sha2(F.concat("event_type", "props"), 256).alias("semantic_hash"), c("event_type").alias("symbols_table"), c("ts").alias("enqueued_at"), "event_id")
    return enrich.keep_last_failures(e).select("semantic_hash", "event_id")


@query(f"WITH {_RUNS}, s AS (SELECT avg(recall) AS recall, avg(CASE WHEN recall > 0 THEN 1.0 ELSE 0.0 END) AS coverage FROM ev), f AS (SELECT {_FAIL} AS type, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), t AS (SELECT max(n) * 1.0 / sum(n) AS share FROM f WHERE type <> 'found') SELECT unnest(list_filter([CASE WHEN coverage - recall > 0.1 THEN 'recall gap to coverage' END, CASE WHEN recall < 0.5 THEN 'low recall' END, CASE WHEN share > 0.5 THEN 'one failure dominates' END, CASE WHEN share > 0.3 AND share <= 0.5 THEN 'one failure is frequent' END], lambda x: x IS NOT NULL)) AS finding FROM s, t")
def findings(spark, d):
    n = _classified(spark, d).where("failure <> 'found'").groupBy(c("failure").alias("type")).agg(F.count("*").alias("n"))
    return evals.findings(evals.summarise(_evaluated(spark, d)), n)


@query("""WITH k AS (SELECT vec_id AS cell, embedding AS centre FROM embeddings WHERE vec_id < 8),
s AS (SELECT e.vec_id, k.cell, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(k.centre AS DOUBLE[])) AS s FROM embeddings e, k)
SELECT vec_id, cell FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, cell) AS n FROM s) WHERE n <= 2""")
def ann_cells(spark, d):
    e = bridge.table(spark, d, "embeddings")
    k = e.where("vec_id < 8").select(c("vec_id").alias("cell"), c("embedding").alias("centre"))
    return retrieval.cells(e, k, 2, key="vec_id")


@query(O.symbols(f"SELECT id, usage_count FROM onl WHERE {O.ilike(['nosuchword'])} UNION ALL SELECT id, usage_count FROM (SELECT id, usage_count FROM onl WHERE {O.ilike(WORDS)} ORDER BY usage_count DESC, id LIMIT 20)"))
def fallback(spark, d):
    s = bridge.symbols(spark, d)
    first = retrieval.keyword_search(s, "nosuchword", []).select("id", "usage_count")
    return retrieval.with_fallback(first, retrieval.keyword_search(s, "red", WORDS).select("id", "usage_count"))


# Streams


@query("SELECT sha256(event_type || props) AS semantic_hash, count(*) > 0 AS seen FROM events GROUP BY 1")
def stream_dedup_jobs(spark, d):
    return enrich.dedup_jobs(spark, f"{d}/events.parquet").select("semantic_hash", F.lit(True).alias("seen"))


@query("""WITH h AS (SELECT DISTINCT sha256(event_type || props) AS semantic_hash FROM events)
SELECT semantic_hash, CAST(2 AS INTEGER) AS status, CAST(64 AS INTEGER) AS dims FROM h""")
def stream_enrich(spark, d):
    return enrich.enrich_jobs(spark, f"{d}/events.parquet").select("semantic_hash", "status", F.size("embedding").alias("dims"))


@query(O.symbols("SELECT id, CAST(CASE WHEN status = 1 THEN 2 ELSE status END AS INTEGER) AS status, status = 1 AS embedded FROM sym"))
def stream_worker(spark, d):
    """Jobs enqueued by hash, worked off by the stream, vectors written back to the rows of their hash."""
    root = f"{enrich.shared_root(spark)}/worker-{uuid4().hex[:12]}"
    none = F.lit(None).cast("array<float>")
    rows = bridge.symbols(spark, d).select("id", "name", "status", F.sha2(c("name"), 256).alias("semantic_hash"), none.alias("embedding"))
    store, vector = Snapshots(spark, f"{root}/symbols"), embedder(lambda texts: hashed(texts, 64))
    store.replace(rows)
    sinks.enqueue(rows.where("status = 1"), f"{root}/jobs")

    def write(jobs: DataFrame) -> None:
        s = store.read()
        docs = s.where("status = 1").join(jobs.select("semantic_hash"), "semantic_hash", "left_semi").select("semantic_hash", "name").dropDuplicates(["semantic_hash"])
        made = docs.select("semantic_hash", vector(c("name")).alias("v"))
        j = s.join(made, "semantic_hash", "left").withColumn("embedding", F.when(c("status") == 1, c("v")).otherwise(c("embedding")))
        store.replace(j.withColumn("status", F.when((c("status") == 1) & c("v").isNotNull(), 2).otherwise(c("status"))).select(s.columns))

    enrich.work(spark, f"{root}/jobs", f"{root}/state", write, per_minute=None)
    return store.read().select("id", "status", c("embedding").isNotNull().alias("embedded"))


# Hashes, keys, prompts and fallback texts


@query(O.symbols("""SELECT id, sha256('{"name":"' || name || '","type":"' || type || '","description":"' || description || '","signature":null,"sideEffects":["dom","timer"],"hooks":["' || hooks[1] || '"]}') AS hash,
sha256('{"name":"' || name || '","type":"' || type || '","description":null,"signature":"fn()","sideEffects":[],"hooks":[],"behavior":["a","b"]}') AS with_behavior FROM sym"""))
def semantic_hash(spark, d):
    none, null = F.array().cast("array<string>"), F.lit(None).cast("string")
    plain = hashes.semantic_hash(c("name"), c("type"), c("description"), null, text.strings(["timer", "dom"]), c("hooks"))
    behaving = hashes.semantic_hash(c("name"), c("type"), null, F.lit("fn()"), none, none, text.strings(["b", "a"]))
    return bridge.symbols(spark, d).select("id", plain.alias("hash"), behaving.alias("with_behavior"))


@query("SELECT conv_id, turn, 'rewrite:' || sha256(text) AS key, 'category:' || substring(sha256(text), 1, 16) AS short FROM conversations")
def cache_keys(spark, d):
    return bridge.table(spark, d, "conversations").select("conv_id", "turn", hashes.cache_key("rewrite:", c("text")).alias("key"), hashes.cache_key("category:", c("text"), 16).alias("short"))


@query("SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform([p_name, ' ' || p_name || ' ', '  ', p_type, lower(p_type)], lambda x: trim(x)), lambda x: len(x) > 0))) AS values FROM part")
def unique_strings(spark, d):
    pad = F.concat(F.lit(" "), "p_name", F.lit(" "))
    return bridge.table(spark, d, "part").select("p_partkey", F.array_sort(text.unique_strings(F.array("p_name", pad, F.lit("  "), "p_type", F.lower("p_type")))).alias("values"))


@query("SELECT doc_id, concat_ws(chr(10), source, nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), substring(text, 1, 50)) AS doc, CASE WHEN length(text) > 4000 THEN substring(text, 1, 4000) || chr(10) || '... cut' ELSE text END AS snippet FROM documents WHERE length(text) > 0")
def chunk_embed_text(spark, d):
    lang = F.when(c("doc_id") % 3 == 0, "").otherwise(c("lang"))
    rows = bridge.table(spark, d, "documents").where("length(text) > 0")
    return rows.select("doc_id", text.chunk_embed_text(c("source"), lang, F.lit(None).cast("string"), F.substring("text", 1, 50)).alias("doc"), render.snippet(c("text")).alias("snippet"))


_LABELS = "[" + ", ".join(f"'{x}'" for x in render.LABELS) + "]"


@query(O.symbols(f"""SELECT id, 'Looking for a ' || type || ' related to: ' || array_to_string(props, ', ') AS sentence,
'State in one English sentence what reusable code this request needs.' || chr(10) || 'Request: ' || name || chr(10) || 'Words: ' || array_to_string(props, ', ') AS prompt,
list_filter({_LABELS}, lambda x: contains(lower(path || ' ' || hooks[1]), x))[1] AS category FROM sym"""))
def rewriting(spark, d):
    reply = F.concat("path", F.lit(" "), F.element_at("hooks", 1))
    return bridge.symbols(spark, d).select("id", text.rewrite_fallback(c("type"), c("props")).alias("sentence"), render.rewrite_prompt(c("name"), c("props")).alias("prompt"), render.category_of_reply(reply).alias("category"))
