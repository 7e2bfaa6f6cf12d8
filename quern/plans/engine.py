"""The public entry points over a symbol table and a chunk table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import DEFAULT, Tuning
from quern.functions import paths, text
from quern.functions.render import LABELS
from quern.functions.scoring import cosine
from quern.operators import chunking, context, evals, extract, merge, ranking, relations, retrieval
from quern.schema import ONLINE, PENDING
from quern.ship import ship
from quern.sources import files, sinks
from quern.sources.embedder import embedder, hashed
from quern.sources.store import Snapshots
from quern.streaming.enrich import Counters, shared_root, work

STORED = "id bigint, name string, path string, type string, category string, description string, signature string, content string, meta_json string, props array<string>, hooks array<string>, callee_names array<string>, usage_count int, embedding array<float>, insert_user string, created_at timestamp, file_hash string, semantic_hash string, status int"
CHUNKS = "path string, chunk_index int, chunk_count int, content string, summary string, semantic_hash string, embedding array<float>, status int"


class Engine:
    """Symbols and chunks below one root, as snapshots.

    embed turns texts into vectors, rewrite a query and its keywords into a sentence (None: the
    fallback sentence). Reads are lazy DataFrames; writes make a new snapshot. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, embed: Callable[[list[str]], np.ndarray] = hashed, rewrite: Callable[[str, list[str]], str] | None = None, tuning: Tuning = DEFAULT, user: str = "system"):
        ship(spark)
        self.spark, self.tuning, self.embed, self.rewrite, self.user = spark, tuning, embed, rewrite, user
        self.symbol_store, self.chunk_store, self.jobs = Snapshots(spark, f"{root}/symbols"), Snapshots(spark, f"{root}/chunks"), f"{root}/jobs"

    # tables

    def symbols(self) -> DataFrame:
        now = self.symbol_store.read()
        return self.spark.createDataFrame([], STORED) if now is None else now

    def chunks(self) -> DataFrame:
        now = self.chunk_store.read()
        return self.spark.createDataFrame([], CHUNKS) if now is None else now

    def _vector(self, sentence: str) -> DataFrame:
        return self.spark.createDataFrame([([float(x) for x in self.embed([sentence])[0]],)], "q array<float>")

    def _as_of(self) -> DataFrame:
        return self.spark.range(1).select(F.current_timestamp().alias("as_of"))

    def _words(self, query: str) -> tuple[list[str], list[str], list[str]]:
        row = self.spark.range(1).select(text.query_keywords(query, self.tuning).alias("k"), text.search_tokens(query).alias("t"), text.literal_tokens(query).alias("l")).first()
        return row["k"], row["t"], row["l"]

    # retrieval

    def recommend(self, query: str, required_props: list[str] = (), required_hooks: list[str] = (), category: str | None = None, semantic: bool = True, limit: int = 5) -> DataFrame:
        """The best candidate and up to limit - 1 alternatives, best first; `semantic` is accepted and has no effect."""
        if not query or not 1 <= limit <= 10:
            raise ValueError("a query, and a limit of 1 to 10")
        types = self.spark.range(1).select(paths.infer_types(query, category).alias("t")).first()["t"]
        words, _, _ = self._words(query)
        sentence = self.rewrite(query, words) if self.rewrite else f"Looking for a {types[0]} related to: {', '.join(words)}"
        out = ranking.recommend(self.symbols(), query, words, self._vector(sentence), self._as_of(), sentence, types, limit, self.tuning)
        unique = lambda v: list(dict.fromkeys(x.strip() for x in v if x.strip()))
        return out.limit(limit).select(
            "id", "name", "type", "category", "path", "description", "usage_count", "final", "priority", "score", "similarity", F.concat_ws(" + ", "reason", F.nullif("notes", F.lit(""))).alias("reason"),
            retrieval.matched_required(unique(required_props), F.col("props")).alias("matched_props"), retrieval.matched_required(unique(required_hooks), F.col("hooks")).alias("matched_hooks"),
        )

    def reply(self, recommended: DataFrame) -> str:
        """Text of a recommendation; it has at most ten rows."""
        rows = recommended.collect()
        if not rows:
            return "No reusable candidate was found."
        first, others = rows[0], rows[1:]
        lines = [f"Recommended: {first['name']} ({first['type']})", f"Path: {first['path']}", f"Used {first['usage_count']} times; score {first['final']:.3f}", f"Why: {first['reason']}"]
        return "\n".join(lines + [f"Alternative: {r['name']} - {r['path']} ({r['final']:.3f})" for r in others])

    def search_symbols(self, query: str, type: str | None = None, ranked: bool = True, semantic: bool = False, limit: int = 20) -> DataFrame:
        if not 1 <= limit <= 100:
            raise ValueError("a limit of 1 to 100")
        types, (_, tokens, _) = ([type] if type else None), self._words(query)
        if semantic:
            none = self.spark.range(1).select(text.query_embed_doc(query, type or "component").alias("d")).first()["d"]
            return ranking.search_semantic(self.symbols(), query, tokens, self._vector(none), self._as_of(), types, limit, self.tuning)
        if ranked:
            return ranking.search_symbols(self.symbols(), query, tokens, self._as_of(), types, self.tuning.search_cap, self.tuning)
        rows = retrieval.keyword_search(self.symbols(), query, tokens, types)
        return rows.where(paths.is_reusable(F.col("name"), F.col("path"))).limit(self.tuning.search_cap)

    def search_by_structure(self, fields: list[str], type: str | None = None, category: str | None = None, limit: int = 20, ranked: bool = True) -> DataFrame:
        if not fields or not 1 <= limit <= 100:
            raise ValueError("at least one field, and a limit of 1 to 100")
        rows = retrieval.search_by_structure(self.symbols(), fields, limit, [type] if type else None, category, self.tuning)
        return ranking.rank_keyword(rows, " ".join(fields), self._as_of(), self.tuning).orderBy(F.desc("score"), F.desc("usage_count"), "id") if ranked else rows

    def symbol_detail(self, name: str) -> DataFrame:
        return retrieval.symbol_detail(self.symbols(), name).drop("embedding")

    def query_docs(self, query: str, limit: int = 8, adjacent_radius: int = 1, max_chars: int = 6000, max_chunks: int = 12, path: str | None = None) -> DataFrame:
        """One row: context text, number of chunks, whether any was left out."""
        return context.context_text(self.query_sources(query, limit, adjacent_radius, max_chars, max_chunks, path))

    def query_sources(self, query: str, limit: int = 8, adjacent_radius: int = 1, max_chars: int = 6000, max_chunks: int = 12, path: str | None = None) -> DataFrame:
        if not (1 <= limit <= 50 and 0 <= adjacent_radius <= 3 and max_chars >= 500 and 1 <= max_chunks <= 30):
            raise ValueError("a bound is exceeded")
        from dataclasses import replace

        chunks = self.chunks()
        found = chunks.where(F.col("status") == ONLINE)
        found = found if path is None else found.where(F.col("path") == path)
        key = F.concat_ws("#", "path", F.lpad(F.col("chunk_index").cast("string"), 8, "0"))
        hits = retrieval.vector_topk(found.withColumn("__k", key), self._vector(query.strip()), limit, key="__k").select("path", "chunk_index", "chunk_count", "content", "similarity")
        near = context.neighbours(hits, chunks, adjacent_radius).select("path", "chunk_index", "chunk_count", "content")
        return context.budget(context.gather(hits, near), replace(self.tuning, context_chars=max_chars, context_chunks=max_chunks))

    # mutation

    def inc_usage(self, symbol_id: int) -> bool:
        """Add one use; False, and no new snapshot, if there is no such symbol."""
        if self.symbols().where(F.col("id") == symbol_id).isEmpty():
            return False
        log = self.spark.createDataFrame([(symbol_id,)], "id bigint")
        self.symbol_store.update(lambda s: merge.add_usage(s, log), ("status", "type"))
        return True

    def reindex(self, root: str, patterns: tuple[str, ...] = ("ts", "tsx", "js", "jsx"), ignore: tuple[str, ...] = (), dry_run: bool = False, force: bool = False) -> dict:
        """Parse what has changed below root and merge it; vectors come from enrich()."""
        now, stored = files.source_files(self.spark, root, patterns, ignore), self.symbols()
        changed = now if force or dry_run else merge.changed_files(now, stored.select("path", "file_hash"))
        total, n = now.count(), changed.count()
        if n == 0:
            return {"root": str(Path(root)), "extracted": 0, "skipped": total, "enqueued": 0, "upserted": 0}
        rows = self._rows(self._parsed(changed))
        count = rows.count()
        if dry_run:
            return {"root": str(Path(root)), "extracted": count, "skipped": total - n, "enqueued": 0, "upserted": 0}
        if force:
            stored = merge.invalidate(stored, rows.select("semantic_hash"))
        out = merge.soft_delete(merge.merge_symbols(stored, rows), rows, changed.select("path"))
        self.symbol_store.replace(out, ("status", "type"))
        return {"root": str(Path(root)), "extracted": count, "skipped": total - n, "enqueued": sinks.enqueue(rows, self.jobs, "symbols"), "upserted": count}

    def work(self, once: bool = True, **options) -> Counters:
        """The worker of the jobs that reindex() has enqueued; see streaming.enrich.work()."""
        def write(jobs: DataFrame) -> None:
            self.enrich(jobs.where("symbols_table = 'symbols'").select("semantic_hash"))

        return work(self.spark, self.jobs, f"{self.jobs}-state", write, once=once, **options)

    def _parsed(self, changed: DataFrame) -> DataFrame:
        """The symbols of sources, written aside: what follows uses them several times, and parsing is the dear part."""
        aside = f"{shared_root(self.spark)}/parsed-{uuid.uuid4().hex[:12]}"
        extract.extract_symbols(changed).write.parquet(aside)
        return self.spark.read.schema(extract.ROW).parquet(aside)

    def _rows(self, found: DataFrame) -> DataFrame:
        exports = found.select(F.col("path").alias("file"), "name")
        edges = relations.call_edges(extract.calls_of(found), exports)
        callees = relations.first_k(edges, ["caller", "caller_path"], ["callee", "callee_path"]).groupBy(F.col("caller").alias("name"), F.col("caller_path").alias("path")).agg(F.sort_array(F.collect_set("callee")).alias("callee_names"))
        none = F.array().cast("array<string>")
        meta = F.to_json(F.struct("kind", "params", "props", "properties", "hooks", F.col("side_effects").alias("sideEffects"), F.col("return_type").alias("returnType")))
        out = found.dropDuplicates(["path", "name"]).join(callees, ["path", "name"], "left")
        key = F.xxhash64("path", "name")
        return out.select(
            key.alias("id"), "name", "path", "type", "category", "description", "signature", "content", meta.alias("meta_json"), F.array_distinct(F.concat("props", "params", "properties")).alias("props"), "hooks", F.coalesce("callee_names", none).alias("callee_names"),
            F.lit(0).alias("usage_count"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(self.user).alias("insert_user"), F.current_timestamp().alias("created_at"), "file_hash", "semantic_hash", F.lit(PENDING).alias("status"),
        )

    def ci_index(self, root: str, changes: DataFrame) -> None:
        """Deletions, renames and changed files of a change set, in one new snapshot."""
        s = self.symbols()
        gone = changes.where("op = 'deleted'").select("path")
        s = merge.soft_delete(s, s.limit(0), gone)
        s = merge.rename_paths(s, changes.where("op = 'renamed'"))
        now = files.source_files(self.spark, root).join(changes.where("op = 'changed'").select("path"), "path", "left_semi")
        rows = self._rows(self._parsed(now))
        self.symbol_store.replace(merge.soft_delete(merge.merge_symbols(s, rows), rows, now.select("path")), ("status", "type"))

    def enrich(self, hashes: DataFrame | None = None) -> int:
        """Vectors and categories of pending rows (of some hashes, or all): reused from online rows of the same hash, else embedded once a hash."""
        s = self.symbols()
        pending = s.where(F.col("status") == PENDING)
        pending = pending if hashes is None else pending.join(hashes.distinct(), "semantic_hash", "left_semi")
        n = pending.count()
        if n == 0:
            return 0
        none = F.array().cast("array<string>")
        doc = text.embed_doc(F.col("type"), F.col("name"), F.col("description"), F.col("signature"), none, F.col("hooks"), none)
        known = merge.reuse_vectors(pending.select("semantic_hash", doc.alias("doc")).dropDuplicates(["semantic_hash"]), s)
        vectors = known.withColumn("vector", F.coalesce("reused", F.when(F.col("reused").isNull(), embedder(self.embed)(F.col("doc"))))).select("semantic_hash", "vector")
        labels = self.embed(list(LABELS))
        categories = self.spark.createDataFrame([(c, [float(x) for x in v], k) for k, (c, v) in enumerate(zip(LABELS, labels))], "label string, vector array<float>, position int")
        j = s.join(vectors, "semantic_hash", "left").withColumn("embedding", F.when(F.col("status") == PENDING, F.col("vector")).otherwise(F.col("embedding"))).drop("vector")  # rows of other hashes have no vector and stay pending
        best = ranking.best_category(j.where((F.col("status") == PENDING) & F.col("category").isNull()).select("id", "embedding"), categories, self.tuning).select("id", F.col("category").alias("__c"))
        out = j.join(best, "id", "left").withColumn("category", F.coalesce("category", "__c")).withColumn("status", F.when((F.col("status") == PENDING) & F.col("embedding").isNotNull(), F.lit(ONLINE)).otherwise(F.col("status")))
        self.symbol_store.replace(out.select(s.columns), ("status", "type"))
        return n

    def upsert_documents(self, docs: DataFrame) -> int:
        """Replace the chunks of (path, content); they are embedded at once."""
        new = chunking.chunk_documents(docs, t=self.tuning)
        vector = embedder(self.embed)(text.chunk_embed_text(F.col("path"), F.col("path"), F.col("summary"), F.col("content")))
        new = new.withColumn("embedding", vector).withColumn("status", F.lit(ONLINE)).select(self.chunks().columns)
        return self.chunk_store.replace(merge.replace_documents(self.chunks(), new), ("path", "chunk_index")).count()

    # evaluation

    def evaluate(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """Metrics of a query set; the queries are run one by one, as a user's would be."""
        rows = []
        for q in queries.collect():
            names = [r["name"] for r in self.recommend(q["input"]["query"], category=q["input"]["category"], limit=limit).collect()]
            rows.append((q["id"], names, [(e["name"], e["rel"]) for e in q["expected"]], q["tags"]))
        runs = self.spark.createDataFrame(rows, "query_id string, returned array<string>, expected array<struct<name:string,rel:int>>, tags array<string>")
        return evals.evaluate(runs, self.tuning.main_k, self.tuning.wide_k)


def report(rows: DataFrame, failures: DataFrame | None = None) -> str:
    """Fixed-width text of an evaluation's metrics, tags and findings."""
    s = evals.summarise(rows)
    one = s.first().asDict()
    bar = lambda x: "#" * round(20 * min(1.0, x)) + "." * (20 - round(20 * min(1.0, x)))
    lines = [f"{k:<10} {bar(v)} {v:6.1%}" for k, v in one.items() if k != "zero_recall"] + [f"zero recall: {one['zero_recall']} queries"]
    lines += [f"  {r['tag']:<10} {r['queries']:>4} queries {r['recall']:6.1%}" for r in evals.recall_by_tag(rows).orderBy("tag").collect()]
    if failures is not None:
        lines += [f"- {r['finding']}" for r in evals.findings(s, failures).collect()]
    return "\n".join(lines)


def similarity_of(a: list[float], b: list[float], spark: SparkSession) -> float:
    return spark.range(1).select(cosine(F.array(*[F.lit(float(x)) for x in a]).cast("array<double>"), F.array(*[F.lit(float(x)) for x in b]).cast("array<double>")).alias("s")).first()["s"]
