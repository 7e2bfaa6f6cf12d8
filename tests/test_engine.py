"""Worked examples, the whole index-and-query cycle, and chunker properties."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import hashes, paths, scoring, text
from quern.operators import chunking, evals, extract, merge, retrieval
from quern.plans.engine import Engine, report, similarity_of
from quern.sources import files

SOURCES = {
    "types/models.ts": "export interface User { id: number; name?: string }\nexport type Box = { a: string; b?: number };\n",
    "utils/generic.ts": "export function identity<Item>(given: Item): Item { return given; }\n",
    "utils/calls.ts": "import { identity } from './generic';\nexport function callIt(x: number) { return identity(x); }\n",
    "utils/sideEffects.ts": "export async function load(url: string) { const r = await fetch(url); return r; }\nexport function keep(k: string) { localStorage.setItem(k, '1'); }\nexport function mut(obj: { x: number }) { obj.x = 1; }\n",
    "hooks/useDelay.tsx": "import { useState, useEffect } from 'react';\nexport function useDelay(ms: number) { const [a, s] = useState(0); useEffect(() => { setTimeout(() => s(1), ms); localStorage.getItem('a'); }, []); return a; }\n",
    "components/Card.tsx": "interface CardProps { title: string; onClose?: () => void }\nexport const Card = ({ title, onClose }: CardProps) => { return <div onClick={onClose}>{title}</div>; };\n",
    "components/Panel.jsx": "/**\n * A small panel.\n * @returns {object}\n */\nexport const Panel = ({ b, a }) => { sessionStorage.setItem('x', a); return <p>{a}</p>; };\n",
    "utils/measure.js": "/**\n * Measures.\n * @param {Window|HTMLElement} target el\n * @returns {object}\n */\nfunction measure(target) { const r = target.getBoundingClientRect(); return { top: r.top }; }\nmodule.exports = { measure };\n",
    "node_modules/x/skip.ts": "export const skip = () => 1;\n",
}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens_and_types(spark):
    assert one(spark, text.search_tokens("useDebounceInput组件 input")) == ["usedebounceinput", "input", "组件"]
    assert one(spark, text.search_tokens("表单输入框 form_item a")) == ["form_item", "表单", "单输", "输入", "入框"]
    for query, category, want in [("x", "util", ["function"]), ("x", "type", ["type", "interface"]), ("防抖 hook", None, ["hook"]), ("表单", None, ["component"]), ("formatDate", "function", ["component"])]:
        assert one(spark, paths.infer_types(query, category)) == want
    assert one(spark, paths.category_from_path(F.lit("src/components/hooks/a.ts"))) == "hooks"
    assert [one(spark, paths.category_from_name(F.lit(n))) for n in ("useAuth", "fetchUser", "foo")] == ["hook", "network", None]
    reusable = [("a", "src/a.test.js"), ("x", "src/demo/x.tsx"), ("MockX", "src/x.ts"), ("Affix", "src/components/Affix.tsx")]
    assert [one(spark, paths.is_reusable(F.lit(n), F.lit(p))) for n, p in reusable] == [False, False, False, True]


def test_scores(spark):
    got = [round(one(spark, scoring.usage_score(F.lit(n))), 4) for n in (3, 18, 40, 999, 1500)]
    assert got == [0.2007, 0.4263, 0.5376, 1, 1]
    assert [round(similarity_of(a, b, spark), 4) for a, b in (([], []), ([1, 0], [1]), ([0, 0], [1, 0]), ([1, 0], [1, 1]))] == [0, 0, 0, 0.7071]
    v = spark.createDataFrame([("A", 0), ("B", 1), ("C", 2)], "id string, rank int")
    w = spark.createDataFrame([("B", 0), ("D", 1)], "id string, rank int")
    rrf = {r["id"]: round(r["rrf"], 6) for r in retrieval.rrf(v, w).collect()}
    assert rrf == {"A": 0.016667, "B": 0.033060, "C": 0.016129, "D": 0.016393}
    assert one(spark, hashes.chunk_hash(F.lit("qa/a.md"), F.lit(0), F.lit("Hello"))) == "2183955e4e41e18cc0015750e8aa0963d9a95774c34c5c6331ad9a7a424468df"


def test_metrics(spark):
    row = spark.createDataFrame([("q", ["X", "A", "B"], [("A", 2), ("B", 1)], ["en"]), ("n", ["X"], [], ["en"])], "query_id string, returned array<string>, expected array<struct<name:string,rel:int>>, tags array<string>")
    got = {r["query_id"]: r for r in evals.evaluate(row).collect()}
    assert (got["q"]["recall_main"], got["q"]["mrr"], round(got["q"]["ndcg"], 4), got["q"]["top1"]) == (1, 0.5, 0.6590, False)
    assert got["n"]["recall_main"] is None and got["n"]["false_positive"]
    assert "recall" in report(evals.evaluate(row), spark.createDataFrame([("no_semantic_recall", 3)], "type string, n bigint"))


def test_chunks_of_worked_examples():
    assert chunking.split_text("Hello world\n\nFoo bar baz\n\nA long sentence", 20, 30, 5) == ["Hello world\n\nFoo bar baz", "r baz\n\nA long sentence"]
    assert chunking.windows("aaaaaaa. bbbbbbb. ccccccc", 10, 2) == ["aaaaaaa.", "a. bbbbbbb", "bb. cccccc", "ccc"]
    assert chunking.split_text("aaaaaaa. bbbbbbb. ccccccc", 8, 10, 2) == ["aaaaaaa.", "a.\n\na. bbbbbbb", "bb\n\nbb. cccccc", "cc\n\nccc"]
    assert chunking.blocks("# T\ntext\n```\n# code\n\nx\n```\nlast\n```\nopen") == ["# T", "text", "```\n# code\n\nx\n```", "last", "```\nopen"]


def test_chunks_cover_the_text():
    rng = random.Random(2)
    for _ in range(200):
        s = "".join(rng.choice("ab. \n#`!") for _ in range(rng.randint(0, 400)))
        got = chunking.split_text(s, 40, 60, 8)
        assert all(len(x) <= 8 + 2 + 60 for x in got) or any(len(b) > 60 for b in chunking.blocks(s))
        joined, at = "".join("".join(got).split()), 0
        for ch in "".join(s.split()):
            at = joined.find(ch, at)
            assert at >= 0


def test_merge_truth_table(spark):
    old = [(k, "p", str(k), h, v, 5, 0) for k, (h, v) in enumerate([("a", [1.0]), ("a", [1.0]), ("b", [1.0]), ("b", None), (None, [1.0]), (None, None)])]
    new = [(k, "p", str(k), "b", [2.0] if k == 0 else None, 0, 1) for k in range(6)]
    schema = "id int, path string, name string, semantic_hash string, embedding array<double>, usage_count int, status int"
    got = {r["id"]: (r["embedding"], r["status"], r["usage_count"]) for r in merge.merge_symbols(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == {0: ([2.0], 2, 5), 1: (None, 1, 5), 2: ([1.0], 2, 5), 3: (None, 1, 5), 4: ([1.0], 2, 5), 5: (None, 1, 5)}


def test_extraction():
    rows = {r["name"]: r for p, s in SOURCES.items() for r in extract.extract(p, s)}
    assert rows["User"]["properties"] == ["id", "name"] and rows["Box"]["kind"] == "typeAlias"
    assert rows["identity"]["params"] == ["$p0"] and rows["identity"]["signature"] == "fn<$T>" + "($p0:$T)=>$T"
    assert [rows[n]["side_effects"] for n in ("load", "keep", "mut")] == [["network"], ["storage"], ["mutation"]]
    d = rows["useDelay"]
    assert (d["type"], d["hooks"], d["side_effects"], d["params"]) == ("hook", ["useEffect", "useState"], ["storage", "timer"], ["$p0"])
    assert (rows["Card"]["type"], rows["Card"]["props"], rows["Card"]["params"]) == ("component", ["onClose", "title"], [])
    p = rows["Panel"]
    assert (p["type"], p["category"], p["description"], p["return_type"], p["params"]) == ("component", "components", "A small panel.", "object", ["a", "b"])
    m = rows["measure"]
    assert (m["signature"], m["behavior"], m["side_effects"], m["category"]) == ("fn($p0:object)=>object", ["reads dom layout"], ["dom"], "utils")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for p, s in SOURCES.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(s)
    return root


def test_index_and_query(spark, tree, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    assert e.reindex(str(tree), dry_run=True)["extracted"] == 11
    first = e.reindex(str(tree))
    assert (first["extracted"], first["skipped"], first["upserted"]) == (11, 0, 11)
    assert first["enqueued"] == e.symbols().select("semantic_hash").distinct().count()
    assert e.work(per_minute=None).failed == 0 and e.enrich() == 0  # the worker has written all vectors back
    assert e.reindex(str(tree)) == {"root": str(tree), "extracted": 0, "skipped": 8, "enqueued": 0, "upserted": 0}
    rows = {r["name"]: r for r in e.symbols().collect()}
    assert rows["callIt"]["callee_names"] == ["identity"] and all(r["status"] == 2 for r in rows.values())
    best = e.recommend("card title", required_props=["TITLE"])
    assert best.first()["name"] == "Card" and best.first()["matched_props"] == ["TITLE"]
    assert e.reply(best).startswith("Recommended: Card")
    assert "useDelay" in {r["name"] for r in e.search_symbols("usedelay").collect()}
    assert e.search_by_structure(["title", "onclose"]).first()["name"] == "Card"
    assert e.symbol_detail("measure").count() == 1 and e.symbol_detail("Measure").count() == 0
    key = rows["Card"]["id"]
    assert e.inc_usage(key) and not e.inc_usage(-1)
    assert e.symbol_detail("Card").first()["usage_count"] == 1
    (tree / "components/Card.tsx").write_text("export const Other = () => <b>hi</b>;\n")
    assert e.reindex(str(tree))["extracted"] == 1
    rows = {r["name"]: r for r in e.symbols().collect()}
    assert rows["Card"]["status"] == 0 and rows["Card"]["file_hash"] is None and rows["Other"]["status"] == 1
    e.ci_index(str(tree), files.change_set(spark, ["--deleted=utils/measure.js", "--renamed", "utils/calls.ts:lib/calls.ts", "--changed", "utils/generic.ts"]))
    rows = {r["name"]: r for r in e.symbols().collect()}
    assert rows["measure"]["status"] == 0 and rows["callIt"]["path"] == "lib/calls.ts"
    q = tmp_path / "q.jsonl"
    q.write_text("# note\n\n" + json.dumps({"id": "1", "input": {"query": "identity function"}, "expected": [{"name": "identity", "path": "x", "rel": 2}], "tags": ["en"]}) + "\n")
    out = e.evaluate(files.query_set(spark, str(q))).first()
    assert out["query_id"] == "1" and 0 <= out["recall_main"] <= 1


def test_documents(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "docs"))
    long = "\n\n".join(f"Paragraph {k} about topic{k}. " + "word " * 120 for k in range(6))
    docs = spark.createDataFrame([("a.md", long), ("b.md", "The kernel uses blue paint."), ("c.md", "")], "path string, content string")
    n = e.upsert_documents(docs)
    assert n == e.upsert_documents(docs) and n > 3
    r = e.query_docs("blue paint kernel").first()
    assert "blue paint" in r["context"] and r["chunks"] >= 1
    assert e.query_docs("paint", path="b.md").first()["chunks"] == 1
    with pytest.raises(ValueError):
        e.query_docs("x", limit=0)


def test_settings(tmp_path):
    (tmp_path / ".env").write_text("A=file\nB='two'\n# C=3\n")
    assert files.settings(str(tmp_path), {"A": "0", "B": "0", "C": "0"}, {"A": "env"}) == {"A": "env", "B": "two", "C": "0"}


def test_command_line(spark, tree, tmp_path, capsys):
    from quern import cli
    from quern.sources import sinks

    store = str(tmp_path / "cli")
    assert cli.main(["index", "--root", str(tree), "--store", store], spark) == 0
    assert cli.main(["enrich", "--store", store], spark) == 0
    q = tmp_path / "q.jsonl"
    q.write_text(json.dumps({"id": "1", "input": {"query": "identity function"}, "expected": [{"name": "identity", "path": "x", "rel": 2}], "tags": ["en"]}) + "\n")
    code = cli.main(["eval", "--store", store, "--queries", str(q), "--out", str(tmp_path / "out"), "--date", "2024-01-02"], spark)
    found = spark.read.json(str(tmp_path / "out" / "date=2024-01-02")).first()["recall_main"]
    assert code == int(found == 0)
    assert cli.main(["analyze", "--out", str(tmp_path / "out" / "date=2024-01-02")], spark) == 0
    assert cli.main(["ci-index", "--root", str(tree), "--store", store, "--deleted", "utils/generic.ts"], spark) == 0
    assert "recall" in capsys.readouterr().out
    assert Engine(spark, store).symbol_detail("identity").count() == 0
    rows = spark.createDataFrame([("a",), ("a",), ("",), (None,)], "semantic_hash string")
    assert sinks.enqueue(rows, str(tmp_path / "jobs")) == 1
    sinks.cache_write(spark.createDataFrame([("k", "v")], "key string, value string"), str(tmp_path / "cache"), 60)
    cache = spark.read.parquet(str(tmp_path / "cache"))
    asked = spark.createDataFrame([("k",), ("m",)], "key string")
    got = files.with_cache(asked, cache, "key", lambda d: d.withColumn("value", F.lit("new")), F.current_timestamp())
    assert {(r["key"], r["value"], r["cached"]) for r in got.collect()} == {("k", "v", True), ("m", "new", False)}


def test_flags(spark):
    from dataclasses import replace

    from quern.config import DEFAULT
    from quern.functions import render

    assert one(spark, text.query_keywords("useFormInput", replace(DEFAULT, split_camel=True))) == ["use", "form", "input"]
    assert one(spark, text.query_keywords("useFormInput component")) == ["useforminput"]
    assert one(spark, text.strip_noise("帮我找一个 date 组件")) == "date"
    asked = {"input onChange": "输入框 onChange", "弹窗 onChange": "dialog onChange", "string formatter": None, "Select 选择器 x": "下拉框 选择器 x", "tabs list": "tabs 列表", "date picker": None}
    assert {q: one(spark, text.synonym_variant(q)) for q in asked} == asked
    assert len(text.SYNONYMS) == 28 and one(spark, text.strip_noise("有没有现成的 date 组件实现")) == "date"
    assert one(spark, render.category_of_reply(F.lit("I think: Service."))) == "service"
    assert one(spark, render.delta(F.lit(0.5), F.lit(0.4))) == "+10.0%"
    assert one(spark, render.snippet(F.lit("x" * 5000), 10)).startswith("xxxxxxxxxx\n")


def test_synonyms_work_out_the_query_once(spark):
    nth = F.monotonically_increasing_id().cast("string")  # one more each time that it is worked out
    got = spark.range(0, 3, 1, 1).select(text.synonym_variant(F.concat(F.lit("List of inputs "), nth)).alias("v")).collect()
    assert [r["v"] for r in got] == [f"List of 输入框s {n}" for n in range(3)]
    odd = {None: None, "": None, "  ": None, "modal  popup": "dialog popup", "TextInput": "Text输入框", "输入框 输入 input textinput textfield": None, "İNPUT list": "İNPUT 列表", "\u212a checKbox": "\u212a 复选框", "tab\tTABLE": "tab 表格"}
    rows = spark.createDataFrame([(q,) for q in odd], "q string").select("q", text.synonym_variant(F.col("q")).alias("v")).collect()
    assert {r["q"]: r["v"] for r in rows} == odd


def test_worker_retries_and_returns_jobs(spark, tmp_path):
    from quern.sources import sinks
    from quern.streaming import enrich

    jobs, waits, seen = str(tmp_path / "jobs"), [], []
    sinks.enqueue(spark.createDataFrame([("a",), ("b",), ("a",)], "semantic_hash string"), jobs)

    def broken(batch):
        seen.append(sorted(r["semantic_hash"] for r in batch.collect()))
        raise ValueError("no model")

    run = lambda f, **k: enrich.work(spark, jobs, str(tmp_path / "state"), f, per_minute=None, sleep=waits.append, **k)
    assert run(broken, tries=3).failed == 1
    assert seen == [["a", "b"]] * 3 and waits == [5.0, 10.0]
    assert {(r["semantic_hash"], r["attempt"]) for r in spark.read.parquet(jobs).where("attempt = 1").collect()} == {("a", 1), ("b", 1)}
    done = []
    assert run(lambda batch: done.extend(r["semantic_hash"] for r in batch.collect())).failed == 0
    assert sorted(done) == ["a", "b"]
    assert enrich.attempt(lambda: None) == 1


def test_pointer_is_never_missing(spark, tmp_path):
    from quern.sources.store import Snapshots

    store = Snapshots(spark, str(tmp_path / "s"))
    assert store.read() is None
    store.replace(spark.range(3))
    store.replace(spark.range(5))
    assert store.read().count() == 5
    (tmp_path / "s" / "CURRENT").unlink()
    with pytest.raises(FileNotFoundError):
        store.read()
