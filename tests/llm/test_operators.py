"""Each operator against a brute-force version, and its defined results for unusual rows."""

import json
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import blobs, components, decontam, langid, linededup, media, media_encode, mixing, neardup, pii, quality, queries, sharding, store, text, tokens

from . import plain

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, __chance string, k string, id string, Shard string"


def odd_rows():
    """Nulls in any column, empty and very long texts, repeated rows and ties; extra columns have clashing names."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    long = " ".join(word[(i * i) % 14] + str(i % 97) for i in range(60_000))
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t", None, "a", 3), (4, long, "en", None, len(long)), (4, long, "en", None, len(long)), (5, "same text of nine words that is repeated here", "en", "b", 1), (6, "same text of nine words that is repeated here", "en", "b", 1), (None, "same text of nine words that is repeated here", "de", "b", 1), (7, "!!! ... ###", "fr", "b", 1), (8, "中文字符 \U0001d518 \x00 z", "en", "b", 1)]
    return [(*r, "x", "y", "z", "w") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOC)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


LABELS = "doc_id bigint, quality int, toxic int"


# --- text ---


def brute_words(s):
    out = []
    for ch in re.finditer(r"[0-9A-Za-z_À-῿₀-⿿぀-퟿-�\U00010000-\U0010ffff]", s):
        out.append((ch.start(), ch.group()))
    words, last = [], None
    for at, ch in out:
        alone = 0x3000 <= ord(ch) < 0xE000 or ord(ch) > 0xFFFF
        low = ch.lower() if ord(ch) < 0x100 else ch
        if last is not None and at == last + 1 and not alone and not was_alone:
            words[-1] += low
        else:
            words.append(low)
        last, was_alone = at, alone
    return words


def test_words_match_a_scan_by_character():
    rng = random.Random(3)
    alphabet = "aB9_ ,.\néÉ×«—中文。\U0001d518"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["x" * 700, None]
    data, offsets = text.utf8(pa.array(texts))
    folded = text.fold(data)
    h, doc, a, b = text.words(folded, offsets)
    got = defaultdict(list)
    for k, i, j in zip(doc, a, b):
        got[k].append(folded[i:j].tobytes().decode())
    for k, t in enumerate(texts):
        assert got[k] == brute_words(t or ""), t
    seen = {}
    for k, x, i, j in zip(doc, h, a, b):
        w = folded[i:j].tobytes()
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


# --- 1 token counts ---


def brute_tokens(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return len(parts)
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_token_counts_of_documents(spark, docs):
    ranks = tokens.read_ranks(tokens.VOCABULARY)
    import regex

    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, spark).collect()}
    memo = {}
    for r in docs.collect():
        n = 0
        for p in regex.findall(tokens.PATTERN, r.text):
            if p not in memo:
                memo[p] = brute_tokens(p.encode(), ranks)
            n += memo[p]
        assert got[r.doc_id] == n


def test_token_counts_of_random_bytes_and_long_runs():
    ranks = tokens.read_ranks(tokens.VOCABULARY)
    rng = random.Random(1)
    for _ in range(300):
        piece = bytes(rng.choice(b"aeinrst theo") for _ in range(rng.randint(0, 25)))
        assert tokens.count_tokens(piece, ranks) == brute_tokens(piece, ranks)
    assert 0 < tokens.count_tokens(b"ab" * 100_000, ranks) < 200_000


def test_token_counts_of_odd_rows(spark, odd, empty):
    got = tokens.token_counts(odd, spark).collect()
    assert len(got) == 11
    by = [(r.doc_id, r.n_tokens) for r in got]
    assert (None, None) in by and (1, None) in by and (2, 0) in by and by.count((4, dict(by)[4])) == 2
    assert tokens.token_counts(empty, spark).count() == 0


# --- 2 language ID ---


def test_language_accuracy_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    model = langid.train(train)
    j = langid.language_id(held, spark, model).join(held.select("doc_id", "lang"), "doc_id").toPandas()
    assert (j.predicted_lang == j.lang).mean() > 0.97
    assert (j.predicted_lang == "und").mean() < 0.01
    families = {r.lang: r.family for r in j[j.predicted_lang == j.lang].itertuples()}
    assert families == {"en": "germanic", "de": "germanic", "es": "romance", "fr": "romance"}
    kept = langid.keep_identified(held, spark, model)
    assert kept.schema == held.schema and kept.count() == (j.predicted_lang != "und").sum()


def test_language_query_equals_plain_votes(spark, docs):
    """The whole query, each document by itself with sums in plain Python."""
    model = langid.train(docs)
    got = {r.doc_id: (r.predicted_lang, r.confidence) for r in queries.op2_language_id(spark, SMALL).collect()}
    for r in docs.collect():
        lang, sure = plain.language(model, r.text, langid.MARGIN, langid.GRAM, langid.BITS)
        assert abs(got[r.doc_id][1] - sure) < 1e-5 and (got[r.doc_id][0] == lang or abs(sure - langid.MARGIN) < 1e-5)
    assert len(got) == docs.count()


def test_machines_are_optimal():
    """The machine's weights have a lower regularised loss than any of many others near them."""
    rng = np.random.default_rng(3)
    x = rng.random((80, 6))
    y = np.where(x @ [1, -1, 2, 0, 0, -2] + rng.normal(0, 0.3, 80) > 0, 1.0, -1.0)
    w, b = langid.svm(x, y, epochs=400, cost=2.0)
    weight = np.where(y > 0, len(y) / 2 / (y > 0).sum(), len(y) / 2 / (y < 0).sum()) * 2.0

    def loss(v):
        return 0.5 * v @ v + (weight * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) ** 2).sum()

    best = np.append(w, b)
    assert all(loss(best) <= loss(best + rng.normal(0, s, 7)) for s in (0.001, 0.01, 0.1, 1) for _ in range(200))


def test_language_of_three_families_and_of_one():
    texts = ["the cat and the dog", "der hund und die katze", "el perro y la gata", "kissa ja koira ovat"] * 15
    model = langid.fit(pa.array(texts), ["en", "de", "es", "fi"] * 15)
    assert list(langid.predict(model, pa.array(texts[:4]))[0]) == ["en", "de", "es", "fi"]
    one = langid.fit(pa.array(texts[:1]), ["en"])
    assert list(langid.predict(one, pa.array(["any thing", "12", None]))[0]) == ["en", "und", "und"]


def test_language_of_odd_rows(spark, odd, empty, docs):
    model = langid.train(docs)
    got = {(r.doc_id, r.predicted_lang) for r in langid.language_id(odd, spark, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und"), (None, "und")} <= got
    assert langid.language_id(empty, spark, model).count() == 0
    assert langid.keep_identified(odd, spark, model).columns == odd.columns
    nothing = langid.train(empty)
    assert {r.predicted_lang for r in langid.language_id(odd, spark, nothing).collect()} == {"und"}


# --- 3 sharding ---


def test_plan_respects_tiers_and_target():
    rng = random.Random(5)
    for _ in range(200):
        entries = [(f"p{i:03}", int(10 ** rng.uniform(1, 5)), rng.randint(1, 9)) for i in range(rng.randint(0, 60))]
        target, fan = 50_000, rng.randint(2, 5)
        runs = sharding.plan(entries, target, fan, 100)
        size = {p: n for p, n, _ in entries}
        used = [p for r in runs for p in r]
        assert len(used) == len(set(used)) and all(len(r) > 1 for r in runs)
        assert not any(size[p] >= target for p in used)
        assert all(sum(size[p] for p in r[:-1]) <= target for r in runs)


def test_shards_round_trip_and_versions(spark, odd, tmp_path):
    out, table = sharding.shard(odd, spark, target=1 << 20, rows=2, root=str(tmp_path / "t"))
    assert out.columns[: len(odd.columns)] == odd.columns
    assert out.columns[len(odd.columns) :] == ["_shard", "shard_bytes", "manifest_version"]
    key = lambda r: json.dumps(r, default=str, sort_keys=True)
    assert sorted(key(r.asDict()) for r in out.select(odd.columns).collect()) == sorted(key(r.asDict()) for r in odd.collect())
    assert table.version() == 2 and table.manifest(1).count() > table.manifest(2).count()
    table.append(odd.limit(3), 1)
    assert table.version() == 3 and table.read(odd.schema).count() == 14
    with pytest.raises(sharding.Conflict):
        table.commit(table.manifest(), 2)
    assert table.version() == 3 and table.read(odd.schema).count() == 14


def test_shards_of_an_empty_table_and_of_timestamps(spark, empty, tmp_path):
    out, table = sharding.shard(empty, spark, root=str(tmp_path / "e"))
    assert out.count() == 0 and table.version() == 1
    t = spark.range(40).select("id", F.timestamp_seconds(F.col("id") * 1000).alias("t"), F.col("id").cast("decimal(20,3)").alias("d"), F.array("id").alias("a"))
    back, _ = sharding.shard(t.repartition(8), spark, rows=3, root=str(tmp_path / "ts"))
    assert sorted(tuple(r)[:2] for r in back.collect()) == sorted(tuple(r)[:2] for r in t.collect())
    assert back.select("shard").distinct().count() < 8


def test_vacuum_keeps_what_others_use(spark, docs, tmp_path):
    """Another writer's files between data and commit, and what a reader of the last version still reads, stay."""
    table = sharding.ShardedTable(spark, str(tmp_path / "v"))
    d = docs.select("doc_id", "text")
    table.append(d, 20)
    other, done = sharding.ShardedTable(spark, table.root), []
    reader = table.read(d.schema)
    commit = other.commit

    def late(entries, after):
        assert table.vacuum() == 0  # the other writer's files are there, but no manifest names them yet
        done.append(commit(entries, after))
        return done[-1]

    other.commit = late
    other.append(d.limit(30), 10)
    assert table.compact() == done[0] + 1 and table.vacuum() == 0
    assert reader.count() == d.count() and table.read(d.schema).count() == d.count() + 30
    gone = table.vacuum(-60)
    assert gone > 0 and table.read(d.schema).count() == d.count() + 30 and table.vacuum(-60) == 0
    names = {f.name for f in (tmp_path / "v/data").rglob("*.parquet")}
    assert names == {r.path.rsplit("/", 1)[1] for r in table.manifest().collect()}


def test_plans_of_parts_of_a_manifest(spark, docs, tmp_path):
    table = sharding.ShardedTable(spark, str(tmp_path / "p"))
    table.append(docs.select("doc_id", "text"), 5)
    before = table.manifest().count()
    table.compact(target=60_000, fan_in=3, planned=10)
    after = table.manifest().collect()
    assert len(after) < before and sum(r.rows for r in after) == docs.count()
    assert sorted(r.doc_id for r in table.read(docs.select("doc_id", "text").schema).collect()) == sorted(r.doc_id for r in docs.collect())


def test_shards_of_clashing_names(spark, tmp_path):
    df = spark.range(9).selectExpr("id", "id AS __shard", "id AS shard", "'x' AS _metadata", "id AS __shard_bytes", "id AS manifest_version")
    out, _ = sharding.shard(df, spark, rows=2, root=str(tmp_path / "c"))
    assert out.columns == [*df.columns, "_shard", "shard_bytes", "_manifest_version"]
    assert sorted(tuple(r) for r in out.select(df.columns).collect()) == sorted(tuple(r) for r in df.collect())


# --- 4 near duplicates ---


def brute_groups(rows, threshold=neardup.THRESHOLD):
    """Pairs (key, lowest key of its group) by sets of word strings, without the operator's hashes."""
    sets = {}
    for k, (_, t) in enumerate(rows):
        w = brute_words(t or "")
        if w:
            sets[k] = {tuple(w[i : i + neardup.SHINGLE]) for i in range(max(1, len(w) - neardup.SHINGLE + 1))}
    by = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            by[x].append(k)
    both = defaultdict(int)
    for ks in by.values():
        for i in range(len(ks)):
            for j in range(i + 1, len(ks)):
                both[ks[i], ks[j]] += 1
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    pairs = {(a, b) for (a, b), n in both.items() if n >= threshold * (len(sets[a]) + len(sets[b]) - n)}
    for a, b in pairs:
        a, b = sorted((top(rows[a][0]), top(rows[b][0])))
        parent[b] = a
    return {(x, top(x)) for x in list(parent) if top(x) != x}


def test_near_duplicates_equal_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {tuple(r) for r in neardup.near_duplicates(docs, spark).collect()}
    want = brute_groups(rows)
    assert len(got & want) >= 0.9 * len(want) and got <= want and len(want) > 10


def test_near_duplicates_of_made_groups(spark):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 400))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(len(w) * rng.choice([0, 2, 4]) // 100):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, " ".join(w)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in neardup.near_duplicates(df, spark).collect()}
    want = brute_groups(rows)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)
    assert neardup.keep_one(df, spark).count() == len(rows) - len(got)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**44, 3000).astype(np.uint64), rng.integers(0, 2**44, 3000).astype(np.uint64)
    both = np.concatenate([a[:2000], b])
    one = lambda x: neardup.sketch(x, np.zeros(len(x), np.int64), 1)
    assert (np.maximum(one(a[:2000]), one(b)) == one(both)).all()
    for share in (0.0, 0.3, 0.6, 0.9):
        k = int(3000 * 2 * share / (1 + share))
        c = np.concatenate([a[:k], b[: 3000 - k]])
        j = neardup.jaccard_mle(one(a), one(c), np.array([3000]), np.array([3000]))[0]
        assert abs(j - share) < 0.12


def test_near_duplicates_of_odd_rows(spark, odd, empty):
    assert [tuple(r) for r in neardup.near_duplicates(odd, spark).collect()] == [(6, 5)]
    kept = neardup.keep_one(odd, spark)
    assert kept.schema == odd.schema
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8]
    clash = odd.withColumns({c: F.lit(c) for c in ("h", "gone", "_gone_h", "n", "json", "__row", "__gone", "__many", "sid")})
    kept = neardup.keep_one(clash, spark)
    assert kept.schema == clash.schema and kept.count() == 9
    assert neardup.near_duplicates(empty, spark).count() == 0 and neardup.keep_one(empty, spark).count() == 0


def test_near_duplicates_of_any_keys(spark):
    copy = "one two three four five six seven eight nine ten"
    rows = [("b9", copy), ("a1", copy), ("c", "nothing that any other row has in it"), ("c", copy + " eleven"), ("c", "nothing that any other row has in it"), ("d", "a clean text of its own"), (None, copy)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id string, text string, extra int")
    assert sorted(tuple(r) for r in neardup.near_duplicates(df, spark).collect()) == [("b9", "a1"), ("c", "a1")]
    kept = sorted((r.doc_id or "", r.text, r.extra) for r in neardup.keep_one(df, spark).collect())
    assert kept == [("", copy, 6), ("a1", copy, 1), ("c", rows[2][1], 2), ("d", rows[5][1], 5)]
    days = df.where("doc_id is not null").selectExpr("date_add(date'2024-01-01', ascii(doc_id)) AS doc_id", "text")
    assert neardup.near_duplicates(days, spark).count() == 2 and neardup.keep_one(days, spark).count() == 3


def test_large_buckets_are_compared_block_by_block():
    rng = np.random.default_rng(1)
    key = np.repeat(np.array([5, 6, 7], np.uint64), [41, 9, 1])
    doc = rng.permutation(1000)[:51].astype(np.uint64)

    def pairs(block):
        sent = blobs.scatter_all([(key, doc)], 1)
        return {(a, b) for r in neardup._shared_buckets(sent, block) for m in r.column(1).to_pylist() for a in m for b in m if a < b}

    assert pairs(4) == pairs(7) == pairs(1000) and len(pairs(4)) == 41 * 40 // 2 + 9 * 8 // 2


def test_blobs_hold_what_was_sent():
    rng = np.random.default_rng(2)
    chunks = [(rng.integers(0, 2**63, n).astype(np.uint64), rng.integers(0, 9, n)) for n in (5, 0, 700, 3)]
    sent = list(blobs.scatter_all(chunks, 7))
    assert len(sent) == 1  # gathered over chunks
    for b in range(7):
        got = blobs.gather([r.filter(pa.array(np.asarray(r.column(0)) == b)) for r in sent], 2)
        want = [(k, v) for keys, values in chunks for k, v in zip(keys.tolist(), values.tolist()) if k % 7 == b]
        assert sorted(zip(got[0].tolist(), got[1].tolist())) == sorted(want)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7)]
    scratch = store.Scratch(spark, "test")
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint"), scratch).collect())
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


# --- 5 quality ---


def test_quality_gradients():
    net = quality.new_network()
    data, offsets = text.utf8(pa.array(["The quick brown fox, " * 60, "a", "pq!!rs" * 30]))
    x = quality.Layout(data, offsets)
    z, kept = quality.forward(net, x)
    grads = quality.backward(net, x, kept, np.array([1.0, -0.5, 2.0], np.float32))
    value = lambda: float(quality.forward(net, x)[0].astype(np.float64) @ [1.0, -0.5, 2.0])
    for name, at, g in (("embed", (104, 1), grads[0]), ("conv", (9, 2), grads[1]), ("bias", (3,), grads[2]), ("out", (5,), grads[3]), ("base", (0,), grads[4])):
        a = getattr(net, name)
        a[at] += 5e-3
        up = value()
        a[at] -= 1e-2
        down = value()
        a[at] += 5e-3
        assert abs((up - down) / 1e-2 - g[at]) < 0.05 * max(1, abs(g[at]))


def test_quality_is_the_same_alone_and_in_a_batch_and_covers_the_end():
    net = quality.new_network()
    texts = ["x" * 5000, "ab", "", "hello world " * 400, None, "y" * 511, "z" * 512, "q" * 513]
    together = quality.probabilities(net, pa.array(texts))
    alone = np.array([quality.probabilities(net, pa.array([t], pa.string()))[0] for t in texts])
    assert np.allclose(together, alone, atol=1e-6) and together[2] == together[4] == 0
    net.bias[:] = 0
    a, b = quality.probabilities(net, pa.array(["a" * 9000, "a" * 8990 + "@@!!##$$%%"]))
    assert a != b


def test_quality_query_equals_plain_convolution(spark, docs):
    """The whole query, every window of every document by itself."""
    net = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    got = {r.doc_id: r.quality for r in queries.op5_quality(spark, SMALL).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert abs(got[r.doc_id] - plain.convolution(net, r.text, quality.WIDTH, quality.STRIDE, quality.CHUNK)) < 1e-4


def test_quality_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    l = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    p = quality.quality(d, l.where("doc_id % 4 <> 0"), spark).withColumnRenamed("quality", "p").join(l.where("doc_id % 4 = 0"), "doc_id").toPandas()
    assert ((p.p > 0.5) == (p.quality == 1)).mean() > 0.88


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (None, None, None), (99, 1, 0)], LABELS)
    got = {r.doc_id: r.quality for r in quality.quality(odd, labels, spark).collect()}
    assert got[1] == got[2] == 0 and 0 < got[5] < 1 and got[5] == got[6]
    none = spark.createDataFrame([], LABELS)
    assert {r.quality for r in quality.quality(odd, none, spark).where("doc_id = 5").collect()} == {0.5}
    assert quality.quality(empty, labels, spark).count() == 0


# --- 6 decontamination ---


def brute_tiles(p, t, least):
    """Greedy string tiling by comparing all pairs of starts."""
    fp, ft, out = [True] * len(p), [True] * len(t), []
    while True:
        best = []
        for i in range(len(p)):
            for j in range(len(t)):
                k = 0
                while i + k < len(p) and j + k < len(t) and p[i + k] == t[j + k] and fp[i + k] and ft[j + k]:
                    k += 1
                if k >= least:
                    best.append((-k, i, j))
        if not best:
            return out
        top = -min(best)[0]
        for n, i, j in sorted(best):
            if -n == top and all(fp[i : i + top]) and all(ft[j : j + top]):
                fp[i : i + top] = [False] * top
                ft[j : j + top] = [False] * top
                out.append((top, i, j))


def test_tiles_equal_brute_force():
    rng = random.Random(4)
    for _ in range(250):
        size = rng.choice([3, 8, 40])
        p = [rng.randrange(size) for _ in range(rng.randint(0, 45))]
        t = [rng.randrange(size) for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, max(0, len(p) - 1))
            t += p[i : i + rng.randint(0, 45)] + [rng.randrange(size)]
        least = rng.choice([3, 5])
        got = decontam.tile(np.array(p, np.uint64), np.array(t, np.uint64), least)
        want = brute_tiles(p, t, least)
        assert sum(x[0] for x in got) == sum(x[0] for x in want)
        assert [x[0] for x in got] == sorted((x[0] for x in want), reverse=True)
        for n, i, j in got:
            assert p[i : i + n] == t[j : j + n]


def test_contamination_equals_brute_force(spark, docs):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, spark).collect()}
    passes = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench, spark, pass_chars=2000).collect()}
    items = [(r.item_id, brute_words(r.text)) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        w = brute_words(r.text)
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i, p in items:
            seeds = [k for k in range(len(p) - 4) if tuple(p[k : k + 5]) in grams]
            if len({q for k in seeds for q in range(k, k + 5)}) >= 0.5 * len(p):
                ids = {x: n for n, x in enumerate(sorted({*w, *p}))}
                if sum(x[0] for x in decontam.tile(np.array([ids[x] for x in p], np.uint64), np.array([ids[x] for x in w], np.uint64))) >= 0.5 * len(p):
                    want.add((r.doc_id, i))
    assert got == want == passes and want


def test_reordered_passages_are_caught(spark):
    p = [f"b{i}" for i in range(40)]
    moved = p[20:40] + ["x", "y"] + p[:20]
    docs = spark.createDataFrame([(1, " ".join(["q"] * 5 + moved + ["z"])), (2, " ".join(p[:12])), (3, " ".join(reversed(p)))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, " ".join(p)), (8, "b1 b2"), (9, None), (None, "b1")], "item_id bigint, text string")
    got = decontam.contaminated(docs, bench, spark).collect()
    assert [(r.doc_id, r.item_id, r.coverage, r.tiles, r.longest_tile) for r in got] == [(1, 7, 1.0, 2, 20)]
    assert [r.doc_id for r in decontam.keep_clean(docs, bench, spark).collect()] == [2, 3]
    named = bench.selectExpr("concat('i', item_id) AS name", "text AS body")
    got = decontam.contaminated(docs.selectExpr("concat('d', doc_id) AS k", "text"), named, spark, key="k", item_text="body", item_key="name")
    assert [(r.k, r.item_id) for r in got.collect()] == [("d1", "i7")]


def test_contamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "same text of nine words that is repeated here")], "item_id bigint, text string")
    got = decontam.contaminated(odd, bench, spark).collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 5, 6]
    kept = decontam.keep_clean(odd, bench, spark)
    assert kept.columns == odd.columns and kept.count() == 8
    assert decontam.contaminated(empty, bench, spark).count() == 0
    assert decontam.contaminated(odd, bench.limit(0), spark).count() == 0 and decontam.keep_clean(odd, bench.limit(0), spark).count() == 11


# --- 7 line dedup ---


def brute_lines(rows, least=linededup.LEAST_WORDS):
    lines = sorted({(i, k, tuple(brute_words(x))) for i, t in rows if i is not None for k, x in enumerate((t or "").split("\n")) if brute_words(x)})
    out = set()
    for n, (i, k, w) in enumerate(lines):
        for i2, k2, w2 in lines[:n]:
            if w == w2 or max(len(w), len(w2)) >= least and one_edit(w, w2):
                out.add((i, k, i2, k2))
                break
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_lines_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(n, "\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 4)))) for n in range(160)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {tuple(r) for r in linededup.duplicate_lines(df, spark).collect()} == brute_lines(rows)


def test_lines_of_any_keys(spark):
    line, near = "one two three four five six seven eight", "one two three four five six seven nine"
    df = spark.createDataFrame([("b", line), ("a1", f"intro\n{near}"), ("c", "INTRO"), (None, line), ("a1", None)], "id string, text string")
    assert sorted(tuple(r) for r in linededup.duplicate_lines(df, spark, key="id").collect()) == [("b", 0, "a1", 1), ("c", 0, "a1", 0)]
    # of a chain only the first line stays, though the third is two words from it
    chain = spark.createDataFrame([(1, line), (2, near), (3, near.replace("one", "none"))], "id int, text string")
    got = linededup.duplicate_lines(chain, spark, key="id")
    assert sorted(tuple(r) for r in got.collect()) == [(2, 0, 1, 0), (3, 0, 2, 0)] and dict(got.dtypes)["kept_id"] == "int"


def test_lines_of_odd_rows(spark, odd, empty):
    got = {tuple(r) for r in linededup.duplicate_lines(odd, spark).collect()}
    assert got == {(6, 0, 5, 0)}
    assert linededup.duplicate_lines(empty, spark).count() == 0


def test_word_edits():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.randrange(3) for _ in range(rng.randint(0, 6))] for _ in range(2))
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, old = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(old[j] + 1, d[-1] + 1, old[j - 1] + (x != y)))
        assert linededup.word_edits(np.array(a), np.array(b), 6) == d[-1]


# --- 8 mixing ---


def test_rates_solve_the_least_squares(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([3, 1, 0.5], 400)
    n = rng.integers(1, 200, 400)
    df = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n bigint, p array<double>")
    names = ["a", "b", "c"]
    found = mixing.solve(df, names, {"a": 0.3, "b": 0.3, "c": 0.4})
    r = mixing.rates(p, found.history)
    assert (r >= 0).all() and np.allclose((r * n) @ p / n.sum(), [0.3, 0.3, 0.4], atol=1e-4)
    # of all rates that meet the targets these are nearest to 1: moving along what keeps the shares only leads away
    away = rng.normal(size=(50, 400))
    a = (n[:, None] * p).T
    for move in away:
        move -= np.linalg.pinv(a) @ (a @ move)
        other = r + 0.01 * move
        assert (other < 0).any() or (n * (other - 1) ** 2).sum() > (n * (r - 1) ** 2).sum()
    hard = mixing.solve(df, names, {"a": 0.9, "b": 0.05, "c": 0.05})  # only the purest documents can serve it
    r = mixing.rates(p, hard.history)
    assert len(hard.history) < 40 and np.allclose((r * n) @ p / n.sum(), [0.9, 0.05, 0.05], atol=1e-4)
    even = spark.createDataFrame([(10, [1.0, 0.0])], "n bigint, p array<double>")
    out = mixing.solve(even, ["a", "b"], {"a": 0.5, "b": 0.5})
    assert abs(mixing.rates(np.array([[1.0, 0.0]]), out.history)[0] - 0.5) < 1e-3  # b is out of reach


def test_mixing_query_is_a_least_squares_optimum(spark, docs):
    """The whole query: words and posteriors counted by hand, and rates that no nonnegative ones beat (first-order conditions)."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    names = sorted(mixing.TARGETS)
    model = mixing.train(docs, labels, names)
    got = {r.doc_id: r for r in queries.op8_mixing(spark, SMALL).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    memo = {}

    def bucket(w):
        if w not in memo:
            raw = np.frombuffer(w.encode(), np.uint8)
            memo[w] = int(text.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0] >> np.uint64(64 - mixing.WORD_BITS))
        return memo[w]

    for r in rows:
        words = brute_words(r.text)
        assert got[r.doc_id].n_tokens == len(words)
        z = np.array(plain.gram_means(r.text.encode(), model.grams, mixing.GRAM, mixing.GRAM_BITS)) + model.bias
        z += sum((model.words[bucket(w)].astype(float) for w in words), np.zeros(len(names))) / max(1, len(words))
        p = np.exp(z - z.max())
        p /= p.sum()
        assert np.abs(p - [got[r.doc_id][f"p_{x}"] for x in names]).max() < 1e-5
    n = np.array([x.n_tokens for x in got.values()], float)
    p = np.array([[x[f"p_{c}"] for c in names] for x in got.values()])
    rate = np.array([x.rate for x in got.values()])
    a = (n[:, None] * p).T / n.sum()
    residual = a @ rate - np.array([mixing.TARGETS[c] for c in names])
    slope = p @ residual  # of the squared residual, a token
    assert (rate >= 0).all() and np.abs(slope[rate > 0]).max() < 1e-3 and slope[rate == 0].min(initial=0) > -1e-3


def test_mixture_meets_its_targets(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    r = mixing.document_rates(docs, labels, spark).toPandas()
    for name, share in mixing.TARGETS.items():
        assert abs((r.rate * r.n_tokens * r[f"p_{name}"]).sum() / r.n_tokens.sum() - share) < 1e-3
    known = r.merge(labels.toPandas(), on="doc_id")
    best = known[["p_good", "p_low", "p_toxic"]].to_numpy().argmax(1)
    truth = np.where(known.toxic == 1, 2, np.where(known.quality == 0, 1, 0))
    assert (best == truth).mean() > 0.8
    mixed = mixing.mix(docs, labels, spark)
    assert mixed.schema == docs.schema
    n = mixed.groupBy("doc_id").count().toPandas().merge(r, on="doc_id", how="right").fillna(0)
    assert ((n["count"] == np.floor(n.rate)) | (n["count"] == np.floor(n.rate) + 1) | (abs(n.rate - n.rate.round()) < 1e-5)).all()


def test_mixture_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 0), (None, 1, 1), (6, None, None)], LABELS)
    r = mixing.document_rates(odd, labels, spark).collect()
    assert len(r) == 11 and all(x.rate >= 0 for x in r) and {x.n_tokens for x in r if x.doc_id in (1, 2, 3, 7)} == {0}
    assert mixing.mix(odd, labels, spark).columns == odd.columns
    assert mixing.mix(odd, labels, spark).count() >= 0
    none = spark.createDataFrame([], LABELS)
    assert {x.p_good for x in mixing.document_rates(odd, none, spark).collect()} == {round(1 / 3, 6)}
    assert mixing.document_rates(empty, labels, spark).count() == 0 and mixing.mix(empty, labels, spark).count() == 0


# --- 9 media ---


@pytest.mark.parametrize("shape", [(24, 20), (1, 1), (17, 33), (64, 48), (100, 37)])
@pytest.mark.parametrize("restart", [0, 3])
def test_coefficients_round_trip(shape, restart):
    rng = np.random.default_rng(shape[0])
    base = rng.integers(0, 255, (shape[0] // 4 + 2, shape[1] // 4 + 2, 3))
    img = np.kron(base, np.ones((4, 4, 1)))[: shape[0], : shape[1]].astype(np.uint8)
    for scale in (0.05, 0.4, 2):
        parts, _ = media_encode.quantised(img, scale)
        image = media.coefficients(media_encode.encode(img, scale, restart))
        for c, (_, _, rows, columns, z) in zip(image.components.values(), parts):
            assert (c.rows, c.columns) == (rows, columns)
            for y in range(c.own_rows):
                for x in range(c.own_columns):
                    at = 64 * (y * c.columns + x)
                    assert c.blocks[at : at + 64].tolist() == z[y * columns + x]
    smooth = np.full((*shape, 3), 90, np.uint8)
    assert np.abs(media.decode(media_encode.encode(smooth, 0.05, restart)).astype(int) - 90).max() <= 2


def test_early_scans_give_a_coarser_picture():
    img = media_encode.picture(np.sin(np.arange(64.0)), 40, 40)
    data = media_encode.encode(img, 0.1)
    scans = [m.start() for m in re.finditer(b"\xff\xda", data)]
    error = lambda d: np.abs(media.decode(d).astype(float) - img).mean()
    assert error(data[: scans[1]]) > error(data[: scans[5]]) > error(data)


def test_tensors_of_odd_images(spark):
    good = media_encode.encode(media_encode.picture(np.zeros(64)))
    rows = [(1, bytearray(good)), (None, bytearray(good)), (2, None), (3, bytearray(b"")), (4, bytearray(b"\xff\xd8 no")), (5, bytearray(good[:40])), (6, bytearray(good[:-60])), (1, bytearray(good))]
    got = media.rgb_tensors(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, jpeg binary, rgb string")).collect()
    assert [(r.height, r.error is None) for r in got] == [(24, True), (24, True), (None, True), (None, False), (None, False), (None, False), (24, True), (24, True)]
    assert len(got[0].rgb) == 24 * 20 * 3
    rng = random.Random(1)
    for _ in range(200):
        bad = bytearray(good)
        for _ in range(3):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            media.decode(bytes(bad))
        except (ValueError, IndexError, media.struct.error):
            pass
    assert media.rgb_tensors(spark.createDataFrame([], "doc_id bigint, jpeg binary")).count() == 0


def test_media_query_equals_a_plain_decoder(spark):
    """The whole query: the pictures as encoded, decoded bit by bit."""
    files = {r.vec_id: bytes(r.jpeg) for r in media_encode.pictures(spark.read.parquet(f"{SMALL}/embeddings.parquet")).collect()}
    got = queries.op9_media(spark, SMALL).collect()
    assert len(got) == len(files) == spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    for r in got:
        want = np.array(plain.jpeg(files[r.vec_id]))
        assert r.error is None and np.abs(np.frombuffer(r.rgb, np.uint8).reshape(want.shape).astype(int) - want).max() <= 1


@pytest.mark.parametrize("shape,restart", [((33, 50), 0), ((50, 33), 2), ((8, 70), 1)])
def test_decoder_equals_a_plain_one(shape, restart):
    img = np.random.default_rng(shape[0]).integers(0, 255, (*shape, 3)).astype(np.uint8)
    for scale in (0.05, 1):
        data = media_encode.encode(img, scale, restart)
        assert np.abs(media.decode(data).astype(int) - np.array(plain.jpeg(data))).max() <= 1


def test_large_pictures(spark, monkeypatch):
    """Sizes are bounded by what Arrow holds and by the file's own length, not by a number of pixels."""
    img = np.kron(np.arange(40 * 30).reshape(40, 30) % 200, np.ones((64, 64)))[..., None].repeat(3, 2).astype(np.uint8)  # 2560 x 1920
    data = media_encode.encode(img, 0.4)
    assert np.abs(media.decode(data).astype(int) - img).mean() < 3
    at = data.index(b"\xff\xc2") + 5
    for height, width in ((65535, 65535), (20000, 20000)):
        with pytest.raises(media.JpegError):
            media.decode(data[:at] + media.struct.pack(">HH", height, width) + data[at + 4 :])
    monkeypatch.setattr(media, "BATCH_BYTES", 3000)  # two tensors a batch at most: batches are cut by bytes
    good = media_encode.encode(media_encode.picture(np.zeros(64)))
    rows = [(k, bytearray(good)) for k in range(7)]
    got = media.rgb_tensors(spark.createDataFrame(rows, "doc_id bigint, jpeg binary").coalesce(1)).collect()
    assert sorted(r.doc_id for r in got) == list(range(7)) and {len(r.rgb) for r in got} == {1440}


# --- 10 personal data ---


@pytest.fixture(scope="module")
def field():
    return pii.train()


def test_personal_data_held_out(field):
    made, cache, right, found, wanted = pii.Generator(1234), {}, 0, 0, 0
    for _ in range(400):
        t, want = made.sentence()
        got = {(a, b, k) for _, a, b, k in pii.find(field, pa.array([t]), cache)}
        right, found, wanted = right + len(got & set(want)), found + len(got), wanted + len(want)
    assert right / found > 0.98 and right / wanted > 0.98


def test_segmentation_equals_enumeration(field):
    """The dynamic program's score is that of the best of all segmentations."""
    def total(r, pieces):
        s, before = 0.0, 0
        for i, j, t in pieces:
            s, before = s + field.moves[before, t] + (field.score(r.key(i, j))[t] if t else 0), t
        return s

    def every(r, spans, at=0):
        if at == len(r.atoms):
            yield []
            return
        for rest in every(r, spans, at + 1):
            yield [(at, at + 1, 0), *rest]
        for i, j in spans:
            if i == at:
                for rest in every(r, spans, j):
                    for t in range(1, len(pii.TYPES)):
                        yield [(i, j, t), *rest]

    for t in ("12.3", "a@b", "+1 2", "7-8"):
        r = pii.Region(t)
        best = max(total(r, x) for x in every(r, pii._spans(r)))
        found = pii.decode(field, r, {})
        at = {x: k for k, x in enumerate(r.start)}
        pieces, k = [], 0
        for s, e, kind in found:
            pieces += [(x, x + 1, 0) for x in range(k, at[s])] + [(at[s], at[e], kind)]
            k = at[e]
        pieces += [(x, x + 1, 0) for x in range(k, len(r.atoms))]
        assert abs(total(r, pieces) - best) < 1e-9


def test_personal_data_of_documents(spark, field):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    patterns = {"email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "ip": r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "card": r"\b\d{16}\b", "secret": r'(?<=token = ")[0-9a-f]+'}
    want = {(r.doc_id, m.start(), m.end(), k) for r in d.collect() for k, p in patterns.items() for m in re.finditer(p, r.text)}
    got = {tuple(r) for r in pii.personal_data(d, spark, model=field).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.03 * len(want)


def test_personal_data_of_odd_rows(spark, field, odd, empty):
    assert pii.personal_data(empty, spark, model=field).count() == 0
    rows = [(1, "mail jo@ex.org"), (None, "jo@ex.org now"), (2, None), (3, ""), (4, "call +1 (555) 555-1234"), (4, "call +1 (555) 555-1234"), (5, "9 " * 3000), (6, "café 中 jo@ex.org")]
    got = pii.personal_data(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, kind string"), spark, model=field).collect()
    assert sorted((r.doc_id or 0, r.start, r.end, r.kind) for r in got) == [(0, 0, 9, "email"), (1, 5, 14, "email"), (4, 5, 22, "phone"), (4, 5, 22, "phone"), (6, 7, 16, "email")]
