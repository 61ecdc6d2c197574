"""Near-duplicates, components, vectors and the pipeline against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vframe.llm import ann, embdedup, neardup, vectors
from vframe.llm.common import Scratch
from vframe.llm.components import components
from vframe.llm.shingles import MinHash, sets

SF = "/root/testdata/sf0.001"


def shingles(text, k):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def closure(nodes, links):
    least = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


def test_sets():
    texts = ["", None, "one", "One TWO\x0bthree", "a b c d e", "a b c d e a b c d e", "É é\x85x " * 40, "w " * 100_000]
    for k in (1, 3, 4):
        got = list(sets([None if t is None else t.encode() for t in texts], k))
        assert [len(s) for s in got] == [len(shingles(t, k)) for t in texts]
    a, b = sets([b"x y z w v", b" X y\tz W v "], 4)
    assert (a == b).all()


def test_minhash_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    own = MinHash(32, 5)
    for share in (0.3, 0.8):
        n = int(1000 * 2 * share / (1 + share))
        same = np.mean([(own.sign(np.sort(p[:1000])) == own.sign(np.sort(p[1000 - n : 2000 - n]))).mean() for p in (rng.permutation(pool) for _ in range(40))])
        assert same == pytest.approx(share, abs=0.03)


def test_bayes_limits():
    limits = neardup.least_agreements(0.8, 1e-6, 160)
    for k, m in zip(range(16, 161, 16), limits, strict=True):
        tail = lambda x: sum(math.comb(k + 1, i) * 0.8**i * 0.2 ** (k + 1 - i) for i in range(x + 1))  # noqa: B023, E731
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (40, 2))] + [(i, i + 1) for i in range(100, 130)] + [(5, 5)]
    want = closure({n for e in edges for n in e}, edges)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark))
    found = dict(map(tuple, got.collect()))
    assert {n: found.get(n, n) for n in want} == want
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark)).count() == 0


def test_a_large_group_of_near_copies_takes_bounded_memory():
    """2,000 variants of a long text in one cell, most pairs below the threshold and none joined yet."""
    import tracemalloc

    import pyarrow as pa

    rng, n = np.random.default_rng(5), 1024
    base = rng.integers(0, 1 << 62, 2000)
    own, held, minhash = [], [], MinHash(neardup.BANDS, neardup.ROWS)
    for _ in range(n):
        x = base.copy()
        x[rng.choice(2000, 115, replace=False)] = rng.integers(0, 1 << 62, 115)
        held.append(np.unique(x.astype(np.uint64)))
        own.append(minhash.sign(held[-1]))
    s = np.stack(own)
    s[:, : neardup.ROWS] = s[0, : neardup.ROWS]  # all are in one bucket of band 0
    ints = lambda v, t: pa.array(np.full(n, v), t)
    ids = pa.array(np.arange(n))
    cell = [ints(0, pa.int32()), ints(1, pa.int64()), ints(0, pa.int32()), ints(0, pa.int32()), ints(0, pa.int32()), ids, ids, pa.array([len(x) for x in held], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())]
    batch = pa.RecordBatch.from_arrays(cell, names=["band", "bucket", "i", "j", "block", "doc_id", "label", "n_shingles", "signature"])
    limits = neardup.least_agreements(0.8, 1e-6, neardup.BANDS * neardup.ROWS)
    sets_ = pa.array([x.tobytes() for x in held], pa.binary())
    tracemalloc.start()
    paired = list(neardup._partners(0.8, limits)(iter([batch])))
    first = tracemalloc.get_traced_memory()[1]
    full = pa.RecordBatch.from_arrays([*paired[0].columns, sets_.take(paired[0].column(5))], names=[*paired[0].schema.names, "set"])
    links = [r for b in neardup._links_within(80)(iter([full])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    second = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert first < 60e6 and second < 250e6, (first, second)
    plain = {x: set(h.tolist()) for x, h in enumerate(held)}
    common = lambda a, b: len(plain[a] & plain[b])
    assert all(100 * (c := common(a, b)) >= 80 * (len(plain[a]) + len(plain[b]) - c) for a, b in links)
    sample = [(a, b) for a in range(0, 60) for b in range(a + 1, 60) if 100 * (c := common(a, b)) >= 80 * (len(plain[a]) + len(plain[b]) - c)]
    least = closure(range(n), links)
    assert len(links) < n and sample and all(least[a] == least[b] for a, b in sample)


def test_near_duplicates(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    rows = {0: None, 1: "", 2: " \n", 3: "one two", 4: "ONE  two", 5: "one two three"}
    base = [word() for _ in range(120)]
    for i in range(40):  # a chain: neighbours are alike, the ends are not
        rows[100 + i] = " ".join(base)
        base[int(rng.integers(120))] = word()
    passage = " ".join(word() for _ in range(60))
    for i in range(40):  # a passage in common, not alike
        rows[200 + i] = passage + " " + " ".join(word() for _ in range(40))
    text = " ".join(word() for _ in range(300))
    for i in range(30):
        rows[300 + i] = text if i % 2 else text + " " + word()
    df = spark.createDataFrame([*rows.items(), (None, text), (3, "one two")], "doc_id bigint, text string").withColumn("component_id", F.lit("clash"))
    found = {k: shingles(t, 4) for k, t in rows.items()}
    links = [(a, b) for a, b in itertools.combinations(rows, 2) if found[a] and found[b] and 100 * len(found[a] & found[b]) >= 80 * len(found[a] | found[b])]
    want = closure(rows, links)
    got = neardup.find_duplicates(df, shingle=4).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(found[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    kept = {r["doc_id"] for r in neardup.keep_first(df, shingle=4).collect()}
    assert kept == {None} | {k for k in rows if want[k] == k}
    assert neardup.find_duplicates(df.filter("false")).count() == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 24)).astype(np.float32)
    x[50:120] = x[50] + 0.15 * rng.normal(size=(70, 24)).astype(np.float32)
    x[120:140] = x[120]
    x[141] = 3 * x[140]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, [float("inf")] + [1.0] * 23), (906, [1.0, 2.0]), (None, [1.0] * 24)]
    df = spark.createDataFrame([*rows, *bad], "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    return x, df


def test_search_with_several_hashes(spark, monkeypatch):
    monkeypatch.setattr(ann, "PER_CELL", 1)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    assert ann.hashes(len(x), 16) == 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0, k=5).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 1500, 50):
        score = vectors.cosine(np.repeat(x[q : q + 1], len(x), axis=0), x)
        best = [i for i in np.lexsort((np.arange(len(x)), -score)).tolist() if i != q][:5]
        rows = sorted(found[q])
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and all(r[2] == score[r[1]] for r in rows)
        hit += len({r[1] for r in rows} & set(best))
    assert hit >= 0.9 * 5 * 30
    u = vectors.units(x[:50])
    assert (ann.probes(u, 3, 7, 9, 2)[:, :, 0] == ann.cells(u, 3, 7, 2)).all()


def test_ties_of_a_hot_vector_take_bounded_memory():
    import tracemalloc

    rows = np.ones((8192, 64), dtype=np.float32)
    tracemalloc.start()
    q, found, score = ann.best(rows[:256], np.arange(256), rows, np.arange(8192), 5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6 and len(q) == 5 * 256 and set(found.tolist()) == set(range(6)) and np.allclose(score, 1)


def test_search(points):
    x, df = points
    got = {}
    for r in ann.search(df, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 400, 10):
        score = vectors.cosine(np.repeat(x[q : q + 1], 400, axis=0), x)
        order = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:5]
        hits += len(set(order) & {v for v, _ in got[q]})
        assert all(s == score[v] for v, s in got[q]) and [(-s, v) for v, s in got[q]] == sorted((-s, v) for v, s in got[q])
    assert hits >= 0.9 * 200 and 900 not in got and 906 not in got
    few = ann.search(df.filter("vec_id < 3"), F.col("vec_id") == 0, k=5).collect()
    assert len(few) == 2
    assert ann.search(df.filter("false"), F.col("vec_id") == 0).count() == 0


def test_search_of_isolated(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    tight = np.repeat(centres, 40, axis=0) + 0.01 * rng.normal(size=(1600, 32))
    x = np.concatenate((tight, rng.normal(size=(60, 32)))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in ann.search(df, (F.col("vec_id") % 100 == 0) | (F.col("vec_id") >= 1600), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["rank"]))
    assert set(got) == {*range(0, 1600, 100), *range(1600, 1660)}
    assert all([k for _, k in v] == [1, 2, 3, 4, 5] and q not in dict(v) for q, v in got.items())


def test_best_counts_ids_once():
    x = np.array([[1, 0]] * 6 + [[1, 0.1], [1, 0.2], [0, 1]], dtype=np.float32)
    ids = np.array([7] * 6 + [1, 2, 9])
    q, found, _ = ann.best(x[:1], np.array([9]), x, ids, 3)
    assert q.tolist() == [0, 0, 0] and found.tolist() == [7, 1, 2]


def test_hadamard():
    h = ann.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16)) and np.allclose(np.abs(h), 0.25)


def test_embedding_duplicates(points):
    x, df = points
    near = embdedup.linked(x, x, 0.95) & ~np.eye(400, dtype=bool)
    want = closure(range(400), [(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b])
    rows = {r["vec_id"]: r for r in embdedup.find_duplicates(df).collect()}
    assert len(rows) == 408
    for i in range(400):
        assert (rows[i]["n_links"], rows[i]["component_id"], rows[i]["kept"]) == (near[i].sum(), want[i], want[i] == i)
    assert all(rows[i]["n_links"] == 0 and rows[i]["kept"] for i in (900, 901, 902, 903, 904, 905, 906, None))
    assert embdedup.find_duplicates(df.filter("false")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hard = [(10_001, None), (10_002, ""), (10_003, "12 34"), (10_004, "Call +1 (743) 555-3824 the and of the thing now and then for all")]
    now = docs.unionByName(spark.createDataFrame([(i, t, None, None, 0) for i, t in hard], docs.schema))
    scratch, seen = Scratch(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.table(stage(spark, now, SF), name)
        seen[name] = now
    ids = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()} | dict(hard)
    assert ids["language_id"] == set(before) - {10_001, 10_002, 10_003}
    found = {k: shingles(before[k], 5) for k in ids["language_id"]}
    links = [(a, b) for a, b in itertools.combinations(found, 2) if 100 * len(found[a] & found[b]) >= 80 * len(found[a] | found[b])]
    want = closure(found, links)
    assert ids["near_duplicates"] == {k for k in found if want[k] == k}
    private = {r["doc_id"]: r["text"] for r in seen["personal_data"].collect()}
    assert set(private) == ids["near_duplicates"] and "555-3824" not in private[10_004]
    mixed = seen["mixture"].groupBy("doc_id").count().collect()
    assert max(r["count"] for r in mixed) <= 2 and ids["mixture"] <= set(private)
    assert all(d.columns == [*docs.columns, *(["shard"] if n == "mixture" else [])] for n, d in seen.items() if n != "packing")
    pieces = seen["packing"]
    assert pieces.groupBy("sequence_id").agg(F.count_distinct("shard").alias("n")).agg(F.max("n")).first()[0] == 1
    tokens = lambda df, n: {(r["doc_id"], r["shard"]): r["n"] for r in df.groupBy("doc_id", "shard").agg(n.alias("n")).collect()}
    assert tokens(pieces, F.sum(F.when(F.col("start") == 0, 1).otherwise(0))) == tokens(seen["mixture"], F.count("*"))
    total = seen["packing"].agg(F.sum("length")).first()[0]
    per = {r["doc_id"]: r["doc_tokens"] for r in seen["packing"].select("doc_id", "doc_tokens").distinct().collect()}
    assert total == sum(per[r["doc_id"]] * r["count"] for r in mixed)


@pytest.mark.parametrize("name", ["op2_chat_format", "op6_minhash_dedup", "op9_embedding_dedup"])
def test_query_against_sql(spark, name):
    import duckdb

    from vframe.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(oracle_sql()[name])
    got = queries()[name](spark, SF)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_queries_of_the_rest(spark):
    """Columns, rows and invariants of the queries without SQL, over their whole tables."""
    import zlib

    from vframe.llm.queries import queries

    own, docs = queries(), spark.read.parquet(f"{SF}/documents.parquet")
    n, ids = docs.count(), {r["doc_id"] for r in docs.select("doc_id").collect()}
    one = own["op1_language_id"](spark, SF).collect()
    assert {r["doc_id"] for r in one} == ids and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in one)
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in one if r["held_out"]]) >= 0.9
    five = own["op5_mix_sources"](spark, SF).collect()
    assert {r["doc_id"] for r in five} == ids and all(r["taken"] in (0, r["size"], 2 * r["size"]) and len(r["shards"]) * r["size"] == r["taken"] for r in five)
    four = sorted(own["op4_token_store"](spark, SF).collect())
    assert [r["doc_id"] for r in four] == sorted(ids) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(four, four[1:], strict=False))
    eight = own["op8_pack"](spark, SF).collect()
    assert sum(r["length"] for r in eight) == sum(r["n_tokens"] for r in four) and "within" not in own["op8_pack"](spark, SF).columns
    assert own["op7_secret_scan"](spark, SF).count() == own["op10_pii_pseudonyms"](spark, SF).count() == n
    assert {r["query_id"] for r in own["op3_cross_polytope"](spark, SF).collect()} == {r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").filter("vec_id % 50 = 0").select("vec_id").collect()}
