"""Vectors, conversations and the pipeline."""

import re
from functools import lru_cache

import numpy as np
import pytest
from compare import connect, difference
from conftest import SMALL
from pyspark.sql import functions as F

from seqloom.llm import catalog, chat, common, vectors


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3), (7, 6), (7, 6)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(61)}, **{k: 1000 for k in range(1000, 1200)}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((300, 16))
    v[100:160] = v[100] + 0.02 * rng.standard_normal((60, 16))
    v[160:200] = v[160]
    v[200:204] *= 1e-200
    rows = [(i, [float(x) for x in v[i]], i % 2 if i < 100 or i >= 204 else 1, 5, 1.0) for i in range(300)]
    rows += [(300, None, 1, 5, 1.0), (301, [0.0] * 16, 1, 5, 1.0), (302, [float("nan")] * 16, 1, 5, 1.0), (303, [float("inf")] + [1.0] * 15, 1, 5, 1.0), (304, [], 1, 5, 1.0)]
    rows += [(305, rows[0][1], None, 5, 1.0), (None, rows[100][1], 1, 5, 1.0), (110, rows[110][1], 1, 5, 1.0), (306, [1.0, 2.0], 1, 5, 1.0), (400, [2.0, 4.0], 1, 5, 1.0), (500, [None, 1.0], 1, 5, 1.0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node long, place double").repartition(3).cache()


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


def test_near_vectors(spark, points):
    rows, df = points
    n = len(rows)
    unit = []
    for r in rows:
        ok = usable(r[1]) and any(r[1]) and r[2] is not None
        x = np.array(r[1], dtype=np.float64) / max(map(abs, r[1])) if ok else None
        unit.append(x / np.linalg.norm(x) if ok else None)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98] for i in range(n)]
    want = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            todo = [j for k in todo for j in links[k] if j not in seen and not seen.add(j)]
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        want.append((rows[i][0], len(links[i]), least, rows[i][0] is not None and rows[i][0] == least))
    got = map(tuple, vectors.near_duplicate_vectors(df).collect())
    assert sorted(got, key=str) == sorted(want, key=str)
    assert vectors.near_duplicate_vectors(df.limit(0)).count() == 0
    assert vectors.calibrated() < 1e-5


@pytest.mark.parametrize("shard", [20, 100_000])
def test_top_k(spark, points, monkeypatch, shard):
    rows, df = points
    monkeypatch.setattr(vectors, "SHARD", shard)
    monkeypatch.setattr(vectors, "QUERIES_BLOCK", 2)
    # Sums beyond 2^53 and beyond a long; ids of queries among them.
    large = [(i, [float(x) for x in 2.0 ** np.array([30 + i % 3, 70, 1]) * [1, (-1) ** i, 1]], 1, 5, 1.0) for i in range(600, 640)]
    large += [(i, [3.0, 2.0**45 + i, 0.25 * i], 1, 5, 1.0) for i in range(700, 740)]
    rows = rows + large
    df = df.union(df.sparkSession.createDataFrame(large, df.schema))
    good = {}
    for r in rows:
        if r[0] is not None and usable(r[1]):
            p = [int(np.floor(1024 * x)) for x in r[1]]
            good[r[0]] = min(good.get(r[0], p), p)
    want = []
    for q in sorted(k for k in good if k % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q and len(good[c]) == len(good[q]))[:10]
        want += [(q, i + 1, c, max(-(2**63), min(2**63 - 1, -s))) for i, (s, c) in enumerate(best)]
    got = sorted(map(tuple, vectors.top_k(df).collect()))
    beyond = {r[0] for r in want if abs(r[3]) >= 2**63 - 1}
    assert beyond and [r for r in got if r[0] not in beyond] == sorted(r for r in want if r[0] not in beyond)
    assert [(r[0], r[1], r[3]) for r in got if r[0] in beyond] == sorted((r[0], r[1], r[3]) for r in want if r[0] in beyond)
    assert vectors.top_k(df.limit(0)).count() == 0


def test_kd_tree_reads_few_leaves_on_clustered_points():
    rng = np.random.default_rng(0)
    points = np.floor(rng.uniform(-50, 50, (40, 3)).repeat(100, axis=0) + rng.uniform(0, 3, (4000, 3)))
    tree = vectors.KDTree(np.arange(4000), points, leaf=16)
    for low, high, children, rows in tree.nodes:
        if rows is not None:
            assert (points[rows].min(axis=0) == low).all() and (points[rows].max(axis=0) == high).all()
    q = np.array([[3.0, -2.0, 5.0]])
    got = sorted(tree.search(q[0], -1, 5, tree.bounds(q)[0], -np.inf), key=lambda x: (-x[0], x[1]))
    scores = points @ q[0]
    want = sorted(range(4000), key=lambda i: (-scores[i], i))[:5]
    assert [(s, i) for s, i in got] == [(scores[i], i) for i in want]


def least_cost(labels):
    @lru_cache(None)
    def go(i, state):
        if i == len(labels):
            return 0 if state in chat.LAST else chat.INSERT if state else chat._FAR
        label, best = labels[i], chat._FAR
        change = lambda role: 0 if role - 1 == label else chat.NAME if label == 3 else chat.RELABEL

        def insert(at, cost, depth):
            nonlocal best
            for t in chat.MOVES[at]:
                best = min(best, cost + change(t) + go(i + 1, t))
                if depth:
                    insert(t, cost + chat.INSERT, depth - 1)

        insert(state, 0, 3)
        if state:
            best = min(best, chat.MERGE + change(state) + go(i + 1, state))
        return best

    return go(0, 0)


def test_chat(spark):
    rng = np.random.default_rng(2)
    roles = ["system", "user", "assistant", None, "tool", " User "]
    rows, want = [], {}
    for c in range(120):
        n = 150 if c == 0 else int(rng.integers(1, 9))
        picked = [roles[int(k)] for k in rng.integers(0, 6, n)]
        key = None if c == 7 else c
        rows += [(key, t, r, [None, "", "hi", "a b"][int(rng.integers(0, 4))], 3, "x") for t, r in enumerate(picked)]
        want[key] = least_cost(tuple(chat.label_of(r) for r in picked))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int, cost string").repartition(7)
    out = chat.repair(df).cache()
    assert out.count() == len(rows)
    for r in chat.transcripts(out).collect():
        said = re.findall(r"<\|(system|user|assistant)\|>", r["transcript"])
        moves = [0, *[chat.ROLES.index(x) + 1 for x in said]]
        assert all(b in chat.MOVES[a] for a, b in zip(moves, moves[1:])) and moves[-1] in chat.LAST
        assert r["transcript"].count("<|end|>") == len(said) and r["cost"] == want[r["conv_id"]]
    assert chat.repair(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, "user", "b"), (1, None, "user", "b"), (1, 0, None, None)], "conv_id long, turn long, role string, text string")
    assert chat.transcripts(chat.repair(odd)).first()["transcript"] == "<|user|>\nb\nb<|end|>\n<|assistant|>\n<|end|>\n"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, SMALL), connect(SMALL), catalog.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_run(spark, name):
    rows = {"op5_chat": spark.read.parquet(f"{SMALL}/conversations.parquet").count(), "op8_packing": None}
    got = catalog.QUERIES[name](spark, SMALL).count()
    want = rows.get(name, spark.read.parquet(f"{SMALL}/documents.parquet").count())
    assert got == want if want else got > 0


def test_pipeline(spark, tmp_path):
    """Each stage against its operator's rule, on the given documents with odd rows added."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(None, "alone and without an id", "en", "x", None), (10**6, None, None, None, None), (10**6, None, None, None, None), (10**6 + 1, "", "en", "x", 0)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.where("doc_id < 3")).withColumn("grouped", F.lit(1))
    good = P.keep_good(spark, docs, SMALL).cache()
    labels = dict(spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect())
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    known = [i for i in labels if labels[i] in (0, 1)]
    assert np.mean([(i in kept) == (labels[i] == 1) for i in known]) > 0.9
    alone = P.drop_near_copies(spark, good, SMALL).cache()
    ids = [r["doc_id"] for r in alone.select("doc_id").collect()]
    assert len([i for i in ids if i == 1]) <= 1 and set(ids) <= kept
    from seqloom.llm import minhash

    again = minhash.near_duplicates(alone)
    assert again.where("kept or doc_id is null or group is null").count() == again.count()
    assert {r[0] for r in minhash.near_duplicates(good).where("kept").select("doc_id").collect()} == {i for i in ids if i is not None}
    clean = P.redact_secrets(spark, alone, SMALL).cache()
    assert clean.count() == alone.count() and clean.columns == P.COLUMNS
    from seqloom.llm import secrets

    assert secrets.digest(clean).where("n_assign + n_access + n_hex > 0").count() == 0
    packed = P.pack(spark, clean, SMALL)
    assert packed.select("doc_id").distinct().count() == clean.select("doc_id").distinct().count()
    assert P.run(spark, SMALL).count() > 0
    assert P.drop_near_copies(spark, good.limit(0), SMALL).count() == 0
