"""Brute-force and invariant checks for what SQL cannot say on whole tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom import constants as K
from seqloom.functions import chemistry as C, sequences as Q
from seqloom.operators import aggregates as G, clusters as U, joins as J, metrics as M, ordered as O, prefixes as X, similarity as S, splits as P, windows as W


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            keep = row[j]
            row[j] = prev + 1 if x == y else max(row[j], row[j - 1])
            prev = keep
    return row[-1]


def peptides(n, seed=3, families=6):
    """Families of mutated copies of some ancestors, plus random ones and exact copies."""
    r = random.Random(seed)
    letters = K.RESIDUES
    base = ["".join(r.choice(letters) for _ in range(r.randint(12, 30))) for _ in range(families)]
    out = []
    for _ in range(n):
        s = list(r.choice(base))
        for _ in range(r.randint(0, 5)):
            s[r.randrange(len(s))] = r.choice(letters)
        if r.random() < 0.3:
            del s[r.randrange(len(s))]
        out.append("".join(s))
    return out + out[:5] + ["ACD", "WY"]


def sequential_greedy(seqs, t):
    order = sorted(set(seqs), key=lambda s: (-len(s), hashlib.sha1(s.encode()).hexdigest()))
    reps, of = [], {}
    for s in order:
        for r in reps:
            if lcs(s, r) >= t * min(len(s), len(r)) - 1e-9:
                of[s] = r
                break
        else:
            reps.append(s)
            of[s] = s
    return of


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_clustering_equals_sequential_greedy(spark, t):
    seqs = peptides(150) + ["ACDEFGHIKL", "AWCWDWEWFWGWHWIWKWLW", "acdxyz", "x" * 70 + "ACDEFGHIKL" * 9]
    df = spark.createDataFrame([(s,) for s in seqs], "sequence string").repartition(4)
    got = {r["sequence"]: r["rep"] for r in S.cluster_by_identity(df, t).collect()}
    assert got == sequential_greedy(seqs, t)


@pytest.mark.parametrize("t", [0.6, 0.9])
def test_clustering_windows_and_cut_lists(spark, monkeypatch, t):
    """Windows of few sequences whose lists of similar ones are cut short decide the same clusters."""
    for name, value in {"FIRST_BATCH": 8, "LEAST_BATCH": 4, "MOST_BATCH": 64, "BATCH_PAIRS": 64, "FEW_PAIRS": 40, "LEAST_PAIRS": 2}.items():
        monkeypatch.setattr(S, name, value)
    seqs = peptides(60, seed=3) + ["".join(random.Random(i).choice("AG") for _ in range(6)) for i in range(30)] + ["".join(random.Random(i).choice("CDE") for _ in range(30)) for i in range(12)]
    df = spark.createDataFrame([(s,) for s in seqs], "sequence string").repartition(3)
    got = {r["sequence"]: r["rep"] for r in S.cluster_by_identity(df, t).collect()}
    assert got == sequential_greedy(seqs, t)


@pytest.mark.parametrize("t", [0.6, 0.8, 1.0])
def test_trie_equals_brute_force(t):
    rnd = random.Random(4)
    some = lambda n, top: ["".join(rnd.choice("ACDE") for _ in range(rnd.randint(1, top))) for _ in range(n)]
    items, texts = sorted(set(some(80, 10))), some(40, 14)
    reaches = lambda x, y: len(x) <= len(y) and lcs(x, y) >= t * len(x) - 1e-9
    trie = X.trie_of(items, t)
    got = {(i, j) for found in trie.walk(texts) if found is not None for i, j in zip(*(a.tolist() for a in found))}
    assert got == {(i, j) for i, y in enumerate(texts) for j, x in enumerate(items) if reaches(x, y)}
    first = X.first_texts(trie, texts, np.arange(40), np.full(len(items), 30))
    assert first.tolist() == [next((i for i, y in enumerate(texts[:30]) if reaches(x, y)), -1) for x in items]
    assert X.meets_any(texts, items, t).tolist() == [any(reaches(x, y) for x in items) for y in texts]


def test_trie_work_grows_less_than_pairs(monkeypatch):
    """Ten times as many sequences leave a text far less than ten times the branches."""
    def branches(n):
        words = [w + "".join("ACDEFGHIKL"[int(d)] for d in str(i * 7919 % 1_000_000).zfill(6)) for i, w in zip(range(n), ["LARGERNG", "SMALLGEAR"] * n)]
        seen, down = [0], X.Trie._down

        def counted(self, *rest):
            out = down(self, *rest)
            seen[0] += 0 if out is None else len(out[1])
            return out

        with monkeypatch.context() as m:
            m.setattr(X.Trie, "_down", counted)
            list(X.trie_of(words, 0.9).walk(words[:200]))
        return seen[0]

    assert branches(20_000) < 5 * branches(2_000)


@pytest.mark.parametrize("t", [0.6, 0.8])
def test_filter_against_long_and_short(spark, t):
    """Short rows inside long ones, long ones around short ones, and long ones of both sides."""
    rnd = random.Random(6)
    some = lambda n, low, top: ["".join(rnd.choice("ACDEG") for _ in range(rnd.randint(low, top))) for _ in range(n)]
    train, test = some(40, 1, 9) + some(30, 20, 45), some(4, 4, 9) + some(4, 20, 45)
    train += [s[:10] + "G" + s[11:] for s in test]
    want = sorted(a for a in train if not any(a == b or lcs(a, b) >= t * min(len(a), len(b)) - 1e-9 for b in test))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "sequence string")
    assert sorted(r[0] for r in S.filter_against(frame(train), frame(test), t).collect()) == want


def test_clustering_with_one_hot_word(spark):
    """All sequences share their words: few representatives, no pairs among members."""
    seqs = ["MKTAYIAKQR" + "".join(random.Random(i).choice("AG") for _ in range(4)) for i in range(400)]
    df = spark.createDataFrame([(s,) for s in seqs], "sequence string")
    got = {r["sequence"]: r["rep"] for r in S.cluster_by_identity(df, 0.8).collect()}
    assert got == sequential_greedy(seqs, 0.8)


def test_scoped_clustering_equals_separate_runs(spark):
    seqs = peptides(60, seed=9)
    df = spark.createDataFrame([("a" if i % 2 else "b", s) for i, s in enumerate(seqs)], "split string, sequence string")
    got = {(r["split"], r["sequence"]): r["rep"] for r in S.cluster_by_identity(df, 0.8, by="split").collect()}
    want = {}
    for g in "ab":
        part = [s for i, s in enumerate(seqs) if ("a" if i % 2 else "b") == g]
        want |= {(g, s): r for s, r in sequential_greedy(part, 0.8).items()}
    assert got == want


def test_filter_against_brute_force(spark):
    train, test = peptides(80, seed=1), peptides(15, seed=2) + peptides(10, seed=1)
    t = 0.6
    similar = lambda a, b: a == b or lcs(a, b) >= t * min(len(a), len(b)) - 1e-9
    want = sorted(a for a in train if not any(similar(a, b) for b in test))
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "sequence string")
    assert sorted(r[0] for r in S.filter_against(frame(train), frame(test), t).collect()) == want


def test_novelty_brute_force(spark):
    q, train = peptides(40, seed=5) + ["", "MKV"], peptides(60, seed=6) + peptides(5, seed=5)
    df = spark.createDataFrame(list(enumerate(q)), "id int, sequence string")
    tr = spark.createDataFrame([(s,) for s in train], "sequence string")
    got = {r["id"]: r["novelty"] for r in S.novelty(df, tr, "id").collect()}
    for i, s in enumerate(q):
        best = max((lcs(s, t) / max(len(s), len(t)) for t in train), default=0) if s else 0
        assert got[i] == pytest.approx(1 - best), s
    none = S.novelty(df, tr.limit(0), "id").collect()
    assert all(r["novelty"] is None for r in none)


def test_lcs_forms_agree(spark):
    a, b = peptides(40, seed=7), peptides(40, seed=8)
    df = spark.createDataFrame(list(zip(a, b)), "a string, b string")
    for r in df.select("a", "b", S.lcs_length("a", "b").alias("x"), S.lcs_native(F.col("a"), F.col("b")).alias("y")).collect():
        assert r["x"] == r["y"] == lcs(r["a"], r["b"])


def test_identity_matrix_and_distances(spark):
    r = random.Random(4)
    rows = [(i, "".join(r.choice(K.RESIDUES + "-") for _ in range(20))) for i in range(25)]
    df = spark.createDataFrame(rows, "k int, aligned string")
    got = {(x["k"], x["k_b"]): x["identity"] for x in S.identity_matrix(df, "k").collect()}
    assert len(got) == 25 * 26 // 2
    for (i, j), v in got.items():
        cols = [(x, y) for x, y in zip(rows[i][1], rows[j][1]) if not x == y == "-"]
        assert v == pytest.approx(100 * sum(x == y for x, y in cols) / len(cols))
    m = S.matrix_from_scale(K.KYTE_DOOLITTLE)
    d = S.distance_between(df, df.withColumnRenamed("k", "k2"), m, "k", "k2", rows_per_block=7)
    got = {(x["k"], x["k2"]): x["distance"] for x in d.collect()}
    assert len(got) == 625
    for (i, j), v in got.items():
        assert v == pytest.approx(sum(m[(x, y)] for x, y in zip(rows[i][1], rows[j][1])))


@pytest.mark.parametrize("k", [1, 3, 40])
def test_nearest_by_distance_brute_force(spark, k):
    r = random.Random(5)
    text = lambda: "".join(r.choice("AC-") for _ in range(5))  # noqa: E731  (many ties)
    a, b = [(f"a{i}", text()) for i in range(30)], [(i, text()) for i in range(23)]
    left, right = spark.createDataFrame(a, "x string, aligned string"), spark.createDataFrame(b, "y int, aligned string")
    m = S.matrix_from_scale(K.KYTE_DOOLITTLE)
    want = set()
    for x, s in a:
        near = sorted((round(sum(m[p] for p in zip(s, t)), 9), y) for y, t in b)[:k]
        want |= {(x, y, d, n + 1) for n, (d, y) in enumerate(near)}
    for rows in (5, 2000):
        got = {(z["x"], z["y"], z["distance"], z["rank"]) for z in S.nearest_by_distance(left, right, m, "x", "y", k, rows_per_block=rows).collect()}
        assert got == want
    assert S.nearest_by_distance(left, right.limit(0), m, "x", "y", k).count() == 0


def test_median_from_a_bracket_is_exact(spark):
    from seqloom.operators import aggregates as G, ordered as O

    r = random.Random(8)
    n = 20001
    odd = [None, float("nan"), 0.0]
    rows = [(r.gauss(0, 1), float(r.randint(0, 3)), 5.0 if i % 3 else -1e9 * i, odd[i % 3] if i < 5 else None, None) for i in range(n)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(13)
    got = {x["metric"]: (x["n"], x["median"]) for x in G.summarize_metrics(df, list("abcde")).collect()}
    for i, c in enumerate("abc"):
        assert got[c] == (n, sorted(x[i] for x in rows)[n // 2])
    assert got["d"] == (1, 0.0) and got["e"] == (0, None)
    half = df.limit(2 * (n // 2))
    assert G.summarize_metrics(half, ["b"]).first()["median"] in (1.0, 1.5, 2.0)
    # Of 20,001 values of `a` only those near the median are rows.
    assert O.bracketed(df.select("a"), ["a"], 0.5).count() < 0.01 * n
    ends = [(O.bracketed(df.select("a"), ["a"], p), p) for p in (0.0, 0.001, 0.9, 1.0)]
    want = sorted(x[0] for x in rows)
    for near, p in ends:
        assert O.quantiles(near, "value", {"q": p}, ["column"], interpolate=False, count="n").first()["q"] == want[int((n - 1) * p)]
    inf = float("inf")
    ends = spark.createDataFrame([(inf, -inf), (inf, -inf), (1.0, 2.0)], "a double, b double")
    got = {x["metric"]: x["median"] for x in G.summarize_metrics(ends, ["a", "b"]).collect()}
    assert not math.isfinite(got["a"]) and not math.isfinite(got["b"])
    empty = G.summarize_metrics(df.limit(0), ["a"]).first()
    assert empty["n"] == 0 and empty["median"] is None


def test_intersect_all_of_many_lists(spark):
    from seqloom.operators import sets as T

    lists = [spark.range(i % 3, 9).withColumnRenamed("id", "k") for i in range(70)]
    assert sorted(r["k"] for r in T.intersect_all(lists, "k").collect()) == list(range(2, 9))


def test_similar_pairs_brute_force(spark):
    r = random.Random(11)
    base = "".join(r.choice(K.RESIDUES) for _ in range(40))
    texts = []
    for _ in range(60):
        s = list(base)
        for _ in range(r.randint(0, 7)):
            s[r.randrange(40)] = r.choice(K.RESIDUES)
        texts.append("".join(s))
    df = spark.createDataFrame([(t,) for t in texts + texts[:3]], "aligned string")
    got = {(x["a"], x["b"]): (x["mutations"], x["n_a"], x["n_b"]) for x in S.similar_pairs(df, 4).collect()}
    u = sorted(set(texts))
    n = {t: (texts + texts[:3]).count(t) for t in u}
    ham = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert got == {(a, b): (ham(a, b), n[a], n[b]) for a in u for b in u if a < b and ham(a, b) <= 4}


def reference_dbscan(x, eps, m):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    near = d <= eps
    core = near.sum(1) >= m
    label = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = c
            while stack:
                p = stack.pop()
                if core[p]:
                    for q in np.where(near[p] & (label < 0))[0]:
                        label[q] = c
                        stack.append(q)
            c += 1
    return label


def test_density_clusters_brute_force(spark):
    g = np.random.default_rng(1)
    x = np.vstack([g.normal(c, 0.4, (30, 3)) for c in (0, 3, 6)] + [g.uniform(-2, 8, (15, 3))])
    x = np.vstack([x, x[:4]])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k bigint, v array<double>")
    got = {r["k"]: r["cluster"] for r in U.density_clusters(df, "k", "v", 0.7, 5).collect()}
    want = reference_dbscan(x, 0.7, 5)
    assert [got[i] for i in range(len(x))] == want.tolist()


def test_density_radius(spark):
    g = np.random.default_rng(1)
    x = np.vstack([g.normal(c, 0.2, (12, 2)) for c in (0, 3)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k bigint, v array<double>")
    assert U.best_eps(df, "k", "v", [0.01, 0.8, 20.0]) == 0.8
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    got = U.distance_percentile(df.withColumnRenamed("k", "id"), "v", 5).first()["eps"]
    assert got == pytest.approx(np.percentile(d, 5))


def test_connected_components(spark):
    edges = [(0, 1), (1, 2), (5, 4), (7, 8), (8, 9), (9, 2)]
    nodes = spark.range(12)
    got = {r["id"]: r["label"] for r in U.connected_components(nodes, spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4, 6: 6, 7: 0, 8: 0, 9: 0, 10: 10, 11: 11}


def test_threshold_from_closed_form_equals_pairs(spark):
    x = [3.0, 8.5, 1.0, 7.25, 9.0, 2.5, 30.0]
    df = spark.createDataFrame(list(enumerate(x)), "k int, v double").withColumn("w", F.lit(1.0))
    one = U.threshold_clusters(df, "k", ["v"], sigma=-0.5).collect()
    two = U.threshold_clusters(df, "k", ["v", "w"], sigma=-0.5).collect()  # a constant column adds nothing
    part = lambda rows: sorted(sorted(r["k"] for r in rows if r["cluster_id"] == c) for c in {r["cluster_id"] for r in rows})
    assert part(one) == part(two)
    d = [abs(a - b) / sum(x) for i, a in enumerate(x) for b in x[i + 1:]]
    t = np.mean(d) - 0.5 * np.std(d, ddof=1)
    assert len(part(one)) == 1 + sum(b - a > t * sum(x) for a, b in zip(sorted(x), sorted(x)[1:]))


def test_strict_clusters_are_complete_link(spark):
    g = np.random.default_rng(2)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(g.uniform(1, 10, (40, 2)))]
    df = spark.createDataFrame(rows, "k int, a double, b double")
    got = {r["k"]: r["cluster_id"] for r in U.threshold_clusters(df, "k", ["a", "b"], threshold=0.01, strict=True).collect()}
    assert len(got) == 40
    v = np.array([r[1:] for r in rows]) / np.array([r[1:] for r in rows]).sum(0)
    for i in got:
        for j in got:
            if got[i] == got[j]:
                assert np.linalg.norm(v[i] - v[j]) <= 0.01 + 1e-12


def test_kmeans_members(spark):
    g = np.random.default_rng(3)
    x = np.vstack([g.normal(c, 0.1, (20, 2)) for c in (0, 5)])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k int, v array<double>")
    assigned, members = U.kmeans(df, "k", "v", 2)
    groups = {}
    for r in assigned.collect():
        groups.setdefault(r["cluster"], set()).add(r["k"])
    assert sorted(map(sorted, groups.values())) == [list(range(20)), list(range(20, 40))]
    assert all(r["member"] in groups[r["cluster"]] and r["n"] == 20 for r in members.collect())


@pytest.mark.parametrize("cosine", [False, True])
def test_kmeans_rounds_equal_brute_force(spark, cosine):
    g = np.random.default_rng(5)
    x = np.vstack([g.normal(c, 0.6, (40, 3)) for c in ((0, 0, 4), (5, 0, 0), (0, 6, 1))] + [np.zeros((2, 3))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    starts = [U.seeds(df.repartition(n), "k", "v", 4, cosine) for n in (1, 5)]
    assert starts[0] == starts[1] and len({tuple(c) for c in starts[0]}) == 4
    unit = x / np.where(np.linalg.norm(x, axis=1, keepdims=True) > 0, np.linalg.norm(x, axis=1, keepdims=True), 1) if cosine else x
    far = [[-900.0] * 3]  # nothing is near it: it keeps its mean
    centres = starts[0] + far
    for _ in range(3):
        near = np.array([np.argmin([((r - np.array(c)) ** 2).sum() for c in centres]) for r in unit])
        want = [unit[near == i].mean(axis=0) if (near == i).any() else np.array(c) for i, c in enumerate(centres)]
        if cosine:
            want = [c / (np.linalg.norm(c) or 1) for c in want]
        got = U.centre_means(df.repartition(3), "v", centres, cosine)
        assert np.allclose(got, want, atol=1e-12)
        assert [r["cluster"] for r in U.assign(df, "k", "v", centres, cosine).orderBy("k").collect()] == [*near.tolist(), None]
        centres = got
    assert np.allclose(centres[4], np.array(far[0]) / (np.linalg.norm(far[0]) if cosine else 1))
    assigned, members = U.kmeans(df, "k", "v", 4, cosine)
    found = {r["k"]: r["cluster"] for r in assigned.collect()}
    assert len(found) == 123 and found[500] is None and sum(r["n"] for r in members.collect()) == 122


def test_kmeans_of_few_or_no_vectors(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], "k int, v array<double>")
    assigned, members = U.kmeans(same, "k", "v", 3)
    assert [tuple(r) for r in members.collect()] == [(0, 0, 6)] and assigned.count() == 6
    assigned, members = U.kmeans(same.limit(0), "k", "v", 3)
    assert assigned.count() == members.count() == 0


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_masks_hold_and_do_not_depend_on_partitions(spark, parts):
    seqs = peptides(50, seed=12)
    df = spark.createDataFrame(list(enumerate(seqs)), "k int, sequence string").repartition(parts)
    df = df.withColumn("fixed", F.transform(Q.letters(F.col("sequence")), lambda c: c.isin("A", "C", "K")))
    rows = P.order_agnostic_mask(df, "k", fixed="fixed", seed=3).orderBy("k").collect()
    seen = []
    for r in rows:
        assert len(r["src"]) == len(r["tgt"]) == len(r["mask"]) == len(r["sequence"])
        assert all(s == (K.TOKEN_MASK if m else t) for s, t, m in zip(r["src"], r["tgt"], r["mask"]))
        assert not any(m and f for m, f in zip(r["mask"], r["fixed"]))
        assert r["n_masked"] == sum(r["mask"]) <= sum(not f for f in r["fixed"])
        seen.append(tuple(r["src"]))
    assert hash(tuple(seen)) == test_masks_hold_and_do_not_depend_on_partitions.__dict__.setdefault("seen", hash(tuple(seen)))
    b = P.bert_mask(df, "k", p=0.5, seed=3).collect()
    for r in b:
        n = math.floor(len(r["tgt"]) * 0.5)
        counts = [r["action"].count(i) for i in range(4)]
        assert counts[1] == math.floor(n * 0.8) and counts[2] == math.floor(n * 0.1) and sum(counts[1:]) == n
        assert all(s == t for s, t, a in zip(r["src"], r["tgt"], r["action"]) if a in (0, 3))


@pytest.mark.parametrize("poisson", [False, True])
def test_bootstrap_error_is_near_the_analytic_one(spark, poisson):
    g = np.random.default_rng(5)
    x = g.normal(10, 2, 500)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "k int, v double")
    r = P.bootstrap(df, "v", ["k"], 200, poisson=poisson).first()
    assert r["mean"] == pytest.approx(x.mean(), abs=0.05)
    assert r["mean_se"] == pytest.approx(x.std() / math.sqrt(500), rel=0.25)
    assert r["mean_low"] < x.mean() < r["mean_high"]
    assert r["median"] == pytest.approx(np.median(x), abs=0.1)


def test_bootstrap_counts(spark):
    df = spark.createDataFrame([(i, "a" if i < 300 else "b") for i in range(1000)], "k int, v string")
    got = {r["value"]: r for r in P.bootstrap_counts(df, "v", ["k"], 100).collect()}
    assert got["a"]["mean"] == pytest.approx(300, abs=8)
    assert got["a"]["std"] == pytest.approx(math.sqrt(1000 * 0.3 * 0.7), rel=0.3)
    assert got["a"]["mean"] + got["b"]["mean"] == pytest.approx(1000)


@pytest.mark.parametrize("case_limit", [32, 0])
def test_ordered_scans_with_one_hot_group(spark, case_limit, monkeypatch):
    """A third of all rows in one group: positions, sums and neighbours stay right across buckets."""
    monkeypatch.setattr(O, "CASE_LIMIT", case_limit)
    r = random.Random(1)
    rows = [(0 if i % 3 == 0 else i % 40, i, r.randint(0, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, t int, v int").repartition(7)
    got = O.running(df, ["t"], ["g"], {"s": "v"}, max_before={"m": "v"}).collect()
    near = {(x["g"], x["t"]): (x["p"], x["n"]) for x in O.neighbours(df, ["t"], {"p": ("v", "prev"), "n": ("v", "next")}, ["g"]).collect()}
    held = {(x["g"], x["t"]): x["b"] for x in O.carry(df.withColumn("w", F.when(F.col("v") > 7, F.col("v"))), ["t"], {"b": ("w", "back")}, ["g"]).collect()}
    by = {(x["g"], x["t"]): (x["idx"], x["s"], x["m"]) for x in got}
    for g in {x[0] for x in rows}:
        vals = [(t, v) for gg, t, v in rows if gg == g]
        total, top, last = 0, None, None
        for i, (t, v) in enumerate(vals):
            total += v
            assert by[(g, t)] == (i, total, top)
            top = v if top is None else max(top, v)
            assert near[(g, t)] == (vals[i - 1][1] if i else None, vals[i + 1][1] if i + 1 < len(vals) else None)
            last = v if v > 7 else last
            assert held[(g, t)] == last


def test_nearest_join_once(spark):
    a = spark.createDataFrame([(1, 10.0), (2, 11.0), (3, 30.0)], "ia bigint, k double")
    b = spark.createDataFrame([(7, 10.4), (8, 31.0)], "ib bigint, k double")
    got = {r["ia"]: (r["ib"], r["off"]) for r in J.nearest_join(a, b, "k", "ia", "ib").collect()}
    assert got == {1: (7, False), 2: (7, True), 3: (8, False)}
    once = {r["ia"]: r["ib"] for r in J.nearest_join(a, b, "k", "ia", "ib", once=True).collect()}
    assert once == {1: 7, 3: 8}


def test_smooth_fills_single_gaps(spark):
    x = [1.0, 2.0, None, 4.0, 5.0]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "g int, t int, v double")
    got = [r["smoothed"] for r in W.smooth(df, ["g"], ["t"], "v", 1, fill_single=True).orderBy("t").collect()]
    clean = [1.5, (1 + 2 + 4) / 3, (2 + 4 + 5) / 3, 4.5]
    want = clean[:2] + [(clean[1] + clean[2]) / 2] + clean[2:]
    assert got == pytest.approx(want)


def test_isoelectric_point_is_where_the_charge_vanishes(spark):
    df = spark.createDataFrame([(s,) for s in peptides(30, seed=14)], "s string")
    rows = df.select(C.isoelectric_point(F.col("s")).alias("pi"), C.charge_terms(F.col("s")).alias("t"))
    rows = rows.select("pi", C.charge_at(F.col("t"), F.col("pi") - 0.01).alias("a"), C.charge_at(F.col("t"), F.col("pi") + 0.01).alias("b"))
    for r in rows.collect():
        assert r["a"] >= r["b"]
        assert r["pi"] in (pytest.approx(4.05, abs=1e-3), pytest.approx(12, abs=1e-3)) or r["a"] > 0 > r["b"]


def test_published_peptide_values(spark):
    """Molar mass of glycine and net charge signs of well-known peptides."""
    df = spark.createDataFrame([("G",), ("KKKK",), ("DDDD",)], "s string")
    rows = df.select(C.peptide_mass(F.col("s")).alias("m"), C.net_charge(F.col("s"), 7.0).alias("q")).collect()
    assert rows[0]["m"] == pytest.approx(75.07)
    assert rows[1]["q"] > 3.5 and rows[2]["q"] < -3.5


def test_chi_square_tail(spark):
    one = spark.range(1)
    for x, dof, p in [(3.841459, 1, 0.05), (9.487729, 4, 0.05), (7.814728, 3, 0.05), (13.276704, 4, 0.01), (11.0705, 5, 0.05)]:
        assert one.select(M.chi_square_p(F.lit(x), dof)).first()[0] == pytest.approx(p, abs=2e-5)


def test_balance_index_without_spread_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "net_charge double, gravy double")
    assert [r["balance_index"] for r in G.balance_index(df).collect()] == [None, None]


def test_single_value_statistics(spark):
    df = spark.createDataFrame([(1, 5.0)], "k int, v double")
    r = G.column_stats(df, "v", "k").first()
    assert (r["std"], r["mean"], r["min_at"], r["max_at"]) == (0.0, 5.0, 1, 1)
    s = G.summarize_metrics(df.withColumn("e", F.lit(None).cast("double")), ["v", "e"]).collect()
    got = {x["metric"]: (x["n"], x["std"], x["median"]) for x in s}
    assert got == {"v": (1, None, 5.0), "e": (0, None, None)}
