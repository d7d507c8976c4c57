"""Results do not depend on the size of the input: null groups, long motifs, wide windows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import fragments, joins as J, motifs as M, ordered as O, windows as W


@pytest.fixture(scope="module")
def groups(spark):
    def make(n):
        return spark.range(n).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("g"), (F.col("id") % 7).cast("double").alias("v")).cache()

    return make


@pytest.mark.parametrize("n", [40, 400, 4000])
def test_null_groups_stay(groups, n):
    df = groups(n)
    rows = {(r["g"], r["idx"], r["t"]) for r in O.running(df, ["id"], ["g"], {"t": "v"}).collect()}
    want = set()
    for g in (None, 1, 2, 3):
        total = 0.0
        for i, k in enumerate(k for k in range(n) if (k % 4 or None) == g):
            total += k % 7
            want.add((g, i, total))
    assert rows == want
    near = O.neighbours(df, ["id"], {"p": ("id", "prev")}, ["g"])
    assert near.where("p is null").count() == 4 and near.where("p <> id - 4").count() == 0 and near.count() == n
    held = O.carry(df.withColumn("x", F.when(F.col("id") < 4, F.col("id"))), ["id"], {"y": ("x", "back")}, ["g"])
    assert held.where("y <> id % 4 or y is null").count() == 0 and held.count() == n
    assert O.quantiles(df, "v", {"q": 0.5}, ["g"]).count() == 4
    assert W.order_check(df, ["g"], ["id"], "id").where("is_strict").count() == 4
    assert W.windowed_metrics(df, ["g"], ["id"], ["v"], 5).agg(F.sum("steps")).first()[0] == n
    assert W.smooth(df, ["g"], ["id"], "v").count() == n
    assert W.split_in(df, 3, ["id"], ["g"]).count() == n
    assert W.ecdf(df, "v", ["g"]).where("cdf = 1").count() == 4


@pytest.mark.parametrize("k", [3, 200, 257, 600, 1500])
def test_windows_longer_than_a_block(spark, k):
    text = "".join("ACDEFGHIK"[i * i % 9] for i in range(1400))
    got = {(r["start"], r["window"]) for r in fragments.text_windows(spark.createDataFrame([(1, text)], "id long, s string"), "id", "s", k).collect()}
    assert got == {(i, text[i : i + k]) for i in range(len(text))}


def test_long_motif_is_found(spark):
    text = "".join(np.random.default_rng(1).choice(list("ACDEFGHIK"), 1400))
    texts = spark.createDataFrame([(1, text)], "id long, sequence string")
    table = spark.createDataFrame([(text[300:900], "exact", None)], "motif string, kind string, regex string")
    assert [(r["start"], r["end"]) for r in M.exact_hits(texts, table, "id").collect()] == [(300, 900)]


def test_window_wider_than_a_chunk(spark):
    n, k = 12_000, 5000
    df = spark.range(n).select("id", (F.col("id") * 7919 % 1009).cast("double").alias("v"))
    got = dict(W.smooth(df, [], ["id"], "v", k).select("id", "smoothed").collect())
    v = np.arange(n) * 7919 % 1009
    total = np.concatenate(([0], np.cumsum(v)))
    for i in (0, 1, 4095, 4096, 4999, 5000, 6000, 8191, 8192, 11_999):
        a, b = max(0, i - k), min(n, i + k + 1)
        assert got[i] == pytest.approx((total[b] - total[a]) / (b - a))


def test_columns_side_by_side_keep_all_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, p string")
    b = spark.createDataFrame([(2, "q")], "k int, p string")
    assert sorted(map(tuple, J.hstack(a, b, ["k"]).collect())) == [(1, "x", None), (2, "y", "q"), (3, "z", None)]
    assert sorted(map(tuple, J.zip_columns(b, a, ["k"], ["k"]).select("p", "p_2").collect()), key=str) == [("q", "x"), (None, "y"), (None, "z")]


def test_strict_clusters_are_complete_and_maximal(spark):
    from seqloom.operators import clusters as C

    rng = np.random.default_rng(6)
    x = rng.uniform(0, 10, (50, 2))
    x[20:28] = x[20]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k long, a double, b double")
    got = dict(C.threshold_clusters(df, "k", ["a", "b"], threshold=0.006, strict=True).collect())
    scaled = x / x.sum(axis=0)
    d = np.sqrt(((scaled[:, None] - scaled[None]) ** 2).sum(-1))
    groups = [[i for i in got if got[i] == g] for g in sorted(set(got.values()))]
    assert sorted(got) == list(range(50)) and len(groups) < 43
    assert all(d[np.ix_(g, g)].max() <= 0.006 for g in groups)
    assert not any(d[np.ix_(g, h)].max() <= 0.006 for k, g in enumerate(groups) for h in groups[:k])


@pytest.mark.parametrize("last, points", [(2048, 1024), (0, 16)])
def test_strict_clusters_without_a_pair_table(spark, monkeypatch, last, points):
    from seqloom.operators import clusters as C

    def pairs(*_):
        raise AssertionError("a table of all pairs within the threshold")

    monkeypatch.setattr(C, "pairs_within", pairs)
    monkeypatch.setattr(C, "LINK_LAST", last)
    monkeypatch.setattr(C, "LINK_POINTS", points)
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.integers(0, 8, (30, 2)).astype(float), rng.uniform(0, 8, (30, 2))))
    x[40:55] = x[40]  # many equal rows
    got = dict(C.complete_linkage(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>"), 2, 2.0).collect())
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    groups = {i: [i] for i in range(len(x))}
    while True:
        far = {(a, b): d[np.ix_(groups[a], groups[b])].max() for a in groups for b in groups if a < b}
        near = {c: min((far[p], p) for p in far if c in p) for c in groups if any(c in p and far[p] <= 2.0 for p in far)}
        moves = {p for s, p in near.values() if s <= 2.0 and all(near[c][1] == p for c in p)}
        if not moves:
            break
        for a, b in moves:
            groups[a] += groups.pop(b)
    assert got == {i: a for a, g in groups.items() for i in g}
