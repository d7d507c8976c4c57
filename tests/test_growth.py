"""Work that grows with the input: it is spread over tasks, and rows stand for ranges instead of positions."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom import bindings
from seqloom.operators import composition, motifs as M, similarity as S, windows as W


def test_pairs_of_a_small_file_are_spread(spark):
    rows = spark.range(0, 30, 1, 1).select("id", F.lpad(F.translate(F.col("id").cast("string"), "0123456789", "ACDEFGHIKL"), 6, "-").alias("aligned"))
    pairs = S.identity_matrix(rows, "id")
    assert pairs.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert pairs.count() == 30 * 31 // 2


def test_columns_of_uneven_texts(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choice("AC-Xé") for _ in range(n))
    rows = [(i, text(r.choice([0, 1, 4, 9])), text(r.choice([0, 1, 4, 9]))) for i in range(300)] + [(300, None, "A"), (301, "A", None)]
    got = spark.createDataFrame(rows, "i int, a string, b string").select("i", S.compare_columns("a", "b").alias("c"))
    for i, c in got.collect():
        a, b = rows[i][1:]
        if a is None or b is None:
            assert c is None
            continue
        x, y = list(a) or [""], list(b) or [""]
        n = max(len(x), len(y)) if a or b else 1
        z = [(x[k] if k < len(x) else None, y[k] if k < len(y) else None) for k in range(n)]
        both = [(p, q) for p, q in z if p not in ("", None) and not (p == "-" and q in ("-", None))]
        assert c["columns"] == len(both)
        assert c["same"] == sum(p == q for p, q in both)
        assert c["one"] == sum(q is not None and "-" in (p, q) for p, q in both)
        assert c["mutations"] == sum(p == "X" or None not in (p, q) and p != q for p, q in z)


def test_windows_are_cut_out_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "WINDOW_BLOCK", 8)
    r = random.Random(2)
    texts = [(i, "".join(r.choice("ACDé") for _ in range(r.choice([0, 1, 7, 8, 9, 40])))) for i in range(40)] + [(7, "ACDA"), (None, "ACAC")]
    spans = [(i, s, s + n, "m") for i in list(range(40)) + [None] for s in range(-2, 42, 3) for n in (1, 2, 5)]
    t = spark.createDataFrame(texts, "k int, sequence string")
    got = M.motif_windows(t, spark.createDataFrame(spans, "k int, start long, end long, motif string"), "k", width=6)
    plan = got._jdf.queryExecution().toString()
    assert "sequence(1," not in plan  # no row a position
    want = []
    for k, s, e, _ in spans:
        c = (s + e - 1) // 2
        for j, x in texts:
            if j == k is not None and 0 <= c < len(x):
                want.append((k, s + 1, e, c + 1, ("---" + x + "--")[c : c + 6]))
    assert sorted(tuple(x[c] for c in ("k", "motif_start", "motif_end", "motif_center", "window")) for x in got.collect()) == sorted(want)


@pytest.mark.parametrize("letters", [0, 2_000_000])
def test_coverage_is_a_table_of_runs(spark, monkeypatch, letters):
    import re

    monkeypatch.setattr(M, "AUTOMATON_LETTERS", letters)
    r = random.Random(8)
    text = lambda n: "".join(r.choice("ACD") for _ in range(n))
    texts = [(i, text(r.choice([0, 1, 5, 30, 90]))) for i in range(30)] + [(3, "ACAACACA" * 6), (None, "AACAD"), (40, None)]
    active = [("AAC", "exact", None), ("CACA", "exact", None), ("DD", "exact", None), ("A-x(2)-D", "regex", "A.{2}D")]
    negative = [("ACA", "exact", None), ("DD", "exact", None)]
    kinds = "motif string, kind string, regex string"
    t, a, n = spark.createDataFrame(texts, "k int, sequence string"), spark.createDataFrame(active, kinds), spark.createDataFrame(negative, kinds)
    marks = {}
    for k, s in texts:
        for bit, table in ((0, active), (1, negative)):
            for motif, kind, regex in table:
                found = re.finditer(f"(?={motif})" if kind == "exact" else regex, s or "")
                for m in found:
                    for p in range(m.start(), m.start() + len(motif) if kind == "exact" else m.end()):
                        marks.setdefault((k, p), [0, 0])[bit] = 1
    runs = M.covered_runs(t, a, n, "k").collect()
    assert sum(x["end"] - x["start"] for x in runs) == len(marks) > len(runs)
    assert {(x["k"], x["pos"]): [x["active"], x["negative"]] for x in M.coverage(t, a, n, "k").collect()} == marks
    for x in M.motif_profile(t, a, n, "k").where("k <> 3").collect():
        own = [v for (k, _), v in marks.items() if k == x["k"]]
        assert (x["active_positions"], x["negative_positions"], x["fixed_positions"]) == (sum(v[0] for v in own), sum(v[1] for v in own), len(own))
    for k, region in M.region_index(t, a, n, "k").where("k <> 3").collect():
        code = lambda v: "0" if v is None else "1" if v[0] else "2"
        s = dict(texts)[k]
        assert region == (None if s is None else "".join(code(marks.get((k, p))) for p in range(len(s))))


def test_ranges_are_read_twice_at_most(spark):
    r = random.Random(4)
    rows = [(r.choice([1, 2, None]), a, a + r.randrange(12)) for a in (r.randrange(9000) for _ in range(3000))]
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "s int, start long, end long").mapInArrow(count, "s int, start long, end long")
    want = set()
    for s in (1, 2, None):
        at = None
        for a, b in sorted(x[1:] for x in rows if x[0] == s):
            if at and a <= at[1]:
                at[1] = max(at[1], b)
            else:
                at and want.add((s, *at))
                at = [a, b]
        want.add((s, *at))
    assert {tuple(x) for x in W.merge_ranges(df, ["s"]).collect()} == want
    assert reads.value <= 2 * len(rows)


def test_blocks_of_long_texts_are_bounded_in_letters(spark, monkeypatch):
    monkeypatch.setattr(composition, "BLOCK_LETTERS", 2000)
    r = random.Random(6)
    texts = ["".join(r.choice("ACDE") for _ in range(r.choice([40, 400]))) for _ in range(120)]
    df = spark.createDataFrame([(str(i), "", t) for i, t in enumerate(texts)], "id string, scope string, sequence string")
    cells, rows = composition.fit(df, cell_rows=200)
    assert len(cells.cells) == 1 and cells.size.tolist() == [sum(map(len, texts))]
    rows = rows.select("scope", "cell", "id", "sequence").localCheckpoint()

    def run(key, a, b):
        import pyarrow as pa

        size = sum(map(len, b.column("sequence").to_pylist()))
        return pa.table({"id": a.column("id"), "letters": pa.array([size] * len(a), pa.int64()), "rows": pa.array([len(b)] * len(a), pa.int64())})

    met = composition.meet(cells, rows.limit(3), rows, run, "id string, letters long, rows long", 3).groupBy("id").agg(F.sum("rows").alias("n"), F.max("letters").alias("most"))
    for x in met.collect():
        assert x["n"] == len(texts) and x["most"] < sum(map(len, texts)) / 3


def test_a_file_of_one_row_group_is_spread(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, 400_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 512).alias("s")).write.parquet(str(tmp_path / "t.parquet"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = spark.read.parquet(str(tmp_path / "t.parquet"))
        assert df.rdd.getNumPartitions() >= cores  # most of them empty
        filled = lambda x: x.select(F.spark_partition_id()).distinct().count()
        assert filled(df) < cores == filled(bindings.spread(df))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_gaps_bring_no_texts_together(spark):
    """Texts of few letters share no key because of the gaps beside them; pairs equal brute force."""
    r = random.Random(4)
    word = lambda n: "".join(r.choice("ACD") for _ in range(n))
    few = ["".join(r.choice("ACDEFGHIKL") for _ in range(8)).ljust(40, "-") for _ in range(60)]
    base = word(40)
    texts = set(few) | {base, base[:38] + "--", "--" + base[2:], "-" * 40, base[:9] + "--" + base[11:], "AC", base + "AC"}
    for n in (1, 2, 3, 4, 5, 6, 12, 30, 39):
        texts |= {x for _ in range(6) for x in (word(n).ljust(40, "-"), word(n).rjust(40, "-"), ("--" + word(n)).ljust(40, "-")[:40])}
    texts = sorted(texts)
    got = {(x["a"], x["b"]) for x in S.similar_pairs(spark.createDataFrame([(t,) for t in texts], "aligned string"), 4).collect()}
    wide = [t for t in texts if len(t) == 40]
    ham = lambda a, b: sum(x != y for x, y in zip(a, b))
    assert {(a, b) for a, b in got if len(a) == len(b) == 40} == {(a, b) for a in wide for b in wide if a < b and ham(a, b) <= 4}
    rows = spark.createDataFrame([(t, 1, 0, 8) for t in few], "t string, n long, lo int, hi int")
    keys = S._meeting_keys(rows, 4, 40, True).groupBy("z", "y", "last", "h").count().agg(F.max("count")).first()[0]
    assert keys < len(set(few)) / 4


def test_pairs_of_vectors_meet_in_blocks(spark, monkeypatch):
    """Blocks of few rows, many rows of one distance to the pivot, and vectors that are near nothing."""
    from seqloom.operators import clusters as C

    monkeypatch.setattr(C, "BLOCK_PARTS", 64)
    monkeypatch.setattr(C, "BLOCK_ROWS", 4)
    monkeypatch.setattr(C, "SLAB", 50)
    r = random.Random(8)
    rows = [(i, [r.choice([0.0, 0.5, r.random()]) for _ in range(3)]) for i in range(150)]
    odd = [(200, None), (201, [0.0, None, 0.0]), (202, [float("nan"), 0.0, 0.0]), (203, [0.1, 0.1])]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>").repartition(3)
    got = {(x["a"], x["b"]): x["d"] for x in C.pairs_within(df, "v", 0.4).collect()}
    dist = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y)) ** 0.5
    want = {(i, j): dist(x, y) for i, x in rows for j, y in rows if i < j and dist(x, y) <= 0.4}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_draws_of_a_bootstrap_are_packed(spark, monkeypatch):
    """One row for each run and value of a bucket, not one a draw; equal to drawing one by one."""
    import hashlib
    from collections import Counter

    from seqloom.operators import splits as P

    monkeypatch.setattr(P, "DRAWN_CELLS", 200)
    values = [None, "a", "b"] * 40
    df = spark.createDataFrame(list(enumerate(values)), "k int, v string")
    got = P.resample(df, "v", 5, ["k"], seed=3).collect()
    want = Counter((run, values[int(hashlib.sha1(f"{i}|{run}|3".encode()).hexdigest()[:15], 16) % 120]) for i in range(120) for run in range(5))
    sums = Counter()
    for x in got:
        sums[x["run"], x["value"]] += x["w"]
    assert sums == want and len(got) <= 3 * 5 * 3


def test_strict_clusters_join_no_chains(spark, monkeypatch):
    """Strict mode has no use for the connected clusters, whose rounds go over all pairs."""
    from seqloom.operators import clusters as C

    def chains(*_):
        raise AssertionError("connected clusters are not asked for")

    monkeypatch.setattr(C, "connected_components", chains)
    df = spark.createDataFrame([(i, 100.0 + i, 100.0 - i % 3) for i in range(12)], "k int, a double, b double")
    assert C.threshold_clusters(df, "k", ["a", "b"], threshold=0.01, strict=True).count() == 12


def test_quantiles_of_small_groups_are_ranked_once(spark, monkeypatch):
    """Groups that fit a window are not cut into buckets of values; larger ones are. Both give the same quantiles."""
    from seqloom.operators import ordered

    monkeypatch.setattr(ordered, "bucket_count", lambda spark: 4)
    data = [(None if i % 5 == 0 else f"g{i % 5}", None if i % 17 == 0 else float(i * 37 % 101), 1 + i % 3) for i in range(400)]
    df = spark.createDataFrame(data, "g string, v double, n int")
    want = {}
    for g in {r[0] for r in data}:
        every = sorted(v for h, v, n in data if h == g and v is not None for _ in range(n))
        low, high = every[(len(every) - 1) // 2], every[len(every) // 2]
        want[g] = low + (high - low) * 0.5
    plans = []
    for limit in (ordered.GROUP_VALUES, 2):
        monkeypatch.setattr(ordered, "GROUP_VALUES", limit)
        got = ordered.quantiles(df, "v", {"m": 0.5}, ["g"], count="n")
        assert {r["g"]: r["m"] for r in got.collect()} == pytest.approx(want)
        plans.append(got._jdf.queryExecution().optimizedPlan().toString().count("Window ["))
    assert plans[0] == 1 < plans[1]


def test_identity_matrix_meets_in_blocks(spark, monkeypatch):
    r = random.Random(8)
    text = lambda n: "".join(r.choice("AC-Xé") for _ in range(n))
    key = lambda i: None if i == 5 else i // 2  # noqa: E731  keys come twice
    even = [(key(i), r.choice(["A-C-", "----", text(4).replace("é", "C")])) for i in range(60)]
    uneven = [(key(i), r.choice([None, "", text(3), text(300)])) for i in range(30)]
    monkeypatch.setattr(S, "MATRIX_LETTERS", 4000)
    for rows in (even, uneven):
        df = spark.createDataFrame(rows, "k int, aligned string")
        pairs = df.select(F.col("k").alias("a"), F.col("aligned").alias("x")).crossJoin(df.select(F.col("k").alias("b"), F.col("aligned").alias("y"))).where("a <= b")
        want = pairs.select("a", "b", F.round(S.aligned_identity(F.col("x"), F.col("y")), 6).alias("v"))
        out = S.identity_matrix(df, "k", digits=6)
        # No row of the plan is a pair of texts.
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "FlatMapGroupsInArrow" in plan
        assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
        assert S.identity_matrix(df.limit(0), "k").count() == 0
