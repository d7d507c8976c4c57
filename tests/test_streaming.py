"""Replayed parts give the same scores as one batch; a second run adds only what is new."""

from pyspark.sql import functions as F

from seqloom.operators import scoring as C
from seqloom.streaming import jobs as N


SCHEMA = "name string, sequence string"


def _score(spark, src, at):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    N.incremental_scoring(stream, "charge", f"{at}/out", f"{at}/state").awaitTermination()
    return sorted(map(tuple, N.scored(spark, f"{at}/out").collect()), key=str)


def test_incremental_scoring_does_not_depend_on_the_batches(spark, tmp_path):
    rows = [("a", "MKTAYK"), ("b", "DDEE"), ("c", "MKTAYK"), ("a", "MKTAYK"), ("d", "RRRR"), ("b", "KK"), ("e", None), ("f", ""), ("b", "DDEE"), (None, "RRRR")]
    rows += [(f"n{i}", "MKTAYK") for i in range(60)]
    got = {}
    for n in (1, 3, 7):
        src = str(tmp_path / f"in{n}")
        for i in range(n):
            spark.createDataFrame(rows[i::n], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got[n] = _score(spark, src, tmp_path / f"job{n}")
        assert spark.read.parquet(f"{tmp_path}/job{n}/out/scores").count() == 6  # each sequence once
    assert got[1] == got[3] == got[7]
    want = dict(sorted(((k, s) for k, s in rows), key=lambda r: r[1] or ""))
    assert {r[0]: r[1] for r in got[1]} == want
    scores = {r["sequence"]: r["charge_score"] for r in C.score_batch(spark.createDataFrame(rows, SCHEMA), "charge").collect()}
    assert all(r[2] == scores[r[1]] for r in got[1])


def test_a_later_batch_reads_no_earlier_rows(spark, tmp_path):
    src, out = str(tmp_path / "in"), tmp_path / "job" / "out"
    for rows in ([("a", "MKTAYK"), ("b", "DDEE")], [("a", "MKTAYK"), ("c", "DDEE"), ("d", "RRRR")]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        _score(spark, src, tmp_path / "job")
        for name in ("keys", "scores"):  # what is stored is moved out of the job's sight
            (out / name).rename(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}")
    last = {n: max(p for p in tmp_path.iterdir() if p.name.startswith(f"{n}-")) for n in ("keys", "scores")}
    assert sorted(r["name"] for r in spark.read.parquet(str(last["keys"])).collect()) == ["c", "d"]
    assert [r["sequence"] for r in spark.read.parquet(str(last["scores"])).collect()] == ["RRRR"]


def test_counters_in_update_mode(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "source string, n int"
    for rows in ([("x", 1), ("y", 9)], [("x", 9), ("x", 1)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = N.quality_counters(stream, "source", F.when(F.col("n") < 5, "short"))
    N.run_to_table(q, str(tmp_path / "t"), str(tmp_path / "c"), "update").awaitTermination()
    got = {(r["source"], r["reason"], r["n"]) for r in N.latest(spark, str(tmp_path / "t"), ["source", "reason"]).collect()}
    assert got == {("x", "short", 2), ("y", "ok", 1), ("x", "ok", 1)}


def _windows_of(spark, tmp_path, files, name, **options):
    src = str(tmp_path / f"{name}-in")
    for rows in files:
        spark.createDataFrame(rows, "t timestamp, u string, v double").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("t timestamp, u string, v double").option("maxFilesPerTrigger", 1).parquet(src)
    mode = options.pop("mode", "update")
    table = str(tmp_path / f"{name}-t")
    N.run_to_table(N.windowed_metrics(stream, "t", "v", ["u"], **options), table, str(tmp_path / f"{name}-c"), mode).awaitTermination()
    return sorted((r["start"], r["end"], r["u"], r["n"], r["total"]) for r in N.latest(spark, table, ["start", "end", "u"]).collect())


def test_windows_do_not_depend_on_the_number_of_files(spark, tmp_path):
    from datetime import datetime, timedelta

    start = datetime(2024, 5, 1)
    rows = [(start + timedelta(minutes=7 * i), "ab"[i % 2], float(i)) for i in range(63)]
    cuts = {n: [rows[i * 63 // n : (i + 1) * 63 // n] for i in range(n)] for n in (1, 3, 7)}
    for kind, options in {"tumbling": {}, "sliding": {"slide": "30 minutes"}, "session": {"gap": "1 hour", "mode": "append"}}.items():
        got = {n: _windows_of(spark, tmp_path, files, f"{kind}{n}", **dict(options)) for n, files in cuts.items()}
        assert got[1] == got[3] == got[7]
        assert kind == "session" or sum(r[3] for r in got[1]) == 63 * (2 if options else 1)


def test_late_rows_are_dropped(spark, tmp_path):
    from datetime import datetime

    # A batch drops rows behind the watermark of the batch before it.
    at = [(12, 0, 1.0), (15, 0, 2.0), (15, 2, 16.0), (12, 30, 4.0), (15, 1, 8.0)]
    got = _windows_of(spark, tmp_path, [[(datetime(2024, 5, 1, h, m), "a", v)] for h, m, v in at], "late")
    assert [(r[0].hour, r[3], r[4]) for r in got] == [(12, 1, 1.0), (15, 3, 26.0)]


def test_window_queries_do_not_depend_on_the_cut_of_the_table(spark, tmp_path):
    from seqloom.catalog.files import sessions, sliding, tumbling

    t = F.timestamp_micros(F.lit(1714521600000000) + F.col("id") * 420000000).cast("timestamp_ntz")
    events = spark.range(63).select(t.alias("ts"), (F.col("id") % 3).alias("user_id"), F.lit("a").alias("event_type"), F.col("id").cast("double").alias("value"))
    events = events.where("user_id <> 1 or id < 25 or id > 50")
    rows = {}
    for n in (1, 3, 7):
        for i in range(n):  # every n-th row, so that each file covers the whole time range
            events.where(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 420000000) % n == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{n}/events.parquet")
        for q in (tumbling, sliding, sessions):
            rows[q, n] = sorted(map(tuple, q(spark, f"{tmp_path}/{n}").collect()))
    for q in (tumbling, sliding, sessions):
        assert rows[q, 1] and rows[q, 1] == rows[q, 3] == rows[q, 7]
    assert sum(r[3] for r in rows[tumbling, 7]) == events.count()


def test_state_of_scoring_holds_no_sequences_and_stays_on_disk(spark, tmp_path):
    src, at = str(tmp_path / "in"), tmp_path / "job"
    text = "MKTAYKWQ" * 500
    rows = [(f"k{i}", text + "ACDEFGHIKL"[i % 10] * i) for i in range(200)] + [("k0", text), ("none", None), ("empty", "")]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", *N.ON_DISK)}
    assert len(_score(spark, src, at)) == 202 and spark.read.parquet(f"{at}/out/scores").count() == 202
    state = [p for n in ("keys", "scores") for p in (at / "state" / n / "state").rglob("*") if p.is_file()]
    assert any(p.suffix in (".changelog", ".zip") for p in state)  # RocksDB's, not the files of maps in memory
    assert sum(p.stat().st_size for p in state) < 4000 * len(rows) / 8
    assert {k: spark.conf.get(k, None) for k in before} == before
