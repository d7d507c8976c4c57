"""Queries of order-based operators."""

from pyspark.sql import functions as F

from seqloom import bindings as V
from seqloom.catalog.aggregates import rounded
from seqloom.catalog.registry import query
from seqloom.operators import windows as W

HOURLY = """v_hour AS (SELECT event_type, epoch_us(ts) // 3600000000 AS hour, count(*) AS n FROM events GROUP BY ALL)"""


def events(spark, sf):
    return V.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", V.micros("ts").alias("us"))


def hourly(spark, sf):
    return events(spark, sf).groupBy("event_type", F.floor(F.col("us") / 3600000000).alias("hour")).agg(F.count("*").alias("n"))


@query("windowed_metrics", """SELECT user_id, "window", count(*) AS steps, round(avg(value), 6) AS value FROM (
  SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS "window" FROM events) GROUP BY ALL""")
def windowed(spark, sf):
    return rounded(W.windowed_metrics(events(spark, sf), ["user_id"], ["us", "event_id"], ["value"], 10))


@query("take_until", """SELECT p_brand, n FROM (SELECT *, sum(n) OVER (ORDER BY sha1(p_brand) ROWS UNBOUNDED PRECEDING) - n AS before FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1))
  WHERE before < (SELECT count(*) FROM part) * 0.3::DOUBLE""")
def take_until(spark, sf):
    p = V.table(spark, sf, "part")
    n = p.groupBy("p_brand").agg(F.count("*").alias("n"))
    return W.take_until(n, "n", [F.sha1("p_brand")], p.agg(F.count("*") * 0.3).scalar())


SMOOTH = "v_e AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS w FROM events)"


@query("smooth", V.with_views(SMOOTH, body="""SELECT event_id, round(avg(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS smoothed FROM v_e WHERE v IS NOT NULL
  UNION ALL SELECT event_id, NULL FROM v_e WHERE v IS NULL"""))
def smooth(spark, sf):
    e = events(spark, sf).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return rounded(W.smooth(e, ["user_id"], ["us", "event_id"], "v").select("event_id", "smoothed"))


@query("smooth_weighted", V.with_views(SMOOTH, body="""SELECT event_id, round(CASE WHEN sum(w) OVER f = 0 THEN 0 ELSE sum(v * w) OVER f / sum(w) OVER f END, 6) AS smoothed
  FROM v_e WHERE v IS NOT NULL WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) UNION ALL SELECT event_id, NULL FROM v_e WHERE v IS NULL"""))
def smooth_weighted(spark, sf):
    e = events(spark, sf).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    e = e.withColumn("w", F.when(F.col("event_type") == "click", 0).otherwise(1))
    return rounded(W.smooth(e, ["user_id"], ["us", "event_id"], "v", 1, "w").select("event_id", "smoothed"))


@query("contiguous_regions", """WITH r AS (SELECT user_id, value > 20 AS f, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM r WHERE f)
SELECT user_id, min(i) AS start, max(i) + 1 AS "end" FROM g GROUP BY user_id, k""")
def regions(spark, sf):
    e = events(spark, sf).withColumn("f", F.col("value") > 20)
    return W.contiguous_regions(e, ["user_id"], ["us", "event_id"], "f")


@query("contiguous_split", V.with_views(HOURLY, body="""SELECT event_type, min(hour) AS first, max(hour) AS last, count(*) AS n FROM (
  SELECT *, hour - row_number() OVER (PARTITION BY event_type ORDER BY hour) AS k FROM v_hour) GROUP BY event_type, k"""))
def runs(spark, sf):
    return W.contiguous_split(hourly(spark, sf), ["event_type"], "hour")


@query("merge_ranges", """WITH r AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS a, l_partkey + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
o AS (SELECT *, max(b) OVER (PARTITION BY s ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY a, b) AS k FROM o)
SELECT s, min(a) AS start, max(b) AS "end" FROM i GROUP BY s, k""")
def merge_ranges(spark, sf):
    li = V.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("bigint")).alias("end")
    )
    return W.merge_ranges(li, ["s"])


@query("ecdf", "SELECT DISTINCT l_extendedprice AS value, round(cume_dist() OVER (ORDER BY l_extendedprice), 9) AS cdf FROM lineitem")
def ecdf(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("value"))
    return rounded(W.ecdf(li, "value"), "value", digits=9)


@query("ecdf_grouped", "SELECT DISTINCT event_type, value, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 9) AS cdf FROM events")
def ecdf_grouped(spark, sf):
    return rounded(W.ecdf(events(spark, sf), "value", ["event_type"]), "value", digits=9)


@query("index_cdf", "SELECT event_id, round((row_number() OVER (ORDER BY value, event_id) - 1) / count(*) OVER ()::DOUBLE, 9) AS cdf FROM events")
def index_cdf(spark, sf):
    return rounded(W.index_cdf(events(spark, sf), "value", ["event_id"]).select("event_id", "cdf"), digits=9)


BIN = "(SELECT min(value) AS lo, max(value) AS hi FROM events)"


@query("bin_column", f"""SELECT event_id, CAST(b AS BIGINT) AS bin, CAST(20 - 1 - b + 1 AS BIGINT) AS rank FROM (
  SELECT event_id, CASE WHEN value >= hi THEN 19 ELSE floor((value - lo) * 19 / (hi - lo)) END AS b FROM events, {BIN})""")
def bin_column(spark, sf):
    b = W.bin_column(events(spark, sf), "value", 20, name="bin")
    return W.bin_column(b, "value", 20, reverse=True, add=1, name="rank").select("event_id", "bin", "rank")


@query("derivative", """SELECT user_id, (x2 + event_id) / 2.0 AS mid, round((v2 - v) / (x2 - event_id), 6) AS slope, sign(v2) <> sign(v) AS sign_change FROM (
  SELECT user_id, event_id, value - 25 AS v, lead(event_id) OVER w AS x2, lead(value - 25) OVER w AS v2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE x2 IS NOT NULL""")
def derivative(spark, sf):
    e = events(spark, sf).withColumn("v", F.col("value") - 25)
    return rounded(W.derivative(e, ["user_id"], "event_id", "v"), "mid")


@query("row_ids", V.with_views(V.PEPTIDES, body="SELECT sequence, 'seq_' || (row_number() OVER (ORDER BY length(sequence), sha1(sequence)) - 1) AS row_id FROM v_pep"))
def row_ids(spark, sf):
    return W.row_ids(V.peptides(spark, sf).select("sequence"), [F.length("sequence"), F.sha1("sequence")])


@query("best_candidate", "SELECT p_brand, arg_min(p_partkey, (-p_size, p_partkey)) AS p_partkey, max(p_size) AS p_size FROM part GROUP BY 1")
def best(spark, sf):
    p = V.table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    return W.best_candidate(p, ["p_brand"], "p_size", "p_partkey")


@query("unique_names", "SELECT p_partkey, p_name || '__row' || CASE WHEN r < 10000 THEN lpad(r::VARCHAR, 4, '0') ELSE r::VARCHAR END AS p_name FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS r FROM part)")
def unique_names(spark, sf):
    return W.unique_names(V.table(spark, sf, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"])


PEAK = """g0 AS (SELECT event_type, row_number() OVER w - 1 AS pos, n::DOUBLE AS y, lag(n) OVER w AS l, lead(n) OVER w AS r FROM v_hour WINDOW w AS (PARTITION BY event_type ORDER BY hour)),
g1 AS (SELECT event_type, pos, y, CASE WHEN l IS NULL THEN r - y WHEN r IS NULL THEN y - l ELSE (r - l) / 2.0::DOUBLE END AS d FROM g0),
g2 AS (SELECT event_type, max(y) AS top, max(abs(d)) AS steep, arg_min(pos, (-y, pos)) AS peak, max(pos) AS fin FROM g1 GROUP BY 1),
g3 AS (SELECT g1.event_type, pos, y, d / steep AS d, top, peak, fin, lag(d / steep) OVER w AS dp, lead(d / steep) OVER w AS dn FROM g1 JOIN g2 USING (event_type) WINDOW w AS (PARTITION BY g1.event_type ORDER BY pos)),
g4 AS (SELECT *, abs(pos - peak) AS step, CASE WHEN abs(pos - peak) = 1 THEN 0 WHEN pos > peak THEN dp ELSE dn END AS old FROM g3 WHERE pos <> peak),
g5 AS (SELECT *, abs(d) < 0.02 AND abs(old) < 0.02 AS flat FROM g4 WHERE 100 * abs((y - top) / top) > 7 AND (d * old < 0 OR (abs(d) < 0.02 AND abs(old) < 0.02)))"""


@query("peak_region", V.with_views(HOURLY, PEAK, body="""SELECT g2.event_type, peak,
  peak - coalesce((SELECT greatest(min(step) - 1 - CAST(arg_min(flat, step) AS INTEGER), 0) FROM g5 WHERE g5.event_type = g2.event_type AND pos < g5.peak), peak) AS first,
  peak + coalesce((SELECT greatest(min(step) - 1 - CAST(arg_min(flat, step) AS INTEGER), 0) FROM g5 WHERE g5.event_type = g2.event_type AND pos > g5.peak), fin - peak) AS last FROM g2"""))
def peak(spark, sf):
    return W.peak_region(hourly(spark, sf).withColumn("n", F.col("n").cast("double")), ["event_type"], ["hour"], "n")


@query("order_check", """SELECT user_id, coalesce(bool_and(value >= p), true) AS is_sorted, coalesce(bool_and(value > p), true) AS is_strict, min(value) = max(value) AS all_equal,
  max(value) - min(value) <= 100 AS nearly_equal FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1""")
def order_check(spark, sf):
    return W.order_check(events(spark, sf), ["user_id"], ["us", "event_id"], "value", 100)


@query("split_in", "SELECT event_id, ntile(7) OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS part FROM events")
def split_in(spark, sf):
    return W.split_in(events(spark, sf), 7, ["us", "event_id"], ["event_type"]).select("event_id", "part")


@query("split_every", "SELECT event_id, (row_number() OVER (ORDER BY ts, event_id) - 1) // 100 AS part FROM events")
def split_every(spark, sf):
    return W.split_every(events(spark, sf), 100, ["us", "event_id"]).select("event_id", "part")
