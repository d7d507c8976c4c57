"""Queries of aggregates."""

from pyspark.sql import functions as F

from seqloom import bindings as V, constants as K
from seqloom.catalog.filters import FILTERED, LABELLED, labelled, usable_activity
from seqloom.catalog.registry import query
from seqloom.catalog.scalars import charge_sql, q6, weights_sql
from seqloom.functions import chemistry as C
from seqloom.operators import aggregates as G

A = K.RESIDUES


def rounded(df, *keys, digits=6):
    """Round every fractional column that is not a key."""
    t = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if t[c] == "double" and c not in keys else F.col(c) for c in df.columns])


ACTIVITY = """v_activity AS (SELECT sequence, -log10(min(um)) AS value, min(um) AS activity_uM_min, median(um) AS activity_uM_median, count(*) AS activity_records,
  string_agg(DISTINCT m, '|' ORDER BY m) AS activity_metrics, string_agg(DISTINCT unit, '|' ORDER BY unit) AS activity_units,
  string_agg(DISTINCT database, '|' ORDER BY database) AS databases FROM v_um WHERE um > 0 GROUP BY sequence)"""


@query("activity_per_sequence", V.with_views(V.MEASUREMENTS, FILTERED, ACTIVITY, body="""SELECT sequence, round(value, 6) AS value,
  round(activity_uM_min, 6) AS activity_uM_min, round(activity_uM_median, 6) AS activity_uM_median, activity_records, activity_metrics,
  activity_units, databases FROM v_activity"""))
def activity_per_sequence(spark, sf):
    return rounded(G.aggregate_activity(usable_activity(spark, sf)))


@query("potency", V.with_views(V.MEASUREMENTS, FILTERED, body="SELECT sequence, round(-log10(min(um)), 6) AS potency FROM v_um WHERE um > 0 GROUP BY 1"))
def potency(spark, sf):
    return usable_activity(spark, sf).groupBy("sequence").agg(q6(G.potency(F.min("um"))).alias("potency"))


def _summary_sql(table, columns):
    parts = [f"""SELECT '{c}' AS metric, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(median({c}), 6) AS median,
      round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM {table}""" for c in columns]
    return " UNION ALL ".join(parts)


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("summarize_metrics", _summary_sql("lineitem", NUMERIC) + """ UNION ALL SELECT 'returned_fraction', count(*), round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0 END), 6),
  NULL, NULL, NULL, NULL FROM lineitem""")
def summarize_metrics(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return rounded(G.summarize_metrics(li, NUMERIC).unionByName(G.rate_row(li, "returned", "returned_fraction")))


def _floor_sql(x, p, table, by):
    return f"list_sort(list({x}))[CAST(floor((count({x}) - 1) * {p}::DOUBLE) AS BIGINT) + 1]"


FLOORS = {"min": 0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1}


@query("floor_quantile", "SELECT event_type, " + ", ".join(f"{_floor_sql('value', p, '', '')} AS {n}" for n, p in FLOORS.items()) + " FROM events GROUP BY 1")
def floor_quantile(spark, sf):
    return G.position_quantile(V.table(spark, sf, "events"), "value", FLOORS, ["event_type"])


@query("value_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def value_counts(spark, sf):
    return G.value_counts(V.table(spark, sf, "documents"), "lang")


@query("overlap_counts", """WITH d AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT a.p_type AS split_a, b.p_type AS split_b, count(*) AS shared FROM d a JOIN d b ON a.p_brand = b.p_brand AND a.p_type < b.p_type GROUP BY ALL""")
def overlap(spark, sf):
    return G.overlap_counts(V.table(spark, sf, "part"), "p_brand", "p_type")


@query("group_mean_vs_baseline", V.with_views(V.SCORES, """m AS (
  SELECT source, 's1' AS score, avg(s1) AS mean FROM v_score GROUP BY 1 UNION ALL SELECT source, 's2', avg(s2) FROM v_score GROUP BY 1)""", body="""
SELECT source, score, round(mean, 6) AS mean, round(mean - base, 6) AS improvement, CASE WHEN mean IS NULL THEN 'no score' WHEN base IS NULL THEN 'no baseline' ELSE 'ok' END AS status
  FROM m LEFT JOIN (SELECT score, mean AS base FROM m WHERE source = 'src0') USING (score)"""))
def group_mean(spark, sf):
    return rounded(G.group_mean_vs_baseline(V.scores(spark, sf), "source", ["s1", "s2"], "src0"))


@query("improvement_table", V.with_views(V.SCORES, body="""SELECT source, round(avg(s1), 6) AS s1_mean, round(avg(s1) - (SELECT avg(s1) FROM v_score WHERE source = 'src0'), 6) AS s1_improvement,
  round(avg(s2), 6) AS s2_mean, round(avg(s2) - (SELECT avg(s2) FROM v_score WHERE source = 'src0'), 6) AS s2_improvement,
  CASE WHEN source = 'src0' THEN 'baseline' ELSE 'variant' END AS type FROM v_score GROUP BY source"""))
def improvement(spark, sf):
    return rounded(G.improvement_table(V.scores(spark, sf), "source", ["s1", "s2"], "src0"))


PROPS = V.PEPTIDES + f""",
v_prop AS (SELECT p_partkey, {charge_sql(7.4)} AS net_charge, ({weights_sql(K.KYTE_DOOLITTLE)}) / length(sequence) AS gravy,
  100::DOUBLE * ({weights_sql(K.AGGREGATION)}) / length(sequence) AS aggregation FROM v_pep)"""


def properties(spark, sf):
    s = F.col("sequence")
    return V.peptides(spark, sf).select(
        "p_partkey", C.net_charge(s).alias("net_charge"), C.gravy(s).alias("gravy"), C.na4vss(s).alias("aggregation")
    )


@query("balance_index", V.with_views(PROPS, body="""SELECT p_partkey, round(1 / (1 + exp(-((net_charge - mc) / sc - (gravy - mg) / sg))), 6) AS balance_index
  FROM v_prop, (SELECT avg(net_charge) AS mc, stddev_pop(net_charge) AS sc, avg(gravy) AS mg, stddev_pop(gravy) AS sg FROM v_prop)"""))
def balance(spark, sf):
    return G.balance_index(properties(spark, sf)).select("p_partkey", q6(F.col("balance_index")).alias("balance_index"))


@query("desirability", V.with_views(PROPS, body="""SELECT p_partkey, round(exp(-0.5 * (pow((net_charge - mc) / sc, 2) + pow((gravy - mg) / sg, 2) + pow((aggregation - ma) / sa, 2)) / 3), 6) AS desirability
  FROM v_prop, (SELECT avg(net_charge) AS mc, stddev_pop(net_charge) AS sc, avg(gravy) AS mg, stddev_pop(gravy) AS sg, avg(aggregation) AS ma, stddev_pop(aggregation) AS sa FROM v_prop)"""))
def desire(spark, sf):
    p = properties(spark, sf).withColumn("flat", F.lit(1.0))
    d = G.desirability(p, ["net_charge", "gravy", "aggregation", "flat", "helicity"])
    return d.select("p_partkey", q6(F.col("desirability")).alias("desirability"))


@query("ensemble_hit", V.with_views(V.SCORES, body="""SELECT doc_id, round(m, 6) AS activity_mean_score, coalesce(m >= 0.8::DOUBLE AND hemolysis_score < 0.4::DOUBLE, false) AS dual_hit
  FROM (SELECT *, CASE WHEN s2 IS NULL THEN s1 ELSE (s1 + s2) / 2 END AS m FROM v_score)"""))
def ensemble(spark, sf):
    return G.ensemble_hit(V.scores(spark, sf), ["s1", "s2"]).select("doc_id", q6(F.col("activity_mean_score")).alias("activity_mean_score"), "dual_hit")


@query("column_stats", """SELECT event_type, count(value) AS count, count(*) FILTER (WHERE value IS NULL) AS nulls, round(sum(value), 4) AS sum, round(avg(value), 6) AS mean,
  round(CASE WHEN count(value) > 100 THEN stddev_samp(value) ELSE stddev_pop(value) END, 6) AS std, min(value) AS min, max(value) AS max,
  arg_min(event_id, (value, event_id)) AS min_at, arg_min(event_id, (-value, event_id)) AS max_at,
  round(sum(value * w) / sum(w), 6) AS weighted_mean, round(sqrt(sum(w * pow(value - m, 2)) / sum(w)), 6) AS weighted_std
  FROM (SELECT *, user_id % 5 + 1 AS w, avg(value) OVER (PARTITION BY event_type) AS m FROM events) GROUP BY event_type""")
def column_stats(spark, sf):
    e = V.table(spark, sf, "events").withColumn("w", F.col("user_id") % 5 + 1)
    s = G.column_stats(e, "value", "event_id", ["event_type"], "w").drop("std_error")
    return rounded(s.withColumn("sum", F.round("sum", 4)), "min", "max")


@query("group_stats", """SELECT p_brand, p_type, count(p_retailprice) AS count, round(avg(p_retailprice), 6) AS mean,
  round(CASE WHEN count(*) > 100 THEN stddev_samp(p_retailprice) WHEN count(*) > 1 THEN stddev_pop(p_retailprice) ELSE 0 END, 6) AS std FROM part GROUP BY ALL""")
def group_stats(spark, sf):
    return rounded(G.column_stats(V.table(spark, sf, "part"), "p_retailprice", "p_partkey", ["p_brand", "p_type"]).select("p_brand", "p_type", "count", "mean", "std"))


@query("unique_in_order", """WITH w AS (SELECT doc_id, unnest(x) AS value, unnest(range(len(x))) AS word_no FROM (SELECT doc_id, string_split_regex(text, '[^A-Za-z]+') AS x FROM documents)),
f AS (SELECT value, min((doc_id, word_no)) AS k FROM w WHERE value <> '' GROUP BY value)
SELECT value, row_number() OVER (ORDER BY k) - 1 AS rank FROM f""")
def unique(spark, sf):
    return G.unique_in_order(V.table(spark, sf, "documents"), "text", ["doc_id"], "[^A-Za-z]+")


@query("mask_stats", """SELECT round(avg(m), 6) AS masked_per_seq, round(avg(CASE WHEN m = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS zero_mask_fraction,
  round(sum(f) / sum(n), 6) AS fixed_fraction, round(avg(CASE WHEN f = 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS no_fixed_fraction, round(avg(f), 6) AS fixed_per_seq, round(avg(n), 6) AS seq_len
  FROM (SELECT len(list_filter(embedding, lambda x: x > 0.1::FLOAT)) AS m, len(list_filter(embedding, lambda x: x < -0.2::FLOAT)) AS f, len(embedding) AS n FROM embeddings)""")
def mask_stats(spark, sf):
    e = V.table(spark, sf, "embeddings").select(
        F.transform("embedding", lambda x: x > F.lit(0.1).cast("float")).alias("m"), F.transform("embedding", lambda x: x < F.lit(-0.2).cast("float")).alias("f")
    )
    return rounded(G.mask_stats(e, "m", "f"))


@query("weighted_mean", """WITH s AS (SELECT avg(w) AS wbar, sum(w * x) / sum(w) AS mu, sum(w) AS su, count(*)::DOUBLE AS n FROM (SELECT l_quantity AS w, l_extendedprice AS x FROM lineitem))
SELECT round(any_value(mu), 4) AS mean, round(sqrt(sum(w * pow(x - mu, 2)) / any_value(su)), 4) AS std, round(1000000 / any_value(su), 6) AS variance,
  round(sqrt(any_value(n / ((n - 1) * su * su)) * (sum(pow(w * x - wbar * mu, 2)) - 2 * any_value(mu) * sum((w - wbar) * (w * x - wbar * mu)) + pow(any_value(mu), 2) * sum(pow(w - wbar, 2)))), 4) AS std_error
FROM (SELECT l_quantity AS w, l_extendedprice AS x, s.* FROM lineitem, s)""")
def weighted(spark, sf):
    m = G.weighted_mean(V.table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity")
    return m.select(*[F.round(c, 4).alias(c) for c in ("mean", "std", "std_error")], F.round(1000000 * F.col("variance"), 6).alias("variance"))


@query("weights_from_errors", """SELECT l_orderkey, l_partkey, l_linenumber, round(1 / pow(CASE WHEN l_tax > 0 THEN l_tax ELSE (SELECT min(l_tax) FROM lineitem WHERE l_tax > 0) / 10 END, 2), 4) AS weight FROM lineitem""")
def weights(spark, sf):
    return G.weights_from_errors(V.table(spark, sf, "lineitem"), "l_tax").select("l_orderkey", "l_partkey", "l_linenumber", F.round("weight", 4).alias("weight"))


@query("combo_counts", """SELECT quality, toxic, GROUPING(quality, toxic) AS level, count(*) AS n FROM labels GROUP BY CUBE (quality, toxic)""")
def combo(spark, sf):
    return G.combo_counts(V.table(spark, sf, "labels"), "quality", "toxic")


@query("length_info", V.with_views(V.ALIGNED, body="""SELECT name, length(replace(aligned, '-', '')) AS length, length(replace(substr(aligned, 5, 6), '-', '')) AS cdr1,
  length(replace(substr(aligned, 18, 4), '-', '')) AS cdr2, length(replace(substr(aligned, 30, 11), '-', '')) AS cdr3 FROM v_aln"""))
def length_info(spark, sf):
    return G.length_info(V.aligned(spark, sf), [(5, 10), (18, 21), (30, 40)])


@query("histogram", """WITH s AS (SELECT min(value) AS lo, max(value) AS hi, CAST(floor(sqrt(count(*))) AS BIGINT) AS k, count(*) AS n FROM events),
c AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / k)), k - 1) AS BIGINT) AS bin, count(*)::DOUBLE AS count FROM events, s GROUP BY 1)
SELECT g.bin, round(lo + g.bin * ((hi - lo) / k), 6) AS left_edge, coalesce(count, 0) AS count, round(coalesce(count, 0) / (n * ((hi - lo) / k)), 6) AS density
FROM (SELECT unnest(range(k)) AS bin, * FROM s) g LEFT JOIN c USING (bin)""")
def histogram(spark, sf):
    return rounded(G.histogram(V.table(spark, sf, "events"), "value"), "count")


@query("curve_summary", " UNION ALL ".join(f"""SELECT l_returnflag, '{c}' AS curve, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.25), 6) AS q25,
  round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem GROUP BY 1""" for c in NUMERIC[1:]))
def curves(spark, sf):
    return rounded(G.curve_summary(V.table(spark, sf, "lineitem"), ["l_returnflag"], NUMERIC[1:]))


@query("pivot_counts", "SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS {x}" for x in ("en", "fr", "de", "es")) + " FROM documents GROUP BY 1")
def pivot_counts(spark, sf):
    return G.pivot_counts(V.table(spark, sf, "documents"), "source", "lang", ["en", "fr", "de", "es"])


@query("melt", " UNION ALL ".join(f"SELECT l_orderkey, l_partkey, l_linenumber, '{c}' AS variable, {c} AS value FROM lineitem" for c in NUMERIC))
def melt(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", *NUMERIC)
    return G.melt(li, ["l_orderkey", "l_partkey", "l_linenumber"], NUMERIC)


@query("transpose", """SELECT 'n' AS key, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es,
  count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents""")
def transpose(spark, sf):
    return G.transpose(G.value_counts(V.table(spark, sf, "documents"), "lang"), "lang")


EVENTS = f"""v_sub AS (SELECT pair_id, p AS position_1based, input_sequence[p] AS a, generated_sequence[p] AS b
  FROM (SELECT *, unnest(range(1, least(length(input_sequence), length(generated_sequence)) + 1)) AS p FROM v_pair))"""


@query("substitution_events", V.with_views(V.PAIRS, EVENTS, body="SELECT pair_id, position_1based, a || '->' || b AS substitution FROM v_sub WHERE a <> b"))
def substitution_events(spark, sf):
    return G.substitution_events(V.pairs(spark, sf)).select("pair_id", "position_1based", "substitution")


@query("substitution_matrix", V.with_views(V.PAIRS, EVENTS, f"aa AS (SELECT unnest(string_split('{A}', '')) AS x)", body="""
SELECT i.x AS input_residue, j.x AS generated_residue, coalesce(n, 0) AS count, round(coalesce(n, 0) / (SELECT count(*) FROM v_sub WHERE a <> b), 6) AS frequency
FROM aa i CROSS JOIN aa j LEFT JOIN (SELECT a, b, count(*) AS n FROM v_sub WHERE a <> b GROUP BY ALL) ON a = i.x AND b = j.x"""))
def substitution_matrix(spark, sf):
    return rounded(G.substitution_matrix(G.substitution_events(V.pairs(spark, sf))))


@query("substitution_counters", V.with_views(V.PAIRS, EVENTS, body="""SELECT (SELECT count(*) FROM v_pair) AS n_pairs, (SELECT count(*) FROM v_pair WHERE input_sequence = '' OR generated_sequence = '') AS n_empty,
  (SELECT count(*) FROM v_pair WHERE input_sequence <> '' AND generated_sequence <> '' AND length(input_sequence) <> length(generated_sequence)) AS n_length_mismatched,
  count(*) AS n_compared, count(*) FILTER (WHERE a = b) AS n_unchanged, count(*) FILTER (WHERE a <> b) AS n_events FROM v_sub"""))
def substitution_counters(spark, sf):
    return G.substitution_counters(V.pairs(spark, sf))


@query("invert_map", "SELECT n_regionkey, arg_max(n_name, n_nationkey) AS n_name, arg_max(s_name, s_suppkey) AS s_name FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def invert_map(spark, sf):
    n, s = V.table(spark, sf, "nation"), V.table(spark, sf, "supplier")
    j = n.join(s, F.col("s_nationkey") == F.col("n_nationkey"))
    a = G.invert_map(j, "n_name", "n_regionkey", "n_nationkey")
    return a.join(G.invert_map(j, "s_name", "n_regionkey", "s_suppkey"), "n_regionkey")
