"""Queries of metrics and sample statistics."""

from pyspark.sql import functions as F

from seqloom import bindings as V, constants as K
from seqloom.catalog.aggregates import NUMERIC, rounded
from seqloom.catalog.registry import query
from seqloom.functions.sequences import letters
from seqloom.operators import metrics as M


@query("confusion_metrics", V.with_views(V.SCORES, body="""SELECT round(tp / (tp + fp), 6) AS precision, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy,
  round((tp * tn - fp * fn) / sqrt((tp + fp) * (tn + fn) * (tp + fn) * (tn + fp)), 6) AS mcc FROM (
  SELECT count(*) FILTER (WHERE s1 > 0.5::DOUBLE AND quality = 1)::DOUBLE AS tp, count(*) FILTER (WHERE s1 > 0.5::DOUBLE AND quality = 0)::DOUBLE AS fp,
  count(*) FILTER (WHERE s1 <= 0.5::DOUBLE AND quality = 0)::DOUBLE AS tn, count(*) FILTER (WHERE s1 <= 0.5::DOUBLE AND quality = 1)::DOUBLE AS fn FROM v_score)"""))
def confusion(spark, sf):
    hit, y = F.col("s1") > 0.5, F.col("quality")
    c = V.scores(spark, sf).agg(
        F.count_if(hit & (y == 1)).alias("tp"), F.count_if(hit & (y == 0)).alias("fp"), F.count_if(~hit & (y == 0)).alias("tn"), F.count_if(~hit & (y == 1)).alias("fn")
    )
    return rounded(c.select(*M.confusion_metrics(*[F.col(x) for x in ("tp", "fp", "tn", "fn")])))


ROC = """g AS (SELECT s1, sum(quality)::DOUBLE AS p, sum(1 - quality)::DOUBLE AS n FROM v_score WHERE quality IS NOT NULL GROUP BY s1),
r AS (SELECT s1, p, n, sum(p) OVER (ORDER BY s1 DESC) AS tp, sum(n) OVER (ORDER BY s1 DESC) AS fp, sum(p) OVER () AS pp, sum(n) OVER () AS nn FROM g)"""


@query("roc", V.with_views(V.SCORES, ROC, body="SELECT s1, round(tp / pp, 6) AS tpr, round(fp / nn, 6) AS fpr FROM r"))
def roc(spark, sf):
    return rounded(M.roc(V.scores(spark, sf), "quality", "s1").select("s1", "tpr", "fpr"), "s1")


@query("auc", V.with_views(V.SCORES, ROC, body="""SELECT round(sum(n / nn * (tp - p / 2) / pp), 6) AS auc, arg_min(s1, (pow(fp / nn, 2) + pow(1 - tp / pp, 2), -s1)) AS threshold FROM r"""))
def auc(spark, sf):
    return rounded(M.auc(V.scores(spark, sf), "quality", "s1"), "threshold")


@query("precision_recall", V.with_views(V.SCORES, ROC, body="SELECT s1, round(tp / (tp + fp), 6) AS precision, round(tp / pp, 6) AS recall FROM r"))
def pr(spark, sf):
    return rounded(M.precision_recall(V.scores(spark, sf), "quality", "s1").select("s1", "precision", "recall"), "s1")


@query("average_precision", V.with_views(V.SCORES, ROC, body="SELECT round(sum(p / pp * tp / (tp + fp)), 6) AS average_precision, round((SELECT avg(quality) FROM v_score), 6) AS base_rate FROM r"))
def ap(spark, sf):
    return rounded(M.average_precision(V.scores(spark, sf), "quality", "s1"))


@query("paired_errors", """SELECT l_returnflag, round(corr(l_quantity, l_extendedprice / 1000), 6) AS pearson, round(avg(pow(l_quantity - l_extendedprice / 1000, 2)), 6) AS mse,
  round(avg(abs(l_quantity - l_extendedprice / 1000)), 6) AS mae, round(sqrt(avg(pow(l_quantity - l_extendedprice / 1000, 2))), 6) AS rmsd FROM lineitem GROUP BY 1""")
def paired(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumn("x", F.col("l_extendedprice") / 1000)
    return rounded(M.paired_errors(li, "l_quantity", "x", ["l_returnflag"]))


@query("absolute_deviations", """SELECT event_type, round(median(abs(value - med)), 6) AS mad, round(avg(abs(value - av)), 6) AS mean_abs_dev FROM (
  SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS med, avg(value) OVER (PARTITION BY event_type) AS av FROM events) GROUP BY 1""")
def deviations(spark, sf):
    return rounded(M.absolute_deviations(V.table(spark, sf, "events"), "value", ["event_type"]))


MASK = """v_m AS (SELECT pair_id, input_sequence AS a, generated_sequence AS b, least(length(input_sequence), length(generated_sequence)) AS n FROM v_pair),
v_mp AS (SELECT pair_id, a[p] AS x, b[p] AS y, n FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM v_m) WHERE a[p] IN ('A', 'E', 'S'))"""


@query("masked_accuracy", V.with_views(V.PAIRS, MASK, body="SELECT round(avg(CASE WHEN x = y THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, count(*) AS masked FROM v_mp"))
def masked_accuracy(spark, sf):
    p = V.pairs(spark, sf)
    n = F.least(F.length("input_sequence"), F.length("generated_sequence"))
    a, b = F.slice(letters(F.col("input_sequence")), F.lit(1), n), F.slice(letters(F.col("generated_sequence")), F.lit(1), n)
    mask = F.transform(a, lambda c: c.isin("A", "E", "S"))
    per = p.where(n > 0).select(*M.masked_accuracy(b, a, mask))
    return per.agg(F.round(F.sum("correct") / F.sum("masked"), 6).alias("accuracy"), F.sum("masked").alias("masked"))


@query("masked_nll", """WITH p AS (SELECT vec_id, len(embedding) AS n, list_filter(list_transform(embedding, lambda x: 1 / (1 + exp(-x::DOUBLE))), lambda q: q > 0.5) AS k FROM embeddings),
s AS (SELECT n, len(k) AS k, coalesce(list_sum(list_transform(k, lambda q: -ln(q))), 0) AS s FROM p)
SELECT round(sum(s) / sum(k), 6) AS nll, round(sum(s * n / greatest(k, 1)) / sum(k), 6) AS reweighted FROM s""")
def masked_nll(spark, sf):
    e = V.table(spark, sf, "embeddings").select(
        F.transform("embedding", lambda x: 1 / (1 + F.exp(-x.cast("double")))).alias("prob"), F.size("embedding").alias("n")
    ).withColumn("mask", F.transform("prob", lambda q: q > 0.5))
    return rounded(M.masked_nll(e, "prob", "mask", "n"))


@query("macro_prf", """WITH d AS (SELECT p_size % 7 AS t, CASE WHEN p_size > 40 THEN p_size % 5 ELSE p_size % 7 END AS p FROM part),
c AS (SELECT t AS c, count(*) AS support, count(*) FILTER (WHERE t = p) AS tp FROM d GROUP BY 1),
q AS (SELECT c.*, (SELECT count(*) FROM d WHERE d.p = c.c) AS predicted FROM c)
SELECT round(avg(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END), 6) AS precision, round(avg(tp / support), 6) AS recall, round(avg(2 * tp / (predicted + support)), 6) AS f1 FROM q""")
def macro(spark, sf):
    s = F.col("p_size")
    d = V.table(spark, sf, "part").select((s % 7).alias("t"), F.when(s > 40, s % 5).otherwise(s % 7).alias("p"))
    return rounded(M.macro_prf(d, "t", "p"))


@query("ovr_auc", """WITH e AS (SELECT vec_id, label, list_transform(embedding[1:10], lambda x: exp(x::DOUBLE)) AS p FROM embeddings),
l AS (SELECT vec_id, label, unnest(list_transform(p, lambda x: round(x / list_sum(p), 9))) AS score, unnest(range(10)) AS cls FROM e),
g AS (SELECT cls, score, sum(CASE WHEN label = cls THEN 1 ELSE 0 END)::DOUBLE AS p, sum(CASE WHEN label = cls THEN 0 ELSE 1 END)::DOUBLE AS n FROM l GROUP BY ALL),
r AS (SELECT *, sum(p) OVER (PARTITION BY cls ORDER BY score DESC) AS tp, sum(p) OVER (PARTITION BY cls) AS pp, sum(n) OVER (PARTITION BY cls) AS nn FROM g)
SELECT round(avg(a), 6) AS macro_auc, count(a) AS classes FROM (SELECT cls, sum(n / nn * (tp - p / 2) / pp) AS a FROM r GROUP BY cls)""")
def ovr(spark, sf):
    e = V.table(spark, sf, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(x.cast("double"))).alias("p"))
    return rounded(M.ovr_auc(e, "label", "p", 10, "vec_id"))


CHI = """o AS (SELECT event_type, count(*)::DOUBLE AS obs FROM events GROUP BY 1), x AS (SELECT obs, avg(obs) OVER () AS ex, count(*) OVER () - 1 AS dof FROM o)"""


@query("chi_square", V.with_views(CHI, body="""SELECT round(sum(pow(obs - ex, 2) / ex), 6) AS chi2, any_value(dof) AS dof, round(sum(pow(obs - ex, 2) / ex) / any_value(dof), 6) AS reduced,
  round(2 * sum(obs * ln(obs / ex)), 6) AS g, round(exp(-sum(pow(obs - ex, 2) / ex) / 2) * (1 + sum(pow(obs - ex, 2) / ex) / 2), 6) AS p_value FROM x"""))
def chi(spark, sf):
    o = V.table(spark, sf, "events").groupBy("event_type").agg(F.count("*").cast("double").alias("obs"))
    mean = o.agg(F.avg("obs")).scalar()
    c = M.chi_square(o.withColumn("ex", mean), "obs", "ex")
    return rounded(c.withColumn("p_value", M.chi_square_p(F.col("chi2"), 4)))


@query("separation", """WITH a AS (SELECT value AS v FROM events WHERE event_type = 'view'), b AS (SELECT value + 20 AS v FROM events WHERE event_type = 'purchase'),
qa AS (SELECT quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3 FROM a), qb AS (SELECT quantile_cont(v, 0.25) AS q1, median(v) AS med, quantile_cont(v, 0.75) AS q3 FROM b)
SELECT round(1 / (1 + exp(-2 * (qb.med - qa.med) / greatest(qb.q3 - qb.q1, qa.q3 - qa.q1))) - 0.5 * ((SELECT avg(CASE WHEN v >= qb.q1 THEN 1.0::DOUBLE ELSE 0 END) FROM a) +
  (SELECT avg(CASE WHEN v <= qa.q3 THEN 1.0::DOUBLE ELSE 0 END) FROM b)), 6) AS efficiency, round(qa.med, 6) AS median_smaller, round(qb.med, 6) AS median_larger FROM qa, qb""")
def separation(spark, sf):
    e = shifted(spark, sf)
    return rounded(M.separation(e, "value", "event_type", "view", "purchase"))


def shifted(spark, sf):
    moved = F.when(F.col("event_type") == "purchase", F.col("value") + 20).otherwise(F.col("value"))
    return V.table(spark, sf, "events").withColumn("value", moved)


@query("best_split", """WITH s AS (SELECT event_type = 'purchase' AS big, CASE WHEN event_type = 'purchase' THEN value + 20 ELSE value END AS v FROM events WHERE event_type IN ('view', 'purchase')),
c AS (SELECT v, count(*) FILTER (WHERE NOT big) AS s, count(*) FILTER (WHERE big) AS l FROM s GROUP BY v),
r AS (SELECT v, sum(s) OVER (ORDER BY v) / (sum(s) OVER ())::DOUBLE AS below, 1 - sum(l) OVER (ORDER BY v) / (sum(l) OVER ())::DOUBLE AS above FROM c)
SELECT round((below + above) * 50, 6) AS efficiency, v AS threshold FROM r WHERE round(below - above, 12) >= 0 ORDER BY v LIMIT 1""")
def best_split(spark, sf):
    return rounded(M.best_split(shifted(spark, sf), "value", "event_type", "view", "purchase"), "threshold")


@query("vector_summary", """SELECT source, round(avg(x), 6) AS mean, round(coalesce(stddev_samp(x), 0), 6) AS std, max(x) AS max, min(x) AS min, round(sum(x), 6) AS sum,
  round(coalesce(avg(x) FILTER (WHERE x > 0), 0), 6) AS mean_positive, round(coalesce(sum(z) / count(z), 0), 6) AS z_score, round(coalesce(sum(z), 0), 6) AS z_sum FROM (
  SELECT source, x, CASE WHEN x < -0.7 THEN 0.5 * (x - 0.7) WHEN x > 0.7 THEN 0.5 * (x + 0.7) END AS z FROM (SELECT source, (n_chars % 401 - 200) / 100.0::DOUBLE AS x FROM documents)) GROUP BY 1""")
def vector_summary(spark, sf):
    d = V.table(spark, sf, "documents").select("source", ((F.col("n_chars") % 401 - 200) / 100.0).alias("x"))
    return rounded(M.vector_summary(d, "x", ["source"]), "max", "min")


@query("normalize", "SELECT event_id, round(1000000 * value / (SELECT sum(value) FROM events), 4) AS share FROM events")
def normalize(spark, sf):
    n = M.normalize(V.table(spark, sf, "events"), "value", "share")
    return n.select("event_id", F.round(F.col("share") * 1000000, 4).alias("share"))
