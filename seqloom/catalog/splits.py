"""Queries of splits, masks, grids, scoring (2.15) and whole jobs (O4)."""

from pyspark.sql import functions as F

from seqloom import bindings as V, constants as K
from seqloom.catalog.aggregates import _summary_sql, rounded
from seqloom.catalog.filters import usable_activity
from seqloom.catalog.motifs import exact_active
from seqloom.catalog.registry import ORACLES, query
from seqloom.catalog.scalars import charge_sql, unit_sql  # noqa: F401
from seqloom.functions import sequences as S
from seqloom.operators import aggregates as G, filters as L, motifs as M, scoring as C, splits as P
from seqloom.plans import dataset_build as B, reports as R


@query("group_holdout", """WITH g AS (SELECT p_brand, count(*) AS n, sha1(p_brand || '|2026') AS k FROM part GROUP BY 1),
r AS (SELECT p_brand, sum(n) OVER (ORDER BY k, p_brand) - n AS before FROM g),
h AS (SELECT p_brand FROM r WHERE before < (SELECT greatest(round_even(count(*) * 0.1::DOUBLE, 0), 1) FROM part))
SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM h) THEN 'test' ELSE 'train' END AS split FROM part""")
def group_holdout(spark, sf):
    return P.group_holdout(V.table(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "split")


@query("random_split", """SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY sha1(c_custkey || '|7'), c_custkey) <= (SELECT floor(count(*) * 0.95::DOUBLE) FROM customer) THEN 'train' ELSE 'test' END AS split FROM customer""")
def random_split(spark, sf):
    return P.random_split(V.table(spark, sf, "customer").select("c_custkey"), "c_custkey", 0.95, 7)


@query("shuffled_pool", "SELECT doc_id, n_chars FROM documents WHERE n_chars > 200 ORDER BY sha1(doc_id || '|3'), doc_id")
def shuffled_pool(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "n_chars")
    return P.shuffled_pool(d, "doc_id", 3, F.col("n_chars") > 200)


def _seed_sql(key, seed):
    return f"CAST('0x' || left(sha1({key} || '|{seed}'), 8) AS BIGINT)"


@query("order_agnostic_mask", V.with_views(V.ALIGNED, f"s AS (SELECT name, replace(aligned, '-', '') AS s FROM v_aln)", body=f"""
SELECT name, length(s) AS n, CASE WHEN length(s) > 1 THEN least(length(s) - ({_seed_sql('name', 5)} % (length(s) - 1) + 1) + 1, length(s) - length(regexp_replace(s, '[^AC]', '', 'g'))) ELSE least(1, length(s) - length(regexp_replace(s, '[^AC]', '', 'g'))) END AS n_masked FROM s"""))
def mask(spark, sf):
    a = V.aligned(spark, sf).select("name", F.replace(F.col("aligned"), F.lit("-"), F.lit("")).alias("sequence"))
    a = a.withColumn("fixed", F.transform(S.letters(F.col("sequence")), lambda c: c.isin("A", "C")))
    m = P.order_agnostic_mask(a, "name", fixed="fixed", seed=5)
    return m.select("name", F.size("tgt").cast("bigint").alias("n"), F.size(F.filter("src", lambda x: x == K.TOKEN_MASK)).cast("bigint").alias("n_masked"))


@query("order_agnostic_mask_unfixed")
def mask_all(spark, sf):
    a = V.aligned(spark, sf).select("name", F.col("aligned").alias("sequence"))
    a = a.withColumn("fixed", F.transform(S.letters(F.col("sequence")), lambda c: c == "-"))
    m = P.order_agnostic_mask(a, "name", fixed="fixed", from_free=False, seed=5)
    return m.groupBy(F.size("tgt").alias("n")).agg(F.avg("n_masked").alias("masked"), F.count("*").alias("rows"))


@query("bert_mask", V.with_views(V.SEQS, body="""SELECT doc_id, floor(floor(n * 0.15::DOUBLE) * 0.8::DOUBLE)::BIGINT AS masked, floor(floor(n * 0.15::DOUBLE) * 0.1::DOUBLE)::BIGINT AS replaced,
  n - floor(n * 0.15::DOUBLE)::BIGINT AS untouched FROM (SELECT doc_id, length(sequence) AS n FROM v_seq)"""))
def bert(spark, sf):
    b = P.bert_mask(V.seqs(spark, sf), "doc_id", seed=1)
    n = lambda v: F.size(F.filter("action", lambda x: x == v)).cast("bigint")
    return b.select("doc_id", n(1).alias("masked"), n(2).alias("replaced"), n(0).alias("untouched"))


#: Draws of 40 runs: rank by rank, from a digest.
DRAWS = """r AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i, value, event_type FROM events),
d AS (SELECT run, CAST('0x' || left(sha1(i || '|' || run || '|0'), 15) AS BIGINT) % (SELECT count(*) FROM events) AS i FROM r, (SELECT unnest(range(40)) AS run)),
s AS (SELECT run, value, event_type FROM d JOIN r USING (i))"""


def _spread_sql(c):
    return f"round(avg({c}), 6) AS {c}, round(stddev_pop({c}), 6) AS {c}_se, round(quantile_cont({c}, 0.025), 6) AS {c}_low, round(quantile_cont({c}, 0.975), 6) AS {c}_high"


@query("bootstrap", V.with_views(DRAWS, "m AS (SELECT run, avg(value) AS mean, median(value) AS median FROM s GROUP BY run)", body=f"SELECT {_spread_sql('mean')}, {_spread_sql('median')} FROM m"))
def bootstrap(spark, sf):
    return rounded(P.bootstrap(V.table(spark, sf, "events"), "value", ["event_id"], 40))


@query("bootstrap_counts", V.with_views(DRAWS, "c AS (SELECT run, event_type, count(*) AS c FROM s GROUP BY ALL)",
    body="SELECT event_type AS value, round(sum(c) / 40::DOUBLE, 6) AS mean, round(sqrt(greatest(sum(c * c) / 40::DOUBLE - pow(sum(c) / 40::DOUBLE, 2), 0)), 6) AS std FROM c GROUP BY 1"))
def bootstrap_counts(spark, sf):
    return rounded(P.bootstrap_counts(V.table(spark, sf, "events"), "event_type", ["event_id"], 40))


@query("run_grid", """SELECT t AS temperature, s AS seed, 'Temp' || t || '_Seed' || s AS subgroup, count(*) AS n, round(avg(n_chars * t + s), 6) AS score FROM documents,
  (SELECT unnest([0.8::DOUBLE, 1.0, 1.2]) AS t), (SELECT unnest([1, 7, 42]) AS s) GROUP BY ALL""")
def run_grid(spark, sf):
    g = P.run_grid(V.table(spark, sf, "documents").select("n_chars"), [1, 7, 42], [0.8, 1.0, 1.2])
    return rounded(P.subgroup_summary(g.withColumn("score", F.col("n_chars") * F.col("temperature") + F.col("seed")), ["score"]), "temperature")


@query("score_batch", V.with_views(V.SEQS, body=f"""SELECT doc_id, round(1 / (1 + exp(-({charge_sql(7.4)}))), 6) AS charge_score,
  round(length(regexp_replace(sequence, '[^{K.HYDROPHOBIC}]', '', 'g')) / nullif(length(sequence), 0), 6) AS hydrophobic_score FROM v_seq"""))
def score_batch(spark, sf):
    s = V.seqs(spark, sf)
    return rounded(C.score_batch(s, "net-charge, hydro").drop("sequence"))


@query("apply_pandas", "SELECT event_id, round(ln(1 + value), 6) AS v FROM events")
def apply_pandas(spark, sf):
    import numpy as np

    e = V.table(spark, sf, "events").select("event_id", "value")
    return rounded(C.apply_pandas(e, lambda v: np.log1p(v), ["value"], "v").select("event_id", "v"))


def word_motifs(spark, sf, which, kind):
    p = V.table(spark, sf, "part").select(V.residues_of(F.split("p_name", " ")[which]).alias("pattern")).where(F.length("pattern") >= 4).distinct()
    if kind == "negative":
        return M.load_negative(p.withColumnRenamed("pattern", "motif"))
    return M.load_motifs(p.withColumn("type", F.lit("regular")))


def built(spark, sf):
    pep = V.peptides(spark, sf)
    size, brand = F.col("p_size"), F.col("p_brand")
    raw = pep.select(
        "p_partkey", F.col("sequence").alias("sequence_key"), F.lit("").alias("representative_sequence"), F.lit("yes").alias("is_standard_aa_sequence"),
        brand.alias("evidence_groups"), F.lit("db").alias("databases"), F.when(size > 10, "positive").otherwise("negative").alias("activity_summary"),
        F.when(size % 3 == 0, "hemolytic").when(size % 3 == 1, "mixed").otherwise("unknown").alias("hemolysis_summary"),
        F.col("p_type").alias("combo_class"), size.alias("evidence_rows"),
    )
    master = L.load_master(raw, "p_partkey")
    activity = G.aggregate_activity(usable_activity(spark, sf)).join(master.select("sequence", "sequence_length", "hemolysis_summary", "combo_class"), "sequence")
    return B.build(master, activity, word_motifs(spark, sf, 0, "active"), word_motifs(spark, sf, 1, "negative"), against=0.8)


@query("dataset_build")
def dataset_build(spark, sf):
    return built(spark, sf)["splits"]


@query("property_report")
def property_report(spark, sf):
    p = V.peptides(spark, sf).select(F.col("p_partkey").cast("string").alias("sequence_id"), "sequence")
    return R.property_report(p)[1]


@query("motif_report", ORACLES["logo_frequency"])
def motif_report(spark, sf):
    d = V.seqs(spark, sf).withColumnRenamed("doc_id", "sequence_id")
    return rounded(R.motif_report(d, V.pairs(spark, sf), exact_active(spark, sf))["logo"])


SCORED = f"""t AS (SELECT 1 / (1 + exp(-({charge_sql(7.4)}))) AS charge_score,
  length(regexp_replace(sequence, '[^{K.HYDROPHOBIC}]', '', 'g')) / length(sequence) AS hydrophobic_score, p_size / 50::DOUBLE AS hemolysis_score FROM v_pep),
u AS (SELECT *, (charge_score + hydrophobic_score) / 2 AS activity_mean_score FROM t)"""


@query("score_report", V.with_views(V.PEPTIDES, SCORED, body=_summary_sql("u", ["charge_score", "hydrophobic_score", "hemolysis_score", "activity_mean_score"]) + """
  UNION ALL SELECT 'dual_hit_rate', count(*), round(avg(CASE WHEN activity_mean_score >= 0.8::DOUBLE AND hemolysis_score < 0.4::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 6), NULL, NULL, NULL, NULL FROM u"""))
def score_report(spark, sf):
    p = V.peptides(spark, sf).withColumn("hemolysis_score", F.col("p_size") / 50)
    return rounded(R.score_report(p, "charge,hydrophobic", ["charge_score", "hydrophobic_score"])[1])


@query("group_report", V.with_views(f"""t AS (SELECT conv_id, turn, role, length(text) AS score, {V.residues_sql('text')} AS aligned FROM conversations)""", """
g AS (SELECT s.role, s.score, s.aligned AS a, p.aligned AS b, u.t AS temperature, u.s AS seed FROM t s JOIN t p ON p.conv_id = s.conv_id AND p.turn = 0,
  (SELECT t, s FROM (SELECT unnest([0.8::DOUBLE, 1.0]) AS t), (SELECT unnest([1, 7]) AS s)) u WHERE s.turn > 0)""", """
k AS (SELECT *, (SELECT avg(CASE WHEN i <= length(b) AND a[i] = b[i] THEN 1.0::DOUBLE ELSE 0 END) FROM (SELECT unnest(range(1, length(a) + 1)) AS i)) AS preserved FROM g)""", """
m AS (SELECT temperature, seed, role, 'score' AS score, avg(score) AS mean, count(score) AS n FROM k GROUP BY ALL UNION ALL
  SELECT temperature, seed, role, 'preserved', avg(preserved), count(preserved) FROM k GROUP BY ALL)""", body="""
SELECT m.temperature, m.seed, m.role, m.score, round(m.mean, 6) AS mean, m.n, round(m.mean - b.mean, 6) AS improvement FROM m LEFT JOIN m b ON b.role = 'user' AND b.temperature = m.temperature AND b.seed = m.seed AND b.score = m.score"""))
def group_report(spark, sf):
    base = F.concat(F.lit("c"), F.col("conv_id"))
    name = F.when(F.col("turn") == 0, base).otherwise(F.concat(base, F.lit("_human_sample_"), F.col("turn")))
    t = V.table(spark, sf, "conversations").select("turn", "role", name.alias("name"), F.length("text").alias("score"), V.residues_of(F.col("text")).alias("aligned"))
    samples = P.run_grid(t.where("turn > 0"), [1, 7], [0.8, 1.0])
    return rounded(R.group_report(samples, t.where("turn = 0").select("name", "aligned"), ["score"], "user"), "temperature")
