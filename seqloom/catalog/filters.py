"""Queries of filters and predicates."""

from pyspark.sql import functions as F

from seqloom import bindings as V, constants as K
from seqloom.catalog.registry import query
from seqloom.catalog.scalars import micromolar_sql, unit_sql
from seqloom.functions import chemistry as C
from seqloom.operators import filters as L

A = K.RESIDUES

MASTER_RAW = f"""v_raw AS (SELECT p_partkey, {V.residues_sql('p_name')} AS sequence_key, CASE WHEN p_size > 2 THEN 'yes' ELSE 'no' END AS std,
  p_brand, p_type, p_size FROM part)"""


def master_raw(spark, sf):
    return V.table(spark, sf, "part").select(
        "p_partkey", V.residues_of(F.col("p_name")).alias("sequence_key"), F.lit("").alias("representative_sequence"),
        F.when(F.col("p_size") > 2, "yes").otherwise("no").alias("is_standard_aa_sequence"),
        F.col("p_brand").alias("evidence_groups"), F.lit("db").alias("databases"), F.lit("positive").alias("activity_summary"),
        F.lit("unknown").alias("hemolysis_summary"), F.col("p_type").alias("combo_class"), F.col("p_size").alias("evidence_rows"),
    )


@query("load_master", V.with_views(MASTER_RAW, body=f"""SELECT sequence_key AS sequence, length(sequence_key) AS sequence_length, arg_max(p_brand, p_partkey) AS evidence_groups,
  arg_max(p_type, p_partkey) AS combo_class, arg_max(p_size, p_partkey) AS evidence_rows FROM v_raw
  WHERE std = 'yes' AND length(sequence_key) BETWEEN 5 AND 100 GROUP BY sequence_key"""))
def load_master(spark, sf):
    return L.load_master(master_raw(spark, sf), "p_partkey").select(
        "sequence", "sequence_length", "evidence_groups", "combo_class", "evidence_rows"
    )


FILTERED = f"""v_num AS (SELECT *, upper(trim(metric)) AS m, TRY_CAST(trim(raw_value) AS DOUBLE) AS number, {unit_sql('unit')} AS u FROM v_meas),
v_act AS (SELECT * FROM v_num WHERE m IN ('MIC','MBC','IC50','EC50') AND trim(comparator) IN ('', '=', '~', '<', '<=') AND number IS NOT NULL),
v_um AS (SELECT a.*, p.sequence, {micromolar_sql('number', 'u', 'sequence')} AS um FROM v_act a JOIN v_pep p USING (p_partkey))"""


def usable_activity(spark, sf):
    master = V.peptides(spark, sf).select("p_partkey", "sequence", C.peptide_mass(F.col("sequence")).alias("mass"))
    return L.with_micromolar(L.activity_filter(V.measurements(spark, sf)).join(master, "p_partkey"))


@query("activity_filter", V.with_views(V.MEASUREMENTS, FILTERED, body="""SELECT m AS metric, u AS unit, count(*) AS n, round(sum(um), 4) AS total
  FROM v_um WHERE um > 0 GROUP BY ALL"""))
def activity_filter(spark, sf):
    return usable_activity(spark, sf).groupBy("metric", C.normalize_unit(F.col("unit")).alias("unit")).agg(
        F.count("*").alias("n"), F.round(F.sum("um"), 4).alias("total")
    )


LABELLED = """v_lab AS (SELECT d.doc_id, CASE toxic WHEN 1 THEN 'hemolytic' WHEN 0 THEN 'unknown' ELSE '' END AS hemolysis,
  CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'mixed' ELSE 'negative' END AS activity FROM documents d LEFT JOIN labels y ON d.doc_id = y.doc_id)"""


def labelled(spark, sf):
    j = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id", "left")
    return j.select(
        "doc_id", "source", F.when(F.col("toxic") == 1, "hemolytic").when(F.col("toxic") == 0, "unknown").otherwise("").alias("hemolysis"),
        F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "mixed").otherwise("negative").alias("activity"),
    )


@query("known_label", V.with_views(LABELLED, body="""SELECT hemolysis NOT IN ('', 'unknown') AS known, activity IN ('positive', 'continuous', 'mixed') AS pretrain,
  count(*) AS n FROM v_lab GROUP BY ALL"""))
def known_label(spark, sf):
    return labelled(spark, sf).groupBy(
        L.known_label(F.col("hemolysis")).alias("known"), L.pretrain_eligible(F.col("activity")).alias("pretrain")
    ).agg(F.count("*").alias("n"))


@query("length_between", V.with_views(V.PEPTIDES, body="SELECT p_partkey, sequence FROM v_pep WHERE sequence IS NOT NULL AND length(sequence) BETWEEN 10 AND 14"))
def length_between(spark, sf):
    return L.length_between(V.peptides(spark, sf), "sequence", 10, 14).select("p_partkey", "sequence")


@query("scorable", f"""SELECT conv_id, turn, NOT regexp_matches(s, '[^{A}]') AS accepted FROM (
  SELECT conv_id, turn, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM conversations WHERE role IN ('user', 'assistant'))""")
def scorable(spark, sf):
    c = L.role_rows(V.table(spark, sf, "conversations"), "role", ["user", "assistant"])
    c = c.withColumn("s", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")))
    ok, rejected = L.scorable(c, ["s"])
    return ok.select("conv_id", "turn", F.lit(True).alias("accepted")).union(
        rejected.select("conv_id", "turn", F.lit(False).alias("accepted"))
    )


@query("role_rows", """SELECT conv_id, turn, role FROM conversations WHERE role = 'system' OR (SELECT count(*) FROM conversations WHERE role = 'system') = 0""")
def role_rows(spark, sf):
    return L.role_rows(V.table(spark, sf, "conversations"), "role", ["system"]).select("conv_id", "turn", "role")


@query("keep_if", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def keep_if(spark, sf):
    o = L.filter_columns(V.table(spark, sf, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus"])
    return L.remove_column(L.keep_if(o, "o_totalprice", lambda c: c > 250000), "o_orderstatus")


@query("filter_null", V.with_views(V.MEASUREMENTS, body="SELECT TRY_CAST(trim(raw_value) AS DOUBLE) IS NOT NULL AS kept, count(*) AS n FROM v_meas GROUP BY 1"))
def filter_null(spark, sf):
    kept, dropped = L.filter_null(V.measurements(spark, sf), ["raw_value"])
    parts = kept.select(F.lit(True).alias("kept")).union(dropped.select(F.lit(False).alias("kept")))
    return parts.groupBy("kept").agg(F.count("*").alias("n"))


CLEANED = """v_dup AS (SELECT *, min(name) OVER (PARTITION BY aligned) AS first_name,
  length(regexp_extract(aligned, '^-*')) AS lead, length(regexp_extract(aligned, '-*$')) AS trail FROM v_aln),
v_cl AS (SELECT *, CASE WHEN name <> first_name THEN 'duplicate'
  WHEN lead > 2 THEN 'leading_gaps' WHEN trail > 2 THEN 'trailing_gaps' WHEN trail > 0 THEN 'filled' ELSE 'ok' END AS reason FROM v_dup)"""


@query("clean_alignment", V.with_views(V.ALIGNED, CLEANED, body="""SELECT name, reason, CASE reason WHEN 'ok' THEN aligned
  WHEN 'filled' THEN left(aligned, 40 - trail) || right('SS', trail) END AS cleaned FROM v_cl"""))
def clean_alignment(spark, sf):
    return L.clean_alignment(V.aligned(spark, sf), "name", cysteines=(), max_leading=2).select("name", "reason", "cleaned")


@query("clean_alignment_counts", V.with_views(V.ALIGNED, body="""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN substr(aligned, 9, 1) <> 'C' THEN 'misaligned_cysteine'
  WHEN length(regexp_extract(aligned, '^-*')) > 0 THEN 'leading_gaps'
  WHEN length(regexp_extract(left(aligned, 39), '-*$')) > 2 THEN 'trailing_gaps'
  WHEN length(regexp_extract(left(aligned, 39), '-*$')) > 0 THEN 'filled' ELSE 'ok' END AS reason FROM v_aln) GROUP BY 1"""))
def clean_counts(spark, sf):
    return L.reason_counts(
        L.clean_alignment(V.aligned(spark, sf), "name", cysteines=(9,), max_leading=0, chain="L", drop_duplicates=False)
    )


@query("min_aligned", V.with_views(V.ALIGNED, body="""SELECT CASE WHEN length(replace(aligned, '-', '')) < 30 THEN 'no hit' WHEN frag % 2 <> 0 THEN 'wrong chain type' ELSE 'accepted' END AS outcome,
  count(*) AS n FROM v_aln GROUP BY 1"""))
def min_aligned(spark, sf):
    a = V.aligned(spark, sf).withColumn("chain", F.when(F.col("frag") % 2 == 0, "H").otherwise("K"))
    ok, failed = L.min_aligned(a, 30, chain="chain", wanted="H")
    return ok.select(F.lit("accepted").alias("outcome")).union(failed.select("reason")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("drop_unaligned_tail", V.with_views(V.ALIGNED, body="SELECT name FROM v_aln WHERE right(aligned, 3) <> '---'"))
def tail(spark, sf):
    return L.drop_unaligned_tail(V.aligned(spark, sf)).select("name")


@query("chain_filter", "SELECT doc_id, 'H' AS h FROM documents WHERE lang NOT IN ('fr', 'de') AND source NOT LIKE '%9'")
def chain_filter(spark, sf):
    d = V.table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") == "fr", "K").when(F.col("lang") == "de", "L").otherwise("H").alias("h"),
        F.when(F.col("source").endswith("9"), "H").otherwise("K").alias("l"),
    )
    return L.chain_filter(d, "h", "l").select("doc_id", "h")


@query("complete_rows", V.with_views(V.ALIGNED, body="SELECT name FROM v_aln WHERE regexp_matches(left(aligned, 3), '[^-]') AND regexp_matches(right(aligned, 3), '[^-]')"))
def complete(spark, sf):
    return L.complete_rows(V.aligned(spark, sf)).select("name")
