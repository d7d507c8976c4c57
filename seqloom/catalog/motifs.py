"""Queries of motif operators and split summaries (E6)."""

from pyspark.sql import functions as F

from seqloom import bindings as V, constants as K
from seqloom.catalog.aggregates import rounded
from seqloom.catalog.registry import query
from seqloom.operators import filters as L, motifs as M, windows as W


def active(spark, sf):
    table = V.motifs(spark, sf).where("type <> 'negative'")
    extra = spark.createDataFrame([(p, "PROSITE") for p in V.PROSITE_PATTERNS], "pattern string, type string")
    return M.load_motifs(table.union(extra))


def exact_active(spark, sf):
    return M.load_motifs(V.motifs(spark, sf).where("type <> 'negative'"))


def negative(spark, sf):
    return M.load_negative(V.motifs(spark, sf).where("type = 'negative'").select(F.col("pattern").alias("motif")))


@query("load_motifs", V.with_views(V.MOTIFS, body="""SELECT pattern AS motif, 'exact' AS kind FROM v_motif WHERE type = 'MERCI' UNION ALL SELECT pattern, 'negative' FROM v_motif WHERE type = 'negative'"""))
def load_motifs(spark, sf):
    table = V.motifs(spark, sf).where("type <> 'negative'").union(spark.createDataFrame([("[K]R[", "PROSITE"), ("", "MERCI")], "pattern string, type string"))
    a = M.load_motifs(table, ("merci", "prosite")).select("motif", "kind")
    return a.union(negative(spark, sf).select("motif", F.lit("negative")))


@query("prosite_to_regex", V.with_views(V.MOTIFS, body="""SELECT pattern, pattern[1] || '.{2}[' || pattern[2:3] || '].' || pattern[4] || '.{1,3}\\*' AS regex FROM v_motif"""))
def prosite(spark, sf):
    p = F.col("pattern")
    text = F.concat_ws("-", F.substring(p, 1, 1), F.lit("x(2)"), F.concat(F.lit("["), F.substring(p, 2, 2), F.lit("]")), F.lit(" X "), F.substring(p, 4, 1), F.lit("x(1,3)"), F.lit("*"))
    return V.motifs(spark, sf).select("pattern", M.prosite_to_regex(text).alias("regex"))


HITS = V.SEQS + ",\n" + V.MOTIFS + """,
v_win AS (SELECT doc_id, i AS start, substr(sequence, i + 1, 30) AS w FROM (SELECT doc_id, sequence, unnest(range(length(sequence))) AS i FROM v_seq)),
v_hit AS (SELECT doc_id, start, start + length(pattern) AS fin, pattern AS motif, type = 'negative' AS neg FROM v_win JOIN v_motif ON left(w, 5) = left(pattern, 5) AND starts_with(w, pattern)),
v_cov AS (SELECT doc_id, pos, max(CASE WHEN neg THEN 0 ELSE 1 END) AS a, max(CASE WHEN neg THEN 1 ELSE 0 END) AS n FROM (SELECT doc_id, neg, unnest(range(start, fin)) AS pos FROM v_hit) GROUP BY ALL),
v_sum AS (SELECT doc_id, CAST(sum(a) AS BIGINT) AS a, CAST(sum(n) AS BIGINT) AS n, count(*) AS u FROM v_cov GROUP BY 1),
v_prof AS (SELECT s.doc_id, length(sequence) AS length, coalesce(a, 0) AS active_positions, coalesce(n, 0) AS negative_positions, coalesce(u, 0) AS fixed_positions,
  length(sequence) - coalesce(a, 0) AS free_de, length(sequence) - coalesce(u, 0) AS free_inp,
  CASE WHEN length(sequence) > 0 THEN coalesce(a, 0) / length(sequence) ELSE 0 END AS active_fraction,
  CASE WHEN length(sequence) > 0 THEN coalesce(u, 0) / length(sequence) ELSE 0 END AS fixed_fraction,
  coalesce(a, 0) > 0 AS has_active, coalesce(n, 0) > 0 AS has_negative FROM v_seq s LEFT JOIN v_sum USING (doc_id))"""


@query("exact_motif_hits", V.with_views(HITS, body="SELECT doc_id, start, fin, motif FROM v_hit WHERE NOT neg"))
def exact_hits(spark, sf):
    h = M.exact_hits(V.seqs(spark, sf), exact_active(spark, sf), "doc_id")
    return h.withColumnRenamed("end", "fin")


REGEX_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{p}' AS motif, CAST(list_sum(list_transform(regexp_extract_all(sequence, '{r}'), lambda m: length(m))) AS BIGINT) AS covered, "
    f"len(regexp_extract_all(sequence, '{r}')) AS n, length(regexp_extract(sequence, '^(.*?){r}', 1)) AS first_start FROM v_seq WHERE regexp_matches(sequence, '{r}')"
    for p, r in zip(V.PROSITE_PATTERNS, ["TH[EA].{2}N", "S.T.{1,3}R", "RE[DS].E"])
)


@query("regex_motif_hits", V.with_views(V.SEQS, body=REGEX_SQL))
def regex_hits(spark, sf):
    h = M.regex_hits(V.seqs(spark, sf), active(spark, sf), "doc_id")
    return h.groupBy("doc_id", "motif").agg(
        F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("n"), F.min("start").alias("first_start")
    )


@query("covered_positions", V.with_views(HITS, body="SELECT doc_id, count(*) AS covered, CAST(sum(pos) AS BIGINT) AS checksum FROM v_cov WHERE a = 1 GROUP BY 1"))
def covered(spark, sf):
    h = M.exact_hits(V.seqs(spark, sf), exact_active(spark, sf), "doc_id")
    return M.covered_positions(h, "doc_id").groupBy("doc_id").agg(F.count("*").alias("covered"), F.sum("pos").alias("checksum"))


def profile(spark, sf):
    return M.motif_profile(V.seqs(spark, sf), exact_active(spark, sf), negative(spark, sf), "doc_id")


@query("motif_profile", V.with_views(HITS, body="""SELECT doc_id, length, active_positions, negative_positions, fixed_positions, free_de, free_inp,
  round(active_fraction, 6) AS active_fraction, round(fixed_fraction, 6) AS fixed_fraction, has_active, has_negative FROM v_prof"""))
def motif_profile(spark, sf):
    return rounded(profile(spark, sf))


@query("task_flags", V.with_views(HITS, body="""SELECT doc_id, has_active AND free_de >= 1 AS de, has_active AND has_negative AND free_inp >= 1 AS inp FROM v_prof"""))
def task_flags(spark, sf):
    return M.task_flags(profile(spark, sf)).select("doc_id", "de", "inp")


@query("region_index", V.with_views(HITS, body="""SELECT doc_id, length AS n, active_positions AS active, fixed_positions - active_positions AS negative, free_inp AS free, coalesce(k, 0) AS checksum FROM v_prof
  LEFT JOIN (SELECT doc_id, CAST(sum((pos + 1) * CASE WHEN a = 1 THEN 1 ELSE 2 END) AS BIGINT) AS k FROM v_cov GROUP BY 1) USING (doc_id)"""))
def region_index(spark, sf):
    r = M.region_index(V.seqs(spark, sf), exact_active(spark, sf), negative(spark, sf), "doc_id").withColumn("c", M.region_codes(F.col("region")))
    count = lambda v: F.size(F.filter("c", lambda x: x == v)).cast("bigint")
    k = F.aggregate(F.transform("c", lambda x, i: (i + 1).cast("bigint") * x), F.lit(0).cast("bigint"), lambda a, x: a + x)
    free = F.size(F.filter(M.free_mask(F.col("region")), lambda b: b)).cast("bigint")
    return r.select("doc_id", F.size("c").cast("bigint").alias("n"), count(1).alias("active"), count(2).alias("negative"), free.alias("free"), k.alias("checksum"))


@query("require_regions", V.with_views(HITS, body="SELECT doc_id FROM v_prof WHERE active_positions >= 1 AND free_inp >= 20"))
def require_regions(spark, sf):
    r = M.region_index(V.seqs(spark, sf), exact_active(spark, sf), negative(spark, sf), "doc_id")
    return L.require_regions(r.withColumn("region", M.region_codes(F.col("region"))), min_free=20).select("doc_id")


@query("motif_spans_merged", V.with_views(HITS, """o AS (SELECT *, max(fin) OVER (PARTITION BY doc_id ORDER BY start, fin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM (SELECT DISTINCT doc_id, start, fin FROM v_hit WHERE NOT neg))""", body="""SELECT doc_id, min(start) AS start, max(fin) AS "end" FROM (
  SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, fin) AS k FROM o) GROUP BY doc_id, k"""))
def merged(spark, sf):
    return W.merge_ranges(M.exact_hits(V.seqs(spark, sf), exact_active(spark, sf), "doc_id"), ["doc_id"])


WINDOWS = """v_lw AS (SELECT doc_id, motif, start + 1 AS motif_start, fin AS motif_end, (start + fin - 1) // 2 + 1 AS motif_center,
  substr(p, (start + fin - 1) // 2 + 1, 15) AS "window" FROM v_hit JOIN (SELECT doc_id, repeat('-', 7) || sequence || repeat('-', 7) AS p FROM v_seq) USING (doc_id) WHERE NOT neg)"""


@query("motif_windows", V.with_views(HITS, WINDOWS, body="SELECT * FROM v_lw"))
def motif_windows(spark, sf):
    s = V.seqs(spark, sf)
    return M.motif_windows(s, M.exact_hits(s, exact_active(spark, sf), "doc_id"), "doc_id")


@query("logo_frequency", V.with_views(HITS, WINDOWS, "l AS (SELECT \"window\"[i] AS residue, i AS position FROM v_lw, (SELECT unnest(range(1, 16)) AS i))", body=f"""
SELECT g.position, g.residue, coalesce(n, 0) AS count, round(coalesce(n / t, 0), 6) AS frequency FROM (SELECT * FROM (SELECT unnest(range(1, 16)) AS position), (SELECT unnest(string_split('{K.RESIDUES}', '')) AS residue)) g
LEFT JOIN (SELECT position, residue, count(*) AS n FROM l GROUP BY ALL) USING (position, residue) LEFT JOIN (SELECT position, count(*) AS t FROM l WHERE residue <> '-' GROUP BY 1) USING (position)"""))
def logo(spark, sf):
    s = V.seqs(spark, sf)
    return rounded(M.logo_frequency(M.motif_windows(s, M.exact_hits(s, exact_active(spark, sf), "doc_id"), "doc_id")))


def _q(c, p):
    return f"list_sort(list({c}))[CAST(floor((count(*) - 1) * {p}::DOUBLE) AS BIGINT) + 1]"


SPLIT_COLUMNS = ["length", "active_fraction", "fixed_fraction", "free_de", "free_inp"]


@query("summarize_split", V.with_views(HITS, body="""SELECT lang, count(*) AS n, count(*) FILTER (WHERE has_active) AS with_active, count(*) FILTER (WHERE NOT has_active) AS without_active,
  count(*) FILTER (WHERE has_negative) AS with_negative, CAST(sum(active_positions) AS BIGINT) AS active_total, CAST(sum(negative_positions) AS BIGINT) AS negative_total,
  CAST(sum(fixed_positions) AS BIGINT) AS fixed_total, """ + ", ".join(
    f"round({_q(c, p)}::DOUBLE, 6) AS {c}_{n}" for c in SPLIT_COLUMNS for n, p in M.LENGTH_PROBS.items()) + " FROM v_prof JOIN documents USING (doc_id) GROUP BY lang"))
def summarize_split(spark, sf):
    p = profile(spark, sf).join(V.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(M.summarize_split(p, "lang"))


@query("label_counts", """SELECT lang, 'quality' AS label, quality AS value, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL
  UNION ALL SELECT lang, 'toxic', toxic, count(*) FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def label_counts(spark, sf):
    j = V.table(spark, sf, "documents").join(V.table(spark, sf, "labels"), "doc_id")
    return M.label_counts(j, "lang", ["quality", "toxic"])
