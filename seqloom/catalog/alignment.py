"""Queries of alignment statistics and of residue ranks (G4)."""

from pyspark.sql import functions as F

from seqloom import bindings as V, constants as K
from seqloom.catalog.aggregates import rounded
from seqloom.catalog.registry import query
from seqloom.functions.sequences import letters
from seqloom.operators import alignment as N

SYM = N.SYMBOLS

FREQ = V.POSITIONS + f""",
v_grid AS (SELECT pos, aa FROM (SELECT unnest(range(1, 41)) AS pos) CROSS JOIN (SELECT unnest(string_split('{SYM}', '')) AS aa)),
v_cnt AS (SELECT pos, aa, sum(frag % 3 + 1)::DOUBLE AS c FROM v_pos GROUP BY ALL),
v_gap AS (SELECT pos, coalesce(c, 0) AS gaps FROM (SELECT DISTINCT pos FROM v_grid) LEFT JOIN (SELECT pos, c FROM v_cnt WHERE aa = '-') USING (pos)),
v_freq AS (SELECT g.pos, g.aa, coalesce(c, 0) AS c, (coalesce(c, 0) + CASE WHEN g.aa = '-' THEN 0 ELSE 0.05::DOUBLE END) / (total + 1) AS freq,
  CASE WHEN g.aa <> '-' AND total - gaps > 0 THEN coalesce(c, 0) / (total - gaps + 1) ELSE 0 END AS freq_no_gaps
  FROM v_grid g LEFT JOIN v_cnt USING (pos, aa) JOIN v_gap USING (pos), (SELECT sum(frag % 3 + 1)::DOUBLE AS total FROM v_aln))"""


def freq(spark, sf):
    a = V.aligned(spark, sf).withColumn("w", F.col("frag") % 3 + 1)
    return N.position_frequencies(a, weight="w")


def cast_pos(df):
    return df.withColumn("pos", F.col("pos").cast("bigint"))


@query("position_frequencies", V.with_views(FREQ, body="SELECT pos, aa, round(freq, 9) AS freq, round(freq_no_gaps, 9) AS freq_no_gaps FROM v_freq"))
def position_frequencies(spark, sf):
    return cast_pos(rounded(freq(spark, sf), digits=9))


@query("log_odds", V.with_views(FREQ, body="""SELECT pos, aa, round(log2((CASE WHEN freq > 0 THEN freq ELSE (SELECT min(bg) FROM b) / 10 END) / bg), 6) AS log_odds FROM v_freq JOIN b USING (aa)""").replace(
    "\nSELECT pos, aa, round(log2", ",\nb AS (SELECT aa, CASE WHEN m > 0 THEN m ELSE min(CASE WHEN m > 0 THEN m END) OVER () / 4 END AS bg FROM (SELECT aa, avg(freq) AS m FROM v_freq GROUP BY aa))\nSELECT pos, aa, round(log2"))
def log_odds(spark, sf):
    return cast_pos(rounded(N.log_odds(freq(spark, sf))))


@query("conservation", V.with_views(FREQ, "m AS (SELECT aa, sum(freq) / (SELECT sum(freq) FROM v_freq WHERE aa <> '-') AS mean FROM v_freq WHERE aa <> '-' GROUP BY aa)",
       body="SELECT pos, round(sqrt(sum(pow(freq - mean, 2))), 9) AS conservation FROM v_freq JOIN m USING (aa) GROUP BY pos"))
def conservation(spark, sf):
    return cast_pos(rounded(N.conservation(freq(spark, sf)), digits=9))


@query("consensus", V.with_views(FREQ, body=f"""SELECT string_agg(aa, '' ORDER BY pos) AS consensus FROM (
  SELECT pos, arg_min(aa, (-freq, instr('{SYM}', aa))) AS aa FROM v_freq GROUP BY pos)"""))
def consensus(spark, sf):
    return N.consensus(freq(spark, sf))


@query("strict_consensus", V.with_views(V.POSITIONS, "n AS (SELECT pos, aa, count(*) AS c FROM v_pos GROUP BY ALL)", "t AS (SELECT count(*) AS total FROM v_aln)", body=f"""
SELECT string_agg(CASE WHEN c = total THEN aa WHEN c >= total / 2.0 THEN lower(aa) WHEN gaps > 0 THEN ',' ELSE '*' END, '' ORDER BY pos) AS consensus
FROM (SELECT pos, arg_min(aa, (-c, instr('{SYM}', aa))) AS aa, max(c) AS c, sum(CASE WHEN aa = '-' THEN c ELSE 0 END) AS gaps FROM n GROUP BY pos), t"""))
def strict(spark, sf):
    return N.strict_consensus(V.aligned(spark, sf))


@query("top_residues", V.with_views(FREQ, body="SELECT * FROM (SELECT pos, aa, row_number() OVER (PARTITION BY pos ORDER BY round(freq, 12) DESC, aa) AS rank FROM v_freq) WHERE rank <= 5"))
def top_residues(spark, sf):
    f = freq(spark, sf).withColumn("freq", F.round("freq", 12))
    return cast_pos(N.top_residues(f, 5).select("pos", "aa", "rank"))


KEY = "QVQLVQSGAEVKKPGASVKVSCKAS-GYTFT--SYYMHWV-"
QUERY_KEY = KEY.replace("-", "") + "RQAP"


@query("frequencies_by_query", V.with_views(FREQ, f"k AS (SELECT pos, '{KEY}'[pos] AS residue FROM (SELECT unnest(range(1, 41)) AS pos))", body=f"""
, ki AS (SELECT row_number() OVER (ORDER BY pos) - 1 AS idx, residue, pos FROM k WHERE residue <> '-')
SELECT idx, residue, pos, aa, round(freq, 9) AS freq FROM ki JOIN v_freq USING (pos)
UNION ALL SELECT {len(KEY.replace('-', ''))} + i, 'RQAP'[i + 1], NULL, NULL, NULL FROM (SELECT unnest(range(4)) AS i)"""))
def by_query(spark, sf):
    out = N.frequencies_by_query(freq(spark, sf), KEY, QUERY_KEY)
    return rounded(out.select(F.col("idx").cast("bigint").alias("idx"), "residue", F.col("pos").cast("bigint").alias("pos"), "aa", "freq"), digits=9)


RANGES = [(5, 10), (18, 21), (30, 40)]


@query("same_loop_length", V.with_views(V.ALIGNED, """li AS (SELECT name, length(replace(substr(aligned, 5, 6), '-', '')) AS c1,
  length(replace(substr(aligned, 18, 4), '-', '')) AS c2, length(replace(substr(aligned, 30, 11), '-', '')) AS c3 FROM v_aln)""", body="""
SELECT a.name, a.c1 = k.c1 AS same_cdr1, a.c2 = k.c2 AS same_cdr2, a.c3 = k.c3 AS same_cdr3, a.c1 = k.c1 AND a.c2 = k.c2 AND a.c3 = k.c3 AS same_all FROM li a, (SELECT * FROM li WHERE name = '0_0') k"""))
def same_loop(spark, sf):
    return N.same_loop_length(V.aligned(spark, sf), "0_0", RANGES)


@query("block_frequencies", V.with_views(V.POSITIONS, body=f"""SELECT 'cdr1' AS block, g.pos, g.aa, round((coalesce(c, 0) + CASE WHEN g.aa = '-' THEN 0 ELSE 0.05::DOUBLE END) / ((SELECT count(*) FROM v_aln WHERE aligned[5] <> '-') + 1), 9) AS freq
  FROM (SELECT pos, aa FROM (SELECT unnest(range(5, 11)) AS pos) CROSS JOIN (SELECT unnest(string_split('{SYM}', '')) AS aa)) g
  LEFT JOIN (SELECT pos, v_pos.aa, count(*) AS c FROM v_pos JOIN v_aln USING (name) WHERE aligned[5] <> '-' GROUP BY ALL) n USING (pos, aa)"""))
def blocks(spark, sf):
    cond = F.substring("aligned", 5, 1) != "-"
    out = N.block_frequencies(V.aligned(spark, sf), {"cdr1": (5, 10, cond)})
    return cast_pos(rounded(out.select("block", "pos", "aa", "freq"), digits=9))


@query("per_length_score", V.with_views(V.ALIGNED, body=f"""SELECT name, round(s / n, 6) AS score, round((0.8::DOUBLE - 1) / (0.988047::DOUBLE - 1) * (exp(-s / n) - 1) + 1, 6) AS nativeness
  FROM (SELECT name, length(replace(aligned, '-', '')) AS n,
    list_sum(list_transform(string_split(replace(aligned, '-', ''), ''), lambda c: instr('{K.RESIDUES}', c) / 100.0::DOUBLE)) AS s FROM v_aln)"""))
def per_length(spark, sf):
    sym = letters(F.col("aligned"))
    scores = F.transform(sym, lambda c: F.instr(F.lit(K.RESIDUES), c) / 100.0)
    sel = F.transform(sym, lambda c: c != "-")
    return rounded(V.aligned(spark, sf).select(
        "name", N.per_length_score(scores, sym).alias("score"), N.nativeness(scores, sel, K.NATIVENESS_THRESHOLDS["VH"]).alias("nativeness")
    ))
