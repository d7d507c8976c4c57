"""Queries of the column functions."""

from pyspark.sql import functions as F

from seqloom import bindings as V, constants as K
from seqloom.catalog.registry import query
from seqloom.functions import chemistry as C, sequences as S
from seqloom.operators import profiles

A = K.RESIDUES


def q6(c):
    return F.round(c, 6)


def weights_sql(table: dict, s: str = "sequence") -> str:
    return " + ".join(f"(length({s}) - length(replace({s}, '{a}', ''))) * CAST({table[a]} AS DOUBLE)" for a in A)


MASS = (
    "CASE WHEN length({s}) > 0 THEN {w} - (length({s}) - 1) * CAST(18.015 AS DOUBLE) ELSE 0 END"
)


def mass_sql(s="sequence"):
    return MASS.format(s=s, w=weights_sql(K.MASS, s))


def unit_sql(u):
    low = f"lower(trim(coalesce({u}, '')))"
    for mark in ("μ", "µ", "micro", "碌"):
        low = f"replace({low}, '{mark}', 'u')"
    return f"replace({low}, ' ', '')"


def micromolar_sql(value, unit_col, s):
    """Text of the conversion; `unit_col` is an already normalised unit."""
    ug = ", ".join(f"'{u}'" for u in K.UNITS_UG_ML)
    um = ", ".join(f"'{u}'" for u in K.UNITS_UM)
    m = f"nullif({mass_sql(s)}, 0)"
    return f"""CASE WHEN {value} > 0 THEN CASE WHEN {unit_col} IN ({um}) THEN {value}
      WHEN {unit_col} = 'nm' THEN {value} / 1000.0::DOUBLE WHEN {unit_col} = 'mm' THEN {value} * 1000
      WHEN {unit_col} IN ({ug}) THEN {value} * 1000 / {m}
      WHEN {unit_col} = 'mg/ml' THEN {value} * 1000000 / {m} END END"""


def end_pk_sql(residue, default, table):
    return f"CASE {residue} " + " ".join(f"WHEN '{a}' THEN {p}" for a, p in table.items()) + f" ELSE {default} END"


N_PK = end_pk_sql("left(sequence, 1)", K.PK_N_TERM, K.PK_N_TERM_BY_RESIDUE)
C_PK = end_pk_sql("right(sequence, 1)", K.PK_C_TERM, K.PK_C_TERM_BY_RESIDUE)


def charge_sql(ph):
    def count(a):
        return f"(length(sequence) - length(replace(sequence, '{a}', '')))"

    def pos(pk):
        return f"(pow(10::DOUBLE, {pk} - {ph}) / (pow(10::DOUBLE, {pk} - {ph}) + 1))"

    def neg(pk):
        return f"(pow(10::DOUBLE, {ph} - {pk}) / (pow(10::DOUBLE, {ph} - {pk}) + 1))"

    text = pos(f"({N_PK})")
    text += "".join(f" + {count(a)} * {pos(p)}" for a, p in K.PK_POSITIVE.items())
    text += f" - {neg(f'({C_PK})')}"
    return text + "".join(f" - {count(a)} * {neg(p)}" for a, p in K.PK_NEGATIVE.items())


MOMENT_CTE = """terms AS (SELECT doc_id, length(sequence) AS n,
    list_transform(range(length(sequence)), lambda i: i) AS ii, string_split(sequence, '') AS cc, sequence FROM v_seq)"""


def scale_sql(expr, table):
    return f"CASE {expr} " + " ".join(f"WHEN '{a}' THEN {v}::DOUBLE" for a, v in table.items()) + " END"


@query("normalize_sequence", f"""SELECT doc_id, upper(trim(regexp_replace(text, '[^A-Za-z -]', '', 'g'))) AS normalized,
  regexp_replace(upper(regexp_replace(text, '[^A-Za-z-]', '', 'g')), '-', '', 'g') AS cleaned FROM documents""")
def normalize_sequence(spark, sf):
    ascii_text = F.regexp_replace("text", "[^A-Za-z -]", "")
    return V.table(spark, sf, "documents").select(
        "doc_id", S.normalize_sequence(ascii_text).alias("normalized"), S.clean_sequence(ascii_text).alias("cleaned")
    )


@query("standard_and_invalid_residues", f"""WITH c AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS s FROM documents)
SELECT doc_id, regexp_replace(s, '[^{A}]', '', 'g') AS standard,
  array_to_string(list_sort(list_distinct(string_split(nullif(regexp_replace(s, '[{A}]', '', 'g'), ''), ''))), '') AS invalid
FROM c""".replace("array_to_string(", "coalesce(array_to_string(").replace("'') AS invalid", "''), '') AS invalid"))
def standard_and_invalid(spark, sf):
    s = F.regexp_replace("text", "[^A-Za-z]", "")
    return V.table(spark, sf, "documents").select(
        "doc_id", S.standard_sequence(s).alias("standard"), S.invalid_residues(s).alias("invalid")
    )


@query("is_valid_sequence", f"""SELECT doc_id, coalesce(length(w) BETWEEN 5 AND 100 AND regexp_matches(w, '^[{A}]+$'), false) AS valid, count(*) AS n
FROM (SELECT doc_id, unnest(string_split_regex(upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' ')) AS w FROM documents)
GROUP BY ALL""")
def is_valid(spark, sf):
    text = F.upper(F.regexp_replace("text", "[^A-Za-z ]", ""))
    w = V.table(spark, sf, "documents").select("doc_id", F.explode(F.split(text, " ")).alias("w"))
    return w.groupBy("doc_id", S.is_valid_sequence(F.col("w")).alias("valid")).agg(F.count("*").alias("n"))


@query("peptide_mass", V.with_views(V.SEQS, body=f"SELECT doc_id, round({mass_sql()}, 4) AS mass FROM v_seq"))
def mass(spark, sf):
    return V.seqs(spark, sf).select("doc_id", F.round(C.peptide_mass(F.col("sequence")), 4).alias("mass"))


@query("stable_key", V.with_views(V.SEQS, body="SELECT doc_id, sha1(sequence) AS sort_key FROM v_seq"))
def stable(spark, sf):
    return V.seqs(spark, sf).select("doc_id", S.stable_key(F.col("sequence")).alias("sort_key"))


@query("parse_float", V.with_views(V.MEASUREMENTS, body="""SELECT l_orderkey, line, p_partkey, raw_value,
  TRY_CAST(trim(raw_value) AS DOUBLE) AS value, TRY_CAST(trim(raw_value) AS DOUBLE) IS NOT NULL AS usable FROM v_meas"""))
def parse_float(spark, sf):
    v = S.parse_float(F.col("raw_value"))
    return V.measurements(spark, sf).select(
        "l_orderkey", "line", "p_partkey", "raw_value", v.alias("value"), S.is_finite(v).alias("usable")
    )


@query("normalize_unit", V.with_views(V.MEASUREMENTS, body=f"SELECT {unit_sql('unit')} AS unit, count(*) AS n FROM v_meas GROUP BY 1"))
def unit(spark, sf):
    return V.measurements(spark, sf).groupBy(C.normalize_unit(F.col("unit")).alias("unit")).agg(F.count("*").alias("n"))


@query("to_micromolar", V.with_views(V.MEASUREMENTS, body=f"""
SELECT l_orderkey, line, m.p_partkey, round({micromolar_sql('v', 'u', 'sequence')}, 6) AS um
FROM (SELECT *, TRY_CAST(trim(raw_value) AS DOUBLE) AS v, {unit_sql('unit')} AS u FROM v_meas) m JOIN v_pep USING (p_partkey)"""))
def micromolar(spark, sf):
    m = V.measurements(spark, sf).join(V.peptides(spark, sf), "p_partkey")
    um = C.to_micromolar(S.parse_float(F.col("raw_value")), F.col("unit"), C.peptide_mass(F.col("sequence")))
    return m.select("l_orderkey", "line", "p_partkey", q6(um).alias("um"))


@query("hydrophobic_fraction", V.with_views(V.SEQS, body=f"""SELECT doc_id,
  round(length(regexp_replace(sequence, '[^{K.HYDROPHOBIC}]', '', 'g')) / nullif(length(sequence), 0), 6) AS fraction FROM v_seq"""))
def fraction(spark, sf):
    return V.seqs(spark, sf).select("doc_id", q6(C.hydrophobic_fraction(F.col("sequence"))).alias("fraction"))


@query("gravy", V.with_views(V.SEQS, body=f"SELECT doc_id, round(({weights_sql(K.KYTE_DOOLITTLE)}) / nullif(length(sequence), 0), 6) AS gravy FROM v_seq"))
def gravy(spark, sf):
    return V.seqs(spark, sf).select("doc_id", q6(C.gravy(F.col("sequence"))).alias("gravy"))


@query("net_charge", V.with_views(V.SEQS, body=f"""SELECT doc_id, round(CASE WHEN length(sequence) > 0 THEN {charge_sql(7.4)} END, 6) AS charge_74,
  round(CASE WHEN length(sequence) > 0 THEN {charge_sql(7.0)} END, 6) AS charge_70 FROM v_seq"""))
def charge(spark, sf):
    s = F.col("sequence")
    return V.seqs(spark, sf).select(
        "doc_id", q6(C.net_charge(s, 7.4)).alias("charge_74"), q6(C.net_charge(s, 7.0)).alias("charge_70")
    )


def _pi_sql():
    """The halvings written out as one step per query block."""
    ctes = [f"""b0 AS (SELECT doc_id, sequence, {K.PI_START}::DOUBLE AS ph, {K.PI_LOW}::DOUBLE AS lo, {K.PI_HIGH}::DOUBLE AS hi
      FROM v_seq)"""]
    for i in range(K.PI_STEPS):
        ctes.append(f"""b{i + 1} AS (SELECT doc_id, sequence, (lo2 + hi2) / 2 AS ph, lo2 AS lo, hi2 AS hi FROM (
          SELECT doc_id, sequence, CASE WHEN up THEN ph ELSE lo END AS lo2, CASE WHEN up THEN hi ELSE ph END AS hi2
          FROM (SELECT *, {charge_sql('ph')} > 0 AS up FROM b{i})))""")
    return V.with_views(V.SEQS, *ctes, body=f"SELECT doc_id, CASE WHEN length(sequence) > 0 THEN round(ph, 4) END AS pi FROM b{K.PI_STEPS}")


@query("isoelectric_point", _pi_sql())
def pi(spark, sf):
    terms = V.seqs(spark, sf).select("doc_id", "sequence", C.charge_terms(F.col("sequence")).alias("t"))
    return terms.select("doc_id", F.when(F.length("sequence") > 0, F.round(C.isoelectric_point_from(F.col("t")), 4)).alias("pi"))


def _moment_sql(scale):
    t = scale_sql("cc[i + 1]", scale)
    x = "list_sum(list_transform(ii, lambda i: ({t}) * {f}(radians(i * 100.0::DOUBLE))))"
    return f"sqrt(pow({x.format(t=t, f='cos')}, 2) + pow({x.format(t=t, f='sin')}, 2)) / nullif(n, 0)"


@query("hydrophobic_moment", V.with_views(V.SEQS, MOMENT_CTE, body=f"""SELECT doc_id, round({_moment_sql(K.KYTE_DOOLITTLE)}, 6) AS moment_kd,
  round({_moment_sql(K.EISENBERG)}, 6) AS moment_eisenberg FROM terms"""))
def moment(spark, sf):
    s = F.col("sequence")
    return V.seqs(spark, sf).select(
        "doc_id", q6(C.hydrophobic_moment(s)).alias("moment_kd"),
        q6(C.hydrophobic_moment(s, K.EISENBERG)).alias("moment_eisenberg"),
    )


@query("na4vss", V.with_views(V.SEQS, body=f"SELECT doc_id, round(100::DOUBLE * ({weights_sql(K.AGGREGATION)}) / nullif(length(sequence), 0), 6) AS aggregation FROM v_seq"))
def na4(spark, sf):
    return V.seqs(spark, sf).select("doc_id", q6(C.na4vss(F.col("sequence"))).alias("aggregation"))


PROFILE_SQL = V.with_views(V.SEQS, MOMENT_CTE, body=f"""
SELECT s.doc_id AS sequence_id, length(raw) AS length, length(sequence) = length(raw) AND length(sequence) > 0 AS valid_standard_aa,
  coalesce(array_to_string(list_sort(list_distinct(string_split(nullif(regexp_replace(raw, '[{A}]', '', 'g'), ''), ''))), ''), '') AS invalid_residues,
  round(CASE WHEN length(sequence) > 0 THEN {charge_sql(7.4)} END, 6) AS net_charge,
  round(({weights_sql(K.KYTE_DOOLITTLE)}) / nullif(length(sequence), 0), 6) AS gravy,
  round(m, 6) AS hydrophobic_moment,
  round(100::DOUBLE * ({weights_sql(K.AGGREGATION)}) / nullif(length(sequence), 0), 6) AS aggregation,
  round(length(regexp_replace(sequence, '[^{K.HYDROPHOBIC}]', '', 'g')) / nullif(length(sequence), 0), 6) AS hydrophobic_fraction
FROM (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS raw FROM documents) r JOIN v_seq s USING (doc_id)
LEFT JOIN (SELECT doc_id, CASE WHEN n > 0 THEN {_moment_sql(K.KYTE_DOOLITTLE)} END AS m FROM terms) USING (doc_id)""")


@query("sequence_profile", PROFILE_SQL)
def sequence_profile(spark, sf):
    d = V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("sequence_id"), F.regexp_replace("text", "[^A-Za-z]", "").alias("sequence")
    )
    p = profiles.sequence_profile(d, with_pi=False)
    rounded = ["net_charge", "gravy", "hydrophobic_moment", "aggregation", "hydrophobic_fraction"]
    return p.select(
        "sequence_id", F.col("length").cast("bigint").alias("length"), "valid_standard_aa", "invalid_residues",
        *[q6(F.col(c)).alias(c) for c in rounded],
    )


@query("tokenize", V.with_views(V.ALIGNED, body=f"""SELECT name,
  array_to_string(list_transform(string_split(aligned, ''), lambda c: instr('{A}X-', c) - 1), ',') AS tokens,
  replace(aligned, '-', '') AS decoded,
  array_to_string(list_concat(list_transform(string_split(replace(aligned, '-', ''), ''), lambda c: instr('{A}X-', c) - 1),
    list_transform(range(50 - length(replace(aligned, '-', ''))), lambda i: 21)), ',') AS padded FROM v_aln"""))
def tokenize(spark, sf):
    ids = S.tokenize(F.col("aligned"))
    bare = S.tokenize(F.replace(F.col("aligned"), F.lit("-"), F.lit("")))
    return V.aligned(spark, sf).select(
        "name", F.array_join(ids.cast("array<string>"), ",").alias("tokens"), S.detokenize(ids).alias("decoded"),
        F.array_join(S.pad_tokens(bare, 50).cast("array<string>"), ",").alias("padded"),
    )


@query("one_hot", V.with_views(V.POSITIONS, body=f"""SELECT pos, instr('{A}-', aa) - 1 AS aa_index, count(*) AS n
  FROM v_pos WHERE aa <> '' GROUP BY ALL"""))
def one_hot(spark, sf):
    hot = V.aligned(spark, sf).select(F.posexplode(S.one_hot(F.col("aligned"))).alias("pos", "row"))
    flat = hot.select((F.col("pos") + 1).cast("bigint").alias("pos"), F.posexplode("row").alias("aa_index", "on"))
    return flat.where("on = 1").groupBy("pos", F.col("aa_index").cast("bigint").alias("aa_index")).agg(F.count("*").alias("n"))


def _numbering():
    """Numbering text built from an event: CDR and framework maps with single quotes and padded keys."""
    k = F.get_json_object("props", "$.k").cast("int")
    return F.concat(
        F.lit("{'fwh1': {'1 ': 'Q', '"), (k % 26 + 1), F.lit(" ': 'E'}, 'cdrh3': {'111A': 'Y', '"),
        (k % 60 + 100), F.lit("': 'W'}}"),
    )


@query("place_by_position", f"""WITH e AS (SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events),
m AS (SELECT event_id, k, k % 26 + 1 AS a, k % 60 + 100 AS b FROM e)
SELECT event_id, CASE WHEN b <= 128 THEN
  (SELECT string_agg(CASE WHEN p.pos = m.b::VARCHAR THEN 'W' WHEN p.pos = '111A' THEN 'Y' WHEN p.pos = m.a::VARCHAR THEN 'E'
    WHEN p.pos = '1' THEN 'Q' ELSE '-' END, '' ORDER BY p.i)
   FROM (SELECT unnest([{','.join(repr(p) for p in K.HEAVY_POSITIONS)}]) AS pos, unnest(range(152)) AS i) p) END AS placed
FROM m""")
def place(spark, sf):
    e = V.table(spark, sf, "events")
    return e.select("event_id", S.place_by_position(_numbering(), K.HEAVY_POSITIONS).alias("placed"))


@query("region_of", V.with_views(V.POSITIONS, body="""SELECT name, count(*) FILTER (WHERE pos BETWEEN 27 AND 38) AS cdr1,
  count(*) FILTER (WHERE pos < 27) AS fr1, count(*) FILTER (WHERE pos > 38) AS fr2,
  count(*) FILTER (WHERE pos BETWEEN 24 AND 33) AS chothia_l1 FROM v_pos WHERE aa <> '-' GROUP BY name"""))
def region(spark, sf):
    p = V.positions(spark, sf).where("aa <> '-'")
    imgt, cho = S.region_of(F.col("pos")), S.region_of(F.col("pos"), "chothia", "K")
    return p.groupBy("name").agg(
        F.count_if(imgt == "CDR1").alias("cdr1"), F.count_if(imgt == "FR1").alias("fr1"),
        F.count_if(imgt == "FR2").alias("fr2"), F.count_if(cho == "CDR1").alias("chothia_l1"),
    )


@query("segment", V.with_views(V.ALIGNED, body="""SELECT name, substr(s, 1, 10) || '|' || substr(s, 11, greatest(n - 20, 0)) || '|' || substr(s, 11 + greatest(n - 20, 0), 10) AS pieces,
  n - 20 <= 12 AS fits, true AS whole FROM (SELECT name, replace(aligned, '-', '') AS s, length(replace(aligned, '-', '')) AS n FROM v_aln)"""))
def segment(spark, sf):
    s = F.replace(F.col("aligned"), F.lit("-"), F.lit(""))
    a = V.aligned(spark, sf).select("name", s.alias("s"))
    lengths = F.array(F.lit(10), F.greatest(F.length("s") - 20, F.lit(0)), F.lit(10))
    pieces = S.segment(F.col("s"), lengths)
    return a.select(
        "name", F.array_join(pieces, "|").alias("pieces"), S.fits(lengths, [26, 12, 17]).alias("fits"),
        F.contains(F.col("s"), F.array_join(pieces, "")).alias("whole"),
    )


@query("parent_name", """SELECT split_part(name, '_human_sample_', 1) AS parent, count(*) AS n FROM (
  SELECT CASE WHEN turn = 0 THEN 'conv' || conv_id ELSE 'conv' || conv_id || '_human_sample_' || turn END AS name FROM conversations) GROUP BY 1""")
def parent(spark, sf):
    c = V.table(spark, sf, "conversations")
    base = F.concat(F.lit("conv"), F.col("conv_id"))
    name = F.when(F.col("turn") == 0, base).otherwise(F.concat(base, F.lit("_human_sample_"), F.col("turn")))
    return c.groupBy(S.parent_name(name).alias("parent")).agg(F.count("*").alias("n"))


@query("rescale", """WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
SELECT event_id, round((value - lo) / (hi - lo) * 10, 6) AS scaled, round((0.8::DOUBLE - 1) / (0.988047::DOUBLE - 1) * (value - 1) + 1, 4) AS shifted FROM events, s""")
def rescale(spark, sf):
    e = V.table(spark, sf, "events")
    return profiles.scale_in_range(e, "value", 0.0, 10.0, "scaled").select(
        "event_id", q6(F.col("scaled")).alias("scaled"),
        F.round(S.rescale_linear(F.col("value"), K.NATIVENESS_TARGET, K.NATIVENESS_THRESHOLDS["VH"]), 4).alias("shifted"),
    )


@query("dipeptide_deviation", V.with_views(V.SEQS, body=f"""
, codon AS (SELECT unnest(string_split('{A}', '')) AS aa, unnest([{','.join(str(K.CODONS[a]) for a in A)}]) AS c),
grid AS (SELECT a.aa || b.aa AS pair, a.c * b.c / 3721.0::DOUBLE AS e FROM codon a, codon b),
long AS (SELECT doc_id, sequence, length(sequence) AS n FROM v_seq WHERE length(sequence) >= 2),
pairs AS (SELECT doc_id, n, substr(sequence, i, 2) AS pair FROM (SELECT doc_id, sequence, n, unnest(range(1, n)) AS i FROM long)),
obs AS (SELECT doc_id, pair, count(*) AS k FROM pairs GROUP BY ALL)
SELECT l.doc_id, g.pair, round((coalesce(k, 0) / (n - 1)::DOUBLE - e) / sqrt(e * (1 - e) / (n - 1)), 6) AS deviation
FROM long l CROSS JOIN grid g LEFT JOIN obs o ON o.doc_id = l.doc_id AND o.pair = g.pair"""))
def dipeptides(spark, sf):
    return profiles.dipeptide_deviation(V.seqs(spark, sf), "doc_id").select("doc_id", "pair", q6(F.col("deviation")).alias("deviation"))


@query("variable_domain_text", "SELECT page_id, upper(trim(regexp_replace(url, '[^a-z ]', ' ', 'g'))) AS domain_text FROM pages")
def domain(spark, sf):
    return V.table(spark, sf, "pages").select(
        "page_id", S.normalize_sequence(F.regexp_replace("url", "[^a-z ]", " ")).alias("domain_text")
    )


@query("apply_and_round", """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 7) AS net,
  round(l_extendedprice / l_quantity, 7) AS l_extendedprice, round(l_tax, 7) AS l_tax FROM lineitem""")
def apply_round(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_quantity", "l_tax")
    out = profiles.apply_column(li, lambda p, d: p * (1 - d), ["l_extendedprice", "l_discount"], "net")
    out = profiles.apply_column(out, lambda p, n: p / n, ["l_extendedprice", "l_quantity"])
    return profiles.round_all(out.drop("l_quantity", "l_discount"), 7, half_even=False)


@query("pvalue_stars", """SELECT CASE WHEN p < 0 THEN '#' WHEN p > 0.05 THEN '' WHEN p > 0.01 THEN '*' WHEN p > 0.001 THEN '**'
  WHEN p > 0.0001 THEN '***' ELSE '****' END AS stars, count(*) AS n FROM (SELECT pow(value / 500.0::DOUBLE, 2) - 0.0000001 AS p FROM events) GROUP BY 1""")
def stars(spark, sf):
    p = F.pow(F.col("value") / 500.0, F.lit(2.0)) - 0.0000001
    return V.table(spark, sf, "events").groupBy(S.pvalue_stars(p).alias("stars")).agg(F.count("*").alias("n"))


@query("extract_numbers", """SELECT page_id, len(x) AS n, round(list_sum(x), 4) AS total FROM (
  SELECT page_id, list_transform(regexp_extract_all(regexp_replace(html, '[0-9]{12,}', '', 'g'), '-?[0-9]+(?:\\.[0-9]+)?'), lambda v: TRY_CAST(v AS DOUBLE)) AS x FROM pages)""")
def numbers(spark, sf):
    x = S.extract_numbers(F.regexp_replace("html", "[0-9]{12,}", ""))
    p = V.table(spark, sf, "pages").select("page_id", x.alias("x"))
    total = F.when(F.size("x") > 0, F.aggregate("x", F.lit(0.0), lambda a, v: a + v))
    return p.select("page_id", F.size("x").cast("bigint").alias("n"), F.round(total, 4).alias("total"))


@query("parse_list", """SELECT l_orderkey, l_linenumber, l_partkey, len(x) AS n, x[1] AS first, x[-1] AS last FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, [l_quantity, l_discount, l_tax] AS x FROM lineitem)""")
def lists(spark, sf):
    text = F.concat_ws(";", "l_quantity", "l_discount", "l_tax")
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.parse_list(text, ";").alias("x"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.size("x").cast("bigint").alias("n"),
        F.element_at("x", 1).alias("first"), F.element_at("x", -1).alias("last"),
    )
