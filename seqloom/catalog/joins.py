"""Queries of joins."""

from pyspark.sql import functions as F

from seqloom import bindings as V
from seqloom.catalog.filters import LABELLED, labelled
from seqloom.catalog.registry import query
from seqloom.functions.sequences import region_of
from seqloom.operators import joins as J




def short(spark, sf, name, *cols):
    return V.table(spark, sf, name).select(*cols)


@query("activity_with_master", V.with_views(V.MEASUREMENTS, body="""SELECT p_type AS combo_class, database, count(*) AS n, count(DISTINCT sequence) AS sequences
  FROM v_meas JOIN v_pep USING (p_partkey) GROUP BY ALL"""))
def activity_with_master(spark, sf):
    pep = V.peptides(spark, sf)
    m = V.measurements(spark, sf).join(pep.select("p_partkey", "sequence"), "p_partkey")
    j = J.with_master(m.drop("p_partkey"), pep.select("sequence", F.col("p_type").alias("combo_class")))
    return j.groupBy("combo_class", "database").agg(F.count("*").alias("n"), F.countDistinct("sequence").alias("sequences"))


@query("attach_cluster", """SELECT CAST(p_partkey AS VARCHAR) AS sequence, CASE WHEN p_size > 10 THEN p_brand ELSE CAST(p_partkey AS VARCHAR) END AS cluster_id FROM part""")
def attach_cluster(spark, sf):
    p = short(spark, sf, "part", F.col("p_partkey").cast("string").alias("sequence"), "p_brand", "p_size")
    clusters = p.where("p_size > 10").select("sequence", F.col("p_brand").alias("cluster_id"))
    return J.attach_cluster(p.select("sequence"), clusters)


@query("exclude", """SELECT p_partkey AS sequence, p_brand AS cluster_id FROM part p WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50 AND p_type = 'PROMO')
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50)
  AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_discount = 0.1)""")
def exclude(spark, sf):
    p, li = V.table(spark, sf, "part"), V.table(spark, sf, "lineitem")
    pool = p.select(F.col("p_partkey").alias("sequence"), F.col("p_brand").alias("cluster_id"))
    held = p.where("p_size = 50 and p_type = 'PROMO'").select(F.col("p_brand").alias("cluster_id"))
    sets = [li.where(c).select(F.col("l_partkey").alias("sequence")) for c in ("l_quantity = 50", "l_discount = 0.1")]
    return J.exclude(pool, held, sets)


@query("sample_with_parent", """SELECT s.conv_id, s.turn, length(s.text) AS n, length(p.text) AS parent_n FROM conversations s
  JOIN conversations p ON p.conv_id = s.conv_id AND p.turn = 0 WHERE s.turn > 0""")
def sample_with_parent(spark, sf):
    c = V.table(spark, sf, "conversations")
    base = F.concat(F.lit("c"), F.col("conv_id"))
    name = F.when(F.col("turn") == 0, base).otherwise(F.concat(base, F.lit("_human_sample_"), F.col("turn")))
    t = c.select("conv_id", "turn", name.alias("name"), F.length("text").cast("bigint").alias("n"))
    j = J.sample_with_parent(t.where("turn > 0"), t.where("turn = 0").select("name", "n"))
    return j.select("conv_id", "turn", "n", "parent_n")


@query("variant_table", """SELECT a.conv_id || '_' || a.turn AS variant_name, a.text AS variant_sequence, coalesce(u.text, '') AS seed_sequence,
  'Temp0.8_Seed7' AS subgroup, 0.8::DOUBLE AS temperature FROM conversations a
  LEFT JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 AND u.role = 'user' WHERE a.role = 'assistant'""")
def variant_table(spark, sf):
    c = V.table(spark, sf, "conversations")
    name = lambda shift: F.concat(F.col("conv_id"), F.lit("_"), F.col("turn") + shift)
    gen = c.where("role = 'assistant'").select(
        name(0).alias("variant_name"), F.col("text").alias("variant_sequence"), name(-1).alias("seed_name")
    )
    seeds = c.where("role = 'user'").select(name(0).alias("name"), F.col("text").alias("sequence"))
    return J.variant_table(gen, seeds, "seed_name", {"subgroup": "Temp0.8_Seed7", "temperature": 0.8}).drop("seed_name")


@query("score_cache", """WITH cache AS (SELECT text AS seq, arg_max(quality, doc_id) AS score FROM documents JOIN labels USING (doc_id) GROUP BY text),
pending AS (SELECT doc_id, text FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels y WHERE y.doc_id = d.doc_id AND toxic = 1))
SELECT doc_id, score, score IS NOT NULL AS filled FROM pending p LEFT JOIN cache c ON c.seq = p.text""")
def score_cache(spark, sf):
    d, y = short(spark, sf, "documents", "doc_id", "text"), V.table(spark, sf, "labels")
    rows = d.join(y, "doc_id").select(F.col("text").alias("seq"), F.col("quality").alias("score"), F.col("doc_id").alias("at"))
    cache = J.upsert_cache(rows.limit(0), rows, "at")
    filled, rest = J.fill_from_cache(d, y.where("toxic = 1"), cache, "doc_id", ["text"], "score")
    return filled.select("doc_id", F.col("text_score").alias("score"), F.lit(True).alias("filled")).union(
        rest.select("doc_id", F.lit(None).cast("int"), F.lit(False))
    )


@query("hstack", """SELECT c_custkey, c_name, c_acctbal AS acctbal, s_name, s_acctbal AS acctbal_2 FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def hstack(spark, sf):
    # There are fewer suppliers than customers, so most left keys have no partner.
    right = short(spark, sf, "supplier", F.col("s_suppkey").alias("c_custkey"), "s_name", F.col("s_acctbal").alias("acctbal"))
    return J.hstack(short(spark, sf, "customer", "c_custkey", "c_name", F.col("c_acctbal").alias("acctbal")), right, ["c_custkey"])


@query("zip_columns", """SELECT a.o_orderkey, b.l_orderkey, b.l_linenumber FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders) a
  FULL JOIN (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_partkey, l_linenumber) AS r FROM lineitem) b USING (r)""")
def zip_columns(spark, sf):
    a = short(spark, sf, "orders", "o_orderkey", "o_totalprice")
    b = short(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    z = J.zip_columns(a, b, ["o_totalprice", "o_orderkey"], ["l_extendedprice", "l_orderkey", "l_partkey", "l_linenumber"])
    return z.select("o_orderkey", "l_orderkey", "l_linenumber")


@query("merge_on", """SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (
  SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def merge_on(spark, sf):
    c = short(spark, sf, "customer", "c_custkey", "c_name")
    o = short(spark, sf, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return J.merge_on(c, o, "c_custkey", "o_custkey", "o_orderkey")


@query("merge_on_ignore_case", """SELECT s_suppkey, n_regionkey FROM supplier LEFT JOIN nation ON lower('nation_' || s_nationkey) = lower(n_name)""")
def merge_ci(spark, sf):
    s = short(spark, sf, "supplier", "s_suppkey", F.concat(F.lit("nation_"), F.col("s_nationkey")).alias("label"))
    n = short(spark, sf, "nation", "n_name", "n_regionkey")
    return J.merge_on(s, n, "label", "n_name", "n_regionkey", ignore_case=True).select("s_suppkey", "n_regionkey")


@query("nearest_join", """WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS k FROM events WHERE event_type = 'purchase'),
b AS (SELECT event_id AS near_id, user_id, epoch_us(ts) AS k FROM events WHERE event_type = 'view'),
j AS (SELECT a.event_id, a.user_id, a.k, (SELECT max((b.k, b.near_id)) FROM b WHERE b.user_id = a.user_id AND b.k <= a.k) AS lo,
  (SELECT min((b.k, b.near_id)) FROM b WHERE b.user_id = a.user_id AND b.k > a.k) AS hi FROM a)
SELECT user_id, event_id, CASE WHEN hi IS NULL OR k - lo[1] <= hi[1] - k THEN lo[2] ELSE hi[2] END AS near_id FROM j""")
def nearest(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_id", "event_type", V.micros("ts").alias("k"))
    a = e.where("event_type = 'purchase'")
    b = e.where("event_type = 'view'").withColumnRenamed("event_id", "near_id")
    return J.nearest_join(a, b, "k", "event_id", "near_id", ["user_id"]).select("user_id", "event_id", "near_id")


@query("cross_pairs", "SELECT p_partkey, n_name, p_size * n_regionkey AS score FROM part, nation")
def cross_pairs(spark, sf):
    p, n = short(spark, sf, "part", "p_partkey", "p_size"), short(spark, sf, "nation", "n_name", "n_regionkey")
    return J.product(p, n, 4).select("p_partkey", "n_name", (F.col("p_size") * F.col("n_regionkey")).alias("score"))


THREE = """v_three AS (SELECT a.name, a.aligned AS parental, lead(aligned, 1) OVER w AS predicted, lead(aligned, 2) OVER w AS germline
  FROM v_aln a WINDOW w AS (PARTITION BY doc_id ORDER BY frag)),
v_p3 AS (SELECT name, pos, parental[pos] AS parental, predicted[pos] AS predicted, germline[pos] AS germline
  FROM v_three, (SELECT unnest(range(1, 41)) AS pos) WHERE germline IS NOT NULL)"""


def three_fragments(spark, sf):
    """A fragment as parental, its two successors as predicted and germline, by key joins."""
    a = V.aligned(spark, sf)
    shifted = lambda k: a.select("doc_id", (F.col("frag") - k).alias("frag"), "aligned")
    parent = a.select("doc_id", "frag", "aligned")
    return J.position_join({"parental": parent, "predicted": shifted(1), "germline": shifted(2)}, ["doc_id", "frag"])


@query("position_join", V.with_views(V.ALIGNED, THREE, body="""SELECT pos, count(*) AS n, count(*) FILTER (WHERE parental = predicted) AS same,
  count(*) FILTER (WHERE predicted = germline) AS germ FROM v_p3 GROUP BY pos"""))
def position_join(spark, sf):
    return three_fragments(spark, sf).groupBy("pos").agg(
        F.count("*").alias("n"), F.count_if(F.col("parental") == F.col("predicted")).alias("same"),
        F.count_if(F.col("predicted") == F.col("germline")).alias("germ"),
    )


@query("route_by_type", """SELECT d.doc_id, lang, CASE lang WHEN 'en' THEN y.quality * 2 WHEN 'fr' THEN y.toxic END AS score FROM documents d LEFT JOIN labels y USING (doc_id)""")
def route(spark, sf):
    y = V.table(spark, sf, "labels")
    tables = {"en": y.select("doc_id", (F.col("quality") * 2).alias("score")), "fr": y.select("doc_id", F.col("toxic").alias("score"))}
    return J.route_by_type(short(spark, sf, "documents", "doc_id", "lang"), tables, "lang", "doc_id")


TERMS = ["ther", "the", "tion", "ing", "ment", "other", "ion"]
LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"


@query("first_contained", f"""SELECT doc_id, list_filter({LIST}, lambda t: contains(text, t))[1] AS any_term,
  list_filter({LIST}, lambda t: ends_with(regexp_extract(text, '[a-z]*[^a-z]*$'), t || '.'))[1] AS end_term FROM documents""")
def first_contained(spark, sf):
    d = short(spark, sf, "documents", "doc_id", "text")
    any_term = J.first_contained(d, "text", TERMS).withColumnRenamed("term", "any_term")
    return J.first_contained(any_term, "text", [t + "." for t in TERMS], "ends").select(
        "doc_id", "any_term", F.regexp_replace("term", r"\.$", "").alias("end_term")
    )


@query("first_contained_longest", f"""SELECT doc_id, list_reduce(list_concat([''], {LIST}),
  lambda acc, t: CASE WHEN contains(text, t) AND (acc = '' OR NOT contains(acc, t)) THEN t ELSE acc END) AS term FROM documents""")
def longest(spark, sf):
    d = short(spark, sf, "documents", "doc_id", "text")
    return J.first_contained(d, "text", TERMS, "longest").select("doc_id", F.coalesce("term", F.lit("")).alias("term"))
