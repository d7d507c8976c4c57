"""Queries of sets, sorts and top-k."""

from pyspark.sql import functions as F

from seqloom import bindings as V
from seqloom.catalog.registry import query
from seqloom.operators import sets as T

WORDS = "v_w AS (SELECT doc_id, lang, unnest(string_split_regex(lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')), ' +')) AS word FROM documents)"


def words(spark, sf):
    text = F.lower(F.regexp_replace("text", "[^A-Za-z ]", ""))
    return V.table(spark, sf, "documents").select("doc_id", "lang", F.explode(F.split(text, " +")).alias("word"))


@query("canonical_order", V.with_views(V.PEPTIDES, body="SELECT sequence, length(sequence) AS n, sha1(sequence) AS k FROM v_pep ORDER BY n, k"))
def canonical(spark, sf):
    s = T.canonical_order(V.peptides(spark, sf).select("sequence"))
    return s.select("sequence", F.length("sequence").cast("bigint").alias("n"), F.sha1("sequence").alias("k"))


@query("sort_by", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC")
def sort_by(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    return T.sort_columns(T.sort_by(o, "o_totalprice", reverse=True))


@query("top_k_hit", """SELECT vec_id, len(list_filter(embedding, lambda x: x > embedding[label + 1])) < 3 AS top3,
  len(list_filter(embedding, lambda x: x > embedding[label + 1])) < 5 AS top5 FROM embeddings""")
def top_k(spark, sf):
    e, y = F.col("embedding"), F.col("label")
    return V.table(spark, sf, "embeddings").select(
        "vec_id", T.top_k_hit(e, y, 3).alias("top3"), T.top_k_hit(e, y, 5).alias("top5")
    )


@query("first_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def first_n(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return T.first_n(p, 25, [F.col("p_retailprice").desc(), "p_partkey"])


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT p_size FROM part")
def union_distinct(spark, sf):
    frames = [("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("part", "p_size")]
    return T.union_distinct(*[V.table(spark, sf, t).select(F.col(c).alias("k")) for t, c in frames])


@query("vstack", """SELECT c_custkey AS k, c_acctbal AS v FROM customer UNION ALL SELECT o_orderkey, o_totalprice FROM orders
  WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)""")
def vstack(spark, sf):
    a = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    b = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return T.vstack(a, b, "k")


@query("intersect_all", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08 INTERSECT SELECT p_partkey FROM part WHERE p_size < 30")
def intersect_all(spark, sf):
    li = V.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "k")
    p = V.table(spark, sf, "part").where("p_size < 30").select(F.col("p_partkey").alias("k"))
    return T.intersect_all([li.where("l_quantity > 40"), li.where("l_discount > 0.08"), p], "k")


@query("except_sets", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000 EXCEPT SELECT s_suppkey FROM supplier")
def except_sets(spark, sf):
    c = V.table(spark, sf, "customer").select("c_custkey")
    sets = [V.table(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")),
            V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"))]
    return T.except_sets(c, sets, "c_custkey")


@query("membership_table", f"""WITH {WORDS} SELECT members, count(*) AS n FROM (
  SELECT word, string_agg(DISTINCT lang, ',' ORDER BY lang) AS members FROM v_w GROUP BY word) GROUP BY 1""")
def membership(spark, sf):
    return T.membership_table(words(spark, sf), "word", "lang")


@query("drop_duplicates_first", "SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, sha1(text) AS k FROM documents GROUP BY text")
def drop_first(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "source", F.sha1("text").alias("k"))
    return T.drop_duplicates(d, ["k"], ["doc_id"])


@query("drop_duplicates_last", "SELECT max(doc_id) AS doc_id, arg_max(source, doc_id) AS source, sha1(text) AS k FROM documents GROUP BY text")
def drop_last(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", "source", F.sha1("text").alias("k"))
    return T.drop_duplicates(d, ["k"], ["doc_id"], keep="last")
