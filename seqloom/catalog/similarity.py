"""Queries of similarity, clustering and leakage control."""

from pyspark.sql import functions as F

from seqloom import bindings as V, constants as K
from seqloom.catalog.aggregates import rounded
from seqloom.catalog.joins import THREE, three_fragments
from seqloom.catalog.registry import query
from seqloom.functions.sequences import slot_codes
from seqloom.operators import clusters as C, similarity as S

MATRIX = S.matrix_from_scale(K.KYTE_DOOLITTLE)
SYM = K.RESIDUES + K.GAP


#: Longest common subsequence as a fold over the rows of the table.
LCS = """list_reduce(list_prepend(list_resize([0], length({y}) + 1, 0), list_transform(string_split({x}, ''), lambda c: [ord(c)])),
  lambda row, c: list_reduce(list_prepend([0], list_transform(range(1, length({y}) + 1), lambda j: [CASE WHEN ord({y}[j]) = c[1] THEN row[j] + 1 ELSE row[j + 1] END])),
    lambda cur, v: list_append(cur, greatest(v[1], cur[-1]))))[-1]"""
BAG = "[" + ", ".join(f"length(s) - length(replace(s, '{c}', ''))" for c in K.RESIDUES) + "]"
SHARED_LETTERS = "list_sum(list_transform(list_zip(x.bag, y.bag), lambda p: least(p[1], p[2])))"


def greedy_sql(nodes: str, t: float) -> str:
    """v_n (scope, s, id) in greedy order, v_e (a, b, identity) of similar ones and v_reps (id): one after the other, each
    joins the first representative it is similar to."""
    return f"""v_n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY length(s) DESC, sha1(s), scope) AS id FROM (SELECT DISTINCT scope, s, {BAG} AS bag FROM ({nodes}))),
v_c AS MATERIALIZED (SELECT x.id AS a, y.id AS b, x.s AS x, y.s AS y FROM v_n x JOIN v_n y ON x.scope = y.scope AND x.id < y.id AND {SHARED_LETTERS} >= {t}::DOUBLE * length(y.s) - 1e-9),
v_e AS MATERIALIZED (SELECT a, b, l / length(y) AS identity FROM (SELECT *, {LCS.format(x="x", y="y")} AS l FROM v_c) WHERE l >= {t}::DOUBLE * length(y) - 1e-9),
v_g(i, reps) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.i + 1, CASE WHEN count(e.a) = 0 THEN list_append(any_value(g.reps), g.i + 1) ELSE any_value(g.reps) END
  FROM v_g g LEFT JOIN v_e e ON e.b = g.i + 1 AND list_contains(g.reps, e.a) WHERE g.i < (SELECT count(*) FROM v_n) GROUP BY g.i),
v_reps AS (SELECT unnest(reps) AS id FROM (SELECT reps FROM v_g ORDER BY i DESC LIMIT 1))"""


def against_sql(train: str, test: str, t: float) -> str:
    """v_bad (s): training sequences that are similar to a test sequence."""
    return f"""v_tr AS MATERIALIZED (SELECT DISTINCT s, {BAG} AS bag FROM ({train})), v_te AS MATERIALIZED (SELECT DISTINCT s, {BAG} AS bag FROM ({test})),
v_tc AS MATERIALIZED (SELECT x.s AS x, y.s AS y FROM v_tr x JOIN v_te y ON {SHARED_LETTERS} >= {t}::DOUBLE * least(length(x.s), length(y.s)) - 1e-9),
v_bad AS MATERIALIZED (SELECT DISTINCT x AS s FROM (SELECT *, {LCS.format(x="x", y="y")} AS l FROM v_tc) WHERE x = y OR l >= {t}::DOUBLE * least(length(x), length(y)) - 1e-9)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query("cluster_by_identity", recursive(V.with_views(V.PEPTIDES, greedy_sql("SELECT '' AS scope, sequence AS s FROM v_pep", 0.8), body="""
, v_first AS (SELECT b AS id, min(a) AS rep FROM v_e WHERE a IN (SELECT id FROM v_reps) AND b NOT IN (SELECT id FROM v_reps) GROUP BY b UNION ALL SELECT id, id FROM v_reps)
SELECT n.s AS sequence, sha1(r.s) AS cluster_id, r.s AS rep, round(coalesce(identity, 1), 6) AS identity, n.id = r.id AS is_rep
FROM v_first f JOIN v_n n ON n.id = f.id JOIN v_n r ON r.id = f.rep LEFT JOIN v_e e ON e.a = f.rep AND e.b = f.id""")))
def cluster_by_identity(spark, sf):
    c = S.cluster_by_identity(V.peptides(spark, sf), 0.8)
    return c.select("sequence", "cluster_id", "rep", F.round("identity", 6).alias("identity"), "is_rep")


@query("representatives", recursive(V.with_views(V.PEPTIDES, greedy_sql("SELECT '' AS scope, sequence AS s FROM v_pep", 0.9), body="SELECT s AS sequence FROM v_n JOIN v_reps USING (id)")))
def representatives(spark, sf):
    return S.representatives(V.peptides(spark, sf), 0.9)


def benchmark(spark, sf):
    return V.table(spark, sf, "benchmark").select("item_id", V.residues_of(F.col("text")).alias("sequence"))


TRAIN, TEST = "SELECT sequence AS s FROM v_pep WHERE p_type <> 'PROMO'", "SELECT sequence AS s FROM v_pep WHERE p_type = 'PROMO'"


@query("filter_against", V.with_views(V.PEPTIDES, against_sql(TRAIN, TEST, 0.8), body="SELECT p_partkey, sequence FROM v_pep WHERE p_type <> 'PROMO' AND sequence NOT IN (SELECT s FROM v_bad)"))
def filter_against(spark, sf):
    p = V.peptides(spark, sf)
    return S.filter_against(p.where("p_type <> 'PROMO'").select("p_partkey", "sequence"), p.where("p_type = 'PROMO'"), 0.8)


SHARED = V.SEQS + ",\n" + V.MOTIFS.replace("v_word AS", "v_bench AS (SELECT item_id, " + V.residues_sql("text") + " AS s FROM benchmark),\nv_word AS", 1) + """,
v_bk AS (SELECT DISTINCT substr(s, i, 12) AS w FROM (SELECT s, unnest(range(1, length(s) - 10)) AS i FROM v_bench WHERE length(s) >= 12)),
v_dk AS (SELECT doc_id, substr(sequence, i, 12) AS w FROM (SELECT doc_id, sequence, unnest(range(1, length(sequence) - 10)) AS i FROM v_seq WHERE length(sequence) >= 12)),
v_leak AS (SELECT DISTINCT doc_id FROM v_dk JOIN v_bk USING (w))"""


@query("shares_word", V.with_views(SHARED, body="SELECT doc_id FROM v_leak"))
def shares_word(spark, sf):
    return S.shares_word(V.seqs(spark, sf), benchmark(spark, sf), 12, "doc_id")


@query("leakage_counts", V.with_views(SHARED, body="""SELECT lang, count(*) AS before, count(DISTINCT text) AS after_internal,
  count(DISTINCT text) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM v_leak)) AS after_train_vs_test FROM documents GROUP BY lang"""))
def leakage_counts(spark, sf):
    leak = S.shares_word(V.seqs(spark, sf), benchmark(spark, sf), 12, "doc_id").withColumn("leak", F.lit(True))
    d = V.table(spark, sf, "documents").select("doc_id", "lang", F.xxhash64("text").alias("h"), F.sha1("text").alias("k"))
    return d.join(leak, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("before"), F.countDistinct("k").alias("after_internal"),
        F.countDistinct(F.when(F.col("leak").isNull(), F.col("k"))).alias("after_train_vs_test"),
    )


@query("filter_training", recursive(V.with_views(
    V.PEPTIDES, greedy_sql("SELECT p_type AS scope, sequence AS s FROM v_pep WHERE p_type <> 'PROMO'", 0.9), against_sql(TRAIN, TEST, 0.8), body="""
SELECT scope AS p_type, count(*) AS before, count(*) FILTER (WHERE id IN (SELECT id FROM v_reps)) AS after_internal,
  count(*) FILTER (WHERE id IN (SELECT id FROM v_reps) AND s NOT IN (SELECT s FROM v_bad)) AS after_train_vs_test FROM v_n GROUP BY scope""")))
def filter_training(spark, sf):
    p = V.peptides(spark, sf)
    return S.filter_training(p.where("p_type <> 'PROMO'"), p.where("p_type = 'PROMO'"), 0.9, 0.8, by="p_type")[1]


@query("novelty")
def novelty(spark, sf):
    n = S.novelty(benchmark(spark, sf), V.seqs(spark, sf), "item_id")
    return n.select("item_id", F.round("novelty", 6).alias("novelty"))


@query("word_size", "SELECT DISTINCT l_discount AS t, CASE WHEN l_discount * 10 >= 0.7 THEN 5 WHEN l_discount * 10 >= 0.6 THEN 4 WHEN l_discount * 10 >= 0.5 THEN 3 ELSE 2 END AS k FROM lineitem")
def word_size(spark, sf):
    d = F.col("t") * 10
    t = V.table(spark, sf, "lineitem").select(F.col("l_discount").alias("t")).distinct()
    cuts = [x for x in (0.7, 0.6, 0.5)]
    out = F.when(d >= cuts[0], S.word_size(cuts[0])).when(d >= cuts[1], S.word_size(cuts[1])).when(d >= cuts[2], S.word_size(cuts[2]))
    return t.select("t", out.otherwise(S.word_size(0.0)).alias("k"))


NEXT = """v_next AS (SELECT a.name, a.aligned AS a, b.aligned AS b FROM v_aln a JOIN v_aln b ON a.doc_id = b.doc_id AND b.frag = a.frag + 1),
v_np AS (SELECT name, a, b, a[p] AS x, b[p] AS y FROM v_next, (SELECT unnest(range(1, 41)) AS p))"""


def next_fragments(spark, sf):
    a = V.aligned(spark, sf)
    b = a.select("doc_id", (F.col("frag") - 1).alias("frag"), F.col("aligned").alias("b"))
    return a.join(b, ["doc_id", "frag"]).select("name", F.col("aligned").alias("a"), "b")


@query("aligned_identity", V.with_views(V.ALIGNED, NEXT, body="""SELECT name, round(100.0 * count(*) FILTER (WHERE x = y AND x <> '-') / nullif(count(*) FILTER (WHERE NOT (x = '-' AND y = '-')), 0), 6) AS identity,
  round(100.0 * (count(*) FILTER (WHERE x = y AND x <> '-') + count(*) FILTER (WHERE (x = '-') <> (y = '-'))) / nullif(count(*) FILTER (WHERE NOT (x = '-' AND y = '-')), 0), 6) AS gap_one,
  round(100.0 * count(*) FILTER (WHERE x = y AND x <> '-') / least(count(*) FILTER (WHERE x <> '-'), count(*) FILTER (WHERE y <> '-')), 6) AS over_shorter FROM v_np GROUP BY name"""))
def aligned_identity(spark, sf):
    a, b = F.col("a"), F.col("b")
    return rounded(next_fragments(spark, sf).select(
        "name", S.aligned_identity(a, b).alias("identity"), S.aligned_identity(a, b, 1.0).alias("gap_one"), S.aligned_identity(a, b, over="shorter").alias("over_shorter")
    ))


REFS = f"v_ref AS (SELECT n_nationkey, rpad({V.residues_sql('n_name')}, 40, '-') AS r FROM nation)"


def references(spark, sf):
    return V.table(spark, sf, "nation").select("n_nationkey", F.rpad(V.residues_of(F.col("n_name")), 40, "-").alias("aligned"))


def labels40(spark, sf):
    """Customer names as aligned rows of 40 columns, for comparisons against the reference set."""
    c = V.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.col("c_name"), F.col("c_mktsegment")).alias("s"))
    return c.select("k", F.rpad(V.residues_of(F.col("s")), 40, "-").alias("aligned"))


LABELS = f"v_l40 AS (SELECT c_custkey AS k, rpad({V.residues_sql('c_name || c_mktsegment')}, 40, '-') AS a FROM customer)"
CROSS = """v_x AS (SELECT k, n_nationkey, a[p] AS x, r[p] AS y FROM v_l40, v_ref, (SELECT unnest(range(1, 41)) AS p))"""


NAMES = f"""v_name AS (SELECT 'customer' AS kind, c_custkey AS k, {V.residues_sql('c_name || c_mktsegment')} AS s FROM customer
  UNION ALL SELECT 'supplier', s_suppkey, {V.residues_sql('s_name')} FROM supplier),
v_nation AS (SELECT n_nationkey, {V.residues_sql('n_name')} AS r FROM nation),
v_wide AS (SELECT greatest(40, (SELECT max(length(s)) FROM v_name), (SELECT max(length(r)) FROM v_nation))::INTEGER AS w),
v_nx AS (SELECT kind, k, n_nationkey, rpad(s, w, '-')[p] AS x, rpad(r, w, '-')[p] AS y FROM v_name, v_nation, (SELECT w, unnest(range(1, w + 1)) AS p FROM v_wide))"""


def whole_names(spark, sf):
    """Names of customers and suppliers, all their letters; `key` holds the kind, as both tables count from the same number."""
    row = lambda table, kind, key, *name: V.table(spark, sf, table).select(
        F.struct(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("k")).alias("key"), V.residues_of(F.concat(*name)).alias("aligned")
    )
    return row("customer", "customer", "c_custkey", "c_name", "c_mktsegment").union(row("supplier", "supplier", "s_suppkey", "s_name"))


@query("identity_to_references", V.with_views(NAMES, body="""SELECT kind, k, n_nationkey, round(100.0 * count(*) FILTER (WHERE x = y AND x <> '-') / nullif(count(*) FILTER (WHERE NOT (x = '-' AND y = '-')), 0), 6) AS identity
  FROM v_nx GROUP BY ALL"""))
def identity_to_references(spark, sf):
    nations = V.table(spark, sf, "nation").select("n_nationkey", V.residues_of(F.col("n_name")).alias("aligned"))

    def identity(a, b):
        # Columns with two gaps do not count, so each pair is as wide as its longer text.
        wide = F.greatest(F.length(a), F.length(b))
        return S.aligned_identity(F.rpad(a, wide, "-"), F.rpad(b, wide, "-"))

    out = S.pairwise(whole_names(spark, sf), nations, identity, "key", "n_nationkey", name="identity")
    return rounded(out.select("key.kind", "key.k", "n_nationkey", "identity"))


SUPPLIERS = f"v_sup AS (SELECT s_suppkey, rpad(residues, 40, '-') AS a FROM (SELECT s_suppkey, {V.residues_sql('s_name || s_suppkey')} || translate(CAST(s_suppkey AS VARCHAR), '0123456789', 'ACDEFGHIKL') AS residues FROM supplier))"


@query("identity_matrix", V.with_views(SUPPLIERS, body="""SELECT s_suppkey, s_suppkey_b, round(100.0 * count(*) FILTER (WHERE x = y AND x <> '-') / nullif(count(*) FILTER (WHERE NOT (x = '-' AND y = '-')), 0), 6) AS identity
  FROM (SELECT l.s_suppkey, r.s_suppkey AS s_suppkey_b, l.a[p] AS x, r.a[p] AS y FROM v_sup l JOIN v_sup r ON l.s_suppkey <= r.s_suppkey, (SELECT unnest(range(1, 41)) AS p)) GROUP BY ALL"""))
def identity_matrix(spark, sf):
    digits = F.translate(F.col("s_suppkey").cast("string"), "0123456789", "ACDEFGHIKL")
    rows = V.table(spark, sf, "supplier").select("s_suppkey", F.rpad(F.concat(V.residues_of(F.concat("s_name", "s_suppkey")), digits), 40, "-").alias("aligned"))
    return S.identity_matrix(rows, "s_suppkey", digits=6)


@query("pairwise", V.with_views(LABELS, REFS, body="SELECT k, n_nationkey, levenshtein(replace(a, '-', ''), replace(r, '-', '')) AS edits FROM v_l40, v_ref"))
def pairwise(spark, sf):
    bare = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    return S.pairwise(labels40(spark, sf), references(spark, sf), lambda a, b: F.levenshtein(bare(a), bare(b)), "k", "n_nationkey", name="edits")


SEGS = ", ".join(f"({i}, substr(t, {8 * i + 1}, 8))" for i in range(5))


@query("similar_pairs", V.with_views(V.ALIGNED, f"""tx AS (SELECT aligned AS t, count(*) AS n FROM v_aln GROUP BY 1),
sg AS (SELECT t, n, i, substr(t, 8 * i + 1, 8) AS s FROM tx, (SELECT unnest(range(5)) AS i)),
pr AS (SELECT DISTINCT l.t AS a, r.t AS b, l.n AS n_a, r.n AS n_b FROM sg l JOIN sg r ON l.i = r.i AND l.s = r.s AND l.t < r.t)""",
    body="SELECT a, b, n_a, n_b, hamming(a, b) AS mutations FROM pr WHERE hamming(a, b) <= 4"))
def similar_pairs(spark, sf):
    return S.similar_pairs(V.aligned(spark, sf), 4)


@query("n_mutations", V.with_views(V.ALIGNED, NEXT, body="SELECT name, count(*) FILTER (WHERE x <> y) AS mutations FROM v_np GROUP BY name"))
def n_mutations(spark, sf):
    return next_fragments(spark, sf).select("name", S.n_mutations(F.col("a"), F.col("b")).alias("mutations"))


def dist_sql(x, y):
    kd = lambda c: f"CASE {c} " + " ".join(f"WHEN '{a}' THEN {v}::DOUBLE" for a, v in K.KYTE_DOOLITTLE.items()) + " END"
    return f"CASE WHEN {x} = {y} THEN 0 WHEN {x} = '-' OR {y} = '-' THEN 1 ELSE abs({kd(x)} - {kd(y)}) / 9 END"


@query("residue_distance", V.with_views(V.ALIGNED, NEXT, body=f"SELECT name, round(sum({dist_sql('x', 'y')}), 6) AS distance FROM v_np GROUP BY name"))
def residue_distance(spark, sf):
    return rounded(next_fragments(spark, sf).select("name", S.residue_distance(F.col("a"), F.col("b"), MATRIX).alias("distance")))


@query("distance_between", V.with_views(LABELS, REFS, CROSS, body=f"SELECT k, n_nationkey, round(sum({dist_sql('x', 'y')}), 6) AS distance FROM v_x GROUP BY ALL"))
def distance_between(spark, sf):
    return rounded(S.distance_between(labels40(spark, sf), references(spark, sf), MATRIX, "k", "n_nationkey"))


@query("nearest_by_distance", V.with_views(LABELS, REFS, CROSS, body=f"""SELECT k, n_nationkey, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY distance, n_nationkey) AS rank FROM (SELECT k, n_nationkey, round(sum({dist_sql('x', 'y')}), 9) AS distance FROM v_x GROUP BY ALL)) WHERE rank <= 3"""))
def nearest_by_distance(spark, sf):
    near = S.nearest_by_distance(labels40(spark, sf), references(spark, sf), MATRIX, "k", "n_nationkey", 3)
    return near.withColumn("distance", F.round("distance", 6))


CODES = slot_codes("H", "kabat_vernier")[:V.WIDTH]
SLOTS = f"(SELECT unnest(range(1, 41)) AS pos, unnest([{','.join(str(c) for c in CODES)}]) AS code) s"


@query("preservation", V.with_views(V.ALIGNED, THREE, body=f"""SELECT name, round(avg(CASE WHEN parental = predicted THEN 1.0::DOUBLE ELSE 0 END), 6) AS preserved,
  round(avg(CASE WHEN parental = predicted THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE code = 0), 6) AS framework FROM v_p3 JOIN {SLOTS} USING (pos) GROUP BY name"""))
def preservation(spark, sf):
    p = three_fragments(spark, sf)
    code = F.get(F.array(*[F.lit(c) for c in CODES]), F.col("pos").cast("int") - 1)
    out = S.preservation(p, ["doc_id", "frag"], "predicted", "parental", code)
    return rounded(out.withColumn("name", F.concat_ws("_", "doc_id", "frag")).select("name", "preserved", "framework"))


@query("mutation_precision", V.with_views(V.ALIGNED, THREE, body="""SELECT name, shared, unshared, round(shared / nullif(shared + unshared, 0), 6) AS precision FROM (
  SELECT name, count(*) FILTER (WHERE (germline <> parental OR predicted <> parental) AND germline = predicted) AS shared,
    count(*) FILTER (WHERE predicted <> parental AND germline <> predicted) AS unshared FROM v_p3 GROUP BY name)"""))
def mutation_precision(spark, sf):
    out = S.mutation_precision(three_fragments(spark, sf), ["doc_id", "frag"], "germline", "parental", "predicted")
    return rounded(out.select(F.concat_ws("_", "doc_id", "frag").alias("name"), "shared", "unshared", "precision"))


@query("annotate_conservation", V.with_views(V.ALIGNED, THREE, body="""SELECT pos, CASE WHEN parental = predicted THEN CASE WHEN parental = germline THEN 'Conserved' ELSE 'Back-mutated' END
  WHEN predicted = germline THEN 'Humanized' ELSE 'Engineered' END AS conservation, count(*) AS n FROM v_p3 GROUP BY ALL"""))
def annotate(spark, sf):
    return S.annotate_conservation(three_fragments(spark, sf)).groupBy("pos", "conservation").agg(F.count("*").alias("n"))


@query("density_clusters", """WITH RECURSIVE near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a, embeddings b WHERE list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) <= 0.9),
core AS (SELECT a FROM near GROUP BY a HAVING count(*) >= 5),
inner_pairs AS (SELECT a, b FROM near WHERE a IN (SELECT a FROM core) AND b IN (SELECT a FROM core)),
reach(a, b) AS (SELECT a, b FROM inner_pairs UNION SELECT r.a, p.b FROM reach r JOIN inner_pairs p ON r.b = p.a),
part AS (SELECT a, min(b) AS label FROM reach GROUP BY a),
ranked AS (SELECT a, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM part),
border AS (SELECT n.a, min(r.cluster) AS cluster FROM near n JOIN ranked r ON r.a = n.b GROUP BY n.a)
SELECT vec_id, coalesce(ranked.cluster, border.cluster, -1) AS cluster, ranked.a IS NOT NULL AS core
FROM embeddings LEFT JOIN ranked ON ranked.a = vec_id LEFT JOIN border ON border.a = vec_id""")
def density(spark, sf):
    return C.density_clusters(V.table(spark, sf, "embeddings"), "vec_id", "embedding", 0.9, 5)


@query("kmeans")
def kmeans(spark, sf):
    assigned, members = C.kmeans(V.table(spark, sf, "embeddings"), "vec_id", "embedding", 10, cosine=True)
    return assigned.join(members.select("cluster", "member"), "cluster")


@query("kmeans_round", """WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT label, pos, avg(e) AS m FROM (SELECT label, unnest(v) AS e, unnest(range(len(v))) AS pos FROM x) GROUP BY label, pos),
centres AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS cluster, list(m ORDER BY pos) AS c FROM c GROUP BY label),
d AS (SELECT vec_id, cluster, list_distance(v, c) AS distance FROM x, centres),
best AS (SELECT vec_id, cluster, distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, round(distance, 6) AS distance FROM best""")
def kmeans_round(spark, sf):
    """One round of Lloyd's algorithm: each vector goes to the nearest of the means of the labels."""
    e = V.table(spark, sf, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("pos", "e")).groupBy("label", "pos").agg(F.avg(F.col("e").cast("double")).alias("m"))
    centres = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c")).orderBy("label").select("c.m")
    # One row a label.
    placed = C.assign(e, "vec_id", "embedding", [r["m"] for r in centres.collect()])
    return placed.withColumn("distance", F.round("distance", 6))


@query("threshold_clusters", """WITH x AS (SELECT s_suppkey, s_acctbal / (SELECT sum(s_acctbal) FROM supplier) AS v FROM supplier),
g AS (SELECT s_suppkey, v, v - lag(v) OVER (ORDER BY v, s_suppkey) AS gap FROM x)
SELECT s_suppkey, CAST(sum(CASE WHEN gap > 0.00005::DOUBLE THEN 1 ELSE 0 END) OVER (ORDER BY v, s_suppkey) AS BIGINT) AS cluster_id FROM g""")
def threshold_clusters(spark, sf):
    return C.threshold_clusters(V.table(spark, sf, "supplier"), "s_suppkey", ["s_acctbal"], threshold=0.00005)


@query("threshold_clusters_auto", """WITH x AS (SELECT s_suppkey, s_acctbal / (SELECT sum(s_acctbal) FROM supplier) AS v FROM supplier),
d AS (SELECT avg(abs(a.v - b.v)) + -1.2::DOUBLE * stddev_samp(abs(a.v - b.v)) AS t FROM x a JOIN x b ON a.s_suppkey < b.s_suppkey),
g AS (SELECT s_suppkey, v, v - lag(v) OVER (ORDER BY v, s_suppkey) AS gap FROM x)
SELECT s_suppkey, CAST(sum(CASE WHEN gap > t THEN 1 ELSE 0 END) OVER (ORDER BY v, s_suppkey) AS BIGINT) AS cluster_id FROM g, d""")
def threshold_auto(spark, sf):
    return C.threshold_clusters(V.table(spark, sf, "supplier"), "s_suppkey", ["s_acctbal"], sigma=-1.2)


@query("threshold_clusters_strict")
def threshold_strict(spark, sf):
    s = V.table(spark, sf, "supplier").withColumn("nation", F.col("s_nationkey") + 1.0)
    return C.threshold_clusters(s, "s_suppkey", ["s_acctbal", "nation"], threshold=0.0004, strict=True)
