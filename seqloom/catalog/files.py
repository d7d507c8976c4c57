"""Queries of sources, sinks and streams. Files are written from the given tables
into the shared folder and read back."""

from pyspark.sql import functions as F

from seqloom import bindings as V, constants as K
from seqloom.catalog.filters import LABELLED, labelled  # noqa: F401
from seqloom.catalog.registry import query
from seqloom.catalog.scalars import charge_sql
from seqloom.operators.storage import scratch_path
from seqloom.sources import readers as R, writers as W
from seqloom.streaming import jobs as N


@query("read_table", V.with_views(V.SEQS, body="SELECT doc_id::VARCHAR AS doc_id, nullif(sequence, '') AS sequence FROM v_seq"))
def read_table(spark, sf):
    path = scratch_path(spark, "table")
    W.write_csv(V.seqs(spark, sf), path)
    return R.read_table(spark, path)


@query("resolve_columns", """SELECT 'seq_' || row_number() OVER (ORDER BY doc_id) AS sequence_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence, doc_id FROM documents""")
def resolve(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "").alias("peptide"))
    return R.resolve_columns(d, order=["doc_id"]).drop("peptide")


@query("fasta_round_trip", V.with_views(V.SEQS, body="""SELECT 'seq_' || (row_number() OVER (ORDER BY doc_id) - 1) || '|len=' || length(sequence) AS sequence_id, sequence FROM v_seq"""))
def fasta(spark, sf):
    path = scratch_path(spark, "fasta")
    W.write_fasta(V.seqs(spark, sf), path, ["doc_id"])
    return R.read_fasta(spark, path).select("sequence_id", "sequence")


@query("paired_fasta", V.with_views(V.PAIRS, body="""SELECT pair_id || '_VH' AS sequence_id, input_sequence AS sequence FROM v_pair UNION ALL SELECT pair_id || '_VL', generated_sequence FROM v_pair"""))
def paired_fasta(spark, sf):
    path = scratch_path(spark, "paired")
    W.write_paired_fasta(V.pairs(spark, sf), path, "pair_id", "input_sequence", "generated_sequence")
    return R.read_fasta(spark, path).select("sequence_id", "sequence")


@query("write_csv", "SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders")
def write_csv(spark, sf):
    path = scratch_path(spark, "csv")
    n = W.write_csv(V.table(spark, sf, "orders"), path, ["o_orderkey", "o_custkey", "o_totalprice"])
    back = R.read_table(spark, path, "o_orderkey bigint, o_custkey bigint, o_totalprice double")
    return back.agg(F.lit(n).cast("bigint").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("write_delimited", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def write_delimited(spark, sf):
    path = scratch_path(spark, "delim") + ".tsv"
    W.write_delimited(V.table(spark, sf, "supplier"), path, ["s_suppkey"], ["s_suppkey", "s_name", "s_acctbal"])
    return R.read_table(spark, path, "s_suppkey bigint, s_name string, s_acctbal double")


@query("paired_repertoire", V.with_views(V.SEQS, body="SELECT doc_id::VARCHAR AS doc, lang AS locus_heavy, sequence AS sequence_alignment_aa_heavy FROM v_seq JOIN documents USING (doc_id)"))
def repertoire(spark, sf):
    """Several gzip files, each with a metadata line and a header line, made from the documents."""
    path = scratch_path(spark, "repertoire")
    d = V.seqs(spark, sf).join(V.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    units = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = d.repartition(units).select(F.concat_ws(",", "doc_id", F.concat(F.lit('"'), F.col("sequence"), F.lit('"')), "lang").alias("line"))
    numbered = body.withColumn("p", F.spark_partition_id())
    heads = numbered.select("p").distinct().select("p", F.explode(F.array(
        F.struct(F.lit(0).alias("o"), F.lit('"{""Run"": 1}"').alias("line")), F.struct(F.lit(1).alias("o"), F.lit("doc,sequence_alignment_aa_heavy,locus_heavy").alias("line"))
    )).alias("h"))
    rows = numbered.select("p", F.lit(2).alias("o"), "line").union(heads.select("p", "h.o", "h.line"))
    rows.repartition(units, "p").sortWithinPartitions("p", "o").select("line", F.col("p").alias("unit")).write.partitionBy("unit").option("compression", "gzip").text(path)
    return R.read_paired_repertoire(spark, path, ["doc", "locus_heavy", "sequence_alignment_aa_heavy"]).drop("name")


@query("list_sources", "SELECT DISTINCT 'src' || lang AS species, CASE WHEN lang < 'es' THEN 'heavy' ELSE 'light' END AS chain FROM documents WHERE lang <> 'fr'")
def list_sources(spark, sf):
    path = scratch_path(spark, "species")
    d = V.table(spark, sf, "documents").select(
        F.when(F.col("lang") == "fr", "human").otherwise(F.concat(F.lit("src"), F.col("lang"))).alias("dir"), "doc_id", "lang"
    )
    for chain, rows in (("heavy", d.where("lang < 'es'")), ("light", d.where("lang >= 'es'"))):
        rows.select("dir", "doc_id").repartition("dir").write.mode("append").partitionBy("dir").csv(f"{path}/{chain}")
    files = R.list_sources(spark, path, pattern="*.csv*")
    tagged = files.select(F.regexp_replace("species", "^dir=", "").alias("species"), F.regexp_extract("path", r"/(heavy|light)/", 1).alias("chain"))
    return tagged.where("species <> 'human'").distinct()


@query("read_capped", "SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5")
def read_capped(spark, sf):
    return R.capped(V.table(spark, sf, "documents").select("source", "doc_id"), "source", ["doc_id"], 5)


@query("save_snapshot", V.with_views(V.PEPTIDES, body="SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS snapshot_id, p_partkey, sequence FROM v_pep"))
def snapshot(spark, sf):
    path = scratch_path(spark, "snapshot")
    p = V.peptides(spark, sf).select("p_partkey", "sequence")
    W.save_snapshot(p, path, ["p_partkey"])
    return W.save_snapshot(p.limit(0), path, ["p_partkey"])


@query("read_keyed", "SELECT conv_id::VARCHAR AS conv_id, arg_max(role, turn) AS role, arg_max(length(text), turn)::DOUBLE AS n FROM conversations GROUP BY 1")
def read_keyed(spark, sf):
    path = scratch_path(spark, "keyed")
    W.write_csv(V.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n")), path)
    return R.read_keyed(spark, path, "conv_id", order="turn", numbers=["n"]).drop("turn")


@query("write_report")
def write_report(spark, sf):
    path = scratch_path(spark, "report")
    d = V.table(spark, sf, "documents")
    parts = {"langs": d.groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean")), "sources": d.groupBy("source").agg(F.count("*").alias("n"))}
    W.write_report(path, parts)
    return spark.read.text(f"{path}/markdown/*").union(spark.read.text(f"{path}/json"))


@query("read_blocks", "SELECT event_id::VARCHAR AS record, event_type AS kind, CAST(props->>'$.k' AS DOUBLE) AS k, value, event_id % 2 = 0 AS flag FROM events")
def read_blocks(spark, sf):
    path = scratch_path(spark, "blocks")
    e = V.table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    flag = F.when(F.col("event_id") % 2 == 0, "YES").otherwise("no")
    e.select(F.concat(
        F.lit("REC "), F.col("event_id"), F.lit("\nkind "), F.col("event_type"), F.lit("\nvalues K "), k, F.lit(" 0 , V "), F.col("value"), F.lit("\n\nflag "), flag
    ).alias("value")).write.text(path)
    b = R.read_blocks(spark, path, "REC ")
    v = R.parse_value_line(F.col("entries")["values"])
    return b.select(
        "record", F.col("entries")["kind"].alias("kind"), v["K"][0].alias("k"), v["V"][0].alias("value"), (F.col("entries")["flag"] == "true").alias("flag")
    )


def file_stream(spark, sf, name, files=1):
    """`files` a batch; None reads all there are in one, as a watermark needs whose files overlap in time."""
    reader = spark.readStream.schema(spark.read.parquet(f"{sf}/{name}.parquet").schema)
    return (reader if files is None else reader.option("maxFilesPerTrigger", files)).parquet(f"{sf}/{name}.parque[t]")


@query("incremental_scoring", V.with_views(V.SEQS, body=f"""SELECT doc_id, round(1 / (1 + exp(-({charge_sql(7.4)}))), 6) AS charge_score FROM v_seq"""))
def incremental_scoring(spark, sf):
    path = scratch_path(spark, "scores")
    s = file_stream(spark, sf, "documents").select("doc_id", V.residues_of(F.col("text")).alias("sequence"))
    N.incremental_scoring(s, "charge", f"{path}/table", f"{path}/checkpoint", "doc_id").awaitTermination()
    return N.scored(spark, f"{path}/table", "doc_id").select("doc_id", F.round("charge_score", 6).alias("charge_score"))


def _windows(spark, sf, mode="update", **options):
    path = scratch_path(spark, "windows")
    e = file_stream(spark, sf, "events", None).withColumn("ts", F.col("ts").cast("timestamp"))
    N.run_to_table(N.windowed_metrics(e, "ts", "value", **options), f"{path}/table", f"{path}/checkpoint", mode).awaitTermination()
    wall = lambda c: F.unix_micros(F.from_utc_timestamp(c, F.current_timezone())).alias(c)
    keys = ["start", "end", *options.get("by", [])]
    out = N.final(spark, f"{path}/table") if mode == "complete" else N.latest(spark, f"{path}/table", keys)
    return out.select(wall("start"), wall("end"), *options.get("by", []), "n", F.round("mean", 6).alias("mean"))


HOUR = 3600000000


@query("stream_tumbling_windows", f"""SELECT epoch_us(ts) // {HOUR} * {HOUR} AS start, epoch_us(ts) // {HOUR} * {HOUR} + {HOUR} AS "end", event_type, count(*) AS n, round(avg(value), 6) AS mean
  FROM events GROUP BY ALL""")
def tumbling(spark, sf):
    return _windows(spark, sf, by=["event_type"])


@query("stream_sliding_windows", f"""SELECT s AS start, s + {HOUR} AS "end", count(*) AS n, round(avg(value), 6) AS mean FROM (
  SELECT value, unnest([epoch_us(ts) // ({HOUR} // 2) * ({HOUR} // 2), epoch_us(ts) // ({HOUR} // 2) * ({HOUR} // 2) - {HOUR} // 2]) AS s FROM events) GROUP BY ALL""")
def sliding(spark, sf):
    return _windows(spark, sf, slide="30 minutes")


@query("stream_session_windows", f"""WITH l AS (SELECT user_id, value, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= {2 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS k FROM l)
SELECT min(t) AS start, max(t) + {2 * HOUR} AS "end", user_id, count(*) AS n, round(avg(value), 6) AS mean FROM s GROUP BY user_id, k""")
def sessions(spark, sf):
    """All sessions of the stored table, those still open at its end too."""
    return _windows(spark, sf, "complete", by=["user_id"], gap="2 hours")


@query("stream_quality_counters", f"""SELECT source, CASE WHEN n_chars < 500 THEN 'too short' WHEN lang <> 'en' THEN 'wrong type' ELSE 'ok' END AS reason, count(*) AS n FROM documents GROUP BY ALL""")
def counters(spark, sf):
    path = scratch_path(spark, "counters")
    reason = F.when(F.col("n_chars") < 500, "too short").when(F.col("lang") != "en", "wrong type")
    q = N.quality_counters(file_stream(spark, sf, "documents"), "source", reason)
    N.run_to_table(q, f"{path}/table", f"{path}/checkpoint", "update").awaitTermination()
    return N.latest(spark, f"{path}/table", ["source", "reason"])
