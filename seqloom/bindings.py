"""Views over the given tables that stand in for the sequence inputs.

Each view has a Spark form and the same definition as SQL, for the oracle queries.
Texts are always used whole: long sequences are cut into consecutive fragments, never shortened.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom import constants as K

WIDTH = 40


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "conversations", "pages") else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with rows in fewer splits than there are cores are spread over the cores before CPU-heavy work.

    A row group is never split, so a file of few row groups has most of its splits empty. A scan without columns tells
    how many hold rows; it reads footers only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    filled = df.select(F.spark_partition_id().alias("p")).distinct().count()
    return df.repartition(cores) if filled < cores else df


def micros(ts):
    """Wall-clock microseconds of a timestamp without zone, whatever the session zone is."""
    return F.unix_micros(F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone()))


def residues_of(text):
    """ASCII letters in upper case, standard residues only."""
    return F.regexp_replace(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), f"[^{K.RESIDUES}]", "")


def residues_sql(text: str) -> str:
    return (
        f"regexp_replace(upper(regexp_replace({text},'[^A-Za-z]','','g')),'[^{K.RESIDUES}]','','g')"
    )


def seqs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", residues_of(F.col("text")).alias("sequence"))


SEQS = f"v_seq AS (SELECT doc_id, {residues_sql('text')} AS sequence FROM documents)"


def aligned(spark, sf) -> DataFrame:
    """Fragments of `WIDTH` residues; a short last fragment has its gaps right on even, left on odd ones."""
    cut = seqs(spark, sf).select(
        "doc_id",
        F.posexplode(F.regexp_extract_all("sequence", F.lit(f".{{1,{WIDTH}}}"), F.lit(0))).alias("frag", "part"),
    )
    return cut.select(
        "doc_id", F.col("frag").cast("bigint").alias("frag"),
        F.concat(F.col("doc_id"), F.lit("_"), F.col("frag")).alias("name"),
        F.when(F.col("frag") % 2 == 0, F.rpad("part", WIDTH, "-")).otherwise(F.lpad("part", WIDTH, "-")).alias("aligned"),
    )


ALIGNED = SEQS + f""",
v_cut AS (SELECT doc_id, regexp_extract_all(sequence, '.{{1,{WIDTH}}}') AS parts FROM v_seq),
v_part AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts))) AS frag FROM v_cut),
v_aln AS (SELECT doc_id, frag, doc_id || '_' || frag AS name,
  CASE WHEN frag % 2 = 0 THEN rpad(part, {WIDTH}, '-') ELSE lpad(part, {WIDTH}, '-') END AS aligned FROM v_part)"""


def positions(spark, sf) -> DataFrame:
    from seqloom.functions.sequences import letters

    return aligned(spark, sf).select(
        "doc_id", "frag", "name", F.posexplode(letters(F.col("aligned"))).alias("p", "aa")
    ).select("doc_id", "frag", "name", (F.col("p") + 1).cast("bigint").alias("pos"), "aa")


POSITIONS = ALIGNED + f""",
v_pos AS (SELECT doc_id, frag, name, pos, aligned[pos] AS aa
  FROM v_aln, (SELECT unnest(range(1, {WIDTH + 1})) AS pos) p)"""


def peptides(spark, sf) -> DataFrame:
    """One short peptide per part: residues of its name, then its key written with residues."""
    p = spread(table(spark, sf, "part"))
    digits = F.translate(F.col("p_partkey").cast("string"), "0123456789", "ACDEFGHIKL")
    return p.select(
        "p_partkey", F.concat(residues_of(F.col("p_name")), digits).alias("sequence"),
        "p_brand", "p_type", "p_size", "p_retailprice",
    )


PEPTIDES = f"""v_pep AS (SELECT p_partkey, {residues_sql('p_name')} ||
  translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ACDEFGHIKL') AS sequence,
  p_brand, p_type, p_size, p_retailprice FROM part)"""


def measurements(spark, sf) -> DataFrame:
    """Activity evidence rows: one per line item, on the peptide of its part."""
    li = spread(table(spark, sf, "lineitem"))
    n = F.col("l_linenumber")
    return li.select(
        "l_orderkey", n.alias("line"), F.col("l_partkey").alias("p_partkey"),
        F.when(n == 1, " mic ").when(n == 2, "MBC").when(n == 3, "ic50").when(n == 4, "EC50")
        .when(n == 5, "LD50").when(n == 6, "MIC").otherwise("").alias("metric"),
        F.when(F.col("l_tax") < 0.03, "").when(F.col("l_tax") < 0.06, " <= ").otherwise(">").alias("comparator"),
        F.when(F.col("l_discount") < 0.005, "n/a")
        .otherwise(F.concat(F.lit(" "), (F.col("l_quantity") - 1).cast("int").cast("string"))).alias("raw_value"),
        F.when(F.col("l_returnflag") == "A", "µg/ml").when(F.col("l_returnflag") == "N", " μM")
        .otherwise(F.when(F.col("l_linestatus") == "F", "nM").otherwise("units")).alias("unit"),
        F.concat(F.lit("db"), F.col("l_suppkey") % 7).alias("database"),
    )


MEASUREMENTS = PEPTIDES + """,
v_meas AS (SELECT l_orderkey, l_linenumber AS line, l_partkey AS p_partkey,
  CASE l_linenumber WHEN 1 THEN ' mic ' WHEN 2 THEN 'MBC' WHEN 3 THEN 'ic50' WHEN 4 THEN 'EC50'
    WHEN 5 THEN 'LD50' WHEN 6 THEN 'MIC' ELSE '' END AS metric,
  CASE WHEN l_tax < 0.03 THEN '' WHEN l_tax < 0.06 THEN ' <= ' ELSE '>' END AS comparator,
  CASE WHEN l_discount < 0.005 THEN 'n/a' ELSE ' ' || CAST(CAST(l_quantity - 1 AS INTEGER) AS VARCHAR) END AS raw_value,
  CASE l_returnflag WHEN 'A' THEN 'µg/ml' WHEN 'N' THEN ' μM'
    ELSE CASE WHEN l_linestatus = 'F' THEN 'nM' ELSE 'units' END END AS unit,
  'db' || (l_suppkey % 7) AS database FROM lineitem)"""


def pairs(spark, sf) -> DataFrame:
    """Consecutive turns of a conversation as input and generated sequence."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", residues_of(F.col("text")).alias("s"))
    a = c.select("conv_id", "turn", F.col("s").alias("input_sequence"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("generated_sequence"), "role")
    return a.join(b, ["conv_id", "turn"]).select(
        F.concat(F.col("conv_id"), F.lit("_"), F.col("turn")).alias("pair_id"), "conv_id", "turn",
        "input_sequence", "generated_sequence", "role",
    )


PAIRS = f"""v_turn AS (SELECT conv_id, turn, role, {residues_sql('text')} AS s FROM conversations),
v_pair AS (SELECT a.conv_id || '_' || a.turn AS pair_id, a.conv_id, a.turn,
  a.s AS input_sequence, b.s AS generated_sequence, b.role
  FROM v_turn a JOIN v_turn b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def motifs(spark, sf) -> DataFrame:
    """Motif table (pattern, type): every distinct benchmark word of five or more residues.

    Words of up to 8 residues are 'regular', of 9 to 11 'MERCI', longer ones 'negative'.
    """
    words = table(spark, sf, "benchmark").select(F.explode(F.split("text", "[^A-Za-z]+")).alias("w"))
    p = words.select(residues_of(F.col("w")).alias("pattern")).where(F.length("pattern") >= 5).distinct()
    n = F.length("pattern")
    return p.withColumn("type", F.when(n <= 8, "regular").when(n <= 11, "MERCI").otherwise("negative"))


MOTIFS = f"""v_word AS (SELECT unnest(string_split_regex(text, '[^A-Za-z]+')) AS w FROM benchmark),
v_mpat AS (SELECT DISTINCT {residues_sql('w')} AS pattern FROM v_word),
v_motif AS (SELECT pattern, CASE WHEN length(pattern) <= 8 THEN 'regular'
  WHEN length(pattern) <= 11 THEN 'MERCI' ELSE 'negative' END AS type FROM v_mpat WHERE length(pattern) >= 5)"""

# Patterns in PROSITE notation, a fixed small table of the bindings.
PROSITE_PATTERNS = ["T-H-[EA]-x(2)-N", "S-x-T-x(1,3)-R", "R-E-[DS]-X-E"]


def scores(spark, sf) -> DataFrame:
    """Documents with labels and three scores derived from their lengths and texts."""
    d, y = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(y, "doc_id", "left").select(
        "doc_id", "source", "lang", "quality", "toxic",
        ((F.col("n_chars") % 101) / 100.0).alias("s1"),
        F.when(F.col("quality").isNotNull(), (F.length("text") % 97) / 96.0).alias("s2"),
        ((F.col("n_chars") % 53) / 52.0).alias("hemolysis_score"),
    )


SCORES = """v_score AS (SELECT d.doc_id, source, lang, quality, toxic, (n_chars % 101) / 100.0 AS s1,
  CASE WHEN quality IS NOT NULL THEN (length(text) % 97) / 96.0 END AS s2,
  (n_chars % 53) / 52.0 AS hemolysis_score FROM documents d LEFT JOIN labels y ON d.doc_id = y.doc_id)"""


def with_views(*views: str, body: str) -> str:
    """One WITH query; a body that starts with a comma goes on with further named blocks."""
    return "WITH " + ",\n".join(views) + "\n" + body.lstrip()
