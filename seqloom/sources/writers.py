"""Writers: FASTA, delimited files, snapshots, reports."""

from pyspark.sql import DataFrame, Observation, functions as F

from seqloom.operators import ordered as O
from seqloom.sources.readers import path_exists


def fasta_lines(df: DataFrame, order: list, sequence: str = "sequence") -> DataFrame:
    """Text of each record, `>seq_{i}|len={n}` and the sequence, in order."""
    at = O.running(df, order, index="_i")
    head = F.concat(F.lit(">seq_"), F.col("_i"), F.lit("|len="), F.length(sequence))
    return at.orderBy("_i").select(F.concat_ws("\n", head, F.col(sequence)).alias("value"))


def write_fasta(df: DataFrame, path: str, order: list, sequence: str = "sequence"):
    """Part files hold consecutive ranges; read in name order they are the ordered file."""
    fasta_lines(df, order, sequence).write.text(path)


def write_paired_fasta(df: DataFrame, path: str, name: str = "name", heavy: str = "h_seq", light: str = "l_seq"):
    """`{name}_VH` and then `{name}_VL` per row."""
    one = lambda tag, s: F.concat(F.lit(">"), F.col(name), F.lit(f"{tag}\n"), F.col(s))
    df.orderBy(name).select(F.concat_ws("\n", one("_VH", heavy), one("_VL", light)).alias("value")).write.text(path)


def write_csv(df: DataFrame, path: str, fields: list = None, sep: str = ",") -> int:
    """Header, fixed column order; returns the row count, observed while writing."""
    seen = Observation()
    out = df.select(*(fields or df.columns)).observe(seen, F.count(F.lit(1)).alias("n"))
    out.write.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return seen.get["n"]


def write_delimited(df: DataFrame, path: str, order: list = None, columns: list = None) -> int:
    return write_csv(df.orderBy(*order) if order else df, path, columns, "\t")


def save_snapshot(df: DataFrame, path: str, order: list) -> DataFrame:
    """Rows under dense ids 0..n-1 as parquet; an existing finished snapshot is kept as it is."""
    spark = df.sparkSession
    if not path_exists(spark, path):
        O.running(df, order, index="snapshot_id").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def report_json(**parts: DataFrame) -> DataFrame:
    """One JSON document from small summary frames: each becomes a list of objects."""
    spark = next(iter(parts.values())).sparkSession
    cells = [df.agg(F.collect_list(F.struct(*df.columns))).scalar().alias(name) for name, df in parts.items()]
    return spark.range(1).select(F.to_json(F.struct(*cells)).alias("value"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """A Markdown table line per row, numbers as %.6g and missing values as nan; header lines first."""
    def cell(c, t):
        x = F.col(c)
        if t in ("double", "float"):
            return F.when(x.isNull() | F.isnan(x), "nan").otherwise(_six_digits(x))
        return F.coalesce(x.cast("string"), F.lit("nan"))

    bar = lambda xs: F.concat(F.lit("| "), F.concat_ws(" | ", *xs), F.lit(" |"))
    body = df.select(bar([cell(c, t) for c, t in df.dtypes]).alias("value"))
    head = df.sparkSession.createDataFrame(
        [("| " + " | ".join(df.columns) + " |",), ("| " + " | ".join("---" for _ in df.columns) + " |",)], "value string"
    )
    return head.union(body)


def _six_digits(x):
    """%.6g: six significant digits, exponent form outside 1e-4 .. 1e6, no trailing zeros."""
    e = F.floor(F.log10(F.abs(x)))
    digits = F.greatest(5 - e, F.lit(0)).cast("int")
    plain = F.lit(None).cast("string")
    for n in range(10, -1, -1):
        plain = F.when(digits == n, F.format_string(f"%.{n}f", x)).otherwise(plain)
    trimmed = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    expo = F.regexp_replace(F.format_string("%.5e", x), r"\.?0*e", "e")
    return F.when(x == 0, "0").when((e < -4) | (e >= 6), expo).otherwise(trimmed)


def write_report(path: str, parts: dict):
    """`path/json` and one Markdown table per part below `path/markdown`."""
    report_json(**parts).coalesce(1).write.text(f"{path}/json")
    for name, df in parts.items():
        markdown_rows(df).coalesce(1).write.text(f"{path}/markdown/{name}")
