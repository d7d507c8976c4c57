"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seqloom.llm import minhash, packing, quality, secrets
from seqloom.llm.common import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Empty and null texts are scored like any other."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).where("predicted = 1").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id; wordless documents stay.

    Of repeated rows of that document one stays; a group of null ids alone keeps one row.
    """
    found = minhash.near_duplicates(docs)
    # One row of each group is named by its id and the hash of its text; a row without a group stays.
    first = found.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "check")).alias("at")).select("at.doc_id", "at.check")
    loose = found.where("group is null").select("doc_id", "check").distinct()
    keep = first.withColumn("grouped", F.lit(True)).union(loose.withColumn("grouped", F.lit(False))).withColumnRenamed("doc_id", "id").withColumnRenamed("check", "hash")
    kept = docs.withColumn("_check", F.xxhash64(F.col("text").cast("string"))).join(keep, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_check") == F.col("hash")))
    ranked = kept.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "_check").orderBy("lang", "source", "n_chars")))
    return ranked.where(~F.col("grouped") | (F.col("_nth") == 1)).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    done = secrets.redact(docs, mark="[SECRET]")
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens."""
    return packing.pack_documents(docs, keep=packing.CHUNKS)


STAGES = [("quality", keep_good), ("near_copies", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]

#: A trained classifier and a tokenizer are in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
