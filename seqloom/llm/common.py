"""Shared folders, materialised states, text batches and connected components."""

import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session that has none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/seqloom-llm-{name}-{uuid.uuid4().hex}"


class State:
    """A DataFrame written to the shared folder and read back: short lineage that survives lost executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the files once nothing reads them any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(sizes, limit: int):
    """Ranges [i, j) of consecutive rows whose sizes sum to about `limit`; one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n + 1
    if len(sizes) > start:
        yield start, len(sizes)


def planes(values) -> bytes:
    """An integer array byte plane by byte plane, each compressed for itself, as leading bytes are mostly zeros and last
    ones are noise: the number of values, the sizes of the planes, the planes."""
    import pyarrow as pa

    codec = pa.Codec("zstd")
    planes = [codec.compress(x.tobytes(), asbytes=True) for x in values.view(np.uint8).reshape(len(values), values.itemsize).T]
    return np.array([len(values), *map(len, planes)], np.uint32).tobytes() + b"".join(planes)


def unplanes(raw: bytes, dtype) -> np.ndarray:
    import pyarrow as pa

    codec, size = pa.Codec("zstd"), np.dtype(dtype).itemsize
    n, *sizes = np.frombuffer(raw, np.uint32, size + 1).tolist()
    out, at = np.empty((n, size), np.uint8), 4 * (size + 1)
    for i, k in enumerate(sizes):
        out[:, i] = np.frombuffer(codec.decompress(raw[at : at + k], n, asbytes=True), np.uint8)
        at += k
    return out.view(dtype).ravel()


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file; SEQLOOM_TOKENIZERS names another folder."""
    folder = os.environ.get("SEQLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) undirected edges of longs -> (node, root), root the smallest node reachable; only nodes with an edge.

    Every round gives a node the least label around it, then the label of that label. A hot node is one row of the
    labels joined with many edges (a skew join can split it), and minima are combined before the shuffle.
    Null ends are ignored.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    both = State(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = State(both.df.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        seen = both.df.join(labels.df.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.df.join(seen, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.df.select(F.col("node").alias("next"), F.col("root").alias("jump"))
        moved = State(hooked.join(jump, "next").select("node", F.col("jump").alias("next"), "root"), "labels")
        changed = moved.df.where("next <> root").limit(1).count()
        labels.drop()
        labels = State(moved.df.select("node", F.col("next").alias("root")), "labels")
        moved.drop()
        if not changed:
            both.drop()
            return labels.df
