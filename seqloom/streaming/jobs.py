"""Structured Streaming: incremental scoring, windowed metrics, quality counters."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators import ordered as O, scoring as C


#: A sequence that very many keys share reaches its state through so many places.
SALTS = 16
#: Parts of a state for each core; every part of every state is a store of its own.
STATE_PARTS = 2
#: State on the executors' disks, and the memory of all stores of an executor together.
ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


@contextmanager
def state_on_disk(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, if the session names no provider; those started before or after
    are left alone, as a query takes a copy of the settings when it starts."""
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), STATE_PARTS * spark.sparkContext.defaultParallelism)
    chosen = {"spark.sql.shuffle.partitions": str(parts)} | ({} if spark.conf.get(next(iter(ON_DISK)), None) else ON_DISK)
    before = {k: spark.conf.get(k, None) for k in chosen}
    try:
        for k, v in chosen.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Running:
    """Streaming queries that belong together."""

    def __init__(self, *queries: StreamingQuery):
        self.queries = queries

    def awaitTermination(self) -> None:
        for q in self.queries:
            q.awaitTermination()


def incremental_scoring(
    stream: DataFrame, scorers: str, table: str, checkpoint: str, key: str = "name", sequence: str = "sequence"
) -> Running:
    """Scores every sequence of the stream once, however many keys and batches bring it; `scored` reads the result.

    What was seen is keyed state, so a batch reads no earlier rows: `table/keys` gets each new (key, sequence) and
    `table/scores` each new sequence with its scores. Both are append-only; a batch writes its own folder, so one that is
    replayed after a failure overwrites itself, and progress resumes from the checkpoint. The state keeps the key and the
    SHA-256 of its sequences, whatever their length, on the executors' disks (`state_on_disk`).
    """
    rows = stream.select(key, sequence, F.unhex(F.sha2(sequence, 256)).alias("_sha"))
    keys = rows.dropDuplicates([key, "_sha"]).select(key, sequence)
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("_salt")
    each = rows.select(sequence, "_sha", salt).dropDuplicates(["_sha", "_salt"]).select(sequence, "_sha").dropDuplicates(["_sha"]).select(sequence)

    def start(rows: DataFrame, name: str, done) -> StreamingQuery:
        def save(batch: DataFrame, batch_id: int):
            done(batch).write.mode("overwrite").parquet(f"{table}/{name}/batch={batch_id}")

        write = rows.writeStream.foreachBatch(save).option("checkpointLocation", f"{checkpoint}/{name}")
        return write.trigger(availableNow=True).start()

    with state_on_disk(stream.sparkSession):
        return Running(start(keys, "keys", lambda b: b), start(each, "scores", lambda b: C.score_batch(b, scorers, sequence)))


def scored(spark: SparkSession, table: str, key: str = "name", sequence: str = "sequence") -> DataFrame:
    """(key, sequence, scores) of all batches. Of several sequences of one key the greatest counts, whichever batch
    brought it; null counts only where the key has no other."""
    keys = spark.read.parquet(f"{table}/keys").groupBy(key).agg(F.max(sequence).alias(sequence))
    return O.join_on(keys, spark.read.parquet(f"{table}/scores").drop("batch"), [sequence])


def windowed_metrics(
    stream: DataFrame, time: str, value: str, by: list = (), size: str = "1 hour", slide: str = None,
    gap: str = None, delay: str = "10 minutes",
) -> DataFrame:
    """Count, mean and sum per event-time window: tumbling, sliding (`slide`) or session (`gap`).

    Works on streams and on tables. In update or append mode rows later than `delay` behind the newest one seen in an
    earlier batch are dropped, and so is the state of windows that end before; complete mode drops neither. Session
    windows in append mode appear once, after they have closed; complete mode gives those still open too, which a table
    that has an end needs (`final` reads it)."""
    when = F.session_window(time, gap) if gap else F.window(time, size, slide) if slide else F.window(time, size)
    return (
        stream.withWatermark(time, delay).groupBy(when.alias("w"), *by)
        .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "mean", "total")
    )


def quality_counters(stream: DataFrame, source: str, reason) -> DataFrame:
    """Running count per source and reason; `reason` is a Column (null: the row is fine)."""
    return stream.groupBy(source, F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


def run_to_table(df: DataFrame, table: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is available and keeps each batch's rows in `table/batch=i`; a replayed batch overwrites its own.

    In append mode the batches together are the result. In update mode a batch holds the groups that changed in it, in
    complete mode all groups; `latest` takes the newest row of each group.
    """
    def save(batch: DataFrame, batch_id: int):
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str, keys: list) -> DataFrame:
    """Newest row per key over the batches of an update-mode table."""
    rows = spark.read.option("basePath", table).parquet(table)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def final(spark: SparkSession, table: str) -> DataFrame:
    """Rows of the last batch of a complete-mode table."""
    rows = spark.read.option("basePath", table).parquet(table)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(last, "batch").drop("batch")
