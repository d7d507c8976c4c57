"""Token ids of documents in binary files: one id array a file, with Elias-Fano document boundaries."""

import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seqloom.llm.common import scratch_path, slices, tokenizer_path
from seqloom.llm.elias_fano import EliasFano

#: Format: MAGIC, bytes of an id, end id, number of ids; boundaries (n + 1 values) and document ids (shifted by the
#: first) as Elias-Fano; a bit for each document whose id is null; the ids, little-endian.
MAGIC = b"SLTK0001"
HEAD = "<8sBIQqQ"


def pack(ids: list, doc_ids: list, end_id: int, width: int) -> bytes:
    """One file. doc_ids ascend, nulls first; end_id is put after every document's ids."""
    known = [d for d in doc_ids if d is not None]
    first = known[0] if known else 0
    bounds = EliasFano.encode(np.concatenate(([0], np.cumsum([len(x) + 1 for x in ids], dtype=np.uint64))).astype(np.uint64))
    names = EliasFano.encode(np.array([d - first for d in known], dtype=np.uint64))
    end = np.array([end_id], dtype=f"<u{width}")
    body = np.concatenate([x for doc in ids for x in (doc, end)]).astype(f"<u{width}", copy=False) if ids else np.empty(0, f"<u{width}")
    head = struct.pack(HEAD, MAGIC, width, end_id, len(body), first, len(doc_ids) - len(known))
    return head + bounds.to_bytes() + names.to_bytes() + body.tobytes()


class TokenFile:
    """A file's documents by place: offsets from select, ids as a view of the file."""

    def __init__(self, raw):
        magic, self.width, self.end_id, n, first, self.nulls = struct.unpack_from(HEAD, raw, 0)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.bounds, at = EliasFano.from_bytes(raw, struct.calcsize(HEAD))
        names, at = EliasFano.from_bytes(raw, at)
        self.doc_ids = [None] * self.nulls + [first + int(x) for x in names.values()]
        self.ids = np.frombuffer(raw, f"<u{self.width}", n, at)

    def __len__(self):
        return len(self.doc_ids)

    def document(self, i: int):
        """(start in the file, ids) of the i-th document."""
        a, b = self.bounds.select(i), self.bounds.select(i + 1)
        return a, self.ids[a:b]

    def bounds_in_parts(self, size: int = 1 << 14):
        """Starts of consecutive documents, and the end of the last one, `size` documents at a time."""
        for i in range(0, len(self), size):
            yield self.bounds.select_range(i, min(len(self), i + size) + 1).astype(np.int64)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = None, end_id: int = 2, text: str = "text", key: str = "doc_id", file_ids: int = 1 << 22) -> DataFrame:
    """Encode whole texts and write token files of about `file_ids` ids to the folder `path`, in ascending order of key.

    Returns the manifest (shard, part, file, n_docs, n_tokens), also written as Parquet to `path`/manifest. Files get
    new names at every attempt and only those of the attempts that ended are in the manifest, so a lost executor leaves
    no wrong file. Rows are ranged by key and a hash of the text, so that a hot key is spread; each task holds one
    file's ids at a time. Null texts are empty documents (the end id alone); null keys come first; repeated rows are
    documents of their own; other columns are not read. An empty table gives an empty manifest.
    """
    tokenizer = tokenizer or tokenizer_path()
    path = path.rstrip("/")

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        from seqloom.llm.bpe import load

        encoder = load(tokenizer)
        width = 2 if max(encoder.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        store, folder = fs.FileSystem.from_uri(path)
        shard, part, ids, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal part, ids, names, size
            name = f"{shard:06d}-{part:06d}-{uuid.uuid4().hex}.tok"
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(pack(ids, names, end_id, width))
            row = pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "file": [name], "n_docs": [len(names)], "n_tokens": [size]})
            part, ids, names, size = part + 1, [], [], 0
            return row

        for batch in batches:
            lengths = np.diff(np.array(_offsets(batch.column(1)), dtype=np.int64))
            for i, j in slices(lengths.tolist(), 1 << 21):
                for k, got in zip(batch.column(0)[i:j].to_pylist(), encoder.encode(batch.column(1)[i:j].to_pylist())):
                    ids.append(got)
                    names.append(k)
                    size += len(got) + 1
                    if size >= file_ids:
                        yield flush()
        if names:
            yield flush()

    spark = docs.sparkSession
    _make(spark, path)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    ranged = rows.repartitionByRange(F.col("key").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("key").asc_nulls_first())
    manifest = ranged.mapInArrow(write, "shard int, part int, file string, n_docs long, n_tokens long")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.schema(manifest.schema).parquet(f"{path}/manifest")


def _offsets(column):
    import pyarrow.compute as pc

    n = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.cumsum(n)))


def _make(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def read_tokens(spark: SparkSession, path: str, manifest: DataFrame = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the token files of `path`.

    start counts the ids of all documents before it over all files in order. Files come through Spark's binary reader;
    a task holds the files of one split.
    """
    path = path.rstrip("/")
    if manifest is None:
        manifest = spark.read.parquet(f"{path}/manifest")
    # One row a file; sums of the shards first, so that the ordered sum runs over few rows in each window.
    in_shard = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    first = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    bases = manifest.select("shard", "file", F.coalesce(F.sum("n_tokens").over(in_shard), F.lit(0)).alias("within")).join(first, "shard")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tok").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                token_file = TokenFile(content.as_buffer())
                starts, counts, crcs = [], [], []
                for bounds in token_file.bounds_in_parts():
                    first = int(bounds[0])
                    raw = memoryview(token_file.ids[first : bounds[-1]].astype("<u4")).cast("B")
                    places = (4 * (bounds - first)).tolist()
                    starts += bounds[:-1].tolist()
                    counts += np.diff(bounds).tolist()
                    crcs += [zlib.crc32(raw[a:b]) for a, b in zip(places[:-1], places[1:])]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name.as_py()] * n, pa.string()), pa.array(token_file.doc_ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["file", "doc_id", "within_file", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(read, "file string, doc_id long, within_file long, n_tokens long, ids_crc32 long")
    return rows.join(bases, "file").select("doc_id", (F.col("first") + F.col("within") + F.col("within_file")).alias("start"), "n_tokens", "ids_crc32")


def token_index(docs: DataFrame, tokenizer: str = None, end_id: int = 2, path: str = None) -> DataFrame:
    """Write the token files of docs to `path` (a new shared folder by default) and read them back."""
    path = path or scratch_path(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, path, write_tokens(docs, path, tokenizer, end_id))
