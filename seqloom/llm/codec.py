"""BPE ids of documents and texts of ids."""

import hashlib

from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import slices, tokenizer_path


def encode(docs: DataFrame, tokenizer: str = None, text: str = "text", key: str = "doc_id", leaf: int = 4096, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of whole texts, by tree concatenation.

    Texts longer than `leaf` bytes are encoded in halves that are joined exactly (bpe.TreeEncoder); the leaves of a
    batch are encoded in one call. ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256
    of the text decoded from them in UTF-8. Null texts are empty; null keys and repeated rows stay; other columns are
    not read; no shuffle.
    """
    tokenizer = tokenizer or tokenizer_path()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from seqloom.llm.bpe import TreeEncoder, load

        tree = TreeEncoder(load(tokenizer), leaf)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for i, j in slices(sizes, 1 << 21):
                ids = tree.encode(batch.column(1)[i:j].to_pylist())
                raw = [x.astype("<u4") for x in ids]
                cols = [
                    batch.column(0)[i:j],
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in raw]),
                    pa.array([hashlib.sha256(tree.encoder.decode(x).encode()).hexdigest() for x in ids]),
                ]
                if keep_ids:
                    cols.append(pa.array([x.astype("int32") for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if keep_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def decode(coded: DataFrame, tokenizer: str = None, ids: str = "ids", out: str = "text") -> DataFrame:
    """The rows with the text of their id arrays, special tokens included; null ids give null, none an empty text."""
    tokenizer = tokenizer or tokenizer_path()

    @F.pandas_udf("string")
    def text_of(column):
        from seqloom.llm.bpe import load

        encoder = load(tokenizer)
        return column.map(lambda x: None if x is None else encoder.decode(x))

    return coded.withColumn(out, text_of(ids))
