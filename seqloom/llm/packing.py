"""Packing of tokenised documents into sequences: pairing of large items, best fit of the others."""

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from seqloom.llm.common import State, partitions, slices, tokenizer_path

#: Chunks of texts whose ids a Python worker keeps where other stages follow, as they stay in its memory after the stage.
CHUNKS = 250_000


def pieces(docs: DataFrame, capacity: int = 1024, tokenizer: str = None, end_id: int = 2, text: str = "text", key: str = "doc_id", keep: int = 1_000_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole texts as ids with the end id, longer ones cut.

    A document longer than the capacity is cut into full pieces; what is left over is its first piece. Null texts are
    empty (the end id alone). A Python worker keeps the ids of so many chunks of texts.
    """
    tokenizer = tokenizer or tokenizer_path()

    def cut(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from seqloom.llm.bpe import load

        encoder = load(tokenizer, keep)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for i, j in slices(sizes, 1 << 21):
                rows = []
                for name, ids in zip(batch.column(0)[i:j].to_pylist(), encoder.encode(batch.column(1)[i:j].to_pylist())):
                    raw, n = ids.astype("<u4").tobytes() + int(end_id).to_bytes(4, "little"), len(ids) + 1
                    a, b, piece = 0, (n % capacity) or min(n, capacity), 0
                    while a < n:
                        rows.append((name, piece, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
                        a, b, piece = b, b + capacity, piece + 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:]]], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict, capacity: int) -> list:
    """Placements (length, first rank, last rank + 1, first sequence, items a sequence, offset) for items counted by length.

    Large items (over a third of the capacity) go first: no sequence holds three of them, and from the longest on each
    is paired with the longest one left that fits, which makes as many pairs as can be. The others follow in falling
    length, each into the smallest gap that holds it. Equal gaps are handled together as ranges of sequences, so the
    work and the number of placements depend on the capacity, not on the number of items.
    """
    left, used, out = dict(counts), {n: 0 for n in counts}, []
    gaps, sizes = {}, []  # gap -> ranges of sequences [first, last); the gaps in order
    made = 0

    def take(n, k, first, each, offset):
        out.append((n, used[n], used[n] + k, first, each, offset))
        used[n] += k
        left[n] -= k

    def opened(gap, a, b):
        if b > a and gap:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((a, b))

    large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and left[m] > (m == n)), None)
            if mate is None:
                k = left[n]
                take(n, k, made, 1, 0)
                opened(capacity - n, made, made + k)
            else:
                k = left[n] // 2 if mate == n else min(left[n], left[mate])
                take(n, k, made, 1, 0)
                take(mate, k, made, 1, n)
                opened(capacity - n - mate, made, made + k)
            made += k
    for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(sizes, n)
            if at == len(sizes):
                gap, each = capacity, capacity // n
                new = -(-left[n] // each)
                a, b, made = made, made + new, made + new
            else:
                gap = sizes[at]
                a, b = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
                each = gap // n
            whole = min(b - a, left[n] // each)
            if whole:
                take(n, whole * each, a, each, capacity - gap)
                opened(gap - each * n, a, a + whole)
            if a + whole < b and left[n] and left[n] < each:
                k = left[n]
                take(n, k, a + whole, each, capacity - gap)
                opened(gap - k * n, a + whole, a + whole + 1)
                opened(gap, a + whole + 1, b)
            else:
                opened(gap, a + whole, b)
    return out


def pack(items: DataFrame, capacity: int = 1024) -> DataFrame:
    """items with a column length in [1, capacity] -> the same rows with sequence_id and offset, gapless from 0.

    Only the number of items of each length (at most `capacity` numbers) reaches the driver, which plans by length;
    every item finds its place by its rank among those of its length. Ranks are counted under a salt, so a hot length
    is spread. The plan joined to the items has a bounded number of rows, as it depends on the capacity alone.
    """
    spark = items.sparkSession
    salts = max(16, 4 * partitions(spark))
    state = State(items.withColumn("_salt", F.pmod(F.xxhash64(*items.columns), F.lit(salts)).cast("int")), "items")
    per_salt = state.df.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_salt.select("length", "_salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    order = [c for c in state.df.columns if c not in ("length", "_salt")]
    ranked = state.df.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_salt").orderBy(*(order or ["length"]))) - 1).join(firsts, ["length", "_salt"])
    places = spark.sparkContext.broadcast(_columns(plan(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        n, first, seq, each, offset = places.value
        # Placements are sorted by (length, first rank): the last one that starts at or before the item's rank holds it.
        code = n.astype(object) * (1 << 62) + first if len(n) and int(first.max()) >= 1 << 40 else n * (1 << 40) + first
        want = length.to_numpy().astype(code.dtype) * ((1 << 62) if code.dtype == object else (1 << 40)) + rank.to_numpy()
        i = np.searchsorted(code, want, "right") - 1
        t = rank.to_numpy() - first[i]
        return pd.DataFrame({"sequence_id": seq[i] + t // each[i], "offset": offset[i] + t % each[i] * length.to_numpy()})

    return ranked.withColumn("_place", place("length", F.col("_rank") + F.col("_first"))).select(*items.columns, "_place.sequence_id", "_place.offset")


def _columns(rows: list):
    rows = sorted(rows)
    cols = np.array([(n, a, s, each, offset) for n, a, b, s, each, offset in rows if b > a], dtype=np.int64).reshape(-1, 5)
    return tuple(np.ascontiguousarray(cols[:, i]) for i in range(5))


def pack_documents(docs: DataFrame, capacity: int = 1024, tokenizer: str = None, end_id: int = 2, keep: int = 1_000_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all documents.

    Null texts and null ids are kept; repeated rows are documents of their own; other columns are not read; an empty
    table gives no rows.
    """
    return pack(pieces(docs, capacity, tokenizer, end_id, keep=keep), capacity)
