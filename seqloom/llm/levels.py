"""Sum-of-squares online packing of tokenised documents into windows, with a level array."""

import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import slices, tokenizer_path

#: Ids after which a task settles its open windows and begins anew; bounds the ids it holds (4 bytes each).
RUN = 1 << 24


class Levels:
    """Open windows by fill level: counts[h] of them hold h ids, 0 < h < capacity."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.open = [[] for _ in range(capacity + 1)]
        self.made = 0

    def choose(self, size: int) -> int:
        """The level (0: a new window) from which `size` ids leave the least sum of squared counts; the fullest of equals.

        A window that leaves level h changes the sum by 1 - 2 counts[h], one that comes to h + size by
        2 counts[h + size] + 1; full windows do not count.
        """
        n = self.counts
        last = self.capacity - size
        change = 1 - 2 * n[: last + 1]
        change[0] = 0
        change[:last] += 2 * n[size : self.capacity] + 1
        usable = n[: last + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def place(self, size: int):
        """(window, level before, whether it is full now) for an item of 1 to `capacity` ids."""
        level = 0 if size == self.capacity else self.choose(size)
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        else:
            window, self.made = self.made, self.made + 1
        full = level + size == self.capacity
        if not full:
            self.open[level + size].append(window)
            self.counts[level + size] += 1
        return window, level, full

    def rest(self):
        """(level, windows) of all open windows, fullest first."""
        return [(h, self.open[h]) for h in range(self.capacity - 1, 0, -1) if self.open[h]]


def pack_run(documents, capacity: int, first: int):
    """Pieces (doc, start, length, crc32, doc_tokens, sequence, offset) of (doc, ids) pairs, and the next free sequence.

    Whole windows are cut off the front of a long document; what is left, and every shorter document, is an item that
    is placed as it comes. At the end windows whose fill is a power of two stay, as these are not padded. The pieces of
    the others are laid end to end and cut into full windows, and the last ids into windows of falling powers of two.
    So nothing is padded, and only documents in windows left open at the end are cut for the packing.
    """
    levels, held, out = Levels(capacity), {}, []

    def piece(doc, ids, start, length, total, sequence, offset):
        out.append((doc, start, length, zlib.crc32(ids[start : start + length].tobytes()), total, first + sequence, offset))

    for doc, ids in documents:
        total, at = len(ids), 0
        while at < total:
            size = min(capacity, total - at)
            window, level, full = levels.place(size)
            held.setdefault(window, []).append((doc, ids, at, size, total, level))
            if full:
                for d, i, s, n, t, o in held.pop(window):
                    piece(d, i, s, n, t, window, o)
            at += size
    loose = []
    for level, windows in levels.rest():
        for window in windows:
            if level & (level - 1):
                loose += held.pop(window)
            else:
                for d, i, s, n, t, o in held.pop(window):
                    piece(d, i, s, n, t, window, o)
    left = sum(x[3] for x in loose)
    room = fill = 0
    sequence = levels.made - 1
    for doc, ids, start, size, total, _ in loose:
        while size:
            if fill == room:
                room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
                fill, sequence = 0, sequence + 1
            n = min(size, room - fill)
            piece(doc, ids, start, n, total, sequence, fill)
            start, size, fill, left = start + n, size - n, fill + n, left - n
    return out, first + sequence + 1


def pack_online(docs: DataFrame, capacity: int = 1024, tokenizer: str = None, end_id: int = 0, run_ids: int = RUN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): every id of every document in one piece.

    Each partition is packed by itself in the task that encodes it, without a shuffle, and the same partition gives the
    same rows again after a lost executor. Capacity is a power of two. Every sequence is full or holds a power of two
    of ids. Null texts are empty (the end id alone); null ids are kept; repeated rows are documents of their own; ties
    go to the fullest level, then to the window that came there last; other columns are not read; an empty table gives
    no rows.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    tokenizer = tokenizer or tokenizer_path()

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from seqloom.llm.bpe import load

        encoder = load(tokenizer)
        next_id = TaskContext.get().partitionId() << 40
        waiting, size = [], 0
        end = np.array([end_id], dtype="<u4")
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

        def settle():
            nonlocal waiting, size, next_id
            rows, next_id = pack_run(waiting, capacity, next_id)
            waiting, size = [], 0
            for i in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + (1 << 16)])], names=names)

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for i, j in slices(sizes, 1 << 21):
                for name, ids in zip(batch.column(0)[i:j].to_pylist(), encoder.encode(batch.column(1)[i:j].to_pylist())):
                    waiting.append((name, np.concatenate((ids.astype("<u4"), end))))
                    size += len(ids) + 1
                    if size >= run_ids:
                        yield from settle()
        yield from settle()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
