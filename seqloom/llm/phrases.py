"""Frequent phrases and their association scores: mergeable Misra-Gries summaries, then exact counts."""

import hashlib
import io

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from seqloom.llm.common import State, partitions, planes, slices, unplanes
from seqloom.llm.text import _hash_words, mix

#: Bytes of text in a block, and of a text that is cut at the ends of its pieces.
BLOCK, LONG = 4 << 20, 1 << 20
#: Bytes hashed in one numpy step.
STEP = 1 << 20
#: Blocks whose n-grams a hash partition gets, about.
SHARE = 8
#: Bits of an n-gram's fingerprint in the first pass. Different n-grams of one fingerprint are counted together, which
#: can only let more of them through; the second pass counts words.
BITS = 40
#: Fixed by the contract: signs that end a piece; space and tab part words inside one.
BREAKS = b".,;:!?\n\v\f\r"

_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(BREAKS)] = True
_COUNTED = ("lang", "n_words", "phrase", "f")
_GAP = _BREAK.copy()
_GAP[[32, 9]] = True


class MisraGries:
    """At most `capacity` counters. A key added c times in all keeps a counter of at least c - lost, and lost is at most
    mass / (capacity + 1): every merge that is over capacity takes as much from capacity + 1 counters as is lost."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, keys, counts) -> None:
        """Add the counters of another summary, or plain counts."""
        both = np.concatenate((self.keys, keys))
        self.keys, inverse = np.unique(both, return_inverse=True)
        self.counts = np.bincount(inverse, weights=np.concatenate((self.counts, counts)), minlength=len(self.keys)).astype(np.int64)
        over = len(self.keys) - self.capacity
        if over > 0:
            less = int(np.partition(self.counts, over - 1)[over - 1])
            self.lost += less
            keep = self.counts > less
            self.keys, self.counts = self.keys[keep], self.counts[keep] - less

    def reaching(self, least: int):
        """The keys that may have been added `least` times."""
        return self.keys[self.counts + self.lost >= least]


class Grams:
    """The words of the texts of a block, and the n-grams of its pieces, each by language."""

    def __init__(self, langs: list, texts: list):
        self.raw = b"\n".join(texts)
        found, at = [], 0
        # Hashed in steps, as a step takes several times its bytes.
        for i, j in slices([len(t) for t in texts], STEP):
            hashes, starts, ends = _hash_words(b"\n".join(texts[i:j]), _GAP)
            found.append((hashes, starts + at, ends + at))
            at += sum(len(t) + 1 for t in texts[i:j])
        hashes, self.starts, self.ends = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 2)
        piece = np.cumsum(_BREAK[np.frombuffer(self.raw, np.uint8)], dtype=np.int32)
        self.piece = piece[self.starts]
        self.names = sorted(set(langs))
        code = {x: i for i, x in enumerate(self.names)}
        counts = np.searchsorted(self.starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        self.lang = np.repeat(np.array([code[x] for x in langs], dtype=np.int64), np.diff(counts))
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") for x in self.names], dtype=np.uint64)
        self.hashes = mix(hashes ^ seeds[self.lang]) if len(hashes) else hashes

    def keys(self, longest: int):
        """For n = 1..longest: (n, places of the first words, 64-bit keys) of the n-grams inside pieces."""
        run, at = self.hashes, np.arange(len(self.hashes))
        for n in range(1, longest + 1):
            if n > 1:
                inside = at[at + n <= len(self.hashes)]
                fits = self.piece[inside + n - 1] == self.piece[inside]
                run, at = run[: len(inside)][fits], inside[fits]
                run = mix(run * np.uint64(0xD6E8FEB86659FD93) + self.hashes[at + n - 1])
            yield n, at, run

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.raw[self.starts[i] : self.ends[i]] for i in range(at, at + n)).lower().decode("utf-8", "replace")


def _marks(keys):
    return keys >> np.uint64(64 - BITS)


def _cut(text: bytes, long: int):
    """Parts of about `long` bytes that end where a piece ends; a longer piece stays whole."""
    start = 0
    while len(text) - start > long:
        ends = [x for x in (text.find(bytes([b]), start + long) for b in BREAKS) if x >= 0]
        if not ends:
            break
        yield text[start : min(ends)]
        start = min(ends) + 1
    yield text[start:]


def _bind(batches, most):
    """Blocks of about `most` bytes of (lang, text), compressed."""
    import pyarrow as pa

    number, langs, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def block():
        nonlocal number, langs, texts, size
        table = pa.Table.from_arrays([pa.array(langs, pa.string()).dictionary_encode(), pa.array(texts, pa.binary())], names=["lang", "text"])
        row = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_packed(table)], pa.binary())], names=["block", "data"])
        number, langs, texts, size = number + 1, [], [], 0
        return row

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            name = lang.as_py()
            for part in _cut(text.as_buffer().to_pybytes(), min(LONG, most)):
                langs.append(name)
                texts.append(part)
                size += len(part) + 1
                if size >= most:
                    yield block()
    if texts:
        yield block()


def _packed(table) -> bytes:
    import pyarrow as pa

    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue()


def _grams(raw) -> Grams:
    import pyarrow as pa

    table = pa.ipc.open_stream(raw).read_all()
    return Grams(table.column("lang").to_pylist(), table.column("text").to_pylist())


def frequent(docs: DataFrame, least: int = 100, longest: int = 5, text: str = "text", lang: str = "lang", block: int = BLOCK) -> DataFrame:
    """(lang, n_words, phrase, f): every phrase of 1 to `longest` words that stands at least `least` times in a lang,
    counted exactly, and for each lang a row with n_words 0 and no phrase that counts its words.

    First pass: each block counts the fingerprints of its n-grams and sends them by hash. A hash partition merges what
    it gets into one Misra-Gries summary whose capacity exceeds its mass divided by `least`, so no n-gram that often can
    be lost, and memory is bounded by the capacity. What may reach `least` goes back to the blocks it came from. Second
    pass: the blocks count the n-grams of these fingerprints by their words, and the hash partitions add these up.
    """
    spark = docs.sparkSession
    # Lower case and names of languages are made here; blocks hold bytes.
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    blocks = State(rows.mapInArrow(lambda batches: _bind(batches, block), "block long, data binary"), "phrase-blocks")
    shards = max(8, partitions(spark), -(-blocks.df.count() // SHARE))

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                every = np.concatenate([_marks(k) for _, _, k in _grams(data.as_buffer()).keys(longest)])
                every.sort()
                first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.empty(0, np.int64)
                found, counts = every[first], np.diff(np.append(first, len(every)))
                del every
                top = found * np.uint64(shards) >> np.uint64(BITS)
                cuts = np.searchsorted(top, np.arange(shards + 1, dtype=np.uint64)).tolist()
                made = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _, _ in made], pa.int32()), pa.array([number] * len(made), pa.int64()),
                        pa.array([planes(np.diff(found[a:b], prepend=np.uint64(0))) for _, a, b in made], pa.binary()),
                        pa.array([planes(counts[a:b].astype(np.uint32)) for _, a, b in made], pa.binary()),
                        pa.array([int(counts[a:b].sum()) for _, a, b in made], pa.int64()),
                    ],
                    names=["shard", "block", "marks", "counts", "mass"],
                )

    def summarise(bundles):
        import pyarrow as pa

        def bundle(i):
            return np.cumsum(unplanes(bundles.column("marks")[i].as_py(), np.uint64), dtype=np.uint64)

        mass = sum(bundles.column("mass").to_pylist())
        summary = MisraGries(mass // least + 1)
        for i in range(bundles.num_rows):
            summary.merge(bundle(i), unplanes(bundles.column("counts")[i].as_py(), np.uint32))
        left = summary.reaching(least)
        # What each block has of it.
        names, out = [], []
        for i, number in enumerate(bundles.column("block").to_pylist()):
            own = np.intersect1d(bundle(i), left, assume_unique=True)
            if len(own):
                names.append(number)
                out.append(planes(np.diff(own, prepend=np.uint64(0))))
        return pa.Table.from_arrays([pa.array(names, pa.int64()), pa.array(out, pa.binary())], names=["block", "left"])

    asked = blocks.df.mapInArrow(ask, "shard int, block long, marks binary, counts binary, mass long")
    left = State(asked.groupBy("shard").applyInArrow(summarise, "block long, left binary"), "phrase-marks")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for data, parts in zip(batch.column("data"), batch.column("parts").to_pylist()):
                wanted = np.sort(np.concatenate([np.cumsum(unplanes(p, np.uint64), dtype=np.uint64) for p in parts or []] or [np.empty(0, np.uint64)]))
                grams = _grams(data.as_buffer())
                words = np.bincount(grams.lang, minlength=len(grams.names)).tolist()
                shard, rows = [0] * len(words), [(name, 0, None, c) for name, c in zip(grams.names, words)]
                for n, at, keys in grams.keys(longest):
                    marks = _marks(keys)
                    i = np.minimum(np.searchsorted(wanted, marks), max(0, len(wanted) - 1))
                    hit = wanted[i] == marks if len(wanted) else np.zeros(len(marks), dtype=bool)
                    found, first, counts = np.unique(keys[hit], return_index=True, return_counts=True)
                    places = at[hit][first]
                    shard += (_marks(found) * np.uint64(shards) >> np.uint64(BITS)).tolist()
                    rows += [(grams.names[x], n, grams.phrase(p, n), c) for x, p, c in zip(grams.lang[places].tolist(), places.tolist(), counts.tolist())]
                order = np.argsort(np.array(shard), kind="stable")
                table = pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=list(_COUNTED)).take(order)
                cuts = np.searchsorted(np.array(shard)[order], np.arange(shards + 1)).tolist()
                made = [(s, _packed(table.slice(a, b - a))) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in made], pa.int32()), pa.array([x for _, x in made], pa.binary())], names=["shard", "data"])

    def add(bundles):
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in bundles.column("data")])
        total = rows.group_by(["lang", "n_words", "phrase"]).aggregate([("f", "sum")]).rename_columns(list(_COUNTED))
        return total.filter(pc.or_(pc.is_null(total.column("phrase")), pc.greater_equal(total.column("f"), least)))

    parts = left.df.groupBy("block").agg(F.collect_list("left").alias("parts"))
    counted = blocks.df.join(parts, "block", "left").select("data", "parts").mapInArrow(count, "shard int, data binary")
    done = counted.groupBy("shard").applyInArrow(add, "lang string, n_words int, phrase string, f long")
    done = State(done, "phrases")
    blocks.drop()
    left.drop()
    return done.df


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, best: int = 2000, text: str = "text", lang: str = "lang", block: int = BLOCK) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `best` phrases of 2 to `longest` words of each lang.

    A-Z are lower-cased, texts are split at BREAKS into pieces and these at spaces and tabs into words. A phrase that
    stands `least` times or more in its lang is a candidate; its score is the least over its cuts of floor(1000 * a * n /
    (l * r)), equal ones to the earliest cut, in 38-digit decimals. A candidate that stands in a longer one of the same
    count is dropped. Order: score and a falling, phrase in UTF-8 bytes. A null lang is `und`, as is the lang of that
    name; null and empty texts have no words; repeated rows count each; other columns are not read; an empty table gives
    no rows.
    """
    counts = frequent(docs, least, longest, text, lang, block)
    words = counts.where("n_words = 0").select("lang", F.col("f").alias("n"))
    grams = counts.where("n_words > 0").select("lang", "n_words", "phrase", "f")
    phrases = grams.where("n_words > 1")

    # A phrase in a longer one of the same count also stands in one longer by a word, whose count lies between them.
    some = lambda k: F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)
    parts = F.array(some(F.col("n_words") - 1), some(1 - F.col("n_words")))
    inside = phrases.where("n_words > 2").select("lang", F.explode(F.array_distinct(parts)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").where("longer is null or longer < f").drop("longer")

    cuts = kept.select("lang", "n_words", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
    cuts = cuts.select("*", some(F.col("k")).alias("head"), some(F.col("k") - F.col("n_words")).alias("tail"))
    side = lambda phrase, f: grams.select("lang", F.col("phrase").alias(phrase), F.col("f").alias(f))
    scored = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"]).join(words, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    scored = scored.withColumn("up", (F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n")).cast("decimal(38,0)")).withColumn("down", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("cast(up div down as bigint)"))
    worst = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.*")

    # The best of each hash part first, so that no task sorts all phrases of a language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = max(8, partitions(docs.sparkSession))
    parted = worst.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    heads = parted.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("nth") <= best)
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
