"""Splits, masks, resampling and run grids. Randomness is a hash of row key and seed, so results do
not depend on partitioning."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqloom import constants as K
from seqloom.functions.sequences import let, tokenize
from seqloom.operators import ordered as O
from seqloom.operators.storage import State
from seqloom.operators.windows import take_until

#: Draws of a step, and ranks x runs of a bucket of drawn ranks, that are held at once.
DRAWN_CELLS = 1 << 22


def seeded_key(key: Column, seed) -> Column:
    return F.sha1(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def seeded_int(key: Column, seed) -> Column:
    """Non-negative integer below 2^32 from the key and the seed."""
    return F.conv(F.left(seeded_key(key, seed), F.lit(8)), 16, 10).cast("bigint")


def holdout_groups(df: DataFrame, group: str, frac: float, seed) -> DataFrame:
    """Whole groups in seeded order until max(1, round(frac x rows)) rows are reached."""
    sizes = df.groupBy(group).agg(F.count("*").alias("n")).withColumn("_k", seeded_key(F.col(group), seed))
    target = df.agg(F.greatest(F.bround(F.count("*") * F.lit(frac)), F.lit(1.0))).scalar()
    return take_until(sizes, "n", ["_k", group], target).select(group)


def group_holdout(df: DataFrame, group: str, frac: float = 0.1, seed=2026) -> DataFrame:
    """Adds `split`: 'test' for held-out groups, else 'train'."""
    held = holdout_groups(df, group, frac, seed).withColumn("_held", F.lit(True))
    out = df.join(held, group, "left")
    return out.withColumn("split", F.when(F.col("_held"), "test").otherwise("train")).drop("_held")


def random_split(df: DataFrame, key: str, ratio: float = 0.95, seed=0) -> DataFrame:
    """Adds `split`: the first int(n x ratio) rows in seeded order are 'train'."""
    total = df.agg(F.floor(F.count("*") * F.lit(ratio))).scalar()
    at = O.running(df.withColumn("_k", seeded_key(F.col(key), seed)), ["_k", key], index="_i")
    return at.withColumn("split", F.when(F.col("_i") < total, "train").otherwise("test")).drop("_k", "_i")


def shuffled_pool(df: DataFrame, key: str, seed=0, valid: Column = None) -> DataFrame:
    """Rows in seeded order; invalid ones are skipped."""
    kept = df.where(valid) if valid is not None else df
    return kept.orderBy(seeded_key(F.col(key), seed), key)


def _picked(candidates: Column, key: Column, seed, n: Column) -> Column:
    """n of the candidate positions in seeded order."""
    ranked = F.array_sort(
        F.transform(candidates, lambda i: F.struct(F.xxhash64(key, F.lit(str(seed)), i).alias("h"), i.alias("i")))
    )
    return F.transform(F.slice(ranked, F.lit(1), n), lambda x: x["i"])


def _flags(picked: Column, size: Column) -> Column:
    """Boolean array from sorted positions, by gaps between neighbours (linear)."""
    none = lambda n: F.array_repeat(F.lit(False), n)

    def build(p):
        runs = F.transform(
            p, lambda x, i: F.concat(none(x - F.coalesce(F.get(p, i - 1), F.lit(-1)) - 1), F.array(F.lit(True)))
        )
        last = F.coalesce(F.try_element_at(p, F.lit(-1)), F.lit(-1))
        return F.concat(F.flatten(runs), none(size - last - 1))

    return let(F.array_sort(picked), build)


def order_agnostic_mask(
    df: DataFrame, key: str, sequence: str = "sequence", fixed: str = None, from_free: bool = True, seed=0
) -> DataFrame:
    """Adds tgt, src (token arrays), mask (booleans), n_masked.

    A step t is drawn from [1, D), D the length, and D - t + 1 positions are masked. `from_free`
    draws them from the positions that are not `fixed`, at most all of them; otherwise they are
    drawn from all and the fixed ones are unmasked afterwards.
    """
    size = F.size("tgt")
    base = df.withColumn("tgt", tokenize(F.col(sequence)))
    t = F.when(size > 1, F.pmod(seeded_int(F.col(key), seed), size - 1) + 1).otherwise(F.lit(1))
    base = base.withColumn("_n", (size - t + 1).cast("int"))
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    frozen = F.col(fixed) if fixed else F.array_repeat(F.lit(False), size)
    base = base.withColumn("_fixed", frozen)
    free = F.filter(every, lambda i: ~F.get("_fixed", i)) if from_free else every
    base = base.withColumn("_p", _picked(free, F.col(key), seed, F.col("_n")))
    mask = _flags(F.col("_p"), size)
    base = base.withColumn("mask", F.zip_with(mask, "_fixed", lambda m, f: m & ~f))
    src = F.zip_with("tgt", "mask", lambda x, m: F.when(m, F.lit(K.TOKEN_MASK)).otherwise(x))
    masked = F.size(F.filter("mask", lambda m: m))
    return base.withColumns({"src": src, "n_masked": masked}).drop("_n", "_p", "_fixed")


def bert_mask(df: DataFrame, key: str, sequence: str = "sequence", p: float = 0.15, seed=0) -> DataFrame:
    """floor(L p) positions: 80 % masked, 10 % replaced by a random residue, the rest unchanged.

    Adds tgt, src and `action` (0 untouched, 1 masked, 2 replaced, 3 kept) per position.
    """
    size = F.size("tgt")
    base = df.withColumn("tgt", tokenize(F.col(sequence))).withColumn("_n", F.floor(size * F.lit(p)).cast("int"))
    every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    base = base.withColumn("_p", _picked(every, F.col(key), seed, F.col("_n")))
    m, r = F.floor(F.col("_n") * 0.8).cast("int"), F.floor(F.col("_n") * 0.1).cast("int")
    base = base.withColumns({
        "_m": _flags(F.slice("_p", F.lit(1), m), size), "_r": _flags(F.slice("_p", m + 1, r), size), "_t": _flags(F.col("_p"), size)
    })
    action = F.zip_with(
        F.zip_with("_m", "_r", lambda a, b: F.when(a, 1).when(b, 2).otherwise(0)), "_t",
        lambda x, touched: F.when(touched & (x == 0), 3).otherwise(x),
    )
    base = base.withColumn("action", action)
    random_residue = lambda i: F.pmod(F.xxhash64(F.col(key), F.lit(f"{seed}r"), i), F.lit(20)).cast("int")
    src = F.transform(
        F.arrays_zip("tgt", "action"),
        lambda z, i: F.when(z["action"] == 1, F.lit(K.TOKEN_MASK)).when(z["action"] == 2, random_residue(i)).otherwise(z["tgt"]),
    )
    return base.withColumn("src", src).drop("_n", "_p", "_m", "_r", "_t")


def resample(df: DataFrame, value: str, runs: int, order: list, seed=0, poisson: bool = False) -> DataFrame:
    """(run, value, w): bootstrap samples. Exact: n draws with replacement per run, by rank; draws travel as four bytes each
    to the bucket of the rank drawn, which hands on a row for each run and value in it. `poisson` gives every row a
    Poisson(1) weight per run instead, which needs no join."""
    each = F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run")
    if poisson:
        u = (F.pmod(F.xxhash64(*order, "run", F.lit(str(seed))), F.lit(2**52)) + 0.5) / float(2**52)
        rows = df.select(*order, F.col(value).alias("value"), each)
        total, term, w = 0.0, 2.718281828459045**-1, F.lit(0)
        for i in range(1, 19):
            total += term
            w = w + F.when(u > total, 1).otherwise(0)
            term /= i
        return rows.select("run", "value", w.alias("w")).where("w > 0")
    ranked = State(O.running(df.select(*order, F.col(value).alias("value")), order, index="_i").select("_i", "value"), "ranks").df
    n, kind = ranked.count(), dict(ranked.dtypes)["value"]
    width = max(1, DRAWN_CELLS // runs)
    tails = [f"|{run}|{seed}".encode() for run in range(runs)]

    def draw(batches):
        """The draws of some ranks, packed by buckets of the drawn ranks: rank in the bucket x runs + run."""
        step = max(1, DRAWN_CELLS // 8 // runs)
        for batch in batches:
            ranks = batch.column(0).to_pylist()
            for at in range(0, len(ranks), step):
                some = [b"%d" % i for i in ranks[at : at + step]]
                # 60 bits of a digest, so that every rank of a table of any size can be drawn.
                digests = b"".join([hashlib.sha1(i + t).digest()[:8] for i in some for t in tails])
                drawn = ((np.frombuffer(digests, ">u8") >> np.uint64(4)) % np.uint64(n)).astype(np.int64)
                bucket = drawn // width
                cell = ((drawn - bucket * width) * runs + np.tile(np.arange(runs), len(some))).astype(np.uint32)
                by = np.argsort(bucket, kind="stable")
                found, first = np.unique(bucket[by], return_index=True)
                cells = [c.tobytes() for c in np.split(cell[by], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(cells, pa.binary())], names=["b", "cells"])

    def weigh(key, draws, rows):
        flat = np.frombuffer(b"".join(draws.column("cells").to_pylist()), np.uint32)
        weights = np.bincount(flat, minlength=width * runs).reshape(-1, runs)
        values = rows.column("value").combine_chunks().dictionary_encode("encode")
        code = values.indices.to_numpy(zero_copy_only=False)
        by = np.argsort(code, kind="stable")
        own = weights[rows.column("_i").to_numpy()[by] % width]
        total = np.add.reduceat(own, np.flatnonzero(np.diff(code[by], prepend=-1))) if len(by) else own
        at, run = np.nonzero(total)
        return pa.table({"run": pa.array(run.astype(np.int32)), "value": values.dictionary.take(pa.array(at)), "w": pa.array(total[at, run].astype(np.int32))})

    # The work grows with draws, not bytes.
    cores = df.sparkSession.sparkContext.defaultParallelism
    draws = ranked.select("_i").repartition(4 * cores).mapInArrow(draw, "b long, cells binary")
    rows = ranked.select("_i", "value", F.floor(F.col("_i") / width).cast("long").alias("b"))
    return draws.groupBy("b").cogroup(rows.groupBy("b")).applyInArrow(weigh, f"run int, value {kind}, w int")


def bootstrap(df: DataFrame, value: str, order: list, runs: int = 100, seed=0, poisson: bool = False) -> DataFrame:
    """One row: bootstrap mean and median, their standard errors and 95 % intervals."""
    s = resample(df, value, runs, order, seed, poisson)
    # Draws are made once.
    s = State(s.groupBy("run", "value").agg(F.sum("w").alias("w")), "draws").df
    means = s.groupBy("run").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("mean"))
    counted = s.groupBy("run", F.col("value").cast("double").alias("value")).agg(F.sum("w").alias("n"))
    upto = O.running(counted, ["value"], ["run"], {"upto": "n"}, "_i")
    upto = upto.join(counted.groupBy("run").agg(F.sum("n").alias("_all")), "run")
    at = lambda r: F.max(F.when((F.col("upto") - F.col("n") <= r) & (r < F.col("upto")), F.col("value")))
    mid = (F.col("_all") - 1) / 2
    medians = upto.groupBy("run").agg(((at(F.floor(mid)) + at(F.ceil(mid))) / 2).alias("median"))
    both = means.join(medians, "run")
    # `runs` rows are left; their percentiles are plain aggregates.
    ci = lambda c, p: F.percentile(c, F.lit(p))
    return both.agg(
        *[x for c in ("mean", "median") for x in (
            F.avg(c).alias(c), F.stddev_pop(c).alias(f"{c}_se"), ci(c, 0.025).alias(f"{c}_low"), ci(c, 0.975).alias(f"{c}_high")
        )]
    )


def bootstrap_counts(df: DataFrame, value: str, order: list, runs: int = 100, seed=0) -> DataFrame:
    """Per outcome: mean and standard deviation of its count over the runs (missing counts are 0)."""
    s = resample(df, value, runs, order, seed)
    per = s.groupBy("run", "value").agg(F.sum("w").alias("c"))
    c, c2 = F.sum("c") / runs, F.sum(F.col("c") * F.col("c")) / runs
    return per.groupBy("value").agg(c.alias("mean"), F.sqrt(F.greatest(c2 - c * c, F.lit(0.0))).alias("std"))


def run_grid(df: DataFrame, seeds: list, temperatures: list) -> DataFrame:
    """Every row once per (temperature, seed) with the subgroup label."""
    grid = F.array(*[
        F.struct(F.lit(float(t)).alias("temperature"), F.lit(int(s)).alias("seed"), F.lit(f"Temp{t}_Seed{s}").alias("subgroup"))
        for t in temperatures for s in seeds
    ])
    return df.withColumn("_g", F.explode(grid)).select(*df.columns, "_g.*")


def subgroup_summary(df: DataFrame, scores: list) -> DataFrame:
    return df.groupBy("temperature", "seed", "subgroup").agg(
        F.count("*").alias("n"), *[F.avg(s).alias(s) for s in scores]
    )
