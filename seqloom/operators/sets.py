"""Set operations, de-duplication, sorting, top-k."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from seqloom.functions.sequences import stable_key


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def vstack(a: DataFrame, b: DataFrame, key: str, overwrite: bool = False) -> DataFrame:
    """Keyed append of tables with one row per key: rows of `a` win unless `overwrite`."""
    keep, add = (b, a) if overwrite else (a, b)
    return keep.unionByName(add.join(keep.select(key), key, "left_anti").select(*keep.columns))


def intersect_all(frames: list, column: str) -> DataFrame:
    """Values present in every frame, in one pass over their union."""
    tagged = reduce(lambda a, b: a.union(b), [f.select(column, F.lit(i).alias("_i")) for i, f in enumerate(frames)])
    hits = tagged.distinct().groupBy(column).agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == len(frames)).select(column)


def except_sets(pool: DataFrame, sets: list, key: str) -> DataFrame:
    used = reduce(lambda a, b: a.union(b), [s.select(key) for s in sets])
    return pool.join(used, key, "left_anti")


def membership_table(df: DataFrame, element: str, group: str) -> DataFrame:
    """Cells of a Venn diagram: the exact set of groups holding an element, with its size.

    (element, group) is made distinct first, so an element repeated in one hot group is one row.
    """
    return (
        df.select(element, group).distinct().groupBy(element)
        .agg(F.array_join(F.array_sort(F.collect_set(group)), ",").alias("members"))
        .groupBy("members").agg(F.count("*").alias("n"))
    )


def drop_duplicates(df: DataFrame, keys: list, order: list, keep: str = "first") -> DataFrame:
    """First or last row per key in an explicit order, by aggregation (no window per key)."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    best = df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, "r.*").select(*df.columns)


def canonical_order(df: DataFrame, sequence: str = "sequence", cluster: str = None) -> DataFrame:
    """(length, sha1) order; test sets put the cluster first."""
    keys = [F.length(sequence), stable_key(F.col(sequence))]
    return df.orderBy(*([cluster] if cluster else []), *keys)


def sort_by(df: DataFrame, column: str, reverse: bool = False) -> DataFrame:
    return df.orderBy(F.col(column).desc() if reverse else F.col(column).asc())


def sort_columns(df: DataFrame, keep_first: int = 1) -> DataFrame:
    return df.select(*df.columns[:keep_first], *sorted(df.columns[keep_first:]))


def first_n(df: DataFrame, n: int, order: list) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_k_hit(scores, truth, k: int):
    """True if fewer than k classes score above the true class (0-based index into `scores`)."""
    mine = F.element_at(scores, truth + 1)
    return F.size(F.filter(scores, lambda x: x > mine)) < k
