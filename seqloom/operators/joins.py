"""Joins: lookups, caches, column-wise merges, nearest keys, blocked products."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from seqloom.operators import ordered as O


def with_master(activity: DataFrame, master: DataFrame) -> DataFrame:
    """Evidence rows of known sequences with the attributes of the master record."""
    return activity.join(master, "sequence")


def attach_cluster(df: DataFrame, clusters: DataFrame, key: str = "sequence") -> DataFrame:
    """Cluster id by key; a row without a cluster is its own singleton."""
    found = clusters.select(key, F.col("cluster_id").alias("_c"))
    return df.join(found, key, "left").withColumn("cluster_id", F.coalesce("_c", key)).drop("_c")


def exclude(pool: DataFrame, held_out: DataFrame, sets: list, cluster: str = "cluster_id", key: str = "sequence") -> DataFrame:
    """Pool rows outside the held-out clusters and outside every given set of keys."""
    out = pool.join(held_out.select(cluster).distinct(), cluster, "left_anti")
    used = reduce(lambda a, b: a.union(b), [s.select(key) for s in sets])
    return out.join(used, key, "left_anti").select(*pool.columns)


def sample_with_parent(samples: DataFrame, parents: DataFrame, name: str = "name", marker: str = "_human_sample_") -> DataFrame:
    """Each sample with the columns of its parent (prefixed `parent_`); samples without one are dropped."""
    renamed = parents.select(*[F.col(c).alias(f"parent_{c}") for c in parents.columns])
    keyed = samples.withColumn("_p", F.substring_index(name, marker, 1))
    return keyed.join(renamed, keyed["_p"] == renamed[f"parent_{name}"]).drop("_p")


def variant_table(generated: DataFrame, seeds: DataFrame, seed_name: str, constants: dict) -> DataFrame:
    """Generated rows with the sequence of their seed ('' if absent) and constant run columns."""
    named = seeds.select(F.col("name").alias(seed_name), F.col("sequence").alias("seed_sequence"))
    out = generated.join(named, seed_name, "left")
    return out.withColumn("seed_sequence", F.coalesce("seed_sequence", F.lit(""))).withColumns(
        {k: F.lit(v) for k, v in constants.items()}
    )


def fill_from_cache(pending: DataFrame, done: DataFrame, cache: DataFrame, name: str, keys: list, value: str) -> tuple:
    """(filled, still pending): rows not yet done whose every key column hits the cache.

    `cache` has one row per `seq`; the filled rows carry `{key}_{value}` per key column.
    """
    out = pending.join(done.select(name), name, "left_anti")
    for k in keys:
        hit = cache.select(F.col("seq").alias(k), F.col(value).alias(f"{k}_{value}"))
        out = out.join(hit, k, "left")
    full = reduce(lambda a, b: a & b, [F.col(f"{k}_{value}").isNotNull() for k in keys])
    return out.where(full), out.where(~full).drop(*[f"{k}_{value}" for k in keys])


def upsert_cache(cache: DataFrame, new: DataFrame, order: str, key: str = "seq") -> DataFrame:
    """One row per key; the row with the highest `order` wins."""
    rest = [c for c in cache.columns if c not in (key, order)]
    both = cache.unionByName(new.select(*cache.columns))
    last = both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"), F.max(order).alias(order))
    return last.select(key, "r.*", order)


def assert_complete(df: DataFrame, scores: list) -> DataFrame:
    """Raises while running if a row still lacks a score."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in scores])
    checked = F.when(missing, F.raise_error(F.lit("scoring is incomplete")).cast("double"))
    return df.withColumn(scores[0], F.coalesce(checked, F.col(scores[0]).cast("double")))


def _renamed(a: DataFrame, b: DataFrame, on: list) -> DataFrame:
    clash = {c for c in b.columns if c in a.columns and c not in on}
    return b.select(*[F.col(c).alias(f"{c}_2" if c in clash else c) for c in b.columns])


def hstack(a: DataFrame, b: DataFrame, on: list) -> DataFrame:
    """Column-wise concatenation by key: all rows of `a`, null where `b` has none; a clashing name gets the suffix _2."""
    return a.join(_renamed(a, b, on), on, "left")


def zip_columns(a: DataFrame, b: DataFrame, order_a: list, order_b: list) -> DataFrame:
    """Column-wise concatenation by rank in an explicit order of each side; the shorter side is filled with null."""
    left = O.running(a, order_a, index="_row")
    right = O.running(_renamed(a, b, []), [f"{c}_2" if c in a.columns else c for c in order_b], index="_row")
    return left.join(right, "_row", "full").drop("_row")


def merge_on(a: DataFrame, b: DataFrame, left_on: str, right_on: str, order: str, ignore_case: bool = False) -> DataFrame:
    """Left join keeping `a`; of several matches only the first by `order`; misses give nulls."""
    fold = F.lower if ignore_case else (lambda c: c)
    rest = [c for c in b.columns if c != right_on]
    first = b.groupBy(fold(F.col(right_on)).alias("_k")).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    named = first.select("_k", *[F.col(f"_r.{c}").alias(f"{c}_2" if c in a.columns else c) for c in rest])
    return a.withColumn("_k", fold(F.col(left_on))).join(named, "_k", "left").drop("_k")


def nearest_join(
    a: DataFrame, b: DataFrame, key: str, id_a: str, id_b: str, by: list = (), warn_percent: float = 5.0, once: bool = False
) -> DataFrame:
    """For every row of `a` the row of `b` with the nearest numeric key (the smaller on a tie).

    Both neighbours come from one ordered scan over the union. `off` flags a difference above
    `warn_percent` of the key. `once` keeps each `b` row only for its nearest `a` row.
    """
    by = list(by)
    mark = F.struct(F.col(key).cast("double").alias("k"), F.col(id_b).alias("i"))
    left = a.select(*by, F.col(key).cast("double").alias("key"), F.col(id_a).alias(id_a), F.lit(None).cast("struct<k:double,i:bigint>").alias("b"))
    right = b.select(*by, F.col(key).cast("double").alias("key"), F.lit(None).cast("bigint").alias(id_a), mark.cast("struct<k:double,i:bigint>").alias("b"))
    both = left.unionByName(right).withColumn(
        "_tie", F.struct(F.col("key"), F.coalesce(F.col("b.i"), F.lit(-1)).alias("i"), F.coalesce(id_a, F.lit(-1)).alias("a"))
    )
    order = ["key", "_tie.i", "_tie.a"]
    flat = both.select(*by, "key", id_a, "b", F.col("_tie.i").alias("_i"), F.col("_tie.a").alias("_a"))
    scanned = O.carry(flat, ["key", "_i", "_a"], {"below": ("b", "back"), "above": ("b", "ahead")}, by)
    below, above = F.abs(F.col("key") - F.col("below.k")), F.abs(F.col("above.k") - F.col("key"))
    pick = F.when(F.col("above").isNull() | (below <= above), F.col("below")).otherwise(F.col("above"))
    out = scanned.where(F.col(id_a).isNotNull()).select(*by, id_a, "key", pick.alias("b"))
    out = out.select(
        *by, id_a, "key", F.col("b.i").alias(id_b), F.col("b.k").alias("nearest"),
        (F.abs(F.col("key") - F.col("b.k")) * 100 > F.abs(F.col("key")) * warn_percent).alias("off"),
    )
    if once:
        rank = F.struct(F.abs(F.col("key") - F.col("nearest")), F.col(id_a))
        best = out.groupBy(id_b).agg(F.min_by(F.struct(*[c for c in out.columns if c != id_b]), rank).alias("r"))
        out = best.select("r.*", id_b).select(*out.columns)
    return out


def product(a: DataFrame, b: DataFrame, blocks: int) -> DataFrame:
    """All combinations of two tables as an equi-join: rows of `b` are spread over `blocks`, each
    row of `a` visits every block. The result is as large as the product; use it for grids and
    for comparisons against a reference set."""
    left = a.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = b.withColumn("_block", F.pmod(F.xxhash64(*b.columns), F.lit(blocks)).cast("int"))
    return left.join(right, "_block").drop("_block")


def position_join(frames: dict, key: list, width_key: str = "aligned") -> DataFrame:
    """Aligned texts of equal width joined per (key, position): {column name: frame with key + aligned}."""
    names = list(frames)
    joined = reduce(
        lambda x, y: x.join(y, key), [f.select(*key, F.col(width_key).alias(n)) for n, f in frames.items()]
    )
    return explode_positions(joined, key, names)


def explode_positions(df: DataFrame, key: list, columns: list) -> DataFrame:
    """One row per position of equally wide text columns, positions from 1, without a shuffle."""
    zipped = F.arrays_zip(*[F.split(c, "").alias(c) for c in columns])
    out = df.select(*key, F.posexplode(zipped).alias("_p", "_z"))
    return out.select(
        *key, (F.col("_p") + 1).cast("bigint").alias("pos"), *[F.col(f"_z.{c}").alias(c) for c in columns]
    ).where(reduce(lambda a, b: a | b, [F.coalesce(F.col(c), F.lit("")) != "" for c in columns]))


def route_by_type(df: DataFrame, tables: dict, type_col: str, key: str) -> DataFrame:
    """Score table chosen by type: one join on (type, key) instead of one pass per type."""
    tagged = reduce(lambda x, y: x.unionByName(y), [t.withColumn(type_col, F.lit(k)) for k, t in tables.items()])
    return df.join(tagged, [type_col, key], "left")


def first_contained(df: DataFrame, text: str, terms: list, mode: str = "contains") -> DataFrame:
    """First term in list order that the text contains / starts with / ends with; null if none.

    `longest` goes on scanning and replaces the match unless the new term is part of it.
    """
    tests = {"contains": F.contains, "begins": F.startswith, "ends": F.endswith}
    listed = F.array(*[F.lit(t) for t in terms])
    if mode == "longest":
        hit = F.aggregate(
            listed, F.lit(None).cast("string"),
            lambda acc, t: F.when(
                F.contains(F.col(text), t) & (acc.isNull() | ~F.contains(acc, t)), t
            ).otherwise(acc),
        )
    else:
        hit = F.try_element_at(F.filter(listed, lambda t: tests[mode](F.col(text), t)), F.lit(1))
    return df.withColumn("term", hit)
