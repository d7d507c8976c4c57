"""Order-dependent work without one-task windows.

Positions, running sums and neighbour values over a long order are computed in two levels: rows
are cut into buckets along the order, each bucket is scanned by its own task, and the bucket
totals (at most `buckets` rows per group) carry the state across. A group holding most of the
rows is therefore spread over all buckets.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom.operators.storage import cut_lineage

#: Up to so many cut points are compared as a tree of conditions; more would make the generated code too large.
CASE_LIMIT = 32


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def bucket_count(spark) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_on(left: DataFrame, right: DataFrame, keys: list, how: str = "inner") -> DataFrame:
    """Equi-join on key columns in which null equals null; the keys come from the left side."""
    keys = list(keys)
    named = right.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    if not keys:
        return left.crossJoin(named)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    return left.join(named, same, how).drop(*[f"_key{i}" for i in range(len(keys))])


def cut_points(df: DataFrame, order: list, buckets: int) -> list:
    """Ordering keys that cut `df` into about equal buckets.

    Taken from a hash-ordered sample of at most 20 keys per bucket; they only steer the balance,
    never the result. Few rows need no cut.
    """
    keys = [_col(c).alias(f"k{i}") for i, c in enumerate(order)]
    size = 20 * buckets
    sample = df.select(*keys).orderBy(F.xxhash64(*[f"k{i}" for i in range(len(keys))])).limit(size).collect()
    if len(sample) < size:
        return []
    ordered = sorted(sample)
    points = [tuple(ordered[i * len(ordered) // buckets]) for i in range(1, buckets)]
    return sorted(set(points))


def bucket_of(order: list, points: list) -> Column:
    """Index of the bucket of a row: the number of cut points at or below its key, by binary search.

    A few points become a tree of comparisons; many are searched in a literal array, which keeps
    the generated code small.
    """
    key = F.struct(*[_col(c).alias(f"k{i}") for i, c in enumerate(order)])
    bounds = [F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(p)]) for p in points]
    if len(points) > CASE_LIMIT:
        steps = len(points).bit_length()
        # Once the search is closed `mid` may point one past the end, hence a repeated last bound.
        listed = F.array(*bounds, bounds[-1])

        def halve(acc, _):
            mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
            left = acc["k"] < F.element_at(listed, mid + 1)
            open_ = acc["lo"] < acc["hi"]
            return F.struct(
                acc["k"].alias("k"), F.when(open_ & ~left, mid + 1).otherwise(acc["lo"]).alias("lo"),
                F.when(open_ & left, mid).otherwise(acc["hi"]).alias("hi"),
            )

        start = F.struct(key.alias("k"), F.lit(0).alias("lo"), F.lit(len(points)).alias("hi"))
        return F.aggregate(F.array(*[F.lit(i) for i in range(steps)]), start, halve, lambda acc: acc["lo"])

    def search(lo, hi):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key < bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(points))


def running(
    df: DataFrame, order: list, by: list = (), sums: dict = None, index: str = "idx",
    max_before: dict = None, points: list = None,
) -> DataFrame:
    """Add the 0-based position `index`, inclusive running sums, and the running maxima of all
    earlier rows (`max_before`), per `by` in `order`. `points` reuses known cut points.

    `order` must be a total order of non-null values; null `by` values are a group of their own.
    """
    sums, peaks, by = sums or {}, max_before or {}, list(by)
    if points is None:
        points = cut_points(df, order, bucket_count(df.sparkSession))
    ordering = [_col(c) for c in order]
    cut = df.withColumn("_b", bucket_of(order, points))
    here = Window.partitionBy(*by, "_b").orderBy(*ordering)
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn(index, (F.row_number().over(here) - 1).cast("bigint")).withColumns(
        {name: F.sum(_col(c)).over(upto) for name, c in sums.items()}
        | {name: F.max(_col(c)).over(here.rowsBetween(Window.unboundedPreceding, -1)) for name, c in peaks.items()}
    )
    if not points:  # one bucket: nothing to carry
        return local.drop("_b")
    totals = cut.groupBy(*by, "_b").agg(
        F.count("*").alias("_n"), *[F.sum(_col(c)).alias(f"_s_{name}") for name, c in sums.items()],
        *[F.max(_col(c)).alias(f"_m_{name}") for name, c in peaks.items()],
    )
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        *by, "_b",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_s_{n}") for n in sums],
        *[F.max(f"_m_{n}").over(before).alias(f"_m_{n}") for n in peaks],
    )
    out = join_on(local, shift, [*by, "_b"])
    return out.select(
        *df.columns,
        (F.col(index) + F.col("_n")).alias(index),
        *[(F.col(n) + F.col(f"_s_{n}")).alias(n) for n in sums],
        *[F.greatest(n, f"_m_{n}").alias(n) for n in peaks],
    )


def neighbours(df: DataFrame, order: list, columns: dict, by: list = (), points: list = None) -> DataFrame:
    """Add the value of the previous / next row: {new name: (column, "prev" | "next")}.

    Edge rows of each bucket carry their values to the next bucket that has rows of the group.
    Rows without a neighbour get null.
    """
    by = list(by)
    if points is None:
        points = cut_points(df, order, bucket_count(df.sparkSession))
    ordering = [_col(c) for c in order]
    cut = df.withColumn("_b", bucket_of(order, points))
    here = Window.partitionBy(*by, "_b").orderBy(*ordering)
    fn = {"prev": F.lag, "next": F.lead}
    local = cut.withColumns(
        {name: fn[way](_col(c)).over(here) for name, (c, way) in columns.items()}
        | {"_first": F.row_number().over(here) == 1, "_last": F.lead(F.lit(1)).over(here).isNull()}
    )
    if not points:
        return local.drop("_b", "_first", "_last")
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ordering)])
    edges = cut.groupBy(*by, "_b").agg(
        *[
            (F.max_by if way == "prev" else F.min_by)(F.struct(_col(c).alias("v")), key).alias(f"_e_{name}")
            for name, (c, way) in columns.items()
        ]
    )
    across = Window.partitionBy(*by).orderBy("_b")
    edges = edges.select(
        *by, "_b", *[fn[way](f"_e_{name}").over(across).alias(f"_e_{name}") for name, (_, way) in columns.items()]
    )
    out = join_on(local, edges, [*by, "_b"])
    return out.select(
        *df.columns,
        *[
            F.when(F.col("_first" if way == "prev" else "_last"), F.col(f"_e_{name}.v"))
            .otherwise(F.col(name)).alias(name)
            for name, (_, way) in columns.items()
        ],
    )


def carry(df: DataFrame, order: list, columns: dict, by: list = (), points: list = None) -> DataFrame:
    """Add the nearest non-null value before ("back") or after ("ahead") each row, itself included."""
    by = list(by)
    if points is None:
        points = cut_points(df, order, bucket_count(df.sparkSession))
    ordering = [_col(c) for c in order]
    cut = df.withColumn("_b", bucket_of(order, points))
    here = Window.partitionBy(*by, "_b").orderBy(*ordering)

    def scan(c, way, w, strict):
        if way == "back":
            return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -strict))
        return F.first(c, ignorenulls=True).over(w.rowsBetween(strict, Window.unboundedFollowing))

    local = cut.withColumns({name: scan(_col(c), way, here, 0) for name, (c, way) in columns.items()})
    if not points:
        return local.drop("_b")
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ordering)])
    edges = cut.groupBy(*by, "_b").agg(
        *[
            (F.max_by if way == "back" else F.min_by)(_col(c), F.when(_col(c).isNotNull(), key)).alias(f"_e_{name}")
            for name, (c, way) in columns.items()
        ]
    )
    across = Window.partitionBy(*by).orderBy("_b")
    edges = edges.select(
        *by, "_b",
        *[scan(F.col(f"_e_{name}"), way, across, 1).alias(f"_e_{name}") for name, (_, way) in columns.items()],
    )
    out = join_on(local, edges, [*by, "_b"])
    return out.select(
        *df.columns, *[F.coalesce(name, f"_e_{name}").alias(name) for name in columns]
    )


def with_margin(df: DataFrame, index: str, chunk: int, margin: int) -> DataFrame:
    """Copy rows near a chunk border into the neighbour chunk, so that a frame of +-`margin` rows
    is complete inside one chunk. A chunk is at least as long as the margin, so a row goes to its own
    and the two next to it. Adds `_chunk` and `_core` (true for the row's own chunk)."""
    chunk = max(chunk, margin)
    own = F.floor(F.col(index) / chunk)
    copies = F.array_distinct(
        F.array(own, F.floor((F.col(index) - margin) / chunk), F.floor((F.col(index) + margin) / chunk))
    )
    return (
        df.withColumn("_own", own)
        .withColumn("_chunk", F.explode(copies))
        .withColumn("_core", F.col("_chunk") == F.col("_own"))
        .drop("_own")
    )


#: Distinct values of a group that are ranked in one window; if a group has more, all are cut into buckets by value.
GROUP_VALUES = 1 << 16


def counted_values(df: DataFrame, value, by: list = (), count: str = None) -> DataFrame:
    """Distinct values per group with their count `n` (the sum of `count`, if rows stand for many)."""
    times = F.col(count) if count else F.lit(1)
    counted = (
        df.select(*by, _col(value).cast("double").alias("value"), times.cast("bigint").alias("_times")).where(F.col("value").isNotNull())
        .groupBy(*by, "value").agg(F.sum("_times").alias("n"))
    )
    # Read several times below: stored once, so that the input is not computed again each time.
    return cut_lineage(counted)


def upto_values(counted: DataFrame, by: list = ()) -> DataFrame:
    """Adds the cumulative count `upto` to counted values."""
    by = list(by)
    small = by and (counted.groupBy(*by).count().agg(F.max("count")).collect()[0][0] or 0) <= GROUP_VALUES
    return running(counted, ["value"], by, {"upto": "n"}, "_i", points=[] if small else None).drop("_i")


def ranked_values(df: DataFrame, value, by: list = (), count: str = None) -> DataFrame:
    """Distinct values per group with their count `n` (the sum of `count`, if rows stand for many) and cumulative
    count `upto`."""
    return upto_values(counted_values(df, value, list(by), count), by)


def quantiles(df: DataFrame, value, probs: dict, by: list = (), interpolate: bool = True, count: str = None) -> DataFrame:
    """Exact quantiles per group, one column per name in `probs`.

    Works on counts of distinct values, so no group is ever collected. `interpolate=True` is linear
    interpolation between ranks; False takes the value at rank floor((n-1)p).
    """
    by = list(by)
    counted = counted_values(df, value, by, count)
    ranked = upto_values(counted, by)
    if by:
        ranked = join_on(ranked, counted.groupBy(*by).agg(F.sum("n").alias("_total")), by)
    else:
        ranked = ranked.withColumn("_total", counted.agg(F.sum("n")).scalar())

    def at(rank):
        inside = (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(inside, F.col("value")))

    out = []
    for name, p in probs.items():
        rank = (F.col("_total") - 1) * F.lit(float(p))
        low = F.floor(rank)
        if not interpolate:
            out.append(at(low).alias(name))
            continue
        part = F.max(rank - low)
        lo, hi = at(low), at(F.ceil(rank))
        out.append((lo + (hi - lo) * part).alias(name))
    grouped = ranked.groupBy(*by) if by else ranked.groupBy()
    return grouped.agg(*out)


#: Relative rank error of the sketch that brackets a quantile.
SKETCH_ERROR = 0.001


def bracketed(df: DataFrame, columns: list, p: float) -> DataFrame:
    """(column, value, n): counts of the double `columns` from which `quantiles` gives the exact quantile `p` of each.

    A mergeable sketch of each column gives two values around the quantile; rows below and above count as infinite
    ones, so that of a column only the values between them are shuffled, about 4 `SKETCH_ERROR` of all, and one row a
    partition for the rest. Nulls don't count. The sketch's rank error is at most half the room left on either side, so
    the quantile lies inside; `at_quantile` raises an error rather than give an infinite value that isn't in the data.
    """
    room = 2 * SKETCH_ERROR
    sides = [max(0.0, p - room), min(1.0, p + room)]
    bounds = df.agg(F.struct(*[
        F.struct(
            (F.percentile_approx(c, F.lit(sides[0]), F.lit(round(1 / SKETCH_ERROR))) if sides[0] else F.min(c)).alias("lo"),
            (F.percentile_approx(c, F.lit(sides[1]), F.lit(round(1 / SKETCH_ERROR))) if sides[1] < 1 else F.max(c)).alias("hi"),
        ).alias(f"_{i}") for i, c in enumerate(columns)
    ])).scalar()
    far = lambda c, b: F.when(F.col(c) < b["lo"], float("-inf")).when(F.col(c) > b["hi"], float("inf")).otherwise(F.col(c))
    cut = df.withColumn("_q", bounds).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), far(c, F.col("_q")[f"_{i}"]).alias("value")) for i, c in enumerate(columns)
    ])))
    return cut.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count("*").alias("n"))


def at_quantile(value: str, low: str, high: str) -> Column:
    """`value`, checked: it must lie between the column's own least and greatest value (NaN: between two infinite ones)."""
    infinite = F.greatest(F.abs(low), F.abs(high)) == float("inf")
    outside = ((F.col(value) < F.col(low)) | (F.col(value) > F.col(high))) & ~(F.isnan(value) & infinite)
    return F.when(outside, F.raise_error(F.lit("a sketch missed its quantile"))).otherwise(F.col(value))


def union_all(frames: list) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
