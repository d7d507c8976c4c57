"""Order-based operators. Long series are scanned in buckets or chunks (see `ordered`)."""

from pyspark.sql import DataFrame, Window, functions as F

from seqloom.operators import ordered as O
from seqloom.operators.storage import cut_lineage

CHUNK = 4096


def windowed_metrics(df: DataFrame, series: list, order: list, values: list, n: int, partial: bool = True) -> DataFrame:
    """Mean of each value over consecutive blocks of n steps; `partial` keeps an unfinished last block."""
    at = O.running(df, order, series, index="_i")
    out = at.groupBy(*series, F.floor(F.col("_i") / n).alias("window")).agg(
        F.count("*").alias("steps"), *[F.avg(v).alias(v) for v in values]
    )
    return out if partial else out.where(F.col("steps") == n)


def take_until(df: DataFrame, size: str, order: list, target) -> DataFrame:
    """Whole rows in order until the running sum of `size` reaches the target, the crossing row included."""
    t = F.lit(target) if isinstance(target, (int, float)) else target
    summed = O.running(df, order, sums={"_upto": size}, index="_i")
    return summed.where(F.col("_upto") - F.col(size) < t).drop("_upto", "_i")


def smooth(df: DataFrame, series: list, order: list, value: str, k: int = 3, weight: str = None, fill_single: bool = False) -> DataFrame:
    """Centred mean over +-k neighbours, shorter at the ends; the weighted form is 0 where weights sum to 0.

    Missing values are taken out before and put back as null, or, with `fill_single`, as the mean
    of the two smoothed neighbours.
    """
    x = F.nanvl(F.col(value), F.lit(None).cast("double"))
    clean = df.withColumn("_x", x)
    at = O.running(clean.where(F.col("_x").isNotNull()), order, series, index="_i")
    wide = O.with_margin(at, "_i", CHUNK, k)
    frame = Window.partitionBy(*series, "_chunk").orderBy("_i").rowsBetween(-k, k)
    if weight:
        total = F.sum(weight).over(frame)
        mean = F.when(total == 0, 0.0).otherwise(F.sum(F.col("_x") * F.col(weight)).over(frame) / total)
    else:
        mean = F.avg("_x").over(frame)
    done = wide.withColumn("smoothed", mean).where("_core").drop("_i", "_x", "_chunk", "_core")
    missing = clean.where(F.col("_x").isNull()).drop("_x").withColumn("smoothed", F.lit(None).cast("double"))
    out = done.unionByName(missing)
    if fill_single:
        sides = O.neighbours(out, order, {"_p": ("smoothed", "prev"), "_n": ("smoothed", "next")}, series)
        out = sides.withColumn("smoothed", F.coalesce("smoothed", (F.col("_p") + F.col("_n")) / 2)).drop("_p", "_n")
    return out


def contiguous_regions(df: DataFrame, series: list, order: list, flag: str) -> DataFrame:
    """(start, end) index pairs of runs of true, end excluded."""
    at = O.running(df, order, series, {"_t": F.col(flag).cast("int")}, "_i")
    runs = at.where(flag).groupBy(*series, (F.col("_i") - F.col("_t")).alias("_g"))
    return runs.agg(F.min("_i").alias("start"), (F.max("_i") + 1).alias("end")).drop("_g")


def contiguous_split(df: DataFrame, series: list, value: str) -> DataFrame:
    """Runs of consecutive integers as (first, last, n)."""
    at = O.running(df, [value], series, index="_i")
    runs = at.groupBy(*series, (F.col(value) - F.col("_i")).alias("_g"))
    return runs.agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("_g")


def merge_ranges(df: DataFrame, series: list, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching ranges merged; an island starts where no earlier range reaches.

    Ranges are merged inside buckets of the order first, in one pass over the input; only what is left of them is merged
    across buckets.
    """
    rows = df.select(*series, start, end)
    points = O.cut_points(rows, [start, end], O.bucket_count(df.sparkSession))
    opened = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), F.col(start))
    here = Window.partitionBy(*series, "_b").orderBy(start, end)
    before, upto = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_b", O.bucket_of([start, end], points)).withColumn("_reach", F.max(end).over(before))
    local = local.withColumn("_from", F.last(opened, ignorenulls=True).over(upto)).groupBy(*series, "_b", "_from").agg(F.max(end).alias(end))
    local = local.select(*series, F.col("_from").alias(start), end)
    if not points:  # one bucket, so all is merged
        return local
    local = cut_lineage(local)
    reach = O.running(local, [start, end], series, max_before={"_reach": end}, index="_i", points=points)
    held = O.carry(reach.withColumn("_open", opened), [start, end], {"_from": ("_open", "back")}, series, points)
    return held.groupBy(*series, "_from").agg(F.max(end).alias(end)).withColumnRenamed("_from", start)


def ecdf(df: DataFrame, value: str, by: list = (), weight: str = None) -> DataFrame:
    """Distinct values with the cumulative share of rows (or of weight)."""
    by = list(by)
    w = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(w.alias("w"))
    summed = O.running(counted, [value], by, {"_upto": "w"}, "_i")
    if by:
        total = counted.groupBy(*by).agg(F.sum("w").alias("_all"))
        summed = O.join_on(summed, total, by)
    else:
        summed = summed.withColumn("_all", counted.agg(F.sum("w")).scalar())
    return summed.select(*by, value, (F.col("_upto") / F.col("_all")).alias("cdf"))


def index_cdf(df: DataFrame, value: str, order: list) -> DataFrame:
    """Index form: position / N for every row."""
    total = df.agg(F.count("*")).scalar()
    return O.running(df, [value, *order], index="_i").withColumn("cdf", F.col("_i") / total).drop("_i")


def bin_column(df: DataFrame, value: str, n: int = None, reverse: bool = False, add: int = 0, name: str = None) -> DataFrame:
    """Bin over n equally spaced edges from min to max; reverse ranks from the top."""
    x = F.col(value)
    s = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).alias("s")).scalar()
    k = F.lit(n) if n else F.floor(F.sqrt(s.getField("n")))
    lo, hi = s.getField("lo"), s.getField("hi")
    b = F.when(x >= hi, k - 1).otherwise(F.floor((x - lo) * (k - 1) / (hi - lo)))
    return df.withColumn(name or f"bin_{value}", ((k - 1 - b if reverse else b) + add).cast("bigint"))


def derivative(df: DataFrame, series: list, x: str, y: str) -> DataFrame:
    """Slope to the next point at the middle of both; `sign_change` flags a flip of the sign of y."""
    nxt = O.neighbours(df, [x], {"_x2": (x, "next"), "_y2": (y, "next")}, series)
    rows = nxt.where(F.col("_x2").isNotNull())
    return rows.select(
        *series, ((F.col("_x2") + F.col(x)) / 2).alias("mid"),
        ((F.col("_y2") - F.col(y)) / F.nullif(F.col("_x2") - F.col(x), F.lit(0))).alias("slope"),
        (F.signum(F.col("_y2")) != F.signum(F.col(y))).alias("sign_change"),
    )


def row_ids(df: DataFrame, order: list, prefix: str = "seq_", name: str = "row_id") -> DataFrame:
    """Ids in total order, from 0."""
    return O.running(df, order, index="_i").withColumn(name, F.concat(F.lit(prefix), F.col("_i"))).drop("_i")


def best_candidate(df: DataFrame, group: list, score: str, order: str) -> DataFrame:
    """Row with the highest score per group, the first by `order` on ties."""
    rest = [c for c in df.columns if c not in group]
    best = df.groupBy(*group).agg(F.min_by(F.struct(*rest), F.struct(-F.col(score), F.col(order))).alias("r"))
    return best.select(*group, "r.*").select(*df.columns)


def unique_names(df: DataFrame, name: str, order: list) -> DataFrame:
    """If any name repeats, all names get a __row suffix with the zero-based row number."""
    repeated = df.agg(F.count(name) > F.countDistinct(name)).scalar()
    at = O.running(df, order, index="_i")
    suffixed = F.concat(F.col(name), F.lit("__row"), F.lpad(F.col("_i").cast("string"), F.greatest(F.lit(4), F.length(F.col("_i").cast("string"))), F.lit("0")))
    return at.withColumn(name, F.when(repeated, suffixed).otherwise(F.col(name))).drop("_i")


def peak_region(df: DataFrame, series: list, order: list, value: str, min_change: float = 7.0, flat: float = 0.02) -> DataFrame:
    """(first, last) positions around the first maximum, per series.

    Walking away from the maximum, the region ends where the value has changed by `min_change`
    percent and the slope flips, or is flat twice in a row (then one step earlier). Each side's
    end is the first such position, so no walk is needed.
    """
    at = O.running(df, order, series, index="pos")
    near = O.neighbours(at, ["pos"], {"_l": (value, "prev"), "_r": (value, "next")}, series)
    y = F.col(value)
    slope = F.when(F.col("_l").isNull(), F.col("_r") - y).when(F.col("_r").isNull(), y - F.col("_l")).otherwise(
        (F.col("_r") - F.col("_l")) / 2
    )
    sloped = near.withColumn("_d", slope)
    top = sloped.groupBy(*series).agg(
        F.max(y).alias("_top"), F.max(F.abs("_d")).alias("_steep"),
        F.min_by("pos", F.struct(-y, F.col("pos"))).alias("_at"), F.max("pos").alias("_end"),
    )
    rel = O.join_on(sloped, top, list(series)).withColumn("_d", F.col("_d") / F.col("_steep"))
    side = O.neighbours(rel, ["pos"], {"_dp": ("_d", "prev"), "_dn": ("_d", "next")}, series)
    changed = 100 * F.abs((y - F.col("_top")) / F.col("_top")) > min_change
    out, keys = {}, [*series, "_at", "_end"]
    for way, inner, beyond in (("last", "_dp", F.col("pos") > F.col("_at")), ("first", "_dn", F.col("pos") < F.col("_at"))):
        step = F.abs(F.col("pos") - F.col("_at"))
        old = F.when(step == 1, 0.0).otherwise(F.col(inner))
        flat_twice = (F.abs("_d") < flat) & (F.abs(old) < flat)
        stop = beyond & changed & ((F.col("_d") * old < 0) | flat_twice)
        cut = F.when(stop, F.struct(step.alias("s"), flat_twice.alias("f")))
        out[way] = F.min(cut).alias(f"_{way}")
    ends = side.groupBy(*keys).agg(*out.values())
    reach = lambda w, full: F.coalesce(
        F.greatest(F.col(f"_{w}.s") - 1 - F.col(f"_{w}.f").cast("int"), F.lit(0)), full
    )
    return ends.select(
        *series, F.col("_at").alias("peak"),
        (F.col("_at") - reach("first", F.col("_at"))).alias("first"),
        (F.col("_at") + reach("last", F.col("_end") - F.col("_at"))).alias("last"),
    )


def order_check(df: DataFrame, series: list, order: list, value: str, tolerance: float = 0.0) -> DataFrame:
    """Per series: sorted, strictly sorted, all equal, equal within the tolerance."""
    near = O.neighbours(df, order, {"_p": (value, "prev")}, series)
    x, p = F.col(value), F.col("_p")
    return near.groupBy(*series).agg(
        F.coalesce(F.bool_and(x >= p), F.lit(True)).alias("is_sorted"),
        F.coalesce(F.bool_and(x > p), F.lit(True)).alias("is_strict"),
        (F.min(x) == F.max(x)).alias("all_equal"), (F.max(x) - F.min(x) <= tolerance).alias("nearly_equal"),
    )


def split_in(df: DataFrame, k: int, order: list, by: list = ()) -> DataFrame:
    """`part` 0..k-1 of k nearly equal consecutive chunks, the first ones one longer."""
    by = list(by)
    at = O.running(df, order, by, index="_i")
    if by:
        at = O.join_on(at, df.groupBy(*by).agg(F.count("*").alias("_n")), by)
    else:
        at = at.withColumn("_n", df.agg(F.count("*")).scalar())
    every, rem = F.floor(F.col("_n") / k), F.col("_n") % k
    long = rem * (every + 1)
    part = F.when(F.col("_i") < long, F.floor(F.col("_i") / (every + 1))).otherwise(rem + F.floor((F.col("_i") - long) / every))
    return at.withColumn("part", part.cast("bigint")).drop("_i", "_n")


def split_every(df: DataFrame, n: int, order: list, by: list = ()) -> DataFrame:
    return O.running(df, order, by, index="_i").withColumn("part", F.floor(F.col("_i") / n)).drop("_i")
