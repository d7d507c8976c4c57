"""Grouped and global aggregates. Order statistics work on counts of distinct values (see `ordered`)."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seqloom import constants as K
from seqloom.functions.sequences import letters
from seqloom.operators import ordered as O
from seqloom.operators.storage import cut_lineage


def join_distinct(x: Column) -> Column:
    """Sorted distinct non-empty values joined by '|'."""
    return F.array_join(F.array_sort(F.collect_set(F.when(x != "", x))), "|")


def potency(um_min: Column) -> Column:
    return -F.log10(um_min)


def aggregate_activity(df: DataFrame, key: str = "sequence") -> DataFrame:
    """Per sequence: potency, min and median micromolar, record count, distinct metrics, units, sources.

    The input is read once, into counts of distinct (key, value, metric, unit, source) rows; all else comes from these,
    so that a sequence with very many records stays small.
    """
    counts = cut_lineage(df.groupBy(key, "um", "metric", "unit", "database").agg(F.count("*").alias("n")))
    median = O.quantiles(counts, "um", {"activity_uM_median": 0.5}, [key], count="n")
    base = counts.groupBy(key).agg(
        F.min("um").alias("activity_uM_min"), F.sum("n").alias("activity_records"),
        join_distinct(F.col("metric")).alias("activity_metrics"), join_distinct(F.col("unit")).alias("activity_units"),
        join_distinct(F.col("database")).alias("databases"),
    )
    return (
        O.join_on(base, median, [key]).withColumn("value", potency(F.col("activity_uM_min")))
        .select(key, "value", "activity_uM_min", "activity_uM_median", "activity_records", "activity_metrics",
                "activity_units", "databases")
    )


def summarize_metrics(df: DataFrame, columns: list) -> DataFrame:
    """Long table (metric, n, mean, std, median, min, max); nulls and NaN dropped, booleans as 0/1.

    A column without values keeps its row with n = 0. The median is exact; only values near it are shuffled.
    """
    doubles = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in columns]
    wide = df.select(*doubles)
    parts = [
        F.struct(F.lit(c).alias("metric"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
        for c in columns
    ]
    base = wide.agg(F.array(*parts).alias("r")).select(F.inline("r"))
    near = O.bracketed(wide, columns, 0.5).withColumnRenamed("column", "metric")
    median = O.quantiles(near, "value", {"median": 0.5}, ["metric"], count="n")
    return (
        base.join(median, "metric", "left").withColumn("median", O.at_quantile("median", "min", "max"))
        .select("metric", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "median", "min", "max")
    )


def rate_row(df: DataFrame, flag: str, name: str) -> DataFrame:
    """Extra summary row: the share of true flags."""
    null = F.lit(None).cast("double")
    return df.agg(F.count(flag).alias("n"), F.avg(F.col(flag).cast("double")).alias("mean")).select(
        F.lit(name).alias("metric"), "n", "mean",
        *[null.alias(c) for c in ("std", "median", "min", "max")],
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def overlap_counts(df: DataFrame, cluster: str, split: str) -> DataFrame:
    """Number of clusters shared by every pair of splits, in one pass over distinct (cluster, split)."""
    sets = df.select(cluster, split).distinct().groupBy(cluster).agg(F.array_sort(F.collect_set(split)).alias("s"))
    pairs = sets.where(F.size("s") > 1).select(
        F.explode(
            F.flatten(
                F.transform(
                    "s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))
                )
            )
        ).alias("p")
    )
    return pairs.groupBy(F.col("p.a").alias("split_a"), F.col("p.b").alias("split_b")).agg(F.count("*").alias("shared"))


def group_mean_vs_baseline(df: DataFrame, group: str, scores: list, baseline: str) -> DataFrame:
    """Mean per group and score with its difference to the baseline group; a reason where one is missing."""
    long = df.select(group, *[F.col(c).cast("double").alias(c) for c in scores]).unpivot([group], scores, "score", "v")
    means = long.groupBy(group, "score").agg(F.avg("v").alias("mean"))
    base = means.where(F.col(group) == baseline).select("score", F.col("mean").alias("base"))
    out = means.join(base, "score", "left")
    reason = F.when(F.col("mean").isNull(), "no score").when(F.col("base").isNull(), "no baseline").otherwise("ok")
    return out.select(group, "score", "mean", (F.col("mean") - F.col("base")).alias("improvement"), reason.alias("status"))


def improvement_table(df: DataFrame, group: str, scores: list, baseline: str) -> DataFrame:
    """Wide form: one row per group, mean and improvement per score, and a `type` column."""
    long = group_mean_vs_baseline(df, group, scores, baseline)
    wide = long.groupBy(group).pivot("score", scores).agg(
        F.first("mean").alias("mean"), F.first("improvement").alias("improvement")
    )
    return wide.withColumn("type", F.when(F.col(group) == baseline, "baseline").otherwise("variant"))


def _moments(df: DataFrame, columns: list, ref: DataFrame = None) -> dict:
    """Mean and population deviation per column as one scalar row."""
    src = ref if ref is not None else df
    stats = src.agg(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).alias("s")
    ).scalar()
    return {c: (stats.getField(f"m_{c}"), stats.getField(f"s_{c}")) for c in columns}


def balance_index(df: DataFrame, charge: str = "net_charge", gravy: str = "gravy", name: str = "balance_index") -> DataFrame:
    """Logistic of the difference of z-scores; null if a deviation is zero."""
    m = _moments(df, [charge, gravy])
    z = {c: (F.col(c) - m[c][0]) / F.nullif(m[c][1], F.lit(0.0)) for c in (charge, gravy)}
    return df.withColumn(name, 1 / (1 + F.exp(-(z[charge] - z[gravy]))))


def desirability(df: DataFrame, columns: list, ref: DataFrame = None, name: str = "desirability") -> DataFrame:
    """Geometric mean of Gaussian terms around the reference; columns without spread are skipped.

    A null property makes the result null, as a product with a missing term is missing.
    """
    used = [c for c in columns if c in df.columns and (ref is None or c in ref.columns)]
    m = _moments(df, used, ref)
    total, k = F.lit(0.0), F.lit(0)
    for c in used:
        on = F.coalesce(m[c][1] > 0, F.lit(False))
        total = total + F.when(on, -0.5 * F.pow((F.col(c) - m[c][0]) / m[c][1], F.lit(2.0))).otherwise(0.0)
        k = k + F.when(on, 1).otherwise(0)
    return df.withColumn(name, F.when(k > 0, F.exp(total / k)))


def ensemble_hit(
    df: DataFrame, scorers: list, hemolysis: str = "hemolysis_score",
    activity: float = K.ACTIVITY_HIT, limit: float = K.HEMOLYSIS_HIT,
) -> DataFrame:
    """Row mean over the available scorer columns and the dual-hit flag; missing values never hit."""
    present = F.filter(F.array(*[F.col(c) for c in scorers]), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x)
    mean = F.when(F.size(present) > 0, total / F.size(present))
    hit = (F.col("activity_mean_score") >= activity) & (F.col(hemolysis) < limit)
    return df.withColumn("activity_mean_score", mean).withColumn("dual_hit", F.coalesce(hit, F.lit(False)))


def column_stats(df: DataFrame, value: str, order: str, by: list = (), weight: str = None) -> DataFrame:
    """count, nulls, sum, mean, std, std_error, min/max and the first `order` key at each.

    The deviation divides by n-1 only above 100 values, by n below, and is 0 for one value.
    The weighted deviation is taken around the unweighted mean.
    """
    x, n = F.col(value), F.count(value)
    std = F.when(n > 100, F.stddev_samp(x)).when(n > 1, F.stddev_pop(x)).otherwise(0.0)
    aggs = [
        n.alias("count"), F.count_if(x.isNull()).alias("nulls"), F.sum(x).alias("sum"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"), std.alias("std"), (std / F.sqrt(n)).alias("std_error"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.min_by(order, F.when(x.isNotNull(), F.struct(x, F.col(order)))).alias("min_at"),
        F.min_by(order, F.when(x.isNotNull(), F.struct(-x, F.col(order)))).alias("max_at"),
    ]
    if weight:
        w = F.when(x.isNotNull(), F.col(weight))
        sw, swx, swx2 = F.sum(w), F.sum(w * x), F.sum(w * x * x)
        mean = F.avg(x)
        aggs += [
            (swx / sw).alias("weighted_mean"),
            F.sqrt(F.greatest((swx2 - 2 * mean * swx + mean * mean * sw) / sw, F.lit(0.0))).alias("weighted_std"),
        ]
    return df.groupBy(*by).agg(*aggs)


def unique_in_order(df: DataFrame, column: str, order: list, split_at: str = None) -> DataFrame:
    """Distinct values ranked by first appearance; `split_at` is a regex that cuts each value first."""
    keys = [c for c in order]
    if split_at:
        rows = df.select(*keys, F.posexplode(F.split(column, split_at)).alias("_at", "value"))
        keys = keys + ["_at"]
    else:
        rows = df.select(*keys, F.col(column).alias("value"))
    first = rows.where(F.col("value") != "").groupBy("value").agg(F.min(F.struct(*keys)).alias("_f"))
    flat = first.select("value", *[F.col(f"_f.{k}").alias(f"_k{i}") for i, k in enumerate(keys)])
    order_cols = [f"_k{i}" for i in range(len(keys))]
    return O.running(flat, order_cols, index="rank").select("value", "rank")


def mask_stats(df: DataFrame, mask: str, fixed: str) -> DataFrame:
    """One row over boolean mask / fixed arrays of equal length."""
    on = lambda c: F.size(F.filter(c, lambda x: x))
    counted = df.select(on(mask).alias("m"), on(fixed).alias("f"), F.size(fixed).alias("n"))
    share = lambda c: F.avg((F.col(c) == 0).cast("double"))
    return counted.agg(
        F.avg("m").alias("masked_per_seq"), share("m").alias("zero_mask_fraction"),
        (F.sum("f") / F.sum("n")).alias("fixed_fraction"), share("f").alias("no_fixed_fraction"),
        F.avg("f").alias("fixed_per_seq"), F.avg(F.greatest("n", F.lit(1))).alias("seq_len"),
    )


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    """Weighted mean and deviation, 1/sum of weights, Cochran standard error of the weighted mean."""
    x, w = F.col(value), F.col(weight)
    first = df.agg(
        F.struct(F.avg(w).alias("wbar"), (F.sum(x * w) / F.sum(w)).alias("mu")).alias("s")
    ).scalar()
    wbar, mu = first.getField("wbar"), first.getField("mu")
    d, e = w * x - wbar * mu, w - wbar
    n, su = F.count(w), F.sum(w)
    inner = F.sum(d * d) - 2 * F.max(mu) * F.sum(e * d) + F.max(mu) * F.max(mu) * F.sum(e * e)
    return df.agg(
        (F.sum(x * w) / su).alias("mean"), F.sqrt(F.sum(w * (x - mu) * (x - mu)) / su).alias("std"),
        (1 / su).alias("variance"), F.sqrt(n / ((n - 1) * su * su) * inner).alias("std_error"),
    )


def weights_from_errors(df: DataFrame, error: str, name: str = "weight") -> DataFrame:
    """1/e^2; errors that are not positive count as a tenth of the smallest positive one."""
    smallest = df.agg(F.min(F.when(F.col(error) > 0, F.col(error)))).scalar()
    e = F.when(F.col(error) > 0, F.col(error)).otherwise(smallest / 10)
    return df.withColumn(name, 1 / (e * e))


def combo_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Class by class counts with margins; `level` tells margin rows (bit set) from null classes."""
    return df.cube(a, b).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


def length_info(df: DataFrame, ranges: list, key: str = "name", aligned: str = "aligned") -> DataFrame:
    """Ungapped length overall and per column range (first, last)."""
    bare = lambda c: F.length(F.replace(c, F.lit(K.GAP), F.lit("")))
    return df.select(
        key, bare(F.col(aligned)).alias("length"),
        *[bare(F.substring(aligned, a, b - a + 1)).alias(f"cdr{i}") for i, (a, b) in enumerate(ranges, 1)],
    )


def histogram(df: DataFrame, value: str, bins: int = None, weight: str = None) -> DataFrame:
    """Equal bins from min to max, the top edge in the last one, empty bins kept; default count is sqrt(n)."""
    x = F.col(value)
    w = F.col(weight) if weight else F.lit(1.0)
    s = df.where(x.isNotNull()).agg(
        F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n"), F.sum(w).alias("w")).alias("s")
    ).scalar()
    lo, hi = s.getField("lo"), s.getField("hi")
    k = F.lit(bins) if bins else F.floor(F.sqrt(s.getField("n")))
    step = (hi - lo) / k
    b = F.least(F.floor((x - lo) / step), k - 1)
    counted = df.where(x.isNotNull()).groupBy(b.cast("bigint").alias("bin")).agg(F.sum(w).alias("count"))
    grid = df.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), (k - 1).cast("bigint"))).alias("bin"),
        lo.alias("lo"), step.alias("step"), s.getField("w").alias("total"),
    )
    c = F.coalesce("count", F.lit(0.0))
    return grid.join(counted, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("left_edge"), c.alias("count"),
        (c / (F.col("total") * F.col("step"))).alias("density"),
    )


def curve_summary(df: DataFrame, by: list, columns: list) -> DataFrame:
    """Mean and interpolated quartiles of every column per group, long form."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(by), columns, "curve", "v")
    keys = [*by, "curve"]
    means = long.groupBy(*keys).agg(F.avg("v").alias("mean"))
    return means.join(O.quantiles(long, "v", {"q25": 0.25, "q75": 0.75}, keys), keys)


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def melt(df: DataFrame, ids: list, columns: list, name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def transpose(df: DataFrame, index: str) -> DataFrame:
    """Rows become columns; for small summary tables."""
    return df.transpose(F.col(index))


def substitution_events(pairs: DataFrame, key: str = "pair_id", a: str = "input_sequence", b: str = "generated_sequence") -> DataFrame:
    """Changed standard positions up to the shorter length: (pair, 1-based position, from, to)."""
    zipped = F.arrays_zip(letters(F.col(a)).alias("x"), letters(F.col(b)).alias("y"))
    rows = pairs.select(key, F.posexplode(zipped).alias("_p", "_z")).select(
        key, (F.col("_p") + 1).alias("position_1based"), F.col("_z.x").alias("input_residue"), F.col("_z.y").alias("generated_residue")
    )
    ok = lambda c: F.col(c).rlike(f"^[{K.RESIDUES}]$")
    changed = rows.where(ok("input_residue") & ok("generated_residue") & (F.col("input_residue") != F.col("generated_residue")))
    return changed.withColumn("substitution", F.concat_ws("->", "input_residue", "generated_residue"))


def substitution_matrix(events: DataFrame) -> DataFrame:
    """Long 20 x 20 table of counts and of shares of all events; zero cells kept."""
    counts = events.groupBy("input_residue", "generated_residue").agg(F.count("*").alias("count"))
    total = events.agg(F.count("*")).scalar()
    aa = F.array(*[F.lit(c) for c in K.RESIDUES])
    grid = events.sparkSession.range(1).select(F.explode(aa).alias("input_residue"), aa.alias("_b"))
    grid = grid.select("input_residue", F.explode("_b").alias("generated_residue"))
    c = F.coalesce("count", F.lit(0))
    return grid.join(counts, ["input_residue", "generated_residue"], "left").select(
        "input_residue", "generated_residue", c.alias("count"),
        F.coalesce(c / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("frequency"),
    )


def substitution_counters(pairs: DataFrame, a: str = "input_sequence", b: str = "generated_sequence") -> DataFrame:
    x, y = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    empty = (x == "") | (y == "")
    std = lambda c: c.rlike(f"^[{K.RESIDUES}]$")
    zipped = F.filter(
        F.arrays_zip(letters(x).alias("x"), letters(y).alias("y")),
        lambda z: F.coalesce(std(z["x"]) & std(z["y"]), F.lit(False)),
    )
    per = pairs.select(
        empty.alias("e"), (~empty & (F.length(x) != F.length(y))).alias("u"), F.size(zipped).alias("c"),
        F.size(F.filter(zipped, lambda z: z["x"] == z["y"])).alias("s"),
    )
    total = lambda c: F.sum(c).cast("bigint")
    return per.agg(
        F.count("*").alias("n_pairs"), F.count_if("e").alias("n_empty"), F.count_if("u").alias("n_length_mismatched"),
        total("c").alias("n_compared"), total("s").alias("n_unchanged"), (total("c") - total("s")).alias("n_events"),
    )


def invert_map(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.groupBy(value).agg(F.max_by(key, order).alias(key))


def position_quantile(df: DataFrame, value: str, probs: dict, by: list = ()) -> DataFrame:
    """Value at rank floor((n-1)p), without interpolation."""
    return O.quantiles(df, value, probs, by, interpolate=False)


def stack(frames: list) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
