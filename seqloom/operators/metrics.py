"""Classification and sample statistics, exact and distributed."""

from pyspark.sql import Column, DataFrame, functions as F

from seqloom.operators import ordered as O


def confusion_metrics(tp: Column, fp: Column, tn: Column, fn: Column) -> list:
    """Precision, balanced accuracy, Matthews correlation as aliased columns."""
    d = lambda a, b: a / F.nullif(b, F.lit(0))
    c = lambda x: x.cast("double")
    tp, fp, tn, fn = c(tp), c(fp), c(tn), c(fn)
    mcc = d(tp * tn - fp * fn, F.sqrt((tp + fp) * (tn + fn) * (tp + fn) * (tn + fp)))
    return [
        d(tp, tp + fp).alias("precision"), ((d(tp, tp + fn) + d(tn, tn + fp)) / 2).alias("balanced_accuracy"),
        mcc.alias("mcc"),
    ]


def _by_score(df: DataFrame, truth: str, score: str, weight: str = None, by: list = ()) -> DataFrame:
    """Distinct scores with cumulative positives and negatives from the highest score down."""
    by = list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    pos = F.sum(F.when(F.col(truth) == 1, w).otherwise(0.0)).alias("p")
    neg = F.sum(F.when(F.col(truth) == 1, 0.0).otherwise(w)).alias("n")
    counted = df.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(*by, score).agg(pos, neg)
    desc = counted.withColumn("_d", -F.col(score).cast("double"))
    return O.running(desc, ["_d"], by, {"tp": "p", "fp": "n"}, "_i").drop("_d", "_i")


def roc(df: DataFrame, truth: str, score: str, by: list = ()) -> DataFrame:
    """ROC points (score, tpr, fpr) from the highest score down; rates are null without a class."""
    by = list(by)
    pts = _by_score(df, truth, score, None, by)
    ends = pts.groupBy(*by).agg(F.sum("p").alias("_P"), F.sum("n").alias("_N"))
    if by:
        pts = pts.join(ends, by)
    else:
        e = ends.agg(F.struct(F.max("_P").alias("p"), F.max("_N").alias("n")).alias("s")).scalar()
        pts = pts.withColumns({"_P": e.getField("p"), "_N": e.getField("n")})
    z = lambda c: F.nullif(F.col(c), F.lit(0.0))
    return pts.select(
        *by, score, (F.col("tp") / z("_P")).alias("tpr"), (F.col("fp") / z("_N")).alias("fpr"),
        (F.col("p") / z("_P")).alias("d_tpr"), (F.col("n") / z("_N")).alias("d_fpr"),
    )


def auc(df: DataFrame, truth: str, score: str, by: list = ()) -> DataFrame:
    """Area under the ROC curve and the score nearest to the corner (0, 1).

    A trapezoid ends at a point and is d_fpr wide, so the previous point is (fpr - d_fpr, tpr - d_tpr).
    """
    pts = roc(df, truth, score, by)
    area = F.sum(F.col("d_fpr") * (F.col("tpr") - F.col("d_tpr") / 2))
    far = F.pow(F.col("fpr"), F.lit(2.0)) + F.pow(1 - F.col("tpr"), F.lit(2.0))
    return pts.groupBy(*by).agg(area.alias("auc"), F.min_by(score, F.struct(far, -F.col(score))).alias("threshold"))


def precision_recall(df: DataFrame, truth: str, score: str, weight: str = None) -> DataFrame:
    pts = _by_score(df, truth, score, weight)
    total = pts.agg(F.sum("p")).scalar()
    return pts.select(
        score, (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        (F.col("tp") / F.nullif(total, F.lit(0.0))).alias("recall"), (F.col("p") / F.nullif(total, F.lit(0.0))).alias("d_recall"),
    )


def average_precision(df: DataFrame, truth: str, score: str, weight: str = None) -> DataFrame:
    """Step-wise average precision and the base rate."""
    base = df.agg(F.avg(F.col(truth).cast("double"))).scalar()
    return precision_recall(df, truth, score, weight).agg(
        F.sum(F.col("d_recall") * F.col("precision")).alias("average_precision"), F.max(base).alias("base_rate")
    )


def paired_errors(df: DataFrame, a: str, b: str, by: list = ()) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.groupBy(*by).agg(
        F.corr(a, b).alias("pearson"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmsd")
    )


def absolute_deviations(df: DataFrame, value: str, by: list = ()) -> DataFrame:
    """Median absolute deviation and mean absolute deviation per group."""
    by = list(by)
    x = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x"))
    centre = O.quantiles(x, "_x", {"_med": 0.5}, by)
    mean = x.groupBy(*by).agg(F.avg("_x").alias("_avg"))
    if by:
        both = x.join(centre, by).join(mean, by)
    else:
        both = x.withColumns({"_med": centre.scalar(), "_avg": mean.scalar()})
    both = both.withColumn("_d", F.abs(F.col("_x") - F.col("_med")))
    mad = O.quantiles(both, "_d", {"mad": 0.5}, by)
    dev = both.groupBy(*by).agg(F.avg(F.abs(F.col("_x") - F.col("_avg"))).alias("mean_abs_dev"))
    return mad.join(dev, by) if by else dev.withColumn("mad", mad.scalar())


def masked_accuracy(pred: Column, truth: Column, mask: Column) -> list:
    """(correct, masked) counts of one row over its masked positions; sum both and divide."""
    z = F.arrays_zip(pred.alias("p"), truth.alias("t"), mask.alias("m"))
    masked = F.filter(z, lambda x: x["m"])
    return [F.size(F.filter(masked, lambda x: x["p"] == x["t"])).alias("correct"), F.size(masked).alias("masked")]


def masked_nll(df: DataFrame, prob: str, mask: str, length: str) -> DataFrame:
    """Mean -log p over masked positions, plain and weighted by length / masked count of the row.

    `prob` holds the probability of the true class per position; both are 0 when nothing is masked.
    """
    kept = F.filter(F.zip_with(prob, mask, lambda p, m: F.when(m, -F.log(p))), lambda x: x.isNotNull())
    per = df.select(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x).alias("s"), F.size(kept).alias("k"), F.col(length).alias("n"))
    weight = F.col("n") / F.greatest("k", F.lit(1))
    total = F.nullif(F.sum("k"), F.lit(0))
    return per.agg(
        F.coalesce(F.sum("s") / total, F.lit(0.0)).alias("nll"), F.coalesce(F.sum(F.col("s") * weight) / total, F.lit(0.0)).alias("reweighted")
    )


def macro_prf(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Macro precision, recall and F1 over the classes present in `truth`; 0 on division by zero."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    hit = F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0))
    support = pairs.groupBy(F.col("t").alias("c")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    predicted = pairs.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    per = support.join(predicted, "c", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    div = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    prec, rec = div(F.col("tp"), F.col("predicted")), div(F.col("tp"), F.col("support"))
    f1 = div(2 * F.col("tp"), F.col("predicted") + F.col("support"))
    return per.agg(F.avg(prec).alias("precision"), F.avg(rec).alias("recall"), F.avg(f1).alias("f1"))


def ovr_auc(df: DataFrame, truth: str, probs: str, classes: int, key: str) -> DataFrame:
    """Macro one-vs-rest AUC over renormalised class probabilities (array column)."""
    p = F.slice(probs, 1, classes)
    total = F.greatest(F.aggregate(p, F.lit(0.0), lambda a, x: a + x), F.lit(1e-9))
    rows = df.where(F.col(truth) < classes).select(truth, p.alias("_p"), total.alias("_s"))
    long = rows.select(truth, "_s", F.posexplode("_p").alias("cls", "_v"))
    long = long.select("cls", (F.col(truth) == F.col("cls")).cast("int").alias("y"), (F.col("_v") / F.col("_s")).alias("score"))
    return auc(long, "y", "score", ["cls"]).agg(F.avg("auc").alias("macro_auc"), F.count("auc").alias("classes"))


def chi_square(df: DataFrame, observed: str, expected: str, error: str = None) -> DataFrame:
    """Statistic, degrees of freedom and reduced value; G statistic beside it."""
    d = F.col(observed) - F.col(expected)
    term = d * d / (F.col(error) * F.col(error)) if error else d * d / F.col(expected)
    dof = F.count("*") - 1
    g = 2 * F.sum(F.when(F.col(observed) > 0, F.col(observed) * F.log(F.col(observed) / F.col(expected))).otherwise(0.0))
    return df.agg(F.sum(term).alias("chi2"), dof.alias("dof"), (F.sum(term) / dof).alias("reduced"), g.alias("g"))


def chi_square_p(statistic: Column, dof: int) -> Column:
    """Upper tail probability for an integer number of degrees of freedom, as a finite sum."""
    half = statistic / 2
    if dof % 2 == 0:
        terms, total = F.lit(1.0), F.lit(1.0)
        for i in range(1, dof // 2):
            terms = terms * half / i
            total = total + terms
        return F.exp(-half) * total
    # Odd: complementary error function plus a finite sum; erfc by its continued fraction is not
    # needed, the Gaussian tail comes from a Taylor / asymptotic split with error below 1e-7.
    x = F.sqrt(half)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    out = poly * F.exp(-half)
    term = F.sqrt(half / F.lit(3.141592653589793)) * 2 * F.exp(-half)
    for i in range((dof - 1) // 2):
        out = out + term
        term = term * half / (i + 1.5)
    return out


def separation(df: DataFrame, value: str, group: str, smaller, larger) -> DataFrame:
    """Logistic of 2 x median difference / larger IQR, minus half the overlapping fractions."""
    side = df.where(F.col(group).isin(smaller, larger)).select((F.col(group) == larger).alias("big"), F.col(value).alias("v"))
    q = O.quantiles(side, "v", {"q1": 0.25, "med": 0.5, "q3": 0.75}, ["big"])
    pick = lambda b: F.max(F.when(F.col("big") == b, F.struct("q1", "med", "q3")))
    s = q.agg(F.struct(pick(False).alias("s"), pick(True).alias("l")).alias("x")).scalar()
    lo, hi = s.getField("s"), s.getField("l")
    bad = F.when(F.col("big"), F.col("v") <= lo.getField("q3")).otherwise(F.col("v") >= hi.getField("q1"))
    frac = side.groupBy("big").agg(F.avg(bad.cast("double")).alias("bad")).agg(F.sum("bad")).scalar()
    iqr = F.greatest(hi.getField("q3") - hi.getField("q1"), lo.getField("q3") - lo.getField("q1"))
    gap = hi.getField("med") - lo.getField("med")
    return df.sparkSession.range(1).select(
        (1 / (1 + F.exp(-2 * gap / iqr)) - frac / 2).alias("efficiency"),
        lo.getField("med").alias("median_smaller"), hi.getField("med").alias("median_larger"),
    )


def vector_summary(df: DataFrame, value: str, by: list = (), low: float = -0.7, high: float = 0.7, coeff: float = 0.5) -> DataFrame:
    """Mean, n-1 deviation, max, min, sum, mean of positives, thresholded z-sum and z-score."""
    x = F.col(value)
    z = F.when(x < low, coeff * (x + low)).when(x > high, coeff * (x + high))
    zsum, zn = F.coalesce(F.sum(z), F.lit(0.0)), F.count(z)
    psum, pn = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.count_if(x > 0)
    return df.groupBy(*by).agg(
        F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.max(x).alias("max"), F.min(x).alias("min"),
        F.sum(x).alias("sum"), F.when(pn > 1, psum / pn).otherwise(psum).alias("mean_positive"),
        F.when(zn > 1, zsum / zn).otherwise(zsum).alias("z_score"), zsum.alias("z_sum"),
    )


def normalize(df: DataFrame, value: str, name: str = None) -> DataFrame:
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(name or value, F.col(value) / total)


def best_split(df: DataFrame, value: str, group: str, smaller, larger) -> DataFrame:
    """Threshold that leaves equal shares of both samples on their right side: (efficiency %, threshold).

    The line is the first value where the share of `smaller` at or below it reaches the share of
    `larger` above it; the efficiency is the mean of both shares there, 100 / 0 when disjoint.
    """
    side = df.where(F.col(group).isin(smaller, larger)).select((F.col(group) == larger).cast("int").alias("big"), F.col(value).alias("v"))
    counts = side.where(F.col("v").isNotNull()).groupBy("v").agg(
        F.sum(1 - F.col("big")).alias("s"), F.sum("big").alias("l")
    )
    run = O.running(counts, ["v"], sums={"us": "s", "ul": "l"}, index="_i")
    t = counts.agg(F.struct(F.sum("s").alias("s"), F.sum("l").alias("l")).alias("x")).scalar()
    below, above = F.col("us") / t.getField("s"), 1 - F.col("ul") / t.getField("l")
    at = F.when(F.round(below - above, 12) >= 0, F.struct("v", ((below + above) * 50).alias("e")))
    edge = side.agg(
        F.struct(
            F.min(F.when(F.col("big") == 1, F.col("v"))).alias("l0"), F.max(F.when(F.col("big") == 1, F.col("v"))).alias("l1"),
            F.min(F.when(F.col("big") == 0, F.col("v"))).alias("s0"), F.max(F.when(F.col("big") == 0, F.col("v"))).alias("s1"),
        ).alias("x")
    ).scalar()
    best = run.agg(F.min(at).alias("m")).select(F.col("m.e").alias("e"), F.col("m.v").alias("threshold"))
    eff = F.when(edge.getField("l0") > edge.getField("s1"), 100.0).when(edge.getField("l1") < edge.getField("s0"), 0.0)
    return best.select(eff.otherwise(F.col("e")).alias("efficiency"), "threshold")
