"""Column statistics of fixed-width alignments, on the long form (position, residue).

Frequencies are grouped counts with map-side combine; everything after them works on at most
width x 21 rows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqloom import constants as K
from seqloom.functions.sequences import letters
from seqloom.operators import aggregates as G

SYMBOLS = K.GAP + K.RESIDUES


def position_counts(df: DataFrame, aligned: str = "aligned", weight: str = None, by: list = ()) -> DataFrame:
    """Weighted count per (group, position, symbol) with the group total; zero cells kept."""
    by = list(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = df.select(*by, w.alias("w"), F.posexplode(letters(F.col(aligned))).alias("p", "aa"))
    counted = long.groupBy(*by, (F.col("p") + 1).alias("pos"), "aa").agg(F.sum("w").alias("c"))
    totals = df.groupBy(*by).agg(F.sum(w).alias("total"), F.max(F.length(aligned)).alias("width"))
    grid = totals.select(*by, "total", F.explode(F.sequence(F.lit(1), "width")).alias("pos"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(s) for s in SYMBOLS])).alias("aa"))
    return grid.join(counted, [*by, "pos", "aa"], "left").withColumn("c", F.coalesce("c", F.lit(0.0)))


def position_frequencies(
    df: DataFrame, aligned: str = "aligned", weight: str = None, pseudo: float = 1 / 20, by: list = ()
) -> DataFrame:
    """(pos, aa, freq, freq_no_gaps): gap and 20 residues. Each residue gets `pseudo` extra counts
    and the denominators 20 x pseudo; the gap row gets none. Other symbols are ignored."""
    by = list(by)
    counts = position_counts(df, aligned, weight, by)
    gap = F.max(F.when(F.col("aa") == K.GAP, F.col("c")))
    gaps = counts.groupBy(*by, "pos").agg(gap.alias("gaps"))
    extra = F.when(F.col("aa") == K.GAP, 0.0).otherwise(pseudo)
    filled = F.col("total") - F.col("gaps")
    bare = F.when((F.col("aa") != K.GAP) & (filled > 0), F.col("c") / (filled + 20 * pseudo)).otherwise(0.0)
    return counts.join(gaps, [*by, "pos"]).select(
        *by, "pos", "aa", ((F.col("c") + extra) / (F.col("total") + 20 * pseudo)).alias("freq"),
        bare.alias("freq_no_gaps"),
    )


def log_odds(freq: DataFrame, background: str = "auto") -> DataFrame:
    """log2(freq / background); background is the mean over positions or uniform. A zero background
    becomes a quarter of the smallest positive one, a zero frequency a tenth of the smallest."""
    if background == "uniform":
        n = freq.agg(F.countDistinct("aa")).scalar()
        back = freq.select("aa").distinct().withColumn("bg", 1 / n)
    else:
        back = freq.groupBy("aa").agg(F.avg("freq").alias("bg"))
    low = back.agg(F.min(F.when(F.col("bg") > 0, F.col("bg")))).scalar()
    back = back.withColumn("bg", F.when(F.col("bg") > 0, F.col("bg")).otherwise(low / 4))
    floor = back.agg(F.min("bg")).scalar()
    f = F.when(F.col("freq") > 0, F.col("freq")).otherwise(floor / 10)
    return freq.join(back, "aa").select("pos", "aa", F.log2(f / F.col("bg")).alias("log_odds"))


def conservation(freq: DataFrame) -> DataFrame:
    """Distance of a column from the overall residue distribution, gap row left out."""
    aa = freq.where(F.col("aa") != K.GAP)
    all_sum = aa.agg(F.sum("freq")).scalar()
    mean = aa.groupBy("aa").agg((F.sum("freq") / F.max(all_sum)).alias("mean"))
    d = F.col("freq") - F.col("mean")
    return aa.join(mean, "aa").groupBy("pos").agg(F.sqrt(F.sum(d * d)).alias("conservation"))


def _top(df: DataFrame, value: str) -> DataFrame:
    """Most frequent symbol per position; ties go to the first in symbol order."""
    rank = F.struct(-F.col(value), F.instr(F.lit(SYMBOLS), F.col("aa")))
    return df.groupBy("pos").agg(F.min_by("aa", rank).alias("aa"), F.max(value).alias(value))


def _as_text(df: DataFrame, symbol: Column) -> DataFrame:
    return df.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", symbol.alias("s")))), lambda x: x["s"]), "").alias("consensus")
    )


def consensus(freq: DataFrame) -> DataFrame:
    """One row: the most frequent symbol of every column."""
    return _as_text(_top(freq, "freq"), F.col("aa"))


def strict_consensus(df: DataFrame, aligned: str = "aligned") -> DataFrame:
    """Identical columns as is, at least half in lower case, else ',' with gaps and '*' without."""
    counts = position_counts(df, aligned)
    total = df.agg(F.count("*")).scalar()
    gaps = counts.groupBy("pos").agg(F.max(F.when(F.col("aa") == K.GAP, F.col("c"))).alias("gaps"))
    top = _top(counts, "c").join(gaps, "pos")
    symbol = (
        F.when(F.col("c") == total, F.col("aa")).when(F.col("c") >= total / 2, F.lower("aa"))
        .when(F.col("gaps") > 0, ",").otherwise("*")
    )
    return _as_text(top.withColumn("symbol", symbol), F.col("symbol"))


def top_residues(freq: DataFrame, k: int = 21) -> DataFrame:
    """Residues of every position by falling frequency (at most 21 rows per window)."""
    w = Window.partitionBy("pos").orderBy(F.desc("freq"), "aa")
    return freq.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def frequencies_by_query(freq: DataFrame, key_aligned: str, query: str = None) -> DataFrame:
    """Columns re-indexed to the gapless key sequence, or to a longer query: (idx, residue, pos).

    The key is one aligned text; query positions it does not cover have null columns.
    """
    placed = [(i + 1, c) for i, c in enumerate(key_aligned) if c != K.GAP]
    rows, n = [], 0
    for i, aa in enumerate(query if query is not None else "".join(c for _, c in placed)):
        hit = n < len(placed) and placed[n][1] == aa
        rows.append((i, aa, placed[n][0] if hit else None))
        n += hit
    index = freq.sparkSession.createDataFrame(rows, "idx int, residue string, pos int")
    return index.join(freq, "pos", "left")


def same_loop_length(df: DataFrame, key_value: str, ranges: list, key: str = "name", aligned: str = "aligned") -> DataFrame:
    """Flags per row: its ungapped length in each range equals that of the key row; and in all of them."""
    names = [f"cdr{i}" for i in range(1, len(ranges) + 1)]
    lengths = G.length_info(df, ranges, key, aligned)
    mine = lengths.where(F.col(key) == key_value).agg(F.struct(*[F.max(n).alias(n) for n in names]).alias("s")).scalar()
    same = {f"same_{n}": F.col(n) == mine.getField(n) for n in names}
    out = lengths.withColumns(same)
    both = reduce(lambda a, b: a & b, [F.col(f"same_{n}") for n in names])
    return out.withColumn("same_all", both).select(key, *[f"same_{n}" for n in names], "same_all")


def block_frequencies(df: DataFrame, blocks: dict, aligned: str = "aligned", **options) -> DataFrame:
    """Column frequencies per named block {name: (first, last, row condition)}, each over its own rows."""
    parts = [
        position_frequencies(df.where(cond).withColumn("_s", F.substring(aligned, a, b - a + 1)), "_s", **options)
        .select(F.lit(name).alias("block"), (F.col("pos") + a - 1).alias("pos"), "aa", "freq", "freq_no_gaps")
        for name, (a, b, cond) in blocks.items()
    ]
    return reduce(lambda x, y: x.unionByName(y), parts)


def per_length_score(scores: Column, symbols: Column, empty=None) -> Column:
    """Sum of position scores over the number of non-gap symbols; `empty` where nothing is left."""
    n = F.size(F.filter(symbols, lambda s: s != K.GAP))
    total = F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(n > 0, total / n).otherwise(F.lit(empty).cast("double"))


def nativeness(scores: Column, selected: Column, threshold: float = None) -> Column:
    """exp(-mean score of the selected positions), rescaled to the common target; 1 if none is selected."""
    from seqloom.functions.sequences import rescale_linear

    kept = F.filter(F.zip_with(scores, selected, lambda s, on: F.when(on, s)), lambda s: s.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    raw = F.exp(-total / F.size(kept))
    scaled = rescale_linear(raw, K.NATIVENESS_TARGET, threshold) if threshold else raw
    return F.when(F.size(kept) > 0, scaled).otherwise(1.0)
