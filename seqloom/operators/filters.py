"""Filters and predicates over sequence and evidence tables."""

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from seqloom import constants as K
from seqloom.functions import chemistry as C, sequences as S


def load_master(df: DataFrame, order: str, min_len: int = 5, max_len: int = 100) -> DataFrame:
    """Validated master rows, one per sequence; the row with the highest `order` wins."""
    raw = F.coalesce(F.nullif("representative_sequence", F.lit("")), F.col("sequence_key"))
    seq = S.normalize_sequence(raw)
    fields = ["evidence_groups", "databases", "activity_summary", "hemolysis_summary", "combo_class"]
    kept = df.where(F.col("is_standard_aa_sequence") == "yes").withColumn("sequence", seq)
    kept = kept.where(S.is_valid_sequence(F.col("sequence"), min_len, max_len))
    row = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in fields],
                   F.coalesce("evidence_rows", F.lit(0)).cast("int").alias("evidence_rows"))
    last = kept.groupBy("sequence").agg(F.max_by(row, order).alias("r"))
    return last.select("sequence", F.length("sequence").alias("sequence_length"), "r.*")


def activity_filter(df: DataFrame) -> DataFrame:
    """Evidence rows with an accepted metric, comparator and number; adds `metric`, `number`, and the
    normalised unit `u`."""
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    parsed = once(
        df.withColumnRenamed("metric", "_m").where(F.upper(text(F.col("_m"))).isin(K.ACTIVITY_METRICS))
        .where(text(F.col("comparator")).isin(K.COMPARATORS)),
        metric=F.upper(text(F.col("_m"))), number=S.parse_float(F.col("raw_value")), u=C.normalize_unit(F.col("unit")),
    )
    return parsed.drop("_m").where(S.is_finite(F.col("number")))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once per row: as generated columns they are not copied into
    every filter and expression above them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_micromolar(df: DataFrame) -> DataFrame:
    """Adds `um` for rows of activity_filter with a `mass`; drops rows without a finite positive value."""
    um = C.micromolar_of(F.col("number"), F.col("u"), F.col("mass"))
    return df.withColumn("um", um).where(S.is_finite(F.col("um")) & (F.col("um") > 0))


def known_label(x: Column) -> Column:
    return ~F.coalesce(x, F.lit("")).isin("", "unknown")


def pretrain_eligible(activity_summary: Column) -> Column:
    return activity_summary.isin(K.SUPERVISED_SUMMARIES)


def length_between(df: DataFrame, column: str, lo: int, hi: int) -> DataFrame:
    return df.na.drop(subset=[column]).where(F.length(column).between(lo, hi))


def require_regions(df: DataFrame, region: str = "region", min_active: int = 1, min_free: int = 1) -> DataFrame:
    """Keep rows whose region vector has enough active (1) and free (0) positions."""
    active = F.size(F.filter(region, lambda r: r == 1))
    free = F.size(F.filter(region, lambda r: r == 0))
    return df.where((active >= min_active) & (free >= min_free))


def scorable(df: DataFrame, columns: list) -> tuple:
    """(accepted, rejected): rows whose sequences have only standard residues, and the others."""
    bad = reduce(or_, [F.coalesce(F.col(c), F.lit("")).rlike(f"[^{K.RESIDUES}]") for c in columns])
    return df.where(~bad), df.where(bad)


def role_rows(df: DataFrame, column: str, roles: list) -> DataFrame:
    """Rows with one of the roles; all rows if the column is missing or no row has such a role."""
    if column not in df.columns:
        return df
    hit = F.coalesce(F.col(column).isin(roles), F.lit(False))
    found = df.agg(F.max(hit)).scalar()
    return df.where(hit | ~found)


def keep_if(df: DataFrame, column: str, predicate) -> DataFrame:
    return df.where(predicate(F.col(column)))


def filter_columns(df: DataFrame, columns: list) -> DataFrame:
    return df.select(*columns)


def remove_column(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def filter_null(df: DataFrame, columns: list) -> tuple:
    """(kept, dropped): a row is dropped when a chosen column is not a number."""
    ok = reduce(and_, [S.is_finite(S.parse_float(F.col(c).cast("string"))) for c in columns])
    return df.where(ok), df.where(~ok)


def clean_alignment(
    df: DataFrame, key: str, order: str = None, aligned: str = "aligned", cysteines: tuple = (23, 106),
    drop_misaligned: bool = False, max_leading: int = None, suffix: str = "SS", chain: str = "H",
    drop_duplicates: bool = True,
) -> DataFrame:
    """Check fixed-width rows; adds `cleaned` (null for dropped rows) and `reason`.

    Reasons, in order of the checks: duplicate, misaligned_cysteine, leading_gaps, trailing_gaps,
    filled (missing C-terminus replaced by the end of `suffix`), ok. Light chains are filled one
    column earlier, as their last column stays empty. A row with misaligned cysteines that is not
    dropped keeps its text and skips the terminal checks.
    """
    a = F.col(aligned)
    width = F.length(a)
    wrong = reduce(or_, [F.substring(a, c, 1) != "C" for c in cysteines]) if cysteines else F.lit(False)
    lead = F.length(F.regexp_extract(a, "^(-*)", 1))
    body = a if chain == "H" else F.left(a, width - 1)
    last = F.lit("") if chain == "H" else F.right(a, F.lit(1))
    trail = F.length(F.regexp_extract(body, "(-*)$", 1))
    first = F.lit(True)
    if drop_duplicates:
        # One row per distinct text carries the first key; its position is found by aggregation.
        rank = F.col(order or key)
        df = df.join(df.groupBy(aligned).agg(F.min(rank).alias("_first")), aligned)
        first = rank == F.col("_first")
    limit = F.lit(max_leading) if max_leading is not None else width
    k = len(suffix)
    reason = (
        F.when(~first, "duplicate").when(wrong, "misaligned_cysteine").when(lead > limit, "leading_gaps")
        .when(trail > k, "trailing_gaps").when(trail > 0, "filled").otherwise("ok")
    )
    filled = F.concat(F.left(body, F.length(body) - trail), F.right(F.lit(suffix), trail), last)
    keep_wrong = F.lit(None).cast("string") if drop_misaligned else a
    out = df.withColumn("reason", reason)
    cleaned = (
        F.when(F.col("reason") == "ok", a).when(F.col("reason") == "filled", filled)
        .when(F.col("reason") == "misaligned_cysteine", keep_wrong)
    )
    return out.withColumn("cleaned", cleaned).drop("_first")


def reason_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("reason").agg(F.count("*").alias("n"))


def min_aligned(df: DataFrame, n: int = 50, aligned: str = "aligned", chain: str = None, wanted: str = None) -> tuple:
    """(accepted, failed with `reason`): at least n residues placed and, if given, the wanted chain type."""
    placed = F.length(F.replace(aligned, F.lit(K.GAP), F.lit("")))
    reason = F.when(F.col(aligned).isNull() | (placed < n), "no hit")
    if chain:
        reason = reason.when(F.col(chain) != wanted, "wrong chain type")
    checked = df.withColumn("reason", reason)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def drop_unaligned_tail(df: DataFrame, aligned: str = "aligned", tail: str = "---") -> DataFrame:
    return df.where(~F.endswith(F.col(aligned), F.lit(tail)))


def chain_filter(df: DataFrame, heavy: str = "locus_heavy", light: str = "locus_light") -> DataFrame:
    return df.where(~F.col(heavy).isin("L", "K") & (F.col(light) != "H"))


def complete_rows(df: DataFrame, aligned: str = "aligned") -> DataFrame:
    """Rows with a residue in one of the first three and one of the last three columns."""
    a = F.col(aligned)
    return df.where(F.substring(a, 1, 3).rlike("[^-]") & F.right(a, F.lit(3)).rlike("[^-]"))
