"""Table jobs over one sequence per row: property profile, rescaling, dipeptides, column tools."""

from pyspark.sql import DataFrame, functions as F

from seqloom import constants as K
from seqloom.functions import chemistry as C, sequences as S
from seqloom.operators.fragments import text_windows


def sequence_profile(
    df: DataFrame, sequence: str = "sequence", ph: float = 7.4, moment_scale: dict = None, with_pi: bool = True
) -> DataFrame:
    """One wide row per sequence. Rows without a standard residue keep their length and get nulls."""
    clean = df.withColumn(sequence, S.clean_sequence(F.col(sequence)))
    base = clean.withColumn("_std", F.regexp_replace(sequence, f"[^{K.RESIDUES}]", ""))
    counts = {a: F.col("_n")[a] for a in K.RESIDUES}
    std = F.col("_std")
    base = base.withColumn("_n", F.struct(*[c.alias(a) for a, c in C.residue_counts(std).items()]))
    base = base.withColumn("_t", C.charge_terms(std, counts))
    has = F.length(std) > 0
    out = base.withColumns(
        {
            "length": F.length(sequence),
            "valid_standard_aa": has & (F.length(std) == F.length(sequence)),
            "invalid_residues": S.invalid_residues(F.col(sequence)),
            "net_charge": F.when(has, C.charge_at(F.col("_t"), ph)),
            "gravy": C.gravy(std, counts),
            "hydrophobic_moment": C.hydrophobic_moment(std, moment_scale),
            "aggregation": C.na4vss(std, counts),
            "hydrophobic_fraction": C.hydrophobic_fraction(std),
        }
    )
    if with_pi:
        out = out.withColumn("isoelectric_point", F.when(has, C.isoelectric_point_from(F.col("_t"))))
    return out.drop("_std", "_n", "_t")


def scale_in_range(df: DataFrame, column: str, lo: float, hi: float, name: str = None) -> DataFrame:
    """Min-max rescaling; NaN values take no part in the range and stay NaN."""
    x = F.nanvl(F.col(column), F.lit(None).cast("double"))
    span = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("s")).scalar()
    low, high = span.getField("lo"), span.getField("hi")
    return df.withColumn(name or column, (F.col(column) - low) * (hi - lo) / (high - low) + lo)


def dipeptide_deviation(df: DataFrame, key: str = "sequence_id", sequence: str = "sequence") -> DataFrame:
    """Long form (key, pair, deviation) over all 400 pairs of every sequence of length >= 2."""
    long = df.where(F.length(sequence) >= 2)
    seen = (
        text_windows(long, key, sequence, 2).where(F.length("window") == 2)
        .groupBy(key, F.col("window").alias("pair")).agg(F.count("*").alias("k"))
    )
    pairs = F.explode(F.array(*[F.lit(a + b) for a in K.RESIDUES for b in K.RESIDUES]))
    grid = long.select(key, (F.length(sequence) - 1).alias("m"), pairs.alias("pair"))
    expected = C.dipeptide_expected(F.substring("pair", 1, 1), F.substring("pair", 2, 1))
    observed = F.coalesce("k", F.lit(0)) / F.col("m")
    return grid.join(seen, [key, "pair"], "left").select(
        key, "pair", ((observed - expected) / F.sqrt(expected * (1 - expected) / F.col("m"))).alias("deviation")
    )


def apply_column(df: DataFrame, fn, columns: list, name: str = None) -> DataFrame:
    """Column function over one or more columns, into a new column or in place of the first."""
    return df.withColumn(name or columns[0], fn(*[F.col(c) for c in columns]))


def round_all(df: DataFrame, digits: int, half_even: bool = True) -> DataFrame:
    fn = F.bround if half_even else F.round
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: fn(c, digits) for c in floats})
