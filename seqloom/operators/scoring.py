"""Scorer registry and user-supplied functions."""

from pyspark.sql import DataFrame, functions as F

from seqloom.functions import chemistry as C

# Native example scorers: a Column of the sequence -> a score in 0..1.
SCORERS = {
    "charge": lambda s: 1 / (1 + F.exp(-C.net_charge(s, 7.4))),
    "hydrophobic": lambda s: C.hydrophobic_fraction(s),
}
ALIASES = {"net_charge": "charge", "hydro": "hydrophobic"}


def register(name: str, scorer, *aliases: str):
    SCORERS[name] = scorer
    ALIASES.update({a: name for a in aliases})


def resolve(names: str) -> list:
    """Scorer names from a comma list; aliases resolved, doubles dropped, 'none' alone means no scoring."""
    wanted = [n.strip().lower().replace("-", "_") for n in names.split(",") if n.strip()]
    if wanted == ["none"]:
        return []
    out = []
    for n in wanted:
        n = ALIASES.get(n, n)
        if n not in SCORERS:
            raise ValueError(f"unknown scorer {n!r}; known: {', '.join(sorted(SCORERS))}")
        if n not in out:
            out.append(n)
    return out


def independent_scorers(guiding: str) -> list:
    """All scorers but the guiding one."""
    skip = set(resolve(guiding))
    return [n for n in SCORERS if n not in skip]


def score_batch(df: DataFrame, scorers: str, sequence: str = "sequence") -> DataFrame:
    """One `{name}_score` column per scorer. A scorer is a Column function or a pandas iterator UDF,
    which loads its model once per task."""
    return df.withColumns({f"{n}_score": SCORERS[n](F.col(sequence)) for n in resolve(scorers)})


def score_distinct(df: DataFrame, scorers: str, sequence: str = "sequence") -> DataFrame:
    """Score every distinct sequence once and join the scores back."""
    scored = score_batch(df.select(sequence).distinct(), scorers, sequence)
    return df.join(scored, sequence)


def apply_pandas(df: DataFrame, fn, columns: list, name: str, dtype: str = "double") -> DataFrame:
    """User function over Arrow batches of pandas Series, for what Column functions cannot say."""
    import pandas as pd

    def call(*series: pd.Series) -> pd.Series:
        return fn(*series)

    call.__annotations__ = {"return": pd.Series}
    from pyspark.sql.pandas.functions import PandasUDFType

    udf = F.pandas_udf(call, dtype, PandasUDFType.SCALAR)
    return df.withColumn(name, udf(*[F.col(c) for c in columns]))
