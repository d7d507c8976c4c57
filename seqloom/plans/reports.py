"""Report jobs: properties, substitutions and motifs, scores, antibody groups over a run grid."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from seqloom import constants as K
from seqloom.operators import aggregates as G, joins as J, motifs as M, profiles as R, scoring as C, similarity as S
from seqloom.operators.storage import cut_lineage

PROPERTIES = ["gravy", "net_charge", "hydrophobic_moment", "helicity", "aggregation"]


def property_report(df: DataFrame, train: DataFrame = None, ref: DataFrame = None) -> tuple:
    """(profile with novelty and composites, long summary). A `helicity` column is used if present."""
    out = cut_lineage(R.sequence_profile(df))
    if train is not None:
        out = out.join(S.novelty(df, train, "sequence_id"), "sequence_id", "left")
    out = cut_lineage(G.desirability(G.balance_index(out), PROPERTIES, ref))
    skip = {"sequence_id", "sequence", "invalid_residues"}
    numeric = [c for c, t in out.dtypes if c not in skip and t in ("double", "int", "bigint", "boolean", "float")]
    return out, G.summarize_metrics(out, numeric)


def motif_report(df: DataFrame, pairs: DataFrame, motifs: DataFrame, width: int = 15) -> dict:
    """Substitution tables of the pairs and motif-centred logo tables of the sequences."""
    events = G.substitution_events(pairs)
    windows = M.motif_windows(df, M.motif_spans(df, motifs, "sequence_id"), "sequence_id", width=width)
    return {
        "events": events, "matrix": G.substitution_matrix(events), "counters": G.substitution_counters(pairs),
        "windows": windows, "logo": M.logo_frequency(windows, width),
    }


def score_report(df: DataFrame, scorers: str, activity: list, hemolysis: str = "hemolysis_score") -> tuple:
    """(scores with ensemble and dual hit, summary with the hit rate)."""
    scored = C.score_distinct(df.where(F.length("sequence") > 0), scorers)
    out = G.ensemble_hit(scored, activity, hemolysis)
    numeric = [*activity, hemolysis, "activity_mean_score"]
    return out, G.summarize_metrics(out, numeric).unionByName(G.rate_row(out, "dual_hit", "dual_hit_rate"))


def group_report(samples: DataFrame, parents: DataFrame, scores: list, baseline: str, group: str = "role") -> DataFrame:
    """Group means, improvement over the baseline and share of preserved positions, per grid cell.

    One table holds all cells (temperature, seed); aligned sample and parent are compared position
    by position after the parent join.
    """
    j = J.sample_with_parent(samples, parents)
    z = F.filter(F.arrays_zip(F.split("aligned", "").alias("x"), F.split("parent_aligned", "").alias("y")), lambda c: c["x"] != "")
    kept = F.size(F.filter(z, lambda c: c["x"] == c["y"])) / F.nullif(F.size(z), F.lit(0))
    cells = ["temperature", "seed"]
    rows = j.withColumn("preserved", kept)
    long = rows.select(*cells, group, *[F.col(s).cast("double").alias(s) for s in [*scores, "preserved"]]).unpivot(
        [*cells, group], [*scores, "preserved"], "score", "v"
    )
    means = long.groupBy(*cells, group, "score").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))
    base = means.where(F.col(group) == baseline).select(*cells, "score", F.col("mean").alias("_b"))
    return means.join(base, [*cells, "score"], "left").withColumn("improvement", F.col("mean") - F.col("_b")).drop("_b")


def hit(thresholds: dict):
    """Condition that all named scores pass: {column: (op, limit)} with op '>=' or '<'."""
    tests = [F.col(c) >= v if op == ">=" else F.col(c) < v for c, (op, v) in thresholds.items()]
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


DEFAULT_HIT = {"activity_mean_score": (">=", K.ACTIVITY_HIT), "hemolysis_score": ("<", K.HEMOLYSIS_HIT)}
