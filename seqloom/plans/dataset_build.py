"""Dataset build: validated master and activity -> clusters -> leakage-free splits with reports."""

from pyspark.sql import DataFrame, functions as F

from seqloom.operators import aggregates as G, filters as L, joins as J, motifs as M, sets as T, similarity as S, splits as P
from seqloom.operators.storage import cut_lineage


def build(
    master: DataFrame, activity: DataFrame, active: DataFrame, negative: DataFrame, identity: float = 0.8,
    internal: float = 0.9, against: float = 0.6, test_frac: float = 0.1, seed: int = 2026, min_length: int = 0,
) -> dict:
    """Frames by name: the six splits, `splits` (long: split, sequence, cluster_id), `filter_counts`,
    `overlaps`, `counts`, `profile`.

    `master` has one row per sequence (see load_master); `activity` is aggregate_activity joined with
    the label columns of the master.
    """
    master = cut_lineage(master)
    activity = cut_lineage(activity)
    clusters = cut_lineage(S.cluster_by_identity(master, identity, min_length=min_length).select("sequence", "cluster_id"))
    profile = cut_lineage(M.task_flags(M.motif_profile(master.select("sequence"), active, negative, "sequence")))
    flagged = J.attach_cluster(activity.join(profile, "sequence"), clusters)
    known = L.known_label(F.col("hemolysis_summary"))
    de, inp = flagged.where("de"), flagged.where(F.col("inp") & known)
    de_known = de.where(known)

    held_de = cut_lineage(P.holdout_groups(de_known, "cluster_id", test_frac, seed))
    held_inp = cut_lineage(P.holdout_groups(inp, "cluster_id", test_frac, seed + 1))
    names = ["sequence", "cluster_id"]
    test_de = de_known.join(held_de, "cluster_id", "left_semi").select(*names)
    test_inp = inp.join(held_inp, "cluster_id", "left_semi").select(*names)
    fine_de = de.join(held_de, "cluster_id", "left_anti").select(*names)
    fine_inp = inp.join(held_inp, "cluster_id", "left_anti").select(*names)

    pool = J.attach_cluster(master.where(L.pretrain_eligible(F.col("activity_summary"))).select("sequence"), clusters)
    pretrain = cut_lineage(J.exclude(pool, held_de.union(held_inp), [fine_de, fine_inp, test_de, test_inp]))
    pretrain_motif = pretrain.join(profile.where("has_active and optimizable_de").select("sequence"), "sequence")

    tests = cut_lineage(T.union_distinct(test_de, test_inp))
    trains = {"pretrain": pretrain, "pretrain_motif": pretrain_motif, "finetune_de": fine_de, "finetune_inp": fine_inp}
    tagged = lambda frames: G.stack([f.select(F.lit(n).alias("split"), *names) for n, f in frames.items()])
    pools = cut_lineage(tagged(trains))
    kept, counters = S.filter_training(pools, tests, internal, against, min_length)
    frames = {**trains, "test_de": test_de, "test_inp": test_inp}
    fixed = tagged({"test_de": test_de, "test_inp": test_inp})
    long = cut_lineage(pools.join(kept, ["split", "sequence"], "left_semi").unionByName(fixed))
    out = {n: long.where(F.col("split") == n).select("sequence") for n in frames}
    for n in ("finetune_de", "finetune_inp", "test_de", "test_inp"):
        out[n] = out[n].join(activity, "sequence")
    one = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    out["counts"] = G.stack([
        one(master, "master"), one(activity, "activity"), one(de, "de"), one(de_known, "de_known"), one(inp, "inp"),
        one(held_de, "held_de"), one(held_inp, "held_inp"),
    ])
    out |= {
        "splits": long, "filter_counts": counters, "profile": profile,
        "overlaps": G.overlap_counts(long, "cluster_id", "split"),
    }
    return out


def split_summary(built: dict) -> DataFrame:
    return M.summarize_split(built["splits"].join(built["profile"], "sequence"), "split")


def split_labels(built: dict, activity: DataFrame) -> DataFrame:
    return M.label_counts(built["splits"].join(activity, "sequence"), "split", ["hemolysis_summary", "combo_class"])
