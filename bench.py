"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores) choose data and cores.
"""

import json
import os
import time

from pyspark.sql import SparkSession, functions as F

from seqloom import bindings as V
from seqloom.catalog import QUERIES
from seqloom.catalog.similarity import MATRIX, references
from seqloom.operators import similarity as S

HEADLINE = [
    "activity_per_sequence", "sequence_profile", "isoelectric_point", "hydrophobic_moment", "summarize_metrics",
    "floor_quantile", "substitution_matrix", "exact_motif_hits", "motif_profile", "summarize_split",
    "position_frequencies", "strict_consensus", "shares_word", "similar_pairs", "cluster_by_identity",
    "distance_between", "ecdf", "merge_ranges", "smooth", "nearest_join", "auc", "group_holdout",
    "order_agnostic_mask", "melt", "merge_on", "membership_table", "incremental_scoring", "stream_tumbling_windows",
]


def timed(df) -> float:
    t = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t


def distance_rates(spark, sf, cores) -> dict:
    """Aligned pairs per second and core: all fragments of the documents against the reference rows, and the nearest of
    1,001 others at 149 columns."""
    a = V.aligned(spark, sf).select("name", "aligned").cache()
    b = references(spark, sf).cache()
    pairs = a.count() * b.count()
    d = S.distance_between(a, b, MATRIX, "name", "n_nationkey").groupBy("n_nationkey").agg(F.min("distance").alias("d"))
    out = {"aligned_pairs_per_sec_per_core": round(pairs / timed(d) / cores)}
    cut = V.seqs(spark, sf).select("doc_id", F.posexplode(F.regexp_extract_all("sequence", F.lit(".{1,149}"), F.lit(0))).alias("frag", "part"))
    wide = cut.select(F.concat_ws("_", "doc_id", "frag").alias("name"), F.rpad("part", 149, "-").alias("aligned")).cache()
    others = wide.orderBy("name").limit(1001).withColumnRenamed("name", "other").cache()
    pairs = wide.count() * others.count()
    out["nearest_pairs_per_sec_per_core_149"] = round(pairs / timed(S.nearest_by_distance(wide, others, MATRIX, "name", "other")) / cores)
    for df in (a, b, wide, others):
        df.unpersist()
    return out


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("seqloom-bench").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(2 * cores)).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["value_counts"](spark, sf).count()
    times = {}
    for name in HEADLINE:
        t = time.time()
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    rates = distance_rates(spark, sf, cores)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")), "cpus": cores, **rates,
    }))


if __name__ == "__main__":
    main()
