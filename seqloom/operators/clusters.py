"""Clustering of numeric rows: density, k-means, thresholded norms, connected components."""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.operators import ordered as O
from seqloom.operators.joins import product
from seqloom.operators.storage import State, cut_lineage


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each component, by neighbour minima and pointer jumping."""
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut_lineage(nodes.select("id", F.col("id").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("m"))
        hooked = labels.join(near, "id", "left").select("id", "label", F.least("label", F.coalesce("m", "label")).alias("h"))
        jump = hooked.select(F.col("id").alias("h"), F.col("h").alias("j"))
        new = cut_lineage(hooked.join(jump, "h").select("id", F.col("label").alias("old"), F.col("j").alias("label")))
        done = new.where("old <> label").isEmpty()
        labels = new.select("id", "label")
        if done:
            return labels


#: Components of the vectors of a block, fewest rows of a block, and pairs that are compared at once.
BLOCK_PARTS, BLOCK_ROWS, SLAB = 1 << 20, 256, 1 << 21


def _near_rows(x, y, eps: float):
    """(i, j, distance) of rows of two matrices at most eps apart. A product rules out what is farther by more than its own
    rounding; the rest is added up component by component, as `euclidean` does."""
    sx, sy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    slack = 1e-12 * max(1, x.shape[1])
    step = max(1, SLAB // max(1, len(y)))
    for at in range(0, len(x), step):
        own = sx[at : at + step, None]
        i, j = np.nonzero(own + sy - 2 * (x[at : at + step] @ y.T) <= eps * eps * (1 + 1e-9) + slack * (own + sy))
        i += at
        for k in range(0, len(i), SLAB):
            p, q = i[k : k + SLAB], j[k : k + SLAB]
            d = np.zeros(len(p))
            for c in range(x.shape[1]):
                d += (x[p, c] - y[q, c]) ** 2
            d = np.sqrt(d)
            good = d <= eps
            yield p[good], q[good], d[good]


def pairs_within(df: DataFrame, vector: str, eps: float) -> DataFrame:
    """(a, b, d) with a < b and Euclidean distance at most eps, over `id` and the vector column; ids are unique.

    Rows are cut into blocks along their distance to a pivot. Distances to it differ by at most eps for such pairs
    (triangle inequality), so only blocks whose ranges are that near meet, each two in one task as matrix products. Exact
    for any pivot. Vectors that are null, hold null or are not finite are near nothing.
    """
    import pyarrow as pa

    spark = df.sparkSession
    kind = dict(df.dtypes)["id"]
    rows = df.select("id", F.col(vector).cast("array<double>").alias("v"))
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(F.col("v").isNotNull() & ~F.exists("v", odd)).withColumn("m", F.size("v"))
    pivot = rows.orderBy(F.xxhash64("id"), "id").limit(1).select("v").collect()
    none = spark.createDataFrame([], f"a {kind}, b {kind}, d double")
    if not pivot:
        return none
    # Vectors of another length have no distance to the pivot, and none to those of its length.
    ring = F.coalesce(euclidean(F.col("v"), F.array(*[F.lit(float(x)) for x in pivot[0][0]])), F.lit(0.0))
    rows = cut_lineage(rows.withColumn("r", ring))
    n, parts = rows.agg(F.count("*"), F.sum("m")).first()
    count = max(-(-parts // BLOCK_PARTS), min(8, n // BLOCK_ROWS), 1)
    cuts = sorted(set(rows.approxQuantile("r", [i / count for i in range(1, count)], 0.1 / count))) if count > 1 else []
    bucket = F.coalesce(sum([(F.col("r") > c).cast("int") for c in cuts], F.lit(0)), F.lit(0))
    rows = rows.withColumn("p", bucket)
    boxes = rows.groupBy("m", "p").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n")).orderBy("m", "p").collect()
    # A range that many rows share is cut by hash.
    blocks, first, pieces = [], {}, {}
    size = -(-n // count)
    for x in boxes:
        first[x["m"], x["p"]], pieces[x["m"], x["p"]] = len(blocks), max(1, round(x["n"] / size))
        blocks += [(x["m"], x["lo"], x["hi"])] * pieces[x["m"], x["p"]]
    slack = lambda x: 1e-9 * (eps + abs(x))
    meets = [[j for j, (m, lo, hi) in enumerate(blocks) if m == own and lo - high <= eps + slack(lo) and low - hi <= eps + slack(low)] for own, low, high in blocks]
    meets = [[(i, j) if i <= j else (j, i) for j in near] for i, near in enumerate(meets)]
    table = spark.createDataFrame(
        [(m, p, k, i, j, first[m, p] + k == i, first[m, p] + k == j) for (m, p), n_ in pieces.items() for k in range(n_) for i, j in meets[first[m, p] + k]],
        "m int, p int, k int, i int, j int, left boolean, right boolean",
    )
    share = spark.createDataFrame([(m, p, n_) for (m, p), n_ in pieces.items()], "m int, p int, pieces int")
    placed = rows.join(share, ["m", "p"]).withColumn("k", F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).join(table, ["m", "p", "k"])

    def matrix(t):
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(t.num_rows, -1) if t.num_rows else np.zeros((0, 1))

    def run(key, left, right):
        out = []
        if left.num_rows and right.num_rows:
            ka, kb = left.column("id").combine_chunks(), right.column("id").combine_chunks()
            for i, j, d in _near_rows(matrix(left), matrix(right), eps):
                a, b = ka.take(pa.array(i)), kb.take(pa.array(j))
                t = pa.table({"a": a, "b": b, "d": pa.array(d)})
                if key[0] == key[1]:
                    t = t.filter(pc.less(t["a"], t["b"]))
                else:
                    t = t.filter(pc.not_equal(t["a"], t["b"]))
                    swap = pc.greater(t["a"], t["b"])
                    t = pa.table({"a": pc.if_else(swap, t["b"], t["a"]), "b": pc.if_else(swap, t["a"], t["b"]), "d": t["d"]})
                out.append(t)
        return pa.concat_tables(out) if out else empty

    import pyarrow.compute as pc
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(none.schema).empty_table()
    # The work grows with pairs, not bytes, so partitions are counted in block pairs and not merged by size.
    tasks = max(1, min(20_000, sum(map(len, meets))))
    # Names of their own, as both sides come from one table.
    spread = lambda side: placed.where(side).select(*(F.col(c).alias(c) for c in ("i", "j", "id", "v"))).repartition(tasks, "i", "j").groupBy("i", "j")
    return spread("left").cogroup(spread("right")).applyInArrow(run, f"a {kind}, b {kind}, d double")


def distance_percentile(df: DataFrame, vector: str, percent: float, blocks: int = 8) -> DataFrame:
    """Percentile of all pair distances incl. self, as of a full matrix; quadratic by definition."""
    a = df.select(F.col("id").alias("a"), F.col(vector).alias("va"))
    b = df.select(F.col("id").alias("b"), F.col(vector).alias("vb"))
    d = product(a, b, blocks).select(F.round(euclidean(F.col("va"), F.col("vb")), 12).alias("d"))
    return O.quantiles(d, "d", {"eps": percent / 100})


def density_clusters(df: DataFrame, key: str, vector: str, eps: float, min_samples: int = 5) -> DataFrame:
    """DBSCAN: (key, cluster, core). -1 is noise; clusters are numbered by their smallest core key.

    Equal vectors are one weighted point, so copies add no pairs.
    """
    points = df.groupBy(vector).agg(F.min(key).alias("id"), F.count("*").alias("w"))
    points = cut_lineage(points.select("id", "w", F.col(vector).alias("_v")))
    near = cut_lineage(pairs_within(points, "_v", eps).select("a", "b"))
    both = near.union(near.select("b", "a"))
    weight = points.select(F.col("id").alias("b"), "w")
    around = both.join(weight, "b").groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("n"))
    cores = points.join(around, "id", "left").where(F.col("w") + F.coalesce("n", F.lit(0)) >= min_samples).select("id")
    cores = cut_lineage(cores)
    inner = near.join(cores.withColumnRenamed("id", "a"), "a").join(cores.withColumnRenamed("id", "b"), "b")
    labels = connected_components(cores, inner.select("a", "b"))
    rank = O.running(labels.select("label").distinct(), ["label"], index="cluster")
    core_labels = labels.join(rank, "label").select("id", "cluster", F.lit(True).alias("core"))
    touch = both.join(core_labels.select(F.col("id").alias("b"), "cluster"), "b").join(cores.withColumnRenamed("id", "a"), "a", "left_anti")
    border = touch.groupBy(F.col("a").alias("id")).agg(F.min("cluster").alias("cluster")).withColumn("core", F.lit(False))
    known = points.join(core_labels.unionByName(border), "id", "left").select(
        F.col("_v").alias(vector), F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("core", F.lit(False)).alias("core")
    )
    return df.select(key, vector).join(known, vector).select(key, "cluster", "core")


def best_eps(df: DataFrame, key: str, vector: str, candidates: list, min_samples: int = 5) -> float:
    """The candidate radius that gives most clusters, the larger one on a tie."""
    count = lambda e: density_clusters(df, key, vector, e, min_samples).agg(F.max("cluster")).first()[0] + 1
    return max((count(e), e) for e in candidates)[1]


def _vectors(batch, cosine: bool):
    """Rows of an Arrow batch as a matrix; of unit length for the cosine (a zero vector stays zero)."""
    column = batch.column("v")
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    if not cosine:
        return x
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def _nearest(x, centres) -> tuple:
    """(number of the nearest centre, squared distance to it); the smaller number on a tie. Centres one by one, so that a
    batch needs no rows x centres x components."""
    best, found = np.full(len(x), np.inf), np.zeros(len(x), np.int32)
    for i, c in enumerate(centres):
        d = ((x - c) ** 2).sum(axis=1)
        near = d < best
        best[near], found[near] = d[near], i
    return found, best


def assign(df: DataFrame, key: str, vector: str, centres: list, cosine: bool = False) -> DataFrame:
    """(key, cluster, distance): number of the nearest of `centres` (k lists, sent to the tasks) and the distance to it;
    the smaller number on a tie. For the cosine rows are scaled to unit length first. Both are null for a null vector."""
    fixed = np.array(centres, dtype=float)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                found, d = _nearest(_vectors(batch, cosine), fixed)
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(found), pa.array(np.sqrt(d))], names=["k", "cluster", "distance"])

    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    kind = dict(rows.dtypes)["k"]
    none = rows.where("v is null").select("k", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("distance"))
    found = rows.where("v is not null").mapInArrow(run, f"k {kind}, cluster int, distance double")
    return found.union(none).withColumnRenamed("k", key)


def centre_means(df: DataFrame, vector: str, centres: list, cosine: bool = False) -> list:
    """One round: the mean of the rows nearest to each centre; a centre without rows stays. Each task adds up its rows,
    so k vectors a task are shuffled and k come back."""
    fixed = np.array(centres, dtype=float)

    def run(batches):
        import pyarrow as pa

        sums, n = np.zeros_like(fixed), np.zeros(len(fixed), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch, cosine)
                found, _ = _nearest(x, fixed)
                np.add.at(sums, found, x)
                n += np.bincount(found, minlength=len(fixed))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at].tolist(), pa.list_(pa.float64())), pa.array(n[at])], names=["cluster", "s", "n"])

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, "cluster int, s array<double>, n long")
    means = parts.select("cluster", "n", F.posexplode("s").alias("pos", "x")).groupBy("cluster", "pos").agg((F.sum("x") / F.sum("n")).alias("mean"))
    out = [list(c) for c in centres]
    for r in means.collect():
        out[r["cluster"]][r["pos"]] = r["mean"]
    if cosine:
        out = [(np.array(c) / (np.linalg.norm(c) or 1)).tolist() for c in out]
    return out


def seeds(df: DataFrame, key: str, vector: str, k: int, cosine: bool = False, seed: int = 7) -> list:
    """k rows as first centres, each drawn with a weight of its squared distance to the nearest one so far.

    A row's draw is an exponential of that rate made from a hash of its key, the round and the seed, and the smallest one
    wins: one aggregate a centre, the same under any partitioning. Fewer distinct vectors give fewer centres.
    """
    rows = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    if cosine:
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x))
        rows = rows.select("k", F.when(length > 0, F.transform("v", lambda x: x / length)).otherwise(F.col("v")).alias("v"))
    centres = []
    for i in range(k):
        # 2^53 steps; never 0.
        u = (F.shiftrightunsigned(F.xxhash64("k", F.lit(seed), F.lit(i)), 11) + F.lit(1)).cast("double") / F.lit(2.0**53)
        weighed = rows.withColumn("w", F.lit(1.0))
        if centres:
            # The vector goes along with the key.
            weighed = assign(rows.select(F.struct("k", "v").alias("r"), "v"), "r", "v", centres).select("r.k", "r.v", (F.col("distance") * F.col("distance")).alias("w"))
        drawn = weighed.where("w > 0").agg(F.min(F.struct((-F.log(u) / F.col("w")).alias("e"), "k", "v")).alias("m")).first()["m"]
        if drawn is None:
            break
        centres.append(list(drawn["v"]))
    return centres


def kmeans(df: DataFrame, key: str, vector: str, k: int, cosine: bool = False, seed: int = 7, max_iter: int = 20) -> tuple:
    """(assignment (key, cluster), centroids (cluster, member, n)): Lloyd's rounds from `seeds` until no mean moves or
    `max_iter` is reached; the centroid member is the row nearest to its mean, the smaller key on a tie.

    An empty cluster keeps its mean (it has no member and no row in the second table). With the cosine, rows and means
    have unit length. Null vectors get a null cluster; an empty table gives no rows. Only k centres reach the driver.
    """
    centres = seeds(df, key, vector, k, cosine, seed)
    for _ in range(max_iter):
        moved = centre_means(df, vector, centres, cosine)
        # Sums of floating numbers depend on their order in the last bits.
        still = all(abs(x - y) <= 1e-12 * max(1.0, abs(x)) for a, b in zip(centres, moved) for x, y in zip(a, b))
        centres = moved
        if still:
            break
    placed = assign(df, key, vector, centres, cosine)
    members = placed.where("cluster is not null").groupBy("cluster").agg(F.min_by(key, F.struct("distance", key)).alias("member"), F.count("*").alias("n"))
    return placed.select(key, "cluster"), members


def _norm_stats(rows: DataFrame, width: int, blocks: int) -> tuple:
    """Mean and n-1 deviation of the difference norms over all pairs, as scalar columns.

    One column: from ranks and sums, linear. More columns: a blocked product.
    """
    if width == 1:
        x = rows.select("id", F.col("v")[0].alias("x"))
        n, sx, sxx = F.count("*"), F.sum("x"), F.sum(F.col("x") * F.col("x"))
        s1 = 2 * F.sum(F.col("x") * F.col("i")) - (n - 1) * sx
        tot = n * (n - 1) / 2
        ranked = O.running(x, ["x", "id"], index="i")
        s = ranked.agg(F.struct((s1 / tot).alias("m"), F.sqrt((n * sxx - sx * sx - s1 * s1 / tot) / (tot - 1)).alias("sd")).alias("s")).scalar()
    else:
        a, b = rows.select(F.col("id").alias("a"), F.col("v").alias("va")), rows.select(F.col("id").alias("b"), F.col("v").alias("vb"))
        d = product(a, b, blocks).where("a < b").select(euclidean(F.col("va"), F.col("vb")).alias("d"))
        s = d.agg(F.struct(F.avg("d").alias("m"), F.stddev_samp("d").alias("sd")).alias("s")).scalar()
    return s.getField("m"), s.getField("sd")


def threshold_clusters(
    df: DataFrame, key: str, columns: list, sigma: float = None, threshold: float = None, strict: bool = False, blocks: int = 8
) -> DataFrame:
    """(key, cluster_id): rows within a difference norm of each other after scaling columns by their sums.

    The threshold is the mean pair norm plus sigma deviations unless given. Connected mode joins
    chains; one column needs no pairs at all, as a chain breaks only at a gap of the sorted values.
    Strict mode wants all members within the threshold of each other (complete_linkage).
    """
    sums = df.agg(F.struct(*[F.sum(c).alias(c) for c in columns]).alias("s")).scalar()
    rows = df.select(F.col(key).alias("id"), F.array(*[(F.col(c) / sums.getField(c)).cast("double") for c in columns]).alias("v"))
    rows = cut_lineage(rows)
    if threshold is None:
        mean, sd = _norm_stats(rows, len(columns), blocks)
        limit = mean + (sigma or 0.0) * sd
        threshold = df.sparkSession.range(1).select(limit.alias("t")).first()["t"]
    if strict:
        labels = cut_lineage(complete_linkage(rows, len(columns), threshold))
        rank = O.running(labels.select("label").distinct(), ["label"], index="cluster_id")
        return labels.join(rank, "label").select(F.col("id").alias(key), "cluster_id")
    if len(columns) == 1:
        x = rows.select("id", F.col("v")[0].alias("x"))
        points = O.cut_points(x, ["x", "id"], O.bucket_count(df.sparkSession))
        gap = O.neighbours(x, ["x", "id"], {"p": ("x", "prev")}, points=points)
        opened = gap.withColumn("_o", F.coalesce(F.col("x") - F.col("p") > threshold, F.lit(False)).cast("int"))
        part = O.running(opened, ["x", "id"], sums={"cluster_id": "_o"}, index="_i", points=points).select("id", "cluster_id")
    else:
        labels = connected_components(rows, pairs_within(rows, "v", threshold))
        rank = O.running(labels.select("label").distinct(), ["label"], index="cluster_id")
        part = labels.join(rank, "label").select("id", "cluster_id")
    return part.withColumnRenamed("id", key)


#: Points of a block of clusters, and points in all that one task joins to the end.
LINK_POINTS, LINK_LAST = 1024, 2048


def _outline(x):
    """Of the points of a cluster those that can be farthest from some other point: the ends of a line, the corners in a plane."""
    if x.shape[1] > 2 or len(x) < 3:
        return x
    if x.shape[1] < 2:
        return np.array([x.min(axis=0), x.max(axis=0)])
    x = x[np.lexsort((x[:, 1], x[:, 0]))]
    sides = []
    for way in (x.tolist(), x[::-1].tolist()):
        side = []
        for p in way:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
        sides += side[:-1]
    return np.array(sides) if sides else x[:1]


def _farthest(x, y):
    """Largest distances between the points of clusters, two lists of matrices, added up component by component as in
    `euclidean`."""
    out = np.zeros((len(x), len(y)))
    if not len(x) or not len(y):
        return out
    of, flat_x, flat_y = np.repeat(np.arange(len(x)), [len(p) for p in x]), np.concatenate(x), np.concatenate(y)
    first = np.cumsum([0, *(len(p) for p in y[:-1])])
    step = max(1, SLAB // len(flat_y))
    for at in range(0, len(flat_x), step):
        d = np.zeros((len(flat_x[at : at + step]), len(flat_y)))
        for c in range(flat_x.shape[1]):
            d += (flat_x[at : at + step, c, None] - flat_y[None, :, c]) ** 2
        np.maximum.at(out, of[at : at + step], np.maximum.reduceat(d, first, axis=1))
    return np.sqrt(out)


def _linked(eps: float, width: int, first: bool):
    """One task for all clusters: (c, new) of those that end in another one."""
    import pyarrow as pa

    def run(batches):
        t = pa.Table.from_batches(list(batches), pa.schema([("c", pa.int64()), ("p", pa.list_(pa.float64())), ("still", pa.bool_()), ("hidden", pa.bool_())])).sort_by("c")
        own, points = t["c"].to_numpy(), [np.array(p).reshape(-1, width) for p in t["p"].to_pylist()]
        still, hidden = (t[c].to_numpy() for c in ("still", "hidden"))
        d = _farthest(points, points)
        d[~(d <= eps)] = np.inf
        np.fill_diagonal(d, np.inf)
        root, open_, begin = np.arange(len(own)), np.arange(len(own)), first
        while len(open_) > 1:
            m = d[np.ix_(open_, open_)]
            if begin:
                m[hidden[open_]], m[:, hidden[open_]] = np.inf, np.inf
            near = m.argmin(axis=1)  # the first of equal ones
            at = np.arange(len(open_))
            pairs = (near[near] == at) & (at < near) & np.isfinite(m[at, near])
            if begin:
                pairs &= ~(still[open_] | still[open_][near])
            a, b = open_[pairs], open_[near[pairs]]
            if not len(a) and not (begin and still.any()):
                break
            for x, y in zip(a.tolist(), b.tolist()):
                d[x] = np.maximum(d[x], d[y])
                d[:, x] = d[x]
                root[root == y] = x
            np.fill_diagonal(d, np.inf)
            open_, begin = np.setdiff1d(open_, b), False
        moved = np.flatnonzero(root != np.arange(len(own)))
        yield pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(own[root[moved]])], names=["old", "new"])

    return run


def _nearest_cluster(eps: float, width: int):
    """Per two blocks: for each cluster the nearest of the other block that it could be joined with wholly."""
    import pyarrow as pa

    def run(key, t):
        i, j = (x.as_py() for x in key)
        t = t.sort_by("c")
        own, block, points = t["c"].to_numpy(), t["b"].to_numpy(), [np.array(p).reshape(-1, width) for p in t["p"].to_pylist()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        d = _farthest([points[k] for k in left], [points[k] for k in right])
        d[~(d <= eps)] = np.inf
        if i == j:
            np.fill_diagonal(d, np.inf)
        out = []
        for rows, others, m in ((left, right, d), (right, left, d.T))[: 1 if i == j else 2]:
            if m.size:
                best = m.argmin(axis=1)  # the first of equal ones has the smallest number
                low = m[np.arange(len(rows)), best]
                some = np.isfinite(low)
                out.append(pa.table({"c": own[rows[some]], "d": low[some], "o": own[others[best[some]]]}))
        return pa.concat_tables(out) if out else pa.table({"c": own[:0], "d": np.zeros(0), "o": own[:0]})

    return run


def complete_linkage(rows: DataFrame, width: int, eps: float) -> DataFrame:
    """(id, label) of clusters whose members are all within `eps` of each other; label is the smallest id. `rows` has the
    vector v of `width` components; one that is null, holds null or is not finite stays alone.

    Clusters grow in rounds: of the clusters that could be joined wholly, two that are each other's nearest are. Their
    distance is the largest of a pair between them; equal distances are ordered by the smaller, then the larger label.
    Equal vectors are joined at once, as nothing is nearer to them. No pair is a row: clusters carry the points that can
    be farthest from others, and in a round every two blocks of clusters meet in one task, which hands on the nearest one
    of each. The last points are joined in one task of bounded size. An id that comes more than once is a cluster from the
    start and can be joined from the second round on.
    """
    odd = F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nodes = rows.select("id", F.col("id").alias("label"))
    if not eps >= 0:
        return nodes
    ids = rows.groupBy("id").agg(F.count("*").alias("k"), F.count_if(odd).alias("bad"), F.array_sort(F.collect_set("v")).alias("p"))
    ids = State(ids.where("id is not null and bad = 0").select("id", "k", "p"), "ids").df
    equal = ids.where("k = 1").groupBy("p").agg(F.min("id").alias("label"), (F.count("*") > 1).alias("still")).withColumn("hidden", F.lit(False))
    alone = ids.where("k > 1").select("p", F.col("id").alias("label"), F.lit(False).alias("still"), F.lit(True).alias("hidden"))
    numbered = O.running(equal.union(alone), ["label"], index="c")
    clusters = State(numbered.select(F.col("c").cast("long").alias("c"), "label", F.flatten("p").alias("p"), "still", "hidden"), "clusters")
    names = clusters
    roots = State(names.df.select("c", F.col("c").alias("root")), "roots")
    wake = not names.df.where("still").isEmpty()
    outline = F.udf(lambda p: _outline(np.array(p).reshape(-1, width)).ravel().tolist(), "array<double>")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    first = True
    while True:
        state = clusters.df.select("c", "p", "still", "hidden")
        n, points = state.agg(F.count("*"), F.coalesce(F.sum(F.size("p") / width), F.lit(0)).cast("long")).first()
        last = points <= LINK_LAST
        if last:
            moves = State(state.repartition(1).mapInArrow(_linked(eps, width, first), "old long, new long"), "moves")
        else:
            count = max(-(-points // LINK_POINTS), min(n, -int(-((8 * cores) ** 0.5) // 1)))
            block = (state.where("not hidden") if first else state).select("c", "p", F.pmod(F.xxhash64("c"), F.lit(count)).cast("int").alias("b"))
            other = block.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
            placed = other.select("c", "p", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
            # The work grows with pairs, not bytes, so partitions are counted in block pairs and not merged by size.
            spread = placed.repartition(min(count * (count + 1) // 2, 20_000), "i", "j")
            near = spread.groupBy("i", "j").applyInArrow(_nearest_cluster(eps, width), "c long, d double, o long")
            near = State(near.groupBy("c").agg(F.min(F.struct("d", "o")).alias("s")).select("c", F.col("s.o").alias("o")), "near")
            both = near.df.alias("x").join(near.df.alias("y"), (F.col("x.c") == F.col("y.o")) & (F.col("x.o") == F.col("y.c")) & (F.col("x.c") < F.col("x.o")))
            pairs = both.select(F.col("x.o").alias("old"), F.col("x.c").alias("new"))
            if first and wake:  # equal vectors are still being joined
                busy = state.where("still").select("c")
                pairs = pairs.join(busy, F.col("old") == F.col("c"), "left_anti").join(busy, F.col("new") == F.col("c"), "left_anti")
            moves = State(pairs, "moves")
            near.drop()
        ended = moves.df.isEmpty() and not (first and wake)
        if not ended:
            moved = State(roots.df.join(moves.df, F.col("root") == F.col("old"), "left").select("c", F.coalesce("new", "root").alias("root")), "roots")
            roots.drop()
            roots = moved
        if ended or last:
            break
        merged = state.join(moves.df, F.col("c") == F.col("old"), "left").select(F.coalesce("new", "c").alias("c"), "p")
        merged = merged.groupBy("c").agg(F.count("*").alias("k"), F.flatten(F.collect_list("p")).alias("p"))
        merged = merged.select("c", F.when(F.col("k") > 1, outline("p")).otherwise(F.col("p")).alias("p"), F.lit(False).alias("still"), F.lit(False).alias("hidden"))
        grown = State(merged, "clusters")
        for done in (moves, clusters) if clusters is not names else (moves,):
            done.drop()
        clusters, first = grown, False
    known = roots.df.join(names.df.select("c", "label"), "c").select(F.col("label").alias("l"), "root")
    known = known.join(names.df.select(F.col("c").alias("root"), F.col("label").alias("r")), "root").select("l", "r")
    same = ids.where("k = 1").join(equal.select("p", F.col("label").alias("l")), "p").select("id", "l").union(ids.where("k > 1").select("id", F.col("id").alias("l")))
    found = same.join(known, "l").select("id", "r")
    return nodes.join(found, "id", "left").select("id", F.coalesce("r", "label").alias("label"))
