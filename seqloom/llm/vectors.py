"""Near duplicates among vectors by collision-counting projections, and exact top-k search by KD-trees in shards."""

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from seqloom.llm.common import State, connected_components

#: Near duplicates: tables, quantised projections of a table's cell, width of a cell and half width of the window around
#: the query on the table's own projection (both for unit vectors, in units of distance / sqrt(dimension)), and the
#: least number of tables in which a linked pair meets. At the limit of cosine 0.98 (distance 0.2) a pair meets in a
#: table with probability 0.43, so in fewer than 3 of 32 with 5e-6 (calibrated() gives these figures).
TABLES, DEPTH, CELL, WINDOW, MEET = 32, 8, 8.0, 3.0, 3


def calibrated(tables: int = TABLES, depth: int = DEPTH, cell: float = CELL, window: float = WINDOW, meet: int = MEET) -> float:
    """Probability that a pair at the limit meets in fewer than `meet` tables. A difference of projections is normal."""
    near = math.erf(window / math.sqrt(2))
    grid = np.linspace(-cell, cell, 4001)
    same = float(np.sum((1 - np.abs(grid) / cell) * np.exp(-grid * grid / 2)) * (grid[1] - grid[0]) / math.sqrt(2 * math.pi))
    p = near * same**depth
    return sum(math.comb(tables, i) * p**i * (1 - p) ** (tables - i) for i in range(meet))


def usable(column):
    """Whether a vector is not null and holds finite numbers only."""
    return column.isNotNull() & (F.size(column) > 0) & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


#: Pairs that a window scan hands on at once.
PAIRS_BATCH = 1 << 18


def window_pairs(batches):
    """(a, b), a < b, of nodes within WINDOW of each other in one strip, from rows (label, t, cell, strip, place, node,
    guest) sorted so. Two guests are left to the strip that they come from.

    A row looks back at the rows before it that are inside the window, so a task holds the rows of one window and a batch.
    """
    import pyarrow as pa

    keys, places, nodes, guests = np.empty((0, 4), np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        old = len(places)
        column = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        keys = np.concatenate((keys, np.stack([c.astype(np.int64) for c in column[:4]], axis=1)))
        places, nodes, guests = np.concatenate((places, column[4])), np.concatenate((nodes, column[5])), np.concatenate((guests, column[6]))
        n = len(places)
        # First row of the strip, and first row of it that is inside the window; both by the order of the rows.
        new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
        head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        ends = np.r_[np.flatnonzero(new), n]
        first = head.copy()
        several = np.flatnonzero(np.diff(ends) > 1)
        for i, j in zip(ends[several].tolist(), ends[several + 1].tolist()):
            first[i:j] += np.searchsorted(places[i:j], places[i:j] - WINDOW)
        counts = np.arange(n) - first
        counts[:old] = 0
        i = old
        total = np.cumsum(counts)
        while i < n:
            done = total[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(total, done + PAIRS_BATCH, side="right")))
            c = counts[i:j]
            late = np.repeat(np.arange(i, j), c)
            early = np.arange(len(late)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[i:j], c)
            keep = ~(guests[late] & guests[early])
            x, y = nodes[late[keep]], nodes[early[keep]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])
            i = j
        # A later row of the last strip reaches back as far as the last one does.
        cut = max(int(first[-1]), int(head[-1]))
        keys, places, nodes, guests = keys[cut:], places[cut:], nodes[cut:], guests[cut:]


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: links of cosine >= `cosine` between rows of equal label.

    Null, empty and zero vectors, those that hold null or non-finite components, and rows without a label are linked
    with nothing. n_links counts the other rows that are linked directly; component_id is the smallest vec_id that can
    be reached, kept marks it. Null ids are never the smallest and not kept; repeated rows count each; vectors of
    different length are not linked; other columns are not read; an empty table gives no rows.

    Rows with the same label and vector are one node with a weight, so copies are linked through it and not pair by
    pair. In each of TABLES tables nodes are sorted by a projection within cells of DEPTH more projections and read once
    in that order; pairs within the window around each other in at least MEET tables are verified in double precision.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = State(rows.withColumn("ok", F.col("label").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False))), "vectors")
    good = rows.df.where("ok").where(F.exists("v", lambda x: x != 0))
    weights = good.groupBy("label", "v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    nodes = State(weights.withColumn("node", F.monotonically_increasing_id()), "nodes")
    close = 2 - 2 * cosine  # squared distance of unit vectors at the limit

    def meet(batches):
        import pyarrow as pa

        frames = {}
        for batch in batches:
            v = batch.column("v")
            sizes = np.diff(v.offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                x = np.array([v[i].as_py() for i in at.tolist()], dtype=np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if d not in frames:
                    rng = np.random.default_rng(d)
                    lines = rng.standard_normal((TABLES * (DEPTH + 1), d))
                    frames[d] = lines / np.linalg.norm(lines, axis=1, keepdims=True), rng.uniform(0, 1, (TABLES, DEPTH))
                lines, shift = frames[d]
                unit = math.sqrt(close / d)
                p = (x @ lines.T).reshape(len(at), TABLES, DEPTH + 1) / unit
                cells = np.floor(p[:, :, :DEPTH] / CELL + shift).astype(np.int64).astype(np.uint64)
                code = np.zeros((len(at), TABLES), dtype=np.uint64)
                for j in range(DEPTH):
                    code = code * np.uint64(0x100000001B3) + cells[:, :, j]
                code = code * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d)
                take = lambda c: np.repeat(batch.column(c).to_numpy()[at], TABLES)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(take("node")), pa.array(take("label")), pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(at))), pa.array(code.ravel().view(np.int64)), pa.array(np.ascontiguousarray(p[:, :, DEPTH]).ravel())],
                    names=["node", "label", "t", "cell", "place"],
                )

    met = nodes.df.select("node", "label", "v").mapInArrow(meet, "node long, label long, t int, cell long, place double")
    # Strips as wide as the window: a pair inside the window stands in one strip or in two that touch, so a node goes to
    # its own strip and, as a guest, to the next one. Each strip is sorted by the projection and read once.
    strip = F.floor(F.col("place") / WINDOW)
    lined = met.withColumn("strip", F.explode(F.array(strip, strip + 1))).withColumn("guest", F.col("strip") > strip)
    line = ["label", "t", "cell", "strip"]
    lined = lined.repartition(*line).sortWithinPartitions(*line, "place", "node").select(*line, "place", "node", "guest")
    pairs = lined.mapInArrow(window_pairs, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("met")).where(F.col("met") >= MEET).select("a", "b")

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            p, q = batch.column("p"), batch.column("q")
            x, y = p.values.to_numpy(), q.values.to_numpy()
            at = p.offsets.to_numpy()
            if not (np.diff(at) == np.diff(q.offsets.to_numpy())).all():
                raise ValueError("vectors of different length met")
            x, y = x[at[0] : at[-1]], y[q.offsets.to_numpy()[0] : q.offsets.to_numpy()[-1]]
            ends = (at - at[0])[:-1]
            # Scaled by the largest component, so that squares stay finite.
            n = np.diff(at)
            x = x / np.repeat(np.maximum.reduceat(np.abs(x), ends), n)
            y = y / np.repeat(np.maximum.reduceat(np.abs(y), ends), n)
            dot, xx, yy = (np.add.reduceat(z, ends) for z in (x * y, x * x, y * y))
            keep = pa.array(dot / (np.sqrt(xx) * np.sqrt(yy)) >= cosine)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    left, right = nodes.df.select(F.col("node").alias("a"), F.col("v").alias("p")), nodes.df.select(F.col("node").alias("b"), F.col("v").alias("q"))
    links = State(pairs.join(left, "a").join(right, "b").select("a", "b", "p", "q").where(F.size("p") == F.size("q")).mapInArrow(verify, "a long, b long"), "links")
    roots = connected_components(links.df)
    both = links.df.select("a", "b").union(links.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(nodes.df.select(F.col("node").alias("b"), "weight"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("others"))
    info = nodes.df.select("node", "label", "v", "weight", "least").join(linked, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = info.groupBy("root").agg(F.min("least").alias("component_id"))
    info = info.join(smallest, "root").select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n"), "component_id")
    out = rows.df.join(info, ["label", "v"], "left")
    component = F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


class KDTree:
    """Median splits of integer vectors on the widest side, with the tight box of every node."""

    def __init__(self, ids, points, leaf: int = 64):
        # Points in order of id, so that equal scores keep it.
        order = np.argsort(ids, kind="stable")
        self.ids, self.points = ids[order], points[order]
        self.nodes = []  # (least corner, greatest corner, children or None, rows or None)
        self._build(np.arange(len(ids)), leaf)

    def _build(self, rows, leaf):
        low, high = self.points[rows].min(axis=0), self.points[rows].max(axis=0)
        at = len(self.nodes)
        self.nodes.append(None)
        side = int(np.argmax(high - low))
        if len(rows) <= leaf or low[side] == high[side]:
            self.nodes[at] = (low, high, None, np.sort(rows))
            return at
        order = rows[np.argsort(self.points[rows, side], kind="stable")]
        half = len(order) // 2
        a, b = self._build(order[:half], leaf), self._build(order[half:], leaf)
        self.nodes[at] = (low, high, (a, b), None)
        return at

    def bounds(self, queries):
        """Largest inner product that each query can have in each node's box."""
        low, high = np.stack([n[0] for n in self.nodes]), np.stack([n[1] for n in self.nodes])
        return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T

    def search(self, query, own, k, bounds, floor):
        """The k best (score, id) for one query, scores above or at the floor: nodes are read in falling order of their
        bounds until no bound reaches the k-th score so far."""
        import heapq

        heap, best, kth = [(-bounds[0], 0)], [], floor
        while heap and -heap[0][0] >= kth:
            _, at = heapq.heappop(heap)
            _, _, children, rows = self.nodes[at]
            if children:
                for c in children:
                    if bounds[c] >= kth:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            scores = self.points[rows] @ query
            for i in np.flatnonzero(scores >= kth).tolist():
                name = int(self.ids[rows[i]])
                if name == own:
                    continue
                item = (scores[i], -name)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                kth = max(kth, best[0][0])
        return [(s, -n) for s, n in best]


#: Rows of a shard, cells of the splits at most (their boxes are broadcast: 2 numbers a cell and component), rows that
#: the splits are fitted on, shards a query is sent to before the k-th score goes to all, queries searched at once.
SHARD, CELLS, FIT_ROWS, FIRST, QUERIES_BLOCK = 16_384, 4096, 20_000, 1, 512

#: Copies of queries that are handed on at once.
SENT = 8192

#: Above this size of a possible score sums in double precision may be inexact.
EXACT = 2.0**53
LONG = 2**63 - 1


def median_splits(points, cells: int) -> list:
    """[(side, median, left, right) or (None, cell, ...)] of a tree with at most `cells` leaves over sampled points: the
    widest side is split at its median; node 0 is the root."""
    nodes, leaves = [], 0

    def grow(rows, wanted):
        nonlocal leaves
        at = len(nodes)
        nodes.append(None)
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) else np.zeros(1)
        side = int(np.argmax(spread))
        if wanted < 2 or len(rows) < 2 or not spread[side] > 0:
            nodes[at] = (None, leaves, 0, 0)
            leaves += 1
            return at
        value = float(np.median(rows[:, side]))
        low = rows[:, side] < value
        if not low.any():
            value = float(rows[:, side][rows[:, side] > value].min())
            low = rows[:, side] < value
        nodes[at] = (side, value, grow(rows[low], wanted // 2), grow(rows[~low], wanted - wanted // 2))
        return at

    grow(points, cells)
    return nodes


def cells_of(nodes: list, points) -> np.ndarray:
    """Leaf of every point."""
    out, todo = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
    while todo:
        at, rows = todo.pop()
        side, value, left, right = nodes[at]
        if side is None:
            out[rows] = value
        elif len(rows):
            low = points[rows, side] < value
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


def _matrix(column) -> np.ndarray:
    """An Arrow list column of one length as a matrix."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def _scaled(v, scale: int):
    """floor(scale * x) of doubles as whole doubles, or as Python integers if one is not whole in double precision."""
    if np.abs(v).max(initial=0) * scale < EXACT:
        return np.floor(v * scale)
    whole = [int(x) * scale if abs(x) >= EXACT else math.floor(Fraction(x) * scale) for x in v.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(v.shape)


def top_k(vectors: DataFrame, queries=None, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * x) of every query, exactly.

    Queries are the rows whose id is divisible by 100 unless a condition on `vec_id` is given; candidates are all other
    rows. Ties go to the smaller vec_id. Null, empty vectors, those that hold null or non-finite components and null
    ids take no part; of rows with one id the smallest vector counts; vectors of different length do not meet; other
    columns are not read; fewer candidates give fewer rows. Where a score may pass 2^53, whole numbers of any size are
    used; a score beyond a long is returned as the nearest long, its rank is exact within a shard.

    Median splits, fitted on FIT_ROWS rows, cut the space into cells, a cell of many rows into shards of about SHARD by
    a hash; cells keep the tight boxes of all their rows. A query goes to the cells in falling order of its bound: first to
    FIRST of them, then, with the k-th score found there, to those whose bound reaches it. A shard's rows go to one
    task once a round, which builds its KD-tree and reads the queries after them; queries are what is copied.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    queries = F.col("vec_id") % 100 == 0 if queries is None else queries
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)))
    points = State(rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v")), "points")
    sizes = {r["d"]: r["n"] for r in points.df.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").limit(16).collect()}
    # Lengths of vectors beyond the 16 most frequent ones have one cell each.
    trees = {}
    for d, n in sizes.items():
        cells = min(CELLS // len(sizes), -(-n // SHARD))
        if cells > 1:
            part = points.df.where(F.col("d") == d).orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).select("v")
            trees[d] = median_splits(np.array([r["v"] for r in part.toLocalIterator()]), cells)

    def place(batches):
        for batch in batches:
            d = batch.column("d").to_numpy()
            out = np.zeros(len(d), np.int32)
            for size in np.unique(d).tolist():
                if size in trees:
                    at = np.flatnonzero(d == size)
                    out[at] = cells_of(trees[size], _matrix(batch.column("v").take(pa.array(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=["vec_id", "v", "d", "cell"])

    placed = State(points.df.mapInArrow(place, "vec_id long, v array<double>, d int, cell int"), "placed")

    def box(batches):
        """Corners and number of rows of the cells of one task's rows."""
        found = {}
        for batch in batches:
            d, c = batch.column("d").to_numpy(), batch.column("cell").to_numpy()
            for size, cell in set(zip(d.tolist(), c.tolist())):
                at = np.flatnonzero((d == size) & (c == cell))
                v = _matrix(batch.column("v").take(pa.array(at)))
                low, high, n = found.get((size, cell), (math.inf, -math.inf, 0))
                found[size, cell] = np.minimum(low, v.min(axis=0)), np.maximum(high, v.max(axis=0)), n + len(at)
        if found:
            yield pa.RecordBatch.from_pylist(
                [{"d": s, "cell": c, "low": lo.tolist(), "high": hi.tolist(), "n": n} for (s, c), (lo, hi, n) in found.items()],
                pa.schema([("d", pa.int32()), ("cell", pa.int32()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("n", pa.int64())]),
            )

    parts = placed.df.select("v", "d", "cell").mapInArrow(box, "d int, cell int, low array<double>, high array<double>, n long")
    flat = parts.select("d", "cell", "n", F.posexplode(F.arrays_zip("low", "high")).alias("pos", "x")).groupBy("d", "cell", "pos").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.sum("n").alias("n"))
    boxes = State(flat.groupBy("d", "cell").agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("box"), F.max("n").alias("n")).select("d", "cell", F.col("box.low").alias("low"), F.col("box.high").alias("high"), "n"), "boxes")
    shards = F.ceil(F.col("n") / SHARD).cast("int")
    dealt = State(placed.df.join(boxes.df.select("d", "cell", shards.alias("shards")), ["d", "cell"]).withColumn("shard", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("shards")).cast("int")), "dealt")
    known = spark.sparkContext.broadcast({
        d: [np.array(x) for x in zip(*((r["cell"], r["shards"], r["low"], r["high"]) for r in found))]
        for d, found in _by_length(boxes.df.where(F.col("d").isin(list(sizes))).select("d", "cell", shards.alias("shards"), "low", "high").collect()).items()
    })

    def route(first):
        """Shards that a query goes to: those of its FIRST cells, or of all others whose bound reaches its floor."""
        def run(batches):
            for batch in batches:
                d = batch.column("d").to_numpy()
                for size in np.unique(d).tolist():
                    at = np.flatnonzero(d == size)
                    for i in range(0, len(at), QUERIES_BLOCK):
                        yield from sent(batch.take(pa.array(at[i : i + QUERIES_BLOCK])), size)

        def sent(batch, size):
            rows, cells, parts = [], [], []
            if size in known.value:
                cell, n, low, high = known.value[size]
                q, floors = _matrix(batch.column("v")), batch.column("floor").to_numpy(zero_copy_only=False)
                # floor(scale * x) grows with x. A product that may pass 2^53 has no bound.
                with np.errstate(over="ignore", invalid="ignore"):
                    p, lo, hi = np.floor(q * scale), np.floor(low * scale), np.floor(high * scale)
                    largest = np.maximum(np.abs(lo), np.abs(hi)).max(axis=1)[None, :] * np.abs(p).max(axis=1)[:, None] * size
                    bound = np.maximum(p, 0) @ hi.T + np.minimum(p, 0) @ lo.T
                    bound = np.where(largest < EXACT, bound, np.inf)
                order = np.argsort(-bound, axis=1, kind="stable")
                for i in range(len(q)):
                    reached = order[i, :FIRST] if first else order[i, FIRST:]
                    for c in reached[~(bound[i, reached] < floors[i])].tolist():
                        rows += [i] * int(n[c])
                        cells += [int(cell[c])] * int(n[c])
                        parts += range(int(n[c]))
            elif first:
                # One cell, in as many shards as stand on the row.
                for i, n in enumerate(batch.column("shards").to_pylist()):
                    rows += [i] * n
                    cells += [0] * n
                    parts += range(n)
            for i in range(0, len(rows), SENT):
                taken = batch.take(pa.array(rows[i : i + SENT], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [taken.column("vec_id"), taken.column("v"), taken.column("d"), pa.array(cells[i : i + SENT], pa.int32()), pa.array(parts[i : i + SENT], pa.int32()), taken.column("floor")],
                    names=["vec_id", "v", "d", "cell", "shard", "floor"],
                )

        return run

    def search(batches):
        """Rows sorted by shard, a shard's own rows before its queries: the tree is built when the first query comes."""
        shard, held, tree = None, [], None
        for batch in batches:
            column = {c: batch.column(c) for c in batch.schema.names}
            keys = np.stack([column[c].to_numpy().astype(np.int64) for c in ("d", "cell", "shard", "query")], axis=1)
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if j == i:
                    continue
                if shard != tuple(keys[i, :3]):
                    shard, held, tree = tuple(keys[i, :3]), [], None
                v = _scaled(_matrix(column["v"].slice(i, j - i)), scale)
                names = column["vec_id"].slice(i, j - i).to_numpy()
                if not keys[i, 3]:
                    held.append((names, v))
                    continue
                if not held:
                    continue
                if tree is None:
                    tree = KDTree(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                    held = [(tree.ids, tree.points)]
                    size = max(int(abs(x)) for x in (tree.points.max(), tree.points.min()))
                floors = column["floor"].slice(i, j - i).to_numpy(zero_copy_only=False)
                for at in range(0, len(v), QUERIES_BLOCK):
                    out = ([], [], [])
                    some = v[at : at + QUERIES_BLOCK]
                    if size * max(int(abs(some.max())), int(abs(some.min()))) * some.shape[1] >= EXACT:
                        found = [large_search(tree, q, own, k) for q, own in zip(some, names[at:].tolist())]
                    else:
                        bounds = tree.bounds(some.astype(np.float64))
                        found = [tree.search(some[r], own, k, bounds[r], -math.inf if math.isnan(f) else f) for r, (own, f) in enumerate(zip(names[at : at + len(some)].tolist(), floors[at:].tolist()))]
                    for own, best in zip(names[at:].tolist(), found):
                        for score, name in best:
                            out[0].append(own)
                            out[1].append(name)
                            out[2].append(max(-LONG - 1, min(LONG, int(score))))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])

    for state in (points, placed, boxes):
        state.drop()
    asked = dealt.df.where(queries).select("vec_id", "v", "d", "shards")
    no_floor = F.lit(float("nan"))
    columns = ["vec_id", "v", "d", "cell", "shard"]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def searched(some, first):
        sent = some.mapInArrow(route(first), "vec_id long, v array<double>, d int, cell int, shard int, floor double")
        # The first round reads the shards that a query goes to.
        wanted = dealt.df.join(sent.select("d", "cell", "shard").distinct(), ["d", "cell", "shard"], "left_semi")
        lined = wanted.select(*columns, no_floor.alias("floor"), F.lit(0).alias("query")).unionByName(sent.withColumn("query", F.lit(1)))
        lined = lined.repartition("d", "cell", "shard").sortWithinPartitions("d", "cell", "shard", "query")
        found = lined.mapInArrow(search, "query_id long, vec_id long, score long")
        # Spark keeps the k first rows of a query in each task before the shuffle.
        return State(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "found")

    best = searched(asked.withColumn("floor", no_floor), True)
    # A score at the end of the longs may stand for a larger one, so it bounds nothing.
    kth = best.df.groupBy(F.col("query_id").alias("vec_id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where((F.col("n") >= k) & (F.abs(F.col("kth").cast("double")) < EXACT))
    rest = searched(asked.join(kth.select("vec_id", F.col("kth").cast("double").alias("floor")), "vec_id", "left").withColumn("floor", F.coalesce("floor", no_floor)), False)
    every = best.df.union(rest.df)
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _by_length(rows) -> dict:
    out = {}
    for r in rows:
        out.setdefault(r["d"], []).append(r)
    return out


def large_search(tree: KDTree, query, own, k: int) -> list:
    """The k best (score, id) in whole numbers of any size, from all rows of the tree."""
    points = np.array([[int(x) for x in p] for p in tree.points], dtype=object)
    scores = points @ np.array([int(x) for x in query], dtype=object)
    return sorted(((s, n) for s, n in zip(scores.tolist(), tree.ids.tolist()) if n != own), key=lambda x: (-x[0], x[1]))[:k]
