"""Near duplicates of documents: fast similarity sketching, banding, exact verification, components."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import State, connected_components, slices
from seqloom.llm.text import mix, shingle_sets

#: Bands and rows of the sketch. A pair of similarity 0.75 shares no band with probability (1 - 0.75^6)^56 = 1.7e-5,
#: one of 0.8 with 4e-8.
BANDS, ROWS = 56, 6
#: Sketch coordinates that are also kept as one bit each, and the least number of equal bits of a pair that is verified.
#: At similarity 0.75 the mean is 224 with a deviation of 5.3, so a linked pair falls below with probability 2e-7.
BITS, ALIKE = 256, 196

#: Least similarity, in percent, that the bands and the bounds ALIKE and WIDE_ALIKE are made for.
PERCENT = 75
#: Heads of buckets that a document is compared with first.
HEADS = 4
#: Coordinates of the wide sketch, a bit each, of documents that meet others outside their component, and the least
#: number of equal bits: the mean at similarity 0.75 is 3584 with a deviation of 21, so a linked pair falls below with
#: probability 1e-7, while most pairs of similarity under 0.69 are dropped unread.
WIDE, WIDE_ALIKE = 4096, 3474
#: Members of a block that is compared by wide sketches, and by full sets.
WIDE_BLOCK, EXACT_BLOCK = 1024, 256

_SEEDS = np.random.default_rng(7).integers(0, 1 << 63, 1 << 14, dtype=np.uint64)


def sketches(sets: list, t: int) -> np.ndarray:
    """Sketch of t coordinates of each non-empty set of hashes; two coordinates agree with probability of the similarity.

    Round i < t throws every element into a random bin with value i + its hash; a later round t + j gives bin j to all
    elements. A bin keeps its least value, so the first rounds that reach it decide and every bin is filled after 2t
    rounds; a set leaves as soon as its bins are full, after about t log t / size rounds.
    """
    n = len(sets)
    out = np.full(n * t, np.iinfo(np.uint64).max, dtype=np.uint64)
    items = np.concatenate(sets) if n else np.empty(0, np.uint64)
    rows = np.repeat(np.arange(n, dtype=np.int64), [len(s) for s in sets])
    empty, left = np.ones(n * t, dtype=bool), np.full(n, t, dtype=np.int64)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items ^ _SEEDS[i % len(_SEEDS)] + np.uint64(i // len(_SEEDS)))
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        at = rows * t + bins
        # A bin that an earlier round has filled keeps its value.
        new = empty[at]
        at = at[new]
        np.minimum.at(out, at, np.uint64(i << 48) | (mix(h[new]) >> np.uint64(16)))
        empty[at] = False
        at = np.unique(at)
        left -= np.bincount(at // t, minlength=n)
        stay = left[rows] > 0
        if not stay.all():
            items, rows = items[stay], rows[stay]
    return out.reshape(n, t)


def _described(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, check, node, n_shingles, bits, keys): node is a hash of the set, null without words."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        names = ["doc_id", "check", "node", "n_shingles", "bits", "keys"]
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for i, j in slices(sizes, 1 << 21):
                sets = shingle_sets(batch.column(2)[i:j].to_pylist(), words)
                some = [k for k, s in enumerate(sets) if len(s)]
                table = sketches([sets[k] for k in some], bands * rows)
                keys = np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(some), 1), np.uint64)
                for r in range(rows):
                    keys = mix(keys * np.uint64(3) + table[:, r::rows])
                marks = (mix(table[:, np.arange(BITS) % (bands * rows)]) & np.uint64(1)).astype(np.uint8)
                bits = np.ascontiguousarray(np.packbits(marks, axis=1)).view(np.int64)
                node = [int(np.bitwise_xor.reduce(mix(sets[k] + np.uint64(1))) + np.uint64(len(sets[k]))) for k in some]
                at = dict(zip(some, range(len(some))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[i:j], batch.column(1)[i:j],
                        pa.array([np.uint64(node[at[k]]).astype(np.int64) if k in at else None for k in range(j - i)], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([bits[at[k]] if k in at else None for k in range(j - i)], pa.list_(pa.int64())),
                        pa.array([keys[at[k]].view(np.int64) if k in at else None for k in range(j - i)], pa.list_(pa.int64())),
                    ],
                    names=names,
                )

    return docs.mapInArrow(run, "doc_id long, check long, node long, n_shingles long, bits array<long>, keys array<long>")


def _wide(texts: DataFrame, words: int) -> DataFrame:
    """(wide_node, wide): the wide sketch of each node's text as WIDE bits."""

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for i, j in slices(sizes, 1 << 21):
                marks = (mix(sketches(shingle_sets(batch.column(1)[i:j].to_pylist(), words), WIDE)) & np.uint64(1)).astype(np.uint8)
                bits = np.ascontiguousarray(np.packbits(marks, axis=1)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(list(bits), pa.list_(pa.int64()))], names=["wide_node", "wide"])

    return texts.select("node", "text").mapInArrow(run, "wide_node long, wide array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are similar enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for whole in batches:
            sizes = [x + y for x, y in zip(pc.binary_length(whole.column("ta")).to_pylist(), pc.binary_length(whole.column("tb")).to_pylist())]
            for i, j in slices(sizes, 1 << 22):
                batch = whole.slice(i, j - i)
                a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
                # Texts by node: a text that stands in many pairs is read once.
                first = {}
                for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
                    first.setdefault(x, ("ta", k))
                    first.setdefault(y, ("tb", k))
                sets = dict(zip(first, shingle_sets([batch.column(c)[k].as_py() for c, k in first.values()], words)))
                keep = []
                for x, y in zip(a.tolist(), b.tolist()):
                    p, q = sets[x], sets[y]
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * common >= percent * (len(p) + len(q) - common))
                keep = np.array(keep, dtype=bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def forest(p, q) -> np.ndarray:
    """Indices of edges (p[i], q[i]) that join all the labels which the edges join, and no more than needed."""
    labels, ends = np.unique(np.concatenate((p, q)), return_inverse=True)
    p, q = ends[: len(p)], ends[len(p) :]
    label, left, chosen = np.arange(len(labels)), np.arange(len(p)), []
    while True:
        a, b = label[p[left]], label[q[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            return np.concatenate(chosen) if chosen else np.empty(0, np.int64)
        high, first = np.unique(np.maximum(a, b), return_index=True)
        chosen.append(left[first])
        up = np.arange(len(labels))
        up[high] = np.minimum(a, b)[first]
        while True:
            over = up[up]
            if (over == up).all():
                break
            up = over
        label = up[label]


def _near(percent: int):
    """Marks of pairs of a block whose sizes fit and whose wide sketches are alike."""

    def find(left, right):
        signs = [np.unpackbits(t.column("wide").combine_chunks().flatten().to_numpy().view(np.uint8).reshape(t.num_rows, -1), axis=1).astype(np.float32) * 2 - 1 for t in (left, right)]
        n, m = (t.column("n_shingles").to_numpy() for t in (left, right))
        fit = 100 * np.minimum(n[:, None], m[None, :]) >= percent * np.maximum(n[:, None], m[None, :])
        return fit & (signs[0] @ signs[1].T >= 2 * WIDE_ALIKE - WIDE)

    return find


def _linked(words: int, percent: int):
    """Marks of pairs of a block whose full sets are similar enough: sizes of intersections as a product of 0-1 rows."""

    def find(left, right):
        sets = shingle_sets(left.column("text").to_pylist() + right.column("text").to_pylist(), words)
        sizes = np.array([len(x) for x in sets])
        n, rows = left.num_rows, np.repeat(np.arange(len(sets)), sizes)
        _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # What stands in one set only is in no intersection.
        twice = seen[column] > 1
        rows, column = rows[twice], np.unique(column[twice], return_inverse=True)[1]
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        common = np.zeros((n, len(sets) - n), dtype=np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            a, b = np.searchsorted(column, [start, start + 8192])
            held = np.zeros((len(sets), 8192), dtype=np.float32)
            held[rows[a:b], column[a:b] - start] = 1
            common += held[:n] @ held[n:].T
        common = common.astype(np.int64)
        return 100 * common >= percent * (sizes[:n, None] + sizes[None, n:] - common)

    return find


def _blockwise(members: DataFrame, group: str, find, size: int, payload: str) -> DataFrame:
    """(a, root, b, other): members a of a group that `find` marks with a member of another root, with b null; and of
    these pairs as many as join the roots of a block.

    The members of a group are cut into blocks of about `size` and every two blocks meet in a task of their own, but
    for blocks of the group's largest root alone, which has nothing to find in itself.
    """
    name = payload.split()[0]
    per_root = members.groupBy(group, "root").agg(F.count(F.lit(1)).alias("n"))
    stats = per_root.groupBy(group).agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    blocks = lambda n: F.ceil(n / size).cast("int")
    stats = stats.select(group, F.col("top.root").alias("most"), blocks(F.col("all") - F.col("top.n")).alias("strays"), blocks(F.col("top.n")).alias("bulk"))
    rows = members.join(stats, group).withColumn("big", F.col("root") == F.col("most"))
    spot = lambda n: F.pmod(F.xxhash64("node"), F.greatest(n, F.lit(1))).cast("int")
    rows = rows.withColumn("own", F.when(F.col("big"), F.col("strays") + spot(F.col("bulk"))).otherwise(spot(F.col("strays"))))
    others = F.when(F.col("big"), F.sequence(F.lit(0), F.col("strays") - 1)).otherwise(F.sequence(F.lit(0), F.col("strays") + F.col("bulk") - 1))
    rows = rows.where("strays > 0").withColumn("meets", F.explode(others))
    rows = rows.select(F.col(group).alias("grp"), F.least("own", "meets").alias("i"), F.greatest("own", "meets").alias("j"), "own", "node", "root", "n_shingles", name)

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = table.filter(pc.equal(table.column("own"), i)), table.filter(pc.equal(table.column("own"), j))
        names = ["a", "root", "b", "other"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64())] * 4, names=names)
        (a, ra), (b, rb) = (((t.column("node").to_numpy(), t.column("root").to_numpy())) for t in (left, right))
        x, y = np.nonzero(find(left, right) & (ra[:, None] != rb[None, :]))
        keep = forest(ra[x], rb[y])
        ends = [(a[k], ra[k]) for k in np.unique(x)] + [(b[k], rb[k]) for k in np.unique(y)]
        ends = sorted(set((int(n), int(r)) for n, r in ends))
        x, y = x[keep], y[keep]
        blank = [None] * len(ends)
        return pa.Table.from_arrays(
            [pa.array([n for n, _ in ends] + a[x].tolist(), pa.int64()), pa.array([r for _, r in ends] + ra[x].tolist(), pa.int64()), pa.array(blank + b[y].tolist(), pa.int64()), pa.array(blank + rb[y].tolist(), pa.int64())],
            names=names,
        )

    return rows.groupBy("grp", "i", "j").applyInArrow(run, "a long, root long, b long, other long")


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = 5, bands: int = BANDS, rows: int = ROWS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, group): components of documents that are near copies of each other.

    A text's set holds the distinct `words`-word shingles of its lower-cased (A-Z) words, of the whole sequence if it
    is shorter. Two documents are linked if 100 * intersection >= percent * union; percent is PERCENT at least, as the
    bands and the bounds on equal bits are made for it. component_id is the smallest doc_id
    in the component, kept marks it, group is the same for the members of a component. Null and wordless texts have an
    empty set and are linked with nothing. Null ids take part and are never the smallest; repeated rows give one row
    each. Equal sets are one node (known by a 64-bit hash). Other columns are not read; an empty table gives no rows.

    The member of a bucket that meets most others is its head; each document is compared with the first HEADS of its
    heads. Then, in buckets whose members are not yet in one component, those of different components are compared block
    by block, by matrix products over their wide sketches. Components that are near each other form clouds, and the
    members of a cloud that are near another component are compared on their full sets, block by block too. A block
    hands on no pairs but those that join its components, so rows follow the members, not their pairs. A pair is dropped
    unread only if its sketches differ far more than those of a linked pair can; every other is verified on full sets.
    """
    if percent < PERCENT:
        raise ValueError(f"the bands and sketches find links of {PERCENT} percent and more, not of {percent}")
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("check"), F.col(text).cast("string").alias("text"))
    described = State(_described(source, words, bands, rows), "sketches")
    all_docs = described.df.select("doc_id", "check", "node", "n_shingles")
    nodes = described.df.where("node is not null")
    sample = nodes.dropDuplicates(["node"])
    keyed = sample.select("node", "n_shingles", F.explode("keys").alias("bucket"))
    shared_by = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = State(keyed.join(shared_by, "bucket"), "buckets")
    # The head of a bucket is the member that meets most others in all bands: in a group of copies of one text that
    # differ from each other more than from it, that text.
    met = members.df.groupBy("node").agg(F.sum("size").alias("met"))
    heads = members.df.join(met, "node").groupBy("bucket").agg(F.max(F.struct("met", "node")).alias("head"))

    # The whole text of one document of each node that shares a bucket.
    named = nodes.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "check")).alias("at"), F.first("bits").alias("bits"))
    shared = named.join(members.df.select("node").distinct(), "node").select("node", "bits", "at.doc_id", "at.check")
    same = source.join(shared.withColumnRenamed("doc_id", "id").withColumnRenamed("check", "hash"), (F.col("doc_id").eqNullSafe(F.col("id"))) & (F.col("check") == F.col("hash")))
    texts = State(same.dropDuplicates(["node"]).select("node", "bits", "text"), "texts")

    def alike(x, y):
        return sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(BITS // 64)), F.lit(0)) <= BITS - ALIKE

    bits = texts.df.select("node", "bits")
    # A node's first few heads (it has one in each band at most); what they leave apart is compared below.
    own = members.df.join(heads, "bucket").where("head.node <> node").groupBy("node").agg(F.slice(F.sort_array(F.collect_set("head"), False), 1, HEADS).alias("heads"))
    stars = own.select(F.col("node").alias("b"), F.explode("heads.node").alias("a"))
    stars = stars.join(bits.select(F.col("node").alias("a"), F.col("bits").alias("p")), "a").join(bits.select(F.col("node").alias("b"), F.col("bits").alias("q")), "b").where(alike(F.col("p"), F.col("q"))).select("a", "b")
    links = State(_verified(stars, texts.df, words, percent), "links")
    roots = connected_components(links.df)

    # Buckets with members of several components: pairs across components.
    settled = members.df.join(roots, "node", "left").select("bucket", "node", "n_shingles", F.coalesce("root", "node").alias("root"))
    mixed = settled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    open_rows = State(settled.join(mixed, "bucket"), "open")
    wide = State(_wide(texts.df.join(open_rows.df.select("node").distinct(), "node"), words), "wide")
    open_ = open_rows.df.join(wide.df, F.col("node") == F.col("wide_node")).drop("wide_node")
    # Candidates by their wide sketches: which components are near each other, and by which members.
    near = State(_blockwise(open_, "bucket", _near(percent), WIDE_BLOCK, "wide array<long>"), "near")
    clouds = connected_components(near.df.where("b is not null").select(F.col("root").alias("a"), F.col("other").alias("b")))
    # All members of a cloud that are near something outside their component meet on their full sets, each pair once.
    meant = near.df.select(F.col("a").alias("node"), "root").distinct().join(clouds.select(F.col("root").alias("cloud"), F.col("node").alias("root")), "root")
    meant = State(meant.join(texts.df.select("node", "text"), "node").withColumn("n_shingles", F.lit(0).cast("long")), "clouds")
    more = State(_blockwise(meant.df, "cloud", _linked(words, percent), EXACT_BLOCK, "text string").where("b is not null").select("a", "b"), "links")
    if more.df.limit(1).count():
        roots = connected_components(links.df.union(more.df))
    for state in (members, texts, links, open_rows, wide, near, meant, more):
        state.drop()

    grouped = all_docs.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    least = grouped.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
    out = grouped.join(least, "group", "left").withColumn("component_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("least")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "group", "check")
