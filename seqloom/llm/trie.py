"""The prefix trie of conversations: nodes by hashed paths, totals of subtrees along centroid paths."""

import copy
import hashlib
import pickle
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from seqloom.llm.common import State, planes, unplanes

#: Turns in a bundle, ids of conversations in a bundle, and depths of a centroid path in one window.
BUNDLE, IDS, STRETCH = 1 << 16, 1 << 14, 1 << 12
#: Fixed by the contract: conversations of a family take over fewer than HEADS + 1 turns of its first one.
FAMILY, HEADS = 20, 3

_MASK = (1 << 64) - 1
#: A sequence of turns as the map x -> a * x + c modulo 2^64, with a odd; this is the empty one.
EMPTY = (1, 0)


def then(f, g):
    """The map that does f first and g after it."""
    return (f[0] * g[0]) & _MASK, (f[1] * g[0] + g[1]) & _MASK


def undo(f):
    a = pow(f[0], -1, 1 << 64)
    return a, -f[1] * a & _MASK


def family_of(conv: int) -> int:
    """conv - conv % FAMILY, with SQL's remainder."""
    return conv - conv % FAMILY if conv >= 0 else conv + -conv % FAMILY


def taken(conv: int) -> int:
    """How many turns a conversation takes over from the first one of its family; that one is left as it is."""
    return 0 if conv == family_of(conv) else zlib.crc32(str(conv).encode()) % (HEADS + 1)


class Walk:
    """Where a reader of sorted turns stands: the conversation, the map of its turns so far, the maps of its first turns
    and those of its family's first conversation, which comes before the others.

    Maps of parts are joined by `then`, so a reader can begin inside a conversation with the state of the one before.
    """

    def __init__(self):
        self.conv = self.family = None
        self.n, self.path, self.own, self.base = 0, EMPTY, [], []

    def go(self, conv: int, n: int, path, heads) -> None:
        """Read n turns of conv whose map is path; heads: maps and words of the first ones."""
        if conv != self.conv:
            family = family_of(conv)
            if family != self.family:
                self.family, self.base = family, []
            self.conv, self.n, self.path, self.own = conv, 0, EMPTY, []
            if conv == family:
                self.base = self.own
        for step, words in heads[: HEADS - len(self.own)]:
            self.own.append((then(self.path, step), words))
        self.n, self.path = self.n + n, then(self.path, path)


def _run(conv, steps, words):
    """What Walk.go needs of consecutive turns of a conversation."""
    path, heads = EMPTY, []
    for step, w in zip(steps, words):
        path = then(path, step)
        if len(heads) < HEADS:
            heads.append((path, w))
    return conv, len(steps), path, heads


def _steps(h1, h2):
    return list(zip((h1.view(np.uint64) | np.uint64(1)).tolist(), h2.view(np.uint64).tolist()))


def _bundles(batches, most):
    """Rows of sorted turns as arrays, with what the readers of later bundles need to know of them."""
    import pyarrow as pa

    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def bundle():
        nonlocal seq, held, size
        conv, h1, h2, words = (np.concatenate(x) for x in zip(*held))
        last = int(conv[-1])
        runs = []
        for c in dict.fromkeys((family_of(last), last)):
            rows = np.flatnonzero(conv == c)
            if len(rows):
                runs.append(_run(c, _steps(h1[rows], h2[rows]), words[rows].tolist()))
        data = b"".join(x.tobytes() for x in (conv, h1, h2, words))
        row = pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(conv[0])], pa.int64()), pa.array([pickle.dumps(runs)], pa.binary()), pa.array([data], pa.binary())],
            names=["part", "seq", "first", "runs", "data"],
        )
        seq, held, size = seq + 1, [], 0
        return row

    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for i in range(4)]
        for i in range(0, batch.num_rows, most):
            held.append([c[i : i + most] for c in cols])
            size += len(held[-1][0])
            if size >= most:
                yield bundle()
    if size:
        yield bundle()


def _paths(convs, steps, words, walk: Walk, following):
    """Rows (a, c, parent a, parent c, depth, conv, words, end) of a bundle's conversations on the nodes they pass.

    The root is left out, but for conversations without turns. following: the conversation after the bundle, or None.
    """
    out = []
    n = len(convs)
    conv, start, h = None, EMPTY, 0
    for i in range(n):
        before = walk.path if walk.conv == convs[i] else EMPTY
        walk.go(convs[i], 1, steps[i], [(steps[i], words[i])])
        at = walk.n - 1
        if convs[i] != conv:
            conv, h, start = convs[i], taken(convs[i]), None
        shared = min(h, len(walk.base)) if h else 0
        last = (convs[i + 1] if i + 1 < n else following) != conv
        if at == h or (last and at < h):
            ends = last and at < h
            path = EMPTY
            for d in range(shared):
                node, w = walk.base[d]
                out.append((*node, *path, d + 1, conv, w, int(ends and d + 1 == shared)))
                path = node
            if ends and not shared:
                out.append((*EMPTY, *EMPTY, 0, conv, 0, 1))
        if at >= h:
            if start is None:
                # The shared turns stand in the place of the first h own ones.
                start = then(walk.base[shared - 1][0] if shared else EMPTY, undo(walk.own[h - 1][0])) if h else EMPTY
            out.append((*then(start, walk.path), *then(start, before), shared + at - h + 1, conv, words[i], int(last)))
    return out


_MEMBERS = "a long, c long, pa long, pc long, depth long, conv long, words long, end int"


def members(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bundle: int = BUNDLE) -> DataFrame:
    """One row for each rebuilt conversation and node it passes, below the root."""
    spark = turns.sparkSession
    rows = turns.select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("nth"),
    ).where("conv is not null")
    family = F.col("conv") - F.col("conv") % FAMILY
    rows = rows.select(
        family.alias("family"), (F.col("conv") != family).alias("later"), "conv", "turn", "role", F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(1), "text", "role").alias("h2"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"), "nth",
    )
    # Equal rows of one conversation may be many; their place in the input parts them.
    order = ["family", "later", "conv", F.col("turn").asc_nulls_first(), "role", "h1", "nth"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "h1", "h2", "words")
    state = State(ranged.mapInArrow(lambda batches: _bundles(batches, bundle), "part int, seq int, first long, runs binary, data binary"), "turns")
    # One row for each bundle of turns, of a few hundred bytes: the state before each bundle.
    walk, before, last = Walk(), {}, None
    for r in state.df.select("part", "seq", "first", "runs").orderBy("part", "seq").collect():
        if last is not None:
            before[last][1] = r["first"]
        last = (r["part"], r["seq"])
        before[last] = [copy.deepcopy(walk), None]
        for run in pickle.loads(r["runs"]):
            walk.go(*run)
    places = spark.sparkContext.broadcast(before)

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for part, seq, data in zip(batch.column("part").to_pylist(), batch.column("seq").to_pylist(), batch.column("data")):
                conv, h1, h2, words = np.frombuffer(data.as_buffer(), np.int64).reshape(4, -1)
                walk, following = copy.deepcopy(places.value[part, seq])
                rows = _paths(conv.tolist(), _steps(h1, h2), words.tolist(), walk, following)
                for k in range(0, len(rows), 1 << 16):
                    cols = list(zip(*rows[k : k + (1 << 16)]))
                    keys = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in cols[:4]]
                    yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x, pa.int64()) for x in cols[4:7]), pa.array(cols[7], pa.int32())], names=["a", "c", "pa", "pc", "depth", "conv", "words", "end"])

    found = State(state.df.select("part", "seq", "data").mapInArrow(read, _MEMBERS), "members")
    state.drop()
    return found.df


def end_digests(ends: DataFrame, most: int = IDS) -> DataFrame:
    """(a, c, ends_sha256): the hash of the comma-joined ids of the conversations that end at a node, ascending.

    Rows are ranged by node and id. A node inside one partition is hashed there; one that reaches over several, or has
    more than `most`, sends its ids on in packed bundles, and only these meet in one task, as a hash is a sequence.
    """

    def pack(batches):
        import pyarrow as pa

        rows, node, ids, whole = [], None, [], False

        def bundle():
            rows.append((*node, ids[0], planes(np.diff(np.array(ids, np.int64), prepend=np.int64(0))), None))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], names=["a", "c", "first", "ids", "sha"])
            rows.clear()
            return out

        for batch in batches:
            for a, c, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (a, c) != node:
                    if node is not None:
                        if whole:
                            rows.append((*node, ids[0], None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
                        else:
                            bundle()
                    whole, node, ids = node is not None, (a, c), []
                elif len(ids) >= most:
                    bundle()
                    whole, ids = False, []
                ids.append(conv)
                if len(rows) >= 4096:
                    yield flush()
        if node is not None:
            bundle()
        if rows:
            yield flush()

    def join(parts):
        import pyarrow as pa

        parts, sha, comma = parts.sort_by("first"), hashlib.sha256(), b""
        for raw in parts.column("ids"):
            sha.update(comma + ",".join(map(str, np.cumsum(unplanes(raw.as_py(), np.int64)).tolist())).encode())
            comma = b","
        return pa.Table.from_arrays([parts.column("a")[:1], parts.column("c")[:1], pa.array([sha.hexdigest()])], names=["a", "c", "ends_sha256"])

    ranged = ends.select("a", "c", "conv").repartitionByRange("a", "c", "conv").sortWithinPartitions("a", "c", "conv")
    packed = State(ranged.mapInArrow(pack, "a long, c long, first long, ids binary, sha string"), "ends")
    done = packed.df.where("sha is not null").select("a", "c", F.col("sha").alias("ends_sha256"))
    return done.union(packed.df.where("sha is null").groupBy("a", "c").applyInArrow(join, "a long, c long, ends_sha256 string"))


def centroid_totals(nodes: DataFrame, passed: DataFrame, values: list, stretch: int = STRETCH) -> DataFrame:
    """nodes (a, c, depth, conv_id, n_convs, values...) -> the same with every value summed over the node's subtree.

    passed: (a, c, conv, depth) of the conversations on the nodes. A component is a subtree of the forest of parent
    edges. Its nodes with as many conversations as its top, counted in powers of two, are one path, as two subtrees of
    a node cannot both have so many; the lowest is the centroid, and what hangs on the path are components of fewer
    conversations, which are split in the same way. So there are at most log2(conversations) paths over a node, known
    from the counts without a round for each level: a conversation has a row for each path it goes along, with the
    path's top and the foot where it leaves it. Values are added up for each conversation and path, these totals are
    hung on the feet of the paths above, and each path is added up from its centroid to its top.
    """
    level = (F.length(F.bin("n_convs")) - 1).alias("level")
    known = nodes.select("a", "c", "conv_id", level, *values)
    seen = passed.join(known, ["a", "c"])
    own = [F.sum(F.when(F.col("conv") == F.col("conv_id"), F.col(v)).otherwise(0)).alias(v) for v in values]
    ends = [pick(x, "depth").alias(f"{name}_{x}") for name, pick in (("top", F.min_by), ("foot", F.max_by)) for x in ("a", "c")]
    runs = State(seen.groupBy("conv", "level").agg(*ends, *own), "runs")
    # A conversation has a row for each of its levels at most.
    lower = Window.partitionBy("conv").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    below = runs.df.select(F.col("foot_a").alias("a"), F.col("foot_c").alias("c"), *(F.coalesce(F.sum(v).over(lower), F.lit(0)).alias(v) for v in values))
    hung = below.where(" or ".join(f"{v} <> 0" for v in values)).groupBy("a", "c").agg(*(F.sum(v).alias(f"{v}_hung") for v in values))
    filled = nodes.join(hung, ["a", "c"], "left").withColumn("level", level)
    for v in values:
        filled = filled.withColumn(v, F.col(v) + F.coalesce(F.col(f"{v}_hung"), F.lit(0))).drop(f"{v}_hung")
    tops = runs.df.select(F.col("conv").alias("conv_id"), "level", "top_a", "top_c")
    filled = State(filled.join(tops, ["conv_id", "level"]).withColumn("stretch", F.floor(F.col("depth") / stretch)), "paths")
    # Along a path in two steps, so that a long path is in no single window.
    rest = Window.partitionBy("top_a", "top_c").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    sums = filled.df.groupBy("top_a", "top_c", "stretch").agg(*(F.sum(v).alias(f"{v}_s") for v in values))
    sums = sums.select("top_a", "top_c", "stretch", *(F.coalesce(F.sum(f"{v}_s").over(rest), F.lit(0)).alias(f"{v}_s") for v in values))
    near = Window.partitionBy("top_a", "top_c", "stretch").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = filled.df.select("*", *(F.sum(v).over(near).alias(f"{v}_w") for v in values)).join(sums, ["top_a", "top_c", "stretch"])
    return within.select(*(c for c in nodes.columns if c not in values), *((F.col(f"{v}_w") + F.col(f"{v}_s")).alias(v) for v in values))


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", bundle: int = BUNDLE, most: int = IDS, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    A conversation's turns are ordered by turn (null first; ties by role, then by a hash of the turn, so equal rows are
    turns of their own) and rebuilt: the first `taken` turns of its family's first conversation, if that has rows, take
    the place of as many own ones. Null roles and texts are empty; rows without conv_id belong to no conversation; other
    columns are not read; an empty table gives no rows.

    Sequences of turns are known by 127-bit hashes that can be joined, so a conversation of any length is read in
    parts. A hot node is one key that is added up before the shuffle. bundle (turns read as one), most (ids hashed at
    once) and stretch (depths in one window) bound what a task holds; the result does not depend on them.
    """
    passed = members(turns, conv, turn, role, text, bundle)
    ends = passed.where("end = 1").select("a", "c", "conv", "depth")
    shas = end_digests(ends, most)
    grouped = passed.where("depth > 0").groupBy("a", "c").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"), F.first("pa").alias("pa"), F.first("pc").alias("pc"), F.first("words").alias("words"), F.sum("end").alias("n_ends")
    )
    nodes = grouped.select(
        "a", "c", "conv_id", "n_convs", "depth", "pa", "pc", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
    )
    nodes = State(nodes, "nodes").df
    total = centroid_totals(nodes, passed.where("depth > 0").select("a", "c", "conv", "depth"), ["n_leaves", "saved_tokens"], stretch)
    children = nodes.where("depth > 1").groupBy(F.col("pa").alias("a"), F.col("pc").alias("c")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("c").alias("pc"), F.col("conv_id").alias("parent_id"))
    hashed = shas.withColumnRenamed("ends_sha256", "sha")
    first = ends.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n")).first()
    least = F.lit(first["conv_id"]).cast("long")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = total.join(children, ["a", "c"], "left").join(hashed, ["a", "c"], "left").join(parents, ["pa", "pc"], "left")
    below = below.withColumn("parent_conv_id", F.when(F.col("depth") == 1, least).otherwise(F.col("parent_id"))).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    # The root is in no conversation's turns; a trie without nodes is one leaf.
    root = nodes.agg(
        F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"), F.greatest(F.coalesce(F.sum("n_leaves"), F.lit(0)), F.lit(1)).alias("n_leaves"), F.coalesce(F.sum("saved_tokens"), F.lit(0)).alias("saved_tokens"),
    ).select("*", least.alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(first["n"]).cast("long").alias("n_convs"))
    own = hashed.where((F.col("a") == EMPTY[0]) & (F.col("c") == EMPTY[1])).first()
    root = root.where("n_convs > 0").withColumn("sha", F.lit(own["sha"] if own else None).cast("string"))
    both = below.select(*columns[:-1], "sha").union(root.select(*columns[:-1], "sha"))
    return both.select(*(F.col(c).cast("long").alias(c) for c in columns[:-1]), F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
