"""Similarity joins, greedy clustering, leakage control.

Identity of two sequences is the length of their longest common subsequence over the shorter
length (clustering, leakage) or the longer one (novelty). All pairs that can reach the limit are
compared; pairs are ruled out by bounds only (operators/composition.py).
"""

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from seqloom import constants as K
from seqloom.functions.sequences import let
from seqloom.operators import composition, ordered as O, prefixes
from seqloom.operators.fragments import text_windows
from seqloom.operators.joins import product
from seqloom.operators.storage import State, cut_lineage

#: Sequences of a window of the clustering: first, fewest and most.
FIRST_BATCH, LEAST_BATCH, MOST_BATCH = 4096, 1024, 1 << 17
#: Similar pairs that a window keeps about, that let it grow, and that a sequence and block keeps in any case.
BATCH_PAIRS, FEW_PAIRS, LEAST_PAIRS = 1 << 22, 1 << 19, 64


def word_size(t: float) -> int:
    return 5 if t >= 0.7 else 4 if t >= 0.6 else 3 if t >= 0.5 else 2


@F.pandas_udf(IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b)]
    at = np.arange(len(short))
    return pd.Series(composition.Texts(short, long).common(at, at).astype(np.int32))


def lcs_native(a: Column, b: Column) -> Column:
    """The same length as a nested fold, without Python; for short texts."""
    def fold(ys):
        def step(prev, x):
            return F.aggregate(
                F.sequence(F.lit(1), F.size(ys)), F.array(F.lit(0)),
                lambda cur, j: F.concat(
                    cur,
                    F.array(
                        F.when(F.element_at(ys, j) == x, F.element_at(prev, j) + 1)
                        .otherwise(F.greatest(F.element_at(prev, j + 1), F.element_at(cur, -1)))
                    ),
                ),
            )

        empty = F.array_repeat(F.lit(0), F.size(ys) + 1)
        return F.element_at(F.aggregate(F.split(a, ""), empty, step), -1)

    return F.when((F.length(a) > 0) & (F.length(b) > 0), let(F.split(b, ""), fold)).otherwise(0)


def lcs_identity(a: Column, b: Column) -> Column:
    """Common subsequence over the longer length; 0 if a side is empty."""
    return F.when((F.length(a) > 0) & (F.length(b) > 0), lcs_length(a, b) / F.greatest(F.length(a), F.length(b))).otherwise(0.0)


def _keyed(df: DataFrame, sequence: str, scope=None) -> DataFrame:
    """Distinct (scope, sequence, id); id follows the sequence."""
    rows = df.select((F.lit("") if scope is None else scope).cast("string").alias("scope"), F.col(sequence).alias("sequence"))
    return rows.where(F.length("sequence") > 0).distinct().withColumn("id", F.sha1("sequence"))


def _first_pairs(ids: np.ndarray, others: np.ndarray, most: int) -> pa.Table:
    """(id, other, cut): the `most` smallest others of each id; a cut last one hides further ones."""
    by = np.lexsort((others, ids))
    ids, others = ids[by], others[by]
    first = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    n = np.diff(np.append(first, len(ids)))
    nth = np.arange(len(ids)) - np.repeat(first, n)
    kept = nth < most
    cut = (nth == most - 1) & (np.repeat(n, n) >= most)
    return pa.table({"id": pa.array(ids[kept], pa.int64()), "other": pa.array(others[kept], pa.int64()), "cut": pa.array(cut[kept])})


def _pairs(t: float, most: int, short: bool):
    """Per block: the sequences before each one with which it reaches t."""

    def run(key, left, right):
        right = right.sort_by("id")
        own, other = left.column("id").to_numpy(), right.column("id").to_numpy()
        x, y = left.column("sequence").to_pylist(), right.column("sequence").to_pylist()
        if short:
            found = [(own[i], j) for i, j in prefixes.earlier_texts(prefixes.trie_of(x, t), y, other, own, most)]
        else:
            found = [(own[i], other[j]) for i, j in composition.partners(x, y, t, other[None, :] < own[:, None])]
        ids, others = (np.concatenate(c) for c in zip(*found)) if found else (own[:0], other[:0])
        return _first_pairs(ids, others, most)

    return run


def _first(t: float, short: bool):
    """Per block: the first accepted sequence with which each one reaches t."""

    def run(key, left, right):
        right = right.sort_by("id")
        own, other = left.column("id").to_numpy(), right.column("id").to_numpy()
        x, y = left.column("sequence").to_pylist(), right.column("sequence").to_pylist()
        if short:
            found = prefixes.first_texts(prefixes.trie_of(x, t), y, other, own)
        else:
            first = composition.first_partner(x, y, t, np.ones((len(x), len(y)), dtype=bool))
            found = np.where(first >= 0, other[np.maximum(first, 0)] if len(other) else -1, -1)
        return pa.table({"id": pa.array(own[found >= 0], pa.int64()), "rep": pa.array(found[found >= 0], pa.int64())})

    return run


def _decide(batches):
    """(id, rep, known) of the sequences of a window that are similar to earlier ones: the first accepted of these, none if
    all are members; unknown where the pairs kept do not tell."""
    table = pa.Table.from_batches(list(batches), pa.schema([("id", pa.int64()), ("other", pa.int64()), ("cut", pa.bool_())]))
    table = table.sort_by([("id", "ascending"), ("other", "ascending")])
    ids, others, cuts = (table.column(c).to_numpy() for c in ("id", "other", "cut"))
    first = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    own, last = ids[first], np.append(first[1:], len(ids))
    # One without earlier ones is accepted: the state after the last.
    at = np.searchsorted(own, others)
    at = np.where(own[np.minimum(at, len(own) - 1)] == others, at, len(own)) if len(own) else at
    accepted, member, unknown = 0, 1, 2
    state, rep = np.zeros(len(own) + 1, dtype=np.int8), np.full(len(own), -1, dtype=np.int64)
    for x, (i, j) in enumerate(zip(first.tolist(), last.tolist())):
        # What is no member, or hides what comes after it, ends the search.
        ends = (state[at[i:j]] != member) | cuts[i:j]
        k = i + int(ends.argmax())
        if not ends[k - i]:
            continue
        state[x] = member if state[at[k]] == accepted else unknown
        if state[x] == member:
            rep[x] = others[k]
    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(rep, mask=rep < 0), pa.array(state[:-1] != unknown)], names=["id", "rep", "known"])


def cluster_by_identity(df: DataFrame, t: float = 0.8, sequence: str = "sequence", min_length: int = 0, by: str = None) -> DataFrame:
    """Greedy clustering by falling length: (sequence, cluster_id, rep, identity, is_rep).

    Equals the sequential rule: take sequences by (length desc, sha1); each joins the first
    representative with identity >= t, else becomes one. `min_length` drops shorter sequences, as
    the external tool does by default at 11. `by` clusters every value of a column on its own, all of
    them in the same rounds.

    Rounds over windows of the first open sequences. Inside a window all similar pairs are found, of a sequence with very
    many the first ones, and the rule is followed along them in one task of bounded size, as far as they tell. Then all
    open sequences look for the first accepted one of the window that they are similar to. Sequences that may leave out few
    letters stand in tries that the others before them walk down (operators/prefixes.py); the rest is compared block by
    block inside the cells whose composition leaves a partner. Members of a cluster, copies included, make no pair rows.
    """
    scope = F.col(by) if by else F.lit("")
    base = df.select(scope.cast("string").alias("scope"), F.col(sequence).alias("sequence"))
    base = base.where(F.length("sequence") >= max(min_length, 1)).distinct()
    base = base.withColumns({"_len": -F.length("sequence"), "_sha": F.sha1("sequence")})
    ranked = State(O.running(base, ["_len", "_sha", "scope"], index="id").select(F.col("id").cast("long").alias("id"), F.coalesce("scope", F.lit("\u0000")).alias("scope"), F.col("scope").alias("_scope"), "sequence", prefixes.indexed("sequence", t).alias("_short")), "sequences").df
    counts = {r["_short"]: r["count"] for r in ranked.groupBy("_short").count().collect()}
    waiting = sum(counts.values())
    ways, placed = [], []
    for short in counts:
        rows = ranked.where(F.col("_short") == short)
        ways.append((short, *(prefixes.fit(rows, t) if short else composition.fit(rows))))
        rows = ways[-1][2]
        placed.append(rows if not short else rows.withColumn("comp", F.lit(None).cast("array<int>")))
    nodes = State(reduce(lambda a, b: a.unionByName(b), placed), "cells").df if placed else ranked.withColumns({"cell": F.lit(0), "comp": F.lit(None).cast("array<int>")})
    status = State(nodes.select("id", F.lit(None).cast("long").alias("rep"), F.lit(True).alias("open")), "status")

    def met(seekers, targets, kernels, schema, n):
        """What the kernels find for open sequences among targets; a target of a short sequence may be a long one."""
        parts = []
        for short, cells, _ in ways:
            mine = seekers.where(F.col("_short") == short)
            if short:
                found = prefixes.meet(cells, mine.select("scope", "cell", "id", "sequence"), targets.select("scope", "id", "sequence"), kernels[short], schema, n)
            else:
                mine = mine.select("scope", "id", "sequence", F.explode(composition.visits(cells, F.col("comp"), F.lit(t), "shorter")).alias("cell"))
                found = composition.meet(cells, mine, targets.where("not _short").select("scope", "cell", "id", "sequence"), kernels[short], schema, waiting)
            parts.append(found)
        return reduce(lambda a, b: a.union(b), parts)

    batch = FIRST_BATCH
    while waiting:
        last = status.df.where("open").agg(F.percentile_approx("id", min(1.0, batch / waiting), 10_000)).collect()[0][0]
        now = nodes.join(status.df.where("open").select("id"), "id")
        window, most = now.where(F.col("id") <= last), max(LEAST_PAIRS, BATCH_PAIRS // batch)
        pairs = State(met(window, window, {s: _pairs(t, most, s) for s in (True, False)}, "id long, other long, cut boolean", batch), "pairs")
        decided = State(pairs.df.repartition(1).mapInArrow(_decide, "id long, rep long, known boolean"), "decided")
        # What comes before the first unknown one is decided.
        end = decided.df.where("not known").agg(F.min("id")).collect()[0][0]
        end, many = (last + 1 if end is None else end), pairs.df.count()
        sure = window.where(F.col("id") < end).join(decided.df.select("id", "rep"), "id", "left")
        fresh = State(sure.select("id", "scope", "cell", "sequence", "_short", "rep"), "window")
        joined = met(now.where(F.col("id") >= end), fresh.df.where("rep is null"), {s: _first(t, s) for s in (True, False)}, "id long, rep long", batch)
        joined = joined.groupBy("id").agg(F.min("rep").alias("_rep")).union(fresh.df.select("id", F.coalesce("rep", "id")))
        after = State(status.df.join(joined, "id", "left").select("id", F.coalesce("rep", "_rep").alias("rep"), (F.col("open") & F.col("_rep").isNull()).alias("open")), "status")
        for done in (status, pairs, decided, fresh):
            done.drop()
        status, waiting = after, after.df.where("open").count()
        batch = min(MOST_BATCH, 4 * batch) if end > last and many <= FEW_PAIRS else max(LEAST_BATCH, batch // 2) if end <= last or many > 2 * FEW_PAIRS else batch
    reps = nodes.select(F.col("id").alias("rep"), F.col("sequence").alias("_rep"))
    out = status.df.select("id", "rep").join(nodes, "id").join(reps, "rep")
    identity = F.when(F.col("id") == F.col("rep"), 1.0).otherwise(lcs_length("sequence", "_rep") / F.least(F.length("sequence"), F.length("_rep")))
    return out.select(
        *([F.col("_scope").alias(by)] if by else []), "sequence", F.sha1("_rep").alias("cluster_id"), F.col("_rep").alias("rep"), identity.alias("identity"), (F.col("id") == F.col("rep")).alias("is_rep")
    )


def representatives(df: DataFrame, t: float = 0.9, sequence: str = "sequence", min_length: int = 0, by: str = None) -> DataFrame:
    kept = cluster_by_identity(df, t, sequence, min_length=min_length, by=by).where("is_rep")
    return kept.select(*([by] if by else []), "sequence")


def similar_to(train: DataFrame, test: DataFrame, t: float = 0.6, sequence: str = "sequence") -> DataFrame:
    """Distinct training sequences with identity >= t to some test sequence."""
    left, right = _keyed(train, sequence), _keyed(test, sequence)
    same = left.join(right.select("id"), "id", "left_semi").select("sequence")
    short = prefixes.indexed("sequence", t).alias("_short")
    tests = State(right.select("*", short), "tests").df
    rest = State(left.join(right.select("id"), "id", "left_anti").select("*", short), "training").df
    found = []

    def unmet(rows):
        """Training rows that no step before has found."""
        for hits in found:
            rows = rows.join(hits, "sequence", "left_anti")
        return rows

    def sequences(key, a, b):
        texts, size = b.column("sequence").to_pylist(), a.num_rows
        trie = prefixes.trie_of(a.column("sequence").to_pylist(), t)
        hit = prefixes.first_texts(trie, texts, np.zeros(len(texts), np.int64), np.ones(size, np.int64)) >= 0
        return a.filter(pa_mask(hit)).select(["sequence"])

    def longer(key, a, b):
        a = a.sort_by("id")
        hit = prefixes.meets_any(b.column("sequence").to_pylist(), a.column("sequence").to_pylist(), t)
        return b.filter(pa_mask(hit)).select(["sequence"])

    def blocks(key, a, b):
        x, y = a.column("sequence").to_pylist(), b.column("sequence").to_pylist()
        hit = composition.first_partner(x, y, t, np.ones((len(x), len(y)), dtype=bool)) >= 0
        return a.filter(pa_mask(hit)).select(["sequence"])

    def keep(hits):
        found.append(State(hits.distinct(), "similar").df)

    if not rest.where("_short").isEmpty():  # short training rows inside test rows
        cells, rows = prefixes.fit(rest.where("_short").drop("_short"), t)
        keep(prefixes.meet(cells, rows, tests.drop("_short"), sequences, "sequence string", tests.count()))
    if not tests.where("_short").isEmpty():  # short test rows inside training rows
        cells, rows = prefixes.fit(tests.where("_short").drop("_short"), t)
        keep(prefixes.meet(cells, rows, unmet(rest.drop("_short")), longer, "sequence string", rest.count()))
    if not rest.where("not _short").isEmpty() and not tests.where("not _short").isEmpty():
        cells, rows = composition.fit(tests.where("not _short").drop("_short"))
        targets = State(rows, "cells").df
        seekers = State(unmet(rest.where("not _short").drop("_short")).withColumn("comp", composition.composition(F.col("sequence"))), "training").df
        seekers = seekers.select("scope", "id", "sequence", F.explode(composition.visits(cells, F.col("comp"), F.lit(t), "shorter")).alias("cell"))
        keep(composition.meet(cells, seekers, targets, blocks, "sequence string", rest.count()))
    return reduce(lambda a, b: a.union(b), found, same)


def pa_mask(marks):
    return pa.array(marks, pa.bool_())


def filter_against(train: DataFrame, test: DataFrame, t: float = 0.6, sequence: str = "sequence") -> DataFrame:
    """Training rows that are similar to no test row."""
    bad = similar_to(train, test, t, sequence)
    return train.join(bad.withColumnRenamed("sequence", sequence), sequence, "left_anti").select(*train.columns)


def shares_word(train: DataFrame, test: DataFrame, k: int, key: str, sequence: str = "sequence", test_sequence: str = "sequence") -> DataFrame:
    """Keys of training texts that contain a word of k letters of some test text (a semi join, no pairs)."""
    w = text_windows(train, key, sequence, k).where(F.length("window") == k).select(key, F.col("window").alias("word"))
    t = test.select(F.monotonically_increasing_id().alias("_t"), F.col(test_sequence).alias("_s"))
    probe = text_windows(t, "_t", "_s", k).where(F.length("window") == k).select(F.col("window").alias("word")).distinct()
    return w.join(probe, "word", "left_semi").select(key).distinct()


def filter_training(
    train: DataFrame, test: DataFrame, internal: float = 0.9, against: float = 0.6, min_length: int = 0, by: str = "split"
) -> tuple:
    """(kept rows, counters per set) for one or more training sets told apart by the column `by`:
    internal de-duplication of each set, then the filter of all of them against the test set."""
    before = train.select(by, "sequence").distinct()
    inner = cut_lineage(representatives(before, internal, min_length=min_length, by=by))
    kept = cut_lineage(filter_against(inner, test, against))
    tag = lambda df, n: df.select(by, F.lit(n).alias("stage"))
    stages = ["before", "after_internal", "after_train_vs_test"]
    rows = reduce(lambda a, b: a.union(b), [tag(d, n) for d, n in zip((before, inner, kept), stages)])
    counters = rows.groupBy(by).agg(*[F.count_if(F.col("stage") == n).alias(n) for n in stages])
    return kept, counters


def novelty(df: DataFrame, train: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """(key, novelty): 1 - highest identity to any training sequence; null without training rows.

    Branch and bound over cells of similar composition. A sequence first meets the cell that it would
    itself stand in, which gives it a good identity; then only the cells whose box can beat that. Inside
    a cell partners are tried by falling bound until none can beat the best.
    """
    q = df.select(key, F.col(sequence).alias("sequence")).where(F.length("sequence") > 0)
    cells, rows = composition.fit(State(_keyed(train, sequence), "training").df)
    targets = State(rows, "cells").df.select("scope", "cell", "id", "sequence")

    @F.pandas_udf(IntegerType())
    def nearest(comp: pd.Series) -> pd.Series:
        points = composition._points(comp)
        if not len(cells.cells):
            return pd.Series([-1] * len(points))
        bound = cells.shared(points) / np.maximum(np.maximum(points[:, -1:], cells.short[None, :]), 1)
        home = cells.find(points)
        known = np.isin(home, cells.cells)
        return pd.Series(np.where(known, home, cells.cells[bound.argmax(axis=1)]).astype(np.int32))

    def run(_, a, b):
        low = a.column("low").to_numpy()
        best = composition.best_share(a.column("sequence").to_pylist(), b.column("sequence").to_pylist(), low)
        return pa.Table.from_arrays([a.column("id"), pa.array(best, pa.float64())], names=["id", "best"])

    texts = State(_keyed(q, "sequence").withColumn("comp", composition.composition(F.col("sequence"))).withColumn("home", nearest("comp")), "queries").df
    asked = texts.count()
    first = composition.meet(cells, texts.select("scope", "id", "sequence", F.col("home").alias("cell"), F.lit(0.0).alias("low")), targets, run, "id string, best double", asked)
    first = first.groupBy("id").agg(F.max("best").alias("low"))
    state = State(texts.join(first, "id", "left").withColumn("low", F.coalesce("low", F.lit(0.0))), "guesses").df
    more = state.withColumn("cell", F.explode(composition.visits(cells, F.col("comp"), F.col("low"), "longer"))).where("cell <> home")
    second = composition.meet(cells, more.select("scope", "id", "sequence", "cell", "low"), targets, run, "id string, best double", asked).groupBy("id").agg(F.max("best").alias("high"))
    best = state.join(second, "id", "left").select("sequence", F.greatest("low", "high").alias("best"))
    has = len(cells.cells) > 0
    rated = q.join(best, "sequence").select(key, (1 - F.col("best") if has else F.lit(None).cast("double")).alias("novelty"))
    blank = df.where(F.coalesce(F.length(sequence), F.lit(0)) == 0).select(key, F.lit(1.0 if has else None).cast("double").alias("novelty"))
    return rated.unionByName(blank)


def _columns_of(a: Column, b: Column) -> Column:
    return F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))


#: Letters of two sides whose columns are compared in one numpy step.
COLUMN_STEP = 1 << 20


def _letter_codes(texts) -> tuple:
    """(codes of all letters of an Arrow string array, first letter and length of each text); a null has no letters."""
    texts = texts.cast(pa.large_string()).fill_null("")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    flat = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    if flat.max(initial=0) < 128:
        return flat, at[:-1] - at[0], np.diff(at)
    rows = texts.to_pylist()
    size = np.array([len(t) for t in rows], dtype=np.int64)
    return np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size) - size, size


def _sums(marks: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Marks of the letters of consecutive texts, counted per text."""
    upto = np.concatenate(([0], np.cumsum(marks)))
    end = np.cumsum(size)
    return upto[end] - upto[end - size]


def _compare_columns(a, b):
    """Per pair of texts: columns not both gaps, equal ones of them, those with one gap, and columns that differ or hold X
    in both. Columns beyond the second text count if the first has a letter there, those beyond the first don't."""
    (fa, sa, na), (fb, sb, nb) = _letter_codes(a), _letter_codes(b)
    gap, unknown = ord(K.GAP), ord("X")
    out = np.zeros((4, len(na)), dtype=np.int64)
    both = np.minimum(na, nb)
    start, upto = 0, np.cumsum(na + nb)
    while start < len(na):
        stop = max(start + 1, int(np.searchsorted(upto, COLUMN_STEP + (upto[start - 1] if start else 0), "right")))
        some, m = slice(start, stop), both[start:stop]
        wide = int(m.max())
        if (m == wide).all() and (na[some] == wide).all() and (nb[some] == wide).all():
            x = fa[sa[start] : sa[start] + wide * len(m)].reshape(len(m), wide)
            y = fb[sb[start] : sb[start] + wide * len(m)].reshape(len(m), wide)
            count = lambda marks: marks.sum(axis=1)
        else:
            ramp = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            x, y = fa[np.repeat(sa[some], m) + ramp], fb[np.repeat(sb[some], m) + ramp]
            count = lambda marks: _sums(marks, m)
        equal, xg, yg = x == y, x == gap, y == gap
        out[0, some] = m - count(xg & yg)
        out[1, some] = count(equal & ~xg)
        out[2, some] = count(xg ^ yg)
        out[3, some] = m - count(equal) + count(equal & (x == unknown))
        more = na[some] - m
        if more.any():
            ramp = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
            x = fa[np.repeat(sa[some] + m, more) + ramp]
            out[0, some] += _sums(x != gap, more)
            out[3, some] += _sums(x == unknown, more)
        start = stop
    # An empty text splits into one empty letter, which is neither null nor a gap.
    bare = np.flatnonzero((nb == 0) & (na > 0))
    first = fa[sa[bare]]
    out[0, bare] += first == gap
    out[2, bare] += first == gap
    out[3, bare] += first != unknown
    out[3, (na == 0) & (nb > 0)] += 1
    known = pc.and_(pc.is_valid(a), pc.is_valid(b))
    mask = pc.invert(known)
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int32)) for c in out], names=["columns", "same", "one", "mutations"], mask=mask)


@F.arrow_udf(StructType([StructField(c, IntegerType()) for c in ("columns", "same", "one", "mutations")]))
def compare_columns(a: pa.Array, b: pa.Array) -> pa.Array:
    return _compare_columns(a, b)


def aligned_identity(a: Column, b: Column, gap_value: float = 0.0, over: str = "columns") -> Column:
    """Percent identity of equally wide texts. Columns with two gaps are left out; a column with one
    gap counts `gap_value`. `over`: 'columns', 'shorter' (ungapped) or 'width'."""
    n = compare_columns(a, b)
    bare = lambda s: F.length(F.replace(s, F.lit(K.GAP), F.lit("")))
    den = {"columns": n["columns"], "shorter": F.least(bare(a), bare(b)), "width": F.length(a)}[over]
    return 100.0 * (n["same"] + n["one"] * gap_value) / F.nullif(den, F.lit(0))


def n_mutations(a: Column, b: Column) -> Column:
    """Columns that differ; X against X counts as one."""
    return compare_columns(a, b)["mutations"]


def residue_distance(a: Column, b: Column, matrix: dict, alphabet: str = K.RESIDUES + K.GAP) -> Column:
    """Sum over columns of matrix[(x, y)]; the matrix is given by the caller."""
    flat = F.array(*[F.lit(float(matrix[(x, y)])) for x in alphabet for y in alphabet])
    at = lambda c: F.instr(F.lit(alphabet), c) - 1
    z = F.filter(_columns_of(a, b), lambda c: c["x"] != "")
    return F.aggregate(z, F.lit(0.0), lambda acc, c: acc + F.get(flat, at(c["x"]) * len(alphabet) + at(c["y"])))


def matrix_from_scale(scale: dict, gap: float = 1.0) -> dict:
    """Residue distances |difference| / range of a property scale; a gap against a residue costs `gap`."""
    span = max(scale.values()) - min(scale.values())
    out = {(x, y): abs(scale[x] - scale[y]) / span for x in K.RESIDUES for y in K.RESIDUES}
    out.update({(K.GAP, x): gap for x in K.RESIDUES} | {(x, K.GAP): gap for x in K.RESIDUES} | {(K.GAP, K.GAP): 0.0})
    return out


#: Block pairs beyond so many share tasks.
MAX_TASKS = 20_000


def _block_products(a, b, key_a, key_b, matrix, aligned, columns, rows_per_block, alphabet, result, schema) -> DataFrame:
    """`result(keys_a, keys_b, distances)` of every block pair; a block holds about `rows_per_block` rows of `b` and as many
    of `a`, or up to 16 times as many where `b` has only few.

    One task computes one block pair as matrix products of one-hot rows, `rows_per_block` rows of `a` at a time. The rows of
    `b` come in the order of their keys.
    """
    tag = lambda df, side: df.select(F.lit(side).alias("side"))
    sizes = {r["side"]: r["count"] for r in tag(a, "a").union(tag(b, "b")).groupBy("side").count().collect()}
    long = rows_per_block * max(1, min(16, rows_per_block // max(1, sizes.get("b", 0))))
    na, nb = max(1, -(-sizes.get("a", 0) // long)), max(1, -(-sizes.get("b", 0) // rows_per_block))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = a.select(F.col(key_a).alias("_k"), F.col(aligned).alias("_s"), place(key_a, na).alias("_i"), copies(nb).alias("_j"))
    right = b.select(F.col(key_b).alias("_k"), F.col(aligned).alias("_s"), place(key_b, nb).alias("_j"), copies(na).alias("_i"))
    table = np.array([[matrix[(x, y)] for y in alphabet] for x in alphabet], dtype="float64")
    code = np.full(256, -1, dtype="int64")
    for i, c in enumerate(alphabet):
        code[ord(c)] = i

    def encode(texts):
        joined = "".join(texts.to_pylist()).encode("ascii")
        m = code[np.frombuffer(joined, dtype="uint8")].reshape(len(texts), -1)
        return m if columns is None else m[:, columns]

    def one_block(x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x) or not len(y):
            return empty
        y = y.take(pc.sort_indices(y["_k"]))
        my = encode(y["_s"])
        hot = np.zeros((my.size, len(alphabet)))
        hot[np.arange(my.size), my.ravel()] = 1
        hot, keys, parts = hot.reshape(len(y), -1).T, y["_k"].combine_chunks(), []
        for at in range(0, len(x), rows_per_block):
            some = x.slice(at, rows_per_block)
            d = table[encode(some["_s"])].reshape(len(some), -1) @ hot
            parts.append(result(some["_k"].combine_chunks(), keys, d))
        return pa.concat_tables(parts)

    empty = to_arrow_schema(schema).empty_table()
    # The work grows with pairs, not bytes, so partitions are counted in blocks and not merged by size.
    spread = lambda df: df.repartition(min(na * nb, MAX_TASKS), "_i", "_j").groupBy("_i", "_j")
    return spread(left).cogroup(spread(right)).applyInArrow(one_block, schema)


def distance_between(
    a: DataFrame, b: DataFrame, matrix: dict, key_a: str, key_b: str, aligned: str = "aligned",
    columns: list = None, rows_per_block: int = 2000, alphabet: str = K.RESIDUES + K.GAP,
) -> DataFrame:
    """Distances of all rows of `a` to all rows of `b`: (key_a, key_b, distance).

    `columns` limits the sum to some 0-based columns. The result is the product of both sides by definition; where only
    the nearest rows are wanted, `nearest_by_distance` leaves no pair table.
    """
    def every(ka, kb, d):
        i, j = np.divmod(np.arange(d.size), len(kb))
        return pa.table({key_a: ka.take(pa.array(i)), key_b: kb.take(pa.array(j)), "distance": d.ravel()})

    schema = StructType([a.schema[key_a], b.schema[key_b], StructField("distance", DoubleType())])
    return _block_products(a, b, key_a, key_b, matrix, aligned, columns, rows_per_block, alphabet, every, schema)


def nearest_by_distance(
    a: DataFrame, b: DataFrame, matrix: dict, key_a: str, key_b: str, k: int = 1, aligned: str = "aligned",
    columns: list = None, rows_per_block: int = 2000, alphabet: str = K.RESIDUES + K.GAP,
) -> DataFrame:
    """The `k` nearest rows of `b` of every row of `a`: (key_a, key_b, distance, rank from 1); all, if there are fewer.

    Ties go to the smaller key of `b`; distances are compared after rounding to nine places, as sums of one block shape
    differ from those of another in the last bits. Every block pair hands on its k nearest a row, which are ranked again:
    rows of `a` x blocks of `b` x k are shuffled, not the pairs. Keys are unique on either side. Without rows on one side
    the result is empty.
    """
    def nearest(ka, kb, d):
        d = np.round(d, 9)
        if k == 1:
            i, j = np.arange(len(d)), d.argmin(axis=1)  # the first of equal ones has the smallest key
        else:
            limit = np.partition(d, k - 1, axis=1)[:, k - 1 : k] if k < d.shape[1] else np.inf
            i, j = np.nonzero(d <= limit)
            order = np.lexsort((j, d[i, j], i))
            i, j = i[order], j[order]
            first = np.searchsorted(i, np.arange(len(d)))
            kept = np.arange(len(i)) - first[i] < k
            i, j = i[kept], j[kept]
        return pa.table({key_a: ka.take(pa.array(i)), key_b: kb.take(pa.array(j)), "distance": d[i, j]})

    schema = StructType([a.schema[key_a], b.schema[key_b], StructField("distance", DoubleType())])
    parts = _block_products(a, b, key_a, key_b, matrix, aligned, columns, rows_per_block, alphabet, nearest, schema)
    best = Window.partitionBy(key_a).orderBy("distance", key_b)
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def pairwise(a: DataFrame, b: DataFrame, fn, key_a: str, key_b: str, text: str = "aligned", blocks: int = 8, name: str = "value") -> DataFrame:
    """A caller-chosen column function over all pairs of two tables (a blocked equi-join)."""
    # The work grows with pairs, not bytes, so rows of a small table are spread over the cores.
    cores = a.sparkSession.sparkContext.defaultParallelism
    left = a.select(F.col(key_a), F.col(text).alias("_a")).repartition(4 * cores)
    right = b.select(F.col(key_b), F.col(text).alias("_b"))
    return product(left, right, blocks).select(key_a, key_b, fn(F.col("_a"), F.col("_b")).alias(name))


#: Rows of a block of the matrix, rows of it compared at once, and pairs of texts of unlike widths compared at once.
MATRIX_ROWS, MATRIX_SLAB, MATRIX_LETTERS = 2048, 256, 1 << 22


def _percents(same: np.ndarray, columns: np.ndarray, digits: int = None) -> np.ndarray:
    """100 same / columns, rounded like F.round, once for each pair of counts; not a number where there are no columns."""
    wide = int(columns.max(initial=0)) + 1
    codes = same.astype(np.int64) * wide + columns
    codes, at = (codes, slice(None)) if wide < 1024 else np.unique(codes, return_inverse=True)
    found = np.flatnonzero(np.bincount(codes)) if wide < 1024 else codes
    with np.errstate(invalid="ignore"):
        value = 100.0 * (found // wide) / np.where(found % wide, found % wide, np.nan)
    if digits is not None:
        step = Decimal(1).scaleb(-digits)
        value = np.array([float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP)) if v == v else v for v in value.tolist()])
    if wide >= 1024:
        return value[at]
    table = np.full(int(codes.max(initial=0)) + 1, np.nan)
    table[found] = value
    return table[codes]


def _matrix_block(key: str, names: list, digits: int):
    """(key, key_b, identity) of the pairs of one block, or of two blocks i < j: the smaller key first, equal ones in both orders."""

    def pairs(i, j, rank):
        """Rows of the pairs of some left rows with all right ones; with those behind them in one block."""
        a, b = np.repeat(i, len(j)), np.tile(j, len(i))
        if len(j) and j[0] == 0:
            kept = np.flatnonzero(rank[a] <= rank[b])
            return a[kept], b[kept], kept, None
        swap, tie = rank[a] > rank[b], np.flatnonzero(rank[a] == rank[b])
        return np.where(swap, b, a), np.where(swap, a, b), slice(None), tie

    def run(group, t):
        i, j = (x.as_py() for x in group)
        t = t.take(pc.sort_indices(t["k"])).combine_chunks()
        keys, texts, block = t["k"].combine_chunks(), t["s"].combine_chunks(), t["b"].to_numpy()
        rank = pc.rank(keys, tiebreaker="min").to_numpy()
        if i != j:  # rows of the left block, then those of the right one
            order = np.argsort(block != i, kind="stable")
            keys, texts, rank = keys.take(pa.array(order)), texts.take(pa.array(order)), rank[order]
        n = int((block == i).sum())
        left, right = np.arange(n), np.arange(n if i != j else 0, len(block))
        flat, _, size = _letter_codes(texts)
        wide = int(size.max(initial=0))
        plain = not texts.null_count and (size == wide).all()
        if plain:
            letters = flat.reshape(len(size), wide)
            columns = np.ascontiguousarray(letters.T)
            gaps, kind = (columns == ord(K.GAP)), np.uint8 if wide < 256 else np.int32
        step, out = MATRIX_SLAB if plain else max(1, MATRIX_LETTERS // max(1, 2 * wide * max(1, len(right)))), []
        for at in range(0, n, step):
            some = left[at : at + step]
            a, b, kept, tie = pairs(some, right, rank)
            if plain:
                same, gap = np.zeros((2, len(some), len(right)), dtype=kind)
                for p in range(wide):
                    x, xg = columns[p, some], gaps[p, some]
                    y, yg = columns[p, right], gaps[p, right]
                    same += (x[:, None] == y[None, :])
                    if xg.any() and yg.any():
                        gap += xg[:, None] & yg[None, :]
                # Two gaps are equal, but no letters.
                value = _percents((same - gap).ravel()[kept], (kind(wide) - gap).ravel()[kept], digits)
            else:
                n_ = _compare_columns(texts.take(pa.array(a)), texts.take(pa.array(b)))
                value = _percents(*(n_.field(c).to_numpy(zero_copy_only=False) for c in ("same", "columns")), digits)
                value[n_.is_null().to_numpy(zero_copy_only=False)] = np.nan
            if tie is not None and len(tie):
                back = value[tie]
                if not plain:
                    n_ = _compare_columns(texts.take(pa.array(b[tie])), texts.take(pa.array(a[tie])))
                    back = _percents(*(n_.field(c).to_numpy(zero_copy_only=False) for c in ("same", "columns")), digits)
                    back[n_.is_null().to_numpy(zero_copy_only=False)] = np.nan
                a, b, value = np.concatenate((a, b[tie])), np.concatenate((b, a[tie])), np.concatenate((value, back))
            out.append(pa.table([keys.take(pa.array(a)), keys.take(pa.array(b)), pa.array(value, mask=np.isnan(value))], names=names))
        return pa.concat_tables(out) if out else pa.table([keys[:0], keys[:0], pa.array([], pa.float64())], names=names)

    return run


def identity_matrix(df: DataFrame, key: str, aligned: str = "aligned", digits: int = None) -> DataFrame:
    """All pairs incl. self, long form, the smaller key first (`digits` rounds); the output is quadratic by definition.

    Every two blocks of rows meet in one task, which compares them column by column and whose memory depends on neither the
    rows nor their keys. A row goes to as many tasks as there are blocks; pairs are not shuffled.
    """
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(aligned).alias("s"))
    # Rows get their block once, as rows that are equal stand in different ones.
    rows = State(rows.withColumn("p", F.xxhash64(F.monotonically_increasing_id())), "matrix").df
    n, cores = rows.count(), df.sparkSession.sparkContext.defaultParallelism
    count = max(1, -(-n // MATRIX_ROWS), min(n, -int(-((8 * cores) ** 0.5) // 1)))
    block = rows.select("k", "s", F.pmod("p", F.lit(count)).cast("int").alias("b"))
    other = block.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    placed = other.select("k", "s", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    names = [key, f"{key}_b", "identity"]
    kind = df.schema[key].dataType
    schema = StructType([StructField(names[0], kind), StructField(names[1], kind), StructField("identity", DoubleType())])
    # The work grows with pairs, not bytes, so partitions are counted in block pairs and not merged by size.
    spread = placed.repartition(min(count * (count + 1) // 2, MAX_TASKS), "i", "j")
    return spread.groupBy("i", "j").applyInArrow(_matrix_block(key, names, digits), schema)


#: Zones of fewer columns are cut into more and shorter segments, of which more have to be equal.
SHORT_ZONE = 24
#: Rows of keys in one Arrow batch.
KEY_ROWS = 1 << 15


def _segments(zone: int, m: int) -> tuple:
    """(number of segments, how many of them are equal in texts with at most m differences in `zone` columns)."""
    n = min(zone, m + 4) if zone < SHORT_ZONE else m + 2
    return n, max(0, n - m)


def _meeting_keys(rows: DataFrame, m: int, width: int, zones: bool) -> DataFrame:
    """Rows of texts t (n, lo, hi), one for every combination of segments in the zones that a partner's letters can take
    with their own, or in the whole width: the zone (z, y), the last segment of the combination and the key h of its letters."""
    spread = np.random.default_rng(7).integers(1, 1 << 62, size=width + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = lambda *x: np.uint64(hash((zones, *x)) % (1 << 64))
    names = ["t", "n", "lo", "hi", "z", "y", "last", "h"]

    def codes(texts):
        """Letters of the first `width` columns; a column that a text has not is 0."""
        rows = texts.to_pylist()
        out = np.zeros((len(rows), width), dtype=np.uint64)
        for i, t in enumerate(rows) if not all(t.isascii() and len(t) == width for t in rows) else ():
            out[i, : len(t[:width])] = np.frombuffer(t[:width].encode("utf-32-le", "surrogatepass"), np.uint32) + 1
        if rows and not out.any():
            out = np.frombuffer("".join(rows).encode(), np.uint8).reshape(-1, width).astype(np.uint64) + np.uint64(1)
        return out * spread[:width]

    def slices(sizes, limit):
        ends = np.concatenate(([0], np.cumsum(sizes))) // limit
        cuts = np.flatnonzero(np.diff(ends)) + 1
        return zip([0, *cuts], [*cuts, len(sizes)]) if len(sizes) else ()

    def run(batches):
        for batch in batches:
            lo, hi = batch.column("lo").to_numpy(), batch.column("hi").to_numpy()
            marks = np.concatenate((np.zeros((len(lo), 1), np.uint64), np.cumsum(codes(batch.column("t")), axis=1, dtype=np.uint64)), axis=1)
            at, zs, ys, lasts, keys = [], [], [], [], []
            for left in range(m + 1 if zones else 1):
                for right in range(m + 1 - left if zones else 1):
                    z, y = (lo - left, hi + right) if zones else (np.zeros_like(lo), np.full_like(hi, width))
                    fits = (z >= 0) & (y <= width)
                    # Rows of one zone are keyed at once.
                    for zone in np.unique(z[fits] * (width + 1) + y[fits]):
                        a, b = divmod(int(zone), width + 1)
                        some = np.flatnonzero((z == a) & (y == b))
                        count, equal = _segments(b - a, m)
                        cut = [a + (b - a) * i // max(1, count) for i in range(count + 1)]
                        own = marks[some]
                        sums = [own[:, cut[i + 1]] - own[:, cut[i]] for i in range(count)]
                        for k, c in enumerate(combinations(range(count), equal)):
                            at.append(some)
                            keys.append(sum((sums[i] for i in c), np.full(len(some), salt(a, b, k), np.uint64)))
                            for out, v in ((zs, a), (ys, b), (lasts, c[-1] if c else -1)):
                                out.append(np.full(len(some), v, np.int32))
            for i, j in slices([len(x) for x in at], KEY_ROWS):
                some = [np.concatenate(x[i:j]) for x in (zs, ys, lasts, keys)]
                taken = batch.select(names[:4]).take(pa.array(np.concatenate(at[i:j])))
                yield pa.RecordBatch.from_arrays([*taken.columns, *map(pa.array, some[:3]), pa.array(some[3].view(np.int64))], names=names)

    return rows.select("t", "n", "lo", "hi").mapInArrow(run, "t string, n long, lo int, hi int, z int, y int, last int, h long")


def similar_pairs(df: DataFrame, max_mutations: int, aligned: str = "aligned", width: int = 40) -> DataFrame:
    """Distinct aligned texts that differ in at most `max_mutations` columns: (a, b, mutations, n_a, n_b).

    Exact: with m differences spread over m+2 segments two segments are equal, so texts meet on two
    segments. Columns in which both have gaps bring no texts together: a text whose letters stand without a gap
    between them is cut in every zone of its letters and up to m columns beside them, one of which holds just
    its partner's letters too; a zone of few columns has m+4 segments, four of them equal. Texts with at most m letters
    between them are similar anyway. All other texts (with
    inner gaps, without letters, of another width) meet every text on segments of the whole width. Equal texts
    are one row with their count, so copies add no pairs.
    """
    m, t = max_mutations, F.col("t")
    texts = df.groupBy(F.col(aligned).alias("t")).agg(F.count("*").alias("n")).where(t.isNotNull())
    bare = F.trim(t, F.lit(K.GAP))
    lo = F.length(t) - F.length(F.ltrim(t, F.lit(K.GAP)))
    texts = texts.withColumns({"lo": lo, "hi": F.length(F.rtrim(t, F.lit(K.GAP))), "solid": (F.length(t) == width) & (F.length(bare) > 0) & ~F.contains(bare, F.lit(K.GAP))})
    texts = State(texts, "texts").df
    # A scan of few row groups is spread over the cores, as every text has many keys.
    texts = texts.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    solid, other = texts.where("solid"), texts.where("not solid")

    def meet(left, right, among):
        l, r = left.alias("l"), right.alias("r")
        j = l.join(r, (F.col("l.h") == F.col("r.h")) & (F.col("l.z") == F.col("r.z")) & (F.col("l.y") == F.col("r.y")) & (F.col("l.last") == F.col("r.last")) & among)
        z, zone, last = F.col("l.z"), F.col("l.y") - F.col("l.z"), F.col("l.last")
        count = F.when(zone < SHORT_ZONE, F.least(zone, F.lit(m + 4))).otherwise(F.lit(m + 2))
        cut = lambda i: F.floor(zone * i / F.greatest(count, F.lit(1))).cast("int")
        part = lambda c, i: F.substr(F.col(c), z + cut(i) + 1, cut(i + 1) - cut(i))
        # A pair counts at its first equal segments only.
        same = [F.when((F.lit(i) <= last) & (part("l.t", i) == part("r.t", i)), 1).otherwise(0) for i in range(m + 4)]
        j = j.where(sum(same, F.lit(0)) == F.greatest(count - m, F.lit(0)))
        first = F.col("l.t") < F.col("r.t")
        pick = lambda c: (F.when(first, F.col(f"l.{c}")).otherwise(F.col(f"r.{c}")), F.when(first, F.col(f"r.{c}")).otherwise(F.col(f"l.{c}")))
        (a, b), (na, nb) = pick("t"), pick("n")
        return j.select(a.alias("a"), b.alias("b"), na.alias("n_a"), nb.alias("n_b"))

    keys = _meeting_keys(solid, m, width, True)
    union = (F.least("l.lo", "r.lo") == F.col("l.z")) & (F.greatest("l.hi", "r.hi") == F.col("l.y"))
    letters = lambda side: F.col(f"{side}.hi") - F.col(f"{side}.lo")
    pairs = meet(keys, keys, (F.col("l.t") < F.col("r.t")) & union & (letters("l") + letters("r") > m))
    # Of texts with so few letters all pairs are similar, wherever the letters stand.
    few = solid.where(F.col("hi") - F.col("lo") < m).withColumn("size", F.col("hi") - F.col("lo"))
    wanted = few.withColumn("mate", F.explode(F.sequence(F.lit(1), m - F.col("size")))).alias("l")
    close = wanted.join(few.alias("r"), (F.col("l.mate") == F.col("r.size")) & (F.col("l.t") < F.col("r.t")))
    pairs = pairs.union(close.select(F.col("l.t").alias("a"), F.col("r.t").alias("b"), F.col("l.n").alias("n_a"), F.col("r.n").alias("n_b")))
    if not other.isEmpty():
        gapped = _meeting_keys(other, m, width, False)
        pairs = pairs.union(meet(gapped, gapped, F.col("l.t") < F.col("r.t"))).union(meet(gapped, _meeting_keys(solid, m, width, False), F.lit(True)))
    return pairs.withColumn("mutations", n_mutations(F.col("a"), F.col("b"))).where(F.col("mutations") <= m).select("a", "b", "n_a", "n_b", "mutations")


def preservation(positions: DataFrame, key: list, sample: str, parent: str, region: Column, vernier: Column = None) -> DataFrame:
    """Share of identical positions per key: all, framework (region code 0), vernier."""
    same = (F.col(sample) == F.col(parent)).cast("double")
    aggs = [F.avg(same).alias("preserved"), F.avg(F.when(region == 0, same)).alias("framework")]
    if vernier is not None:
        aggs.append(F.avg(F.when(vernier, same)).alias("vernier"))
    return positions.groupBy(*key).agg(*aggs)


def mutation_precision(positions: DataFrame, key: list, exp: str, parent: str, test: str) -> DataFrame:
    """Of the positions where exp or test leave the parent: shared / (shared + only). The key is kept
    and the precision is null where nothing differs."""
    e, p, t = F.col(exp), F.col(parent), F.col(test)
    changed = (e != p) | (t != p)
    shared, only = F.count_if(changed & (e == t)), F.count_if(changed & (e != t) & (t != p))
    return positions.groupBy(*key).agg(shared.alias("shared"), only.alias("unshared")).withColumn(
        "precision", F.col("shared") / F.nullif(F.col("shared") + F.col("unshared"), F.lit(0))
    )


def annotate_conservation(positions: DataFrame, parental: str = "parental", predicted: str = "predicted", germline: str = "germline") -> DataFrame:
    """Conserved / Back-mutated / Humanized / Engineered per position; a missing prediction gives null."""
    a, b, c = F.col(parental), F.col(predicted), F.col(germline)
    kept = F.when(a.eqNullSafe(c), "Conserved").otherwise("Back-mutated")
    label = F.when(a == b, kept).when(b.eqNullSafe(c), "Humanized").otherwise("Engineered")
    return positions.withColumn("conservation", F.when(b.isNotNull(), label))
