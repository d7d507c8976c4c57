"""Motif tables, hits, coverage profiles, windows and logos.

Exact motifs are found by one automaton over all of them (Aho-Corasick), in one pass over each text where it lies, so
no position becomes a row and nothing is shuffled. A table of more letters than AUTOMATON_LETTERS is not sent to the
tasks; its motifs are found by an equi-join on the first letters of every text position. Coverage is a
table of disjoint runs, swept over the ends of the spans; no position is a row.
"""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType

from seqloom import constants as K
from seqloom.functions.sequences import letters
from seqloom.operators import ordered as O
from seqloom.operators.fragments import text_blocks, text_windows
from seqloom.operators.storage import cut_lineage

HEAD = 5
#: Letters of all motifs that an automaton in every task may hold (about 100 bytes each).
AUTOMATON_LETTERS = 2_000_000


def prosite_to_regex(pattern: Column) -> Column:
    """PROSITE notation to a regular expression: '-' separates, x is any residue, x(n) and x(n,m) repeat
    it, [..] stays, everything else is literal."""
    def one(part):
        p = F.trim(part)
        count = F.regexp_extract(p, r"^[xX]\((\d+(?:,\d+)?)\)$", 1)
        escaped = F.regexp_replace(p, r"([^A-Za-z0-9_])", r"\\$1")
        return (
            F.when(count != "", F.concat(F.lit(".{"), count, F.lit("}"))).when(F.lower(p) == "x", ".")
            .when(F.startswith(p, F.lit("[")) & F.contains(p, F.lit("]")), p).otherwise(escaped)
        )

    return F.array_join(F.transform(F.split(pattern, "-"), one), "")


@F.pandas_udf(BooleanType())
def _compiles(patterns: pd.Series) -> pd.Series:
    def ok(p):
        try:
            return re.compile(p) is not None
        except re.error:
            return False

    return patterns.map(ok)


def load_motifs(df: DataFrame, types=("prosite", "regular", "merci")) -> DataFrame:
    """Active motif table (pattern, type) as (motif, kind, regex); blank rows, disabled types and
    invalid patterns are left out. `types` empty or 'none' gives no motif."""
    enabled = [t for t in types if t != "none"]
    name, family = F.trim("pattern"), F.trim("type")
    kind = (
        F.when(F.contains(family, F.lit("PROSITE")) | F.contains(family, F.lit("Cysteine Regex")), "prosite")
        .when(F.contains(family, F.lit("MERCI")), "merci").otherwise("regular")
    )
    rows = df.select(name.alias("motif"), kind.alias("_k"), family.alias("_f"))
    rows = rows.where((F.col("motif") != "") & (F.col("_f") != ""))
    rows = rows.where(F.col("_k").isin(enabled) if enabled else F.lit(False))
    exact = rows.where(F.col("_k") != "prosite").select("motif", F.lit("exact").alias("kind"), F.lit(None).cast("string").alias("regex"))
    regex = rows.where(F.col("_k") == "prosite").select("motif", F.lit("regex").alias("kind"), prosite_to_regex(F.col("motif")).alias("regex"))
    return exact.union(regex.where(_compiles("regex"))).distinct()


def load_negative(df: DataFrame) -> DataFrame:
    m = df.select(F.trim("motif").alias("motif")).where(F.col("motif") != "").distinct()
    return m.withColumns({"kind": F.lit("exact"), "regex": F.lit(None).cast("string")})


def _no_hits(texts: DataFrame, key: str, extra: list = ()) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    none = texts.select(key, zero.alias("start"), zero.alias("end"), F.lit("").alias("motif"), *[F.lit(0).alias(c) for c in extra])
    return none.where(F.lit(False))


def exact_hits(texts: DataFrame, motifs: DataFrame, key: str, sequence: str = "sequence", extra: list = ()) -> DataFrame:
    """(key, start, end, motif) of every occurrence, overlapping ones included; 0-based, end excluded.
    `extra` columns of the motif table are carried along."""
    table = motifs.where("kind = 'exact' and motif <> ''").select("motif", *extra).distinct()
    letters_ = table.agg(F.coalesce(F.sum(F.length("motif")), F.lit(0))).first()[0]
    find = _hits_by_automaton if letters_ <= AUTOMATON_LETTERS else _hits_by_head
    return find(texts, table, key, sequence, list(extra))


def _automaton(rows: list):
    """Automaton over rows (motif, ...); a motif gives its length and its rows."""
    import ahocorasick

    automaton, by_motif = ahocorasick.Automaton(), {}
    for motif, *rest in rows:
        by_motif.setdefault(motif, []).append((motif, *rest))
    for motif, found in by_motif.items():
        automaton.add_word(motif, (len(motif), found))
    automaton.make_automaton()
    return automaton


def _hits_by_automaton(texts: DataFrame, table: DataFrame, key: str, sequence: str, extra: list) -> DataFrame:
    rows = [tuple(r) for r in table.collect()]  # at most AUTOMATON_LETTERS
    if not rows:
        return _no_hits(texts, key, extra)
    sent = texts.sparkSession.sparkContext.broadcast(rows)
    types = {**dict(texts.select(key).dtypes), **dict(table.dtypes)}
    kinds = [to_arrow_type(table.schema[c].dataType) for c in extra]
    schema = ", ".join([f"`{key}` {types[key]}, start bigint, end bigint, motif string", *(f"`{c}` {types[c]}" for c in extra)])

    def run(batches):
        import pyarrow as pa

        automaton = _automaton(sent.value)
        for batch in batches:
            at, out = [], []

            def made():
                cols = list(zip(*out))
                columns = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), *(pa.array(c, t) for c, t in zip(cols[3:], kinds))]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, "start", "end", "motif", *extra])

            for i, text in enumerate(batch.column(1).to_pylist()):
                for last, (size, found) in automaton.iter(text or ""):
                    for row in found:
                        at.append(i)
                        out.append((last + 1 - size, last + 1, *row))
                if len(out) >= 1 << 16:
                    yield made()
                    at, out = [], []
            if out:
                yield made()

    return texts.select(key, F.col(sequence).cast("string").alias("_text")).mapInArrow(run, schema)


def _hits_by_head(texts: DataFrame, table: DataFrame, key: str, sequence: str, extra: list) -> DataFrame:
    head = F.least(F.length("motif"), F.lit(HEAD))
    info = table.agg(F.max(F.length("motif")).alias("longest"), F.collect_set(head).alias("heads")).first()
    if not info["heads"]:
        return _no_hits(texts, key, extra)
    keyed = table.withColumn("_head", F.left("motif", head))
    windows = text_windows(texts, key, sequence, info["longest"])
    heads = [F.left("window", F.lit(h)) for h in sorted(info["heads"])]
    probe = windows.withColumn("_head", F.explode(F.array_distinct(F.array(*heads))) if len(heads) > 1 else heads[0])
    hits = probe.join(keyed, "_head").where(F.startswith(F.col("window"), F.col("motif")))
    return hits.select(key, "start", (F.col("start") + F.length("motif")).alias("end"), "motif", *extra)


def regex_hits(texts: DataFrame, motifs: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """(key, start, end, motif) of the non-overlapping matches of every pattern, left to right.

    Matches are marked in place and the text is split at the marks; starts are prefix sums of the
    piece lengths. The patterns come to the texts as one array (a scalar subquery), for any number of them.
    """
    table = motifs.where("kind = 'regex'").select("motif", "regex").distinct()

    def pieces(regex):
        marked = F.regexp_replace(F.col(sequence), F.concat(F.lit("("), regex, F.lit(")")), F.lit("\u0001$1\u0002"))
        return F.transform(
            F.split(marked, "\u0001"),
            lambda p: F.struct(F.greatest(F.instr(p, "\u0002") - 1, F.lit(0)).alias("m"), F.length(F.replace(p, F.lit("\u0002"), F.lit(""))).alias("n")),
        )

    listed = table.agg(F.sort_array(F.collect_list(F.struct("motif", "regex")))).scalar()
    found = texts.select(key, sequence, F.explode(listed).alias("x")).select(key, "x.motif", pieces(F.col("x.regex")).alias("p"))
    rows = found.where(F.size("p") > 1).select(key, "motif", F.posexplode("p").alias("i", "x"))
    before = Window.partitionBy(key, "motif").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    at = rows.select(key, "motif", "i", F.col("x.m").alias("m"), F.coalesce(F.sum("x.n").over(before), F.lit(0)).alias("start"))
    return at.where("i > 0").select(key, "start", (F.col("start") + F.col("m")).alias("end"), "motif")


def motif_spans(texts: DataFrame, motifs: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    return exact_hits(texts, motifs, key, sequence).unionByName(regex_hits(texts, motifs, key, sequence))


def covered_positions(spans: DataFrame, key: str) -> DataFrame:
    """Distinct 0-based positions under any span."""
    return spans.select(key, F.explode(F.sequence("start", F.col("end") - 1)).alias("pos")).distinct()


def _runs_by_automaton(texts: DataFrame, table: DataFrame, key: str, sequence: str) -> DataFrame:
    """(key, start, end, _a, _n): per text the longest runs of positions under the same sets of exact motifs."""
    rows = [tuple(r) for r in table.collect()]  # at most AUTOMATON_LETTERS
    sent = texts.sparkSession.sparkContext.broadcast(rows)
    schema = f"`{key}` {dict(texts.select(key).dtypes)[key]}, start bigint, end bigint, _a int, _n int"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        automaton = _automaton([(m, a | n << 1) for m, a, n in sent.value]) if sent.value else None
        for batch in batches:
            at, parts = [], []
            for i, text in enumerate(batch.column(1).to_pylist() if automaton else ()):
                ends, sizes, sets = [], [], []
                for last, (size, found) in automaton.iter(text or ""):
                    ends.append(last + 1)
                    sizes.append(size)
                    sets.append(found[0][1] if len(found) == 1 else found[0][1] | found[1][1])
                if not ends:
                    continue
                end, size, sets = np.array(ends), np.array(sizes), np.array(sets)
                code = np.zeros(len(text) + 2, dtype=np.int8)
                for bit in (1, 2):
                    own = (sets & bit) > 0
                    steps = np.bincount(end[own] - size[own], minlength=len(text) + 1) - np.bincount(end[own], minlength=len(text) + 1)
                    code[1:] |= np.where(np.cumsum(steps) > 0, bit, 0).astype(np.int8)
                cuts = np.flatnonzero(np.diff(code))
                start, stop, kind = cuts[:-1], cuts[1:], code[cuts[:-1] + 1]
                kept = kind > 0
                at.append(np.full(int(kept.sum()), i))
                parts.append(np.stack((start[kept], stop[kept], kind[kept] & 1, kind[kept] >> 1)))
            if parts:
                start, stop, a, n = np.concatenate(parts, axis=1)
                columns = [pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(a, pa.int32()), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(at), pa.int64())), *columns], names=[key, "start", "end", "_a", "_n"])

    return texts.select(key, F.col(sequence).cast("string").alias("_text")).mapInArrow(run, schema)


def covered_runs(texts: DataFrame, active: DataFrame, negative: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """(key, start, end, active, negative): the positions under a span of either set as disjoint runs.

    An automaton gives the runs of each text where it lies; those of all its spans and rows of one key are merged by a
    sweep over their ends, two rows a run, so that no position is a row.
    """
    side = lambda df, a, n: df.withColumn("_a", F.lit(a)).withColumn("_n", F.lit(n))
    table = side(active, 1, 0).unionByName(side(negative, 0, 1))
    table = table.groupBy("motif", "kind").agg(F.max("_a").alias("_a"), F.max("_n").alias("_n"))
    exact = table.where("kind = 'exact' and motif <> ''").select("motif", "_a", "_n")
    letters_ = exact.agg(F.coalesce(F.sum(F.length("motif")), F.lit(0))).first()[0]
    if letters_ <= AUTOMATON_LETTERS:
        spans = _runs_by_automaton(texts, exact, key, sequence)
    else:
        spans = _hits_by_head(texts, exact, key, sequence, ["_a", "_n"]).select(key, "start", "end", "_a", "_n")
    if not active.where("kind = 'regex'").isEmpty():
        spans = spans.unionByName(side(regex_hits(texts, active, key, sequence), 1, 0).select(key, "start", "end", "_a", "_n"))
    ends = spans.select(key, F.inline(F.array(
        F.struct(F.col("start").alias("start"), F.col("_a").alias("a"), F.col("_n").alias("n")),
        F.struct(F.col("end").alias("start"), (-F.col("_a")).alias("a"), (-F.col("_n")).alias("n")),
    )))
    ends = ends.groupBy(key, "start").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    order = Window.partitionBy(key).orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = lambda c: (F.sum(c).over(upto) > 0).cast("int").alias(c)
    swept = ends.select(key, "start", F.lead("start").over(order).alias("end"), open_("a"), open_("n"))
    return swept.where("a + n > 0").select(key, "start", "end", F.col("a").alias("active"), F.col("n").alias("negative"))


def coverage(texts: DataFrame, active: DataFrame, negative: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """(key, pos, active, negative) for every position under a span of either set."""
    runs = covered_runs(texts, active, negative, key, sequence)
    return runs.select(key, F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"), "active", "negative")


def motif_profile(texts: DataFrame, active: DataFrame, negative: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """Ten numbers per text: length, covered positions, free positions in both modes, fractions, flags."""
    runs = covered_runs(texts, active, negative, key, sequence).withColumn("l", F.col("end") - F.col("start"))
    sums = runs.groupBy(key).agg(
        F.sum(F.col("active") * F.col("l")).alias("a"), F.sum(F.col("negative") * F.col("l")).alias("n"), F.sum("l").alias("u")
    )
    z = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = texts.select(key, F.length(sequence).cast("bigint").alias("length")).join(sums, key, "left")
    share = lambda c: F.when(F.col("length") > 0, c / F.col("length")).otherwise(0.0)
    return out.select(
        key, "length", z("a").alias("active_positions"), z("n").alias("negative_positions"), z("u").alias("fixed_positions"),
        (F.col("length") - z("a")).alias("free_de"), (F.col("length") - z("u")).alias("free_inp"),
        share(z("a")).alias("active_fraction"), share(z("u")).alias("fixed_fraction"),
        (z("a") > 0).alias("has_active"), (z("n") > 0).alias("has_negative"),
    )


def task_flags(profile: DataFrame) -> DataFrame:
    """Candidate flags of the two tasks; `known` says whether the label is known."""
    de = F.col("has_active") & (F.col("free_de") >= 1)
    inp = F.col("has_active") & F.col("has_negative") & (F.col("free_inp") >= 1)
    return profile.withColumns({"optimizable_de": F.col("free_de") >= 1, "optimizable_inp": F.col("free_inp") >= 1,
                                "de": de, "inp": inp})


def region_index(texts: DataFrame, active: DataFrame, negative: DataFrame, key: str, sequence: str = "sequence") -> DataFrame:
    """(key, region): one digit per position, 0 free, 1 active, 2 negative; active wins."""
    runs = covered_runs(texts, active, negative, key, sequence)
    code = F.when(F.col("active") == 1, "1").otherwise("2")
    run = F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"), code.alias("c"))
    per = runs.groupBy(key).agg(F.array_sort(F.collect_list(run)).alias("p"))
    both = texts.select(key, F.length(sequence).alias("n")).join(per, key, "left")
    zeros = lambda n: F.repeat(F.lit("0"), n)
    marked = F.array_join(
        F.transform("p", lambda x, i: F.concat(zeros(x["s"] - F.when(i > 0, F.get("p", i - 1)["e"]).otherwise(0)), F.repeat(x["c"], x["e"] - x["s"]))), ""
    )
    last = F.element_at("p", -1)["e"]
    return both.select(key, F.when(F.col("p").isNull(), zeros(F.col("n"))).otherwise(F.concat(marked, zeros(F.col("n") - last))).alias("region"))


def region_codes(region: Column) -> Column:
    return letters(region).cast("array<int>")


def free_mask(region: Column) -> Column:
    return F.transform(letters(region), lambda c: c == "0")


#: Letters of a text that meet the spans on them in one row.
WINDOW_BLOCK = 1024


def motif_windows(texts: DataFrame, spans: DataFrame, key: str, sequence: str = "sequence", width: int = 15) -> DataFrame:
    """Text of `width` letters around the centre of each span, '-' outside the sequence; 1-based columns.

    Spans meet blocks of their text and cut their windows out of them: every text is shuffled once, not every position.
    """
    half, size = width // 2, max(WINDOW_BLOCK, width)
    pad = F.lit(K.GAP * half)
    padded = texts.select(key, F.concat(pad, F.col(sequence), F.lit(K.GAP * (width - 1 - half))).alias("_t"))
    blocks = text_blocks(padded, [key], "_t", size, width - 1).drop("_own")
    centred = spans.withColumn("_c", F.floor((F.col("start") + F.col("end") - 1) / 2))
    centred = centred.where("_c >= 0").withColumn("_i", F.floor(F.col("_c") / size).cast("int"))
    window = F.substr("_b", (F.col("_c") - F.col("_i") * F.lit(size) + 1).cast("int"), F.lit(width))
    return centred.join(blocks, [key, "_i"]).where(F.length(window) == width).select(
        key, "motif", (F.col("start") + 1).alias("motif_start"), F.col("end").alias("motif_end"), (F.col("_c") + 1).alias("motif_center"), window.alias("window")
    )


def logo_frequency(windows: DataFrame, width: int = 15) -> DataFrame:
    """Per column and residue: count and share of the non-gap letters; zero rows kept."""
    long = windows.select(F.posexplode(letters(F.col("window"))).alias("p", "residue"))
    counts = long.where(F.col("residue") != K.GAP).groupBy((F.col("p") + 1).alias("position"), "residue").agg(F.count("*").alias("n"))
    total = counts.groupBy("position").agg(F.sum("n").alias("t"))
    grid = windows.sparkSession.range(1, width + 1).select(
        F.col("id").alias("position"), F.explode(F.array(*[F.lit(a) for a in K.RESIDUES])).alias("residue")
    )
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, ["position", "residue"], "left").join(total, "position", "left").select(
        "position", "residue", n.alias("count"), F.coalesce(n / F.col("t"), F.lit(0.0)).alias("frequency")
    )


LENGTH_PROBS = {"min": 0, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "max": 1}


def summarize_split(profile: DataFrame, split: str) -> DataFrame:
    """Per split: counts, position totals and floor quantiles of length, fractions and free positions."""
    has = lambda c: F.count_if(F.col(c))
    profile = cut_lineage(profile)
    out = profile.groupBy(split).agg(
        F.count("*").alias("n"), has("has_active").alias("with_active"), F.count_if(~F.col("has_active")).alias("without_active"),
        has("has_negative").alias("with_negative"), F.sum("active_positions").alias("active_total"),
        F.sum("negative_positions").alias("negative_total"), F.sum("fixed_positions").alias("fixed_total"),
    )
    columns = ["length", "active_fraction", "fixed_fraction", "free_de", "free_inp"]
    long = profile.select(split, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([split], columns, "column", "v")
    q = O.quantiles(long, "v", LENGTH_PROBS, [split, "column"], interpolate=False)
    wide = q.groupBy(split).pivot("column", columns).agg(*[F.first(p).alias(p) for p in LENGTH_PROBS])
    return out.join(wide, split)


def label_counts(df: DataFrame, split: str, labels: list) -> DataFrame:
    """(split, label, value, n) for each label column."""
    long = df.select(split, *labels).unpivot([split], labels, "label", "value")
    return long.groupBy(split, "label", "value").agg(F.count("*").alias("n"))
