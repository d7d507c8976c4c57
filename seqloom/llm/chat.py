"""Repair of the roles of conversations at least cost, and their rendering."""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from seqloom.llm.common import State

#: States of the legal-turn automaton: nothing yet, after a system, a user and an assistant message; and its moves.
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: A conversation may end after a user or an assistant message.
LAST = (USER, ASSISTANT)
#: Costs: appending a message to the one before, changing a role, giving one to a message without a known role, an empty
#: message. A merge under another role costs both.
MERGE, RELABEL, NAME, INSERT = 1, 3, 1, 2
_FAR = 1 << 40


def _steps():
    """For each label (3: unknown) and pair of states the least cost of reading one message, and how: merge, or the
    states of the empty messages before it. Of equal costs the first stands: no merge, fewer empty messages."""
    ways = {s: [((), s)] for s in range(4)}
    for s in range(4):
        for a in MOVES[s]:
            ways[s] += [((a,), a), *[((a, b), b) for b in MOVES[a]]]
    cost, how = np.full((4, 4, 4), _FAR, dtype=np.int64), {}
    for label in range(4):
        role = label + 1 if label < 3 else None
        for s in range(4):
            options = []
            for path, end in ways[s]:
                for t in MOVES[end]:
                    options.append((INSERT * len(path) + (0 if t == role else NAME if role is None else RELABEL), len(path), t, path))
            for c, _, t, path in sorted(options):
                if c < cost[label, s, t]:
                    cost[label, s, t], how[label, s, t] = c, ("keep" if t == role else "relabel", path)
            if s != START:
                c = MERGE + (0 if s == role else NAME if role is None else RELABEL)
                if c < cost[label, s, s]:
                    cost[label, s, s], how[label, s, s] = c, ("merge", ())
    return cost, how


COST, HOW = _steps()
#: Cost of ending in each state: after the start or a system message an empty user message follows.
END = np.array([_FAR, INSERT, 0, 0], dtype=np.int64)


def label_of(role) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else 3


def matrix(labels) -> np.ndarray:
    """Least cost of reading all messages from each state to each state."""
    best = np.where(np.eye(4, dtype=bool), 0, _FAR)
    for label in labels:
        best = (best[:, :, None] + COST[label][None]).min(axis=1)
    return np.minimum(best, _FAR)


def path(labels, first: int, last: int) -> list:
    """States after each message on the cheapest way from `first` to `last`; of equal ways the one of smaller states
    from the end on."""
    rows = [np.where(np.arange(4) == first, 0, _FAR)]
    for label in labels:
        rows.append(np.minimum((rows[-1][:, None] + COST[label]).min(axis=0), _FAR))
    states = [last]
    for label, row in zip(reversed(labels), reversed(rows[:-1])):
        states.append(int(np.argmin(row + COST[label][:, states[-1]])))
    return states[-2::-1] if len(states) > 1 else []


def join_segments(matrices: list) -> list:
    """(first, last) state of each segment of one conversation, in order, for the cheapest legal whole."""
    rows = [np.where(np.arange(4) == START, 0, _FAR)]
    for m in matrices:
        rows.append(np.minimum((rows[-1][:, None] + m).min(axis=0), _FAR))
    state, out = int(np.argmin(rows[-1] + END)), []
    for m, row in zip(reversed(matrices), reversed(rows[:-1])):
        before = int(np.argmin(row + m[:, state]))
        out.append((before, state))
        state = before
    return out[::-1]


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", opening: str = "<|{role}|>\n", closing: str = "<|end|>\n", glue: str = "\n") -> DataFrame:
    """(conv_id, position, turn, role, new_role, action, inserted, cost, rendered): one row for each message.

    Legal is an optional system message, then user and assistant in turn from a user on. Messages are read in order of
    turn (null first, ties by role and a hash of the text) and each is kept, relabelled or merged into the one before, with empty
    messages before it where needed, at the least total cost (MERGE, RELABEL, NAME, INSERT). `rendered` in order of
    `position` is the transcript of the repaired conversation: the row that starts a message closes the one before, and
    the last row closes its own. Roles are read without case and outer space; others and null are unknown. Null texts are
    empty; null ids are one conversation; repeated rows are messages; other columns are not read.

    Messages are ranged by conversation and turn, so a long conversation spans several partitions. Each part gives its
    4 x 4 matrix of least costs (min-plus products of its messages' matrices), the parts' end states follow from the
    product of the few matrices of a conversation, and each part then finds its way between its two states.
    """
    rows = turns.select(
        F.col(key).isNull().alias("unnamed"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("conv"), F.col(turn).cast("long").alias("turn"),
        F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    order = ["unnamed", "conv", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "tie"]
    state = State(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")

    def weigh(group):
        import pyarrow as pa

        group = _sorted(group)
        m = matrix([label_of(r) for r in group.column("role").to_pylist()])
        return pa.Table.from_arrays([group.column("unnamed")[:1], group.column("conv")[:1], group.column("part")[:1], pa.array([m.ravel().tolist()])], names=["unnamed", "conv", "part", "costs"])

    def meet(group):
        import pyarrow as pa

        parts = sorted(zip(group.column("part").to_pylist(), group.column("costs").to_pylist()))
        ends = join_segments([np.array(c, dtype=np.int64).reshape(4, 4) for _, c in parts])
        n = len(parts)
        return pa.Table.from_arrays(
            [pa.array([group.column("unnamed")[0].as_py()] * n), pa.array([group.column("conv")[0].as_py()] * n, pa.int64()), pa.array([p for p, _ in parts], pa.int32()),
             pa.array([a for a, _ in ends], pa.int32()), pa.array([b for _, b in ends], pa.int32()), pa.array([i == n - 1 for i in range(n)])],
            names=["s_unnamed", "s_conv", "s_part", "first", "last", "closes"],
        )

    def render(group, ends):
        import pyarrow as pa

        names = ["conv_id", "position", "turn", "role", "new_role", "action", "inserted", "cost", "rendered"]
        group = _sorted(group)
        first, last, closes = (ends.column(c)[0].as_py() for c in ("first", "last", "closes"))
        labels = [label_of(r) for r in group.column("role").to_pylist()]
        states = path(labels, first, last)
        out, before = [], first
        for i, (label, after, words) in enumerate(zip(labels, states, group.column("text").to_pylist())):
            action, empty = HOW[label, before, after]
            if action == "merge":
                piece = glue + (words or "")
            else:
                piece = (closing if before != START else "") + "".join(opening.format(role=ROLES[e - 1]) + closing for e in empty) + opening.format(role=ROLES[after - 1]) + (words or "")
            cost = int(COST[label, before, after])
            inserted = len(empty)
            if closes and i == len(labels) - 1:
                piece += closing
                if after not in LAST:
                    piece += opening.format(role=ROLES[USER - 1]) + closing
                    cost, inserted = cost + INSERT, inserted + 1
            out.append((i, ROLES[after - 1], action, inserted, cost, piece))
            before = after
        cols = list(zip(*out))
        conv = None if group.column("unnamed")[0].as_py() else group.column("conv")[0].as_py()
        base = group.column("part")[0].as_py() << 32
        return pa.Table.from_arrays(
            [pa.array([conv] * len(out), pa.int64()), pa.array([base + i for i in cols[0]], pa.int64()), group.column("turn").combine_chunks(), group.column("role").combine_chunks(),
             pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.string())],
            names=names,
        )

    parts = state.df.groupBy("unnamed", "conv", "part").applyInArrow(weigh, "unnamed boolean, conv long, part int, costs array<long>")
    ends = parts.groupBy("unnamed", "conv").applyInArrow(meet, "s_unnamed boolean, s_conv long, s_part int, first int, last int, closes boolean")
    schema = "conv_id long, position long, turn long, role string, new_role string, action string, inserted int, cost int, rendered string"
    return state.df.groupBy("unnamed", "conv", "part").cogroup(ends.groupBy("s_unnamed", "s_conv", "s_part")).applyInArrow(render, schema)


def _sorted(table):
    rows = table.to_pylist()
    at = sorted(range(len(rows)), key=lambda i: tuple(x for c in ("turn", "role", "tie") for x in (rows[i][c] is not None, rows[i][c] if rows[i][c] is not None else 0)))
    return table.take(at)


def transcripts(repaired: DataFrame) -> DataFrame:
    """(conv_id, transcript, cost) of whole conversations; each must fit in one row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "rendered")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("transcript"), F.sum("cost").alias("cost"))
