"""Finding short sequences that are all but a few letters contained in longer ones: tries walked by the longer texts.

A sequence of n letters meets the share t of its length in a text that is not shorter if all but n - ceil(t n) of its
letters stand in it in order. Sequences are kept in tries. A text walks down a trie with, for each number of letters left
out, the shortest beginning of the text that holds the rest, and leaves a branch once no sequence below can reach its
share. The work follows the prefixes that texts have in common with the sequences, not the pairs. Cells are ranges of the
sequences in order, bounded by a sample; a text visits the cells whose common prefix it can walk down.
"""

from bisect import bisect_right

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from seqloom.operators.composition import SLACK

#: Sequences that may leave out more letters or are longer are compared by composition.
MOST_LEFT_OUT, MOST_LETTERS = 4, 256
#: Sequences of a cell, most cells, rows that the bounds are chosen from, and texts of a group.
CELL_ROWS, MOST_CELLS, SAMPLE_ROWS, GROUP_TEXTS = 16_384, 1024, 20_000, 1 << 18
#: Entries of the table of next letters of a step, texts of a step, and branches that are followed at once.
STEP_ENTRIES, STEP_TEXTS, STEP_ROWS = 1 << 20, 1024, 1 << 18
#: Sequences of the first trie where any partner will do; each further one holds so many times more.
FIRST_TRIE, TRIE_GROWTH = 256, 8


def least(size: Column, share: float) -> Column:
    """Letters that a sequence must have in common with a text."""
    return F.ceil(F.lit(float(share)) * size - SLACK)


def indexed(sequence: str, share: float) -> Column:
    """Whether a sequence is kept in tries."""
    size = F.length(sequence)
    return (size - least(size, share) <= MOST_LEFT_OUT) & (size <= MOST_LETTERS)


def _raw(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _spread(first: np.ndarray, n: np.ndarray) -> tuple:
    """(row, value) for the n[row] values from first[row] on."""
    by = np.repeat(np.arange(len(n)), n)
    return by, first[by] + np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n)


class Trie:
    """Texts by their prefixes: items in order, nodes level by level. An item needs `least` letters of a text that has at
    least `shortest`; an item is a sequence or stands for all sequences that begin with it."""

    def __init__(self, texts: list, least: np.ndarray, shortest: np.ndarray, longest: np.ndarray):
        self.order = np.array(sorted(range(len(texts)), key=texts.__getitem__), dtype=np.int64)
        texts = [texts[i] for i in self.order]
        flat, size = _raw("".join(texts)), np.array([len(t) for t in texts], dtype=np.int64)
        self.alphabet = np.unique(flat)
        self.letters = len(self.alphabet)
        depth = int(size.max(initial=0))
        codes = np.zeros((len(texts), depth), dtype=np.int16)
        row = np.repeat(np.arange(len(texts)), size)
        codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.searchsorted(self.alphabet, flat) + 1
        differ = codes[1:] != codes[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), depth) if depth else np.zeros(max(0, len(texts) - 1), np.int64)
        same = np.minimum(same, np.minimum(size[1:], size[:-1]))
        least, shortest, out = least[self.order], shortest[self.order], (longest - least)[self.order]
        self.most_out = int(out.max(initial=0))
        self.least, self.out = least, out
        self.levels, above = [], None
        for k in range(depth + 1):
            cut = np.concatenate(([0], np.flatnonzero(same < k) + 1)) if len(texts) else np.zeros(0, np.int64)
            end = np.concatenate((cut[1:], [len(texts)])) if len(texts) else cut
            deep = size[end - 1] >= k if len(texts) else np.zeros(0, bool)
            start, end = cut[deep], end[deep]
            ends = np.flatnonzero(size == k)
            level = {
                "start": start, "end": end, "least": self._over(np.minimum, least, start, end), "out": self._over(np.maximum, out, start, end),
                "shortest": self._over(np.minimum, shortest, start, end), "items": ends,
                "first": np.searchsorted(ends, start), "last": np.searchsorted(ends, end),
            }
            if k:
                level["letter"] = codes[start, k - 1].astype(np.int64)
                above["child"] = np.searchsorted(start, above["start"])
                above["children"] = np.searchsorted(start, above["end"]) - above["child"]
            above = level
            self.levels.append(level)
        if above is not None:
            above["child"] = above["children"] = np.zeros(len(above["start"]), np.int64)

    @staticmethod
    def _over(fold, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if not len(start):
            return values[:0]
        # A last value that no range takes in, as a range may end with the values.
        ends = np.ravel(np.column_stack((start, end)))
        return fold.reduceat(np.concatenate((values, values[-1:])), ends)[::2]

    def _next(self, texts: list) -> tuple:
        """(places after the next letter of each kind from each place on, sizes); the place after the longest text's end
        plus one is none."""
        flat, size = _raw("".join(texts)), np.array([len(t) for t in texts], dtype=np.int64)
        longest = int(size.max(initial=0))
        at = np.minimum(np.searchsorted(self.alphabet, flat), max(0, self.letters - 1))
        code = np.where(self.alphabet[at] == flat, at + 1, 0) if self.letters else np.zeros(len(flat), np.int64)
        placed = np.zeros((len(texts), longest), dtype=np.int64)
        row = np.repeat(np.arange(len(texts)), size)
        placed[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = code
        table = np.full((len(texts), longest + 2, self.letters + 1), longest + 1, dtype=np.int16 if longest < 32_000 else np.int32)
        every = np.arange(len(texts))
        for p in range(longest - 1, -1, -1):
            table[:, p] = table[:, p + 1]
            table[every, p, placed[:, p]] = p + 1
            table[:, p, 0] = longest + 1  # letters of no item
        return table, size

    def walk(self, texts: list, keep=None):
        """(text, item) index arrays of all that meet, level by level of a step of texts. `keep(level, texts, nodes)`
        marks the branches that are still wanted."""
        at = 0
        while at < len(texts):
            step, room = at + 1, len(texts[at])
            while step < len(texts) and step - at < STEP_TEXTS:
                more = max(room, len(texts[step]))
                if (step + 1 - at) * (more + 2) * (self.letters + 1) > STEP_ENTRIES:
                    break
                room, step = more, step + 1
            for x, item in self._step(texts[at:step], at, keep):
                yield x + at, item
            yield None  # the end of a step
            at = step

    def _step(self, texts: list, at: int, keep):
        table, size = self._next(texts)
        first = np.full((len(texts), self.most_out + 1), table.shape[1] - 1, dtype=table.dtype)
        first[:, 0] = 0
        todo = [(0, np.arange(len(texts)), np.zeros(len(texts), np.int64), first)] if len(self.order) else []
        if todo:
            yield from self._ends(*todo[0], size)
        while todo:
            k, x, node, place = todo.pop()
            total = np.cumsum(self.levels[k]["children"][node])
            if total[-1] > STEP_ROWS and len(node) > 1:
                half = min(len(node) - 1, 1 + int(np.searchsorted(total, total[-1] // 2)))
                todo += [(k, x[half:], node[half:], place[half:]), (k, x[:half], node[:half], place[:half])]
                continue
            below = self._down(k, x, node, place, table, size, at, keep)
            if below is not None:
                yield from self._ends(*below, size)
                todo.append(below)

    def _room(self, k: int, size: np.ndarray, least: np.ndarray, out: np.ndarray) -> np.ndarray:
        """For each number of letters left out of k the last place from which `least` letters can still be reached."""
        outs = np.arange(self.most_out + 1)
        room = np.minimum(size[:, None], (size - least + k)[:, None] - outs)
        return np.where(outs <= out[:, None], room, -1)

    def _ends(self, k: int, x, node, place, size):
        """The items that end at the nodes and are met."""
        level = self.levels[k]
        by, at = _spread(level["first"][node], level["last"][node] - level["first"][node])
        if len(by):
            item = level["items"][at]
            good = (place[by] <= self._room(k, size[x[by]], self.least[item], self.out[item])).any(axis=1)
            if good.any():
                yield x[by[good]], self.order[item[good]]

    def _down(self, k: int, x, node, place, table, size, at: int, keep):
        """The branches below, where they stay open."""
        level = self.levels[k]
        by, child = _spread(level["child"][node], level["children"][node])
        if not len(by):
            return None
        below, x = self.levels[k + 1], x[by]
        good = below["shortest"][child] <= size[x]
        if keep is not None:
            good &= keep(k + 1, x + at, child)
        by, child, x = by[good], child[good], x[good]
        place = place[by]
        new = table[x[:, None], place, below["letter"][child][:, None]]
        np.minimum(new[:, 1:], place[:, :-1], out=new[:, 1:])
        fits = new <= self._room(k + 1, size[x], below["least"][child], below["out"][child])
        new[~fits] = table.shape[1] - 1
        alive = np.flatnonzero(fits.any(axis=1))
        return (k + 1, x[alive], child[alive], new[alive]) if len(alive) else None

    def top(self, values: np.ndarray) -> list:
        """For each level the highest value of the items below each node."""
        values = values[self.order]
        return [self._over(np.maximum, values, level["start"], level["end"]) for level in self.levels]


def trie_of(texts: list, share: float) -> Trie:
    size = np.array([len(t) for t in texts], dtype=np.int64)
    return Trie(texts, np.ceil(share * size - SLACK).astype(np.int64), size, size)


def first_texts(trie: Trie, texts: list, ids: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each item the smallest id, under the item's limit, of a text it meets, else -1. Texts are in order of their ids;
    what has been met lowers the limits, so later texts leave the branches that are done."""
    limit, out = limit.copy(), np.full(len(limit), -1, dtype=np.int64)
    tops, changed = trie.top(limit), False
    for found in trie.walk(texts, lambda k, x, node: tops[k][node] > ids[x]):
        if found is None:
            if changed:
                tops, changed = trie.top(limit), False
            continue
        x, item = found
        good = ids[x] < limit[item]
        if good.any():
            np.minimum.at(limit, item[good], ids[x[good]])
            out[item[good]] = limit[item[good]]
            changed = True
    return out


def earlier_texts(trie: Trie, texts: list, ids: np.ndarray, limit: np.ndarray, most: int):
    """(item, id) arrays, a step of texts at a time, of the texts with ids under the item's limit that it meets. Texts are in
    order of their ids; once an item has met `most` or more, it asks for no further ones."""
    limit, met, some = limit.copy(), np.zeros(len(limit), dtype=np.int64), []
    tops = trie.top(limit)
    for found in trie.walk(texts, lambda k, x, node: tops[k][node] > ids[x]):
        if found is not None:
            x, item = found
            good = ids[x] < limit[item]
            some.append((item[good], ids[x[good]]))
            continue
        if some:
            items, others = (np.concatenate(c) for c in zip(*some))
            some = []
            met += np.bincount(items, minlength=len(met))
            full = met >= most
            if full.any():
                limit[full] = -1
                tops = trie.top(limit)
            yield items, others


def meets_any(texts: list, sequences: list, share: float) -> np.ndarray:
    """Whether each text meets one of the sequences. Small tries come first, as most texts that meet many are found there."""
    out = np.zeros(len(texts), dtype=bool)
    first, upto = 0, FIRST_TRIE
    while first < len(sequences):
        todo = np.flatnonzero(~out)
        if not len(todo):
            break
        done = np.zeros(len(todo), dtype=bool)
        for found in trie_of(sequences[first:upto], share).walk([texts[i] for i in todo], lambda k, x, node: ~done[x]):
            if found is not None:
                done[found[0]] = True
        out[todo[done]] = True
        first, upto = upto, upto * TRIE_GROWTH
    return out


class Ranges:
    """Cells of sequences: ranges in order. `trie` has what the sequences of each cell have in common."""

    def __init__(self, sample: list, cells: int):
        some = sorted(sample)
        most = max(1, -(-len(some) // max(1, cells)))
        bounds, todo = [""], [(0, len(some), 0)]
        # A prefix of too many rows is cut at its next letter; only neighbours under one prefix share a cell.
        while todo:
            a, b, k = todo.pop()
            if b > a:
                bounds.append(some[a][:k])
            if b - a <= most or some[a] == some[b - 1]:
                continue
            filled, i = 0, a
            while i < b:
                j = bisect_right(some, some[i][: k + 1], i, b, key=lambda s: s[: k + 1])
                if j - i > most:
                    todo.append((i, j, k + 1))
                elif i > a and not 0 < filled <= most - (j - i):
                    bounds.append(some[i][: k + 1])
                    filled = 0
                filled = 0 if j - i > most else filled + j - i
                i = j
        self.bounds = sorted(set(bounds))

    def find(self, text: str) -> int:
        return max(0, bisect_right(self.bounds, text) - 1)

    def set_cells(self, rows: list) -> None:
        """rows: (cell, first, last sequence, least letters, most left out, shortest, rows)."""
        self.cells = np.array([r[0] for r in rows], dtype=np.int32)
        self.rows = {int(r[0]): int(r[6]) for r in rows}
        texts = []
        for r in rows:
            n = 0
            while n < min(len(r[1]), len(r[2])) and r[1][n] == r[2][n]:
                n += 1
            texts.append(r[1][:n])
        least, out, shortest = (np.array([r[i] for r in rows], dtype=np.int64) for i in (3, 4, 5))
        self.trie = Trie(texts, least, shortest, least + out)

    def open(self, texts: list) -> list:
        """The cells each text visits."""
        out = [[] for _ in texts]
        for found in self.trie.walk(texts):
            if found is not None:
                for x, item in zip(found[0].tolist(), self.cells[found[1]].tolist()):
                    out[x].append(item)
        return out


def fit(df: DataFrame, share: float, sequence: str = "sequence", cell_rows: int = CELL_ROWS, most: int = MOST_CELLS, sample: int = SAMPLE_ROWS) -> tuple:
    """(cells, rows with `cell`). Bounds come from at most `sample` rows chosen by hash; cells hold all rows."""
    n = df.count()
    some = [r[0] for r in df.orderBy(F.xxhash64(sequence), sequence).limit(sample).select(sequence).collect()]
    cells = Ranges(some, max(1, min(most, -(-n // cell_rows))))

    @F.pandas_udf(IntegerType())
    def place(texts):
        import pandas as pd

        return pd.Series([cells.find(t) for t in texts], dtype=np.int32)

    rows = df.withColumn("cell", place(sequence))
    size = F.length(sequence)
    need = least(size, share)
    cells.set_cells([tuple(r) for r in rows.groupBy("cell").agg(F.min(sequence), F.max(sequence), F.min(need), F.max(size - need), F.min(size), F.count(F.lit(1))).orderBy("cell").collect()])
    return cells, rows


def visits(cells: Ranges, sequence: str = "sequence") -> Column:
    """The cells that may hold a sequence which a text meets."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def open_cells(texts):
        import pandas as pd

        return pd.Series(cells.open(texts.tolist()))

    return open_cells(sequence)


def meet(cells: Ranges, sequences: DataFrame, texts: DataFrame, kernel, schema: str, n_texts: int) -> DataFrame:
    """kernel(key, sequences, texts) for the rows that have `scope` and `cell` in common; a cell of far more sequences than
    planned and a large number of texts are cut into parts."""
    full = {c: -(-n // CELL_ROWS) for c, n in cells.rows.items() if n > 4 * CELL_ROWS}
    split = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in full.items() for x in pair]), F.col("cell")), F.lit(1)) if full else F.lit(1)
    parts = F.lit(max(1, -(-n_texts // GROUP_TEXTS)))
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    l = sequences.withColumn("_i", place(split)).withColumn("_j", every(parts))
    r = texts.withColumn("cell", F.explode(visits(cells))).withColumn("_j", place(parts)).withColumn("_i", every(split))
    # Names of their own, as both sides may come from one table.
    r = r.select(*(F.col(c).alias(c) for c in r.columns))
    at = ["scope", "cell", "_i", "_j"]
    return l.groupBy(*at).cogroup(r.groupBy(*at)).applyInArrow(kernel, schema)
