"""Comparing sequences by longest common subsequence without a pair table: cells of similar composition.

Rows are points of letter counts. A tree of median splits over a bounded sample cuts the space into cells, and every
cell has a box: the most it has of each letter, its shortest and longest length. The letters that two sequences share
bound their common subsequence, so a box bounds what any member can reach, and a sequence visits only the cells whose
box leaves something open. Where a sequence meets a cell, blocks are compared in numpy: first the letters and the letter
pairs of all pairs of a block, then a bit-parallel common subsequence of those that are left. Only results leave a
block.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from seqloom import constants as K

#: Rows of a cell and of a block, most cells, and rows that the tree is fitted on.
CELL_ROWS, BLOCK_ROWS, MOST_CELLS, SAMPLE_ROWS = 4096, 4096, 1024, 20_000
#: Letters of a block; long texts make blocks of fewer rows.
BLOCK_LETTERS = 1 << 21
#: Pairs whose letters are compared at once.
SLAB = 1 << 22
#: Letters in the padded texts of one bit-parallel step.
STEP_LETTERS = 1 << 22
#: Slack of comparisons with a share of a length.
SLACK = 1e-9


def composition(s: Column) -> Column:
    """Counts of the residues, of all other letters, and the length."""
    counts = [F.length(s) - F.length(F.replace(s, F.lit(c), F.lit(""))) for c in K.RESIDUES]
    return F.array(*counts, F.length(s) - sum(counts, F.lit(0)), F.length(s))


class Cells:
    """A tree of median splits over points, and the boxes of its leaves."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.dim, self.cut, self.down, self.leaf = [], [], [], []
        todo = [(np.arange(len(points)), self._node())]
        count = 1
        while todo:
            # The fullest leaf is split next, so that leaves are of like size.
            todo.sort(key=lambda x: len(x[0]))
            rows, node = todo.pop()
            some = points[rows]
            spread = some.max(0) - some.min(0) if len(rows) else np.zeros(1)
            if count >= leaves or len(rows) < 2 or not spread.any():
                continue
            for d in np.argsort(-(some.std(0) + 1e-9 * spread)):
                cut = np.median(some[:, d])
                low = some[:, d] <= cut
                if low.all():
                    low = some[:, d] < cut
                    cut = np.nextafter(cut, -np.inf)
                if low.any() and not low.all():
                    break
            self.dim[node], self.cut[node] = int(d), float(cut)
            self.down[node] = (self._node(), self._node())
            todo += [(rows[low], self.down[node][0]), (rows[~low], self.down[node][1])]
            count += 1
        self.dim, self.cut = np.array(self.dim), np.array(self.cut)
        self.down = np.array(self.down).reshape(-1, 2)

    def _node(self) -> int:
        self.dim.append(-1)
        self.cut.append(0.0)
        self.down.append((-1, -1))
        return len(self.dim) - 1

    def find(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        at = np.zeros(len(points), dtype=np.int64)
        rows = np.arange(len(points))
        while True:
            inner = self.dim[at] >= 0
            if not inner.any():
                return at
            right = points[rows, np.maximum(self.dim[at], 0)] > self.cut[at]
            at = np.where(inner, self.down[at, right.astype(np.int64)], at)

    def set_boxes(self, boxes: list) -> None:
        """boxes: (cell, most of each letter..., shortest, longest, rows, letters)."""
        table = np.array(boxes, dtype=np.int64).reshape(len(boxes), len(K.RESIDUES) + 6)
        self.cells, self.most, self.short, self.long, self.rows, self.size = table[:, 0], table[:, 1:-4], *table[:, -4:].T

    def shared(self, points: np.ndarray) -> np.ndarray:
        """(points, cells): upper bound of the letters that a point shares with a member of a cell."""
        out = np.zeros((len(points), len(self.cells)), dtype=np.int64)
        for d in range(self.most.shape[1]):
            out += np.minimum.outer(points[:, d], self.most[:, d])
        return out


def _points(column) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.int64).reshape(len(column), len(K.RESIDUES) + 2)


def fitted_on(rows: DataFrame, n: int, sequence: str, sample: int) -> DataFrame:
    """(h, comp) of about 1.5 times `sample` rows of the `n` by the hash of their sequence; all, if there are not many more.

    Each partition sends its first rows to the driver, so few rows may be left in all of them, and none with its text."""
    rows = rows.select(F.xxhash64(sequence).alias("h"), "comp")
    share = 1.5 * sample / max(1, n)
    return rows if share >= 1 else rows.where(F.col("h") < F.lit(int(2**64 * share) - 2**63))


def fit(df: DataFrame, sequence: str = "sequence", cell_rows: int = CELL_ROWS, most: int = MOST_CELLS, sample: int = SAMPLE_ROWS) -> tuple:
    """(cells, rows with `comp` and `cell`). The tree is fitted on at most `sample` rows chosen by hash; boxes hold all rows,
    and there are at most `most` of them."""
    rows = df.withColumn("comp", composition(F.col(sequence)))
    n = df.count()
    points = [r[0] for r in fitted_on(rows, n, sequence, sample).orderBy("h", "comp").limit(sample).select("comp").collect()]
    cells = Cells(np.array(points, dtype=np.int64).reshape(len(points), len(K.RESIDUES) + 2), max(1, min(most, -(-n // cell_rows))))

    @F.pandas_udf(IntegerType())
    def place(comp):
        import pandas as pd

        return pd.Series(cells.find(_points(comp)).astype(np.int32))

    rows = rows.withColumn("cell", place("comp"))
    letters = [F.max(F.get("comp", F.lit(i))) for i in range(len(K.RESIDUES) + 1)]
    size = F.get("comp", F.lit(len(K.RESIDUES) + 1))
    cells.set_boxes([tuple(r) for r in rows.groupBy("cell").agg(*letters, F.min(size), F.max(size), F.count(F.lit(1)), F.sum(size)).collect()])
    return cells, rows


def visits(cells: Cells, comp: Column, least: Column, share: str) -> Column:
    """The cells that may hold a partner: with share 'shorter' one that shares at least `least` of the shorter length, with
    'longer' one that shares more than `least` of the longer length."""
    @F.pandas_udf(ArrayType(IntegerType()))
    def open_cells(comp, least):
        import pandas as pd

        points, low = _points(comp), least.to_numpy(dtype=np.float64)[:, None]
        bound, size = cells.shared(points), points[:, -1:]
        if share == "shorter":
            fits = bound >= low * np.minimum(size, cells.short[None, :]) - SLACK
        else:
            fits = np.minimum(bound, np.minimum(size, cells.long[None, :])) / np.maximum(np.maximum(size, cells.short[None, :]), 1) > low
        return pd.Series([cells.cells[row] for row in fits])

    return open_cells(comp, least)


def meet(cells: Cells, left: DataFrame, right: DataFrame, kernel, schema: str, n_left: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """kernel(key, left table, right table) for every two blocks of rows that have `scope` and `cell` in common.

    Both sides carry scope, cell and id; left has about n_left ids, right rows are those of the cells. The left side is
    cut into blocks of about `rows`, and so is a cell that could not be split, as its rows have one composition. Cells of
    long texts are cut into blocks of about BLOCK_LETTERS, so that a task's memory depends on neither.
    """
    blocks = [max(-(-int(n) // rows) if n > 2 * rows else 1, -(-int(m) // BLOCK_LETTERS)) for n, m in zip(cells.rows, cells.size)]
    full = {int(c): n for c, n in zip(cells.cells, blocks) if n > 1}
    split = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in full.items() for x in pair]), F.col("cell")), F.lit(1)) if full else F.lit(1)
    parts = F.lit(max(1, -(-n_left // rows)))
    place = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    l = left.withColumn("_i", place(parts)).withColumn("_j", every(split))
    r = right.withColumn("_j", place(split)).withColumn("_i", every(parts))
    # Names of their own, as both sides may come from one table.
    r = r.select(*(F.col(c).alias(c) for c in r.columns))
    at = ["scope", "cell", "_i", "_j"]
    return l.groupBy(*at).cogroup(r.groupBy(*at)).applyInArrow(kernel, schema)


class Texts:
    """Sequences of a block as codes of their letters, with letter and letter-pair counts."""

    def __init__(self, left: list, right: list):
        raw = [self._raw(x) for x in (left, right)]
        letters = np.union1d(*(np.unique(x) for x in raw))
        self.letters, self.grams, self.masks = len(letters), None, {}
        self.sides = []
        for texts, flat in zip((left, right), (np.searchsorted(letters, x).astype(np.int32) for x in raw)):
            size = np.array([len(t) for t in texts], dtype=np.int64)
            first = np.concatenate(([0], np.cumsum(size)))[:-1]
            row = np.repeat(np.arange(len(texts), dtype=np.int32), size)
            counts = np.bincount(row.astype(np.int64) * self.letters + flat, minlength=len(texts) * self.letters).reshape(len(texts), self.letters)
            self.sides.append({"size": size, "first": first, "flat": flat, "row": row, "counts": counts.astype(np.int32)})

    @staticmethod
    def _raw(texts: list) -> np.ndarray:
        """Code points of all letters, a byte each where that is enough."""
        joined = "".join(texts)
        return np.frombuffer(joined.encode("ascii"), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)

    def shared(self, start: int, stop: int) -> np.ndarray:
        """Letters that the left texts start..stop have in common with every right one, order aside."""
        a, b = self.sides[0]["counts"][start:stop], self.sides[1]["counts"]
        longest = max(s["size"].max(initial=0) for s in self.sides)
        kind = np.int16 if longest < 1 << 15 else np.int32
        a, b = a.astype(kind), b.astype(kind)
        out = np.zeros((len(a), len(b)), dtype=kind)
        for c in range(self.letters):
            if a[:, c].any() and b[:, c].any():
                out += np.minimum.outer(a[:, c], b[:, c])
        return out

    def slabs(self):
        """Ranges of left texts whose pairs are compared at once."""
        step = max(1, SLAB // max(1, len(self.sides[1]["size"])))
        for start in range(0, len(self.sides[0]["size"]), step):
            yield start, min(len(self.sides[0]["size"]), start + step)

    def _masks(self, rows, words: int) -> np.ndarray:
        """For rows of the left side and each letter (and none) the places of the letter, a bit each."""
        side = self.sides[0]
        out = np.zeros((len(rows), self.letters + 1, words), dtype=np.uint64)
        for p in range(min(64 * words, int(side["size"][rows].max(initial=0)))):
            has = np.flatnonzero((side["size"][rows] > p) & (side["size"][rows] <= 64 * words))
            letter = side["flat"][side["first"][rows[has]] + p]
            out[has, letter, p >> 6] |= np.uint64(1) << np.uint64(p & 63)
        return out

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common subsequences of the pairs (x[i], y[i]), bit-parallel and many pairs at once."""
        out = np.zeros(len(x), dtype=np.int64)
        words = -(-self.sides[0]["size"][x] // 64)
        order = np.lexsort((self.sides[1]["size"][y], words))
        at = 0
        while at < len(order):
            # Pairs of like sizes: as many as fit one step.
            w, upto = max(1, int(words[order[at]])), at + 1
            room = int(np.searchsorted(words[order], words[order[at]], "right"))
            while upto < room:
                more = min(room, 2 * upto - at)
                if (more - at) * (int(self.sides[1]["size"][y[order[more - 1]]]) + 64 * w) > STEP_LETTERS:
                    break
                upto = more
            some = order[at:upto]
            out[some] = self._step(x[some], y[some], w)
            at = upto
        return out

    def _step(self, x, y, words: int) -> np.ndarray:
        side = self.sides[1]
        if words == 1:  # the places of all left texts of up to 64 letters, kept
            own = x
            if words not in self.masks:
                self.masks[words] = self._masks(np.arange(len(self.sides[0]["size"])), words)
            masks = self.masks[words]
        else:
            rows, own = np.unique(x, return_inverse=True)
            masks = self._masks(rows, words)
        size, first = side["size"][y], side["first"][y]
        row = np.full((len(x), words), np.iinfo(np.uint64).max, dtype=np.uint64)
        flat = np.concatenate((side["flat"], [self.letters]))
        for p in range(int(size.max(initial=0))):
            letter = np.where(size > p, flat[np.minimum(first + p, len(flat) - 1)], self.letters)
            hit = row & masks[own, letter]
            rest = row ^ hit
            if words == 1:
                row = (row + hit) | rest
                continue
            carry = np.zeros(len(x), dtype=np.uint64)
            for w in range(words):
                total = row[:, w] + hit[:, w]
                over = total < row[:, w]
                total = total + carry
                carry = (over | (total < carry)).astype(np.uint64)
                row[:, w] = total | rest[:, w]
        return np.bitwise_count(~row).sum(axis=1).astype(np.int64)

    def fits(self, x, y, least) -> np.ndarray:
        """Whether the letter pairs of (x[i], y[i]) allow a common subsequence of `least`.

        One of l letters falls into at most m + n - 2 l + 1 runs that are unbroken in both texts, so at least 3 l - m -
        n - 1 neighbouring letters stand in both.
        """
        m, n = self.sides[0]["size"][x], self.sides[1]["size"][y]
        need = 3 * least - m - n - 1
        out = need <= 0
        test = np.flatnonzero(~out)
        if not len(test) or self.letters > 64:
            out[test] = True
            return out
        if self.grams is None:
            width = self.letters * self.letters
            self.grams = []
            for side in self.sides:
                inner = np.flatnonzero(side["row"][1:] == side["row"][:-1])
                code = side["row"][inner].astype(np.int64) * width + side["flat"][inner] * self.letters + side["flat"][inner + 1]
                found, counts = np.unique(code, return_counts=True)
                self.grams.append(np.zeros((len(side["size"]), width), dtype=np.int16))
                self.grams[-1].ravel()[found] = np.minimum(counts, 30_000)
        grams = self.grams
        for i in range(0, len(test), 1 << 14):
            some = test[i : i + (1 << 14)]
            both = np.minimum(grams[0][x[some]], grams[1][y[some]]).sum(axis=1, dtype=np.int64)
            out[some] = (both >= need[some]) | (n[some] > 30_000) | (m[some] > 30_000)
        return out


def first_partner(left: list, right: list, share: float, open_: np.ndarray) -> np.ndarray:
    """For each left text the index of the first right text it is marked open with whose common subsequence reaches
    `share` of the shorter length, else -1. Candidates are tried in order, a few at first and then more."""
    texts = Texts(left, right)
    m, n = texts.sides[0]["size"], texts.sides[1]["size"]
    out = np.full(len(left), -1, dtype=np.int64)
    if not len(right):
        return out
    for start, stop in texts.slabs():
        size = np.minimum.outer(m[start:stop], n)
        x, y = np.nonzero(open_[start:stop] & (size > 0) & (texts.shared(start, stop) >= share * size - SLACK))
        x, some = x + start, 4
        while len(x):
            first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            nth = np.arange(len(x)) - np.repeat(first, np.diff(np.concatenate((first, [len(x)]))))
            now = nth < some
            a, b = x[now], y[now]
            need = np.ceil(share * np.minimum(m[a], n[b]) - SLACK).astype(np.int64)
            good = texts.fits(a, b, need)
            a, b, need = a[good], b[good], need[good]
            hit = texts.common(a, b) >= need
            found, at = np.unique(a[hit], return_index=True)
            out[found] = b[hit][at]
            later = ~now & (out[x] < 0)
            x, y, some = x[later], y[later], some * 8
    return out


def partners(left: list, right: list, share: float, open_: np.ndarray):
    """(left, right) index arrays of the pairs marked open whose common subsequence reaches `share` of the shorter length."""
    texts = Texts(left, right)
    m, n = texts.sides[0]["size"], texts.sides[1]["size"]
    for start, stop in texts.slabs():
        size = np.minimum.outer(m[start:stop], n)
        x, y = np.nonzero(open_[start:stop] & (size > 0) & (texts.shared(start, stop) >= share * size - SLACK))
        x = x + start
        need = np.ceil(share * np.minimum(m[x], n[y]) - SLACK).astype(np.int64)
        good = texts.fits(x, y, need)
        x, y, need = x[good], y[good], need[good]
        hit = texts.common(x, y) >= need
        yield x[hit], y[hit]


def best_share(left: list, right: list, low: np.ndarray) -> np.ndarray:
    """For each left text the highest common subsequence over the longer length that beats `low`, else `low`. Candidates
    are tried by falling upper bound until none can beat the best so far."""
    texts = Texts(left, right)
    m, n = texts.sides[0]["size"], texts.sides[1]["size"]
    best = low.astype(np.float64).copy()
    if not len(right):
        return best
    for first, last in texts.slabs():
        longer = np.maximum(np.maximum.outer(m[first:last], n), 1)
        bound = texts.shared(first, last) / longer
        order = np.argsort(-bound, axis=1, kind="stable")
        own, start, some, rows = best[first:last], 0, 2, np.arange(last - first)
        while len(rows) and start < len(right):
            at = order[rows, start : start + some]
            fits = bound[rows[:, None], at] > own[rows][:, None]
            x, y = np.repeat(rows, fits.sum(axis=1)), at[fits]
            if len(x):
                np.maximum.at(own, x, texts.common(x + first, y) / longer[x, y])
            start += at.shape[1]
            # A row whose next bound is not higher than its best is done.
            rows = rows[bound[rows, order[rows, start]] > own[rows]] if start < len(right) else rows[:0]
            some *= 2
    return best
