"""Log-probabilities of documents under an n-gram model of the corpus, as a weighted backoff automaton."""

import io

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.llm.common import State, partitions, planes, slices, unplanes
from seqloom.llm.text import mix, words

#: Bytes of text in a block; documents are counted and scored block by block.
BLOCK = 8 << 20
#: Hashes of the end of a text and of the place before its first word.
_END, _START = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def ngrams(texts: list, order: int):
    """Tokens of all texts, an end after each: bounds (texts + 1), and for k = 1..order the keys of the k-grams that end
    at each token. A key is a 62-bit hash and k - 1; where a k-gram would reach over the start of the text it is 0."""
    hashes, at = words(texts)
    n = len(texts)
    bounds = at + np.arange(n + 1)
    tokens = np.full(bounds[-1], _END, dtype=np.uint64)
    place = np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(at))
    tokens[place] = hashes
    first = np.repeat(bounds[:-1], np.diff(bounds))
    depth = np.arange(len(tokens)) - first  # words before, in the text
    keys, run = [], mix(tokens + np.uint64(1))
    keys.append((run & ~np.uint64(3)))
    back = tokens
    for k in range(2, order + 1):
        # The token k - 1 places before; the start counts as one.
        back = np.concatenate((tokens[:0], np.full(min(k - 1, len(tokens)), _START), tokens[: max(0, len(tokens) - k + 1)]))
        back = np.where(depth == k - 2, _START, back)
        run = mix(run * np.uint64(0xD6E8FEB86659FD93) + back)
        keys.append(np.where(depth >= k - 2, (run & ~np.uint64(3)) | np.uint64(k - 1), np.uint64(0)))
    return bounds, keys


class BackoffAutomaton:
    """States are the contexts of fewer than `order` words that were seen; each has an arc for every word seen after it
    and a failure arc to its longest proper suffix, down to the empty context, which has an arc for every word.

    With c counts and P' the probability one state down, an arc weighs (c(context word) + prior * P') / (c(context) +
    prior), a failure arc prior / (c(context) + prior), so each state's probabilities sum to one and failing is exact.
    The empty context gives (c + 0.5) / (N + 0.5 * (V + 1)).

    An n-gram has one number: as a state, and as the arc of its last word. START is the state before a text, EMPTY the
    empty context; `fail` holds failure arcs, `arc` and `back` the log10 weights of arcs and failure arcs.
    """

    def __init__(self, keys, counts, spots: list, first, total: int, distinct: int, order: int, prior: float):
        """keys: sorted distinct n-grams of some texts, counts: theirs in the corpus; spots: for n = 1..order the number
        of the n-gram that ends at each token, -1 if it would reach over the start; first: tokens that begin a text."""
        n, self.order, self.spots, self.first = len(keys), order, spots, first
        self.START, self.EMPTY = n, n + 1
        end = mix(np.array([_END + np.uint64(1)], np.uint64)) & ~np.uint64(3)
        at = int(np.searchsorted(keys, end[0]))
        texts = float(counts[at]) if at < n and keys[at] == end[0] else 0.0
        self.counts = np.concatenate((counts.astype(np.float64), [texts, 0.0]))
        self.fail = np.full(n + 2, self.EMPTY, dtype=np.int32)
        context = np.full(n, self.EMPTY, dtype=np.int32)
        for k in range(1, order):
            here = spots[k] >= 0
            self.fail[spots[k][here]] = spots[k - 1][here]
            before = np.concatenate(([self.START], spots[k - 1][:-1])).astype(np.int32)
            if k == 1:
                before[first] = self.START
            context[spots[k][here]] = before[here]
        chance = np.zeros(n + 1)
        for k in range(order):
            own = np.flatnonzero((keys & np.uint64(3)) == np.uint64(k))
            if k == 0:
                chance[own] = (self.counts[own] + 0.5) / (total + 0.5 * (distinct + 1))
            else:
                chance[own] = (self.counts[own] + prior * chance[self.fail[own]]) / (self.counts[context[own]] + prior)
        self.arc = np.log10(chance[:n])
        self.back = np.log10(prior / (self.counts + prior))

    def states(self) -> np.ndarray:
        """The state before each token: the longest context seen of the words read so far in its text."""
        after = np.full(len(self.spots[0]), self.EMPTY, dtype=np.int32)
        for spot in self.spots[: self.order - 1]:
            seen = (spot >= 0) & (self.counts[spot] > 0)
            after[seen] = spot[seen]
        before = np.concatenate(([self.EMPTY], after[:-1])).astype(np.int32)
        before[self.first] = self.START if self.order > 1 and self.counts[self.START] > 0 else self.EMPTY
        return before

    def traverse(self, bounds):
        """(known tokens, base and model log10 probability) of each text, read left to right.

        From the state before a token its arc is taken if it is there; if not, failure arcs are followed, adding their
        weights, until one is. All tokens take their steps together.
        """
        single = self.spots[0]
        weight, state, open_ = np.zeros(len(single)), self.states(), np.arange(len(single))
        for k in range(self.order - 1, 0, -1):
            # Those that stand in a state of k words (the start of a text counts as one).
            own, spot = state[open_], self.spots[k][open_]
            down = self.spots[k - 1][np.maximum(open_ - 1, 0)]
            deep = (own == np.where(self.first[open_], self.START, down) if k == 1 else (own == down) & ~self.first[open_]) & (own != self.EMPTY)
            taken = deep & (spot >= 0) & (self.counts[spot] > 0)
            weight[open_[taken]] += self.arc[spot[taken]]
            fails = deep & ~taken
            weight[open_[fails]] += self.back[own[fails]]
            state[open_[fails]] = self.fail[own[fails]]
            open_ = open_[~taken]
        base = self.arc[single]
        weight[open_] += base[open_]
        add = lambda x: np.add.reduceat(x, bounds[:-1]) if len(x) else np.empty(0)
        return add((self.counts[single] > 0).astype(np.int64)), add(base), add(weight)


def _asked(bounds, keys, learned):
    """Sorted distinct keys of a block and their counts in texts that are learned from."""
    every = np.concatenate(keys)
    found = np.unique(every)
    found = found[np.searchsorted(found, 1) :]  # 0 is no key
    used = np.repeat(learned, np.diff(bounds))
    own, n = np.unique(np.concatenate([k[used] for k in keys]), return_counts=True)
    counts = np.zeros(len(found), dtype=np.uint32)
    real = own != 0
    counts[np.searchsorted(found, own[real])] = n[real]
    return found, counts


def _numbered(keys):
    """Sorted distinct keys of a block, and for each list of keys their numbers among these, -1 for no key."""
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    none = int(len(found) > 0 and found[0] == 0)
    numbers = inverse.astype(np.int32) - np.int32(none)
    return found[none:], np.split(numbers, len(keys))


def _read(raw: bytes):
    import pyarrow as pa

    block = pa.ipc.open_stream(raw).read_all()
    return block.column("doc_id").to_pylist(), np.array(block.column("held").to_pylist(), dtype=bool), block.column("text").to_pylist()


def _shards(keys, shards: int):
    """Ends of the slices of sorted keys that belong to shards 0..shards-1."""
    top = (keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    return np.searchsorted(top, np.arange(shards + 1, dtype=np.uint64))


def score(docs: DataFrame, order: int = 3, prior: float = 64.0, held: Column = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of whole texts.

    Learns from the rows that are not held out (held_out() of the id by default). Tokens are the lower-cased (A-Z)
    words between ASCII white space and one end. base_score is the unigram log10 probability, score that of the
    automaton of `order` words. Null texts are the end alone; null ids are learned from; repeated rows count each;
    other columns are not read; an empty table gives no rows.

    Documents are bound into blocks. A block sends its distinct n-grams with their counts to shards by hash, one bundle
    for each shard; a shard adds up the counts of all blocks and returns each block the totals of what it asked for,
    from which the block builds the part of the automaton that its texts can reach. So an n-gram moves once for each
    block it stands in, however frequent it is, and no task holds more than a block or a shard of the model, of which
    there are as many as the corpus needs. Blocks and totals are kept in the shared folder.
    """
    spark = docs.sparkSession
    held = held_out(F.col(key)) if held is None else held

    def bind(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        number, rows, size = TaskContext.get().partitionId() << 32, [], 0

        def block():
            nonlocal number, rows, size
            table = pa.Table.from_batches(rows)
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as out:
                out.write_table(table)
            done = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue()], pa.binary())], names=["block", "data"])
            number, rows, size = number + 1, [], 0
            return done

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            for i, j in slices(sizes, BLOCK // 8):
                rows.append(batch.slice(i, j - i))
                size += sum(sizes[i:j]) + (j - i)
                if size >= BLOCK:
                    yield block()
        if rows:
            yield block()

    def ask(batches):
        import pyarrow as pa

        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                _, out, texts = _read(data.as_py())
                found, counts = _asked(*ngrams(texts, order), ~out)
                cuts = _shards(found, shards).tolist()
                rows = [(s, a, b) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows), pa.int64()),
                        pa.array([planes(np.diff(found[a:b], prepend=np.uint64(0))) for _, a, b in rows], pa.binary()),
                        pa.array([planes(counts[a:b]) for _, a, b in rows], pa.binary()),
                    ],
                    names=["shard", "block", "keys", "counts"],
                )

    def add(bundles):
        import pyarrow as pa

        blocks = bundles.column("block").to_pylist()
        parts = [np.cumsum(unplanes(x.as_py(), np.uint64), dtype=np.uint64) for x in bundles.column("keys")]
        keys = np.concatenate(parts)
        counts = np.concatenate([unplanes(x.as_py(), np.uint32) for x in bundles.column("counts")])
        distinct, inverse = np.unique(keys, return_inverse=True)
        totals = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.uint64)
        single = totals[(distinct & np.uint64(3)) == 0]
        cuts = np.cumsum([0] + [len(p) for p in parts]).tolist()
        shard = bundles.column("shard")[0].as_py()
        answer = [planes(totals[inverse[a:b]]) for a, b in zip(cuts[:-1], cuts[1:])]
        n = len(blocks)
        # The last row holds the shard's tokens and distinct words.
        return pa.Table.from_arrays(
            [pa.array([*blocks, None], pa.int64()), pa.array([shard] * (n + 1), pa.int32()), pa.array([*answer, None], pa.binary()), pa.array([None] * n + [int(single.sum())], pa.int64()), pa.array([None] * n + [int((single > 0).sum())], pa.int64())],
            names=["block", "shard", "totals", "tokens", "distinct"],
        )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held"), F.col(text).cast("string").alias("text"))
    blocks = State(rows.mapInArrow(bind, "block long, data binary"), "blocks")
    # A shard gets about as many n-grams as two blocks ask for.
    shards = max(8, partitions(spark), -(-blocks.df.count() // 2))
    asked = blocks.df.mapInArrow(ask, "shard int, block long, keys binary, counts binary")
    answers = State(asked.groupBy("shard").applyInArrow(add, "block long, shard int, totals binary, tokens long, distinct long"), "totals")
    sums = answers.df.where("block is null").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    total, distinct = sums["n"], sums["v"]

    def judge(block, totals):
        import pyarrow as pa

        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        ids, out, texts = _read(block.column("data")[0].as_py())
        bounds, keys = ngrams(texts, order)
        found, spots = _numbered(keys)
        del keys
        by_shard = sorted(zip(totals.column("shard").to_pylist(), totals.column("totals").to_pylist()))
        counts = np.concatenate([unplanes(t, np.uint64) for _, t in by_shard])
        first = np.zeros(bounds[-1], dtype=bool)
        first[bounds[:-1]] = True
        automaton = BackoffAutomaton(found, counts, spots, first, total, distinct, order, prior)
        known, base, model = automaton.traverse(bounds)
        return pa.Table.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(out), pa.array(np.diff(bounds), pa.int64()), pa.array(known, pa.int64()), pa.array([total] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64())],
            names=names,
        )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.df.groupBy("block").cogroup(answers.df.where("block is not null").groupBy("block")).applyInArrow(judge, schema)
