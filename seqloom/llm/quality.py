"""Quality classifier of documents: supervised subword embeddings trained by stochastic gradient descent."""

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from seqloom.llm.common import State, slices
from seqloom.llm.text import STEP, _hash_words

#: Buckets of hashed features and length of their vectors.
BUCKETS, DIM = 1 << 18, 16
#: Bounds of the training sample: labelled rows, and characters of their texts.
TRAIN_ROWS, TRAIN_CHARS = 4000, 20_000_000


def features(raw: bytes) -> np.ndarray:
    """Buckets of the words, of pairs of equal words and of the 3- and 4-byte grams of a text, as it is written.

    Pairs of one word twice share a bucket, whatever the word: they tell of repetition.
    """
    data = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    three = data[:-2] | data[1:-1] << np.uint32(8) | data[2:] << np.uint32(16) if len(data) > 2 else np.empty(0, np.uint32)
    four = three[:-1] | data[3:] << np.uint32(24)
    hashes, _, _ = _hash_words(raw)
    twice = np.full(int((hashes[1:] == hashes[:-1]).sum()), 0, dtype=np.uint32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    return np.concatenate((
        twice,
        (three * np.uint32(2654435761)) >> shift,
        (four * np.uint32(2246822519) ^ four >> np.uint32(15)) * np.uint32(3266489917) >> shift,
        (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.uint32),
    ))


def _parts(raw: bytes):
    """A text in steps of bounded size, cut at white space."""
    at = 0
    while at < len(raw):
        cut = min(len(raw), at + STEP)
        while cut < len(raw) and raw[cut] not in b" \t\n\v\f\r":
            cut += 1
        yield raw[at:cut]
        at = cut


def bag(text) -> tuple:
    """(distinct buckets, counts) of a whole text."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    for part in _parts((text or "").encode("utf-8", "surrogatepass")):
        total += np.bincount(features(part), minlength=BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


def fit(bags: list, labels: list, epochs: int = 6, rate: float = 0.5, seed: int = 3) -> tuple:
    """(difference of the two class logits for each bucket, bias) of a softmax over averaged bucket vectors.

    Each document is a step: its vector is the average of its features' vectors, and the gradient of the log loss moves
    these and the two output rows. Steps are scaled by the squared length of the average's weights, so that a long
    document moves its logits as much as a short one.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    ones = sum(labels)
    if not 0 < ones < len(labels):
        return np.zeros(BUCKETS), float(np.log((ones + 1) / (len(labels) - ones + 1)))
    output, bias = rng.uniform(-0.5, 0.5, (2, DIM)).astype(np.float32), np.zeros(2, dtype=np.float32)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)).tolist():
            at, count = bags[k]
            pace = rate * (1 - done / steps)
            done += 1
            weight = count / max(count.sum(), 1.0)
            hidden = weight @ vectors[at] if len(at) else np.zeros(DIM, np.float32)
            logit = output @ hidden + bias
            p = np.exp(logit - logit.max())
            error = p / p.sum()
            error[labels[k]] -= 1
            down = error @ output
            output -= pace * np.outer(error, hidden) * 4
            bias -= np.float32(0.05 * pace) * error
            if len(at):
                vectors[at] -= np.outer(weight, down * np.float32(pace / max(float(weight @ weight), 1e-6)))
    return (vectors @ (output[1] - output[0])).astype(np.float64), float(bias[1] - bias[0])


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple:
    """Fit on at most `rows` labelled rows that are not held out and at most `chars` characters of their whole texts.

    Rows are taken in the order of a hash of their id, so the sample is the same at every run; where the characters do
    not suffice, texts of over an eighth of them come last and only those that do not fit are left out. Labels that are neither
    0 nor 1 and null ids are left out; of repeated labels the smaller counts, of documents with one id the text of the
    least hash. The sample's feature counts go to one
    task, which trains the model: both bounds hold there. Without rows of both labels the score is their share.
    """
    order = F.xxhash64(F.col(key), F.lit(11))
    chosen = labels.where(F.col("quality").isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).cast("long").alias("id")).agg(F.min("quality").cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(rows)
    # At most `rows` rows are broadcast.
    sample = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    # Of documents with one id the text of the least hash trains, wherever it lies.
    sample = sample.groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("id", F.col("t.text").alias("text"), "y")
    state = State(sample.withColumn("n", F.coalesce(F.length("text"), F.lit(0))), "sample")
    # At most `rows` rows; a text that does not fit leaves the room to the next, and long ones come after all others.
    sizes, left, fitting = state.df.select("id", "y", "n").orderBy(F.col("n") > chars // 8, F.xxhash64("id", F.lit(11)), "id").collect(), chars, []
    for row in sizes:
        if row["n"] <= left:
            left -= row["n"]
            fitting.append(row)
    if {row["y"] for row in fitting} != {row["y"] for row in sizes}:
        warnings.warn(f"no labelled text of one class fits {chars} characters; the score is the share of the other", stacklevel=2)
    fits = docs.sparkSession.createDataFrame([(row["id"],) for row in fitting], "id long")

    def bags_of(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                at, count = bag(batch.column("text")[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column("id")[i : i + 1], batch.column("y")[i : i + 1], pa.array([at], pa.list_(pa.int32())), pa.array([count], pa.list_(pa.float32()))], names=["id", "y", "at", "count"])

    def model_of(batches):
        import pyarrow as pa

        rows = []
        for batch in batches:
            at, count = batch.column("at"), batch.column("count")
            rows += [(batch.column("id")[i].as_py(), batch.column("y")[i].as_py(), at[i].values.to_numpy(), count[i].values.to_numpy()) for i in range(batch.num_rows)]
        rows.sort(key=lambda r: r[0])
        weights, bias = fit([r[2:] for r in rows], [r[1] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([bias])], names=["weights", "bias"])

    bags = state.df.join(F.broadcast(fits), "id").mapInArrow(bags_of, "id long, y int, at array<int>, count array<float>")
    model = bags.repartition(1).mapInArrow(model_of, "weights binary, bias double").collect()
    state.drop()
    return (np.frombuffer(model[0]["weights"], np.float64), model[0]["bias"]) if model else (np.zeros(BUCKETS), 0.0)


def score(docs: DataFrame, model: tuple, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the probability of label 1. Reads the text alone; a null text is empty; no shuffle.

    The softmax of an average is a function of the average of one number a bucket, so only these are broadcast
    (BUCKETS of them, whatever the data).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts):
        import pandas as pd

        weights, bias = shared.value
        found = []
        for t in texts:
            total, n = 0.0, 0
            for part in _parts((t or "").encode("utf-8", "surrogatepass")):
                at = features(part)
                total += float(weights[at].sum())
                n += len(at)
            found.append(total / max(n, 1) + bias)
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(found, dtype=float), -500, 500))))

    return docs.withColumn(out, probability(F.col(text).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with held_out, score and predicted (1 if the score is 0.5 or more), fitted on labels.

    Every row and column stays but for columns of these three names, which are replaced.
    """
    scored = score(docs, train(docs, labels, text, key), text)
    return scored.withColumn("held_out", held_out(F.col(key))).withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
