"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Every word, and the shape of every word, has a fixed sparse random vector. The vector of a word is the sum of the
random vectors of the words around it, over all documents; words share ``BUCKETS`` rows by hash, so the table
has one size however large the corpus. A document is the mean of its words' vectors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm.work import fields, give_back, in_pieces, mapped, table

#: Rows and columns of the word table, neighbours taken on either side, nonzero entries of a random vector.
BUCKETS, DIMS, NEAR, ENTRIES = 16384, 48, 2, 4
#: Labelled documents that are fit on, at most; hidden units; passes.
SAMPLE, HIDDEN, EPOCHS = 8000, 24, 60

_RUN = re.compile(rb"(.)\1+")
_SHAPE = bytes(65 if 65 <= x <= 90 else 97 if 97 <= x <= 122 or x >= 128 else 48 if 48 <= x <= 57 else x for x in range(256))
_EXTRA = 4


def random_entries() -> tuple[np.ndarray, np.ndarray]:
    """The random vector of each bucket as its ``ENTRIES`` columns and their signs. The last row, of no word, is zero."""
    rng = np.random.default_rng(20)
    columns, signs = rng.integers(0, DIMS, (BUCKETS + 1, ENTRIES)), rng.choice(np.array([-1, 1]), (BUCKETS + 1, ENTRIES))
    signs[BUCKETS] = 0
    return columns, signs


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of word shapes, and how many words each text has. Shapes take the upper quarter."""
    from xxhash import xxh32_intdigest

    words, shapes, sizes = [], [], []
    for x in texts:
        own = x.split()
        words += own
        shapes += x.translate(_SHAPE).split()
        sizes.append(len(own))
    part = BUCKETS * 3 // 4
    known: dict[bytes, int] = {}
    for s in set(shapes):
        known[s] = part + xxh32_intdigest(_RUN.sub(rb"\1", s)) % (BUCKETS - part)
    a = np.fromiter(map(xxh32_intdigest, words), np.uint32, len(words)) % np.uint32(part)
    b = np.fromiter(map(known.__getitem__, shapes), np.int32, len(shapes))
    return a.astype(np.int32), b, np.array(sizes)


def _spaced(row: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``NEAR`` empty places before each text and after the last, so that no word has neighbours in another."""
    out = np.full(row.size + NEAR * (sizes.size + 1), BUCKETS, np.int32)
    out[np.arange(row.size) + NEAR * (1 + np.repeat(np.arange(sizes.size), sizes))] = row
    return out


def context_sums(texts: list[bytes], entries: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of each bucket the sum of the random vectors of the words around its words: a neighbouring pair counts both ways."""
    columns, signs = entries
    total = np.zeros((BUCKETS + 1) * DIMS, np.int64)
    *rows, sizes = buckets(texts)
    for row in rows:
        row = _spaced(row, sizes).astype(np.int64)
        for k in range(1, NEAR + 1):
            pairs, times = np.unique(row[:-k] * (BUCKETS + 1) + row[k:], return_counts=True)
            left, right = np.divmod(pairs, BUCKETS + 1)
            for mid, near in ((left, right), (right, left)):
                for e in range(ENTRIES):
                    np.add.at(total, mid * DIMS + columns[near, e], times * signs[near, e])
    total = total.reshape(-1, DIMS)
    total[BUCKETS] = 0  # what stands between texts is no word
    return total


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The word table from all documents: each task sums its own, Spark adds the tasks' sums bucket by bucket.

    What reaches the driver is the table, ``BUCKETS`` rows of ``DIMS`` integers, for any corpus."""

    def summed(batches):
        entries, total = random_entries(), np.zeros((BUCKETS + 1, DIMS), np.int64)
        for batch in batches:
            for part in in_pieces(batch):
                total += context_sums(part.column(0).to_pylist(), entries)
        give_back()
        used = np.flatnonzero(total[:BUCKETS].any(axis=1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(total[used, d]) for d in range(DIMS)]], names=["bucket", *[f"v{d}" for d in range(DIMS)]])

    parts = docs.select(F.col("text").cast("string").cast("binary").alias("text")).filter("text IS NOT NULL").mapInArrow(summed, "bucket int, " + ", ".join(f"v{d} long" for d in range(DIMS)))
    total = np.zeros((BUCKETS + 1, DIMS))
    for r in parts.groupBy("bucket").agg(*[F.sum(f"v{d}").alias(f"v{d}") for d in range(DIMS)]).collect():
        total[r[0]] = r[1:]
    return unit_rows(total)


def unit_rows(total: np.ndarray) -> np.ndarray:
    return total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Of each text the mean vectors of its words and of their shapes, how alike its words are, and how many and how various they are."""
    *rows, sizes = buckets(texts)
    out = np.zeros((len(texts), 2 * DIMS + _EXTRA))
    for k, row in enumerate(rows):
        # Distinct words only are looked up, each with how often it occurs.
        keys, times = np.unique(np.repeat(np.arange(sizes.size), sizes) * BUCKETS + row, return_counts=True)
        owner, used = np.divmod(keys, BUCKETS)
        bounds = np.searchsorted(owner, np.arange(sizes.size + 1))
        for i in np.flatnonzero(sizes):
            a, b = bounds[i], bounds[i + 1]
            mean = times[a:b] @ vectors[used[a:b]] / sizes[i]
            out[i, k * DIMS : (k + 1) * DIMS] = mean
            out[i, 2 * DIMS + k] = np.linalg.norm(mean)
            if not k:
                out[i, 2 * DIMS + 2 :] = np.log1p(sizes[i]), (b - a) / min(sizes[i], BUCKETS * 3 // 4)
    return out.astype(np.float32)


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, rounded so that they don't depend on which rows are computed together."""
        return np.round(1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -30, 30))), 9)


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss of four fifths of the rows; the temperature is the one of least loss on the rest."""
    rng = np.random.default_rng(7)
    order = rng.permutation(len(x))
    hold, own = (order[: len(x) // 5], order[len(x) // 5 :]) if len(x) >= 50 else (order, order)
    net = Network(x[own].mean(0), x[own].std(0) + 1e-3, rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32), rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32), 0.0)
    z = (x - net.mean) / net.scale
    state = [np.zeros_like(p) for p in (net.w1, net.b1, net.w2, np.float32(0))]
    second = [np.zeros_like(p) for p in state]
    step = 0
    for epoch in range(EPOCHS):
        rng.shuffle(own)
        for a in range(0, len(own), 64):
            i = own[a : a + 64]
            h = np.tanh(z[i] @ net.w1 + net.b1)
            g = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -30, 30))) - y[i]) / len(i)
            back = np.outer(g, net.w2) * (1 - h * h)
            grads = [z[i].T @ back + 1e-4 * net.w1, back.sum(0), h.T @ g + 1e-4 * net.w2, g.sum()]
            step += 1
            rate = 3e-3 * (1 - epoch / EPOCHS)
            for k, (name, grad) in enumerate(zip(("w1", "b1", "w2", "b2"), grads, strict=True)):
                state[k] = 0.9 * state[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                setattr(net, name, getattr(net, name) - rate * (state[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    out = net.logits(x[hold])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [np.mean(np.logaddexp(0, np.where(y[hold] == 1, -out, out) / t)) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _remainder(k: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(k))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, sample: int = SAMPLE) -> Network | None:
    """Fit on at most ``sample`` labelled documents outside the held-out fold, those of the least hashes of doc_id.

    A document with several labels counts with the least; labels other than 0 and 1 don't count. None without labels."""
    known = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(_remainder(3) != 1).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), "quality").collect()
    if not chosen:
        return None
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    few = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], fields(_id=kind, quality="int")))

    def make():
        def step(batch):
            return {"id": batch.column(0), "quality": batch.column(1), "x": [v.tobytes() for v in pooled(batch.column(2).to_pylist(), vectors)]}

        return step

    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")).join(few, F.col("doc_id") == F.col("_id")).select("_id", "quality", "text")
    # Of a doc_id of several texts one counts, the same on every run, so that the sample stays bounded.
    got = mapped(rows, make, fields(id=kind, quality="int", x="binary")).groupBy("id").agg(F.min(F.struct("x", "quality")).alias("row")).select("row.*").collect()
    got = sorted((bytes(r["x"]), r["quality"]) for r in got)
    return fit(np.stack([np.frombuffer(x, np.float32) for x, _ in got]), np.array([q for _, q in got])) if got else None


def score(docs: DataFrame, vectors: np.ndarray, net: Network | None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text is an input; a null text is empty, and an empty text is scored as one without words. Without
    anything learned the score is 0.5. A null doc_id is not held out. Repeated rows give equal rows, an empty
    table none.
    """

    def make():
        def step(batch):
            x = pooled(batch.column(1).to_pylist(), vectors)
            return {"doc_id": batch.column(0), "score": (net.predict(x) if net else np.full(len(x), 0.5)).astype(np.float64)}

        return step

    rows = mapped(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")), make, fields(doc_id=docs.schema["doc_id"].dataType, score="double"))
    return rows.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vectors = word_vectors(docs)
    return score(docs, vectors, train(docs, table(spark, sf_dir, "labels"), vectors))
