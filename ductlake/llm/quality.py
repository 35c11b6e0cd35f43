"""Quality classifier: supervised subword embeddings.

Words, pairs of words and runs of 3 and 4 bytes of a text are hashed into buckets, each with a learned
vector; a document is the mean of its features' vectors, a softmax over two labels follows.  Training is
stochastic gradient descent in numpy on a bounded sample of labelled documents (`SAMPLE`).  For scoring, a
bucket's vector is multiplied with the output weights once, as the mean of products is the product of the
mean: a document's score is the mean of numbers looked up, the same as with vectors.

Two features are shapes and not strings: a word that repeats the one before it, and the end of the text,
which weighs more the shorter the text is.

Defined results: null texts count as empty; a text without a word scores 0; without labels of
both kinds every other score is 0.5; of several labels for a doc_id the smallest counts, and of several texts
for a labelled one the text of the smallest hash; repeated rows get equal scores; very long texts are read in
blocks cut at white space; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductlake.llm.work import byte_blocks

BITS = 18
BUCKETS = 1 << BITS
DIMENSION = 16
SAMPLE = 2000
EPOCHS = 4
RATE = 2.0
END, REPEAT = 0, 1
BLOCK = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, base, np.uint64))


BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
_TABLES: dict[int, tuple] = {}


def _bucket(h: np.ndarray) -> np.ndarray:
    """Buckets 2 and up; the first two are the shapes."""
    return 2 + ((h * ODD) >> np.uint64(64 - BITS)).astype(np.int64) % (BUCKETS - 2)


def block_features(block: bytes) -> list[np.ndarray]:
    """Buckets of the words, pairs, repeated words and byte runs of a block."""
    data = np.frombuffer(block, np.uint8)
    n = len(data)
    if not n:
        return []
    space = SPACES[data]
    wide = np.where(space, np.uint64(32), data.astype(np.uint64)) + np.uint64(1)
    if n not in _TABLES:
        _TABLES.clear()
        _TABLES[n] = (_powers(n, BASE), _powers(n, INVERSE))
    powers, inverses = _TABLES[n]
    out = []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(wide * powers)])
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if len(starts):
        word = (sums[ends] - sums[starts]) * inverses[starts]
        out.append(_bucket(word))
        if len(word) > 1:
            out.append(_bucket(word[:-1] * np.uint64(31) + word[1:]))
            out.append(np.full(np.count_nonzero(word[1:] == word[:-1]), REPEAT))
    for size, salt in ((3, 7), (4, 13)):
        if n >= size:
            gram = wide[: n - size + 1].copy()
            for k in range(1, size):
                gram = (gram << np.uint64(8)) ^ wide[k : n - size + 1 + k]
            out.append(_bucket(gram * np.uint64(2) + np.uint64(salt << 40)))
    return out


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text."""
    found = [np.array([END])]
    for block in byte_blocks((text or "").encode("utf-8", "surrogatepass"), BLOCK):
        parts = block_features(block)
        if parts:
            found.append(np.concatenate(parts))
    return np.unique(np.concatenate(found), return_counts=True)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 5) -> np.ndarray:
    """What each bucket adds to the log odds of label 1, by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIMENSION, 1 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    weights = np.zeros((2, DIMENSION), np.float32)
    labels = {label for _, _, label in samples}
    if len(labels) < 2:
        return np.zeros(BUCKETS, np.float32)
    share = {label: sum(s[2] == label for s in samples) / len(samples) for label in labels}
    steps, total = 0, epochs * len(samples)
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            buckets, counts, label = samples[i]
            now = rate * (1 - steps / total) * min(3.0, 0.5 / share[label])  # the rarer label weighs more
            steps += 1
            part = (counts / counts.sum()).astype(np.float32)
            own = vectors[buckets]
            mean = part @ own
            z = weights @ mean
            odds = np.exp(z - z.max())
            wrong = odds / odds.sum()
            wrong[label] -= 1
            back = wrong @ weights
            weights -= now * np.outer(wrong, mean)
            vectors[buckets] = own - now * part[:, None] * back * 20  # a mean moves each of many vectors little
    return vectors @ (weights[1] - weights[0])


def score(text: str | None, odds: np.ndarray) -> float:
    total, n, words = float(odds[END]), 1, bool((text or "").encode("utf-8", "surrogatepass").strip())
    for block in byte_blocks((text or "").encode("utf-8", "surrogatepass"), BLOCK):
        for part in block_features(block):
            total += float(odds[part].sum(dtype=np.float64))
            n += len(part)
    if not words:
        return 0.0
    return float(1 / (1 + np.exp(-np.clip(total / n, -30, 30))))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Train on at most `sample` labelled documents, chosen by a hash of doc_id."""
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), "label", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))

    def run(batches):
        for batch in batches:
            for doc, text, label, text_hash in zip(*(batch.column(k) for k in range(4))):
                buckets, counts = features(text.as_py())
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc.as_py()], pa.int64()), pa.array([text_hash.as_py()], pa.int64()), pa.array([buckets.astype("<i4").tobytes()], pa.binary()),
                    pa.array([counts.astype("<f4").tobytes()], pa.binary()), pa.array([label.as_py()], pa.int32())], names=["doc_id", "text_hash", "buckets", "counts", "label"])

    found = texts.mapInArrow(run, "doc_id long, text_hash long, buckets binary, counts binary, label int")
    # One text of each doc_id, so at most `sample` rows reach the driver.
    single = found.groupBy("doc_id").agg(F.min(F.struct("text_hash", "buckets", "counts", "label")).alias("r")).select("doc_id", "r.*")
    samples = sorted(((r.doc_id, r.buckets, r.counts, r.label) for r in single.toLocalIterator()), key=lambda r: r[0])
    return train([(np.frombuffer(b, "<i4"), np.frombuffer(c, "<f4"), label) for _, b, c, label in samples])


def quality_scores(documents: DataFrame, odds: np.ndarray) -> DataFrame:
    """doc_id and score of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(odds)

    def run(batches):
        for batch in batches:
            scores = [score(t.as_py(), shared.value) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
