"""Nearest neighbours by inner product through a hash-prefix forest.

Inner products become angles: rows are scaled by the largest norm and get one more component that makes them
unit vectors, queries get a zero there, so the largest inner product is the smallest angle whatever the norms.
A tree gives each row a string of `BITS` bits, one a random hyperplane, and keeps them as a sorted array.
`trees` such arrays are the forest; it covers the whole table and lies in shards of about `SHARD` rows, each
with its part of every array, all under the same hyperplanes.

First a query descends in all arrays to its longest common prefixes and the trees ascend together, one bit at
a time, until `FIRST` times k rows are met in each shard.  The k-th best of all shards bounds the angle of the
k nearest, and with it the prefix length at which a row of that angle is met in some tree with the
probability `recall`.  Then all trees ascend to that length at once, in all shards; every row that shares so
long a prefix in any tree is scored.  Clustered vectors stay deep down; vectors without structure ascend far.
`recall` 1 ascends to the root, where every row is met: the exact answer.

Matrix products find the rows that can be among the k best, within the bound of their rounding; these are
scored again one by one in double precision, so that equal vectors get equal scores wherever they lie.  Of
more than k + 1 equal vectors only the k + 1 smallest ids can ever be an answer, and only these are indexed.
A task holds one shard and one batch of queries; a row lies in one shard, a query goes to each.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; vectors
meet only those of equal dimension; a null vec_id takes no part; of rows with one vec_id the smallest vector
(component by component) counts, so repeated rows count once; ties go to the smaller vec_id; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ductlake.llm.work import keep
from ductlake.session import spread

SHARD = 32768
BITS = 64
TREES = 32
RECALL = 0.95
FIRST = 4
# Scores of a shard that are held at once, and the part of a shard from which a query takes a matrix product.
SCORES = 2 << 20
MANY = 0.05
HITS = "query_id long, vec_id long, score double"


def hyperplanes(dimension: int, trees: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, trees * BITS)).astype(np.float32)


def hash_strings(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """One string of bits per tree (rows) and vector (columns), the first bit the highest."""
    out = np.zeros((planes.shape[1] // BITS, len(vectors)), np.uint64)
    weights = np.uint64(1) << np.arange(BITS - 1, -1, -1, dtype=np.uint64)
    for at in range(0, len(vectors), 4096):
        sides = vectors[at : at + 4096].astype(np.float32) @ planes > 0
        for tree in range(len(out)):
            out[tree, at : at + 4096] = sides[:, tree * BITS : (tree + 1) * BITS] @ weights
    return out


def prefix_length(angle: float, trees: int, recall: float) -> int:
    """The longest prefix that a row at `angle` shares in some of the trees with the probability `recall`."""
    each = 1 - (1 - recall) ** (1 / trees)
    alike = 1 - angle / math.pi
    if each >= 1 or alike <= 0:
        return 0
    return BITS if alike >= 1 else min(BITS, int(math.log(each) / math.log(alike)))


def best_rows(wide: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, k: int) -> tuple:
    """(ids, scores) of the k best of some rows; a row's score does not depend on where it lies."""
    scores = (wide[rows] * query).sum(axis=1)
    if len(rows) > k:
        least = np.partition(scores, len(rows) - k)[len(rows) - k]
        rows, scores = rows[scores >= least], scores[scores >= least]
    best = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows][best], scores[best]


class Shard:
    """Some rows with their part of the forest; `norm` is the largest of the whole table."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, norm: float, k: int, trees: int):
        self.wide, self.ids, self.norm, self.k, self.trees = vectors, ids, norm, k, trees
        scaled = vectors / norm
        rest = np.sqrt(np.maximum(0, 1 - (scaled * scaled).sum(axis=1)))
        self.planes = hyperplanes(vectors.shape[1] + 1, trees)
        strings = hash_strings(np.column_stack([scaled, rest]), self.planes)
        self.orders = np.argsort(strings, axis=1, kind="stable").astype(np.int32)
        self.arrays = np.take_along_axis(strings, self.orders, axis=1)
        self.largest = np.linalg.norm(vectors, axis=1).max()

    def under(self, asked: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end in each tree (rows) of the strings that share a prefix of the given length with each query (columns)."""
        free = np.array([(1 << (BITS - n)) - 1 for n in lengths.tolist()], np.uint64)
        low = np.array([np.searchsorted(array, own & ~free, "left") for array, own in zip(self.arrays, asked)])
        high = np.array([np.searchsorted(array, own | free, "right") for array, own in zip(self.arrays, asked)])
        return low, high

    def first_lengths(self, asked: np.ndarray) -> np.ndarray:
        """The longest prefix of each query under which the trees together hold `FIRST` times k rows, by ascending together."""
        wanted = min(len(self.ids), FIRST * self.k)
        lengths, open_ = np.zeros(asked.shape[1], np.int64), np.arange(asked.shape[1])
        for length in range(BITS, 0, -1):
            low, high = self.under(asked[:, open_], np.full(len(open_), length))
            # Every tree may meet the same rows, so the tree that meets most counts.
            enough = (high - low).max(axis=0) >= wanted
            lengths[open_[enough]] = length
            open_ = open_[~enough]
            if not len(open_):
                break
        return lengths

    def search(self, queries: np.ndarray, query_ids: np.ndarray, lengths: np.ndarray | None) -> Iterator[tuple]:
        """(query, ids, scores): the k best rows under the prefix length of each query, or under the first ones."""
        # Numbers of very different size: only the direction of a query matters for its strings.
        directions = queries / np.abs(queries).max(axis=1, keepdims=True)
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        asked = hash_strings(np.column_stack([directions, np.zeros(len(queries))]), self.planes)
        if lengths is None:
            lengths = self.first_lengths(asked)
        low, high = self.under(asked, lengths)
        slack = 4 * self.wide.shape[1] * np.finfo(float).eps * np.linalg.norm(queries, axis=1) * self.largest
        many = (high - low).sum(axis=0) > MANY * len(self.ids)
        step = max(1, SCORES // len(self.ids))
        for at in range(0, len(queries), step):
            block = np.arange(at, min(at + step, len(queries)))
            dense = block[many[block]]
            rough = dict(zip(dense.tolist(), queries[dense] @ self.wide.T)) if len(dense) else {}
            for q in block.tolist():
                parts = [order[a:b] for order, a, b in zip(self.orders, low[:, q], high[:, q]) if a < b]
                if not parts:
                    continue
                found = np.zeros(len(self.ids), bool)
                for part in parts:
                    found[part] = True
                rows = np.flatnonzero(found)
                rows = rows[self.ids[rows] != query_ids[q]]
                if q in rough and len(rows) > self.k:
                    scores = rough[q][rows]
                    rows = rows[scores >= np.partition(scores, len(rows) - self.k)[len(rows) - self.k] - slack[q]]
                if len(rows):
                    yield int(query_ids[q]), *best_rows(self.wide, self.ids, rows, queries[q], self.k)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _search(norm: float, k: int, trees: int):
    """Over rows sorted by (dimension, shard, kind): first the rows of a shard, then its queries."""

    def run(batches):
        key, held, shard = None, [], None
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in (0, 1, 2)]
            changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in keys])) + 1
            starts = [0, *changes.tolist()] if batch.num_rows else []
            for start, end in zip(starts, [*starts[1:], batch.num_rows]):
                dimension, number, kind = (int(c[start]) for c in keys)
                if (dimension, number) != key:
                    key, held, shard = (dimension, number), [], None
                part = batch.slice(start, end - start)
                vectors, ids = _matrix(part.column(4)), part.column(3).to_numpy()
                if kind == 0:
                    held.append((vectors, ids))
                    continue
                if shard is None and held:
                    shard = Shard(np.concatenate([v for v, _ in held]), np.concatenate([i for _, i in held]), norm, k, trees)
                    held = []
                if shard is None:
                    continue
                lengths = part.column(5).to_numpy(zero_copy_only=False)
                first = np.isnan(lengths.astype(float)).any()
                out_q, out_i, out_s = [], [], []
                for query, found, scores in shard.search(vectors, ids, None if first else lengths.astype(np.int64)):
                    out_q += [query] * len(found)
                    out_i += found.tolist()
                    out_s += scores.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_i, pa.int64()), pa.array(out_s, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vector, dimension of the rows that take part, one for each id."""
    return vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
        "id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x <> 0)"
    ).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dimension", F.size("vector"))


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)


def nearest(
    vectors: DataFrame, query_filter: str, k: int = 20, trees: int = TREES, recall: float = RECALL, vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score for the rows of `vectors` that fulfil `query_filter` (over `id`).

    `recall` is the probability with which each of the k nearest is met at least; 1 gives the exact answer.
    """
    rows = keep(usable(vectors, vec_id, vector), "vectors")
    largest = F.array_max(F.transform("vector", F.abs))
    norm = largest * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / largest) * (x / largest)))
    total = rows.agg(F.count("*").alias("n"), F.max(norm).alias("norm")).first()
    shards, most = max(1, math.ceil(total.n / SHARD)), min(total.norm or 1.0, 1e300)
    same = Window.partitionBy("dimension", "vector").orderBy("id")
    indexed = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    dealt = keep(indexed.select("dimension", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "vector", F.lit(None).cast("int").alias("length")), "shards")
    queries = rows.where(query_filter)

    def ask(queries: DataFrame) -> DataFrame:
        asked = queries.select("dimension", F.explode(F.expr(f"sequence(0, {shards - 1})")).alias("shard"), F.lit(1).alias("kind"), "id", "vector", "length")
        met = dealt.unionAll(asked).repartition("dimension", "shard").sortWithinPartitions("dimension", "shard", "kind", "id")
        return met.mapInArrow(_search(most, k, trees), HITS)

    first = keep(_ranked(ask(queries.withColumn("length", F.lit(None).cast("int"))), k).drop("rank"), "first")
    if recall >= 1:
        deep = F.lit(0)
    else:
        # As prefix_length(); the k-th best score found bounds the angle, fewer than k found bound nothing.
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least") / (norm * most))))
        each = math.log(1 - (1 - recall) ** (1 / trees))
        deep = F.when(F.col("found") < k, 0).when(angle >= math.pi, 0).when(angle <= 0, BITS).otherwise(
            F.least(F.lit(BITS), F.floor(F.lit(each) / F.log1p(-angle / math.pi))))
    kth = first.groupBy("query_id").agg(F.count("*").alias("found"), F.min("score").alias("least"))
    known = queries.join(spread(kth, "query_id"), F.col("id") == F.col("query_id"), "left").withColumn("length", F.coalesce(deep, F.lit(0)).cast("int"))
    hits = ask(known).unionAll(first).distinct()
    return _ranked(hits, k).select("query_id", "rank", "vec_id", "score")
