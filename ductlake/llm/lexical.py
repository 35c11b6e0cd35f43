"""Ranked lexical search over all documents through bit-sliced Bloom signatures.

Documents lie in blocks of rows.  A document's terms, each once per level of its frequency (at least 1, 2,
4, ... occurrences), set bits of a Bloom filter; a block keeps its filters turned round, one bitmap over the
documents for each bit position (a slice).  For a query term the slices of its positions are joined by AND:
the bitmap holds every document with the term, and perhaps more.  The highest level met bounds the
frequency from above, so the sum of the terms' bitmaps, weighted by what a term can add at that bound, is an
upper bound of each document's score.  Documents are rescored exactly from the highest bound downwards until
the bound is below the score of the k-th best document met so far in the task; nothing else is left out.

Blocks hold documents of similar size (by doublings of their terms), so that the filters' width fits each,
and are bounded in rows and in bytes.  Texts never move: one pass counts (documents, terms, and the
documents that hold each query term), a second ranks and returns k rows an item and task, which meet in two
steps.  Items come in chunks of bounded size; each chunk passes over the documents.

Defined results: a term is a maximal run of 0-9, a-z and everything beyond ASCII, A-Z lower-cased; null and
empty texts have none and are not counted; each row is a document of its own, so repeated rows count and
rank each; null doc_ids rank last among equal scores; rows of one item_id are one item with all their
terms, a null item_id takes no part; other columns are ignored; empty tables give no rows; very long texts
are read in blocks, and a term is never cut.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ductlake.llm.work import byte_blocks, keep

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
CHUNK_ITEMS = 512
CHUNK_BYTES = 1 << 20
# A block's bounds: rows, and distinct terms with levels in all rows.
BLOCK_ROWS = 2048
BLOCK_TERMS = 400_000
# Cells of bounds held at once: query terms times rows.
CELLS = 4 << 20
# A filter has about 12 bits for each term and level; 4 positions make about one false hit in 300.
BITS = 12
PROBES = 4
HASHES = 500_000
HITS = "item_id long, doc_id long, score long"


def terms_of(text: str | None) -> Counter:
    found: Counter = Counter()
    for block in byte_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        found.update(TERM.findall(block))
    return found


def weight(n_documents: int, n_holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_documents + 2) / (2 * n_holding + 1)))


def length_part(n: int, n_documents: int, n_terms: int) -> int:
    return 100 - 90 + (90 * n * n_documents) // n_terms


class Hashes:
    """64-bit hashes of (term, level), remembered for frequent terms."""

    def __init__(self):
        from xxhash import xxh64_intdigest

        self.digest, self.known = xxh64_intdigest, {}

    def of(self, term: bytes, level: int) -> int:
        if level:
            return self.digest(term, 13 + level)
        h = self.known.get(term)
        if h is None:
            if len(self.known) > HASHES:
                self.known.clear()
            h = self.known[term] = self.digest(term, 13)
        return h


def positions(hashes: np.ndarray, width: int) -> np.ndarray:
    """`PROBES` bit positions (columns) of each hash in a filter of `width` bits."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    return (low[:, None] + high[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(width)


class Block:
    """Slices over some documents; `terms` are their exact counts."""

    def __init__(self, ids: list, terms: list[Counter], hashes: Hashes):
        self.ids, self.terms, self.hashes = ids, terms, hashes
        self.lengths = np.array([sum(t.values()) for t in terms], np.int64)
        found: list[int] = []
        rows: list[int] = []
        most, of = 0, hashes.of
        for row, counts in enumerate(terms):
            before = len(found)
            found += [of(t, 0) for t in counts]
            found += [of(t, level) for t, n in counts.items() if n > 1 for level in range(1, n.bit_length())]
            rows.append(len(found) - before)
            most = max(most, rows[-1])
        self.width = 64 * math.ceil(BITS * max(1, most) / 64)
        self.levels = max((n.bit_length() for counts in terms for n in counts.values()), default=1)
        owners = np.repeat(np.arange(len(terms), dtype=np.uint64), rows)
        at = positions(np.array(found, np.uint64), self.width).astype(np.int64)
        # Row by row of the filter: the documents' bits, eight to a byte.
        self.slices = np.zeros((self.width, (len(terms) + 7) // 8), np.uint8)
        bit = np.left_shift(1, owners & np.uint64(7)).astype(np.uint8)
        byte = (owners >> np.uint64(3)).astype(np.int64)
        for probe in range(PROBES):
            np.bitwise_or.at(self.slices, (at[:, probe], byte), bit)

    def holders(self, term: bytes, level: int) -> np.ndarray:
        """Bitmap of the documents that may hold the term at least 2**level times."""
        at = positions(np.array([self.hashes.of(term, level)], np.uint64), self.width)[0].astype(np.int64)
        return np.bitwise_and.reduce(self.slices[at], axis=0)


class Query:
    """Items over one list of terms with their weights, and the k best documents of each so far."""

    def __init__(self, items: list[tuple[int, list[bytes]]], weights: dict[bytes, int], n_documents: int, n_terms: int, k: int):
        self.terms = sorted({t for _, terms in items for t in terms if weights.get(t)})
        number = {t: i for i, t in enumerate(self.terms)}
        self.items = [(item, np.array([number[t] for t in terms if t in number], np.int64)) for item, terms in items]
        self.weights = np.array([weights[t] for t in self.terms], np.int64)
        self.n_documents, self.n_terms, self.k = n_documents, n_terms, k
        self.best: list[list[tuple]] = [[] for _ in items]
        self.rescored = self.met = 0

    def bounds(self, block: Block, parts: np.ndarray) -> np.ndarray:
        """What each query term (rows) can add at most to each document (columns)."""
        n = len(block.ids)
        adds = []
        for level in range(block.levels):
            times = np.minimum((1 << (level + 1)) - 1, block.lengths)
            adds.append((1_000_000_000 * times) // (1000 * times + 8 * parts))
        out = np.zeros((len(self.terms), n), np.int64)
        for row, term in enumerate(self.terms):
            bits = block.holders(term, 0)
            level = 0
            while bits.any():
                may = np.unpackbits(bits, count=n, bitorder="little").view(bool)
                np.copyto(out[row], adds[level], where=may)
                level += 1
                if level == block.levels:
                    break
                bits = bits & block.holders(term, level)
            out[row] *= self.weights[row]
        return out

    def rank(self, block: Block) -> None:
        parts = np.array([length_part(n, self.n_documents, self.n_terms) for n in block.lengths.tolist()], np.int64)
        bounds = self.bounds(block, parts)
        self.met += len(self.items) * len(block.ids)
        for (_, wanted), best in zip(self.items, self.best):
            if not len(wanted):
                continue
            above = bounds[wanted].sum(axis=0)
            least = best[0][0] if len(best) == self.k else 1
            rows = np.flatnonzero(above >= max(1, least))
            for row in rows[np.argsort(-above[rows], kind="stable")].tolist():
                # A document whose bound equals the k-th score may still win by its doc_id.
                if len(best) == self.k and above[row] < best[0][0]:
                    break
                self.rescored += 1
                score = self.exact(block.terms[row], wanted, int(parts[row]))
                if score > 0:
                    doc_id = block.ids[row]
                    entry = (score, doc_id is not None, -(doc_id or 0))
                    if len(best) < self.k:
                        heappush(best, entry)
                    elif entry > best[0]:
                        heappushpop(best, entry)

    def exact(self, counts: Counter, wanted: np.ndarray, part: int) -> int:
        score = 0
        for i in wanted.tolist():
            tf = counts.get(self.terms[i])
            if tf:
                score += int(self.weights[i]) * ((1_000_000_000 * tf) // (1000 * tf + 8 * part))
        return score

    def hits(self) -> pa.RecordBatch:
        rows = [(item, -less if some else None, score) for (item, _), best in zip(self.items, self.best) for score, some, less in best]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["item_id", "doc_id", "score"])


def _count(vocabulary: frozenset):
    """Documents with a term, their terms, and the documents that hold each query term, of one task."""

    def run(batches):
        holding: Counter = Counter()
        n_documents = n_terms = 0
        for batch in batches:
            for text in batch.column(0):
                found = terms_of(text.as_py())
                if found:
                    n_documents += 1
                    n_terms += found.total()
                    holding.update(vocabulary & found.keys())
        rows = [(None, n_documents, n_terms), *((t, n, 0) for t, n in holding.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["term", "documents", "terms"])

    return run


def _rank(items: list, weights: dict, n_documents: int, n_terms: int, k: int):
    def run(batches):
        query, hashes = Query(items, weights, n_documents, n_terms, k), Hashes()
        most = max(64, min(BLOCK_ROWS, CELLS // max(1, len(query.terms))))
        waiting: dict[int, tuple[list, list]] = {}
        sizes: Counter = Counter()

        def close(size):
            ids, terms = waiting.pop(size)
            sizes.pop(size)
            query.rank(Block(ids, terms, hashes))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = terms_of(text.as_py())
                if not found:
                    continue
                size = len(found).bit_length()
                ids, terms = waiting.setdefault(size, ([], []))
                ids.append(doc_id)
                terms.append(found)
                sizes[size] += len(found)
                if len(ids) >= most or sizes[size] > BLOCK_TERMS:
                    close(size)
                elif sizes.total() > 4 * BLOCK_TERMS:
                    close(sizes.most_common(1)[0][0])
        for size in list(waiting):
            close(size)
        yield query.hits()

    return run


def _best(hits: DataFrame, k: int, *keys) -> DataFrame:
    order = Window.partitionBy("item_id", *keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search_chunk(documents: DataFrame, items: list[tuple[int, list[bytes]]], k: int) -> DataFrame | None:
    """The k best documents of each item; items are on the driver, bounded by the caller."""
    vocabulary = frozenset(t for _, terms in items for t in terms)
    counted = documents.select("text").mapInArrow(_count(vocabulary), "term binary, documents long, terms long").groupBy("term").agg(F.sum("documents").alias("documents"), F.sum("terms").alias("terms"))
    # At most one row a query term of the chunk, and one of totals.
    rows = counted.collect()
    total = next((r for r in rows if r.term is None), None)
    if total is None or not total.documents:
        return None
    weights = {bytes(r.term): weight(total.documents, r.documents) for r in rows if r.term is not None}
    ranked = documents.mapInArrow(_rank(items, weights, total.documents, total.terms, k), HITS)
    parted = _best(ranked.withColumn("part", F.spark_partition_id() % 64), k, "part").drop("rank", "part")
    return _best(parted, k).select("item_id", "rank", "doc_id", "score")


def lexical_search(documents: DataFrame, queries: DataFrame, k: int = 10, chunk_items: int = CHUNK_ITEMS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents (doc_id, text) for each item (item_id, text) of `queries`."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    terms = "array_distinct(filter(split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+'), x -> x <> ''))"
    items = queries.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null").select("item_id", F.expr(terms).alias("terms"))
    items = keep(items.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where("size(terms) > 0"), "items")
    sizes = items.agg(F.count("*").alias("n"), F.sum(F.expr("aggregate(terms, 0L, (s, x) -> s + octet_length(x))")).alias("size")).first()
    chunks = max(1, math.ceil(sizes.n / chunk_items), math.ceil((sizes.size or 0) / chunk_bytes))
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for chunk in range(chunks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == chunk).collect()
        if part:
            hits = search_chunk(texts, [(r.item_id, [t.encode() for t in r.terms]) for r in part], k)
            if hits is not None:
                found = found.unionAll(hits if chunks == 1 else keep(hits, "hits"))
    return found
