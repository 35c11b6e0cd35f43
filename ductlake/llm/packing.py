"""Best-fit packing of documents into token sequences of bounded length.

Hierarchical residual packing: every partition packs its own pieces best-fit (largest first, each into
the fullest bin that still takes it) and emits bins that are nearly full.  Bins that are not become items
of the next round, which has fewer partitions, and so on up a tree until a round is small enough to be
the last.  A bin carries its pieces as packed bytes (a bin has at most `capacity` pieces, as each has a
token), so no round needs a join and no round holds more than bin rows.

Defined results: a null text is an empty one and gives one piece holding the end id; a null doc_id stays
null; repeated rows are packed one by one; other columns are ignored; an empty table gives no rows.
Ties between bins or pieces are broken by their order in the partition.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductlake.llm.tokens import encoder
from ductlake.llm.work import keep

PIECE = np.dtype([("doc", "<i8"), ("null", "u1"), ("piece", "<i4"), ("start", "<i8"), ("length", "<i4"), ("crc", "<u4")])
BINS = pa.schema([("fill", pa.int32()), ("pieces", pa.binary()), ("done", pa.bool_())])
BINS_DDL = "fill int, pieces binary, done boolean"
PLACED_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

# Pieces or bins that one call packs together; bounds the memory of a task, whatever its partition holds.
BLOCK_ITEMS = 200_000
BATCH_BINS = 20_000


def best_fit(weights: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of the items of each bin, in order of placing."""
    order = sorted(range(len(weights)), key=lambda i: -weights[i])
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by space left
    spaces = 0  # bit s is set if a bin with space s is open
    bins: list[list[int]] = []
    for i in order:
        weight = weights[i]
        fitting = spaces >> weight
        if fitting:
            space = weight + (fitting & -fitting).bit_length() - 1
            number = open_bins[space].pop()
            if not open_bins[space]:
                spaces ^= 1 << space
        else:
            space, number = capacity, len(bins)
            bins.append([])
        bins[number].append(i)
        if space > weight:
            open_bins[space - weight].append(number)
            spaces |= 1 << (space - weight)
    return bins


def cut(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: whole pieces of `capacity` ids after a first one that may be shorter."""
    first = n_ids if n_ids <= capacity else (n_ids % capacity or capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n_ids, capacity)]


def _packed(fills: list[int], blobs: list[bytes], capacity: int, slack: int) -> Iterator[pa.RecordBatch]:
    bins = best_fit(fills, capacity)
    for at in range(0, len(bins), BATCH_BINS):
        part = bins[at : at + BATCH_BINS]
        total = [sum(fills[i] for i in b) for b in part]
        yield pa.RecordBatch.from_arrays([
            pa.array(total, pa.int32()), pa.array([b"".join([blobs[i] for i in b]) for b in part], pa.binary()),
            pa.array([capacity - t <= slack for t in total], pa.bool_()),
        ], schema=BINS)


def _tokenize_and_pack(path: str, end_id: int, capacity: int, slack: int):
    def run(batches):
        ids_of, end = encoder(path).ids, int(end_id).to_bytes(4, "little")
        fills: list[int] = []
        blobs: list[bytes] = []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview(ids_of(text.as_py()) + end)
                for number, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    fills.append(length)
                    blobs.append(np.array([(doc or 0, doc is None, number, start, length, crc)], PIECE).tobytes())
                if len(fills) >= BLOCK_ITEMS:
                    yield from _packed(fills, blobs, capacity, slack)
                    fills, blobs = [], []
        yield from _packed(fills, blobs, capacity, slack)

    return run


def _pack_bins(capacity: int, slack: int):
    def run(batches):
        fills: list[int] = []
        blobs: list[bytes] = []
        for batch in batches:
            fills += batch.column(0).to_pylist()
            blobs += batch.column(1).to_pylist()
            if len(fills) >= BLOCK_ITEMS:
                yield from _packed(fills, blobs, capacity, slack)
                fills, blobs = [], []
        yield from _packed(fills, blobs, capacity, slack)

    return run


def _placed(batches):
    for batch in batches:
        blobs = batch.column(1).to_pylist()
        pieces = np.frombuffer(b"".join(blobs), PIECE)
        counts = np.array([len(b) // PIECE.itemsize for b in blobs], np.int64)
        ends = np.cumsum(pieces["length"].astype(np.int64))
        firsts = np.cumsum(counts) - counts
        base = np.repeat((ends - pieces["length"])[firsts], counts) if len(pieces) else ends
        yield pa.RecordBatch.from_arrays([
            pa.array(pieces["doc"], pa.int64(), mask=pieces["null"].astype(bool)), pa.array(pieces["piece"], pa.int32()),
            pa.array(pieces["start"], pa.int64()), pa.array(pieces["length"].astype(np.int64)),
            pa.array(pieces["crc"].astype(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), counts)),
            pa.array(ends - pieces["length"] - base),
        ], names=[c.split()[0] for c in PLACED_DDL.split(", ")])


def pack_documents(
    documents: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, slack: int = 8, fan_in: int = 8,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A bin with at most `slack` free tokens is emitted at once; the others meet in rounds of `fan_in`
    times fewer partitions, the last of which still has one partition per `BLOCK_ITEMS` bins.
    """
    bins = keep(
        documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(_tokenize_and_pack(tokenizer, end_id, capacity, slack), BINS_DDL), "packing",
    )
    partitions = max(1, documents.rdd.getNumPartitions())
    done = bins.where("done")
    while True:
        rest = bins.where("not done")
        least = math.ceil(rest.count() / BLOCK_ITEMS)
        if least == 0:
            break
        partitions = max(least, math.ceil(partitions / fan_in))
        bins = keep(rest.select("fill", "pieces").repartition(partitions).mapInArrow(_pack_bins(capacity, slack), BINS_DDL), "packing")
        if partitions == least:
            done = done.unionAll(bins)
            break
        done = done.unionAll(bins.where("done"))
    return done.select(F.monotonically_increasing_id().alias("sequence_id"), "pieces").mapInArrow(_placed, PLACED_DDL)


def token_ids(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id and the ids of each document with its end id."""

    def run(batches):
        ids_of, end = encoder(tokenizer).ids, int(end_id).to_bytes(4, "little")
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = np.frombuffer(ids_of(text.as_py()) + end, "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def packed_sequences(placed: DataFrame, documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """The sequences themselves: sequence_id and ids (at most `capacity`).  Needs distinct, non-null doc_ids."""
    return (
        placed.join(token_ids(documents, tokenizer, end_id), "doc_id")
        .groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", F.expr("slice(ids, cast(start as int) + 1, cast(length as int))").alias("ids")))).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"))
    )
