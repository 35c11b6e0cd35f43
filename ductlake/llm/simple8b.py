"""Token ids in files of Simple-8b words, written in ascending doc_id order and read back.

A file holds chunks, each followed by one line feed.  A chunk is little-endian: the letters `S8B1`; the
numbers of documents, ids, words and escapes as uint64; doc_ids as int64; one byte per document that is 1
for a null doc_id; lengths of documents as uint64; the first word of each block of 1024 ids as uint64; the
words as uint64; the escaped values as uint64.  A word holds a selector in its upper 4 bits and as many ids
as the selector says, the first in the lowest bits; the last word of a block may hold fewer.  Selector 0
is an escape: its payload is the position of the value among the escaped ones.

Files are written and read by Spark, so they may lie in any store it knows.  Defined results: a null text
is an empty one (one id, the end id); null doc_ids come first; rows with equal doc_ids lie side by side in
the order of their texts; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ductlake.llm.tokens import encoder
from ductlake.llm.work import keep, new_path

MAGIC = b"S8B1"
# Fixed values: (ids in a word, bits of each) by selector; selector 0 is the escape.
SELECTORS = [
    (1, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6),
    (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60),
]
BLOCK = 1024
CHUNK_IDS = 1 << 20
CHUNKS_PER_FILE = 16
DOCS_DDL = "file string, chunk int, row int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escaped values) of unsigned 64-bit values, all blocks at once."""
    values = values.astype(np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    width = np.frexp(values.astype(np.float64))[1].astype(np.int16)
    index = np.arange(n, dtype=np.int32)
    block_end = np.minimum((index // BLOCK + 1) * BLOCK, n).astype(np.int32)
    chosen = np.zeros(n, np.uint8)
    for selector in range(len(SELECTORS) - 1, 0, -1):
        count, bits = SELECTORS[selector]
        wide = np.flatnonzero(width > bits)
        if len(wide) == n:
            break
        nearest = np.append(wide, n).astype(np.int32)[np.searchsorted(wide, index)] if len(wide) < n // 8 else (
            np.minimum.accumulate(np.where(width > bits, index, n).astype(np.int32)[::-1])[::-1])
        chosen[nearest >= np.minimum(index + count, block_end)] = selector
    counts = np.array([c for c, _ in SELECTORS], np.int32)
    following = np.minimum(index + counts[chosen], block_end)
    at = np.arange(blocks, dtype=np.int32) * BLOCK
    number = np.arange(blocks)
    steps = []
    while len(at):
        steps.append((number, at))
        at = following[at]
        going = (at < n) & (at // BLOCK == number)
        at, number = at[going], number[going]
    block_of = np.concatenate([s[0] for s in steps])
    place = np.concatenate([s[1] for s in steps])
    order = np.lexsort((place, block_of))
    block_of, place = block_of[order], place[order]
    selector_of = chosen[place]
    words = selector_of.astype(np.uint64) << np.uint64(60)
    padded = np.append(values, np.zeros(240, np.uint64))
    for selector in range(2, len(SELECTORS)):
        count, bits = SELECTORS[selector]
        here = np.flatnonzero(selector_of == selector)
        if len(here):
            start, end = place[here], block_end[place[here]]
            for k in range(count):
                part = np.where(start + k < end, padded[start + k], np.uint64(0))
                words[here] |= part << np.uint64(k * bits)
    escaped = np.flatnonzero(selector_of == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, np.searchsorted(block_of, np.arange(blocks)).astype(np.uint64), values[place[escaped]]


def decode(words: np.ndarray, firsts: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The values again."""
    out = np.zeros(len(firsts) * BLOCK + 240, np.uint64)
    selector_of = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS], np.int64)[selector_of]
    before = np.cumsum(counts) - counts
    block_of = np.searchsorted(firsts, np.arange(len(words), dtype=np.uint64), side="right") - 1
    start = before - before[firsts.astype(np.int64)][block_of] + block_of * BLOCK if len(words) else before
    limit = (block_of + 1) * BLOCK
    for selector in np.unique(selector_of):
        count, bits = SELECTORS[selector]
        here = np.flatnonzero(selector_of == selector)
        if selector == 0:
            out[start[here]] = escapes[(words[here] & np.uint64((1 << 60) - 1)).astype(np.int64)]
        elif bits:
            mask = np.uint64((1 << bits) - 1)
            for k in range(count):
                inside = here[start[here] + k < limit[here]]
                out[start[inside] + k] = (words[inside] >> np.uint64(k * bits)) & mask
    return out[:n]


def chunk_bytes(doc_ids: list[int | None], lengths: list[int], values: np.ndarray) -> bytes:
    words, firsts, escapes = encode(values)
    u64 = "<u8"
    return b"".join([
        MAGIC, np.array([len(doc_ids), len(values), len(words), len(escapes)], u64).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        np.array(lengths, u64).tobytes(), firsts.astype(u64).tobytes(), words.astype(u64).tobytes(), escapes.astype(u64).tobytes(),
    ])


def chunks(content: bytes) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc_ids, lengths, values) of each chunk of a file."""
    at = 0

    def take(dtype: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, dtype, n, at)
        at += out.nbytes
        return out

    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no chunk begins at byte {at}")
        at += 4
        n_docs, n_ids, n_words, n_escapes = (int(x) for x in take("<u8", 4))
        doc_ids, null, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
        firsts, words, escapes = take("<u8", -(-n_ids // BLOCK)), take("<u8", n_words), take("<u8", n_escapes)
        at += 1  # the line feed
        yield [None if x else int(d) for d, x in zip(doc_ids, null)], lengths, decode(words, firsts, escapes, n_ids)


def _encoded(tokenizer: str, end_id: int):
    def run(batches):
        ids_of, end = encoder(tokenizer).ids, int(end_id).to_bytes(4, "little")

        def flush():
            content = chunk_bytes(docs, lengths, np.frombuffer(b"".join(blobs), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

        docs, lengths, blobs, held = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = ids_of(text.as_py()) + end
                if docs and held + len(ids) // 4 > CHUNK_IDS:
                    yield flush()
                    docs, lengths, blobs, held = [], [], [], 0
                docs.append(doc.as_py())
                lengths.append(len(ids) // 4)
                blobs.append(ids)
                held += len(ids) // 4
        if docs:
            yield flush()

    return run


def _read(batches):
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            at, rows = 0, {k: [] for k in DOCS_DDL.replace(",", "").split()[::2]}
            for number, (docs, lengths, values) in enumerate(chunks(content.as_py())):
                ids, begin = memoryview(values.astype("<u4").tobytes()), 0
                for row, (doc, length) in enumerate(zip(docs, lengths.tolist())):
                    crc = zlib.crc32(ids[4 * begin : 4 * (begin + length)])
                    for k, v in zip(rows, (path.as_py(), number, row, doc, at, length, crc)):
                        rows[k].append(v)
                    begin, at = begin + length, at + length
            kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))


def write_ids(documents: DataFrame, tokenizer: str, end_id: int, path: str) -> None:
    """Files of chunks under `path`; their names and the chunks in them are in ascending doc_id order."""
    (
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(_encoded(tokenizer, end_id), "content binary")
        .select(F.col("content").cast("string").alias("value"))  # the bytes as they are
        .write.option("maxRecordsPerFile", CHUNKS_PER_FILE).option("lineSep", "\n").text(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in the files: doc_id, start, n_tokens, ids_crc32.

    Starts within a file are known when it is decoded; the files' totals are summed up in order of their
    names, one row per file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    docs = keep(files.mapInArrow(_read, DOCS_DDL), "ids")
    order = [F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), F.regexp_extract("file", r"-c(\d+)", 1).cast("long")]
    totals = docs.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("file", (F.sum("n").over(Window.orderBy(*order)) - F.col("n")).alias("before"))
    return docs.join(before, "file").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def ids_by_files(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the ids of all documents and return what the files say."""
    spark = documents.sparkSession
    path = new_path(spark, "simple8b")
    write_ids(documents, tokenizer, end_id, path)
    return read_ids(spark, path)
