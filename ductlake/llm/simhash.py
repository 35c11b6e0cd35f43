"""Near-duplicates by SimHash fingerprints of word shingles, found through deletion variants.

Fingerprints of 64 bits within 3 bits of each other are linked.  A fingerprint is cut into two segments
of 32 bits: of 3 differing bits one segment holds at most one.  Each segment is indexed by its 32 variants
with one bit left out; two segments differ in at most one bit exactly if they share a variant.  Distinct
fingerprints are dealt by (segment, bit, rest); those that meet are verified by their whole distance.

Nothing emits all pairs of a group: fingerprints that meet under one variant give a spanning forest of
their links.  If more than `RUN` meet, they are cut again: the other segment becomes two parts of 16 bits
with one bit left out, which bounds a group by 2**17 distinct fingerprints whatever the corpus holds.

Defined results: texts without words, empty and null ones have fingerprint zero and are linked like any
other; fewer words than a shingle give one shingle of all; repeated rows get equal results; null doc_ids
count as larger than any other (a component of null doc_ids has a null id); other columns are ignored; very
long texts are read whole, in blocks cut at white space; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductlake.llm.components import connected_components
from ductlake.llm.work import keep, words
from ductlake.session import spread

SEED = 42
RUN = 4096
LINKS_DDL = "a long, b long, key long"
BIT_ROWS = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """A bit is 1 if set in over half of the XXH64 hashes of the shingles."""
    from xxhash import xxh64_intdigest

    ones, n = np.zeros(64, np.int64), 0
    held: list[bytes] = []
    first = True
    for block in words(text):
        held += block
        if len(held) < shingle:
            continue
        first = False
        grams = [b" ".join(g) for g in zip(*[held[k:] for k in range(shingle)])]
        held = held[len(held) - shingle + 1 :]
        hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
        n += len(hashes)
        for at in range(0, len(hashes), BIT_ROWS):
            bits = np.unpackbits(hashes[at : at + BIT_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    if first:
        return xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, the fingerprint as a signed long, and a hash of the text that tells rows with equal doc_ids apart."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints), batch.column(2)], names=["doc_id", "print", "text_hash"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash()).mapInArrow(run, "doc_id long, print long, text_hash long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash")


def forest(prints: np.ndarray, bits: int) -> tuple[list[int], list[int]]:
    """Links that connect all fingerprints within `bits` of each other, at most one less than there are."""
    rest = prints.view(np.uint64)
    a: list[int] = []
    b: list[int] = []
    while len(rest) > 1:
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            x = waiting.pop()
            near = np.bitwise_count(rest ^ x) <= bits
            if near.any():
                found = rest[near]
                rest = rest[~near]
                a += found.view(np.int64).tolist()
                b += [int(np.uint64(x).view(np.int64))] * len(found)
                waiting += list(found)
    return a, b


def _runs(n_keys: int, bits: int, run_limit: int | None):
    """Over rows sorted by their keys: links of each run; the members of a longer run than `run_limit` as they are."""

    def batch_of(a, b, key):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], names=["a", "b", "key"])

    def run(batches):
        held: list[np.ndarray] = []  # the run that the last batch ended in
        held_key, size, passing = None, 0, False

        def close():
            if passing or size < 2:
                return [], []
            return forest(np.concatenate(held), bits)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(k).to_numpy() for k in range(n_keys)]
            prints = batch.column(n_keys).to_numpy()
            changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            starts, ends = np.r_[0, changes], np.r_[changes, batch.num_rows]
            a, b, key = [], [], []
            # A run within the batch that holds one fingerprint has no link.
            todo = np.flatnonzero(ends - starts > 1)
            for i in sorted({0, *todo.tolist(), len(starts) - 1}):
                this, part = tuple(int(k[starts[i]]) for k in keys), prints[starts[i] : ends[i]]
                if this != held_key:
                    x, y = close()
                    a, b, key = a + x, b + y, key + [None] * len(x)
                    held_key, held, size, passing = this, [], 0, False
                size += len(part)
                if run_limit and size > run_limit:
                    hot = np.concatenate([*held, part]).tolist()
                    a, b, key = a + hot, b + hot, key + [this[0]] * len(hot)
                    held, passing = [], True
                else:
                    held.append(part)
            if a:
                yield batch_of(a, b, key)
        x, y = close()
        yield batch_of(x, y, [None] * len(x))

    return run


def near_links(prints: DataFrame, bits: int = 3, run_limit: int = RUN) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column `print`) within `bits` <= 3 of each other."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments hold at most one differing bit up to 3 bits")
    # (segment, bit) above, the segment without that bit below: 38 bits in all.
    variants = prints.select("print", F.expr("explode(sequence(0, 63)) as place")).select(
        F.expr("shiftleft(cast(place as long), 32) | (shiftrightunsigned(print, 32 * (place div 32)) & 4294967295L & ~shiftleft(1L, cast(place % 32 as int)))").alias("key"), "print")
    met = keep(variants.repartition("key").sortWithinPartitions("key", "print").mapInArrow(_runs(1, bits, run_limit), LINKS_DDL), "variants")
    # Again for the fingerprints of long runs: 16-bit parts of the segment that the key does not hold.
    hot = met.where("key is not null").select("key", F.col("a").alias("print"), F.expr("explode(sequence(0, 31)) as place")).select(
        "key", F.expr("""shiftleft(cast(place as long), 16) | (shiftrightunsigned(print, (case when shiftrightunsigned(key, 37) = 0 then 32 else 0 end) + 16 * (place div 16))
            & 65535L & ~shiftleft(1L, cast(place % 16 as int)))""").alias("part"), "print")
    again = hot.repartition("key", "part").sortWithinPartitions("key", "part", "print").mapInArrow(_runs(2, bits, None), LINKS_DDL)
    return met.where("key is null").unionAll(again).select("a", "b").distinct()


def near_duplicates(documents: DataFrame, bits: int = 3, shingle: int = 3, run_limit: int = RUN) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links); and text_hash, and component, a number for each."""
    prints = keep(fingerprints(documents, shingle), "fingerprints")
    distinct = keep(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "fingerprints")
    parts = connected_components(near_links(distinct.select("print"), bits, run_limit)).withColumnRenamed("node", "print")
    placed = distinct.join(parts, "print", "left").withColumn("component", F.coalesce("component", "print"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = keep(placed.join(spread(least, "component"), "component").select("print", "component", "component_id"), "fingerprints")
    return prints.join(spread(of_print, "print"), "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "text_hash", "component")


def first_of_groups(documents: DataFrame, bits: int = 3, shingle: int = 3) -> DataFrame:
    """One row of each component, its smallest doc_id, with all columns of `documents`."""
    judged = near_duplicates(documents, bits, shingle)
    staying = judged.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(
        F.min_by(F.struct("doc_id", "text_hash"), "text_hash").alias("s")).select(
        F.col("s.text_hash").alias("hash_"), F.coalesce("s.doc_id", F.lit(0)).alias("id_"), F.col("s.doc_id").isNull().alias("null_"))
    whole = documents.select(F.struct("*").alias("row_"), text_hash().alias("hash_"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id_"), F.col("doc_id").isNull().alias("null_"))
    keys = ["hash_", "id_", "null_"]
    # Repeated rows are equal in these keys, and one of them stays; the join has dealt the rows by the same keys.
    return whole.join(spread(staying, "hash_"), keys, "left_semi").dropDuplicates(keys).select("row_.*")
