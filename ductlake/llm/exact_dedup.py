"""Exact deduplication of whole texts by Grace hashing.

Each task first reduces what it reads: equal texts of a block become one representative with a count and
its best row, so that a group of copies crosses the network once per block and not once per row.
Representatives are dealt by a hash of their content.  A task that gets them writes what exceeds its
memory to spill files, split by further bits of the hash, again and again until each bucket fits an
open-addressing table, and compares complete contents there.  Rows then get their group through the
number of their representative.  Spill files are the task's own and go when it ends.

Defined results: a null text equals an empty one; of equal texts the row with the largest doc_id stays, of
repeated rows with that doc_id exactly one; null doc_ids count as smallest; other columns are ignored; very long
texts are compared whole, one at a time in memory; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ductlake.llm.work import keep

TABLE_BYTES = 96 << 20
BLOCK_BYTES = 32 << 20
FAN_OUT_BITS = 4
LEAST = -(1 << 63)
ROWS = pa.schema([
    ("rep", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("best", pa.bool_()),
    ("content", pa.binary()), ("n", pa.int64()), ("largest", pa.int64()),
])
ROWS_DDL = "rep long, doc_id long, digest binary, best boolean, content binary, n long, largest long"
GROUPS = pa.schema([("rep", pa.int64()), ("keep_rep", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])
GROUPS_DDL = "rep long, keep_rep long, keep_id long, group_size long"


class Table:
    """Open addressing with linear probing over complete contents; a group holds its representatives."""

    def __init__(self):
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.groups: list[list] = []

    def group(self, key: int, content: bytes) -> list:
        mask = len(self.slots) - 1
        at = key & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == key and self.contents[entry] == content:
                return self.groups[entry]
            at = (at + 1) & mask
        self.slots[at] = len(self.groups)
        self.hashes.append(key)
        self.contents.append(content)
        self.groups.append([])
        if 2 * len(self.groups) > len(self.slots):
            self._grow()
        return self.groups[-1]

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, key in enumerate(self.hashes):
            at = key & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _key(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little")


def _local(block_bytes: int):
    """Rows with the number of their representative; the content goes with the first of equal ones only."""

    def run(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        rows, held, table = [], 0, Table()

        def flush():
            best, size = {}, {}
            for i, (rep, doc, *_) in enumerate(rows):
                size[rep] = size.get(rep, 0) + 1
                if rep not in best or doc > rows[best[rep]][1]:
                    best[rep] = i
            seen = set()
            columns = [[] for _ in ROWS]
            for i, (rep, doc, digest, content) in enumerate(rows):
                first = rep not in seen
                seen.add(rep)
                values = (rep, None if doc == LEAST else doc, digest, best[rep] == i, content if first else None,
                          size[rep] if first else None, rows[best[rep]][1] if first else None)
                for c, v in zip(columns, values):
                    c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, ROWS)], schema=ROWS)

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                content = (text.as_py() or "").encode("utf-8", "surrogatepass")
                digest = hashlib.sha256(content).digest()
                group = table.group(_key(digest), content)
                if not group:
                    group += [number, content]
                    number, held = number + 1, held + len(content)
                rows.append((group[0], LEAST if doc.as_py() is None else doc.as_py(), digest, group[1]))
                if held > block_bytes or len(rows) >= 50_000:
                    yield flush()
                    rows, held, table = [], 0, Table()
        if rows:
            yield flush()

    return run


def _write_record(file, digest: bytes, rep: int, n: int, largest: int, content: bytes) -> None:
    file.write(digest + b"".join(x.to_bytes(8, "little", signed=True) for x in (rep, n, largest, len(content))) + content)


def _read_records(path: Path) -> Iterator[tuple]:
    with path.open("rb") as file:
        while head := file.read(64):
            rep, n, largest, length = (int.from_bytes(head[k : k + 8], "little", signed=True) for k in (32, 40, 48, 56))
            yield head[:32], rep, n, largest, file.read(length)


def grace(records: Iterator[tuple], folder: Path, table_bytes: int) -> Iterator[list]:
    """Groups of (rep, n, largest) with equal contents."""
    for _, group in grace_groups(records, folder, table_bytes):
        yield group


def grace_groups(records: Iterator[tuple], folder: Path, table_bytes: int, bit: int = 64) -> Iterator[tuple[bytes, list]]:
    """(content, group) of records (digest, rep, n, largest, content) with equal contents.

    Records fill a table; once its contents exceed `table_bytes`, new contents go to spill files by the
    next bits of their hash (the lowest ones place them in the table), and each file is taken in turn.
    """
    table, held, spills = Table(), 0, {}
    for record in records:
        digest, rep, n, largest, content = record
        key = _key(digest)
        if not spills or bit <= FAN_OUT_BITS:
            group = table.group(key, content)
            held += 0 if group else len(content) + 200
            group.append((rep, n, largest))
            if held <= table_bytes or bit <= FAN_OUT_BITS:
                continue
            # Too large: the whole table goes to the files, so that equal contents meet again in one.
            spills = {k: (folder / f"{bit}-{k}").open("wb") for k in range(1 << FAN_OUT_BITS)}
            for k, c, g in zip(table.hashes, table.contents, table.groups):
                for member in g:
                    _write_record(spills[(k >> (bit - FAN_OUT_BITS)) & ((1 << FAN_OUT_BITS) - 1)], k.to_bytes(8, "little") + bytes(24), *member, c)
            table = Table()
        else:
            _write_record(spills[(key >> (bit - FAN_OUT_BITS)) & ((1 << FAN_OUT_BITS) - 1)], digest, rep, n, largest, content)
    yield from zip(table.contents, table.groups)
    for k, file in spills.items():
        file.close()
        inner = folder / f"{bit}-{k}.d"
        inner.mkdir()
        yield from grace_groups(_read_records(Path(file.name)), inner, table_bytes, bit - FAN_OUT_BITS)
        Path(file.name).unlink()
        inner.rmdir()


def _resolved(table_bytes: int):
    def run(batches):
        def records():
            for batch in batches:
                for row in zip(*(batch.column(k) for k in range(5))):
                    yield tuple(x.as_py() for x in row)

        with tempfile.TemporaryDirectory() as folder:
            columns = [[] for _ in GROUPS]
            for group in grace(records(), Path(folder), table_bytes):
                largest = max(x[2] for x in group)
                winner = min(x[0] for x in group if x[2] == largest)
                size = sum(x[1] for x in group)
                for rep, _, _ in group:
                    for c, v in zip(columns, (rep, winner, None if largest == LEAST else largest, size)):
                        c.append(v)
                if len(columns[0]) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=GROUPS)
                    columns = [[] for _ in GROUPS]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=GROUPS)

    return run


def exact_duplicates(documents: DataFrame, table_bytes: int = TABLE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = keep(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_local(block_bytes), ROWS_DDL), "texts")
    reps = rows.where("content is not null").select("digest", "rep", "n", "largest", "content")
    groups = reps.repartition("digest").mapInArrow(_resolved(table_bytes), GROUPS_DDL)
    return rows.select("rep", "doc_id", "digest", "best").join(groups, "rep").select(
        "doc_id", "keep_id", "group_size", (F.col("best") & (F.col("rep") == F.col("keep_rep"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def _best_rows(block_bytes: int, doc: int, text: int):
    """Of equal texts of a block the row with the largest doc_id, its other values packed beside the content."""

    def run(batches):
        table, rows, held = Table(), [], 0

        def flush():
            kept = list(zip(table.groups, table.contents, table.hashes))
            columns = [[h.to_bytes(8, "little") + bytes(24) for _, _, h in kept], [g[0] for g, _, _ in kept], [pickle.dumps(g[1]) for g, _, _ in kept], [c for _, c, _ in kept]]
            kinds = [pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "largest", "payload", "content"])

        for batch in batches:
            for row in zip(*batch.columns):
                values = [v.as_py() for v in row]
                content = (values[text] or "").encode("utf-8", "surrogatepass")
                values[text] = values[text] is None
                number = LEAST if values[doc] is None else int(values[doc])
                group = table.group(_key(hashlib.sha256(content).digest()), content)
                if not group:
                    group += [number, values]
                    held += len(content)
                elif number > group[0]:
                    group[:] = [number, values]
                if held > block_bytes or len(table.groups) >= 50_000:
                    yield flush()
                    table, held = Table(), 0
        if table.groups:
            yield flush()

    return run


def _winners(table_bytes: int, text: int, schema: pa.Schema):
    def run(batches):
        def records():
            for batch in batches:
                for digest, largest, payload, content in zip(*batch.columns):
                    # The packed values go with the content; equal contents may have different ones.
                    yield digest.as_py(), largest.as_py(), payload.as_py(), content.as_py()

        with tempfile.TemporaryDirectory() as folder:
            rows, held = [], 0
            for content, values in grace_best(records(), Path(folder), table_bytes):
                values[text] = None if values[text] else content.decode("utf-8", "surrogatepass")
                rows.append(values)
                held += len(content)
                if held > BLOCK_BYTES or len(rows) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def grace_best(records: Iterator[tuple], folder: Path, table_bytes: int) -> Iterator[tuple[bytes, list]]:
    """(content, values) of the best record (digest, largest, payload, content) of each group, by `grace`.

    Payloads wait in a file of their own, so that the tables hold contents and numbers only.
    """
    with (folder / "payloads").open("w+b") as file:

        def numbered():
            for digest, largest, payload, content in records:
                at = file.seek(0, 2)
                file.write(len(payload).to_bytes(8, "little") + payload)
                yield digest, at, 1, largest, content

        for content, group in grace_groups(numbered(), folder, table_bytes):
            at = max(group, key=lambda x: (x[2], -x[0]))[0]
            file.seek(at)
            yield content, pickle.loads(file.read(int.from_bytes(file.read(8), "little")))


def first_of_equal(documents: DataFrame, table_bytes: int = TABLE_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row of each group of equal texts, the one that stays, with all columns of `documents`.

    Texts cross the network once; no row has to be looked up again.
    """
    doc, text = documents.columns.index("doc_id"), documents.columns.index("text")
    reps = documents.mapInArrow(_best_rows(block_bytes, doc, text), "digest binary, largest long, payload binary, content binary")
    schema = to_arrow_schema(documents.schema)
    return reps.repartition("digest").mapInArrow(_winners(table_bytes, text, schema), documents.schema)
