"""Language-model scores by prediction by partial matching over bytes, beside a word-count base.

Texts are lower-cased (A-Z) words with one space between them and a line feed as the end.  The model is a
trie of byte contexts up to `ORDER` letters, trained on all training documents: Spark counts every run of
ORDER + 1 bytes, and each level of shorter runs follows from the next longer one by summing.  A byte is
coded in its longest known context; a byte that is new there costs an escape (method D: each different
byte seen there gives half a count to the escape), and in the next shorter context the bytes of the longer
one are excluded, down to equal chances for what is left.  A document's score is the log10 probability of
its bytes.

The trie is a table per level and covers all training documents; nothing of it is cut.  Tasks hold the
code lengths of the most frequent longest runs, at most `NODES` (the threshold comes from a histogram of
the counts).  Every other run of a document, rare or never seen, meets the levels by joins: a run that
escapes to a shorter context needs the count of the shorter run and two numbers of the longer context,
namely how many occurrences and how many different bytes exclusion leaves in the shorter one.  The result
does not depend on `NODES`.

The base needs the count of each word.  Words so frequent that at most `FREQUENT` can be are broadcast;
all others meet their counts by a join, so that no key of that join is large.

Defined results: null texts count as empty (one token, the end); without training documents every byte
costs log10(256) and the base is 0; repeated rows get equal scores; a null doc_id is in the training part
unless the given condition is true for it; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductlake.llm.work import keep, words

ORDER = 5
NODES = 2_000_000
FREQUENT = 400_000
END = b"\n"
BUFFER = 1 << 20
WORDS_HELD = 400_000
COUNTS = pa.schema([("word", pa.binary()), ("run", pa.int64()), ("n", pa.int64())])
COUNTS_DDL = "word binary, run long, n long"
PARTS = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base", pa.float64()), ("score", pa.float64()), ("word", pa.binary()), ("run", pa.int64()), ("n", pa.int64()),
])
PARTS_DDL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, run long, n long"


def runs_of(text: np.ndarray) -> np.ndarray:
    """The run of ORDER + 1 bytes that ends at each byte after the first ORDER ones, as numbers."""
    n = len(text) - ORDER
    out = np.zeros(max(0, n), np.uint64)
    for k in range(ORDER + 1 if n > 0 else 0):
        out = (out << np.uint64(8)) | text[k : k + n].astype(np.uint64)
    return out


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)


def _counted(batches):
    """Counts of words and of byte runs of the texts in a partition."""
    seen: Counter = Counter()
    kept_runs, kept_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    buffer: list[bytes] = []
    held = 0

    def add_runs():
        nonlocal kept_runs, kept_counts, buffer, held
        # Texts stand one after another; an end is ORDER line feeds, so that every text begins alike.
        runs = runs_of(np.frombuffer(END * ORDER + b"".join(buffer), np.uint8))
        between = np.cumsum([len(b) for b in buffer]) if buffer else np.zeros(0, int)
        real = np.ones(len(runs), bool)
        for k in range(ORDER - 1):
            real[between - 1 - k] = False
        new, counts = np.unique(runs[real], return_counts=True)
        both, place = np.unique(np.concatenate([kept_runs, new]), return_inverse=True)
        kept_counts = np.bincount(place, np.concatenate([kept_counts, counts]), len(both)).astype(np.int64)
        kept_runs, buffer, held = both, [], 0

    def word_batches():
        items = list(seen.items())
        for at in range(0, len(items), 100_000):
            part = items[at : at + 100_000]
            yield _batch([[w for w, _ in part], [None] * len(part), [n for _, n in part]], COUNTS)
        seen.clear()

    for batch in batches:
        for text in batch.column(0):
            seen[END] += 1
            parts = []
            for block in words(text.as_py()):
                seen.update(block)
                if block:
                    parts.append(b" ".join(block))
            buffer.append(b" ".join(parts) + END * ORDER)
            held += len(buffer[-1])
            if held >= BUFFER:
                add_runs()
            if len(kept_runs) >= 2 * NODES:
                yield _batch([[None] * len(kept_runs), kept_runs.view(np.int64), kept_counts], COUNTS)
                kept_runs, kept_counts = kept_runs[:0], kept_counts[:0]
            if len(seen) >= WORDS_HELD:
                yield from word_batches()
    if buffer:
        add_runs()
    yield _batch([[None] * len(kept_runs), kept_runs.view(np.int64), kept_counts], COUNTS)
    yield from word_batches()


class Slots:
    """Numbers by key in open addressing, filled and asked for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(10, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << self.bits, np.float64)
        at, todo = self.place(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[at] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[at[take]], self.values[at[take]] = keys[todo[take]], values[todo[take]]
            left = np.ones(len(todo), bool)
            left[take] = False
            todo, at = todo[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the positions of keys that are not there."""
        at = self.place(keys)
        there = self.keys[at]
        out = self.values[at]
        open_ = np.flatnonzero(there != keys)
        missing = []
        while len(open_):
            empty = self.keys[at[open_]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            missing.append(open_[empty])
            open_ = open_[~empty]
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[open_]] == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit]
        return out, np.concatenate(missing) if missing else np.zeros(0, np.int64)


_HELD: dict[int, Slots] = {}


def held_runs(shared) -> Slots:
    """The code lengths of a broadcast by run, put in place once per Python worker."""
    own = id(shared.value)
    if own not in _HELD:
        _HELD.clear()
        _HELD[own] = Slots(*shared.value[0])
    return _HELD[own]


def _scored(shared):
    def run(batches):
        slots, frequent = held_runs(shared), shared.value[1]
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 36
        columns = [[] for _ in PARTS]
        waiting: list[bytes] = []
        owners: list[int] = []
        held = 0

        def put(*values):
            for c, v in zip(columns, values):
                c.append(v)

        def settle():
            """Scores of the pieces of texts that wait: each but a text's first repeats ORDER bytes before it.

            Runs that are not held go on by document, run and number of times.
            """
            nonlocal waiting, owners, held
            if waiting:
                ends = np.cumsum([len(w) for w in waiting])
                starts = np.concatenate([[0], ends[:-1]]) + ORDER
                runs = runs_of(np.frombuffer(b"".join(waiting), np.uint8))
                values, missing = slots.get(runs)
                values[missing] = 0.0
                sums = np.concatenate([np.zeros(ORDER + 1), np.cumsum(values)])
                for i, value in zip(owners, sums[ends] - sums[starts]):
                    columns[6][i] += float(value)
                piece = np.searchsorted(ends, missing + ORDER, side="right")
                missing, piece = (x[missing + ORDER >= starts[piece]] for x in (missing, piece))
                owner, open_ = np.array(owners)[piece], runs[missing]
                order = np.lexsort((open_, owner))
                owner, open_ = owner[order], open_[order]
                first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (open_[1:] != open_[:-1])])) if len(owner) else owner
                for i, run, times in zip(owner[first].tolist(), open_[first].tolist(), np.diff(np.append(first, len(owner))).tolist()):
                    put(columns[0][i], None, None, None, None, None, None, None, run, times)
            waiting, owners, held = [], [], 0

        for batch in batches:
            for doc, held_out, text in zip(*(batch.column(k) for k in range(3))):
                n, known, base, tail = 1, 0, 0.0, END * ORDER
                place = len(columns[0])
                put(row, doc.as_py(), held_out.as_py(), 0, 0, 0.0, 0.0, None, None, None)
                first = True
                for block in words(text.as_py()):
                    if block:
                        piece = (b"" if first else b" ") + b" ".join(block)
                        waiting.append(tail + piece)
                        owners.append(place)
                        held += len(waiting[-1])
                        tail, first = (tail + piece)[-ORDER:], False
                        n += len(block)
                        for word, times in Counter(block).items():
                            value = frequent.get(word)
                            if value is None:
                                put(row, None, None, None, None, None, None, word, None, times)
                            else:
                                known, base = known + times, base + times * value
                waiting.append(tail + END)
                owners.append(place)
                end = frequent.get(END)
                if end is None:
                    put(row, None, None, None, None, None, None, END, None, 1)
                else:
                    known, base = known + 1, base + end
                columns[3][place], columns[4][place], columns[5][place] = n, known, base
                row += 1
                if held >= BUFFER or len(columns[0]) >= 200_000:
                    settle()
                if len(columns[0]) >= 200_000:
                    yield _batch(columns, PARTS)
                    columns = [[] for _ in PARTS]
        settle()
        yield _batch(columns, PARTS)

    return run


def _frequent_enough(runs: DataFrame, nodes: int) -> int:
    """The least power of two that leaves at most `nodes` runs."""
    by_size = {r["size"]: r["k"] for r in runs.groupBy(F.floor(F.log2("n")).cast("int").alias("size")).agg(F.count("*").alias("k")).collect()}
    size, left = 0, sum(by_size.values())
    while left > nodes:
        left -= by_size.get(size, 0)
        size += 1
    return 1 << size


def _low(column: str, n_bytes: int) -> Column:
    """The last bytes of a run."""
    return F.expr(f"{column} & {(1 << (8 * n_bytes)) - 1}L")


def _small(df: DataFrame, order: int) -> DataFrame:
    """Levels of at most 65,536 rows whatever the corpus holds are broadcast."""
    return F.broadcast(df) if order <= 1 else df


def levels(longest: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs (run, n) and contexts of each order.

    A context has the occurrences (total) and the different bytes (size) that follow it, and for the next
    shorter context what exclusion of its own bytes leaves there (left, fresh).  A run has at most 256
    longer ones, so no key of these joins is large.
    """
    runs = [longest]
    for order in range(ORDER - 1, -1, -1):
        runs.insert(0, keep(runs[0].groupBy(_low("run", order + 1).alias("run")).agg(F.sum("n").alias("n")), "runs"))
    contexts: list[DataFrame] = []
    for order, of_order in enumerate(runs):
        if order:
            shorter = runs[order - 1].select(F.col("run").alias("short"), F.col("n").alias("below"))
            of_order = of_order.join(shorter, _low("run", order) == F.col("short"))
        else:
            of_order = of_order.withColumn("below", F.lit(0).cast("long"))
        table = of_order.groupBy(F.expr("shiftrightunsigned(run, 8)").alias("context")).agg(
            F.sum("n").alias("total"), F.count("*").alias("size"), F.sum("below").alias("below"))
        if order:
            shorter = contexts[order - 1].select(F.col("context").alias("short"), F.col("total").alias("all"), F.col("size").alias("different"))
            table = table.join(shorter, _low("context", order - 1) == F.col("short")).select(
                "context", "total", "size", (F.col("all") - F.col("below")).alias("left"), (F.col("different") - F.col("size")).alias("fresh"))
        contexts.append(keep(table, "contexts"))
    return runs, contexts


def run_costs(asked: DataFrame, runs: list[DataFrame], contexts: list[DataFrame]) -> DataFrame:
    """run and cost, the log10 probability of its last byte after the others, of every row of `asked` (run)."""
    found = asked
    for order in range(ORDER, -1, -1):
        n = runs[order].select(F.col("run").alias(f"run_{order}"), F.col("n").alias(f"n_{order}"))
        found = found.join(_small(n, order), _low("run", order + 1) == F.col(f"run_{order}"), "left").drop(f"run_{order}")
        if order:
            numbers = contexts[order].select(*[F.col(c).alias(f"{c}_{order}") for c in contexts[order].columns])
            found = found.join(_small(numbers, order - 1), _low("shiftrightunsigned(run, 8)", order) == F.col(f"context_{order}"), "left").drop(f"context_{order}")
    root = contexts[0].first()
    found = found.withColumns({f"{c}_0": F.lit(root[c] if root else None).cast("long") for c in ("total", "size")})
    spent, cost = F.lit(0.0), None
    for order in range(ORDER, -1, -1):
        left, fresh = F.col(f"total_{order}"), F.col(f"size_{order}")
        if order < ORDER:
            longer = F.col(f"total_{order + 1}").isNotNull()
            left, fresh = F.when(longer, F.col(f"left_{order + 1}")).otherwise(left), F.when(longer, F.col(f"fresh_{order + 1}")).otherwise(fresh)
        known = F.col(f"n_{order}").isNotNull()
        here = spent + F.log10(F.try_divide(F.col(f"n_{order}") - 0.5, left))
        cost = F.when(known, here) if cost is None else cost.when(known, here)
        spent = spent + F.when(fresh > 0, F.log10(F.try_divide(0.5 * fresh, left))).otherwise(0.0)
    unseen = 256 - (root["size"] if root else 0)
    return found.select("run", cost.otherwise(spent - F.lit(math.log10(max(1, unseen)))).alias("cost"))


def fit(texts: DataFrame) -> tuple[list[DataFrame], list[DataFrame], DataFrame, int, int]:
    """Runs and contexts of each order, the word counts (word, c), the number of tokens and of distinct ones."""
    parts = keep(texts.select(F.col("text").cast("string")).mapInArrow(_counted, COUNTS_DDL), "counts")
    counts = keep(parts.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "counts")
    whole = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    longest = keep(parts.where("run is not null").groupBy("run").agg(F.sum("n").alias("n")), "runs")
    return *levels(longest), counts, int(whole["n"] or 0), int(whole["v"])


def lm_scores(documents: DataFrame, held_out: Column, nodes: int = NODES, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `documents`."""
    spark = documents.sparkSession
    marked = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    runs, contexts, counts, n, v = fit(marked.where("not held_out").select("text"))
    longest = runs[ORDER].where(F.col("n") >= _frequent_enough(runs[ORDER], nodes))
    held = longest.join(contexts[ORDER], F.expr("shiftrightunsigned(run, 8)") == F.col("context")).select(
        "run", F.log10((F.col("n") - 0.5) / F.col("total")).alias("cost")).toArrow()
    # At most `frequent` words have so large a share of all tokens.
    often = counts.where(F.col("c") >= max(1, math.ceil(n / frequent)))
    table = {bytes(r["word"]): math.log10(r["c"] + 1) for r in often.toLocalIterator()}
    shared = spark.sparkContext.broadcast(((held.column("run").to_numpy().astype(np.uint64), held.column("cost").to_numpy()), table))
    parts = keep(marked.mapInArrow(_scored(shared), PARTS_DDL), "scores")
    rare = counts.where(F.col("c") < max(1, math.ceil(n / frequent)))
    rest = parts.where("word is not null").select("row", "word", "n").join(rare, "word").groupBy("row").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_base"))
    asked = parts.where("run is not null").select("row", "run", "n")
    costs = keep(run_costs(keep(asked.select("run").distinct(), "asked"), runs, contexts), "costs")
    other = asked.join(costs, "run").groupBy("row").agg(F.sum(F.col("n") * F.col("cost")).alias("more_score"))
    each = math.log10(n + (v + 1))
    return parts.where("n is null").drop("word", "run", "n").join(rest, "row", "left").join(other, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(each)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
