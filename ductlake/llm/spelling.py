"""Spelling variants: words one edit apart by dense prefix-suffix tiling, and the form that each word leads to.

Two words differ by one inserted, deleted or replaced code point exactly if their common prefix and common
suffix together reach the longer length minus one.  Words become padded matrices of code points, left- and
right-aligned, and blocks of them are compared tile by tile for both lengths at once.

Which words meet: the edit lies in some window of places, and outside a window near words are equal.  A word
goes to the windows of both halves, once as the shorter and once as the longer word of a pair, keyed by what
lies outside.  Words that share a key are one group; of a pair, only the group whose window holds the place
after the common prefix counts it, so each pair counts once.  A group beyond `GROUP` words or `GROUP_BYTES`
is not compared but dealt anew to the two halves of its window, down to windows of one place, where the
alphabet bounds the group (at most 90 + 90 * 90 words).  Groups emit a partial result a word (count, best
near word), never pairs.

Words are counted per task before the exchange.  Forms strictly gain occurrences (at least twofold), so the
way to the last form is a few pointer doublings.

Defined results: null and empty texts have no words; with a null doc_id no code point is deleted; repeated
rows count again; other columns are ignored; an empty table gives no rows; very long texts are read in
blocks, and a run is never cut.  Ties between near words of equal n go to the smallest in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductlake.llm.work import keep
from ductlake.session import spread

RUN = re.compile("[A-Za-zÀ-ÿ]+")
# Where a long text may be cut: after a code point that no run holds.
TEXT_BLOCK = 1 << 20
HELD_WORDS = 200_000
GROUP = 4096
GROUP_BYTES = 16 << 20
TILE_BYTES = 4 << 20
MODULUS = 97


def text_blocks(text: str):
    """The text in blocks of about `TEXT_BLOCK` code points that end where no run goes on."""
    at = 0
    while len(text) - at > TEXT_BLOCK:
        run = RUN.match(text, at + TEXT_BLOCK)
        end = run.end() if run else at + TEXT_BLOCK
        yield text[at:end]
        at = end
    yield text[at:]


def runs_of(text: str) -> Counter:
    """Occurrences of each run of a text, with only A-Z lower-cased."""
    found: Counter = Counter()
    for block in text_blocks(text):
        found.update(RUN.findall(block.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    return found


def written(doc_id: int | None, run: str, modulus: int = MODULUS) -> str:
    """The run as it counts: without one code point where the checksum of document and run asks for it."""
    if doc_id is None:
        return run
    h = zlib.crc32(run.encode(), zlib.crc32(b"%d:" % doc_id))
    if h % modulus:
        return run
    place = h % len(run)
    return run[:place] + run[place + 1 :]


def word_counts(documents: DataFrame, least_length: int = 5, least_n: int = 3, modulus: int = MODULUS) -> DataFrame:
    """word, n of the words of at least `least_length` code points and `least_n` occurrences overall."""

    def run(batches):
        held: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                start = None if doc_id is None else zlib.crc32(b"%d:" % doc_id)
                for found, n in runs_of(text.as_py() or "").items():
                    if len(found) >= least_length:
                        if start is not None and not zlib.crc32(found.encode(), start) % modulus:
                            found = written(doc_id, found, modulus)
                            if len(found) < least_length:
                                continue
                        held[found] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    counted = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def code_points(words: list[str], width: int, right: bool) -> np.ndarray:
    """A row of code points a word (all below 256), padded with zeros on the right, or on the left."""
    padded = [w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words]
    return np.frombuffer("".join(padded).encode("latin-1"), np.uint8).reshape(len(words), width)


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the equal start of each row of `a` with each row of `b`."""
    differ = a[:, None, :] != b[None, :, :]
    return np.where(differ.any(axis=2), differ.argmax(axis=2), a.shape[1])


class Group:
    """Near pairs of words of length L with words of length L and L + 1 whose first difference lies in places [low, high)."""

    def __init__(self, words: list[str], n: np.ndarray, length: int, low: int, high: int):
        order = sorted(range(len(words)), key=lambda i: (len(words[i]), words[i]))
        self.words, self.n = [words[i] for i in order], n[order]
        self.length, self.low, self.high = length, low, high
        self.short = sum(len(w) == length for w in self.words)
        width = length + 1
        self.left, self.right = code_points(self.words, width, False), code_points(self.words, width, True)
        self.lengths = np.array([len(w) for w in self.words])
        # The order of forms: most occurrences, then the smallest word.
        by_form = sorted(range(len(words)), key=lambda i: (-self.n[i], self.words[i]))
        self.rank = np.empty(len(words), np.int64)
        self.rank[by_form] = np.arange(len(words))
        self.by_form = by_form

    def tiles(self):
        """(row, column) numbers of near words, tile by tile, rows being the shorter or, of equal length, the smaller word."""
        step = max(1, min(256, int((TILE_BYTES / (self.length + 1)) ** 0.5)))
        for i in range(0, self.short, step):
            rows = slice(i, min(i + step, self.short))
            for j in range(i, len(self.words), step):
                columns = slice(j, min(j + step, len(self.words)))
                prefix = common(self.left[rows], self.left[columns])
                # Padding is equal padding: what is common ends with the shorter word.
                shorter = np.minimum(self.lengths[rows, None], self.lengths[None, columns])
                longer = np.maximum(self.lengths[rows, None], self.lengths[None, columns])
                prefix = np.minimum(prefix, shorter)
                suffix = np.minimum(common(self.right[rows, ::-1], self.right[columns, ::-1]), shorter)
                near = (prefix + suffix >= longer - 1) & (prefix >= self.low) & (prefix < self.high)
                near &= np.arange(rows.start, rows.stop)[:, None] < np.arange(columns.start, columns.stop)[None, :]
                a, b = np.nonzero(near)
                if len(a):
                    yield a + i, b + j

    def partials(self) -> tuple[list[str], list[int], list[str], list[int]]:
        """(word, near words, best near word, its n) of the words that have one."""
        count = np.zeros(len(self.words), np.int64)
        best = np.full(len(self.words), len(self.words), np.int64)
        for a, b in self.tiles():
            np.add.at(count, a, 1)
            np.add.at(count, b, 1)
            np.minimum.at(best, a, self.rank[b])
            np.minimum.at(best, b, self.rank[a])
        found = np.flatnonzero(count)
        forms = [self.by_form[r] for r in best[found]]
        return [self.words[i] for i in found], count[found].tolist(), [self.words[i] for i in forms], [int(self.n[i]) for i in forms]


PARTIAL_DDL = "word string, n_near long, near string, near_n long, length int, low int, high int"


def _groups(limit: int):
    """Over rows sorted by their group: partial results of each group; of a group beyond the bounds its members (near null)."""

    def run(batches):
        kinds = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("near", pa.string()), ("near_n", pa.int64()), ("length", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])
        key, words, n, passing = None, [], [], False
        out: list[list] = [[] for _ in kinds]

        def members(key, words, n):
            return [words, n, [None] * len(words), [None] * len(words), *([k] * len(words) for k in key[1:])]

        def add(columns):
            for held, new in zip(out, columns):
                held += new

        def close():
            if key is None or passing or len(words) < 2 or all(len(w) > key[1] for w in words):
                return
            found = Group(words, np.array(n, np.int64), *key[1:]).partials()
            add([*found, *([None] * len(found[0]) for _ in range(3))])

        def flush():
            batch = pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) for k, c in enumerate(out)], schema=kinds)
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for group, length, low, high, word, times in zip(*columns):
                this = (group, length, low, high)
                if this != key:
                    close()
                    key, words, n, passing = this, [], [], False
                words.append(word)
                n.append(times)
                over = high - low > 1 and (len(words) > limit or len(words) * (length + 1) > max(GROUP_BYTES, 2 * (length + 1)))
                if passing or over:
                    add(members(key, words, n))
                    words, n, passing = [], [], True
                if len(out[0]) > 50_000:
                    yield flush()
        close()
        yield flush()

    return run


def windows(words: DataFrame, middle: str, low: str, high: str) -> DataFrame:
    """group, length, low, high, word, n: a row for both halves of each row's window, keyed by what lies outside the half.

    `words` has word, n and length (of the shorter word of a pair); the window's ends and middle are SQL.
    """
    halves = F.expr(f"array(named_struct('low', {low}, 'high', {middle}), named_struct('low', {middle}, 'high', {high}))")
    each = words.select("word", "n", "length", F.explode(halves).alias("w")).select("word", "n", "length", "w.low", "w.high").where("low < high")
    outside = "xxhash64(length, low, high, substr(word, 1, low), right(word, greatest(length - high, 0)))"
    return each.select(F.expr(outside).alias("group"), "length", "low", "high", "word", "n")


def near_words(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """word, n_near, near, near_n: of each word of `words` (word, n) with a near one the count, and the best near word."""
    spark = words.sparkSession
    sized = words.select("word", "n", F.explode(F.expr("array(char_length(word), char_length(word) - 1)")).alias("length")).where("length > 0")
    members = windows(sized, "cast(length div 2 as int)", "0", "length + 1")
    partials, more = [], True
    while more:
        met = keep(members.repartition("group").sortWithinPartitions("group", "length", "low", "high").mapInArrow(_groups(limit), PARTIAL_DDL), "near-words")
        partials.append(met.where("near is not null").select("word", "n_near", "near", "near_n"))
        hot = met.where("near is null").select("word", F.col("n_near").alias("n"), "length", "low", "high")
        more = not hot.isEmpty()
        members = windows(hot, "cast((low + high) div 2 as int)", "low", "high")
    out = spark.createDataFrame([], "word string, n_near long, near string, near_n long")
    for part in partials:
        out = out.unionAll(part)
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b")).select(
        "word", "n_near", F.col("b.near").alias("near"), (-F.col("b.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for the rows of `forms` (word, form): the last word that forms lead to, by pointer doubling."""
    known = keep(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = keep(spread(known, "root").join(spread(ahead, "root"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def spelling_variants(documents: DataFrame, least_length: int = 5, least_n: int = 3, factor: int = 2, limit: int = GROUP) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word."""
    words = keep(word_counts(documents, least_length, least_n), "words")
    judged = keep(
        words.join(near_words(words, limit), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(F.col("near_n") >= factor * F.col("n"), F.struct(F.col("near").alias("form"), F.col("near_n").alias("form_n"))).alias("f"),
        ).select("word", "n", "n_near", "f.form", "f.form_n"), "variants")
    last = roots(judged.where("form is not null"))
    return judged.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
