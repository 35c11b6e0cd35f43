"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language holds all its substrings.  A document is parsed greedily
into the longest phrases that the automaton knows; the language whose automaton needs the fewest phrases,
each costing the logarithm of the sample's length, per letter wins.

Transitions are laid out as one table: state and letter give the next state and whether a phrase ended, so
that a task steps through many pieces of text at once.  Texts are parsed whole, in pieces of `LANE`
letters that each begin a phrase.  Letters are lower-cased; whatever lies between them is one space.

The sample is bounded by documented parameters (`ROWS` documents and `LETTERS` letters a language);
everything else reads all rows.  Every language has its own `LETTERS`, however many there are: tables are
built for as many languages at a time as `TABLE_BYTES` hold, one at least.  If they hold all, the tables are
built once and shared; else the samples are (two bytes a letter) and each task builds the tables of one group
after the other.

Defined results: null texts and texts without a letter give `und` and score 0; so do all texts if nothing is
labelled; ties go to the language first in alphabetical order; repeated rows get equal results; other
columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ductlake.llm.work import release

UNKNOWN = "und"
ROWS = 64
LETTERS = 24_000
TABLE_BYTES = 192 << 20
LANE = 2048
LANES = 1024
# Lanes that are held for one round over several groups of languages.
HELD_LANES = 16 * LANES
# Phrase counts (texts times languages) that are held at once.
COUNTS = 4 << 20
SLICE = 1 << 20
OWN_CLASSES = 200
CLASSES = 254
FLAG = np.int32(1 << 30)


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


@dataclass
class Tables:
    """Transitions of some languages."""

    width: int
    table: np.ndarray  # state * width + class: next state, with FLAG if a phrase ended
    roots: np.ndarray


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # by code point: 0 no letter, 1.. a letter
    width: int
    costs: np.ndarray  # of a phrase, by language
    samples: list[np.ndarray]  # classes of the letters, by language; none if `tables` holds all languages
    per_group: int  # languages whose tables are held at once
    tables: Tables | None = None

    def groups(self) -> Iterator[tuple[int, Tables]]:
        """The first language and the tables of each group of languages."""
        if self.tables is not None:
            yield 0, self.tables
            return
        for first in range(0, len(self.samples), self.per_group):
            yield first, transitions(self.samples[first : first + self.per_group], self.width)


def letter_counts(texts: Iterable[str]) -> Counter[str]:
    return Counter(c for t in texts for c in t.lower() if c.isalpha())


def letter_classes(counts: Counter[str]) -> tuple[np.ndarray, int]:
    """The most frequent letters have classes of their own, others share classes by their code point."""
    own = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    classes = np.zeros(0x110000, np.int16)
    points = np.array([p for p in range(0x110000) if chr(p).isalpha()])
    own, shared = (own, 1) if len(own) <= OWN_CLASSES else (own[:OWN_CLASSES], CLASSES - OWN_CLASSES)
    classes[points] = len(own) + 1 + points % shared
    for k, c in enumerate(own):
        classes[ord(c)] = k + 1
    return classes, len(own) + 1 + shared


def symbols_of(text: str, classes: np.ndarray) -> np.ndarray:
    """Classes of the letters, runs of anything else as one 0."""
    parts = []
    for at in range(0, len(text), SLICE):
        part = classes[np.frombuffer(text[at : at + SLICE].lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        parts.append(part)
    all_ = np.concatenate(parts) if parts else np.zeros(0, np.int16)
    apart = np.ones(len(all_), bool)
    apart[1:] = (all_[1:] != 0) | (all_[:-1] != 0)
    return all_[apart]


def transitions(samples: list[np.ndarray], width: int) -> Tables:
    tables, roots, base = [], [], 0
    for sample in samples:
        moves = suffix_automaton(sample.tolist())
        start = np.full(width, base, np.int32)
        for c, to in moves[0].items():
            start[c] = base + to
        table = np.tile(start | FLAG, (len(moves), 1))
        states = np.repeat(np.arange(len(moves)), [len(to) for to in moves])
        letters = np.fromiter(chain.from_iterable(moves), np.int32, len(states))
        table[states, letters] = np.fromiter(chain.from_iterable(to.values() for to in moves), np.int32, len(states)) + base
        table[:, width - 1] = np.arange(base, base + len(moves))
        tables.append(table)
        roots.append(base)
        base += len(moves)
    return Tables(width, np.concatenate(tables).ravel(), np.array(roots))


def train(samples: dict[str, list[str]], letters: int = LETTERS, table_bytes: int = TABLE_BYTES, counts: Counter[str] | None = None) -> Model | None:
    languages = sorted(samples)
    if not languages:
        return None
    classes, n_classes = letter_classes(letter_counts(t for texts in samples.values() for t in texts) if counts is None else counts)
    width = n_classes + 1  # the last one is padding
    chosen = []
    for language in languages:
        joined: list[int] = []
        for text in samples[language]:
            joined += symbols_of(text, classes)[: letters - len(joined)].tolist() + [0]
            if len(joined) >= letters:
                break
        chosen.append(np.array(joined, np.int16))
    costs = np.array([np.log2(max(2, len(sample))) for sample in chosen])
    # An automaton has at most two states a letter.
    per_group = max(1, table_bytes // (8 * width * max(map(len, chosen))))
    if len(languages) <= per_group:
        return Model(languages, classes, width, costs, [], per_group, transitions(chosen, width))
    return Model(languages, classes, width, costs, chosen, per_group)


def phrases(model: Model, lanes: list[np.ndarray]) -> np.ndarray:
    """Phrases that each language needs for each lane."""
    return np.concatenate([_phrases(tables, lanes) for _, tables in model.groups()])


def _phrases(model: Tables, lanes: list[np.ndarray]) -> np.ndarray:
    order = sorted(range(len(lanes)), key=lambda i: -len(lanes[i]))
    lengths = np.array([len(lanes[i]) for i in order])
    longest = int(lengths[0]) if len(lengths) else 0
    text = np.full((longest, len(lanes)), model.width - 1, np.int32)
    for column, i in enumerate(order):
        text[: len(lanes[i]), column] = lanes[i]
    state = np.repeat(model.roots[:, None], len(lanes), axis=1).astype(np.int32)
    count = np.zeros(state.shape, np.int32)
    active = len(lanes) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
    for at in range(longest):
        k = active[at]
        to = model.table[state[:, :k] * model.width + text[at, :k]]
        count[:, :k] += to >> 30
        state[:, :k] = to & (FLAG - 1)
    count += state != model.roots[:, None]
    out = np.zeros_like(count)
    out[:, order] = count
    return out


def judge(texts: list[str | None], model: Model | None) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    step = max(1, COUNTS // len(model.languages))
    for at in range(0, len(texts), step):
        langs[at : at + step], scores[at : at + step] = _judge(texts[at : at + step], model)
    return langs, scores


def _judge(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    held = LANES if model.tables is not None else HELD_LANES
    needed, sizes = np.zeros((len(texts), len(model.languages))), np.ones(len(texts))
    has_letter = np.zeros(len(texts), bool)
    lanes, owner = [], []

    def parse():
        for first, tables in model.groups():
            for at in range(0, len(lanes), LANES):
                found = _phrases(tables, lanes[at : at + LANES])
                np.add.at(needed[:, first : first + len(found)], owner[at : at + LANES], found.T)
        lanes.clear()
        owner.clear()

    for i, text in enumerate(texts):
        symbols = symbols_of(text or "", model.classes)
        has_letter[i] = (symbols > 0).any()
        sizes[i] = max(1, len(symbols))
        for at in range(0, len(symbols) if has_letter[i] else 0, LANE):
            lanes.append(symbols[at : at + LANE])
            owner.append(i)
            if len(lanes) == held:
                parse()
    if lanes:
        parse()
    cost = needed * model.costs / sizes[:, None]
    best, ordered = cost.argmin(axis=1), np.partition(cost, min(1, cost.shape[1] - 1), axis=1)
    for i in np.flatnonzero(has_letter):
        langs[i] = model.languages[best[i]]
        second = ordered[i][1] if len(model.languages) > 1 else np.inf
        scores[i] = float(1 - ordered[i][0] / second) if second > 0 else 0.0
    return langs, scores


def _predict(shared, text_column: int):
    def run(batches):
        release()
        for batch in batches:
            langs, scores = judge(batch.column(text_column).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return run


def fit(labelled: DataFrame, rows: int = ROWS, letters: int = LETTERS) -> Model | None:
    """A model of a bounded sample of `labelled` (doc_id, text, lang): `rows` texts a language, by a hash."""
    long = F.length("text") > letters
    first = Window.partitionBy("lang").orderBy(long, F.xxhash64("doc_id"), F.xxhash64("text"))
    sample = (
        labelled.select("doc_id", "lang", "text").where("lang is not null and text is not null and text rlike '[^ ]'")
        .withColumn("place", F.row_number().over(first)).where(F.col("place") <= rows)
        .select("lang", "place", F.substring("text", 1, letters).alias("text"))
    )
    # Letters are counted over all of the sample; of its texts only those that fill a language's letters are held.
    found: dict[str, list[tuple[int, str]]] = {}
    held: Counter[str] = Counter()
    last: dict[str, int] = {}
    counts: Counter[str] = Counter()
    for row in sample.toLocalIterator():
        lang, place, own = row["lang"], row["place"], letter_counts([row["text"]])
        counts += own
        if own and (held[lang] < letters or place < last[lang]):
            found.setdefault(lang, []).append((place, row["text"]))
            held[lang] += own.total()
            last[lang] = max(place, last.get(lang, 0))
    return train({lang: [t for _, t in sorted(texts)] for lang, texts in found.items()}, letters, counts=counts)


def with_letters(documents: DataFrame) -> DataFrame:
    """The rows whose text has a letter: those that a model gives a language, whichever it is."""
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([any(map(str.isalpha, t or "")) for t in batch.column(at).to_pylist()], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def identify_languages(documents: DataFrame, model: Model | None) -> DataFrame:
    """`documents` with lang_pred and score (by how much the best language is cheaper than the next, 0 to 1).

    Columns that bear these names are replaced.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    plain = documents.drop("lang_pred", "score")
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(_predict(shared, plain.columns.index("text")), schema)
