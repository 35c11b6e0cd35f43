"""Licence scan: a generalised suffix automaton of licence tokens, matching statistics and chained spans.

All templates become one suffix automaton over their words.  The words of a text are streamed through it:
at each word the automaton holds the longest string that ends there and lies in some template (the
matching statistics).  A phrase is a template of a few words and is found wherever it ends, read off the
automaton's links.  Matches of at least `MIN_MATCH` words that cannot be made longer are chained per
template: both the text and the template move forward, with at most `GAP` words between two matches on
either side.  A chain that covers at least `share` of a template's words is a span; of spans that overlap
in the text the one with the larger share stays (then the longer, then the smaller name).

One pass over the table and no exchange; a task holds one block of a text, the matches of the last few
hundred words and the spans found.  The automaton grows with the templates only and is a part of the task.

Defined results: words are maximal runs of a-z, 0-9 and everything beyond ASCII, A-Z lower-cased; null and
empty texts have no words, labels '' and score 0; score is the largest share of any template covered (a
phrase counts as covered whole); repeated rows get equal rows, null doc_ids stay; other columns are
ignored; an empty table gives no rows; very long texts are read in blocks, and a word is never cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductlake.llm.licence_texts import PHRASES, TEMPLATES
from ductlake.llm.work import byte_blocks

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MIN_MATCH = 4
GAP = 32
SHARE = 0.6
SPAN = "struct<template: string, label: string, first_word: long, end_word: long, template_first: int, template_end: int, covered: int, share: double>"
SCAN_DDL = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, spans array<{SPAN}>"


class SuffixAutomaton:
    """Of several sequences at once; a state's strings share their ends in all sequences."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        places: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for end, word in enumerate(sequence, 1):
                last = self._extend(last, word)
                places += [[] for _ in range(len(self.next) - len(places))]
                places[last].append((number, end))
        self.wholes = self._wholes(sequences)
        # Ends of a state are its own and those of the states linked to it: longest first, passed on along the links.
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                places[self.link[state]] += places[state]
        self.places = places

    def _state(self, length: int, following: dict[bytes, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, before: int, word: bytes) -> int:
        """The state of exactly the strings before `word` from `before`, made out of the target if that holds longer ones."""
        target = self.next[before][word]
        if self.length[target] == self.length[before] + 1:
            return target
        part = self._state(self.length[before] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = part
        while before >= 0 and self.next[before].get(word) == target:
            self.next[before][word] = part
            before = self.link[before]
        return part

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        state, before = self._state(self.length[last] + 1, {}, 0), last
        while before >= 0 and word not in self.next[before]:
            self.next[before][word] = state
            before = self.link[before]
        if before >= 0:
            self.link[state] = self._split(before, word)
        return state

    def _wholes(self, sequences: list[list[bytes]]) -> list[list[int]]:
        """By state, the sequences that are as a whole a string of it or of a state up its links."""
        own: dict[int, list[int]] = {}
        for number, sequence in enumerate(sequences):
            state = 0
            for word in sequence:
                state = self.next[state][word]
            own.setdefault(state, []).append(number)
        out: list[list[int]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            out[state] = own.get(state, []) + out[self.link[state]]
        return out


def split_words(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


class Templates:
    """(name, label, text) of phrases, which count wherever they stand, and of templates, which count by the share covered."""

    def __init__(self, phrases: Iterable[tuple[str, str, str]], templates: Iterable[tuple[str, str, str]], share: float = SHARE):
        rows = [(name, label, split_words(text)) for name, label, text in [*phrases, *templates]]
        self.n_phrases = len(list(phrases))
        if any(not words for _, _, words in rows):
            raise ValueError("a template needs a word")
        self.names, self.labels, sequences = map(list, zip(*rows)) if rows else ([], [], [])
        self.lengths = [len(s) for s in sequences]
        self.longest = max(self.lengths, default=0)
        self.share = share
        self.automaton = SuffixAutomaton(sequences)
        # What a state says at once: phrases that end there, and template places for chains.
        self.phrase_ends = [[t for t in whole if t < self.n_phrases] for whole in self.automaton.wholes]
        self.chain_ends = [[(t, e) for t, e in places if t >= self.n_phrases] for places in self.automaton.places]


class Scan:
    """The matching statistics of one text, fed in lists of words."""

    def __init__(self, templates: Templates):
        self.t = templates
        self.state = self.matched = self.at = 0
        self.n_base, self.first, self.last = 0, None, None
        self.base: set[str] = set()
        self.chains: dict[int, list[tuple[int, int, int, int, int]]] = {}
        self.spans: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        self.score = 0.0

    def feed(self, words: list[bytes]) -> None:
        auto = self.t.automaton
        following, link, length, ends = auto.next, auto.link, auto.length, self.t.phrase_ends
        known = following[0]
        state, matched, at = self.state, self.matched, self.at
        for word in words:
            if word not in known:
                if matched >= MIN_MATCH:
                    self.close(state, matched, at)
                state = matched = 0
            else:
                if word not in following[state]:
                    if matched >= MIN_MATCH:
                        self.close(state, matched, at)
                    while word not in following[state]:
                        state = link[state]
                    matched = length[state]
                state = following[state][word]
                matched += 1
                if ends[state]:
                    self.phrases(state, matched, at + 1)
            at += 1
        self.state, self.matched, self.at = state, matched, at

    def phrases(self, state: int, matched: int, end: int) -> None:
        for t in self.t.phrase_ends[state]:
            if self.t.lengths[t] <= matched:
                start = end - self.t.lengths[t]
                self.n_base += 1
                self.base.add(self.t.labels[t])
                self.first = start if self.first is None else min(self.first, start)
                self.last = start if self.last is None else max(self.last, start)
                self.score = 1.0

    def close(self, state: int, matched: int, end: int) -> None:
        """A match of `matched` words that ends before word `end` cannot be made longer: chain it in each template that holds it."""
        for t, t_end in self.t.chain_ends[state]:
            start, t_start = end - matched, t_end - matched
            best = (matched, start, t_start)
            recent = [c for c in self.chains.get(t, ()) if end - c[3] <= self.t.longest + GAP]
            for covered, c_start, c_t_start, c_end, c_t_end in recent:
                gain = matched - max(0, c_end - start, c_t_end - t_start)
                if gain > 0 and c_end < end and c_t_end < t_end and start - c_end <= GAP and t_start - c_t_end <= GAP:
                    best = max(best, (covered + gain, c_start, c_t_start), key=lambda c: (c[0], -c[1], -c[2]))
            node = (*best, end, t_end)
            self.chains[t] = [*recent, node]
            share = best[0] / self.t.lengths[t]
            self.score = max(self.score, share)
            if share >= self.t.share and best[0] > self.spans.get((t, best[1]), (0,))[0]:
                self.spans[t, best[1]] = node

    def finish(self) -> list[dict]:
        """The spans that stay, in the order of the text."""
        if self.matched >= MIN_MATCH:
            self.close(self.state, self.matched, self.at)
        found = [
            {"template": self.t.names[t], "label": self.t.labels[t], "first_word": start, "end_word": end, "template_first": t_start,
             "template_end": t_end, "covered": covered, "share": covered / self.t.lengths[t]}
            for (t, _), (covered, start, t_start, end, t_end) in self.spans.items()
        ]
        found.sort(key=lambda s: (-s["share"], -s["covered"], s["template"], s["first_word"]))
        return sorted(self._apart(found), key=lambda s: s["first_word"])

    @staticmethod
    def _apart(found: list[dict]) -> list[dict]:
        """The first of those that overlap, in the given order."""
        from bisect import bisect_left, insort

        starts: list[tuple[int, int]] = []
        kept = []
        for span in found:
            place = bisect_left(starts, (span["first_word"], span["end_word"]))
            left = place and starts[place - 1][1] > span["first_word"]
            right = place < len(starts) and starts[place][0] < span["end_word"]
            if not left and not right:
                insort(starts, (span["first_word"], span["end_word"]))
                kept.append(span)
        return kept


def scan_text(text: str | None, templates: Templates) -> tuple:
    """The values of `SCAN_DDL` after doc_id."""
    scan = Scan(templates)
    for block in byte_blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        scan.feed(WORD.findall(block))
    spans = scan.finish()
    base = sorted(scan.base)
    return scan.at, scan.n_base, scan.first, scan.last, base, sorted({*base, *(s["label"] for s in spans)}), scan.score, spans


@lru_cache(maxsize=4)
def compiled(phrases: tuple, templates: tuple, share: float) -> Templates:
    """One automaton per Python worker and set of templates."""
    return Templates(phrases, templates, share)


def licence_scan(documents: DataFrame, phrases=tuple(PHRASES), templates=tuple(TEMPLATES), share: float = SHARE) -> DataFrame:
    """`SCAN_DDL` for each row of `documents` (doc_id, text): words, places of phrases, labels, covered spans."""
    phrases, templates = tuple(phrases), tuple(templates)
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())), ("score", pa.float64()),
        ("spans", pa.list_(pa.struct([
            ("template", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("template_first", pa.int32()),
            ("template_end", pa.int32()), ("covered", pa.int32()), ("share", pa.float64())]))),
    ])

    def run(batches):
        wanted = compiled(phrases, templates, share)
        for batch in batches:
            scans = [scan_text(t.as_py(), wanted) for t in batch.column(1)]
            columns = [batch.column(0), *(pa.array(c, kinds.field(k + 1).type) for k, c in enumerate(zip(*scans)))] if scans else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds.field(k).type) if isinstance(c, list) else c for k, c in enumerate(columns)], schema=kinds)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCAN_DDL)
