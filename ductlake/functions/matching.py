"""Scoring of free descriptions against catalogue names (F-Q1..F-Q4)."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions.classify import any_contains
from ductlake.functions.text import strip


def normalise(text: Column) -> Column:
    """Lower case, ё as е, everything but letters, digits and size signs as one space."""
    lowered = F.translate(F.lower(text), "ё", "е")
    kept = F.regexp_replace(lowered, r"[^a-zа-я0-9x*×х/\-. ]", " ")
    return strip(F.regexp_replace(kept, r"(?U)\s+", " "))


def word_mask(text: Column) -> Column:
    """Bit i is set when catalogue word i occurs."""
    bits = [
        F.when(F.contains(text, F.lit(w)), F.lit(1 << i)).otherwise(F.lit(0))
        for i, w in enumerate([*fv.DUCT_WORDS, *fv.FITTING_WORDS])
    ]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def section_hints(text: Column) -> Column:
    """Bit 0: the text hints at a round section, bit 1: at a rectangular one."""
    circ = F.when(any_contains(text, fv.ROUND_HINTS), F.lit(1)).otherwise(F.lit(0))
    rect = F.when(any_contains(text, fv.RECT_HINTS), F.lit(2)).otherwise(F.lit(0))
    return circ.bitwiseOR(rect)


def keyword_score(text_mask: Column, text_hints: Column, name_mask: Column, section: Column) -> Column:
    """2 points for a section hint, 3 for every catalogue word in both texts."""
    wanted = F.when(section == "round", F.lit(1)).when(section == "rectangular", F.lit(2)).otherwise(F.lit(0))
    hint = F.when(text_hints.bitwiseAND(wanted) != 0, F.lit(2.0)).otherwise(F.lit(0.0))
    return hint + F.bit_count(text_mask.bitwiseAND(name_mask)) * 3.0


def inferred_section(dims: Column) -> Column:
    return F.when(dims.getField("A0").isNotNull(), F.lit("rectangular")).when(
        dims.getField("D0").isNotNull(), F.lit("round")
    )


def section_bonus(inferred: Column, section: Column) -> Column:
    return F.when(inferred == section, F.lit(2.5)).otherwise(F.lit(0.0))


def ratio_bound(length_a: Column, length_b: Column) -> Column:
    """Largest similarity two texts of these lengths can have."""
    total = length_a + length_b
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.least(length_a, length_b) / total)


def _best_candidates(text: str, names, bases, bounds, top_n: int, matchers: dict) -> list[dict]:
    """Exact top-n of `10 * similarity + base`; candidates come in any order.

    The most promising ones are compared first.  A candidate is passed over when a bound on its
    similarity (by length, then by letters in common) cannot reach the n-th best score any more.
    """
    order = sorted(range(len(names)), key=lambda i: -(bounds[i] * 10 + bases[i]))
    found: list[tuple[float, int]] = []
    for i in order:
        needed = found[top_n - 1][0] - 1e-9 if len(found) >= top_n else float("-inf")
        if bounds[i] * 10 + bases[i] < needed:
            break
        matcher = matchers.get(names[i])
        if matcher is None:
            matcher = matchers[names[i]] = SequenceMatcher(None, "", names[i])
        matcher.set_seq1(text)
        if matcher.quick_ratio() * 10 + bases[i] < needed:
            continue
        found.append((matcher.ratio() * 10 + bases[i], i))
        found.sort(key=lambda s: (-s[0], s[1]))
    return [{"position": i, "score": score} for score, i in found[:top_n]]


def top_similar(top_n: int):
    """Arrow function: (text, names[], base scores[], bounds[]) -> best [(position, score)]."""

    @F.pandas_udf("array<struct<position:int,score:double>>")
    def ranked(text: pd.Series, names: pd.Series, bases: pd.Series, bounds: pd.Series) -> pd.Series:
        matchers: dict = {}
        return pd.Series([
            _best_candidates(t, n, b, u, top_n, matchers)
            for t, n, b, u in zip(text, names, bases, bounds)
        ])

    return ranked
