"""Article and parameters of a fitting, an adapter or a duct (C1..C13).

Every function here is a plain column over the features that `operators.spec_lines` has computed
before: `ptype`, the dimension struct `dims`, the two section flags and the texts.  The article is
chosen first; it then decides which dimensions become parameters.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions.text import find_number

FITTING_TYPES = [
    "elbow", "transition", "tee", "cross", "cap", "saddle", "offset", "flange",
    "silencer", "damper", "throttle", "mounting_cup",
]

# Which dimensions an article keeps as they are.
KEPT = {
    ("2-1-1", "2-1-2", "2-1-3"): ["D0", "U0", "R0"],
    ("2-2-1", "2-2-2", "2-2-3", "2-2-4"): ["A0", "B0", "U0", "R0"],
    ("3-1-1",): ["D0", "D1"],
    ("3-2-1",): ["A0", "B0", "A1", "B1"],
    ("3-3-1",): ["A0", "B0", "D0"],
    ("4-1-1",): ["D0"],
    ("4-1-3",): ["D0", "A2", "B2"],
    ("4-2-1",): ["A0", "B0"],
    ("4-2-3",): ["A0", "B0", "A1", "B1", "A2", "B2"],
    ("5-1-1", "5-2-1", "6-1-1", "6-2-1", "12-1-3", "12-2-2"): ["D0", "A0", "B0"],
    ("8-1-1", "8-2-1"): ["D0", "D1", "A0", "B0"],
    ("15-1-1", "15-1-2", "29-1-3", "16-1-1", "18-1-3", "20-1", "21-1-1"): ["D0", "L0"],
    ("15-2-1", "15-2-2", "15-2-3", "15-2-6", "15-2-7", "16-2-1", "18-2-1", "20-2", "21-2-1"):
        ["A0", "B0", "L0"],
}
# Lengths that do not depend on the text, and lengths used when the text gives none.
SET_LENGTHS = {
    200.0: ["3-1-1", "3-2-1", "3-3-1", "4-1-1", "4-1-3", "4-2-1", "4-2-3", "5-1-1", "5-2-1"],
    150.0: ["8-1-1", "8-2-1"],
    1000.0: ["15-2-5"],
}
FALLBACK_LENGTHS = {
    1000.0: ["15-1-1", "15-1-2", "15-2-1", "15-2-2", "15-2-3", "15-2-6", "15-2-7"],
    200.0: ["29-1-3", "16-1-1", "18-1-3", "20-1", "21-1-1", "16-2-1", "18-2-1", "20-2", "21-2-1"],
}


@dataclass(frozen=True)
class Features:
    """Columns the classifier looks at."""

    ptype: Column
    name_lower: Column
    rect: Column
    round: Column
    dims: Column

    def dim(self, name: str) -> Column:
        return self.dims.getField(name)

    def says(self, word: str) -> Column:
        return F.contains(self.name_lower, F.lit(word))


def effective_sections(f: Features) -> tuple[Column, Column]:
    """Section flags; for silencers the dimensions found decide before the words do."""
    has_rect, has_round = f.dim("A0").isNotNull(), f.dim("D0").isNotNull()
    silencer = f.ptype == "silencer"
    rect = F.when(silencer & has_rect, True).when(silencer & has_round, False).otherwise(f.rect)
    circ = F.when(silencer & has_rect, False).when(silencer & has_round, True).otherwise(f.round)
    return rect, circ


def tee_branch(f: Features) -> Column:
    """Diameter of a round branch, null when there is none."""
    def non_zero(c: Column) -> Column:
        return F.when(c != 0, c)
    return F.coalesce(
        non_zero(F.coalesce(f.dim("D2"), f.dim("D1"))), F.when(f.rect, non_zero(f.dim("D0")))
    )


def _first(*options: tuple[Column, str], default: str | None = None) -> Column:
    chain = reduce(
        lambda acc, o: F.when(o[0], F.lit(o[1])) if acc is None else acc.when(o[0], F.lit(o[1])),
        options, None,
    )
    return chain if default is None else chain.otherwise(F.lit(default))


def fitting_article(f: Features, branch: Column) -> Column:
    """Article of a fitting; null when the line is no fitting or lacks what its type needs.

    `f.rect` and `f.round` are the effective flags.
    """
    has_d, has_ab = f.dim("D0").isNotNull(), f.dim("A0").isNotNull()
    has_branch_pair = f.dim("A1").isNotNull()
    elbow = F.when(
        f.rect,
        _first(
            (f.says("прямой"), "2-2-2"),
            (f.says("косой") | f.name_lower.rlike(r"(?U)\bкос\b"), "2-2-3"),
            (f.says("пирамид"), "2-2-4"),
            default="2-2-1",
        ),
    ).otherwise(_first((f.says("конич"), "2-1-2"), (f.says("гофрир"), "2-1-3"), default="2-1-1"))
    transition = _first(
        (f.rect & f.round & has_ab & has_d, "3-3-1"), (f.rect, "3-2-1"), default="3-1-1"
    )
    tee = _first(
        (f.rect & branch.isNotNull(), "4-2-1"),
        (f.rect & has_branch_pair, "4-2-3"),
        (~f.rect & branch.isNotNull(), "4-1-1"),
        (~f.rect & f.dim("A2").isNotNull(), "4-1-3"),
    )
    silencer = F.when(
        f.rect,
        _first(
            (f.says("пластина шумоглушителя") | f.says("пластинчатый тип 4"), "15-2-4"),
            (f.says("обтекатель шумоглушителя") | f.says("с обтекателем тип 5"), "15-2-5"),
            (~has_ab, None),
            (f.says("пластинчатый"), "15-2-2"),
            (f.says("с круглыми врезками"), "15-2-6"),
            (f.says("канальный"), "15-2-7"),
            (f.says("с обтекателем"), "15-2-3"),
            default="15-2-1",
        ),
    ).when(has_d, _first((f.says("спиральный"), "15-1-2"), default="15-1-1"))
    damper_rect = F.when(
        has_ab,
        _first(
            (f.says("обратный"), "18-2-1"),
            (f.says("противопожарный") | f.says("дымовой"), "20-2"),
            (f.says("воздушный"), "21-2-1"),
            default="16-2-1",
        ),
    )
    damper_round = F.when(
        has_d,
        _first(
            (f.says("обратный"), "18-1-3"),
            (f.says("противопожарный") | f.says("дымовой"), "20-1"),
            (f.says("воздушный"), "21-1-1"),
            default="16-1-1",
        ),
    )
    any_dim = F.coalesce(*[
        f.dim(d) for d in ("D0", "A0", "L0", "U0", "R0", "D1", "D2")
    ]).isNotNull()
    by_type = (
        F.when(f.ptype == "elbow", elbow)
        .when(f.ptype == "transition", transition)
        .when(f.ptype == "tee", tee)
        .when(f.ptype == "cross", F.when(f.round, F.lit("5-1-1")).otherwise(F.lit("5-2-1")))
        .when(f.ptype == "cap", F.when(f.round, F.lit("6-1-1")).otherwise(F.lit("6-2-1")))
        .when(f.ptype == "saddle", F.when(f.round, F.lit("8-1-1")).otherwise(F.lit("8-2-1")))
        .when(f.ptype == "flange", F.when(f.round, F.lit("12-1-3")).otherwise(F.lit("12-2-2")))
        .when(f.ptype == "silencer", silencer)
        .when((f.ptype == "mounting_cup") & has_d, F.lit("29-1-3"))
        .when(f.ptype.isin("damper", "throttle"), F.when(f.rect, damper_rect).otherwise(damper_round))
    )
    return F.when(any_dim, by_type)


def read_plate(article: Column, text: Column) -> Column:
    """struct of the AxBxC and the AxB a plate or vane text is made of; null for other articles."""
    triple = r"(?iU)([0-9]{2,5})\s*x\s*([0-9]{2,5})\s*x\s*([0-9]{2,5})"
    pair = r"(?iU)([0-9]{2,5})\s*x\s*([0-9]{2,5})"
    return F.when(
        article.isin("15-2-4", "15-2-5"),
        F.struct(
            *[find_number(text, triple, i).alias(f"t{i}") for i in (1, 2, 3)],
            *[find_number(text, pair, i).alias(f"v{i}") for i in (1, 2)],
        ),
    )


def fitting_params(article: Column, f: Features, branch: Column, plate_text: Column) -> dict[str, Column]:
    """Parameter name -> column, null where the article does not use the parameter."""
    plate, vane = article == "15-2-4", article == "15-2-5"
    a0, b0, a2 = f.dim("A0"), f.dim("B0"), f.dim("A2")
    t = [plate_text[f"t{i}"] for i in (1, 2, 3)]
    v = [plate_text[f"v{i}"] for i in (1, 2)]
    read_triple = a2.isNull() & t[0].isNotNull()
    read_pair = a2.isNull() & t[0].isNull() & v[0].isNotNull()
    first = F.coalesce(a0, F.lit(0.0))
    second = F.coalesce(b0, first)

    def kept(name: str) -> Column:
        articles = [a for group, names in KEPT.items() if name in names for a in group]
        return F.when(article.isin(articles), f.dim(name))

    side = F.coalesce(f.dim("D0"), F.greatest(a0, b0), F.lit(0.0))
    length = F.when(plate, F.when(read_triple, t[1]).otherwise(second))
    for value, articles in SET_LENGTHS.items():
        length = length.when(article.isin(articles), F.lit(value))
    for value, articles in FALLBACK_LENGTHS.items():
        length = length.when(article.isin(articles), F.coalesce(f.dim("L0"), F.lit(value)))
    return {
        "D0": kept("D0"),
        "D1": kept("D1"),
        "D2": F.when(article.isin("4-1-1", "4-2-1"), branch),
        "A0": kept("A0"),
        "A1": kept("A1"),
        "A2": F.when(plate, F.when(read_triple, t[2]).otherwise(F.coalesce(a2, F.lit(200.0))))
        .when(vane, F.when(read_pair, v[1]).otherwise(F.coalesce(a2, F.lit(200.0))))
        .otherwise(kept("A2")),
        "B0": F.when(plate, F.when(read_triple, t[0]).otherwise(first))
        .when(vane, F.when(read_pair, v[0]).otherwise(first))
        .otherwise(kept("B0")),
        "B1": kept("B1"),
        "B2": kept("B2"),
        "L0": length,
        "L2": F.when(F.startswith(article, F.lit("4-")), F.lit(100.0)),
        "P0": F.when(
            article.isin("6-1-1", "6-2-1"), F.when(side <= 950, F.lit(25.0)).otherwise(F.lit(35.0))
        ).when(article.isin("12-1-3", "12-2-2"), F.lit(0.0)),
        "U0": F.when(F.startswith(article, F.lit("2-")), F.coalesce(f.dim("U0"), F.lit(90.0))),
        "R0": F.when(F.startswith(article, F.lit("2-1-")), F.coalesce(f.dim("R0"), f.dim("D0")))
        .when(F.startswith(article, F.lit("2-2-")), F.coalesce(f.dim("R0"), F.greatest(a0, b0))),
    }


def cap_comment_size(f: Features) -> Column:
    """Caps put their governing side into the comment instead of the size text."""
    side = F.coalesce(f.dim("D0"), F.greatest(f.dim("A0"), f.dim("B0")))
    return F.coalesce(side.cast("string"), F.lit("0"))


def read_adapter(text: Column) -> Column:
    """struct(a, b, d) of an adapter text; null when the text (lower case, one x) names none."""
    named = F.contains(text, F.lit("ксд")) | F.contains(text, F.lit("4апн")) | F.contains(text, F.lit("адаптер"))
    pair = r"(?U)([0-9]{2,5})\s*x\s*([0-9]{2,5})"
    return F.when(
        named,
        F.struct(
            find_number(text, pair, 1).alias("a"),
            find_number(text, pair, 2).alias("b"),
            find_number(text, r"(?U)(?:ксд|d|ф)\s*([0-9]{2,5})").alias("d"),
        ),
    )


def adapter(text: Column, read: Column) -> Column:
    """struct(article, D0, D1, A0, B0, L0) of a plenum adapter; null when it is none."""
    a0, b0 = read["a"], read["b"]
    d1 = F.when(read["d"] != 0, read["d"])
    rect = (
        F.contains(text, F.lit("прямоугольн")) | F.contains(text, F.lit("квадратн"))
        | F.contains(text, F.lit("4апн"))
    )
    nothing = F.lit(None).cast("double")
    round_one = F.struct(
        F.lit("10-1-1").alias("article"),
        F.greatest(a0, b0).alias("D0"),
        F.coalesce(d1, F.lit(0.0)).alias("D1"),
        nothing.alias("A0"),
        nothing.alias("B0"),
        F.coalesce(d1 + 100.0, F.lit(200.0)).alias("L0"),
    )
    square_one = F.struct(
        F.lit("10-2-3").alias("article"),
        nothing.alias("D0"),
        d1.alias("D1"),
        a0.alias("A0"),
        b0.alias("B0"),
        (d1 + 100.0).alias("L0"),
    )
    return F.when(
        a0.isNotNull(),
        F.when(F.contains(text, F.lit("кругл")), round_one).when(rect & d1.isNotNull(), square_one),
    )
