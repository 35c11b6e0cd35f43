"""Product type, section, material, thickness, connections and skip reasons (F-T*, F-M*, F-X1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions.text import clean, find_number, strip


def any_contains(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def product_type(name_lower: Column) -> Column:
    """First matching type in the fixed order; null when nothing matches.

    The plain substring test in front of every pattern keeps most rows away from the regex engine.
    """
    chain = F.when(
        F.contains(name_lower, F.lit("фасонные")) & name_lower.rlike("(?U)" + fv.AGGREGATE_FITTINGS_PATTERN),
        F.lit("aggregate_fittings"),
    )
    for literal, pattern, ptype in fv.PRODUCT_TYPES:
        hit = F.contains(name_lower, F.lit(literal))
        if pattern != literal:
            hit = hit & name_lower.rlike("(?U)" + pattern)
        chain = chain.when(hit, F.lit(ptype))
    return chain


def says_rectangular(text_lower: Column) -> Column:
    return F.contains(text_lower, F.lit("прямоугольн")) & text_lower.rlike(r"(?U)\bпрямоугольн")


def says_round(text_lower: Column) -> Column:
    return F.contains(text_lower, F.lit("кругл")) & text_lower.rlike(r"(?U)\bкругл")


def is_rectangular(text_lower: Column) -> Column:
    return (
        F.when(says_rectangular(text_lower), F.lit(True))
        .when(says_round(text_lower), F.lit(False))
        .otherwise(text_lower.rlike(r"(?U)[0-9]{2,4}\s*[xх×*]\s*[0-9]{2,4}"))
    )


def is_round(text_lower: Column) -> Column:
    return (
        F.when(says_round(text_lower), F.lit(True))
        .when(says_rectangular(text_lower), F.lit(False))
        .otherwise(text_lower.rlike(r"(?U)(?:d|dn|ф)\s*[0-9]+"))
    )


def is_rectangular_product(name_lower: Column) -> Column:
    """Lines whose small sides are taken for lost zeros."""
    return (
        F.when(F.contains(name_lower, F.lit("кругл")), F.lit(False))
        .when(F.contains(name_lower, F.lit("прямоугольн")), F.lit(True))
        .otherwise(any_contains(name_lower, fv.RECTANGULAR_PRODUCT_WORDS))
    )


def material_from_name(name: Column) -> Column:
    text = F.translate(F.lower(name), "ё", "е")
    return (
        F.when(any_contains(text, ["нерж", "aisi"]), F.lit("нержавеющая"))
        .when(any_contains(text, ["черн", "ст3", "ст.3", "ст-3"]), F.lit("черная"))
        .otherwise(F.lit(fv.DEFAULT_MATERIAL))
    )


def material_code(material: Column) -> Column:
    text = F.translate(F.lower(F.coalesce(material, F.lit(""))), "ё", "е")
    digit = strip(text)
    return (
        F.when(digit.isin("1", "2", "3"), digit)
        .when(F.contains(text, F.lit("нерж")), F.lit("2"))
        .when(F.contains(text, F.lit("черн")), F.lit("3"))
        .otherwise(F.lit("1"))
    )


_NUMBER = r"([0-9]{1,2}(?:\.[0-9]{1,3})?)"


def _plausible(value: Column) -> Column:
    return F.when((value >= 0.3) & (value <= 3.0), value)


def thickness_text(name_lower: Column) -> Column:
    """Name with decimal points and without sizes; null when no digit is left to look at."""
    text = F.translate(name_lower, "ё,", "е.")
    text = F.regexp_replace(
        text, r"(?U)\b[0-9]{2,5}\s*[xх×*]\s*[0-9]{2,5}(?:\s*[-_]\s*[0-9]{2,5})?\b", " "
    )
    text = F.regexp_replace(
        text, r"(?U)\b(?:d|dn|ф)\s*[0-9]{2,5}(?:\s*[-_]\s*[0-9]{2,5})?\b", " "
    )
    return F.when(name_lower.rlike("[0-9]"), text)


def thickness_after_grade(text: Column) -> Column:
    """Number after a steel grade, whatever its size."""
    return F.when(
        any_contains(text, ["08пс", "aisi", "ст"]),
        find_number(text, r"(?U)(?:08пс|aisi\s*[0-9]{3}|ст\.?3|ст-3)[()\s]*" + _NUMBER + r"\b"),
    )


def thickness_before_mm(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("мм")), find_number(text, r"(?U)" + _NUMBER + r"\s*мм"))


def thickness_of(text: Column, after_grade: Column, before_mm: Column) -> Column:
    """Sheet thickness in order of trust; `text` comes from `thickness_text`.

    After the word for thickness, after `t`, after a steel grade, before `мм`, and at last the first
    number that could be a thickness.
    """
    loose = F.transform(
        F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(1)), lambda t: t.try_cast("double")
    )
    return F.coalesce(
        F.when(
            F.contains(text, F.lit("толщин")),
            find_number(text, r"(?U)толщин(?:а|ой)(?:\s*стенки)?\s*" + _NUMBER + r"\s*мм?"),
        ),
        find_number(text, r"(?U)\b[тt]\s*[=:]?\s*" + _NUMBER + r"\b"),
        _plausible(after_grade),
        _plausible(before_mm),
        F.when(
            text.rlike("[0-9]"), F.get(F.filter(loose, lambda v: (v >= 0.3) & (v <= 3.0)), 0)
        ),
    )


def thickness_from_name(name: Column) -> Column:
    """Sheet thickness named in the text, null when there is none."""
    text = thickness_text(F.lower(name))
    return thickness_of(text, thickness_after_grade(text), thickness_before_mm(text))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """The table's code of a key, or null; a literal map, so the key is computed once and not per entry."""
    return F.try_element_at(F.create_map(*[F.lit(x) for entry in table.items() for x in entry]), key)


def connection_code(connection: Column, section: Column) -> Column:
    """Connection name or digit to its one-digit code; '0' when unused or unknown."""
    text = F.lower(clean(connection))
    spaced = strip(F.regexp_replace(F.translate(text, "/\\", "  "), r"(?U)\s+", " "))
    by_name = F.when(
        section == "round",
        F.coalesce(_lookup(spaced, fv.ROUND_CONNECTIONS), _lookup(text, fv.ROUND_CONNECTIONS)),
    ).otherwise(
        F.coalesce(_lookup(spaced, fv.RECT_CONNECTIONS), _lookup(text, fv.RECT_CONNECTIONS))
    )
    return F.when(text.rlike("^[0-8]$"), text).otherwise(F.coalesce(by_name, F.lit("0")))


def default_connections(is_round_section: Column, article: Column | None = None) -> Column:
    """The four side codes as one string of digits, e.g. '6600'."""
    plain = F.when(is_round_section, F.lit("2200")).otherwise(F.lit("6600"))
    if article is None:
        return plain
    return F.when(F.startswith(article, F.lit("3-3")), F.lit("6200")).otherwise(plain)


def skip_reason(size: Column, unit_lower: Column, ptype: Column) -> Column:
    return (
        F.when(ptype == "aggregate_fittings", F.lit(fv.REASON_AGGREGATE))
        .when(ptype == "diffuser", F.lit(fv.REASON_DIFFUSER))
        .when(
            ptype.isin(fv.REASON_EQUIPMENT_TYPES),
            F.concat(ptype, F.lit(fv.REASON_EQUIPMENT_SUFFIX)),
        )
        .when(size == "", F.lit(fv.REASON_NO_SIZE))
        .when(unit_lower.isin(fv.AREA_UNITS), F.lit(fv.REASON_AREA_UNIT))
        .otherwise(F.lit(fv.REASON_UNKNOWN))
    )
