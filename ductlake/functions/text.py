"""Text, number and unit columns (F-N1..3, F-N5..6, F-S1..3, N1, N5, N6, N8, N9).

Patterns are literals with explicit flags: `(?iuU)` folds Cyrillic case and makes `\\w` and `\\b`
Unicode-aware, which Java does not do by default.  Digits are written `[0-9]` so that every captured
text casts to a number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ductlake import fixed_values as fv

WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?$"
# Pieces are 64-bit whole numbers; a line whose quantity reaches this is told apart from an unreadable one.
PIECES_LIMIT = 2.0**63


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (`trim` alone removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def clean(text: Column) -> Column:
    """Missing and blank are the same thing: stripped text, '' for null."""
    return strip(F.coalesce(text, F.lit("")))


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def find(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when there is none."""
    return null_if_empty(F.regexp_extract(text, pattern, group))


def find_number(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group of digits as a number, null when the pattern does not match.

    The group takes part in every match.  Taking the first of all matches gives null for none;
    casting the '' of a plain extraction gives null too, but by way of an exception per row.
    """
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), 0).try_cast("double")


def find_optional_number(text: Column, pattern: str, group: int) -> Column:
    """As `find_number`, for a group that a match may leave out."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found.try_cast("double"))


def number_or_null(text: Column) -> Column:
    """Number with spaces removed and decimal comma allowed; null when it is not a number."""
    compact = strip(F.translate(text, ", ", "."))
    value = F.when(
        compact.rlike(NUMBER), F.replace(compact, F.lit("_"), F.lit("")).try_cast("double")
    )
    return F.when(F.abs(value) < float("inf"), value)


def number_or(text: Column, default: float) -> Column:
    return F.coalesce(number_or_null(text), F.lit(float(default)))


def thickness_number(text: Column) -> Column:
    """Thickness column: decimal comma allowed, inner spaces not; null when unreadable."""
    compact = strip(F.translate(text, ",", "."))
    return F.when(
        compact.rlike(NUMBER), F.replace(compact, F.lit("_"), F.lit("")).try_cast("double")
    )


def price_digits(text: Column) -> Column:
    """All digits of a price text as one whole number; null without digits."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    return F.when(digits != "", digits.try_cast("decimal(38,0)"))


def half_even(value: Column) -> Column:
    return F.rint(value).try_cast("bigint")


def pieces_from_metres(metres: Column, length_mm: Column) -> Column:
    """Running metres to whole standard lengths, at least one; 0 for non-positive input."""
    return F.when((metres <= 0) | (length_mm <= 0), F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), half_even(metres / (length_mm / 1000.0)))
    )


def piece_count(quantity: Column, unit: Column) -> Column:
    """Pieces truncate; any other unit rounds half to even and is at least one."""
    return F.when(unit.isin(fv.PIECE_UNITS), quantity.try_cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), half_even(quantity))
    )


# --- sizes as text ---------------------------------------------------------------------------


def latin_x(text: Column) -> Column:
    """Cyrillic х, × and * all mean x."""
    return F.translate(text, "х×*", "xxx")


def canonical_size(text: Column) -> Column:
    """One spelling of x and no spaces inside numbers."""
    unified = latin_x(text)
    gaps = text.rlike(r"(?U)[0-9]\s+[0-9]")
    return F.when(
        gaps, F.regexp_replace(unified, r"(?U)(?<=[0-9])\s+(?=[0-9])", "")
    ).otherwise(unified)


def canonical_prefix(token: Column) -> Column:
    """Ø and ⌀ become Ф; a leading D/DN becomes ф only when it stands alone."""
    return F.regexp_replace(F.translate(token, "Ø⌀", "ФФ"), r"(?iuU)^(?:d|dn)\b", "ф")


TRIPLE_TOKEN = r"(?iuU)\b([0-9]{2,5}\s*x\s*[0-9]{2,5}\s*x\s*[0-9]{2,5})\b"
PAIR_TOKEN = r"(?iuU)\b([0-9]{2,5}\s*x\s*[0-9]{2,5}(?:\s*[-_]\s*[0-9]{2,5})?)\b"
ROUND_TOKEN = r"(?iuU)(?<![\w.])((?:D|DN|Ф|Ø|⌀)\s*[0-9]{2,5}(?:\s*[-_]\s*[0-9]{2,5})?)"


def size_tokens(canon: Column) -> Column:
    """struct of the first triple, pair and diameter in a text from `canonical_size`, '' if none."""
    has_pair = canon.rlike(r"(?iU)[0-9]\s*x\s*[0-9]")
    return F.struct(
        F.when(has_pair, F.regexp_extract(canon, TRIPLE_TOKEN, 1)).otherwise("").alias("triple"),
        F.when(has_pair, F.regexp_extract(canon, PAIR_TOKEN, 1)).otherwise("").alias("pair"),
        F.regexp_extract(canon, ROUND_TOKEN, 1).alias("circ"),
    )


def pick_token(tokens: Column) -> Column:
    """The token that counts: a triple, else a pair, else a diameter; without spaces."""
    picked = (
        F.when(tokens["triple"] != "", tokens["triple"])
        .when(tokens["pair"] != "", tokens["pair"])
        .when(tokens["circ"] != "", canonical_prefix(tokens["circ"]))
        .otherwise("")
    )
    return F.replace(picked, F.lit(" "), F.lit(""))


def size_token(text: Column) -> Column:
    """Size written inside a name: AxBxL, AxB[-L], or a diameter with optional length; '' if none."""
    return pick_token(size_tokens(canonical_size(text)))


# --- headers, units, models ------------------------------------------------------------------


def normalise_header(header: Column) -> Column:
    lowered = F.translate(strip(F.lower(header)), "ё", "е")
    return F.regexp_replace(F.regexp_replace(lowered, r"[._\\/|-]+", " "), r"(?U)\s+", " ")


def unit_from_size(size: Column) -> Column:
    """A line with a number at the start of a word is measured in metres, otherwise in pieces."""
    return F.when(
        F.lower(size).rlike(r"(?iuU)(?:^|\s)(?:d|dn|ф)?\s*[0-9]+"), F.lit("м")
    ).otherwise(F.lit("шт"))


def canonical_unit(unit: Column) -> Column:
    stripped = clean(unit)
    compact = F.translate(F.lower(stripped), ". ", "")
    result = None
    for name, spellings in fv.CANONICAL_UNITS.items():
        hit = compact.isin(spellings)
        result = F.when(hit, F.lit(name)) if result is None else result.when(hit, F.lit(name))
    return result.otherwise(stripped)


def clean_model(model: Column) -> Column:
    """Model text, or null when it is blank, a placeholder or only a standard number."""
    text = clean(model)
    useless = (text == "") | text.rlike(r"(?U)^(?:[0-](?:\s|$)|ГОСТ)")
    return F.when(~useless, text)


def name_with_model(name: Column, model: Column) -> Column:
    """Append the model unless the name already contains it (case ignored)."""
    absent = model.isNotNull() & ~F.contains(F.upper(name), F.upper(model))
    return F.when(absent, strip(F.concat_ws(" ", name, model))).otherwise(name)
