"""Sizes: OCR repair, section and dimensions (F-S4..F-S8)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions.classify import any_contains, is_rectangular_product
from ductlake.functions.text import canonical_size, find_number, find_optional_number, latin_x, strip

# Marks that cannot occur in cleaned text: pair open, repaired pair open, pair close, separator.
_OPEN, _FIXED, _CLOSE, _SEP = "\u0001", "\u0002", "\u0003", "\u0004"


def _repair_pairs(size: Column) -> Column:
    """Multiply sides 10..99 of every AxB pair by ten, pairs taken left to right.

    Each pair is bracketed once, so a number that the previous pair has used is never looked at
    again; a pair with a repaired side is rewritten as plain AxB, the others keep their spelling.
    """
    side = "([0-9]{2,5})"
    marked = F.regexp_replace(
        size, rf"(?iU){side}(\s*x\s*){side}", f"{_OPEN}$1{_SEP}$2{_SEP}$3{_CLOSE}"
    )
    left = F.regexp_replace(
        marked,
        rf"{_OPEN}0*([1-9][0-9]){_SEP}[^{_SEP}]*{_SEP}([0-9]+){_CLOSE}",
        f"{_FIXED}$1" + f"0{_SEP}x{_SEP}$2{_CLOSE}",
    )
    right = F.regexp_replace(
        left,
        rf"[{_OPEN}{_FIXED}]([0-9]+){_SEP}[^{_SEP}]*{_SEP}0*([1-9][0-9]){_CLOSE}",
        f"{_FIXED}$1{_SEP}x{_SEP}$2" + f"0{_CLOSE}",
    )
    plain = F.regexp_replace(
        right, rf"{_FIXED}0*([0-9]+){_SEP}x{_SEP}0*([0-9]+){_CLOSE}", "$1x$2"
    )
    return F.regexp_replace(plain, f"[{_OPEN}{_FIXED}{_CLOSE}{_SEP}]", "")


def repair_canonical(name_lower: Column, canon: Column) -> Column:
    """Canonical size after the repair of lost zeros; null when there is nothing to look at."""
    suspect = F.contains(F.lower(canon), F.lit("x")) & is_rectangular_product(name_lower) & canon.rlike(
        r"(?iU)(?:(?<![1-9])[1-9][0-9]\s*x|x\s*0*[1-9][0-9](?![0-9])|x\s*0[0-9]{4})"
    )
    return F.when(suspect, _repair_pairs(canon))


def ocr_repair(name_lower: Column, size: Column) -> Column:
    """Repaired size of a rectangular product, or null when nothing had to be repaired."""
    canon = canonical_size(size)
    repaired = repair_canonical(name_lower, canon)
    return F.when(repaired != canon, repaired)


def ocr_warning(original: Column, repaired: Column) -> Column:
    """Warning text for a repaired size; null when `repaired` is null."""
    return F.concat(
        F.lit("OCR: размер исправлен '"), original, F.lit("' -> '"), repaired, F.lit("'")
    )


_RECT_SIZE = r"(?U)^([0-9]{2,5})\s*x\s*([0-9]{2,5})(?:\s*[x_-]\s*([0-9]{2,5}))?$"
_ROUND_SIZE = r"(?U)^(?:(?:d|dn|ф)\s*)?([0-9]{2,5})$"
_LONG_SIZE = r"(?U)^(?:d|dn|ф)\s*([0-9]{2,5})\s*[-_]\s*([0-9]{2,5})$"


def size_text(size: Column) -> Column:
    return latin_x(F.lower(strip(size)))


def read_size(text: Column) -> Column:
    """struct(D0, A0, B0, L0) of a text from `size_text`, null where it says nothing."""
    has_x = F.contains(text, F.lit("x"))
    has_dash = F.contains(text, F.lit("-")) | F.contains(text, F.lit("_"))
    return F.struct(
        F.when(has_x, F.lit(None)).when(has_dash, find_number(text, _LONG_SIZE, 1))
        .otherwise(find_number(text, _ROUND_SIZE)).alias("D0"),
        F.when(has_x, find_number(text, _RECT_SIZE, 1)).alias("A0"),
        F.when(has_x, find_number(text, _RECT_SIZE, 2)).alias("B0"),
        F.when(has_x, find_optional_number(text, _RECT_SIZE, 3))
        .when(has_dash, find_number(text, _LONG_SIZE, 2)).alias("L0"),
    )


def section_of(read: Column) -> Column:
    """Section of a size from `read_size`; null when it is not a size."""
    return F.when(read["A0"].isNotNull(), F.lit("rectangular")).when(
        read["D0"].isNotNull(), F.lit("round")
    )


def parse_size(size: Column) -> Column:
    """struct(section, D0, A0, B0, L0) of a size text; section is null when it is not a size."""
    read = read_size(size_text(size))
    return F.struct(
        section_of(read).alias("section"), *[read[n].alias(n) for n in ("D0", "A0", "B0", "L0")]
    )


def rect_sides(text: Column) -> tuple[Column, Column]:
    """All first sides and all second sides of the AxB pairs of a lower-case text, as text arrays."""
    pattern = F.lit(r"(?U)([0-9]{2,5})\s*x\s*([0-9]{2,5})")
    return (
        F.regexp_extract_all(text, pattern, F.lit(1)),
        F.regexp_extract_all(text, pattern, F.lit(2)),
    )


def diameters(text: Column) -> Column:
    return F.regexp_extract_all(
        text, F.lit(r"(?U)(?<![\w.])(?:d|dn|ф|ø|⌀)\s*([0-9]{2,5})"), F.lit(1)
    )


def _item(array: Column, index: int) -> Column:
    return F.get(array, index).try_cast("double")


_FROM_TO = r"(?U)с\s+(?:d|dn|ф)?\s*([0-9]{2,5})\s+на\s+(?:d|dn|ф)?\s*([0-9]{2,5})"
_MODEL_CODE = r"(?U)\blitened\s+([0-9]{1,3}-[0-9]{1,3})\s+(nkd|nkk)\b"
_BRANDS = ["msn", "kpn-s", "ppk", "гермик", "nkd", "knk", "chr", "kch", "rv", "rsk", "kon"]
_BRAND = r"(?U)\b(?:msn|kpn-s|ppk|гермик|nkd|knk|chr|kch|rv[ncs]|rsk|kon)[-\s]?([0-9]{2,4})\b"
_SLASHED = r"(?U)\bknk[-\s]?([0-9]{2,4})\s*/\s*([0-9])\b"


def read_dimensions(text: Column) -> Column:
    """struct of what the single rules read out of a lower-case text with one x spelling.

    Every rule is behind the letters it needs, so most texts meet few of the patterns.
    """
    def has(word: str) -> Column:
        return F.contains(text, F.lit(word))

    return F.struct(
        F.when(has("на"), find_number(text, _FROM_TO, 1)).alias("from_d"),
        F.when(has("на"), find_number(text, _FROM_TO, 2)).alias("to_d"),
        F.when(has("litened"), F.regexp_extract(text, _MODEL_CODE, 1)).alias("code"),
        F.when(has("litened"), F.upper(F.regexp_extract(text, _MODEL_CODE, 2))).alias("variant"),
        F.coalesce(
            F.when(has("l") | has("длина"), find_number(text, r"(?U)(?:l\s*=?\s*|длина\s*)([0-9]{3,5})")),
            F.when(has("мм"), find_number(text, r"(?U)\b([0-9]{3,5})\s*мм\b")),
        ).alias("length"),
        F.coalesce(
            F.when(has("град"), find_number(text, r"(?U)([0-9]{2,3})\s*°?\s*град")),
            find_number(text, r"(?U)\b(90|45|30|60|15|75)\b"),
        ).alias("angle"),
        F.when(has("r"), find_number(text, r"(?U)r\s*([0-9]{2,4})")).alias("radius"),
        F.when(any_contains(text, _BRANDS), find_number(text, _BRAND)).alias("brand_d"),
        F.when(has("knk"), find_number(text, _SLASHED, 1)).alias("slash_d"),
        F.when(has("knk"), find_number(text, _SLASHED, 2) * 100.0).alias("slash_l"),
    )


def _code_value(read: Column, values: dict[str, float]) -> Column:
    chain = None
    for code, value in values.items():
        hit = read["code"] == code
        chain = F.when(hit, F.lit(float(value))) if chain is None else chain.when(hit, F.lit(float(value)))
    return chain


def model_code_size(read: Column) -> Column:
    """struct(A, B, L) of a known model code, null fields otherwise."""
    known = read["code"].isin(list(fv.MODEL_CODE_SIZES))
    length = None
    for variant, value in fv.MODEL_CODE_LENGTHS.items():
        hit = known & (read["variant"] == variant)
        length = F.when(hit, F.lit(float(value))) if length is None else length.when(hit, F.lit(float(value)))
    return F.struct(
        _code_value(read, {k: a for k, (a, _) in fv.MODEL_CODE_SIZES.items()}).alias("A"),
        _code_value(read, {k: b for k, (_, b) in fv.MODEL_CODE_SIZES.items()}).alias("B"),
        length.alias("L"),
    )


def combine_dimensions(read: Column, code: Column, a_sides: Column, b_sides: Column, rounds: Column) -> Column:
    """struct of every dimension a text gives away, null fields where it gives none.

    Later rules overwrite earlier ones: words like `с D200 на D160` beat the listed diameters, a
    model code beats the listed sides, a brand gives the diameter only when nothing else does, and a
    slashed model gives diameter and length when one of them is missing.
    """
    n_rect, n_round = F.size(a_sides), F.size(rounds)
    d_listed = F.coalesce(
        read["from_d"], F.when((n_rect == 0) | (n_round == 1), _item(rounds, 0))
    )
    a0 = F.coalesce(code["A"], _item(a_sides, 0))
    d0 = F.coalesce(d_listed, F.when(a0.isNull(), read["brand_d"]))
    length = F.coalesce(code["L"], read["length"])
    use_slash = read["slash_d"].isNotNull() & (d0.isNull() | length.isNull())
    return F.struct(
        F.when(use_slash, read["slash_d"]).otherwise(d0).alias("D0"),
        F.coalesce(read["to_d"], F.when((n_rect < 2) & (n_round >= 2), _item(rounds, 1))).alias("D1"),
        F.when((n_rect < 2) & (n_round >= 3), _item(rounds, 2)).alias("D2"),
        a0.alias("A0"),
        _item(a_sides, 1).alias("A1"),
        _item(a_sides, 2).alias("A2"),
        F.coalesce(code["B"], _item(b_sides, 0)).alias("B0"),
        _item(b_sides, 1).alias("B1"),
        _item(b_sides, 2).alias("B2"),
        F.when(use_slash, read["slash_l"]).otherwise(length).alias("L0"),
        read["angle"].alias("U0"),
        read["radius"].alias("R0"),
    )


def text_dimensions(text: Column) -> Column:
    """F-S6 in one expression, for use outside the staged plan."""
    lowered = latin_x(F.lower(text))
    read = read_dimensions(lowered)
    return combine_dimensions(read, model_code_size(read), *rect_sides(lowered), diameters(lowered))


def description_dimensions(text: Column) -> Column:
    """struct(A0, B0, D0, L0, P0) for catalogue matching; looser than `text_dimensions`."""
    text_x = latin_x(text)
    pair = r"(?iU)([0-9]{2,4})\s*x\s*([0-9]{2,4})"
    a0 = find_number(text_x, pair, 1)
    named = find_number(text_x, r"(?iuU)(?:d|dn|ф)\s*([0-9]+)")
    bare = find_number(strip(text_x), r"(?U)\b([0-9]{2,4})\s*$")
    return F.struct(
        a0.alias("A0"),
        find_number(text_x, pair, 2).alias("B0"),
        F.coalesce(named, F.when(a0.isNull() & (bare >= 50) & (bare <= 1600), bare)).alias("D0"),
        find_number(text_x, r"(?iuU)(?:l\s*=?\s*|длина\s*)([0-9]{3,5})").alias("L0"),
        F.coalesce(
            find_number(text_x, r"(?iuU)(?:отверст|\sр\s*|штуцер)(?:\s*[:=])?\s*([0-9]+)"),
            find_number(text_x, r"(?iuU)\b([0-9])\s*(?:отверст|р\b|штуц)"),
        ).alias("P0"),
    )
