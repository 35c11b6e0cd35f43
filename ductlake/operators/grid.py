"""Raw cell grids to equipment lines and specification lines (A1, A2, W1, W4, W5, P2..P6, P12, P13).

Two shapes are used: long cells (table keys, row_no, col_no, text) and wide rows (table keys,
row_no, cells) where `cells` is a map col_no -> non-empty text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions import classify, text
from ductlake.operators.running import BLOCK_ROWS, running
from ductlake.session import spread

TABLE_KEYS = ["doc_id", "page", "table_no"]
UNIT_CELL = r"(?iuU)^(?:шт\.?|м|м2|м²|кв\.м|кв м|pcs|pc|m|m2)$"
MANUFACTURER_CELL = r"(?U)^[A-ZА-Я]{1,10}(?:\s+[A-ZА-Я]{1,10})?$"
SERVICE_ROW = (
    r"(?iuU)^(?:П\d+(?:\.\d+)?\s*\(.*\)|ОБОРУДОВАНИЕ|КИПиА|Лист|Приложение|Спецификация"
    r"|Тип, марка|Позиция|Наименование)"
)


def is_unit(cell: Column) -> Column:
    return cell.rlike(UNIT_CELL)


def is_quantity(cell: Column) -> Column:
    return text.number_or_null(cell).isNotNull()


def is_manufacturer(cell: Column) -> Column:
    return (F.length(cell) <= 15) & cell.rlike(MANUFACTURER_CELL)


def is_name(cell: Column) -> Column:
    has_letters = cell.rlike(r"(?iu)[a-zа-яё]")
    return (F.length(cell) >= 5) & has_letters & (cell.rlike(r"[0-9]") | (F.length(cell) > 20))


def is_position(cell: Column) -> Column:
    return cell.rlike(r"^[0-9]{1,4}$")


ROLE_TESTS = {
    "unit": is_unit, "quantity": is_quantity, "manufacturer": is_manufacturer,
    "name": is_name, "pos": is_position,
}


def select_pages(df: DataFrame, pages: list[int] | None) -> DataFrame:
    """Rows of the listed pages (from 1); pages that do not exist are ignored."""
    return df if pages is None else df.filter(F.col("page").isin(pages))


def filled_cells(cells: DataFrame, keys: list[str] = TABLE_KEYS) -> DataFrame:
    """Non-empty cells with their text stripped."""
    return cells.select(*keys, "row_no", "col_no", text.clean(F.col("text")).alias("text")).filter(
        F.col("text") != ""
    )


def column_scores(cells: DataFrame, keys: list[str] = TABLE_KEYS) -> DataFrame:
    """A1: cells of each column that pass each test (counts are not normalised)."""
    return cells.groupBy(*keys, "col_no").agg(
        *[
            F.sum(F.when(test(F.col("text")), F.lit(1)).otherwise(F.lit(0))).alias(f"{role}_score")
            for role, test in ROLE_TESTS.items()
        ]
    )


def column_roles(scores: DataFrame, keys: list[str] = TABLE_KEYS) -> DataFrame:
    """A2: best column per role, the leftmost on ties; the unit column is no quantity column."""
    def ranked(role: str) -> Column:
        score = F.col(f"{role}_score")
        return F.when(score > 0, F.struct(score.alias("score"), (-F.col("col_no")).alias("neg_col")))

    best = scores.groupBy(*keys).agg(
        *[F.max(ranked(r)).alias(r) for r in ("unit", "manufacturer", "name", "pos")],
        F.sort_array(F.collect_list(ranked("quantity")), asc=False).alias("quantities"),
    )
    unit_col = F.col("unit.neg_col")
    quantity = F.get(
        F.filter("quantities", lambda q: unit_col.isNull() | (q["neg_col"] != unit_col)), 0
    )
    return best.select(
        *keys,
        (-unit_col).alias("unit_col"),
        (-quantity["neg_col"]).alias("quantity_col"),
        (-F.col("manufacturer.neg_col")).alias("manufacturer_col"),
        (-F.col("name.neg_col")).alias("name_col"),
        (-F.col("pos.neg_col")).alias("pos_col"),
    )


def cells_map() -> Column:
    """Texts by column number; of several texts in one cell the last in order."""
    cells = F.array_sort(F.collect_list(F.struct("col_no", "text")))
    return F.map_from_entries(F.filter(cells, lambda cell, i: ~F.coalesce(F.get(cells, i + 1)["col_no"] == cell["col_no"], F.lit(False))))


def wide_rows(cells: DataFrame, keys: list[str] = TABLE_KEYS) -> DataFrame:
    """Rows as a map col_no -> text; a row is as long as its table is wide."""
    return cells.groupBy(*keys, "row_no").agg(
        cells_map().alias("cells")
    )


def _texts(cells: Column) -> Column:
    return F.transform(F.array_sort(F.map_entries(cells)), lambda e: e["value"])


def is_service_row(cells: Column) -> Column:
    """Empty rows, headings and rows of digits only."""
    joined = F.array_join(_texts(cells), " ")
    return (
        (joined == "")
        | joined.rlike(SERVICE_ROW)
        | (joined.rlike(r"(?U)^[0-9\s,]+$") & joined.rlike("[0-9]"))
    )


def _has_service(cells: Column, name_col: Column) -> Column:
    return F.exists(
        F.map_entries(cells),
        lambda e: (e["key"] != name_col)
        & (is_unit(e["value"]) | is_quantity(e["value"]) | is_manufacturer(e["value"])),
    )


def merge_sparse_rows(
    rows: DataFrame, keys: list[str] = TABLE_KEYS, carried: list[str] = ["name_col"],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rows that only continue the row above are merged into it, cell by cell.

    `rows` has the keys, row_no, cells and name_col.  A row starts a group unless it has no name but
    a unit, quantity or manufacturer; of a group's cells the last non-empty one counts.  Groups that
    do not start with a name hold nothing usable and are left out.
    """
    marked = rows.filter(F.size("cells") > 0).withColumns({
        "has_name": F.map_contains_key("cells", F.col("name_col")),
        "has_service": _has_service(F.col("cells"), F.col("name_col")),
    }).withColumn("starts", F.col("has_name") | ~F.col("has_service"))
    grouped = running(
        marked, keys, "row_no", sums={"group_no": F.col("starts").cast("int")}, block_rows=block_rows
    )
    exploded = grouped.select(
        *keys, "group_no", *carried, "row_no",
        (F.col("starts") & F.col("has_name")).alias("opens"),
        F.explode("cells").alias("col_no", "text"),
    )
    cells = exploded.groupBy(*keys, "group_no", "col_no").agg(
        F.max_by("text", "row_no").alias("text"),
        F.bool_or("opens").alias("opens"),
        F.min("row_no").alias("row_no"),
        *[F.first(c).alias(c) for c in carried],
    )
    return cells.groupBy(*keys, "group_no").agg(
        F.min("row_no").alias("row_no"),
        *[F.first(c).alias(c) for c in carried],
        F.bool_or("opens").alias("opens"),
        cells_map().alias("cells"),
    ).filter("opens").drop("opens")


def equipment_lines(
    cells: DataFrame, keys: list[str] = TABLE_KEYS, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cell grid -> equipment lines (roles, service rows, merging, validity, unit lookup)."""
    filled = filled_cells(cells, keys)
    roles = column_roles(column_scores(filled, keys), keys).filter(
        F.col("name_col").isNotNull() & F.col("quantity_col").isNotNull()
    )
    role_columns = ["name_col", "quantity_col", "unit_col", "manufacturer_col"]
    rows = wide_rows(filled, keys).filter(~is_service_row(F.col("cells")))
    rows = rows.join(spread(roles.select(*keys, *role_columns), *keys), keys)
    merged = merge_sparse_rows(rows, keys, role_columns, block_rows)
    return equipment_columns(merged.filter(~is_service_row(F.col("cells"))), keys)


def equipment_columns(rows: DataFrame, keys: list[str]) -> DataFrame:
    """P4 and F-Q10 on merged rows: raw_name, model, manufacturer, unit, quantity."""
    def cell(col: str) -> Column:
        return F.coalesce(F.try_element_at("cells", F.col(col)), F.lit(""))

    taken = F.array("name_col", "quantity_col", "manufacturer_col")
    spare = F.filter(
        F.array_sort(F.map_entries("cells")),
        lambda e: ~F.coalesce(F.array_contains(taken, e["key"]), F.lit(False)) & is_unit(e["value"]),
    )
    picked = rows.select(
        *keys, "row_no",
        cell("name_col").alias("raw_name"),
        F.lit("").alias("model"),
        cell("manufacturer_col").alias("manufacturer"),
        F.coalesce(
            F.when(cell("unit_col") != "", cell("unit_col")), F.get(spare, 0)["value"], F.lit("шт")
        ).alias("unit"),
        cell("quantity_col").alias("quantity"),
    )
    return picked.filter(
        (F.col("raw_name") != "")
        & (F.col("quantity") != "")
        & ~F.col("raw_name").rlike(r"(?U)^[0-9]+(?:[,\s][0-9]+)*$")
    )


# --- project sheets ---------------------------------------------------------------------------


def is_header_cell(cell: Column) -> Column:
    return F.contains(F.lower(cell), F.lit("наименование"))


def header_role(cell: Column) -> Column:
    """F-Q9: role a header cell stands for; the first test that holds wins."""
    low = F.lower(cell)

    def has(word: str) -> Column:
        return F.contains(low, F.lit(word))

    return (
        F.when(has("наименование"), F.lit("name"))
        .when(low.rlike(r"(?U)\bтип\b|марка|обозначение"), F.lit("model"))
        .when(has("ед") & has("изм"), F.lit("unit"))
        .when(has("кол") & has("во"), F.lit("quantity"))
        .when(has("поз"), F.lit("pos"))
    )


def project_sheets(cells: DataFrame, keys: list[str]) -> DataFrame:
    """P5: keys of sheets with a project-specification marker below the first row."""
    marker = classify.any_contains(F.lower("text"), fv.PROJECT_SHEET_MARKERS)
    first = cells.groupBy(*keys).agg(
        F.min("row_no").alias("first_row"), F.max(F.when(marker, F.col("row_no"))).alias("marked_row")
    )
    return first.filter(F.col("marked_row") > F.col("first_row")).select(*keys)


def header_columns(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Header rows with the column of each role (the last column on several)."""
    roles = cells.withColumn("role", header_role(F.col("text")))
    return roles.groupBy(*keys, "row_no").agg(
        F.bool_or(is_header_cell(F.col("text"))).alias("is_header"),
        *[
            F.max(F.when(F.col("role") == r, F.col("col_no"))).alias(f"{r}_col")
            for r in ("name", "model", "unit", "quantity")
        ],
        cells_map().alias("cells"),
    )


def carry_headers(
    rows: DataFrame, keys: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Data rows with the header columns of the last header row above them.

    `rows` has the keys, row_no, is_header, the four role columns and cells.  Rows before the first
    header and rows under a header without name, unit or quantity are dropped, header rows too.
    """
    header = F.struct("name_col", "model_col", "unit_col", "quantity_col")
    carried = running(
        rows.select(*keys, "row_no", "is_header", "cells", F.when(F.col("is_header"), header).alias("own")),
        keys, "row_no", lasts={"header": F.col("own")}, block_rows=block_rows,
    )
    return carried.filter(
        ~F.col("is_header")
        & F.col("header.name_col").isNotNull()
        & F.col("header.unit_col").isNotNull()
        & F.col("header.quantity_col").isNotNull()
    ).select(*keys, "row_no", "cells", "header.*")


def sheet_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Usable lines under their headers, not yet deduplicated."""
    def cell(col: str) -> Column:
        return text.clean(F.try_element_at("cells", F.col(col)))

    picked = rows.select(
        *keys, "row_no",
        cell("name_col").alias("item"),
        text.clean_model(cell("model_col")).alias("model"),
        text.canonical_unit(cell("unit_col")).alias("unit"),
        text.number_or(cell("quantity_col"), 0.0).alias("quantity"),
    ).filter((F.col("item") != "") & (F.col("unit") != "") & (F.col("quantity") != 0))
    return picked.select(
        *keys, "row_no", text.name_with_model(F.col("item"), F.col("model")).alias("name"),
        "unit", "quantity",
    )


def first_per_name(lines: DataFrame, keys: list[str]) -> DataFrame:
    """First line per name and unit within a sheet; later quantities are dropped, not added.

    An aggregation, so a sheet with very many repeats is reduced before rows are exchanged.
    """
    name_key = F.lower(F.regexp_replace("name", r"(?U)\s+", " "))
    rest = [c for c in lines.columns if c not in keys]
    kept = lines.groupBy(*keys, name_key.alias("_name"), F.lower("unit").alias("_unit")).agg(
        F.min_by(F.struct(*rest), "row_no").alias("row")
    )
    return kept.select(*keys, "row.*")


def project_sheet_lines(
    cells: DataFrame, keys: list[str] = ["doc_id"], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Project sheet cells -> specification lines."""
    filled = filled_cells(cells, keys)
    rows = carry_headers(header_columns(filled, keys), keys, block_rows)
    lines = first_per_name(sheet_lines(rows, keys), keys)
    return lines.select(
        *keys, F.col("row_no").alias("line_no"), "name", F.lit("").alias("size"), "unit",
        F.col("quantity").cast("string").alias("quantity"),
        F.lit("").alias("material"), F.lit("").alias("thickness"),
    )


# --- text lines ---------------------------------------------------------------------------------

_SIZE = r"(?:[0-9]{2,5}(?:\s*[xх×*]\s*[0-9]{2,5})?|\b[dDдД][Nn]?\s*[0-9]{2,5}|\bФ\s*[0-9]{2,5})"
_TAIL = rf"({_SIZE})\s+(м|шт|м2|м²|шт\.|шток|pcs|pc|m)\s+([0-9]+(?:[.,][0-9]+)?)"
# Anchoring is exact, as a name may start anywhere, and keeps long lines linear.
WIDE_GAP_LINE = r"(?iuU)^(.+?)\s{2,}" + _TAIL
ANY_LINE = r"(?iuU)^(.+?)\s+" + _TAIL
LINE_TAIL = r"(?iuU)\s" + _TAIL


def text_spec_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """F-Q8, P13: lines of plain text that read as name, size, unit, quantity."""
    candidates = lines.select(*keys, text.strip(F.col("text")).alias("line")).filter(
        (F.length("line") >= 5) & F.col("line").rlike(LINE_TAIL)
    )
    line = F.col("line")
    wide = line.rlike(WIDE_GAP_LINE)

    def part(group: int) -> Column:
        return F.when(wide, F.regexp_extract(line, WIDE_GAP_LINE, group)).otherwise(
            F.regexp_extract(line, ANY_LINE, group)
        )

    parts = candidates.filter(wide | line.rlike(ANY_LINE)).select(
        *keys,
        F.btrim(part(1), F.lit(" -;:")).alias("name"),
        text.strip(part(2)).alias("size"),
        F.lower(text.strip(part(3))).alias("unit"),
        text.number_or(part(4), 0.0).alias("quantity"),
        text.number_or(
            F.regexp_extract(line, r"(?iuU)([0-9]+(?:[.,][0-9]+)?)\s*мм", 1), fv.DEFAULT_THICKNESS
        ).alias("thickness"),
    )
    low = F.lower("name")
    return parts.withColumn(
        "material",
        F.when(F.contains(low, F.lit("нерж")), F.lit("нержавеющая"))
        .when(F.contains(low, F.lit("черн")), F.lit("черная"))
        .otherwise(F.lit(fv.DEFAULT_MATERIAL)),
    )


def table_or_text(
    table_lines: DataFrame, tables: DataFrame, text_lines: DataFrame, keys: list[str]
) -> DataFrame:
    """U4: lines of tables, plus text lines of documents in which no table was found at all.

    `tables` lists the documents with a table, by the document keys.
    """
    without = text_lines.join(spread(tables.select(*keys).distinct(), *keys), keys, "left_anti")
    return table_lines.unionByName(without, allowMissingColumns=True)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all selected tables, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
