"""The three jobs: specification files, equipment documents, price search (E1..E3)."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.operators import equipment, export, grid, prices, schema, spec_lines
from ductlake.session import spread
from ductlake.sinks import writers
from ductlake.sources import dimensions as dim
from ductlake.sources.spec_files import workbook_spec_rows

# Room for the numbers of an equipment document's lines: a line's number tells its page, table and row.
TABLES_A_PAGE = 1_000
ROWS_A_TABLE = 10_000_000


@dataclass
class SpecResult:
    """All lines with their status, and the frames made of them.

    The frames are lazy; while they are built, the given dimension tables are counted (a few rows each).
    """

    parsed: DataFrame
    orders: DataFrame
    skipped: DataFrame
    documents: DataFrame


def process_spec_lines(
    lines: DataFrame,
    headers: DataFrame | None = None,
    allowed: DataFrame | None = None,
    materials: DataFrame | None = None,
    products: DataFrame | None = None,
    defaults: spec_lines.SpecDefaults = spec_lines.SpecDefaults(),
) -> SpecResult:
    """Specification lines with order_id and line_no -> orders, skipped lines, XML.

    The classified lines feed several outputs; a caller who writes more than one of them should
    persist `parsed` or write it as a table first.  `documents` are fragments (order_id, fragment_no),
    one for an ordinary order; `export.whole_documents` puts those of moderate orders together.
    """
    spark: SparkSession = lines.sparkSession
    allowed = dim.builtin_allowed(spark) if allowed is None else allowed
    materials = dim.builtin_materials(spark) if materials is None else materials
    products = dim.builtin_products(spark) if products is None else products
    checked = allowed if allowed.limit(1).count() else None  # an empty list checks nothing
    parsed = spec_lines.parse_spec_lines(lines, checked, materials, defaults)
    orders = spec_lines.order_lines(parsed, "order_id", "line_no")
    skipped = spec_lines.skipped_lines(parsed, "order_id", "line_no")
    documents = export.order_xml(export.with_characteristic(orders, products), headers, export.FRAGMENT_LINES)
    return SpecResult(parsed, orders, skipped, documents)


def equipment_to_spec(
    cells: DataFrame, pages: list[int] | None = None, rules: list[dict] | DataFrame | None = None,
    keys: list[str] = grid.TABLE_KEYS,
) -> DataFrame:
    """Cell grids -> mapped equipment lines with their status."""
    lines = grid.equipment_lines(grid.select_pages(cells, pages), keys)
    return equipment.map_equipment(lines, rules)


def sheet_lines(cells: DataFrame, keys: list[str] = ["doc_id"]) -> DataFrame:
    """P5: cells of sheets of both kinds -> specification lines; a sheet with a project marker is read by its own headers.

    The cell form of what the file reader decides while it reads.
    """
    filled = grid.filled_cells(cells, keys)
    marked = spread(grid.project_sheets(filled, keys), *keys)
    project = grid.project_sheet_lines(filled.join(marked, keys, "left_semi"), keys)
    tables = workbook_spec_rows(filled.join(marked, keys, "left_anti"), keys)
    columns = [*keys, "line_no", *schema.TARGETS]
    return tables.select(*columns).unionByName(schema.spec_rows(project.select(*columns)))


def document_lines(
    cells: DataFrame, text_lines: DataFrame, pages: list[int] | None = None, keys: list[str] = grid.TABLE_KEYS,
) -> DataFrame:
    """Specification lines of documents: of all their tables, or of their text where no table was found.

    `cells` are table cells (keys, row_no, col_no, text) with a header row each, `text_lines` lines of pages
    (doc_id, page, line_no, text).
    """
    chosen = grid.select_pages(cells, pages)
    tables = workbook_spec_rows(chosen, keys)
    numbered = tables.select("doc_id", "page", *[k for k in keys if k not in ("doc_id", "page")], "line_no", *schema.TARGETS)
    text = grid.text_spec_lines(grid.select_pages(text_lines, pages), ["doc_id", "page", "line_no"])
    return grid.table_or_text(numbered, chosen, text, ["doc_id"])


@dataclass
class EquipmentResult:
    """Mapped lines with their status, the orders made of them, and all that was skipped on the way."""

    mapped: DataFrame
    spec: SpecResult
    skipped: DataFrame


def process_equipment(
    cells: DataFrame, pages: list[int] | None = None, rules: list[dict] | DataFrame | None = None,
    keys: list[str] = grid.TABLE_KEYS, **options,
) -> EquipmentResult:
    """Equipment tables -> orders (one a document); lines skipped by the rules and by the parser together.

    `options` go to `process_spec_lines`.
    """
    mapped = equipment_to_spec(cells, pages, rules, keys)
    place = [F.col(k).cast("long") for k in ("page", "table_no") if k in keys]
    line_no = F.col("row_no") + (reduce(lambda a, b: a * TABLES_A_PAGE + b, place) * ROWS_A_TABLE if place else F.lit(0))
    numbered = mapped.withColumns({"order_id": F.col("doc_id"), "line_no": line_no})
    result = process_spec_lines(equipment.mapped_lines(numbered).drop(*keys, "row_no", "detected_category", "detected_article", "source_raw_name", "source_model"), **options)
    skipped = schema.all_skipped(result.skipped, equipment.unmapped_lines(numbered, "order_id", "line_no"))
    return EquipmentResult(mapped, result, skipped)


def search_prices(
    skipped: DataFrame,
    history: DataFrame,
    answers: DataFrame,
    as_of: datetime | str,
    fallback: DataFrame | None = None,
    sources: list[str] | None = None,
    min_offers: int = fv.DEFAULT_MIN_OFFERS,
    max_age_days: int = fv.DEFAULT_MAX_AGE_DAYS,
    force_refresh: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Skipped lines -> (offers answered from the history, offers found by the staged search).

    Answers without a required field or with a negative price (P14) take no part.
    """
    answers = prices.valid_offers(answers)
    fallback = None if fallback is None else prices.valid_offers(fallback)
    items = (
        schema.price_items(skipped)
        .select(F.col("name").alias("item_name"), F.col("size").alias("item_size"))
        .distinct()
    )
    cached = prices.cached_answers(items, history, as_of, min_offers, max_age_days)
    if force_refresh:
        return cached.limit(0), prices.kept_offers(
            prices.search(items, answers, fallback, sources, min_offers)
        )
    known = prices.items_in_cache(history, as_of, min_offers, max_age_days).select(*prices.ITEM_KEYS)
    missing = items.join(known, prices.ITEM_KEYS, "left_anti")
    found = prices.search(missing, answers, fallback, sources, min_offers)
    return cached, prices.kept_offers(found)


def run_price_job(skipped: DataFrame, history_path: str, answers: DataFrame, as_of: datetime | str, run_path: str, **options) -> tuple[DataFrame, DataFrame]:
    """E3 with its write-back (K3): (cached, found) as tables under `run_path`; what was found is in the history then.

    Results are written before the history grows, as both depend on what it held.  `options` go to
    `search_prices`; an answer without a time of its own was read at `as_of`.
    """
    spark = skipped.sparkSession
    history = spark.read.parquet(history_path)
    parts = search_prices(skipped, history, answers, as_of, **options)
    cached, found = parts
    if "scraped_at" not in found.columns:
        found = found.withColumn("scraped_at", F.lit(as_of).cast("timestamp"))
    for name, part in (("cached", cached), ("found", found)):
        part.write.parquet(f"{run_path}/{name}")
    cached, found = (spark.read.parquet(f"{run_path}/{name}") for name in ("cached", "found"))
    if not found.isEmpty():
        kept = [c for c in history.columns if c in found.columns and c != "scraped_on"]
        writers.append_history(found.select(*kept), history_path)
    return cached, found
