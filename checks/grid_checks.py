"""Registered queries over cell grids, headers, text lines, rules, catalogue, export and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import spec_oracle as o
from checks.load import load, table
from checks.spec_checks import _lines, _parsed, params_text
from ductlake import fixed_values as fv
from ductlake.functions import classify
from ductlake.functions import matching as m
from ductlake.functions.size import description_dimensions
from ductlake.operators import blocks, catalogue, equipment, export, grid, reports, schema
from ductlake.sources import dimensions as dim

BLOCK = 500  # small blocks, so that the given tables span many of them


# --- grids ------------------------------------------------------------------------------------

_ROLE_CELLS = """
SELECT CAST(p_partkey % 40 AS BIGINT) AS table_no, p_partkey AS row_no, CAST(c AS INT) AS col_no,
  CASE (c + p_partkey % 40 % 3) % 5
    WHEN 0 THEN concat(p_name, ' ', p_brand) WHEN 1 THEN CASE WHEN p_size % 2 = 0 THEN 'шт' ELSE 'м' END
    WHEN 2 THEN replace(CAST(p_size + 0.5 AS STRING), '.', ',') WHEN 3 THEN CASE WHEN p_size % 3 = 0 THEN 'SYSTEMAIR' ELSE '' END
    ELSE CAST(p_partkey AS STRING) END AS text
FROM {part} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS cols
"""


def column_roles(spark, sf):
    cells = grid.filled_cells(load(spark, sf, _ROLE_CELLS), ["table_no"])
    roles = grid.column_roles(grid.column_scores(cells, ["table_no"]), ["table_no"])
    return roles.select("table_no", *[F.col(c).cast("int").alias(c) for c in roles.columns if c != "table_no"])


def _sparse_rows(spark, sf):
    wide = load(spark, sf, fx.SPARSE)
    cells = F.map_filter(
        F.create_map(*[x for i in range(3) for x in (F.lit(i), F.col(f"c{i}"))]), lambda _, v: v != ""
    )
    return wide.select("table_no", "row_no", cells.alias("cells"), F.lit(0).alias("name_col"))


def sparse_row_merge(spark, sf):
    merged = grid.merge_sparse_rows(_sparse_rows(spark, sf), ["table_no"], block_rows=BLOCK)
    return merged.select(
        "table_no", "row_no", *[F.try_element_at("cells", F.lit(i)).alias(f"c{i}") for i in range(3)]
    )


def equipment_rows(spark, sf):
    rows = _sparse_rows(spark, sf).filter(~grid.is_service_row(F.col("cells"))).withColumns({
        "quantity_col": F.lit(1), "unit_col": F.lit(None).cast("int"), "manufacturer_col": F.lit(None).cast("int"),
    })
    roles = ["name_col", "quantity_col", "unit_col", "manufacturer_col"]
    merged = grid.merge_sparse_rows(rows, ["table_no"], roles, block_rows=BLOCK)
    return grid.equipment_columns(merged.filter(~grid.is_service_row(F.col("cells"))), ["table_no"])


_SHEET = """
SELECT CAST(user_id AS BIGINT) AS doc_id, event_id AS row_no, event_type, value,
  CASE WHEN event_type = 'error' THEN 'Наименование' WHEN event_id % 7 = 0 THEN '' ELSE concat('Клапан  ', CAST(event_id % 50 AS STRING)) END AS k0,
  CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'Прим.' ELSE 'Ед. изм.' END WHEN event_id % 3 = 0 THEN 'шт.' ELSE ' М ' END AS k1,
  CASE WHEN event_type = 'error' THEN 'Кол-во' WHEN event_id % 11 = 0 THEN 'нет' ELSE replace(CAST(value AS STRING), '.', ',') END AS k2,
  CASE WHEN event_type = 'error' THEN 'Тип, марка' WHEN event_id % 4 = 0 THEN 'ГОСТ 14918' WHEN event_id % 4 = 1 THEN concat('клапан  ', CAST(event_id % 50 AS STRING)) ELSE concat('RVN-', CAST(event_id % 9 AS STRING)) END AS k3
FROM {events}
"""


def _sheet_cells(spark, sf):
    wide = load(spark, sf, _SHEET)
    return wide.select(
        "doc_id", "row_no",
        F.posexplode(F.array(*[F.when(F.col(f"k{i}") != "", F.col(f"k{i}")) for i in range(4)])).alias("col_no", "text"),
    )


def header_carry_forward(spark, sf):
    cells = grid.filled_cells(_sheet_cells(spark, sf), ["doc_id"])
    rows = grid.carry_headers(grid.header_columns(cells, ["doc_id"]), ["doc_id"], block_rows=BLOCK)
    return grid.sheet_lines(rows, ["doc_id"])


def first_wins_dedupe(spark, sf):
    lines = grid.project_sheet_lines(_sheet_cells(spark, sf), ["doc_id"], block_rows=BLOCK)
    return lines.select("doc_id", "line_no", "name", "unit", F.col("quantity").cast("double").alias("quantity"))


# Equipment tables of five columns, turned by table: name, quantity, unit, manufacturer, position; some rows continue
# the one above, some are headings, and a table lies on one of five pages.
_EQUIPMENT_GRID = """
SELECT p_partkey % 8 AS table_no, p_partkey % 8 % 5 + 1 AS page, p_partkey AS row_no, p_partkey % 8 % 5 AS turn,
  CASE WHEN p_partkey % 91 = 0 THEN 'ОБОРУДОВАНИЕ' WHEN p_size % 6 = 5 THEN '' ELSE concat(p_name, ' ', p_brand) END AS k0,
  CASE WHEN p_partkey % 91 = 0 OR p_size % 7 = 3 THEN '' ELSE replace(CAST(p_size + 0.5 AS STRING), '.', ',') END AS k1,
  CASE WHEN p_partkey % 91 = 0 OR p_size % 6 = 2 THEN '' WHEN p_size % 2 = 0 THEN 'шт' ELSE 'м' END AS k2,
  CASE WHEN p_partkey % 91 <> 0 AND p_size % 3 = 0 THEN 'SYSTEMAIR' ELSE '' END AS k3,
  CASE WHEN p_partkey % 91 <> 0 AND p_size % 9 = 1 THEN CAST(p_partkey % 1000 AS STRING) ELSE '' END AS k4
FROM {part}
"""


def equipment_document(spark, sf):
    """Cells of whole tables to equipment lines: roles, headings, continued rows and validity, for the listed pages."""
    wide = load(spark, sf, _EQUIPMENT_GRID)
    places = F.array(*[F.struct(((F.lit(i) + F.col("turn")) % 5).cast("int").alias("col_no"), F.col(f"k{i}").alias("text")) for i in range(5)])
    cells = wide.select("table_no", "page", "row_no", F.inline(places))
    lines = grid.equipment_lines(grid.select_pages(cells, [1, 2, 4, 9]), ["page", "table_no"], block_rows=BLOCK)
    return lines.select("page", "table_no", "row_no", "raw_name", "model", "manufacturer", "unit", "quantity")


def free_header_lines(spark, sf):
    """Tables with free headers to specification lines with defaults."""
    rows = load(spark, sf, """SELECT s_suppkey AS row_no, s_name AS `Наименование / изделие`, CASE s_suppkey % 4 WHEN 0 THEN ' DN150 ' WHEN 1 THEN '100x200' WHEN 2 THEN 'сечение Ф 160' END AS `Размер`,
        CASE WHEN s_suppkey % 3 = 0 THEN ' компл ' END AS `Ед.изм`, CASE s_suppkey % 5 WHEN 0 THEN 'нет' WHEN 1 THEN '2,5' ELSE CAST(s_nationkey AS STRING) END AS `Кол-во`,
        CAST(NULL AS STRING) AS `Материал`, CASE WHEN s_suppkey % 2 = 0 THEN '0,9' ELSE 'x' END AS `Толщина_мм` FROM {supplier}""")
    return schema.spec_rows(schema.normalise_columns(rows, ["row_no"]))


def edited_rows(spark, sf):
    """Rows edited by hand, with their keys and texts as typed."""
    rows = load(spark, sf, """SELECT c_custkey AS ` ID `, concat('  ', c_name, ' ') AS `Name`, CASE c_custkey % 3 WHEN 0 THEN concat('{"D0": ', CAST(c_custkey % 900 AS STRING), '}') WHEN 1 THEN '{oops' END AS `Params`,
        CASE c_custkey % 4 WHEN 0 THEN '3' WHEN 1 THEN ' 2,5 ' WHEN 2 THEN 'x' END AS `Quantity`, CASE c_custkey % 5 WHEN 0 THEN '1.2' WHEN 1 THEN '' ELSE 'abc' END AS `thickness ` FROM {customer}""".replace('{"D0"', '{{"D0"').replace("'}'", "'}}'").replace("'{oops'", "'{{oops'"))
    return schema.editor_rows(rows).select("id", "name", params_text(F.col("params")).alias("params"), "quantity", "thickness")


def page_selection(spark, sf):
    lines = load(spark, sf, "SELECT l_orderkey, l_linenumber AS page, l_quantity FROM {lineitem}")
    return grid.select_pages(lines, [1, 3, 99]).groupBy("page").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("double").alias("quantity"))


_HEADER_CELLS = """
SELECT l_orderkey AS table_no, l_linenumber AS col_no, CASE min(l_partkey) % 12
    WHEN 0 THEN 'Наименование' WHEN 1 THEN 'Размер сечения' WHEN 2 THEN 'Ед.изм' WHEN 3 THEN 'Кол-во'
    WHEN 4 THEN 'Материал' WHEN 5 THEN 'Толщина, мм' WHEN 6 THEN 'Изделие' WHEN 7 THEN 'qty'
    WHEN 8 THEN 'Сталь_мм' WHEN 9 THEN 'Примечание' WHEN 10 THEN 'Диаметр | мм' ELSE '№' END AS text
FROM {lineitem} GROUP BY l_orderkey, l_linenumber
"""


def header_keyword_map(spark, sf):
    given = schema.map_header_cells(load(spark, sf, _HEADER_CELLS), ["table_no"])
    return given.groupBy("target", "col_no").agg(F.count(F.lit(1)).alias("n"), F.sum("table_no").alias("tables"))


_TEXT_LINES = """
SELECT p_partkey AS doc_id, 1 AS line_no, concat(p_name, CASE p_partkey % 3 WHEN 0 THEN '  ' ELSE ' ' END,
    CASE p_partkey % 4 WHEN 0 THEN 'D' WHEN 1 THEN 'Ф ' ELSE '' END, CAST(p_size * 10 + 100 AS STRING),
    CASE p_partkey % 5 WHEN 0 THEN ' М ' WHEN 1 THEN ' шт. ' WHEN 2 THEN ' кг ' ELSE ' шт ' END, CAST(p_size AS STRING),
    CASE p_partkey % 6 WHEN 0 THEN ',5 0,7 мм' ELSE '' END) AS text FROM {part}
"""


# A table of each even part: its lines are what the union keeps of that part.
_TABLE_LINES = """
SELECT p_partkey AS doc_id, p_name AS name, concat('D', CAST(p_size * 10 AS STRING)) AS size, 'шт' AS unit, CAST(p_size AS DOUBLE) AS quantity,
  CAST(0.5 AS DOUBLE) AS thickness, 'черная' AS material FROM {part} WHERE p_partkey % 2 = 0 AND p_size % 3 > 0
"""


def text_line_fallback(spark, sf):
    """Lines of documents (hardly any matches) and of part texts; documents of even parts have a table, some an empty one."""
    docs = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    )
    parts = load(spark, sf, _TEXT_LINES)
    lines = grid.union_all([docs, parts])
    parsed = grid.text_spec_lines(lines, ["doc_id"])
    tables = load(spark, sf, "SELECT p_partkey AS doc_id FROM {part} WHERE p_partkey % 2 = 0")
    return grid.table_or_text(load(spark, sf, _TABLE_LINES), tables, parsed, ["doc_id"])


# --- rules --------------------------------------------------------------------------------------

_EQUIPMENT = """
SELECT p_partkey AS line_no, CASE p_partkey % 16
    WHEN 0 THEN 'Шумоглушитель прямоугольный' WHEN 1 THEN 'Фильтр карманный' WHEN 2 THEN 'Вставка кассетная фильтрующая'
    WHEN 3 THEN 'Обратный клапан' WHEN 4 THEN 'Заслонка' WHEN 5 THEN 'Решетка наружная' WHEN 6 THEN 'Монтажный стакан'
    WHEN 7 THEN 'Клапан противопожарный' WHEN 8 THEN 'Вентилятор канальный' WHEN 9 THEN 'Узел' WHEN 10 THEN 'Изделие'
    WHEN 11 THEN 'Корпус фильтра' WHEN 12 THEN 'Изделие msn' WHEN 13 THEN 'Ограждение кровли' WHEN 14 THEN 'Клапан воздушный' ELSE 'Диффузор' END AS raw_name,
  CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN concat('NKD ', CAST(p_size * 10 + 100 AS STRING)) WHEN 2 THEN concat('RVN-', CAST(p_size * 10 + 100 AS STRING))
    WHEN 3 THEN concat(CAST(p_size * 20 + 100 AS STRING), 'х', CAST(p_size * 10 + 100 AS STRING)) WHEN 4 THEN concat('DFPM', CAST(p_size * 10 + 100 AS STRING))
    WHEN 5 THEN concat('MSN-', CAST(p_size * 10 + 100 AS STRING)) ELSE concat('PPK ', CAST(p_size * 10 + 100 AS STRING)) END AS model,
  CASE p_partkey % 3 WHEN 0 THEN '' ELSE 'шт' END AS unit, CAST(p_size AS STRING) AS quantity
FROM {part}
"""


def rule_category_match(spark, sf):
    mapped = equipment.map_equipment(load(spark, sf, _EQUIPMENT))
    return mapped.select(
        "line_no", "status", "name", "size", "unit", "article", params_text(F.col("params")).alias("params"),
        "detected_category", "reason",
    )


# --- export, catalogue, reports -------------------------------------------------------------------


def _ordered(spark, sf):
    p = _parsed(spark, _lines(spark, sf)).filter(F.col("status") == "order")
    return export.with_characteristic(p, dim.builtin_products(spark))


def characteristic(spark, sf):
    return _ordered(spark, sf).select("line_no", "article", "characteristic", "error", "product_name")


def order_xml(spark, sf):
    headers = load(spark, sf, "SELECT CAST(c_custkey AS BIGINT) AS order_id, c_name AS customer, concat('A&', c_mktsegment) AS contact FROM {customer}")
    return export.order_xml(_ordered(spark, sf), headers, fragment_lines=1000)


# Products with computed values and lines of them; the last kind's expression is not allowed.
_COMPUTED = """
SELECT concat('P', CAST(p_partkey AS STRING)) AS article, p_name AS name, CASE WHEN p_size % 2 = 0 THEN 'round' ELSE 'rectangular' END AS section,
  array('A0', 'D0', 'R0', 'U0') AS xml_parameters,
  map('R0', CASE p_partkey % 6 WHEN 0 THEN 'D0 * 1.5' WHEN 1 THEN 'max(A0, B0, 60) / 2' WHEN 2 THEN 'A0 + D0 * 2' WHEN 3 THEN 'round(D0 / 3)' WHEN 4 THEN '-A0 ** 2 + min(D0, 70)' ELSE 'open(D0)' END,
    'U0', CASE p_partkey % 6 WHEN 2 THEN '(R0 - 3) // 7 % 5' ELSE '90' END) AS default_params,
  CASE WHEN p_partkey % 4 = 0 THEN map('U0', 'U0 / 4 + 1') ELSE map() END AS force_params
FROM {part}
"""
_COMPUTED_LINES = """
SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS part, CAST(l_quantity * 10 AS DOUBLE) AS d0, CAST(l_linenumber * 100 AS DOUBLE) AS a0,
  CASE WHEN l_linenumber % 2 = 0 THEN CAST(50 AS DOUBLE) END AS b0, CASE WHEN l_linenumber = 5 THEN CAST(7 AS DOUBLE) END AS r0 FROM {lineitem}
"""


def default_expressions(spark, sf):
    lines = load(spark, sf, _COMPUTED_LINES)
    given = F.map_filter(F.create_map(*[x for p in ("A0", "B0", "D0", "R0") for x in (F.lit(p), F.col(p.lower()))]), lambda _, v: v.isNotNull())
    lines = lines.select("order_id", "line_no", F.concat(F.lit("P"), F.col("part").cast("string")).alias("article"), given.alias("params"))
    return export.with_characteristic(lines, load(spark, sf, _COMPUTED)).select(
        "order_id", "line_no", "article", "characteristic", F.split("error", ":")[0].alias("error"))


def connection_codes(spark, sf):
    names = load(spark, sf, """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN ' Бандаж ' WHEN 1 THEN 'без соед' WHEN 2 THEN 'Б/С' WHEN 3 THEN 'ниппель'
        WHEN 4 THEN 'Фланец' WHEN 5 THEN 'шина/уголок' WHEN 6 THEN 'шина' WHEN 7 THEN 'рейка' WHEN 8 THEN '' WHEN 9 THEN '7' WHEN 10 THEN '9' ELSE 'фланец  (пр)' END AS conn,
        CASE p_size % 2 WHEN 0 THEN 'round' ELSE 'rectangular' END AS section FROM {part}""")
    return names.select("p_partkey", classify.connection_code(F.col("conn"), F.col("section")).alias("code"))


_DESCRIPTION = f"SELECT concat(name, ' ', size) AS description FROM ({fx.SPEC_LINE}) AS s"


def catalogue_match_score(spark, sf):
    texts = load(spark, sf, _DESCRIPTION)
    return catalogue.match_descriptions(texts, dim.builtin_products(spark), top_n=5, with_similarity=False)


def catalogue_match_full(spark, sf):
    texts = load(spark, sf, _DESCRIPTION)
    return catalogue.match_descriptions(texts, dim.builtin_products(spark), top_n=5)


def description_dims(spark, sf):
    d = description_dimensions(F.col("description"))
    return load(spark, sf, _DESCRIPTION).distinct().select(
        "description", m.normalise(F.col("description")).alias("norm"),
        *[d[n].alias(n.lower()) for n in ("A0", "B0", "D0", "L0", "P0")],
    )


def reconcile(spark, sf):
    manual = load(spark, sf, "SELECT l_returnflag AS article, CAST(l_quantity AS BIGINT) AS quantity FROM {lineitem} WHERE l_linestatus = 'F'")
    parsed = load(spark, sf, "SELECT CASE WHEN l_returnflag = 'R' THEN 'X' ELSE l_returnflag END AS article, CAST(l_quantity AS BIGINT) AS quantity FROM {lineitem} WHERE l_linestatus = 'O'")
    return reports.reconcile(manual, parsed)


def parameter_usage(spark, sf):
    parts = load(spark, sf, "SELECT p_brand AS article, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) * 7919 AS number, split(p_name, ' ') AS xml_parameters FROM {part}")
    return reports.parameter_usage(parts, "number")


_ENTRIES = """
SELECT concat('N', CAST(n_nationkey AS STRING)) AS code, n_name AS name, CAST(NULL AS STRING) AS parent_code, true AS is_group, false AS is_deleted FROM {nation}
UNION ALL SELECT concat('S', CAST(s_suppkey AS STRING)), s_name, concat('N', CAST(s_nationkey + 2 AS STRING)), false, s_suppkey % 9 = 0 FROM {supplier}
"""


def catalogue_list(spark, sf):
    return reports.catalogue_list(load(spark, sf, _ENTRIES))


def catalogue_columns(spark, sf):
    entries = load(spark, sf, f"SELECT *, concat('ед', code) AS unit, length(name) AS weight FROM ({_ENTRIES}) AS e")
    return reports.catalogue_list(entries, "unit", "weight")


def first_entries(spark, sf):
    return reports.first_entries(load(spark, sf, _ENTRIES), 50)


def connection_list(spark, sf):
    return reports.connection_list(load(spark, sf, "SELECT n_nationkey AS code, n_name AS name, n_regionkey AS section, n_nationkey % 6 = 0 AS is_deleted FROM {nation}"))


def like_search(spark, sf):
    return reports.name_like(spark, load(spark, sf, "SELECT c_custkey AS code, c_name AS name FROM {customer}"), "%1_5%", 20)


def nested_orders(spark, sf):
    orders = load(spark, sf, "SELECT o_orderkey AS order_id, o_orderdate AS order_date, o_custkey AS customer, o_orderstatus = 'F' AS posted FROM {orders}")
    lines = load(spark, sf, "SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product, CAST(l_quantity AS BIGINT) AS quantity FROM {lineitem}")
    last = reports.last_orders(orders, lines, 10)
    return last.select(
        "order_id", "order_date", "customer",
        F.coalesce(reports.nested_lines_text(F.col("lines"), "line_no", "product", "quantity"), F.lit("")).alias("lines"),
    )


_MODULE = """
SELECT conv_id, turn * 4 AS line_no, concat('  ИначеЕсли ПродуктШапка = Справочники.асПродукция.П', CAST(conv_id AS STRING), '_', CAST(turn AS STRING), ' Тогда // ', role) AS text FROM {conversations} WHERE role <> 'assistant'
UNION ALL SELECT conv_id, turn * 4 + 1, CASE turn % 3 WHEN 0 THEN 'Обозначение = "Ф" + D_ + "-" + L_ + d1_;' WHEN 1 THEN 'Обозначение = A_ + "x" + B_ + "-" + u;' ELSE 'КонецЕсли;' END FROM {conversations}
UNION ALL SELECT conv_id, turn * 4 + 2, concat('АртикулГруппы = "', CAST(conv_id % 9 AS STRING), '";') FROM {conversations}
UNION ALL SELECT conv_id, turn * 4 + 3, CASE WHEN turn % 2 = 0 THEN concat('АртикулПродукции = "', CAST(conv_id AS STRING), '-', CAST(turn AS STRING), '";') ELSE text END FROM {conversations}
"""


def block_assembly(spark, sf):
    found = blocks.product_blocks(load(spark, sf, _MODULE), ["conv_id"], block_rows=5)
    return found.withColumn("xml_parameters", F.array_join("xml_parameters", ","))


QUERIES = {
    f.__name__: f for f in (
        column_roles, sparse_row_merge, equipment_rows, header_carry_forward, first_wins_dedupe,
        header_keyword_map, text_line_fallback, rule_category_match, characteristic, order_xml, default_expressions,
        equipment_document, free_header_lines, edited_rows, page_selection, catalogue_columns,
        connection_codes, catalogue_match_score, catalogue_match_full, description_dims, reconcile,
        parameter_usage, catalogue_list, first_entries, connection_list, like_search, nested_orders,
        block_assembly,
    )
}

_NW = o._NW
_SP = fx.for_oracle(fx.SPARSE)
_UNITQ = "(c1 <> '' OR c2 = 'шт')"
_MERGED = f"""
  g0 AS (SELECT * FROM ({_SP}) AS s WHERE c0 <> '' OR c1 <> '' OR c2 <> ''),
  g1 AS (SELECT *, sum(CASE WHEN c0 <> '' OR NOT {_UNITQ} THEN 1 ELSE 0 END) OVER (PARTITION BY table_no ORDER BY row_no) AS g FROM g0),
  mg AS (SELECT table_no, min(row_no) AS row_no, arg_max(c0, row_no) FILTER (WHERE c0 <> '') AS c0,
      arg_max(c1, row_no) FILTER (WHERE c1 <> '') AS c1, arg_max(c2, row_no) FILTER (WHERE c2 <> '') AS c2
    FROM g1 GROUP BY table_no, g HAVING arg_min(c0, row_no) <> '')"""


def _best(role: str, extra: str = "") -> str:
    return f"arg_max(col_no, {role} * 100 - col_no) FILTER (WHERE {role} > 0 {extra})"


_SHEET_O = f"""
  sh AS ({fx.for_oracle(_SHEET)}),
  hd AS (SELECT *, event_type = 'error' AS is_header,
      max(CASE WHEN event_type = 'error' THEN row_no END) OVER (PARTITION BY doc_id ORDER BY row_no) AS h FROM sh),
  ln AS (SELECT doc_id, row_no, k0, CASE WHEN k1 = 'шт.' THEN 'шт' ELSE 'м' END AS unit,
      coalesce(TRY_CAST(replace(k2, ',', '.') AS DOUBLE), 0) AS quantity,
      CASE WHEN k3 LIKE 'ГОСТ%' THEN NULL ELSE k3 END AS model
    FROM hd WHERE NOT is_header AND h IS NOT NULL AND h % 5 <> 0 AND k0 <> ''),
  sl AS (SELECT doc_id, row_no, CASE WHEN model IS NOT NULL AND NOT contains(upper(k0), upper(model)) THEN concat(k0, ' ', model) ELSE k0 END AS name,
      unit, quantity FROM ln WHERE quantity <> 0)"""


def _equipment_oracle() -> str:
    eq = fx.for_oracle(_EQUIPMENT)
    cats = []
    for i, r in enumerate(fv.CATEGORY_RULES):
        tests = [f"contains(tl, {o.q(k)})" for k in r["keywords"]]
        tests += [f"regexp_matches(tl, {o.q(o.word(a.lower()))})" for a in r["aliases"]]
        cats.append(f"WHEN {' OR '.join(tests)} THEN {i}")
    skip = " ".join(f"WHEN contains(tl, {o.q(k)}) THEN {o.q(k)}" for k in fv.SKIP_KEYWORDS)

    def col(key: str) -> str:
        return "CASE cat " + " ".join(
            f"WHEN {i} THEN {o.q(r[key]) if r[key] else 'NULL'}" for i, r in enumerate(fv.CATEGORY_RULES)
        ) + " END"

    brand = "CASE cat " + " ".join(
        f"WHEN {i} THEN " + o.num("t", f"(?i)(?:^|{_NW})(?:{'|'.join(a for a in r['aliases'])})[-\\s]?([0-9]{{2,4}})(?:{_NW}|$)")
        for i, r in enumerate(fv.CATEGORY_RULES) if len(r["dimension_patterns"]) > 1
    ) + " END"
    pair = r"([0-9]{2,4})\s*[-xх×]\s*([0-9]{2,4})"
    length = "CASE cat " + " ".join(
        f"WHEN {i} THEN {int(r['default_params']['L0'])}" for i, r in enumerate(fv.CATEGORY_RULES) if r["default_params"]
    ) + " END"
    return f"""WITH e AS (SELECT *, trim(concat_ws(' ', raw_name, model)) AS t, lower(trim(concat_ws(' ', raw_name, model))) AS tl FROM ({eq}) AS q),
      c AS (SELECT *, CASE {' '.join(cats)} END AS cat FROM e),
      d AS (SELECT *, {o.num('t', pair, 1)} AS pa, {o.num('t', pair, 2)} AS pb, {brand} AS pd FROM c),
      f AS (SELECT *, CASE WHEN pa IS NULL OR (cat = 4 AND pd IS NOT NULL) THEN pd END AS d0,
          CASE WHEN cat = 4 AND pd IS NOT NULL THEN NULL ELSE pa END AS a0, CASE WHEN cat = 4 AND pd IS NOT NULL THEN NULL ELSE pb END AS b0 FROM d),
      s AS (SELECT *, CASE WHEN d0 IS NOT NULL THEN 'round' ELSE 'rectangular' END AS section, {col('name')} AS cname, {col('id')} AS cid,
          CASE WHEN d0 IS NOT NULL THEN coalesce({col('article_round')}, {col('article_rect')}) ELSE coalesce({col('article_rect')}, {col('article_round')}) END AS art FROM f),
      r AS (SELECT *, CASE WHEN cat IS NULL THEN CASE WHEN (CASE {skip} END) IS NOT NULL THEN concat('Оборудование не производится (', CASE {skip} END, ')') ELSE 'Не удалось распознать категорию' END
          WHEN art IS NULL THEN concat('Для категории ', cname, ' не назначен артикул в 1С')
          WHEN d0 IS NULL AND a0 IS NULL THEN concat('Не удалось извлечь размеры для категории ', cname) END AS reason FROM s)
      SELECT line_no, CASE WHEN reason IS NULL THEN 'spec' ELSE 'skipped' END AS status,
        CASE WHEN reason IS NULL THEN concat(cname, CASE section WHEN 'round' THEN ' круглого сечения' ELSE ' прямоугольного сечения' END) END AS name,
        CASE WHEN reason IS NULL THEN CASE WHEN d0 IS NOT NULL THEN concat('D', CAST(d0 AS BIGINT)) ELSE concat(CAST(a0 AS BIGINT), 'x', CAST(b0 AS BIGINT)) END END AS size,
        CASE WHEN reason IS NULL THEN 'шт' END AS unit, CASE WHEN reason IS NULL THEN art END AS article,
        CASE WHEN reason IS NULL THEN concat_ws(',',
          'A0=' || CAST(CAST(coalesce(a0, CASE WHEN cat IN (1, 2, 3) THEN d0 END) AS BIGINT) AS VARCHAR),
          'B0=' || CAST(CAST(coalesce(b0, CASE WHEN cat IN (1, 2, 3) THEN d0 END) AS BIGINT) AS VARCHAR),
          'D0=' || CAST(CAST(d0 AS BIGINT) AS VARCHAR), 'L0=' || CAST({length} AS VARCHAR)) END AS params,
        CASE WHEN reason IS NULL THEN cid END AS detected_category, reason FROM r"""


def _characteristic_sql() -> tuple[str, str]:
    source = {"A0": "pa0", "A1": "pa1", "A2": "pa2", "B0": "pb0", "B1": "pb1", "B2": "pb2", "D0": "pd0", "D1": "pd1",
              "D2": "pd2", "L0": "pl0", "L1": "pl1", "L2": "pl2", "P0": "pp0", "R0": "pr0", "U0": "pu0"}
    texts, errors = [], []
    for article, _, _, params, _ in fv.ARTICLES:
        parts, missing = [], []
        for p in params:
            value = "100" if fv.FORCED_PARAMS.get(article, {}).get(p) else source[p]
            number = f"CAST(round_even({value}, 0) AS BIGINT)"
            shown = f"printf('%04d', {number})" if p[0] in "DABLP" else f"CAST({number} AS VARCHAR)"
            parts.append(f"'{p}' || {shown} || '{p}_'")
            missing.append(f"WHEN {value} IS NULL THEN '{p}'")
        if parts:
            texts.append(f"WHEN '{article}' THEN {' || '.join(parts)}")
            errors.append(f"WHEN '{article}' THEN CASE {' '.join(missing)} END")
    text = f"CASE article {' '.join(texts)} ELSE '' END"
    error = f"CASE article {' '.join(errors)} END"
    return text, error


_CH_TEXT, _CH_MISSING = _characteristic_sql()
_CH_KNOWN = o.in_list([article for article, _, _, params, _ in fv.ARTICLES if params])
_NAMES = ", ".join(f"('{a}', '{n or ''}')" for a, _, n, _, _ in fv.ARTICLES)
_PRODUCTS = ", ".join(
    f"({i}, '{a}', '{s or 'round'}', '{n or ''}')" for i, (a, s, n, _, _) in enumerate(fv.ARTICLES)
)
_NORM = "trim(regexp_replace(regexp_replace(replace(lower({0}), 'ё', 'е'), '[^a-zа-я0-9x*×х/\\-. ]', ' ', 'g'), '\\s+', ' ', 'g'))"
_DESC = fx.for_oracle(_DESCRIPTION)
_DX = "translate(description, 'х×*', 'xxx')"
_D0 = o.num(_DX, r"(?i)(?:d|dn|ф)\s*([0-9]+)")
_A0 = o.num(_DX, r"(?i)([0-9]{2,4})\s*x\s*([0-9]{2,4})", 1)
_BARE = o.num(f"trim({_DX})", rf"(?:^|{_NW})([0-9]{{2,4}})\s*$")
_ROUND = f"coalesce({_D0}, CASE WHEN {_A0} IS NULL AND {_BARE} BETWEEN 50 AND 1600 THEN {_BARE} END)"
_WORD_SCORE = " + ".join(f"CASE WHEN contains(norm, '{w}') AND contains(pn, '{w}') THEN 3.0 ELSE 0.0 END" for w in [*fv.DUCT_WORDS, *fv.FITTING_WORDS])


def _xml(tag: str, value: str, pad: int) -> str:
    esc = f"coalesce(CAST({value} AS VARCHAR), '')"
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        esc = f"replace({esc}, '{raw}', '{entity}')"
    space = " " * pad
    return f"CASE WHEN {esc} = '' THEN '{space}<{tag}/>' ELSE concat('{space}<{tag}>', {esc}, '</{tag}>') END || chr(10)"


_THICK = "coalesce(named_thickness, CASE line_no % 4 WHEN 0 THEN 0.7 WHEN 2 THEN 1.0 ELSE 0.8 END)"
_ROW_XML = " || ".join([
    "'    <productRow>' || chr(10)", _xml("article", "article", 6), _xml("name", "pname", 6),
    _xml("characteristic", "ch", 6), _xml("quantity", "pieces", 6), _xml("material", "final_code", 6),
    _xml("thickness", f"CAST({_THICK} AS DOUBLE)", 6), *[_xml(f"connection_{i}", f"sides[{i + 1}]", 6) for i in range(4)],
    _xml("system", "''", 6), _xml("comment", o.COMMENT, 6), "'    </productRow>' || chr(10)",
])
_HEAD_XML = " || ".join(
    _xml(h, {"customer": "c_name", "contact": "'A&' || c_mktsegment"}.get(h, "''"), 2) for h in export.HEADER_FIELDS
)
_SIZE = r"([0-9]{2,5}(?:\s*[xх×*]\s*[0-9]{2,5})?|[dд][n]?\s*[0-9]{2,5}|Ф\s*[0-9]{2,5})"
_REST = _SIZE + r"\s+(м|шт|м2|м²|шт\.|шток|pcs|pc|m)\s+([0-9]+(?:[.,][0-9]+)?)"
_WIDE = o.q(r"(?i)^(.+?)\s{2,}" + _REST)
_ANY = o.q(r"(?i)^(.+?)\s+" + _REST)
_SECTION_ROUND = "p_size % 2 = 0"

ORACLE = {
    "column_roles": f"""WITH cells AS ({fx.for_oracle(_ROLE_CELLS)}), f AS (SELECT * FROM cells WHERE text <> ''),
        s AS (SELECT table_no, col_no, count(*) FILTER (WHERE text IN ('шт', 'м')) AS u, count(*) FILTER (WHERE TRY_CAST(replace(text, ',', '.') AS DOUBLE) IS NOT NULL) AS q,
            count(*) FILTER (WHERE regexp_matches(text, '^[A-ZА-Я]{{1,10}}$')) AS mf,
            count(*) FILTER (WHERE length(text) >= 5 AND regexp_matches(text, '[A-Za-zА-Яа-яЁё]') AND (regexp_matches(text, '[0-9]') OR length(text) > 20)) AS nm,
            count(*) FILTER (WHERE regexp_matches(text, '^[0-9]{{1,4}}$')) AS ps FROM f GROUP BY ALL),
        b AS (SELECT table_no, {_best('u')} AS unit_col FROM s GROUP BY ALL)
        SELECT table_no, any_value(unit_col) AS unit_col, {_best('q', 'AND col_no <> coalesce(unit_col, -1)')} AS quantity_col, {_best('mf')} AS manufacturer_col,
          {_best('nm')} AS name_col, {_best('ps')} AS pos_col FROM s JOIN b USING (table_no) GROUP BY table_no""",
    "sparse_row_merge": f"WITH {_MERGED} SELECT table_no, row_no, c0, c1, c2 FROM mg",
    "equipment_rows": f"""WITH {_MERGED} SELECT table_no, row_no, c0 AS raw_name, '' AS model, '' AS manufacturer, 'шт' AS unit, c1 AS quantity FROM mg WHERE c1 IS NOT NULL""",
    "header_carry_forward": f"WITH {_SHEET_O} SELECT doc_id, row_no, name, unit, quantity FROM sl",
    "first_wins_dedupe": f"""WITH {_SHEET_O} SELECT doc_id, row_no AS line_no, name, unit, quantity FROM sl
        QUALIFY row_number() OVER (PARTITION BY doc_id, lower(regexp_replace(name, '\\s+', ' ', 'g')), lower(unit) ORDER BY row_no) = 1""",
    "header_keyword_map": f"""WITH RECURSIVE cells AS ({fx.for_oracle(_HEADER_CELLS)}),
        m AS (SELECT table_no, col_no, row_number() OVER (PARTITION BY table_no ORDER BY col_no) AS i,
            CASE text WHEN 'Наименование' THEN ['name'] WHEN 'Размер сечения' THEN ['size'] WHEN 'Ед.изм' THEN ['unit'] WHEN 'Кол-во' THEN ['quantity']
              WHEN 'Материал' THEN ['material'] WHEN 'Толщина, мм' THEN ['thickness'] WHEN 'Изделие' THEN ['name'] WHEN 'qty' THEN ['quantity']
              WHEN 'Сталь_мм' THEN ['material', 'thickness'] WHEN 'Диаметр | мм' THEN ['size', 'thickness'] ELSE []::VARCHAR[] END AS c FROM cells),
        r(table_no, i, used, col_no, target) AS (
          SELECT table_no, 1, CASE WHEN len(c) > 0 THEN [c[1]] ELSE []::VARCHAR[] END, col_no, c[1] FROM m WHERE i = 1
          UNION ALL SELECT m.table_no, m.i, CASE WHEN len(list_filter(c, lambda x: NOT list_contains(used, x))) > 0 THEN list_append(used, list_filter(c, lambda x: NOT list_contains(used, x))[1]) ELSE used END,
            m.col_no, list_filter(c, lambda x: NOT list_contains(used, x))[1] FROM r JOIN m ON m.table_no = r.table_no AND m.i = r.i + 1)
        SELECT target, CAST(col_no AS BIGINT) AS col_no, count(*) AS n, CAST(sum(table_no) AS BIGINT) AS tables FROM r WHERE target IS NOT NULL GROUP BY ALL""",
    "text_line_fallback": f"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM documents UNION ALL SELECT doc_id, text FROM ({fx.for_oracle(_TEXT_LINES)}) AS t),
        p AS (SELECT line, CASE WHEN regexp_matches(line, {_WIDE}) THEN regexp_extract(line, {_WIDE}, ['n', 's', 'u', 'q'])
            WHEN regexp_matches(line, {_ANY}) THEN regexp_extract(line, {_ANY}, ['n', 's', 'u', 'q']) END AS x, doc_id
          FROM l WHERE length(line) >= 5 AND doc_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0))
        SELECT doc_id, trim(x.n, ' -;:') AS name, trim(x.s) AS size, lower(x.u) AS unit, CAST(replace(x.q, ',', '.') AS DOUBLE) AS quantity,
          coalesce(TRY_CAST(replace(regexp_extract(line, '(?i)([0-9]+(?:[.,][0-9]+)?)\\s*мм', 1), ',', '.') AS DOUBLE), 0.8) AS thickness, 'оцинкованная' AS material
        FROM p WHERE x IS NOT NULL UNION ALL SELECT * FROM ({fx.for_oracle(_TABLE_LINES)}) AS tl""",
    "rule_category_match": _equipment_oracle(),
    "characteristic": f"""WITH {o.parsed(fx.for_oracle(fx.SPEC_LINE))}, n(article, pname) AS (VALUES {_NAMES}),
        c AS (SELECT line_no, article, {_CH_TEXT} AS t, {_CH_MISSING} AS miss, article IN {_CH_KNOWN} AS known FROM out WHERE ordered)
        SELECT line_no, article, CASE WHEN known AND miss IS NULL THEN t END AS characteristic,
          CASE WHEN NOT known THEN concat('Для артикула ', article, ' неизвестен список параметров') WHEN miss IS NOT NULL THEN concat('Для артикула ', article, ' не хватает параметра ', miss) END AS error, pname AS product_name FROM c JOIN n USING (article)""",
    "order_xml": f"""WITH {o.parsed(fx.for_oracle(fx.SPEC_LINE))}, n(article, pname) AS (VALUES {_NAMES}),
        c AS (SELECT out.*, {_CH_TEXT} AS ch, {_CH_MISSING} AS miss FROM out WHERE ordered AND article IN {_CH_KNOWN}),
        r AS (SELECT order_id, line_no, line_no // 1000 AS fragment_no, {_ROW_XML} AS x FROM c JOIN n USING (article) WHERE miss IS NULL),
        p AS (SELECT order_id, fragment_no, count(*) AS n_lines, string_agg(x, '' ORDER BY line_no) AS body FROM r GROUP BY ALL),
        e AS (SELECT *, min(fragment_no) OVER (PARTITION BY order_id) AS lo, max(fragment_no) OVER (PARTITION BY order_id) AS hi FROM p)
        SELECT order_id, CAST(fragment_no AS BIGINT) AS fragment_no, CAST(n_lines AS INTEGER) AS n_lines, concat(
          CASE WHEN fragment_no = lo THEN '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<Order>' || chr(10) || {_HEAD_XML} || '  <Tabl>' || chr(10) ELSE '' END, body,
          CASE WHEN fragment_no = hi THEN '  </Tabl>' || chr(10) || '</Order>' || chr(10) ELSE '' END) AS xml
        FROM e LEFT JOIN customer ON c_custkey = order_id""",
    "default_expressions": f"""WITH l AS (SELECT *, 'P' || CAST(part AS VARCHAR) AS article FROM ({fx.for_oracle(_COMPUTED_LINES)}) AS x),
        r AS (SELECT *, coalesce(r0, CASE part % 6 WHEN 0 THEN d0 * 1.5 WHEN 1 THEN CASE WHEN b0 IS NOT NULL THEN greatest(a0, b0, 60) / 2 END WHEN 2 THEN a0 + d0 * 2
            WHEN 3 THEN round_even(d0 / 3, 0) WHEN 4 THEN -(a0 * a0) + least(d0, 70) END) AS rr FROM l),
        u AS (SELECT *, CASE WHEN part % 6 = 2 THEN floor((rr - 3) / 7) - 5 * floor(floor((rr - 3) / 7) / 5) ELSE 90 END AS u1 FROM r),
        f AS (SELECT *, CASE WHEN part % 4 = 0 THEN u1 / 4 + 1 ELSE u1 END AS u0 FROM u)
        SELECT order_id, line_no, article, CASE WHEN rr IS NOT NULL THEN concat('A0', printf('%04d', CAST(a0 AS BIGINT)), 'A0_D0', printf('%04d', CAST(d0 AS BIGINT)), 'D0_R0',
            CAST(round_even(rr, 0) AS BIGINT), 'R0_U0', CAST(round_even(u0, 0) AS BIGINT), 'U0_') END AS characteristic,
          CASE WHEN rr IS NULL THEN concat('Для артикула ', article, CASE WHEN part % 6 = 5 THEN ' недопустимо выражение параметра R0' ELSE ' не хватает параметра R0' END) END AS error FROM f""",
    "equipment_document": f"""WITH g AS (SELECT * FROM ({fx.for_oracle(_EQUIPMENT_GRID)}) AS x WHERE page IN (1, 2, 4) AND k0 <> 'ОБОРУДОВАНИЕ' AND concat(k0, k1, k2, k3, k4) <> ''),
        v AS (SELECT *, k0 = '' AND concat(k1, k2, k3, k4) <> '' AND regexp_full_match(concat_ws(' ', nullif(k1, ''), nullif(k4, '')), '[0-9\\s,]+') AND concat(k2, k3) = '' AS digits_only FROM g),
        n AS (SELECT *, sum(CASE WHEN k0 <> '' OR NOT (k1 <> '' OR k2 <> '' OR k3 <> '' OR k4 <> '') THEN 1 ELSE 0 END) OVER (PARTITION BY page, table_no ORDER BY row_no) AS grp FROM v WHERE NOT digits_only),
        m AS (SELECT page, table_no, grp, min(row_no) AS row_no, arg_min(k0, row_no) AS opening, arg_max(k0, row_no) FILTER (WHERE k0 <> '') AS raw_name, arg_max(k1, row_no) FILTER (WHERE k1 <> '') AS quantity,
            arg_max(k2, row_no) FILTER (WHERE k2 <> '') AS unit, arg_max(k3, row_no) FILTER (WHERE k3 <> '') AS manufacturer FROM n GROUP BY ALL)
        SELECT page, table_no, row_no, raw_name, '' AS model, coalesce(manufacturer, '') AS manufacturer, coalesce(unit, 'шт') AS unit, quantity FROM m WHERE opening <> '' AND quantity IS NOT NULL""",
    "free_header_lines": """SELECT s_suppkey AS row_no, s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN 'DN150' WHEN 1 THEN '100x200' WHEN 2 THEN 'сечение Ф 160' ELSE '' END AS size,
        CASE WHEN s_suppkey % 3 = 0 THEN 'компл' WHEN s_suppkey % 4 IN (0, 1, 2) THEN 'м' ELSE 'шт' END AS unit,
        CASE s_suppkey % 5 WHEN 0 THEN 0.0 WHEN 1 THEN 2.5 ELSE CAST(s_nationkey AS DOUBLE) END AS quantity, 'оцинкованная' AS material, CASE WHEN s_suppkey % 2 = 0 THEN 0.9 ELSE 0.8 END AS thickness FROM supplier""",
    "edited_rows": """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN concat('D0=', c_custkey % 900) ELSE '' END AS params,
        CASE c_custkey % 4 WHEN 0 THEN 3.0 WHEN 1 THEN 2.5 ELSE 0.0 END AS quantity, CASE WHEN c_custkey % 5 = 0 THEN 1.2 ELSE 0.8 END AS thickness FROM customer""",
    "page_selection": "SELECT l_linenumber AS page, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem WHERE l_linenumber IN (1, 3) GROUP BY ALL",
    "catalogue_columns": f"WITH e AS ({fx.for_oracle(_ENTRIES)}) SELECT e.code, e.name, concat('ед', e.code) AS unit, length(e.name) AS weight, g.name AS group_name FROM e LEFT JOIN e AS g ON e.parent_code = g.code WHERE NOT e.is_group AND NOT e.is_deleted",
    "connection_codes": f"""SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN CASE WHEN {_SECTION_ROUND} THEN '1' ELSE '0' END
        WHEN 1 THEN CASE WHEN {_SECTION_ROUND} THEN '2' ELSE '8' END WHEN 2 THEN CASE WHEN {_SECTION_ROUND} THEN '2' ELSE '8' END
        WHEN 3 THEN CASE WHEN {_SECTION_ROUND} THEN '3' ELSE '0' END WHEN 4 THEN CASE WHEN {_SECTION_ROUND} THEN '4' ELSE '5' END
        WHEN 5 THEN CASE WHEN {_SECTION_ROUND} THEN '0' ELSE '6' END WHEN 6 THEN CASE WHEN {_SECTION_ROUND} THEN '0' ELSE '6' END
        WHEN 7 THEN CASE WHEN {_SECTION_ROUND} THEN '0' ELSE '7' END WHEN 9 THEN '7' WHEN 11 THEN CASE WHEN {_SECTION_ROUND} THEN '0' ELSE '5' END ELSE '0' END AS code FROM part""",
    "catalogue_match_score": f"""WITH d AS (SELECT DISTINCT description FROM ({_DESC}) AS x), prod(pos, article, section, pname) AS (VALUES {_PRODUCTS}),
        f AS (SELECT description, {_NORM.format('description')} AS norm, CASE WHEN {_A0} IS NOT NULL THEN 'rectangular' WHEN {_ROUND} IS NOT NULL THEN 'round' END AS inferred FROM d),
        s AS (SELECT description, pos, article, CASE WHEN section = 'round' AND {o.contains_any('norm', fv.ROUND_HINTS)} OR section = 'rectangular' AND {o.contains_any('norm', fv.RECT_HINTS)} THEN 2.0 ELSE 0.0 END
            + {_WORD_SCORE} + CASE WHEN inferred = section THEN 2.5 ELSE 0.0 END AS score FROM (SELECT f.*, prod.*, {_NORM.format('pname')} AS pn FROM f CROSS JOIN prod) AS j)
        SELECT description, CAST(rank AS INTEGER) AS rank, article, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY description ORDER BY score DESC, pos) AS rank FROM s) AS r WHERE rank <= 5""",
    "description_dims": f"""SELECT DISTINCT description, {_NORM.format('description')} AS norm, {_A0} AS a0, {o.num(_DX, '(?i)([0-9]{2,4})' + chr(92) + 's*x' + chr(92) + 's*([0-9]{2,4})', 2)} AS b0, {_ROUND} AS d0,
        {o.num(_DX, '(?i)(?:l' + chr(92) + 's*=?' + chr(92) + 's*|длина' + chr(92) + 's*)([0-9]{3,5})')} AS l0,
        CASE WHEN description LIKE '%на 4 отверстия%' THEN 4.0 END AS p0 FROM ({_DESC}) AS x""",
    "reconcile": """WITH m AS (SELECT l_returnflag AS a, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_linestatus = 'F'),
        p AS (SELECT CASE WHEN l_returnflag = 'R' THEN 'X' ELSE l_returnflag END AS a, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_linestatus = 'O'),
        u AS (SELECT a, q AS mq, 0 AS pq FROM m UNION ALL SELECT a, 0, q FROM p)
        SELECT coalesce(a, 'Итого') AS article, CAST(sum(mq) AS BIGINT) AS manual, CAST(sum(pq) AS BIGINT) AS parsed, CAST(sum(pq) - sum(mq) AS BIGINT) AS difference FROM u GROUP BY ROLLUP (a)""",
    "parameter_usage": "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS parameter, p_brand AS article FROM part",
    "catalogue_list": f"WITH e AS ({fx.for_oracle(_ENTRIES)}) SELECT e.code, e.name, g.name AS group_name FROM e LEFT JOIN e AS g ON e.parent_code = g.code WHERE NOT e.is_group AND NOT e.is_deleted",
    "first_entries": f"SELECT code, name FROM ({fx.for_oracle(_ENTRIES)}) AS e WHERE NOT is_group AND NOT is_deleted ORDER BY name, code LIMIT 50",
    "connection_list": "SELECT n_nationkey AS code, n_name AS name, n_regionkey AS section FROM nation WHERE n_nationkey % 6 <> 0",
    "like_search": "SELECT c_custkey AS code, c_name AS name FROM customer WHERE c_name LIKE '%1_5%' ORDER BY name, code LIMIT 20",
    "nested_orders": """WITH o AS (SELECT o_orderkey, o_orderdate, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10)
        SELECT o_orderkey AS order_id, o_orderdate AS order_date, o_custkey AS customer, coalesce((SELECT string_agg(concat_ws(':', l_linenumber, l_partkey, CAST(l_quantity AS BIGINT)), ';'
          ORDER BY l_linenumber, l_partkey, l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS lines FROM o""",
    "block_assembly": f"""WITH l AS ({fx.for_oracle(_MODULE)}),
        k AS (SELECT *, text LIKE '  ИначеЕсли%' AS opens, text LIKE 'КонецЕсли%' AS closes, nullif(regexp_extract(text, '^АртикулПродукции = "([^"]+)"', 1), '') AS art FROM l),
        b AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY line_no) AS g FROM k),
        e AS (SELECT *, min(CASE WHEN closes OR art IS NOT NULL THEN line_no END) OVER (PARTITION BY conv_id, g) AS fin FROM b WHERE g > 0),
        r AS (SELECT conv_id, g, min(line_no) AS first_line, max(CASE WHEN opens THEN regexp_extract(text, 'асПродукция[.]([^ ]+) ', 1) END) AS product_ref,
            max(CASE WHEN opens THEN regexp_extract(text, '// (.*)$', 1) END) AS comment,
            arg_max(regexp_extract(text, '^Обозначение = (.+);', 1), line_no) FILTER (WHERE text LIKE 'Обозначение%') AS designation_expression,
            arg_max(regexp_extract(text, '"([^"]+)"', 1), line_no) FILTER (WHERE text LIKE 'АртикулГруппы%') AS group_code, max(art) AS article
          FROM e WHERE fin IS NULL OR line_no <= fin GROUP BY ALL)
        SELECT conv_id, first_line, product_ref, comment, designation_expression, group_code, article,
          CASE WHEN contains(designation_expression, 'D_') THEN 'D0,D1,L0' ELSE 'A0,B0,U0' END AS xml_parameters FROM r WHERE article IS NOT NULL AND designation_expression IS NOT NULL""",
}
