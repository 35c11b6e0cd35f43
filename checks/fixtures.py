"""Inputs derived from the given tables, as SQL that both engines run unchanged."""

from __future__ import annotations

# (name, size, unit) per template; {a} {b} are sides, {d} {e} diameters, {s} is p_size.
_TEMPLATES = [
    ("'Воздуховод из оцинкованной стали'", "concat('D', d)", "'м'"),
    ("'Воздуховод прямошовный нержавеющий 0,7 мм'", "concat('Ф', d, '-1250')", "'м'"),
    ("'Отвод круглый 90 градусов'", "concat('D', d)", "'шт'"),
    ("'Переход круглый'", "concat('D', d, '-D', e)", "'шт'"),
    ("'Тройник прямоугольный'", "concat(a, 'x', b)", "'шт'"),
    ("'Заглушка прямоугольная'", "concat(a, 'x', b)", "'шт'"),
    ("'Шумоглушитель трубчатый'", "concat('D', d)", "'шт'"),
    ("'Клапан воздушный'", "concat(a, 'x', b)", "'шт'"),
    ("'Решетка вентиляционная'", "CASE WHEN p_size % 3 = 0 THEN concat(a, 'х', b) ELSE '' END", "'шт'"),
    ("'Фасонные изделия из черной стали'", "''", "'м2'"),
    ("concat('Отвод прямоугольный косой ', a, 'x', b, ' R', d)", "''", "'шт.'"),
    ("concat('Переход круглый с D', d, ' на D', e)", "''", "'шт'"),
    ("concat('Переход с прямоугольного на круглое сечение ', a, 'x', b, '-Ф', d)", "''", "'шт'"),
    ("concat('Переход прямоугольный ', a, 'x', b, '-', b, 'x', a)", "''", "'компл'"),
    ("concat('Тройник круглый Ф', d, '-Ф', d, '-Ф', e)", "''", "'шт'"),
    ("concat('Тройник прямоугольный ', a, 'x', b, ' с круглой врезкой D', e)", "''", "'шт'"),
    ("concat('Тройник прямоугольный ', a, 'x', b, '-', a, 'x', b, '-', b, 'x', b)", "'нет'", "'шт'"),
    ("concat('Крестовина круглая нерж. Ф', d)", "''", "'шт'"),
    ("'Крестовина прямоугольная'", "concat(a, ' x ', b)", "'шт'"),
    ("concat('Заглушка круглая сталь ст3 Ф', d, '0')", "''", "'шт'"),
    ("concat('Врезка прямоугольная ', a, 'x', b, ' D', e)", "''", "'шт'"),
    ("'Врезка круглая'", "concat('Ф', e)", "'шт'"),
    ("'Фланец круглый'", "concat('D', d, ' на 4 отверстия')", "'шт'"),
    ("'Фланец прямоугольный AISI 430 0.80'", "concat(a, '*', b)", "'шт'"),
    ("'Шумоглушитель LITENED 60-30 NKD'", "''", "'шт'"),
    ("'Шумоглушитель LITENED 100-50 NKK'", "''", "'шт'"),
    ("concat('Шумоглушитель KNK ', d, '/', p_size % 9 + 1)", "''", "'шт'"),
    ("concat('Пластина шумоглушителя ', a, 'x', b, '00x200')", "''", "'шт'"),
    ("concat('Обтекатель шумоглушителя ', a, 'x200')", "''", "'шт'"),
    ("concat('Шумоглушитель пластинчатый ', a, 'x', b, ' L=', e, '0')", "''", "'шт'"),
    ("'Шумоглушитель канальный с обтекателем'", "concat(a, 'x', b)", "'шт'"),
    ("concat('Стакан монтажный MSN-', d)", "''", "'шт'"),
    ("'Клапан обратный'", "concat('Ф', d)", "'шт'"),
    ("'Клапан противопожарный'", "concat(a, 'x', b, '-', e)", "'шт'"),
    ("'Клапан дымовой круглый'", "concat('D', d)", "'шт'"),
    ("'Дроссель'", "concat('D', d)", "'шт'"),
    ("'Утка круглая'", "concat('D', d)", "'шт'"),
    ("'Квадратный диффузор с адаптером'", "concat('4АПН ', a, 'x', a, ' + КСД ', d)", "'шт'"),
    ("'Круглый диффузор с адаптером'", "concat('600x', b, ' КСД', e)", "'шт'"),
    ("'Круглый диффузор'", "concat('ДПУ-М ', d)", "'шт'"),
    ("'Воздуховод прямоугольный толщина стенки 1,2 мм'", "concat(a, 'x', b, 'x', e)", "'м'"),
    ("'Воздуховод спирально-навивной (08пс)0.70'", "concat(d)", "'кг'"),
    ("concat('Воздуховод черный т 1.5 ', a, ' x ', b)", "''", "'метр'"),
    ("'Зонт крышный'", "concat('D', d)", "'шт'"),
    ("'Непонятная деталь'", "''", "'шт'"),
    ("concat('Фильтр карманный ', b, 'x', a)", "''", "'м²'"),
    ("'Отвод'", "concat(d)", "'шт'"),
]
N_TEMPLATES = len(_TEMPLATES)


def _case(column: int) -> str:
    whens = " ".join(f"WHEN {i} THEN {t[column]}" for i, t in enumerate(_TEMPLATES))
    return f"CASE template {whens} END"


def spec_text(key: str, size: str) -> str:
    """name, size and unit columns over a relation with `template`, `a`, `b`, `d`, `e`, `p_size`."""
    return f"{_case(0)} AS name, {_case(1)} AS size, {_case(2)} AS unit"


PARTS = f"""
SELECT p_partkey, p_size, p_name, p_brand, p_partkey % {N_TEMPLATES} AS template,
  CAST(p_size * 20 + 100 AS STRING) AS a, CAST((p_size % 7) * 50 + 60 AS STRING) AS b,
  CAST(p_size * 10 + 100 AS STRING) AS d, CAST(p_size * 5 + 100 AS STRING) AS e
FROM {{part}}
"""

# One line per part; `нет` is an unreadable quantity, `,5` halves show the rounding.
SPEC_LINE = f"""
SELECT p_partkey AS line_no, p_partkey % 50 AS order_id,
  {spec_text('p_partkey', 'p_size')},
  CASE WHEN p_partkey % 97 = 0 THEN 'нет'
    ELSE replace(CAST(CAST(p_size + 0.5 AS DOUBLE) AS STRING), '.', ',') END AS quantity,
  CASE p_partkey % 3 WHEN 0 THEN 'нержавеющая' WHEN 1 THEN '' ELSE 'оцинкованная' END AS material,
  CASE p_partkey % 4 WHEN 0 THEN '0,7' WHEN 1 THEN 'x' WHEN 2 THEN ' 1.0 ' ELSE '' END AS thickness
FROM ({PARTS}) AS parts
"""

# One line per line item; the quantity comes from the item.
SPEC_LINE_ITEMS = f"""
SELECT l_orderkey AS order_id, l_linenumber AS line_no,
  {spec_text('l_partkey', 'p_size')},
  CAST(l_quantity AS STRING) AS quantity
FROM {{lineitem}} JOIN ({PARTS}) AS parts ON l_partkey = p_partkey
"""

OFFER = """
SELECT p_name AS item_name, CAST(p_size AS STRING) AS item_size, l_returnflag AS source,
  concat(p_brand, ' ', p_name) AS title, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
  s_name AS supplier, l_shipdate AS scraped_at, l_orderkey, l_linenumber
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey
"""

ITEM = "SELECT DISTINCT p_name AS item_name, CAST(p_size AS STRING) AS item_size FROM {part}"

# Answers of sources to queries: the item's name and size, its last word and size, or a text no item
# asks for.  Two return flags are the registered sources, the third one is the fallback.
ANSWER = """
SELECT l_returnflag AS source,
  CASE l_linenumber % 4 WHEN 0 THEN concat(p_name, ' ', p_brand) WHEN 1 THEN concat(p_name, ' ', CAST(p_size AS STRING))
    ELSE concat(split_part(p_name, ' ', 2), ' ', CAST(p_size AS STRING)) END AS query,
  CASE WHEN l_orderkey % 5 = 0 THEN concat('other ', p_brand)
    ELSE concat(p_brand, ' ', p_name, ' ', CAST(p_size AS STRING)) END AS title,
  CASE WHEN l_orderkey % 11 = 0 THEN CAST(0 AS DECIMAL(18,2))
    ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END AS price,
  l_orderkey * 1000000 + l_suppkey * 1000 + l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS seq
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""
PRIMARY = f"SELECT source, query, title, price, seq FROM ({ANSWER}) AS x WHERE source IN ('R', 'A')"
FALLBACK = f"SELECT source, query, title, price, seq FROM ({ANSWER}) AS x WHERE source = 'N'"
MIN_OFFERS = 6

# Sparse rows of a grid: three columns, `view` rows are empty and `error` rows close a group.
SPARSE = """
SELECT CAST(user_id AS BIGINT) AS table_no, event_id AS row_no,
  CASE WHEN event_type = 'signup' THEN concat('Клапан ', CAST(user_id AS STRING)) ELSE '' END AS c0,
  CASE WHEN event_type IN ('purchase', 'click') THEN CAST(value AS STRING) ELSE '' END AS c1,
  CASE WHEN event_type = 'error' THEN 'прочее' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'шт' ELSE '' END AS c2
FROM {events}
"""

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def for_oracle(sql: str) -> str:
    """The same text with plain table names and the other engine's type names."""
    return sql.format(**{t: t for t in TABLES}).replace("AS STRING)", "AS VARCHAR)")
