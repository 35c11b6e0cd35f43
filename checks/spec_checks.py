"""Registered queries over specification lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks import spec_oracle as o
from checks.load import load
from ductlake import fixed_values as fv
from ductlake.functions import articles, classify, size, text
from ductlake.operators import reports, spec_lines
from ductlake.sources import dimensions as dim


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, fx.SPEC_LINE)


def _counted_items(spark: SparkSession, sf: str) -> DataFrame:
    """All line items; what only numbers a line is no part of a count."""
    return reports.equal_lines(load(spark, sf, fx.SPEC_LINE_ITEMS).drop("line_no", "order_id"))


def _parsed(spark: SparkSession, lines: DataFrame) -> DataFrame:
    return spec_lines.parse_spec_lines(lines, dim.builtin_allowed(spark), dim.builtin_materials(spark))


def params_text(params):
    entries = F.array_sort(F.map_entries(params))
    return F.array_join(
        F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("bigint").cast("string"))), ","
    )


def spec_order_lines(spark, sf):
    p = _parsed(spark, _lines(spark, sf))
    sides = F.concat(*[F.col(f"connection_{i}") for i in range(4)])
    return p.filter(F.col("status") == "order").select(
        "line_no", "order_id", "article", params_text(F.col("params")).alias("params"), "quantity",
        "material_code", "thickness", sides.alias("sides"), "comment",
    )


def spec_skipped_lines(spark, sf):
    p = _parsed(spark, _lines(spark, sf))
    return spec_lines.skipped_lines(p, "line_no").select("line_no", "name", "size", "unit", "reason", "ocr_warning")


def spec_skipped_reasons(spark, sf):
    p = _parsed(spark, _counted_items(spark, sf))
    return reports.reason_distribution(p.filter(F.col("status") == "skipped"))


def article_distribution(spark, sf):
    return reports.article_distribution(_parsed(spark, _counted_items(spark, sf)))


def row_totals(spark, sf):
    return reports.row_totals(_parsed(spark, _lines(spark, sf)))


def fitting_classify(spark, sf):
    lines = spec_lines.with_texts(spec_lines.clean_lines(_lines(spark, sf)), distinct_texts=False)
    routed = spec_lines.route_lines(lines).filter(F.col("route").isin("fitting", "adapter"))
    return routed.select(
        "line_no", "route", "ptype", F.col("parsed_article").alias("article"),
        params_text(F.col("params")).alias("params"), F.col("connections").alias("sides"),
    )


def unit_quantity_normalise(spark, sf):
    lines = load(spark, sf, fx.SPEC_LINE_ITEMS).withColumn("quantity", F.replace("quantity", F.lit("."), F.lit(",")))
    value = text.number_or_null(F.col("quantity"))
    return lines.select(
        text.unit_from_size(F.col("size")).alias("guessed_unit"),
        text.canonical_unit(F.col("unit")).alias("canonical_unit"),
        text.piece_count(value, F.col("unit")).alias("pieces"),
        text.pieces_from_metres(value, F.lit(1250.0)).alias("ducts"),
    ).groupBy("guessed_unit", "canonical_unit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pieces").alias("pieces"), F.sum("ducts").alias("ducts")
    )


def size_tokens(spark, sf):
    lines = _lines(spark, sf)
    s = size.parse_size(F.col("token"))
    return lines.withColumn("token", F.when(F.col("size") != "", F.col("size")).otherwise(text.size_token(F.col("name")))).select(
        "line_no", "token", text.canonical_size(F.col("token")).alias("canon"),
        s["section"].alias("section"), s["D0"].alias("d0"), s["A0"].alias("a0"), s["B0"].alias("b0"), s["L0"].alias("l0"),
    )


def ocr_size_repair(spark, sf):
    repaired = _parsed(spark, _lines(spark, sf)).filter(F.col("status") == "order").select(
        "line_no", "size", "comment", spec_lines.split_ocr_comment(F.col("comment")).alias("o")
    )
    return repaired.filter(F.col("o").isNotNull()).select(
        "line_no", "size", F.col("o.name").alias("line_text"), F.col("o.warning").alias("warning")
    )


def product_type(spark, sf):
    low = F.col("low")
    names = load(spark, sf, fx.SPEC_LINE_ITEMS).groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    return names.withColumn("low", F.lower("name")).select("k",
        classify.product_type(low).alias("ptype"), classify.is_rectangular(low).alias("rect"),
        classify.is_round(low).alias("circ"), classify.is_rectangular_product(low).alias("rect_product"),
    ).groupBy("ptype", "rect", "circ", "rect_product").agg(F.sum("k").alias("n"))


def material_thickness(spark, sf):
    lines = _lines(spark, sf)
    return lines.select(
        "line_no", classify.material_from_name(F.col("name")).alias("material"),
        classify.material_code(F.col("material")).alias("column_code"),
        classify.thickness_from_name(F.col("name")).alias("thickness"),
    )


def _explicit(spark, sf):
    """Explicit choices: every third part names an article itself."""
    sql = """SELECT p_partkey AS line_no, p_name AS name, CAST(p_size AS STRING) AS size,
        CASE p_partkey % 3 WHEN 0 THEN 'шт' WHEN 1 THEN 'компл' ELSE 'pcs' END AS unit,
        CAST(p_retailprice / 100 AS STRING) AS quantity,
        CASE p_partkey % 5 WHEN 0 THEN '3-3-2' WHEN 1 THEN '17-2-1' WHEN 2 THEN '99-1' WHEN 3 THEN '21-1-1' ELSE '' END AS article,
        CASE p_partkey % 2 WHEN 0 THEN concat('{{"A0": ', CAST(p_size AS STRING), ', "L0": 100}}') ELSE concat('{{"D0": ', CAST(p_size AS STRING), '}}') END AS params
      FROM {part}"""
    lines = load(spark, sf, sql)
    return lines.withColumn("params", F.from_json("params", "map<string,double>"))


def explicit_lines(spark, sf):
    p = _parsed(spark, _explicit(spark, sf))
    sides = F.concat(*[F.col(f"connection_{i}") for i in range(4)])
    return p.select(
        "line_no", "status", "article", params_text(F.col("params")).alias("params"), "quantity", sides.alias("sides"),
        "comment", "reason",
    )


def allowed_split(spark, sf):
    articles_df = load(spark, sf, "SELECT p_partkey, concat(CAST(p_partkey % 12 + 1 AS STRING), '-', CAST(p_size % 3 AS STRING), '-', CAST(p_partkey % 7 AS STRING)) AS parsed_article FROM {part}")
    flagged = spec_lines.with_allowed_check(articles_df, dim.builtin_allowed(spark))
    return flagged.groupBy("parsed_article", "is_allowed").agg(F.count(F.lit(1)).alias("n"))


def material_validity(spark, sf):
    base = load(spark, sf, "SELECT p_partkey, concat(CAST(p_partkey % 22 + 1 AS STRING), '-', CAST(p_size % 3 AS STRING), '-', CAST(p_partkey % 5 AS STRING)) AS parsed_article, CAST(p_partkey % 3 + 1 AS STRING) AS wanted_code FROM {part}")
    return spec_lines.with_material_check(base, dim.builtin_materials(spark)).select(
        "p_partkey", "parsed_article", "material_code", "material_warning"
    )


QUERIES = {
    f.__name__: f for f in (
        spec_order_lines, spec_skipped_lines, spec_skipped_reasons, article_distribution, row_totals,
        fitting_classify, unit_quantity_normalise, size_tokens, ocr_size_repair, product_type,
        material_thickness, explicit_lines, allowed_split, material_validity,
    )
}

_LINE = fx.for_oracle(fx.SPEC_LINE)
_ITEMS = fx.for_oracle(fx.SPEC_LINE_ITEMS)
_LOW = "translate(lower(token), 'х×*', 'xxx')"
_RS = r"^([0-9]{2,5})\s*x\s*([0-9]{2,5})(?:\s*[x_-]\s*([0-9]{2,5}))?$"
_LS = r"^(?:d|dn|ф)\s*([0-9]{2,5})\s*[-_]\s*([0-9]{2,5})$"
_CS = r"^(?:d|dn|ф)?\s*([0-9]{2,5})$"
_LISTED = ", ".join(f"('{article}')" for article, *_ in fv.ARTICLES)
_CODES = ", ".join(f"('{a}', '{','.join(codes)}')" for a, codes in fv.ARTICLE_MATERIALS.items())

ORACLE = {
    "spec_order_lines": f"""WITH {o.parsed(_LINE)}
        SELECT line_no, order_id, article, {o.PARAMS} AS params, pieces AS quantity, final_code AS material_code,
          coalesce(named_thickness, CASE line_no % 4 WHEN 0 THEN 0.7 WHEN 2 THEN 1.0 ELSE 0.8 END) AS thickness,
          sides, {o.COMMENT} AS comment FROM out WHERE ordered""",
    "spec_skipped_lines": f"""WITH {o.parsed(_LINE)}
        SELECT line_no, CASE WHEN article IS NULL THEN name ELSE name END AS name, CASE WHEN article IS NULL THEN sz ELSE size END AS size,
          CASE WHEN article IS NULL THEN ul ELSE unit END AS unit, reason,
          CASE WHEN article IS NULL THEN ocr_warning END AS ocr_warning FROM out WHERE NOT ordered""",
    "spec_skipped_reasons": f"""WITH {o.parsed(_ITEMS)}
        SELECT reason, count(*) AS n_lines FROM out WHERE NOT ordered GROUP BY reason""",
    "article_distribution": f"""WITH {o.parsed(_ITEMS)}
        SELECT article, count(*) AS n_lines, CAST(sum(pieces) AS BIGINT) AS pieces FROM out WHERE ordered GROUP BY article""",
    "row_totals": f"""WITH {o.parsed(_LINE)}
        SELECT CASE WHEN ordered THEN 'order' ELSE 'skipped' END AS status, count(*) AS n_lines,
          count(*) FILTER (WHERE ocr_warning IS NOT NULL AND (ordered OR article IS NULL)) AS n_repaired FROM out GROUP BY 1""",
    "fitting_classify": f"""WITH {o.parsed(_LINE)}
        SELECT line_no, route, ptype, article, {o.PARAMS} AS params, sides FROM out WHERE route IN ('fitting', 'adapter')""",
    "unit_quantity_normalise": f"""WITH l AS ({_ITEMS}), v AS (SELECT *, CAST(quantity AS DOUBLE) AS qty FROM l)
        SELECT CASE WHEN regexp_matches(lower(size), '(?:^|\\s)(?:d|dn|ф)?\\s*[0-9]+') THEN 'м' ELSE 'шт' END AS guessed_unit,
          CASE WHEN unit IN ('шт', 'шт.') THEN 'шт' WHEN unit IN ('м', 'метр') THEN 'м' WHEN unit IN ('м2', 'м²') THEN 'м²' ELSE unit END AS canonical_unit,
          count(*) AS n,
          CAST(sum(CASE WHEN unit IN {o.in_list(fv.PIECE_UNITS)} THEN trunc(qty) ELSE greatest(1, round_even(qty, 0)) END) AS BIGINT) AS pieces,
          CAST(sum(greatest(1, round_even(qty / 1.25, 0))) AS BIGINT) AS ducts
        FROM v GROUP BY 1, 2""",
    "size_tokens": f"""WITH l AS ({_LINE}), t AS (SELECT *, CASE WHEN size <> '' THEN size ELSE {o.size_token('name')} END AS token FROM l)
        SELECT line_no, token, {o.canon('token')} AS canon,
          CASE WHEN regexp_matches({_LOW}, {o.q(_RS)}) THEN 'rectangular'
            WHEN regexp_matches({_LOW}, {o.q(_LS)}) OR regexp_matches({_LOW}, {o.q(_CS)}) THEN 'round' END AS section,
          coalesce({o.num(_LOW, _LS)}, {o.num(_LOW, _CS)}) AS d0, {o.num(_LOW, _RS, 1)} AS a0, {o.num(_LOW, _RS, 2)} AS b0,
          coalesce({o.num(_LOW, _RS, 3)}, {o.num(_LOW, _LS, 2)}) AS l0 FROM t""",
    "ocr_size_repair": f"""WITH {o.parsed(_LINE)}
        SELECT line_no, sz AS size, trim(concat_ws(' ', plain_comment, '[' || mat_warning || ']')) AS line_text,
          '[' || ocr_warning AS warning FROM out WHERE ordered AND ocr_warning IS NOT NULL""",
    "product_type": f"""WITH l AS (SELECT lower(name) AS nl FROM ({_ITEMS}) AS i)
        SELECT {o.ptype_case('nl')} AS ptype,
          CASE WHEN regexp_matches(nl, 'прямоугольн') THEN true WHEN regexp_matches(nl, 'кругл') THEN false
            ELSE regexp_matches(nl, '[0-9]{{2,4}}\\s*[xх×*]\\s*[0-9]{{2,4}}') END AS rect,
          CASE WHEN regexp_matches(nl, {o.q(f'(^|{o._NW})кругл')}) THEN true WHEN regexp_matches(nl, {o.q(f'(^|{o._NW})прямоугольн')}) THEN false
            ELSE regexp_matches(nl, '(?:d|dn|ф)\\s*[0-9]+') END AS circ,
          {o.RECT_PRODUCT} AS rect_product, count(*) AS n FROM l GROUP BY ALL""",
    "material_thickness": f"""WITH l AS ({_LINE}), n AS (SELECT *, lower(name) AS nl FROM l)
        SELECT line_no, CASE WHEN {o.contains_any('nl', ['нерж', 'aisi'])} THEN 'нержавеющая'
            WHEN {o.contains_any('nl', ['черн', 'ст3', 'ст.3', 'ст-3'])} THEN 'черная' ELSE 'оцинкованная' END AS material,
          CASE WHEN contains(material, 'нерж') THEN '2' ELSE '1' END AS column_code,
          {o.thickness()} AS thickness FROM n""",
    "explicit_lines": f"""WITH b AS (SELECT p_partkey, concat(p_name, ' ', CAST(p_size AS VARCHAR)) AS comment, p_size,
            CAST(p_retailprice / 100 AS DOUBLE) AS qty,
            CASE p_partkey % 5 WHEN 0 THEN '3-3-2' WHEN 1 THEN '17-2-1' WHEN 2 THEN '99-1' WHEN 3 THEN '21-1-1' END AS explicit,
            p_size >= 10 AS duct, p_partkey % 3 AS u, p_partkey % 2 = 0 AS rect FROM part),
          r AS (SELECT *, CASE WHEN explicit IS NOT NULL THEN explicit WHEN duct AND u <> 1 THEN '1-1-2' END AS article FROM b)
        SELECT p_partkey AS line_no, CASE WHEN article IS NULL OR article = '99-1' THEN 'skipped' ELSE 'order' END AS status, article,
          CASE WHEN article IS NULL OR article = '99-1' THEN NULL WHEN explicit IS NULL THEN concat('D0=', p_size, ',L0=3000')
            WHEN rect THEN concat('A0=', p_size, ',L0=100') ELSE concat('D0=', p_size) END AS params,
          CASE WHEN article IS NULL OR article = '99-1' THEN NULL WHEN u <> 1 THEN CAST(trunc(qty) AS BIGINT)
            ELSE greatest(1, CAST(round_even(qty, 0) AS BIGINT)) END AS quantity,
          CASE WHEN article IS NULL OR article = '99-1' THEN NULL WHEN article = '3-3-2' THEN '6200' WHEN explicit IS NOT NULL AND rect THEN '6600' ELSE '2200' END AS sides,
          CASE WHEN article IS NULL OR article = '99-1' THEN NULL ELSE comment END AS comment,
          CASE WHEN article = '99-1' THEN concat({o.q(fv.REASON_NOT_ALLOWED[0])}, article, {o.q(fv.REASON_NOT_ALLOWED[1])})
            WHEN article IS NULL THEN {o.q(fv.REASON_UNKNOWN)} END AS reason
        FROM r""",
    "allowed_split": f"""WITH listed(a) AS (VALUES {_LISTED}), p AS (SELECT concat(p_partkey % 12 + 1, '-', p_size % 3, '-', p_partkey % 7) AS parsed_article FROM part)
        SELECT parsed_article, parsed_article IN (SELECT a FROM listed) AS is_allowed, count(*) AS n FROM p GROUP BY 1, 2""",
    "material_validity": f"""WITH m(article, codes) AS (VALUES {_CODES}),
          p AS (SELECT p_partkey, concat(p_partkey % 22 + 1, '-', p_size % 3, '-', p_partkey % 5) AS parsed_article, CAST(p_partkey % 3 + 1 AS VARCHAR) AS w FROM part)
        SELECT p_partkey, parsed_article, CASE WHEN contains(codes, w) OR codes IS NULL THEN w ELSE codes[1] END AS material_code,
          CASE WHEN NOT contains(codes, w) THEN concat('материал ', w, ' не поддерживается артикулом ', parsed_article, ', использован ', codes[1]) END AS material_warning
        FROM p LEFT JOIN m ON parsed_article = article""",
}
