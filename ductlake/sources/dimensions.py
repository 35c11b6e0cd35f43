"""Built-in dimension tables and readers for their files (S4..S8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ductlake import fixed_values as fv
from ductlake.functions.text import strip

RULE_ITEM = (
    "id string, name string, keywords array<string>, aliases array<string>, "
    "article_round string, article_rect string, dimension_patterns array<string>, "
    "default_params map<string,double>, round_derived_params map<string,string>"
)
RULE_FILE = (
    "version string, description string, defaults struct<material:string,thickness:double,unit:string>, "
    f"categories array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in RULE_ITEM.split(', '))}>>, "
    "skip_keywords array<string>"
)
PRODUCT_ITEM = (
    "article string, name string, comment string, section string, xml_parameters array<string>, "
    "default_params map<string,string>, force_params map<string,string>"
)


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "array(" + ", ".join(_literal(v) for v in value) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def inline_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small literal table; a local relation, so its size is known to the optimiser."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")


# --- built-in tables --------------------------------------------------------------------------


def builtin_allowed(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark, ["article", "section", "name"],
        [(a, s, n) for a, s, n, _, _ in fv.ARTICLES],
    )


def builtin_materials(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark, ["article", "codes"],
        list(fv.ARTICLE_MATERIALS.items()),
    )


def builtin_product_rows() -> list[dict]:
    return [
        {
            "article": a, "section": s or "round", "name": n or "", "xml_parameters": params,
            "default_params": {}, "force_params": fv.FORCED_PARAMS.get(a, {}), "provenance": origin or "",
        }
        for a, s, n, params, origin in fv.ARTICLES
    ]


def builtin_products(spark: SparkSession) -> DataFrame:
    """Seed product map; `catalogue_pos` keeps the file order."""
    table = inline_table(
        spark,
        ["catalogue_pos", "article", "name", "section", "xml_parameters", "force_keys", "force_values", "provenance"],
        [
            (i, r["article"], r["name"], r["section"], r["xml_parameters"],
             list(r["force_params"]), list(r["force_params"].values()), r["provenance"])
            for i, r in enumerate(builtin_product_rows())
        ],
    )
    text_array = "array<string>"
    return table.select(
        "catalogue_pos", "article", "name", "section",
        F.col("xml_parameters").cast(text_array).alias("xml_parameters"),
        F.create_map().cast("map<string,string>").alias("default_params"),
        F.map_from_arrays(
            F.col("force_keys").cast(text_array), F.col("force_values").cast(text_array)
        ).alias("force_params"),
        "provenance",
    )


# --- readers ----------------------------------------------------------------------------------


def read_allowed_articles(spark: SparkSession, path: str) -> DataFrame:
    """One article per line, its number is the first word; headings and totals are skipped."""
    line = strip(F.col("value"))
    first = F.get(F.split(line, r"(?U)\s+"), 0)
    return (
        spark.read.text(path)
        .filter(~F.startswith(line, F.lit("---")) & ~F.startswith(F.lower(line), F.lit("total")))
        .select(first.alias("article"))
        .filter(F.col("article").rlike(r"^[0-9]+-[0-9]+(?:-[0-9]+)?$"))
        .distinct()
    )


def read_article_materials(spark: SparkSession, path: str) -> DataFrame:
    """`{article: [codes]}`; a file that is no such object gives no rows."""
    parsed = F.from_json("value", "map<string,array<string>>")
    return (
        spark.read.text(path, wholetext=True)
        .select(F.explode(parsed).alias("article", "codes"))
        .filter(F.col("codes").isNotNull())
    )


def read_category_rules(spark: SparkSession, path: str) -> DataFrame:
    """Equipment rules with their priority (position in the file)."""
    return (
        spark.read.schema(RULE_FILE).json(path, multiLine=True)
        .select(F.posexplode("categories").alias("priority", "rule"))
        .select("priority", "rule.*")
    )


def read_skip_keywords(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema(RULE_FILE).json(path, multiLine=True)
        .select(F.posexplode("skip_keywords").alias("position", "keyword"))
    )


def read_rule_defaults(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULE_FILE).json(path, multiLine=True).select("defaults.*")


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Product map; of two entries for one article the later one counts."""
    entries = (
        spark.read.text(path, wholetext=True)
        .select(F.posexplode(F.from_json("value", _array_of(PRODUCT_ITEM))).alias("catalogue_pos", "item"))
        .select("catalogue_pos", "item.*")
    )
    last = entries.groupBy("article").agg(
        F.min("catalogue_pos").alias("catalogue_pos"),
        F.max_by(
            F.struct(*[c for c in entries.columns if c not in ("article", "catalogue_pos")]),
            "catalogue_pos",
        ).alias("item"),
    )
    return last.select(
        "catalogue_pos", "article",
        F.coalesce("item.name", "item.comment", F.lit("")).alias("name"),
        F.coalesce("item.section", F.lit("round")).alias("section"),
        "item.xml_parameters", "item.default_params", "item.force_params",
        F.lit("file").alias("provenance"),
    )


def _array_of(ddl: str) -> T.ArrayType:
    return T.ArrayType(T.StructType.fromDDL(ddl))


def read_erp_export(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    """Rows of successful exports; exports with `success = false` carry only an error."""
    schema = T.StructType([
        T.StructField("success", T.BooleanType()),
        T.StructField("error", T.StringType()),
        T.StructField("data", _array_of(row_schema)),
    ])
    return (
        spark.read.schema(schema).json(path, multiLine=True)
        .filter("success")
        .select(F.explode("data").alias("row"))
        .select("row.*")
    )


def read_erp_errors(spark: SparkSession, path: str) -> DataFrame:
    return (
        spark.read.schema("success boolean, error string").json(path, multiLine=True)
        .filter(~F.col("success"))
        .select(F.input_file_name().alias("file"), "error")
    )


def object_ref(ref: Column) -> Column:
    """Readable text of a nested object reference."""
    return ref.getField("Представление")
