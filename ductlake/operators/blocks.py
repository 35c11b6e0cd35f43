"""Product blocks out of a module text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions.text import find, strip
from ductlake.operators.running import BLOCK_ROWS, running
from ductlake.session import spread

OPENING = r"(?U)^(?:Если|ИначеЕсли)\s+ПродуктШапка\s*=\s*Справочники\.асПродукция\.(\w+)\s*Тогда(?:\s*//+\s*(.*))?"
DESIGNATION = r"(?U)^Обозначение\s*=\s*(.+);"
GROUP_LINE = r'(?U)^АртикулГруппы\s*=\s*"([^"]+)";'
ARTICLE_LINE = r'(?U)^АртикулПродукции\s*=\s*"([^"]+)";'
CLOSING = "КонецЕсли"


def designation_parameters(expression: Column) -> Column:
    """Sorted distinct parameters whose variables an expression uses as whole words."""
    hits = [
        F.when(expression.rlike(rf"(?U)\b{variable}\b"), F.lit(parameter))
        for variable, parameter in fv.DESIGNATION_VARIABLES.items()
    ]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))


def product_blocks(
    lines: DataFrame, keys: list[str], order: str = "line_no", text: str = "text",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(product_ref, comment, designation_expression, article, group_code, xml_parameters).

    A block opens at its condition and ends at its article line or, with no article, at the end of
    the condition; what follows its end belongs to no block.  Blocks without a designation are left
    out.  Blocks are numbered by a running count, then reduced by an aggregation.
    """
    line = strip(F.col(text))
    kinds = lines.select(
        *keys, order,
        find(line, OPENING, 1).alias("product_ref"),
        F.when(line.rlike(OPENING), F.regexp_extract(line, OPENING, 2)).alias("comment"),
        find(line, DESIGNATION).alias("designation"),
        find(line, GROUP_LINE).alias("group_code"),
        find(line, ARTICLE_LINE).alias("article"),
        F.startswith(line, F.lit(CLOSING)).alias("closes"),
    )
    marked = kinds.filter(
        F.col("product_ref").isNotNull() | F.col("designation").isNotNull()
        | F.col("group_code").isNotNull() | F.col("article").isNotNull() | F.col("closes")
    )
    numbered = running(
        marked, keys, order, sums={"block_no": F.col("product_ref").isNotNull().cast("int")},
        block_rows=block_rows,
    ).filter(F.col("block_no") > 0)
    ends = numbered.groupBy(*keys, "block_no").agg(
        F.min(F.when(F.col("article").isNotNull() | F.col("closes"), F.col(order))).alias("end_no")
    )
    inside = numbered.join(spread(ends, *keys, "block_no"), [*keys, "block_no"]).filter(
        F.col("end_no").isNull() | (F.col(order) <= F.col("end_no"))
    )

    def last(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))

    blocks = inside.groupBy(*keys, "block_no").agg(
        F.min(order).alias("first_line"),
        F.min_by("product_ref", order).alias("product_ref"),
        F.trim(F.min_by("comment", order)).alias("comment"),
        strip(last("designation")).alias("designation_expression"),
        last("group_code").alias("group_code"),
        last("article").alias("article"),
    ).filter(F.col("article").isNotNull() & F.col("designation_expression").isNotNull())
    return blocks.withColumn(
        "xml_parameters", designation_parameters(F.col("designation_expression"))
    ).drop("block_no")
