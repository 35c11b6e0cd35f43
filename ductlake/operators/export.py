"""Order lines to characteristics and XML documents (J3, F-X5, K1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions import classify, formatting as fmt
from ductlake.session import broadcast_checked, held

HEADER_FIELDS = ["numberDate", "numberOrder", "INN", "customer", "email", "phone", "contact"]
# Lines that are put together at once while a document is built.
FRAGMENT_LINES = 20_000
# Bytes of an order that is put together in one value; Spark's values hold 2 GB at most.
WHOLE_BYTES = 256 << 20


def _plain_numbers(values: Column) -> Column:
    return F.forall(F.coalesce(F.map_values(values), F.array().cast("array<string>")), lambda v: v.try_cast("double").isNotNull() | v.isNull())


def product_programs(products: DataFrame) -> DataFrame:
    """X4, F-X6: products with their `program` (`formatting.program`) where any default or forced value is computed.

    Such products keep no values beside it; those of plain numbers, and the built-in ones with them, have none.
    """
    plain = _plain_numbers(F.col("default_params")) & _plain_numbers(F.col("force_params"))
    provenance = F.col("provenance") if "provenance" in products.columns else F.lit("given")
    return products.select(
        "article", "name", "section", "xml_parameters", provenance.alias("provenance"),
        *[F.when(plain, F.col(c)).alias(c) for c in ("default_params", "force_params")],
        F.when(~plain, fmt.program(F.col("xml_parameters"), F.col("default_params"), F.col("force_params"))).alias("program"),
    )


def with_characteristic(lines: DataFrame, products: DataFrame) -> DataFrame:
    """J3, F-X5: product name, section, characteristic, or the reason there is none.

    A line whose article is unknown, whose article's parameter list is not known, or that lacks a required
    parameter gets an `error` and leaves the other lines of its order alone.
    """
    known = product_programs(products).withColumnRenamed("name", "product_name")
    joined = lines.join(broadcast_checked(known), "article", "left")
    required = F.coalesce("xml_parameters", F.array().cast("array<string>"))
    built = fmt.numeric_characteristic(required, F.col("params"), F.col("default_params"), F.col("force_params"))
    invalid = F.lit(None).cast("string")
    # Lines reach Python only if there is a computed value, and then with its program and parameters alone.
    if not known.where(F.col("program").isNotNull()).isEmpty():
        given = F.coalesce(F.when(F.col("program").isNotNull(), F.col("params")), F.create_map().cast("map<string,double>"))
        joined = joined.withColumn("settled", F.arrow_udf(fmt.settle, fmt.SETTLED)("program", given))
        built = F.when(F.col("program").isNotNull(), fmt.settled_characteristic(required, F.col("settled"))).otherwise(built)
        invalid = F.col("settled.invalid")
    unknown_list = (F.size(required) == 0) & (F.coalesce("provenance", F.lit("")) == "")
    article = F.concat(F.lit("Для артикула "), "article")
    # Behind a generator, so that no filter or later column computes the parameters a second time.
    return (
        joined.select("*", F.inline(F.array(built)).alias("built_text", "built_missing"))
        .withColumns({
            "characteristic": F.when(~unknown_list, F.col("built_text")),
            "error": F.when(
                F.col("section").isNull(),
                F.concat(F.lit("Артикул "), "article", F.lit(" не найден в сопоставлении")),
            ).when(
                unknown_list, F.concat(article, F.lit(" неизвестен список параметров"))
            ).when(
                invalid.isNotNull(), F.concat(article, F.lit(" недопустимо выражение параметра "), "built_missing", F.lit(": "), invalid),
            ).when(
                F.col("built_missing").isNotNull(), F.concat(article, F.lit(" не хватает параметра "), "built_missing"),
            ),
        })
        .drop("built_text", "built_missing", "xml_parameters", "default_params", "force_params", "program", "settled", "provenance")
    )


def with_side_codes(lines: DataFrame) -> DataFrame:
    """`lines` with code_0 to code_3, computed once before the element names them (a long choice each)."""
    return held(lines, {f"code_{i}": classify.connection_code(F.col(f"connection_{i}"), F.col("section")) for i in range(4)})


def product_row_xml():
    """One `productRow` element of twelve children, over `with_side_codes`."""
    side = [fmt.xml_element(f"connection_{i}", F.col(f"code_{i}"), 6) for i in range(4)]
    return F.concat(
        F.lit("    <productRow>\n"),
        fmt.xml_element("article", F.col("article"), 6),
        fmt.xml_element("name", F.col("product_name"), 6),
        fmt.xml_element("characteristic", F.col("characteristic"), 6),
        fmt.xml_element("quantity", F.coalesce(F.col("quantity").cast("string"), F.lit("1")), 6),
        fmt.xml_element("material", F.coalesce("material_code", F.lit("1")), 6),
        fmt.xml_element("thickness", F.coalesce(F.col("thickness").cast("string"), F.lit(fv.DEFAULT_XML_THICKNESS)), 6),
        *side,
        fmt.xml_element("system", F.col("system"), 6),
        fmt.xml_element("comment", F.col("comment"), 6),
        F.lit("    </productRow>\n"),
    )


def whole_documents(fragments: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Fragments of `order_xml` put together, one row an order.

    The bytes of an order are added up first.  An order above `max_bytes` (`WHOLE_BYTES` if not given)
    raises an error before its fragments meet in one task: such orders are written as fragments.
    """
    limit = WHOLE_BYTES if max_bytes is None else max_bytes
    sizes = fragments.groupBy("order_id").agg(F.sum(F.octet_length("xml").cast("long")).alias("bytes"))
    too_large = sizes.where(F.col("bytes") > limit).orderBy(F.desc("bytes")).limit(1).collect()
    if too_large:
        order, size = too_large[0]
        raise ValueError(f"order {order} has {size} bytes of XML, more than {limit}; write its fragments instead")
    return fragments.groupBy("order_id").agg(
        F.min("fragment_no").alias("fragment_no"), F.sum("n_lines").cast("int").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fragment_no", "xml"))), lambda p: p["xml"]), "").alias("xml"),
    )


def order_xml(
    lines: DataFrame, headers: DataFrame | None = None, fragment_lines: int | None = None
) -> DataFrame:
    """K1: order documents as (order_id, fragment_no, n_lines, xml).

    `lines` come from `with_characteristic` and have order_id and line_no; lines with an error are
    left out.  A caller that gives `fragment_lines` gets fragments, cut by line number, which put
    together in order are the document; no task holds an order.  Without it an order is one document
    in one row (`whole_documents`), an error above `WHOLE_BYTES`.  Orders without a line produce nothing.
    """
    if fragment_lines is None:
        return whole_documents(order_xml(lines, headers, FRAGMENT_LINES))
    good = with_side_codes(lines.filter(F.col("error").isNull()))
    parts = good.select(
        "order_id",
        F.floor(F.col("line_no") / fragment_lines).cast("bigint").alias("fragment_no"),
        F.struct("line_no", product_row_xml().alias("xml")).alias("line"),
    ).groupBy("order_id", "fragment_no").agg(
        F.array_sort(F.collect_list("line")).alias("rows")
    ).select(
        "order_id", "fragment_no", F.size("rows").alias("n_lines"),
        F.array_join(F.transform("rows", lambda r: r["xml"]), "").alias("body"),
    )
    ends = parts.groupBy("order_id").agg(
        F.min("fragment_no").alias("first_no"), F.max("fragment_no").alias("last_no")
    )
    if headers is not None:
        present = [h if h in headers.columns else None for h in HEADER_FIELDS]
        ends = ends.join(headers.select("order_id", *[h for h in present if h]), "order_id", "left")
    header = F.concat(*[
        fmt.xml_element(h, F.col(h) if headers is not None and h in headers.columns else F.lit(""), 2)
        for h in HEADER_FIELDS
    ])
    opened = ends.select(
        "order_id", "first_no", "last_no",
        F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<Order>\n'), header, F.lit("  <Tabl>\n")).alias("head"),
    )
    is_first = F.col("fragment_no") == F.col("first_no")
    is_last = F.col("fragment_no") == F.col("last_no")
    return parts.join(opened, "order_id").select(
        "order_id", "fragment_no", "n_lines",
        F.concat(
            F.when(is_first, F.col("head")).otherwise(""),
            "body",
            F.when(is_last, F.lit("  </Tabl>\n</Order>\n")).otherwise(""),
        ).alias("xml"),
    )
