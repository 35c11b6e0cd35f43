"""Totals, distributions, reconciliation and catalogue lists (A6, Q1..Q10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def row_totals(parsed: DataFrame) -> DataFrame:
    """Lines per status and how many of them had their size repaired."""
    repaired = F.col("ocr_warning").isNotNull() | F.coalesce(
        F.contains("comment", F.lit("[OCR:")), F.lit(False)
    )
    return parsed.groupBy("status").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(repaired).alias("n_repaired")
    )


def equal_lines(lines: DataFrame) -> DataFrame:
    """Lines that are equal in all columns as one, with their number in `weight`.

    For counts by article or reason: lines are added up before they are parsed, and no line has to
    meet its text again.
    """
    return lines.groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("weight"))


def _weight(df: DataFrame) -> Column:
    return F.col("weight") if "weight" in df.columns else F.lit(1).cast("long")


def article_distribution(parsed: DataFrame) -> DataFrame:
    """Q7: order lines and pieces per article, most frequent first; a column `weight` counts equal lines."""
    weight = _weight(parsed)
    return (
        parsed.filter(F.col("status") == "order").groupBy("article")
        .agg(F.sum(weight).alias("n_lines"), F.sum(F.col("quantity") * weight).alias("pieces"))
        .orderBy(F.desc("n_lines"), "article")
    )


def reason_distribution(skipped: DataFrame) -> DataFrame:
    """Q8: skipped lines per reason; a column `weight` counts equal lines."""
    return skipped.groupBy("reason").agg(F.sum(_weight(skipped)).alias("n_lines"))


def reconcile(manual: DataFrame, parsed: DataFrame, total_label: str = "Итого") -> DataFrame:
    """Q9: pieces per article in two order versions, their difference, and a total row."""
    left = manual.groupBy("article").agg(F.sum("quantity").alias("manual"))
    right = parsed.groupBy("article").agg(F.sum("quantity").alias("parsed"))
    both = left.alias("l").join(right.alias("r"), F.col("l.article").eqNullSafe(F.col("r.article")), "full_outer").select(
        F.coalesce("l.article", "r.article").alias("article"), F.coalesce("manual", F.lit(0)).alias("manual"), F.coalesce("parsed", F.lit(0)).alias("parsed")
    )
    return both.rollup("article").agg(
        F.sum("manual").alias("manual"), F.sum("parsed").alias("parsed"),
        (F.sum("parsed") - F.sum("manual")).alias("difference"), F.grouping("article").alias("is_total"),
    ).withColumn("article", F.when(F.col("is_total") == 1, F.lit(total_label)).otherwise(F.col("article"))).drop("is_total")


# Numbers of one bitmap, as the engine's bitmap functions count them.
BITMAP_BITS = 32_768


def parameter_sets(products: DataFrame, number: str = "catalogue_pos") -> DataFrame:
    """Q10: the articles a parameter applies to as bitmaps: (parameter, bucket, articles).

    `number` counts articles from 0.  A row holds 32,768 numbers, so a parameter that very many articles
    share is many rows of bounded size, and bitmaps are made before anything is exchanged.
    """
    numbered = products.select((F.col(number).cast("long") + 1).alias("n"), F.explode("xml_parameters").alias("parameter")).where("n > 0")
    return numbered.groupBy("parameter", F.bitmap_bucket_number("n").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("articles"))


def merged_sets(sets: DataFrame) -> DataFrame:
    """Sets of several catalogues, numbered alike, as one."""
    return sets.groupBy("parameter", "bucket").agg(F.bitmap_or_agg("articles").alias("articles"))


def set_sizes(sets: DataFrame) -> DataFrame:
    """Articles of each parameter, counted in the bitmaps."""
    return sets.groupBy("parameter").agg(F.sum(F.bitmap_count("articles")).alias("n_articles"))


def set_numbers(sets: DataFrame) -> DataFrame:
    """(parameter, number) of every bit that is set."""
    held = sets.select("parameter", "bucket", F.posexplode(F.expr(f"transform(sequence(1, {BITMAP_BITS // 8}), i -> cast(conv(hex(substring(articles, i, 1)), 16, 10) as int))")).alias("byte", "bits"))
    return held.where("bits <> 0").select("parameter", "bucket", "byte", F.explode(F.expr("filter(sequence(0, 7), k -> (shiftright(bits, k) & 1) = 1)")).alias("bit")).select(
        "parameter", ((F.col("bucket") - 1) * BITMAP_BITS + F.col("byte") * 8 + F.col("bit")).alias("number"))


def parameter_usage(products: DataFrame, number: str = "catalogue_pos") -> DataFrame:
    """Q10: (parameter, article), a row for each article a parameter applies to."""
    names = products.select(F.col(number).cast("long").alias("number"), "article").distinct()
    return set_numbers(parameter_sets(products, number)).join(names, "number").select("parameter", "article")


def catalogue_list(entries: DataFrame, *columns: str) -> DataFrame:
    """Q1, Q3: entries that are neither groups nor deleted, with the name of their group.

    `entries`: code, name, parent_code, is_group, is_deleted and the listed columns.
    """
    groups = entries.select(F.col("code").alias("group_code"), F.col("name").alias("group_name"))
    return (
        entries.filter(~F.col("is_group") & ~F.col("is_deleted"))
        .join(groups, F.col("parent_code") == F.col("group_code"), "left")
        .select("code", "name", *columns, "group_name")
        .orderBy("name", "code")
    )


def first_entries(entries: DataFrame, n: int = 50) -> DataFrame:
    """Q2: the first n entries by name."""
    return (
        entries.filter(~F.col("is_group") & ~F.col("is_deleted"))
        .select("code", "name").orderBy("name", "code").limit(n)
    )


def connection_list(connections: DataFrame) -> DataFrame:
    """Q4: connections that are not deleted, by code."""
    return connections.filter(~F.col("is_deleted")).drop("is_deleted").orderBy("code")


def last_orders(orders: DataFrame, lines: DataFrame, n: int = 10) -> DataFrame:
    """Q5: the last n posted orders with their lines nested.

    The orders are cut down first; only their lines are grouped.
    """
    latest = orders.filter("posted").orderBy(F.desc("order_date"), F.desc("order_id")).limit(n)
    nested = (
        lines.join(F.broadcast(latest.select("order_id")), "order_id")
        .groupBy("order_id")
        .agg(F.array_sort(F.collect_list(F.struct(*[c for c in lines.columns if c != "order_id"]))).alias("lines"))
    )
    return latest.join(nested, "order_id", "left")


def name_like(spark: SparkSession, entries: DataFrame, mask: str, n: int = 20) -> DataFrame:
    """Q6: the first n entries whose name is like the mask, given as a named parameter."""
    return spark.sql(
        "SELECT code, name FROM {entries} WHERE name LIKE :mask ORDER BY name, code LIMIT :n",
        args={"mask": mask, "n": n}, entries=entries,
    )


def nested_lines_text(lines: Column, *fields: str) -> Column:
    """Nested lines as one text, for reports that hold no arrays."""
    return F.array_join(
        F.transform(lines, lambda r: F.concat_ws(":", *[r[f].cast("string") for f in fields])), ";"
    )
