"""Writers of orders, skipped lines, price history and reports (K1..K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_orders(documents: DataFrame, path: str) -> None:
    """K1: order documents as a table, in ranges of order_id; the form for many orders."""
    documents.repartitionByRange("order_id", "fragment_no").write.mode("overwrite").parquet(path)


def write_order_xml(documents: DataFrame, path: str) -> None:
    """K1: one folder per order; its files put together in name order are the document.

    For handing over a moderate number of orders; `write_orders` makes no folder per order.
    An order of ordinary length is one file.  Rows are range-partitioned by order and fragment, so a
    very long order is written by several tasks.
    """
    (
        documents.repartitionByRange("order_id", "fragment_no")
        .sortWithinPartitions("order_id", "fragment_no")
        .select("order_id", F.rtrim(F.col("xml"), F.lit("\n")).alias("xml"))
        .write.mode("overwrite").partitionBy("order_id").text(path)
    )


def write_skipped(skipped: DataFrame, path: str) -> None:
    """K2: skipped lines with their reasons."""
    skipped.write.mode("overwrite").json(path)


def append_history(offers: DataFrame, path: str) -> None:
    """K3: add kept offers with their item to the history, by day of reading; nothing for none."""
    (
        offers.withColumn("scraped_on", F.to_date("scraped_at"))
        .repartitionByRange("scraped_on", "scraped_at")  # few files a day, and a full day in several tasks
        .write.mode("append").partitionBy("scraped_on").parquet(path)
    )


def write_price_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """K4: the price report as JSON lines or headed CSV."""
    writer = report.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.json(path)
