"""Reading the given tables for the registered queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def load(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """A fixture statement over the given tables; only the tables it names are read."""
    names = set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql))
    return spark.sql(sql, **{n: table(spark, sf, n) for n in names})
