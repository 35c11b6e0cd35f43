"""Session defaults and size-checked broadcasting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rule and catalogue tables are hundreds of rows.  Above this row count a table is joined without
# a broadcast hint and the optimiser decides from its own size statistics.
BROADCAST_MAX_ROWS = 20_000


def build_session(app_name: str = "ductlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are designed for; explicit `conf` wins."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Java's own case mapping; the texts hold Latin and Cyrillic letters only.
        "spark.sql.icu.caseMappings.enabled": "false",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def broadcast_checked(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint for a dimension table, given only after counting at most `max_rows` + 1 rows."""
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    return F.broadcast(df)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over all shuffle partitions: before costly work, or for the small side of a join.

    Adaptive execution joins small partitions by their bytes, which would leave such work to a few
    tasks; a given partition count is kept.  Rows go by a hash of the keys and not by the keys
    themselves, so that a later join on the keys brings its own exchange: adaptive execution splits
    a hot key only where exchanges sit directly below the join.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, F.xxhash64(*keys))


def held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """`df` with further columns that leave through a one-row generator.

    The optimiser neither substitutes a generated column into what follows nor derives constraints from
    its expression.  Through plain selects it does both, and with expressions as large as the classifier's
    most of a query's fixed time goes there.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
