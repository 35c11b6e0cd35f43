"""Running values over long ordered groups, computed block by block.

A plain window puts a whole group into one task; a document or table may hold a large part of all
rows.  Here rows are cut into blocks of consecutive order numbers, every block is reduced to one
row, the few block rows are scanned, and the rows of a block start from what the scan hands them.
The result is the same; the large shuffle is by (group, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 50_000


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add running sums and last non-null values up to and including each row.

    `order` is a whole number, unique within the group; rows with null keys are a group of their own.
    """
    sums, lasts = sums or {}, lasts or {}
    staged = df.withColumns({
        "_block": F.floor(F.col(order) / F.lit(block_rows)).cast("bigint"),
        **{f"_s_{n}": c.cast("bigint") for n, c in sums.items()},
        **{f"_l_{n}": c for n, c in lasts.items()},
    })
    blocks = staged.groupBy(*keys, "_block").agg(
        *[F.sum(f"_s_{n}").alias(f"_bs_{n}") for n in sums],
        *[
            F.max_by(f"_l_{n}", F.when(F.col(f"_l_{n}").isNotNull(), F.col(order))).alias(f"_bl_{n}")
            for n in lasts
        ],
    )
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(
        *keys,
        "_block",
        *[F.coalesce(F.sum(f"_bs_{n}").over(before), F.lit(0)).alias(f"_cs_{n}") for n in sums],
        *[F.last(f"_bl_{n}", ignorenulls=True).over(before).alias(f"_cl_{n}") for n in lasts],
    )
    # Keys may be null: such rows are a document of their own.
    named = carried.select(*[F.col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.col("_block").alias("_kb"), *[c for c in carried.columns if c not in (*keys, "_block")])
    same = F.col("_block") == F.col("_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{i}"))
    joined = staged.join(named, same)
    here = (
        Window.partitionBy(*keys, "_block").orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return joined.select(
        *df.columns,
        *[(F.sum(f"_s_{n}").over(here) + F.col(f"_cs_{n}")).alias(n) for n in sums],
        *[
            F.coalesce(F.last(f"_l_{n}", ignorenulls=True).over(here), F.col(f"_cl_{n}")).alias(n)
            for n in lasts
        ],
    )
