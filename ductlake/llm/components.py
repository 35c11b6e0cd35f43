"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductlake.llm.work import keep
from ductlake.session import spread


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: larger neighbours of each node get its least neighbour.  Small: the node and its smaller ones do.

    The least neighbours come from a pre-aggregated exchange; they are spread, so that the join with a
    node of very many neighbours has exchanges on both sides and can be split.
    """
    pairs = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = spread(pairs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "a")
    joined = pairs.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def connected_components(links: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of `links` (a, b: longs).

    Every round is written to the shared folder; the driver sees a count and a checksum only.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = keep(ordered.where("a > b").distinct(), "links")
    state = _state(now)
    while state[0]:
        following = keep(_star(keep(_star(now, True), "links"), False), "links")
        new_state = _state(following)
        if new_state == state and not following.join(now, ["a", "b"], "left_anti").take(1):
            break
        now, state = following, new_state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
