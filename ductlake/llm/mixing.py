"""Mixing sources to target weights by Poisson replication.

A source is to make up `weight` of the mixture, so its documents repeat `rate` times on average:
weight x budget / size of the source.  Each document draws its count by inverting the Poisson distribution
at a number that a hash of (seed, doc_id) gives, is exploded by it, and all copies are dealt and ordered by
another hash.  The result depends on ids and seed only, not on partitions or retries.

Defined results: a null source is a source of its own; a null doc_id draws as the text "null"; repeated rows
draw equal counts; a source without a weight gets none of the mixture; extra columns are kept; an empty
table stays empty.  Columns that bear the names of added ones are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ductlake.session import broadcast_checked

ADDED = ["rate", "copies", "copy", "shuffle_key"]
HEX_DIGITS = 12
TERMS = 64


def draw(*parts) -> F.Column:
    """A number below 2**48 from a hash of the parts."""
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, HEX_DIGITS), 16, 10).cast("long")


def source_rates(documents: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, budget: float = 1.0) -> DataFrame:
    """source, size (letters, each document at least one) and rate.

    Without weights a source weighs as its size to the power `exponent`, which lifts small sources.
    `budget` is the size of the mixture as a share of the input.
    """
    sizes = documents.groupBy("source").agg(F.sum(F.greatest(F.lit(1), F.coalesce(F.length("text"), F.lit(0))).cast("long")).alias("size"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(float(exponent))))
    else:
        kind = T.StructType([T.StructField("source", T.StringType()), T.StructField("weight", T.DoubleType())])
        given = documents.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], kind)
        weighted = sizes.alias("s").join(given.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source")), "left").select(
            "s.source", "s.size", F.coalesce("g.weight", F.lit(0.0)).alias("weight"))
    # Sums over a decimal do not depend on the order of the sources.
    whole = weighted.agg(F.sum("size").alias("all_size"), F.sum(F.col("weight").cast(T.DecimalType(30, 6))).cast("double").alias("all_weight"))
    totals = whole.first()
    scale = float(budget) * float(totals["all_size"] or 0) / float(totals["all_weight"] or 1) if totals["all_weight"] else 0.0
    return weighted.select("source", "size", F.round(F.col("weight") * F.lit(scale) / F.col("size"), 9).alias("rate"))


def poisson_count(number: F.Column, rate: F.Column) -> F.Column:
    """Inverse of the Poisson distribution at number / 2**48.

    A rate is cut into `parts` equal ones of at most 16, each with its own number, as exp(-rate) of a large
    rate has no digits left; the sum of their counts is Poisson again.  Beyond `TERMS` terms the remaining
    probability is below the resolution of the number.
    """
    at = number.cast("double") / F.lit(float(1 << (4 * HEX_DIGITS)))
    state = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("total"), F.lit(0).alias("n"))
    step = lambda s, k: F.struct(
        (s["p"] * rate / k).alias("p"), (s["total"] + s["p"] * rate / k).alias("total"),
        F.when(at >= s["total"], k).otherwise(s["n"]).cast("int").alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), state, step)["n"]


def mix_sources(
    documents: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.5, budget: float = 1.0, seed: int = 17,
) -> DataFrame:
    """The documents, each as often as drawn, with rate, copies, copy (from 1) and shuffle_key, in the order of a hash."""
    plain = documents.drop(*ADDED)
    rates = broadcast_checked(source_rates(plain, weights, exponent, budget).select(F.col("source").alias("mix_source_"), "rate"))
    rated = plain.join(rates, F.col("source").eqNullSafe(F.col("mix_source_"))).drop("mix_source_")
    parts = F.ceil(F.col("rate") / 16).cast("int")
    part_rate = F.col("rate") / F.greatest(parts, F.lit(1))
    single = poisson_count(draw(F.lit(seed), F.col("doc_id"), F.lit(1)), part_rate)
    several = F.aggregate(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), F.lit(0), lambda n, k: n + poisson_count(draw(F.lit(seed), F.col("doc_id"), k), part_rate))
    counted = rated.withColumn("copies", F.when(F.col("rate") <= 0, 0).when(parts <= 1, single).otherwise(several))
    copies = counted.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    keyed = copies.withColumn("shuffle_key", draw(F.lit(seed), F.lit("order"), F.col("doc_id"), F.col("copy")))
    # Dealt by the key and sorted inside each part: a shuffle of the whole mixture with one exchange.
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id")
