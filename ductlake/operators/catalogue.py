"""Free descriptions to catalogue articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ductlake.functions import matching as m
from ductlake.functions.size import description_dimensions
from ductlake.session import spread

# Products handled as one array; a larger catalogue is cut into pieces of this size.
PIECE = 512
# A catalogue of at most so many pieces (4096 products) is broadcast; a larger one is joined.
BROADCAST_PIECES = 8
# Parts in which classes of products meet classes of texts.
CLASS_PIECES = 8


def _product_features(products: DataFrame) -> DataFrame:
    named = products.select("catalogue_pos", "article", "section", m.normalise(F.col("name")).alias("name"))
    return named.withColumn("mask", m.word_mask(F.col("name")))


def product_pieces(products: DataFrame) -> DataFrame:
    """Catalogue as a few rows (piece, items array), every piece of bounded size."""
    return (
        _product_features(products)
        .withColumn("piece", F.floor(F.col("catalogue_pos") / PIECE).cast("int"))
        .groupBy("piece")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("catalogue_pos", "article", "name", "section", "mask"))
            ).alias("items")
        )
    )


def description_features(texts: DataFrame, column: str = "description") -> DataFrame:
    """Distinct descriptions with normalised text, word bits and inferred section."""
    distinct = spread(texts.select(F.col(column).alias("description")).distinct(), "description")
    features = distinct.withColumns({
        "norm": m.normalise(F.col("description")),
        "inferred": m.inferred_section(description_dimensions(F.col("description"))),
    })
    return features.withColumns({
        "text_mask": m.word_mask(F.col("norm")), "text_hints": m.section_hints(F.col("norm")),
    })


TEXT_CLASS = ["text_mask", "text_hints", "inferred"]


def product_classes(products: DataFrame, top_n: int) -> DataFrame:
    """(section, mask, best): products that every text scores alike, and their first `top_n` in catalogue order.

    The rank is cut per task before the exchange, so a class of very many products sends n rows a task.
    """
    first = Window.partitionBy("section", "mask").orderBy("catalogue_pos", "article")
    kept = _product_features(products).withColumn("place", F.row_number().over(first)).filter(F.col("place") <= top_n)
    return kept.groupBy("section", "mask").agg(F.collect_list(F.struct("catalogue_pos", "article")).alias("best"))


def scored_classes(texts: DataFrame, classes: DataFrame, top_n: int) -> DataFrame:
    """Text classes with their best products: (`TEXT_CLASS`, best of (neg, catalogue_pos, article)).

    Sections, word bits and hints are all that a score without letters looks at, so classes of texts meet
    classes of products; both are bounded by the words and not by the number of texts or products.
    """
    pieces = classes.withColumn("piece", F.pmod(F.xxhash64("section", "mask"), F.lit(CLASS_PIECES)).cast("int")).groupBy("piece").agg(
        F.collect_list(F.struct("section", "mask", "best")).alias("classes"))
    asked = texts.select(*TEXT_CLASS).distinct().withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(CLASS_PIECES - 1))))

    def of_class(c: Column) -> Column:
        base = m.keyword_score(F.col("text_mask"), F.col("text_hints"), c["mask"], c["section"]) + m.section_bonus(F.col("inferred"), c["section"])
        return F.transform(c["best"], lambda p: F.struct((-base).alias("neg"), p["catalogue_pos"].alias("catalogue_pos"), p["article"].alias("article")))

    def best(entries: Column) -> Column:
        return F.slice(F.array_sort(entries), 1, top_n)

    of_piece = asked.join(pieces, "piece").select(*TEXT_CLASS, best(F.flatten(F.transform("classes", of_class))).alias("best"))
    return of_piece.groupBy(*TEXT_CLASS).agg(best(F.flatten(F.collect_list("best"))).alias("best"))


def match_by_classes(texts: DataFrame, products: DataFrame, top_n: int = 5, column: str = "description") -> DataFrame:
    """As `match_descriptions` without letters, class by class: (description, rank, article, score)."""
    described = description_features(texts, column)
    found = scored_classes(described, product_classes(products, top_n), top_n)
    known = [F.coalesce(F.col("inferred"), F.lit("")).alias("inferred_") if c == "inferred" else F.col(c) for c in TEXT_CLASS]
    keys = ["text_mask", "text_hints", "inferred_"]
    joined = described.select("description", *known).join(spread(found.select(*known, "best"), *TEXT_CLASS[:2]), keys)
    return _ranks(joined)


def _ranks(ranked: DataFrame) -> DataFrame:
    return ranked.select("description", F.posexplode("best").alias("pos", "b")).select(
        "description", (F.col("pos") + 1).alias("rank"), F.col("b.article").alias("article"),
        (-F.col("b.neg")).alias("score"),
    )


def _held(name: str, value: Column) -> Column:
    return F.inline(F.array(F.struct(value.alias(name))))


def match_descriptions(
    texts: DataFrame, products: DataFrame, top_n: int = 5, column: str = "description",
    with_similarity: bool = True,
) -> DataFrame:
    """Best `top_n` products per distinct description: (description, rank, article, score).

    Descriptions are deduplicated first.  Scoring is one projection per catalogue piece; a piece
    keeps only the products whose largest possible score can still reach the n-th surest one, and
    only those are compared letter by letter.  Join the result back on the description.  Without letters
    the work is by classes (`match_by_classes`).
    """
    if not with_similarity:
        return match_by_classes(texts, products, top_n, column)
    pieces = product_pieces(products)
    n_pieces = (products.agg(F.max("catalogue_pos")).first()[0] or 0) // PIECE + 1
    features = description_features(texts, column).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.lit(n_pieces - 1)))
    )
    if n_pieces <= BROADCAST_PIECES:
        joined = features.join(F.broadcast(pieces), "piece")
    else:
        # A piece meets all descriptions: every shuffle partition's share of them gets its own copy.
        shares = int(features.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        copies = pieces.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        dealt = features.withColumn("share", F.pmod(F.xxhash64("description"), F.lit(shares)).cast("int"))
        joined = dealt.join(copies, ["piece", "share"]).drop("share")
    length = F.length("norm")
    scored = joined.withColumn(
        "scored",
        F.transform(
            "items",
            lambda p: F.struct(
                (
                    m.keyword_score(F.col("text_mask"), F.col("text_hints"), p["mask"], p["section"])
                    + m.section_bonus(F.col("inferred"), p["section"])
                ).alias("base"),
                m.ratio_bound(length, F.length(p["name"])).alias("bound"),
                p["catalogue_pos"].alias("catalogue_pos"),
                p["article"].alias("article"),
                p["name"].alias("name"),
            ),
        ),
    )
    # Each step leaves through a generator: a column used inside a lambda would otherwise be
    # computed again for every element.
    held = scored.select("description", "norm", _held("scored", F.col("scored")))
    sure = F.sort_array(F.transform("scored", lambda s: s["base"]), asc=False)
    floored = held.select(
        "description", "norm", "scored", _held("floor", F.coalesce(F.get(sure, top_n - 1), F.lit(-1.0)))
    )
    pruned = floored.select(
        "description", "norm",
        _held("scored", F.filter("scored", lambda s: s["base"] + s["bound"] * 10 >= F.col("floor"))),
    )
    best = m.top_similar(top_n)(
        F.col("norm"),
        F.transform("scored", lambda s: s["name"]),
        F.transform("scored", lambda s: s["base"]),
        F.transform("scored", lambda s: s["bound"]),
    )
    ranked = pruned.withColumn("best", best).withColumn(
        "best",
        F.transform(
            "best",
            lambda b: F.struct(
                (-b["score"]).alias("neg"),
                F.get(F.col("scored"), b["position"])["catalogue_pos"].alias("catalogue_pos"),
                F.get(F.col("scored"), b["position"])["article"].alias("article"),
            ),
        ),
    )
    if n_pieces > 1:
        ranked = ranked.groupBy("description").agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, top_n).alias("best")
        )
    return _ranks(ranked)
