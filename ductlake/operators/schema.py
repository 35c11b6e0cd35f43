"""Headers and rows to the common shapes (N2..N4, N7, N10, P7, W2, U2, P8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions import classify, text
from ductlake.session import spread

TARGETS = list(fv.HEADER_KEYWORDS)


def header_mask(normalised: Column) -> Column:
    """Bit i is set when a keyword of target i occurs in the header."""
    mask = F.lit(0)
    for i, target in enumerate(TARGETS):
        hit = classify.any_contains(normalised, fv.HEADER_KEYWORDS[target])
        mask = mask.bitwiseOR(F.when(hit, F.lit(1 << i)).otherwise(F.lit(0)))
    return mask


def header_targets(headers: list[str]) -> list[str | None]:
    """The target of each of one table's columns, or None; each target is given once, left to right."""
    import re

    out: list[str | None] = []
    for header in headers:
        name = re.sub(r"\s+", " ", re.sub(r"[._\\/|-]+", " ", header.lower().strip().replace("ё", "е")))
        out.append(next((t for t in TARGETS if t not in out and any(k in name for k in fv.HEADER_KEYWORDS[t])), None))
    return out


def map_headers(headers: list[str]) -> dict[str, str]:
    """Column name -> target for one table's headers."""
    return {h: t for h, t in zip(headers, header_targets(headers)) if t}


def map_header_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """N1/N2 for many tables at once: header cells (keys, col_no, text) -> (keys, target, col_no).

    A table's headers are folded left to right; the state is the set of targets already given, as
    bits.  Only header cells are grouped, so a group is as long as a table is wide.
    """
    named = cells.select(
        *keys, "col_no", text.normalise_header(F.coalesce("text", F.lit(""))).alias("header")
    )
    # Behind a generator, so that the filter does not test every keyword a second time.
    masks = named.select(
        *keys, "col_no", F.inline(F.array(F.struct(header_mask(F.col("header")).alias("mask"))))
    ).filter(F.col("mask") != 0)
    rows = masks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col_no", "mask"))).alias("cols"))
    start = F.struct(
        F.lit(0).alias("used"), F.array().cast("array<struct<bit:int,col_no:bigint>>").alias("given")
    )

    def step(state: Column, col: Column) -> Column:
        free = col["mask"].bitwiseAND(F.bitwise_not(state["used"]))
        lowest = free.bitwiseAND(-free)
        return F.struct(
            state["used"].bitwiseOR(lowest).alias("used"),
            F.when(
                lowest != 0,
                F.array_append(
                    state["given"],
                    F.struct(lowest.alias("bit"), col["col_no"].cast("bigint").alias("col_no")),
                ),
            ).otherwise(state["given"]).alias("given"),
        )

    given = rows.select(*keys, F.explode(F.aggregate("cols", start, step)["given"]).alias("g"))
    names = F.array(*[F.lit(t) for t in TARGETS])
    return given.select(
        *keys,
        F.get(names, F.log2(F.col("g.bit")).cast("int")).alias("target"),
        F.col("g.col_no").alias("col_no"),
    )


def drop_empty(df: DataFrame) -> DataFrame:
    """Without columns and rows that are null throughout (one counting pass for the columns)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    kept = [c for i, c in enumerate(df.columns) if counts[i] > 0]
    return df.select(*[F.col(f"`{c}`") for c in kept]).dropna("all") if kept else df.limit(0)


def normalise_columns(df: DataFrame, carried: list[str] = []) -> DataFrame:
    """The six standard columns of a table with free headers; missing ones are null."""
    mapping = map_headers([c for c in df.columns if c not in carried])
    source = {target: header for header, target in mapping.items()}
    columns = [
        (F.col(f"`{source[t]}`").cast("string") if t in source else F.lit(None).cast("string")).alias(t)
        for t in TARGETS
    ]
    table = df.select(*carried, *columns)
    if not mapping:
        return table.limit(0)
    return table


def spec_rows(df: DataFrame) -> DataFrame:
    """Normalised columns to specification lines with defaults filled in."""
    carried = [c for c in df.columns if c not in TARGETS]
    size = text.clean(F.col("size"))
    unit = text.clean(F.col("unit"))
    material = text.clean(F.col("material"))
    return df.select(
        *carried,
        text.clean(F.col("name")).alias("name"),
        size.alias("size"),
        F.when(unit != "", unit).otherwise(text.unit_from_size(size)).alias("unit"),
        text.number_or(F.col("quantity"), 0.0).alias("quantity"),
        F.when(material != "", material).otherwise(F.lit(fv.DEFAULT_MATERIAL)).alias("material"),
        text.number_or(F.col("thickness"), fv.DEFAULT_THICKNESS).alias("thickness"),
    )


def editor_rows(df: DataFrame) -> DataFrame:
    """Rows edited by hand: names lowered, params text to a map, bad numbers to defaults."""
    columns = {c.strip().lower(): F.col(f"`{c}`") for c in df.columns}
    types = {f.name.strip().lower(): f.dataType.simpleString() for f in df.schema.fields}
    out = {
        n: text.strip(c) if types[n] == "string" else c for n, c in columns.items()
    }
    if types.get("params") == "string":
        parsed = F.from_json(columns["params"], "map<string,double>")
        out["params"] = F.coalesce(parsed, F.create_map().cast("map<string,double>"))
    out["quantity"] = text.number_or(columns.get("quantity", F.lit("0")).cast("string"), 0.0)
    out["thickness"] = text.number_or(
        columns.get("thickness", F.lit("0.8")).cast("string"), fv.DEFAULT_THICKNESS
    )
    return df.select(*[c.alias(n) for n, c in out.items()])


def price_items(skipped: DataFrame, keys: list[str] = []) -> DataFrame:
    """Skipped lines of both kinds to distinct items for the price search.

    Lines with a `raw_name` come from the equipment mapping, the others from the specification.
    Rows as given fall together first, before rows are exchanged, so that texts and numbers are
    cleaned once per different row; then cleaned ones do, and only distinct items are typed.
    """
    used = [c for c in ("raw_name", "name", "model", "size", "unit", "quantity") if c in skipped.columns and c not in keys]
    skipped = skipped.select(*keys, *used).distinct()

    def have(name: str) -> Column:
        return F.col(name).cast("string") if name in skipped.columns else F.lit(None).cast("string")

    mapped = have("raw_name").isNotNull()
    unit = text.clean(have("unit"))
    items = skipped.select(
        *keys,
        F.when(mapped, text.clean(have("raw_name"))).otherwise(text.clean(have("name"))).alias("name"),
        F.when(mapped, text.clean(have("model"))).otherwise(text.clean(have("size"))).alias("size"),
        F.when(mapped | (unit == ""), F.lit("шт")).otherwise(unit).alias("unit"),
        F.when(mapped, F.lit(1.0)).otherwise(text.number_or(have("quantity"), 1.0)).alias("quantity"),
    ).filter(F.col("name") != "")
    distinct = spread(items.withColumn("name_lower", F.lower("name")).distinct(), "name", "size")
    # Behind a generator, so that the filter is not copied with its patterns below the aggregation.
    typed = distinct.select(
        *keys, "name", "size", "unit", "quantity",
        F.inline(F.array(F.struct(classify.product_type(F.col("name_lower")).alias("category")))),
    )
    return typed.filter(F.col("category").isin(fv.RESOLD_TYPES))


def all_skipped(spec_skipped: DataFrame, equipment_skipped: DataFrame) -> DataFrame:
    """Skipped lines of both stages, missing columns null."""
    return spec_skipped.unionByName(equipment_skipped, allowMissingColumns=True)


def categories(items: DataFrame) -> DataFrame:
    """The categories present, sorted."""
    return items.select("category").filter(F.col("category").isNotNull()).distinct().orderBy("category")
