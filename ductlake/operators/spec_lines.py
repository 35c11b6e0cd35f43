"""Specification lines to order lines and skipped lines (P1, W6, C12..C14, J1, J2, F-X1..3).

A line's text is classified once per distinct text, the rest is plain arithmetic on the line.  The
two outputs, order lines and skipped lines, are the two sides of one `status` column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions import articles, classify, size, text
from ductlake.session import broadcast_checked, held, spread

# Column -> default used when the input has no such column at all.
OPTIONAL_INPUTS = {"name": "", "size": "", "unit": "", "quantity": "0"}

# A number, but more pieces than 64 bits hold.
REASON_TOO_LARGE = "Слишком большое количество: "


@dataclass(frozen=True)
class SpecDefaults:
    """What a line gets when it says nothing."""

    material: str = fv.DEFAULT_MATERIAL
    thickness: str = str(fv.DEFAULT_THICKNESS)
    round_article: str = fv.DEFAULT_ROUND_ARTICLE
    rect_article: str = fv.DEFAULT_RECT_ARTICLE
    round_length_mm: float = fv.DEFAULT_ROUND_LENGTH_MM
    rect_length_mm: float = fv.DEFAULT_RECT_LENGTH_MM
    adapter_l1_mm: float = fv.DEFAULT_ADAPTER_L1_MM
    prefer_material_column: bool = False


def _column(df: DataFrame, name: str, default: str) -> Column:
    if name not in df.columns:
        return F.lit(default)
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# --- the text of a line ---------------------------------------------------------------------------


def text_features(texts: DataFrame) -> DataFrame:
    """Everything read out of `name` and `size_given`, as columns next to the given ones.

    A chain of selects: each computes what the next refers to several times, so a pattern runs once
    per text, and only where the letters it needs occur.  Each leaves through a generator (`held`).
    """
    inside = F.col("size_given") == ""
    lowered = held(texts, {
        "name_lower": F.lower("name"),
        "name_canon": F.when(inside, text.canonical_size(F.col("name"))),
    })
    named = held(lowered, {
        "tokens": F.when(inside, text.size_tokens(F.col("name_canon"))),
        "material_named": classify.material_from_name(F.col("name")),
        "thick_text": classify.thickness_text(F.col("name_lower")),
        "ptype": classify.product_type(F.col("name_lower")),
    })
    thick = F.col("thick_text")
    found = held(named, {
        "size_found": F.when(inside, text.pick_token(F.col("tokens"))).otherwise(F.col("size_given")),
        "thick_grade": classify.thickness_after_grade(thick),
        "thick_mm": classify.thickness_before_mm(thick),
        "is_fitting": F.coalesce(F.col("ptype").isin(articles.FITTING_TYPES), F.lit(False)),
    })
    measured = held(found, {
        "size_canon": text.canonical_size(F.col("size_found")),
        "thickness_named": F.when(
            thick.isNotNull(),
            classify.thickness_of(thick, F.col("thick_grade"), F.col("thick_mm")),
        ),
    })
    repaired = held(measured, {"size_fixed": size.repair_canonical(F.col("name_lower"), F.col("size_canon"))})
    changed = F.col("size_fixed") != F.col("size_canon")
    sized = held(repaired, {
        "size": F.when(changed, F.col("size_fixed")).otherwise(F.col("size_found")),
        "ocr_warning": F.when(changed, size.ocr_warning(F.col("size_found"), F.col("size_fixed"))),
    })
    joined = held(sized, {"text": F.concat("name", F.lit(" "), "size")})
    spelled = held(joined, {"text_x": text.latin_x(F.lower("text"))})
    line = F.col("text_x")
    fitting = F.col("is_fitting")
    a_sides, b_sides = size.rect_sides(line)
    tokens = held(spelled, {
        "a_sides": F.when(fitting, a_sides),
        "b_sides": F.when(fitting, b_sides),
        "rounds": F.when(fitting, size.diameters(line)),
        "says_rect": F.when(fitting, classify.is_rectangular(line)),
        "says_round": F.when(fitting, classify.is_round(line)),
        "dims_read": F.when(fitting, size.read_dimensions(line)),
        "adapter_read": articles.read_adapter(line),
    })
    coded = held(tokens, {
        "dims_code": size.model_code_size(F.col("dims_read")),
        "adapter": articles.adapter(line, F.col("adapter_read")),
    })
    return held(coded, {
        "dims": F.when(
            fitting,
            size.combine_dimensions(
                F.col("dims_read"), F.col("dims_code"), F.col("a_sides"), F.col("b_sides"), F.col("rounds")
            ),
        ),
    })


def _map_of(params: dict[str, Column]) -> Column:
    entries = F.create_map(*[part for k, v in params.items() for part in (F.lit(k), v)])
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def classify_texts(texts: DataFrame, defaults: SpecDefaults = SpecDefaults()) -> DataFrame:
    """What a line's text alone decides: (carried, name, size_given) plus TEXT_COLUMNS.

    `text_route` is 'adapter', 'fitting', 'aggregate' or 'duct', in this order of preference, or
    null; article, parameters, sides and comment belong to it.

    The results leave through a one-row `inline`.  The optimiser substitutes neither a later filter
    nor a join key through a generator, so a filter on the outcome cannot copy the whole classifier
    into itself (through plain selects it does, and the plan grows without bound).
    """
    features = text_features(texts)
    base = articles.Features(
        F.col("ptype"), F.col("name_lower"), F.col("says_rect"), F.col("says_round"), F.col("dims")
    )
    rect, circ = articles.effective_sections(base)
    flagged = held(features, {"rect": rect, "circ": circ})
    f = articles.Features(
        F.col("ptype"), F.col("name_lower"), F.col("rect"), F.col("circ"), F.col("dims")
    )
    branched = held(flagged, {"branch": articles.tee_branch(f)})
    branch = F.col("branch")
    chosen = held(branched, {"fitting_article": F.when(F.col("is_fitting"), articles.fitting_article(f, branch))})
    decided = F.col("adapter").isNotNull() | F.col("fitting_article").isNotNull()
    seen = held(chosen, {
        "plate_text": articles.read_plate(F.col("fitting_article"), F.col("text")),
        "duct": F.when(
            ~decided & (F.col("size") != ""), size.read_size(size.size_text(F.col("size")))
        ),
    })
    read = held(seen, {"section": size.section_of(F.col("duct"))})
    duct_round = F.col("section") == "round"
    routed = held(read, {
        "text_route": F.when(F.col("adapter").isNotNull(), "adapter")
        .when(F.col("fitting_article").isNotNull(), "fitting")
        .when(F.col("ptype") == "aggregate_fittings", "aggregate")
        .when(F.col("section").isNotNull(), "duct"),
        "duct_article": F.when(
            duct_round,
            F.when(F.contains("name_lower", F.lit("прямошовный")), F.lit("1-1-1"))
            .when(F.contains("name_lower", F.lit("спирально-навивной")), F.lit("1-1-2"))
            .otherwise(F.lit(defaults.round_article)),
        ).otherwise(F.lit(defaults.rect_article)),
        "duct_length": F.coalesce(
            F.col("duct.L0"),
            F.when(duct_round, F.lit(defaults.round_length_mm)).otherwise(F.lit(defaults.rect_length_mm)),
        ),
    })
    route = F.col("text_route")
    duct_params = {
        "D0": F.col("duct.D0"), "A0": F.col("duct.A0"), "B0": F.col("duct.B0"),
        "L0": F.col("duct_length"),
    }
    adapter_params = {p: F.col(f"adapter.{p}") for p in ("D0", "D1", "A0", "B0", "L0")}
    adapter_params["L1"] = F.lit(defaults.adapter_l1_mm)
    results = {
        "text_article": F.when(route == "adapter", F.col("adapter.article"))
        .when(route == "fitting", F.col("fitting_article"))
        .when(route == "duct", F.col("duct_article")),
        "text_params": F.when(route == "adapter", _map_of(adapter_params))
        .when(
            route == "fitting",
            _map_of(articles.fitting_params(F.col("fitting_article"), f, branch, F.col("plate_text"))),
        )
        .when(route == "duct", _map_of(duct_params)),
        "text_sides": F.when(
            (route == "fitting") & (F.col("ptype") == "transition"),
            classify.default_connections(F.col("circ"), F.col("fitting_article")),
        )
        .when(route == "duct", classify.default_connections(duct_round))
        .otherwise(F.lit("0000")),
        "text_comment": F.when(
            route == "adapter", F.concat(F.lit("КСД адаптер: "), "name", F.lit(" "), "size")
        )
        .when(
            (route == "fitting") & (F.col("ptype") == "cap"),
            F.concat("name", F.lit(" "), articles.cap_comment_size(f)),
        )
        .otherwise(F.col("text")),
    }
    shown = [F.col(c) for c in ("text_route", "ptype", "size", "ocr_warning", "material_named", "thickness_named", "duct_length")]
    outputs = shown + [c.alias(n) for n, c in results.items()]
    return routed.select(*texts.columns, F.inline(F.array(F.struct(*outputs))))


# --- the line ---------------------------------------------------------------------------------------


INPUTS = {"name", "size", "unit", "quantity", "material", "thickness", "article", "params", "system"}


def clean_lines(df: DataFrame, defaults: SpecDefaults = SpecDefaults()) -> DataFrame:
    """Cleaned inputs, blank lines dropped.

    Input columns: name, size, unit, quantity, material, thickness (all optional text), article and
    params (optional, an explicit choice); every other column is carried along untouched.
    """
    carried = [c for c in df.columns if c not in INPUTS]
    if {"article", "params"} <= set(df.columns):
        given = F.coalesce((text.clean(F.col("article")) != "") & (F.size("params") > 0), F.lit(False))
        article = F.when(given, text.clean(F.col("article")))
        params = F.when(given, F.col("params").cast("map<string,double>"))
    else:
        article, params = F.lit(None).cast("string"), F.lit(None).cast("map<string,double>")
    cleaned = df.select(*carried, F.inline(F.array(F.struct(
        *[_column(df, c, d).alias(f"{c}_raw") for c, d in OPTIONAL_INPUTS.items()],
        text.strip(_column(df, "name", "")).alias("name"),
        text.strip(_column(df, "size", "")).alias("size_given"),
        F.lower(text.strip(_column(df, "unit", ""))).alias("unit"),
        text.strip(_column(df, "material", defaults.material)).alias("material_given"),
        _column(df, "thickness", defaults.thickness).alias("thickness_raw"),
        _column(df, "system", "").alias("system"),
        article.alias("explicit_article"),
        params.alias("explicit_params"),
    ))))
    return cleaned.filter((F.col("name") != "") | (F.col("size_given") != ""))


def with_texts(
    lines: DataFrame, defaults: SpecDefaults = SpecDefaults(), distinct_texts: bool = True
) -> DataFrame:
    """Lines with TEXT_COLUMNS.

    Names and sizes repeat all over an archive of specifications, so by default each distinct text
    is read once: the distinct texts come out of an aggregation that shrinks before the exchange,
    are classified in parallel and joined back.  The join is an ordinary one: adaptive execution
    broadcasts a small set of texts and splits a text that very many lines share.  With
    `distinct_texts` off the texts are read line by line, with no exchange at all.
    """
    if not distinct_texts:
        return classify_texts(lines, defaults)
    keys = ["name", "size_given"]
    texts = spread(lines.select(*keys).distinct(), *keys)
    return lines.join(classify_texts(texts, defaults), keys)


def route_lines(lines: DataFrame, defaults: SpecDefaults = SpecDefaults()) -> DataFrame:
    """Route of every line and the article, parameters and pieces it leads to.

    Order of the routes: unreadable quantity, explicit article, adapter, fitting, aggregate line,
    duct, everything else.
    """
    valued = held(lines, {
        "quantity": text.number_or_null(F.col("quantity_raw")),
        "thickness": F.coalesce(
            "thickness_named", text.thickness_number(F.col("thickness_raw")), F.lit(fv.DEFAULT_THICKNESS)
        ),
    })
    unit, text_route = F.col("unit"), F.col("text_route")
    routed = held(valued, {
        "route": F.when(F.col("quantity").isNull() | (F.abs("quantity") >= text.PIECES_LIMIT), "bad_quantity")
        .when(F.col("explicit_article").isNotNull(), "explicit")
        .when(text_route.isin("adapter", "fitting"), text_route)
        .when((text_route == "aggregate") | unit.isin(fv.AREA_UNITS), "aggregate")
        .when((text_route == "duct") & unit.isin(fv.METRE_UNITS + fv.PIECE_UNITS), "duct")
        .otherwise("other"),
    })
    route = F.col("route")
    by_text = route.isin("adapter", "fitting", "duct")
    explicit_rect = F.map_contains_key("explicit_params", "A0") | F.map_contains_key("explicit_params", "B0")
    material = F.col("material_given") if defaults.prefer_material_column else F.col("material_named")
    return held(routed, {
        "parsed_article": F.when(route == "explicit", F.col("explicit_article")).when(
            by_text, F.col("text_article")
        ),
        "params": F.when(route == "explicit", F.col("explicit_params")).when(by_text, F.col("text_params")),
        "pieces": F.when(
            (route == "duct") & unit.isin(fv.METRE_UNITS),
            text.pieces_from_metres(F.col("quantity"), F.col("duct_length")),
        ).otherwise(text.piece_count(F.col("quantity"), unit)),
        "wanted_code": classify.material_code(material),
        "connections": F.when(
            route == "explicit", classify.default_connections(~explicit_rect, F.col("explicit_article"))
        ).otherwise(F.col("text_sides")),
        "plain_comment": F.when(
            route == "explicit", text.strip(F.concat("name", F.lit(" "), "size"))
        ).otherwise(F.col("text_comment")),
        "parse_reason": F.when(
            route == "bad_quantity", F.concat(F.when(F.col("quantity").isNull(), fv.REASON_QUANTITY_PREFIX).otherwise(REASON_TOO_LARGE), "quantity_raw")
        ).when(
            route.isin("aggregate", "other"),
            classify.skip_reason(F.col("size"), unit, F.col("ptype")),
        ),
    })


def with_material_check(lines: DataFrame, materials: DataFrame | None) -> DataFrame:
    """Replace a material code the article cannot be made of by its first allowed one.

    `materials` has (article, codes array); articles missing there are not checked.
    """
    if materials is None:
        return lines.withColumns({"material_code": F.col("wanted_code"), "material_warning": F.lit(None).cast("string")})
    allowed = materials.select(F.col("article").alias("parsed_article"), F.col("codes").alias("material_codes"))
    wrong = (F.size("material_codes") > 0) & ~F.array_contains("material_codes", F.col("wanted_code"))
    first = F.get(F.col("material_codes"), 0)
    return (
        lines.join(broadcast_checked(allowed), "parsed_article", "left")
        .withColumns({
            "material_code": F.when(wrong, first).otherwise(F.col("wanted_code")),
            "material_warning": F.when(
                wrong,
                F.concat(
                    F.lit("материал "), "wanted_code", F.lit(" не поддерживается артикулом "),
                    "parsed_article", F.lit(", использован "), first,
                ),
            ),
        })
        .drop("material_codes")
    )


def with_allowed_check(lines: DataFrame, allowed: DataFrame | None) -> DataFrame:
    """Flag articles that may be ordered; one left join serves both outputs."""
    if allowed is None:
        return lines.withColumn("is_allowed", F.col("parsed_article").isNotNull())
    listed = allowed.select(F.col("article").alias("parsed_article")).withColumn("is_allowed", F.lit(True))
    return lines.join(broadcast_checked(listed), "parsed_article", "left").withColumn(
        "is_allowed", F.coalesce("is_allowed", F.lit(False))
    )


def finalise(lines: DataFrame, carried: list[str]) -> DataFrame:
    """Status, comment and the columns of both outputs."""
    parsed = F.col("parsed_article").isNotNull()
    refused = parsed & ~F.col("is_allowed")
    ordered = parsed & F.col("is_allowed")

    def bracket(warning: str) -> Column:
        return F.concat(F.lit("["), F.col(warning), F.lit("]"))

    warned = F.col("material_warning").isNotNull() | F.col("ocr_warning").isNotNull()
    comment = F.when(
        warned,
        text.strip(F.concat_ws(" ", "plain_comment", bracket("material_warning"), bracket("ocr_warning"))),
    ).otherwise(F.col("plain_comment"))

    def both(order_value: Column | None, refused_value: Column, skip_value: Column) -> Column:
        chain = F.when(refused, refused_value)
        if order_value is not None:
            chain = chain.when(ordered, order_value)
        return chain.otherwise(skip_value)

    nothing = F.lit(None).cast("string")
    return lines.select(
        *carried,
        F.when(ordered, "order").otherwise("skipped").alias("status"),
        both(F.col("name"), F.col("name_raw"), F.col("name")).alias("name"),
        both(F.col("size"), F.col("size_raw"), F.col("size")).alias("size"),
        both(F.col("unit"), F.col("unit_raw"), F.col("unit")).alias("unit"),
        F.col("parsed_article").alias("article"),
        F.when(ordered, F.col("params")).alias("params"),
        F.when(ordered, F.col("pieces")).alias("quantity"),
        F.when(ordered, F.col("material_code")).alias("material_code"),
        F.when(ordered, F.col("thickness")).alias("thickness"),
        *[
            F.when(ordered, F.substring("connections", i + 1, 1)).alias(f"connection_{i}")
            for i in range(4)
        ],
        F.when(ordered, F.col("system")).alias("system"),
        F.when(ordered, comment).alias("comment"),
        F.when(
            refused,
            F.concat(F.lit(fv.REASON_NOT_ALLOWED[0]), "parsed_article", F.lit(fv.REASON_NOT_ALLOWED[1])),
        ).otherwise(F.col("parse_reason")).alias("reason"),
        F.when(refused, F.col("quantity_raw")).alias("quantity_raw"),
        F.when(~refused & ~parsed, F.col("ocr_warning")).otherwise(nothing).alias("ocr_warning"),
    )


def parse_spec_lines(
    df: DataFrame,
    allowed: DataFrame | None = None,
    materials: DataFrame | None = None,
    defaults: SpecDefaults = SpecDefaults(),
    distinct_texts: bool = True,
) -> DataFrame:
    """Every non-blank line with its `status` ('order' or 'skipped') and the columns of both outputs."""
    carried = [c for c in df.columns if c not in INPUTS]
    lines = route_lines(with_texts(clean_lines(df, defaults), defaults, distinct_texts), defaults)
    lines = with_material_check(lines, materials)
    lines = with_allowed_check(lines, allowed)
    return finalise(lines, carried)


ORDER_COLUMNS = [
    "article", "params", "quantity", "material_code", "thickness",
    "connection_0", "connection_1", "connection_2", "connection_3", "system", "comment",
]
SKIPPED_COLUMNS = ["name", "size", "unit", "reason", "quantity_raw", "article", "ocr_warning"]


def order_lines(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.filter(F.col("status") == "order").select(*keys, *ORDER_COLUMNS)


def skipped_lines(parsed: DataFrame, *keys: str) -> DataFrame:
    return parsed.filter(F.col("status") == "skipped").select(*keys, *SKIPPED_COLUMNS)


def split_ocr_comment(comment: Column) -> Column:
    """F-X3: struct(name, warning) of a comment that carries a size repair, else null."""
    return F.when(
        F.contains(comment, F.lit("[OCR:")),
        F.struct(
            F.regexp_extract(comment, r"(?s)^(.*?)(?: \[OCR:|$)", 1).alias("name"),
            F.rtrim(F.regexp_extract(comment, r"(?s)(\[OCR:.*)$", 1), F.lit("]")).alias("warning"),
        ),
    )
