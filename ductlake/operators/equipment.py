"""Equipment lines to explicit specification lines through category rules (J4, J5, F-S9, C15, X3).

Rules are a table of any size.  Their keywords, aliases and the skip words become multi-pattern automata that
run over Arrow batches and give each line the number of its first rule; what else a rule says joins by that
number, and its size patterns are read as columns.  Neither the plan nor the code it compiles to depends on
the number of rules.  Automata are bounded in bytes: a larger table is cut into ranges of priority, one
automaton each.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions.text import clean, strip
from ductlake.session import spread
from ductlake.sources.dimensions import RULE_ITEM

DIMENSION_GROUPS = {"D": "D0", "L": "L0", "U": "U0"}
SIZES = ["A0", "B0", "D0", "L0", "U0"]
# Text of the patterns in one automaton; an automaton takes some 60 times as much memory in a worker.
AUTOMATON_BYTES = 4 << 20
PATTERN_GROUPS = "array<struct<pattern: string, A: int, B: int, D: int, L: int, U: int>>"
Pattern = tuple[str, str, int]  # text, kind, number: the rule's priority, or the skip word's place


def rules_from(rules: DataFrame) -> DataFrame:
    """Category rules (S6) with one row a priority; of equal priorities the smallest id counts."""
    rest = [c for c in rules.columns if c != "priority"]
    return rules.groupBy("priority").agg(F.min_by(F.struct(*rest), F.col("id")).alias("r")).select("priority", "r.*")


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """A list of rules as a table, in priority order."""
    names = [c.strip().split(" ")[0] for c in RULE_ITEM.split(", ")]
    rows = [(i, *[rule.get(n) for n in names]) for i, rule in enumerate(rules)]
    return spark.createDataFrame(rows, f"priority long, {RULE_ITEM}")


def pattern_groups(patterns: list[str] | None) -> list[dict]:
    """A rule's size patterns as the engine reads them, with the numbers of their named groups (0: none); without bad ones."""
    out = []
    for pattern in patterns if patterns is not None else []:
        try:
            groups = dict(re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern)).groupindex)
        except re.error:
            continue
        found = {g: groups.get(g, 0) for g in ("A", "B", "D", "L", "U")}
        if found["A"] and found["B"] or found["D"] or found["L"] or found["U"]:
            out.append({"pattern": "(?iuU)" + pattern, **found})
    return out


@lru_cache(maxsize=8)
def _automaton(content: str):
    """One automaton per worker and list of patterns (as JSON): each text with all that it stands for."""
    import ahocorasick

    meanings: dict[str, list[tuple[str, int]]] = {}
    for text, kind, number in json.loads(content):
        meanings.setdefault(text, []).append((kind, number))
    automaton = ahocorasick.Automaton()
    for text, kinds in meanings.items():
        if text:
            automaton.add_word(text, (text, kinds))
    if len(automaton):
        automaton.make_automaton()
    return automaton, meanings.get("", [])


def _is_word(letter: str) -> bool:
    return letter.isalnum() or letter == "_"


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Word boundaries at both ends of text[start:end]."""
    before, after = _is_word(text[start - 1]) if start else False, _is_word(text[end]) if end < len(text) else False
    return before != _is_word(text[start]) and after != _is_word(text[end - 1])


def first_meanings(text: str | None, automaton, everywhere: list[tuple[str, int]]) -> tuple[int | None, str | None]:
    """(number of the first rule with a keyword inside the text or an alias as a word in it, first skip word in it)."""
    if text is None:
        return None, None
    rule, place, word = None, None, None
    hits = [(len(text), "", everywhere)]
    if len(automaton):
        hits += [(end + 1, found, kinds) for end, (found, kinds) in automaton.iter(text)]
    for end, found, kinds in hits:
        for kind, number in kinds:
            if kind == "skip":
                if place is None or number < place:
                    place, word = number, found
            elif (rule is None or number < rule) and (kind == "keyword" or found and _stands_alone(text, end - len(found), end)):
                rule = number
    return rule, word


def _matcher(patterns: Broadcast):
    @F.pandas_udf("rule long, word string")
    def match(texts: pd.Series) -> pd.DataFrame:
        automaton, everywhere = _automaton(patterns.value)
        found = [first_meanings(t, automaton, everywhere) for t in texts]
        return pd.DataFrame({"rule": pd.array([r for r, _ in found], "Int64"), "word": [w for _, w in found]})

    return match


def pattern_lists(rules: DataFrame) -> list[list[Pattern]]:
    """Keywords and aliases in lists of about `AUTOMATON_BYTES`, cut by priority."""
    def texts(column: str, kind: str) -> DataFrame:
        return rules.select(F.explode(column).alias("text"), F.lit(kind).alias("kind"), "priority").where("text is not null")

    patterns = texts("keywords", "keyword").unionAll(texts("aliases", "alias"))
    size = patterns.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    parts = -(-int(size) // AUTOMATON_BYTES)
    cuts = sorted(set(rules.approxQuantile("priority", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    out = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = patterns
        part = part if low is None else part.where(F.col("priority") > low)
        part = part if high is None else part.where(F.col("priority") <= high)
        # A list of bounded size at a time; it goes on as a broadcast value.
        found = [(text.lower(), kind, priority) for text, kind, priority in part.collect()]
        if found:
            out.append(found)
    return out


def first_rules(lines: DataFrame, text: str, lists: list[list[Pattern]], skip_words: list[str]) -> DataFrame:
    """`lines` with rule (of the first list that has one) and skipped_word."""
    skips = [(w.lower(), "skip", i) for i, w in enumerate(skip_words)]
    spark = lines.sparkSession
    lists = [[*(lists[0] if lists else []), *skips], *lists[1:]]
    matched = lines
    for i, patterns in enumerate(lists):
        shipped = spark.sparkContext.broadcast(json.dumps(patterns, ensure_ascii=False))
        matched = matched.withColumn(f"match_{i}", _matcher(shipped)(F.col(text)))
    names = [f"match_{i}" for i in range(len(lists))]
    rule = F.coalesce(*[F.col(n)["rule"] for n in names])
    # Behind a generator, so that no filter asks the automata a second time.
    return matched.select(*lines.columns, F.inline(F.array(F.struct(rule.alias("rule"), F.col(names[0])["word"].alias("skipped_word")))))


def rule_sizes(text: Column, patterns: Column) -> Column:
    """struct(A0, B0, D0, L0, U0) of the first pattern (`PATTERN_GROUPS`) that yields a size; null when none does."""
    def read(p: Column) -> Column:
        def number(group: str) -> Column:
            found = F.call_function("regexp_extract", text, p["pattern"], p[group])
            return F.when((p[group] > 0) & (found != ""), found.try_cast("double"))

        both = (p["A"] > 0) & (p["B"] > 0)
        a, b = F.when(both, number("A")), F.when(both, number("B"))
        return F.struct(
            F.when(b.isNotNull(), a).alias("A0"), F.when(a.isNotNull(), b).alias("B0"), *[number(g).alias(t) for g, t in DIMENSION_GROUPS.items()])

    def any_size(s: Column) -> Column:
        return F.coalesce(*[s[n] for n in SIZES]).isNotNull()

    return F.get(F.filter(F.transform(patterns, read), any_size), 0)


def rule_parameters(found: Column, derived: Column, defaults: Column) -> Column:
    """Found sizes, then sides derived from the diameter, in the rule's order, then the rule's defaults."""
    no_numbers = F.create_map().cast("map<string,double>")
    own = F.map_filter(F.create_map(*[x for n in SIZES for x in (F.lit(n), found[n])]), lambda _, v: v.isNotNull())

    def derive(known: Column, entry: Column) -> Column:
        value = F.try_element_at(known, entry["value"])
        new = ~F.map_contains_key(known, entry["key"]) & value.isNotNull()
        return F.when(new, F.map_concat(known, F.map_from_arrays(F.array(entry["key"]), F.array(value)))).otherwise(known)

    round_ = F.when(found["D0"].isNotNull(), F.map_entries(derived))
    known = F.aggregate(F.coalesce(round_, F.array().cast("array<struct<key:string,value:string>>")), own, derive)
    return F.get(F.transform(F.array(known), lambda k: F.map_concat(k, F.map_filter(F.coalesce(defaults, no_numbers), lambda n, v: ~F.map_contains_key(k, n) & v.isNotNull()))), 0)


def map_equipment(
    lines: DataFrame,
    rules: list[dict] | DataFrame | None = None,
    skip_keywords: list[str] | None = None,
    defaults: dict | None = None,
) -> DataFrame:
    """Every equipment line with `status` 'spec' or 'skipped' and the columns of both outputs.

    Input: raw_name, model, unit, quantity (text) and any carried columns.  `rules` is a table (S6: priority,
    id, name, keywords, aliases, article_round, article_rect, dimension_patterns, default_params,
    round_derived_params) of any size, or a list of rules.
    """
    spark = lines.sparkSession
    given = fv.CATEGORY_RULES if rules is None else rules
    skip_keywords = fv.SKIP_KEYWORDS if skip_keywords is None else skip_keywords
    defaults = fv.RULE_DEFAULTS if defaults is None else defaults
    used = {"raw_name", "model", "unit", "quantity"}
    carried = [c for c in lines.columns if c not in used]

    if isinstance(given, DataFrame):
        table = rules_from(given)
        lists = pattern_lists(table)
        read_patterns = F.pandas_udf(lambda s: s.map(lambda p: pattern_groups(p)), PATTERN_GROUPS)(F.col("dimension_patterns"))
    else:
        table = rules_table(spark, given)
        lists = [[(t.lower(), kind, i) for i, r in enumerate(given) for key, kind in (("keywords", "keyword"), ("aliases", "alias")) for t in r.get(key) or []]]
        read_patterns = None
    attributes = table.select(
        F.col("priority").alias("rule"), F.col("name").alias("category_name"), F.col("id").alias("category_id"),
        F.nullif("article_round", F.lit("")).alias("article_round"), F.nullif("article_rect", F.lit("")).alias("article_rect"),
        "default_params", "round_derived_params", *([] if read_patterns is None else [read_patterns.alias("patterns")]))
    if read_patterns is None:
        patterns = spark.createDataFrame([(i, pattern_groups(r.get("dimension_patterns"))) for i, r in enumerate(given)], f"rule long, patterns {PATTERN_GROUPS}")
        # The caller's own list, on the driver as it is.
        attributes = F.broadcast(attributes.join(F.broadcast(patterns), "rule", "left"))
    else:
        attributes = spread(attributes, "rule")

    texts = lines.select(
        *carried,
        clean(F.col("raw_name")).alias("raw_name"),
        clean(F.col("model")).alias("model"),
        F.col("unit").alias("unit_given"),
        F.col("quantity").alias("quantity_given"),
    ).withColumn("full_text", strip(F.concat_ws(" ", "raw_name", "model")))
    lowered = texts.withColumn("full_lower", F.lower("full_text"))
    indexed = first_rules(lowered, "full_lower", lists, skip_keywords).join(attributes, "rule", "left")
    sized = indexed.select("*", F.inline(F.array(F.struct(rule_sizes(F.col("full_text"), F.col("patterns")).alias("found")))))
    rule, found = F.col("rule"), F.col("found")
    section = F.when(
        found.getField("D0").isNotNull() & found.getField("A0").isNull() & found.getField("B0").isNull(),
        F.lit("round"),
    ).otherwise(F.lit("rectangular"))
    round_first, rect_first = F.coalesce("article_round", "article_rect"), F.coalesce("article_rect", "article_round")
    judged = sized.withColumns({
        "section": section,
        "chosen": F.when(section == "round", round_first).otherwise(rect_first),
        "skipped_word": F.when(rule.isNull(), F.col("skipped_word")),
    }).withColumn(
        "reason",
        F.when(
            F.col("skipped_word").isNotNull(),
            F.concat(F.lit(fv.REASON_NOT_MADE[0]), "skipped_word", F.lit(fv.REASON_NOT_MADE[1])),
        )
        .when(rule.isNull(), F.lit(fv.REASON_NO_CATEGORY))
        .when(
            round_first.isNull(),
            F.concat(
                F.lit(fv.REASON_CATEGORY_NO_ARTICLE[0]), "category_name",
                F.lit(fv.REASON_CATEGORY_NO_ARTICLE[1]),
            ),
        )
        .when(found.isNull(), F.concat(F.lit(fv.REASON_CATEGORY_NO_DIMS), "category_name"))
        .when(
            F.col("chosen").isNull(),
            F.concat(
                F.lit(fv.REASON_SECTION_NO_ARTICLE), "category_name", F.lit(" ("), "section", F.lit(")")
            ),
        ),
    )
    spec = F.col("reason").isNull()
    d0, a0, b0 = (found.getField(n).cast("bigint") for n in ("D0", "A0", "B0"))
    size = (
        F.when(found.getField("D0").isNotNull(), F.concat(F.lit("D"), d0.cast("string")))
        .when(a0.isNotNull() & b0.isNotNull(), F.concat_ws("x", a0.cast("string"), b0.cast("string")))
        .otherwise(F.lit(""))
    )
    word_of_section = F.when(F.col("section") == "round", F.lit(" круглого сечения")).otherwise(
        F.lit(" прямоугольного сечения")
    )
    return judged.select(
        *carried,
        F.when(spec, "spec").otherwise("skipped").alias("status"),
        F.when(spec, F.concat("category_name", word_of_section)).alias("name"),
        F.when(spec, size).alias("size"),
        F.when(spec, F.coalesce(F.when(F.col("unit_given") != "", F.col("unit_given")), F.lit(defaults["unit"]))).alias("unit"),
        F.when(spec, F.coalesce("quantity_given", F.lit("1"))).alias("quantity"),
        F.when(spec, F.lit(defaults["material"])).alias("material"),
        F.when(spec, F.lit(str(defaults["thickness"]))).alias("thickness"),
        F.when(spec, F.col("chosen")).alias("article"),
        F.when(spec, rule_parameters(found, F.col("round_derived_params"), F.col("default_params"))).alias("params"),
        F.col("raw_name").alias("source_raw_name"),
        F.col("model").alias("source_model"),
        F.when(spec, F.col("category_id")).alias("detected_category"),
        F.when(spec, F.col("chosen")).alias("detected_article"),
        "reason",
    )


def mapped_lines(mapped: DataFrame) -> DataFrame:
    """The lines that became specification lines."""
    return mapped.filter(F.col("status") == "spec").drop("status", "reason")


def unmapped_lines(mapped: DataFrame, *keys: str) -> DataFrame:
    """The others with their reason, as the price search takes them."""
    return mapped.filter(F.col("status") == "skipped").select(
        *keys,
        F.col("source_raw_name").alias("raw_name"),
        F.col("source_model").alias("model"),
        "reason",
    )
