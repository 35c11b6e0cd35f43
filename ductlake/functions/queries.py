"""Search queries of an item and relevance of an offer title (F-Q5..F-Q7, W3, P9)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions.text import clean, strip


def words(text: Column) -> Column:
    """Whitespace-separated words; an empty array for blank text."""
    return F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")


def without_stop_words(text: Column, stop_words: list[str] | None = None) -> Column:
    stops = F.array(*[F.lit(w) for w in (fv.QUERY_STOP_WORDS if stop_words is None else stop_words)])
    return F.array_join(
        F.filter(words(text), lambda w: ~F.array_contains(stops, F.lower(w))), " "
    )


def leading_prefixes(query: Column) -> Column:
    """The query and its shorter beginnings: 'a b c' -> ['a b c', 'a b', 'a']."""
    tokens = words(query)
    return F.when(
        F.size(tokens) > 0,
        F.transform(
            F.sequence(F.size(tokens), F.lit(1), F.lit(-1)),
            lambda n: F.array_join(F.slice(tokens, F.lit(1), n), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


def item_queries(
    name: Column, size: Column, brand: Column | None = None, stop_words: list[str] | None = None
) -> Column:
    """Ordered distinct queries of an item, most specific first."""
    name, size = clean(name), clean(size)
    brand = clean(brand) if brand is not None else F.lit("")
    short = without_stop_words(name, stop_words)
    has_size = size != ""
    bases = F.array_compact(F.array(
        F.when((short != "") & has_size, F.concat(short, F.lit(" "), size)),
        F.when(short != "", short),
        F.when((name != "") & has_size, F.concat(name, F.lit(" "), size)),
        F.when(name != "", name),
        F.when((brand != "") & has_size, F.concat(brand, F.lit(" "), size)),
    ))
    return F.array_distinct(F.flatten(F.transform(bases, leading_prefixes)))


def query_keywords(query: Column) -> Column:
    """Lower-case words of the query that count: longer than two characters."""
    return F.transform(F.filter(words(query), lambda w: F.length(w) > 2), F.lower)


def is_relevant(title: Column, keywords: Column) -> Column:
    """All keywords but one (and at least one) occur in the title; no keywords accept everything."""
    return has_keywords(F.lower(title), keywords)


def has_keywords(lowered: Column, keywords: Column) -> Column:
    """As `is_relevant`, for a title in lower case."""
    hits = F.size(F.filter(keywords, lambda k: F.contains(lowered, k)))
    return (F.size(keywords) == 0) | (hits >= F.greatest(F.lit(1), F.size(keywords) - 1))


def search_url(base_url: Column, path: Column, parameter: Column, query: Column) -> Column:
    """Search address, with & instead of ? when the path already has a query part."""
    glue = F.when(F.contains(path, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(
        F.rtrim(base_url, F.lit("/")), path, glue, parameter, F.lit("="), F.url_encode(query)
    )
