"""Registered queries over offers, items and the price history."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.load import load
from ductlake.functions import queries as fq
from ductlake.operators import prices, schema
from ductlake.sources.registry import PriceSource, SourceRegistry

AS_OF = "2000-06-30 00:00:00"
MAX_AGE = 400
STOPS = ["small", "large", "old"]
_TIES = ["l_orderkey", "l_linenumber", "supplier", "title"]


def _offers(spark, sf):
    return load(spark, sf, fx.OFFER)


def top3_offers(spark, sf):
    top = prices.top_offers(_offers(spark, sf), prices.ITEM_KEYS, ["scraped_at", *_TIES])
    return top.select(*prices.ITEM_KEYS, "rank", "source", "price", "supplier", "title")


def best_offer(spark, sf):
    return prices.best_offers(
        _offers(spark, sf), prices.ITEM_KEYS, ["scraped_at", *_TIES], ["source", "supplier", "title"]
    )


def fresh_cache_gate(spark, sf):
    return prices.items_in_cache(_offers(spark, sf), AS_OF, min_offers=3, max_age_days=MAX_AGE)


def cached_answers(spark, sf):
    items = load(spark, sf, fx.ITEM)
    answers = prices.cached_answers(items, _offers(spark, sf), AS_OF, min_offers=3, max_age_days=MAX_AGE)
    return answers.groupBy(*prices.ITEM_KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.max("scraped_at").alias("newest"), F.min("price").alias("lowest")
    )


def offer_history(spark, sf):
    return prices.offer_history(_offers(spark, sf), *_TIES).select(
        *prices.ITEM_KEYS, "source", "price", "scraped_at", "supplier"
    )


def offer_validity(spark, sf):
    raw = load(spark, sf, """SELECT l_orderkey, l_returnflag AS source,
        CASE WHEN l_linenumber = 3 THEN NULL ELSE l_linestatus END AS title,
        CAST(l_extendedprice - 30000 AS DECIMAL(18,2)) AS price FROM {lineitem}""")
    good = prices.valid_offers(raw).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    bad = prices.rejected_offers(raw).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))
    return good.withColumn("kept", F.lit(True)).unionByName(bad.withColumn("kept", F.lit(False))).withColumn(
        "total", F.col("total").cast("double")
    )


def query_expansion(spark, sf):
    items = load(spark, sf, fx.ITEM)
    return prices.expand_items(items, STOPS)


def offer_relevance(spark, sf):
    answers = load(spark, sf, fx.ANSWER)
    return prices.relevant_offers(answers).groupBy("query").agg(
        F.count(F.lit(1)).alias("n"), F.min("price").cast("double").alias("lowest")
    )


def title_relevance(spark, sf):
    queries = load(spark, sf, "SELECT CAST(p_partkey AS BIGINT) AS query_id, concat(p_brand, ' ', p_name, ' ', CAST(p_size AS STRING), ' ', p_type) AS query FROM {part}")
    offers = load(spark, sf, "SELECT s_suppkey AS offer_id, concat('Brand#', CAST(s_suppkey % 25 + 1 AS STRING), ' ', CASE s_suppkey % 3 WHEN 0 THEN 'small ring' WHEN 1 THEN 'red bolt' ELSE 'cold plate' END, ' ECONOMY ', s_name) AS title FROM {supplier}")
    return prices.title_matches(queries, offers, "query_id", "offer_id")


_TITLE_QUERIES = """SELECT CAST(p_partkey AS BIGINT) AS query_id, CASE WHEN p_partkey % 9 = 0 THEN 'a 12 ' WHEN p_partkey % 9 = 1 THEN '' ELSE concat(p_brand, ' ', p_name, ' ', p_type) END AS query FROM {part}"""
_TITLE_OFFERS = """SELECT s_suppkey AS offer_id, concat('Brand#', CAST(s_suppkey % 25 + 1 AS STRING), ' ', CASE s_suppkey % 3 WHEN 0 THEN 'small ring' WHEN 1 THEN 'red bolt' ELSE 'cold plate' END, ' ECONOMY ', s_name) AS title,
    CAST(s_acctbal AS DECIMAL(18,2)) AS price FROM {supplier}"""


def title_top_offers(spark, sf):
    return prices.top_title_offers(load(spark, sf, _TITLE_QUERIES), load(spark, sf, _TITLE_OFFERS), "query_id", "offer_id")


class Listed(PriceSource):
    """A source of the checks: as many offers as a query has words, none for a text that holds `fail`."""

    name = "listed"

    def search(self, query):
        if query.startswith("h"):
            raise ConnectionError(query)
        return [{"title": f"{query} {i}", "price": 100 * i + len(query), "url": f"http://listed/{i}"} for i, _ in enumerate(query.split(), 1)]


class Single(PriceSource):
    name = "single"

    def search(self, query):
        return [{"title": query.upper(), "price": 5 * len(query), "supplier": "S", "url": "http://single"}]


def plugged_sources(spark, sf):
    registry = SourceRegistry()
    for source in (Single(), Listed()):
        registry.register_search(source)
    names = load(spark, sf, "SELECT p_name AS query FROM {part}")
    return registry.answers(names).select("source", "query", "title", F.col("price").cast("double").alias("price"), "supplier", "url", "seq")


def _search(spark, sf, fallback):
    items = load(spark, sf, fx.ITEM)
    offers = load(spark, sf, fx.PRIMARY)
    extra = load(spark, sf, fx.FALLBACK) if fallback else None
    return prices.search(
        items, offers, extra, sources=["R", "A"], min_offers=fx.MIN_OFFERS, stop_words=STOPS,
        offer_columns=["source", "title"],
    )


def staged_stop(spark, sf):
    return _search(spark, sf, False).select(*prices.ITEM_KEYS, "n_queries", "n_found", F.size("top").alias("n_kept"))


def fallback_stage(spark, sf):
    return _search(spark, sf, True).select(
        *prices.ITEM_KEYS, "n_queries", "n_found", "used_fallback", F.size("top").alias("n_kept")
    )


def search_offers(spark, sf):
    return prices.kept_offers(_search(spark, sf, True)).select(*prices.ITEM_KEYS, "rank", "query", "price", "source", "title")


def price_report(spark, sf):
    include = load(spark, sf, fx.ITEM + " WHERE p_size % 2 = 0").select(
        F.col("item_name").alias("name"), F.col("item_size").alias("size")
    )
    kept = prices.top_offers(
        _offers(spark, sf).withColumn("url", F.lit("")), prices.ITEM_KEYS, ["scraped_at", *_TIES]
    )
    return prices.price_report(kept, include)


def price_item_projection(spark, sf):
    """Skipped lines of both kinds to items for the search."""
    spec = load(spark, sf, f"SELECT name, size, unit, quantity FROM ({fx.SPEC_LINE_ITEMS}) AS s")
    mapped = load(spark, sf, f"SELECT name AS raw_name, size AS model, 'x' AS reason FROM ({fx.SPEC_LINE}) AS s")
    return schema.price_items(schema.all_skipped(spec, mapped))


def item_categories(spark, sf):
    items = price_item_projection(spark, sf)
    return schema.categories(prices.in_categories(items, ["silencer", "damper", "filter", "grille"]))


QUERIES = {
    f.__name__: f for f in (
        top3_offers, best_offer, fresh_cache_gate, cached_answers, offer_history, offer_validity,
        query_expansion, offer_relevance, title_relevance, title_top_offers, plugged_sources, staged_stop, fallback_stage, search_offers,
        price_report, price_item_projection, item_categories,
    )
}

from checks import spec_oracle as o  # noqa: E402
from ductlake import fixed_values as fv  # noqa: E402

_OFFER = fx.for_oracle(fx.OFFER)
_ITEM = fx.for_oracle(fx.ITEM)
_ANSWER = fx.for_oracle(fx.ANSWER)
_FRESH = f"scraped_at >= TIMESTAMP '{AS_OF}' - INTERVAL {MAX_AGE} DAY"
_RANKED = f"""SELECT *, row_number() OVER (PARTITION BY item_name, item_size
    ORDER BY price, scraped_at, l_orderkey, l_linenumber, supplier, title) AS rank FROM ({_OFFER}) AS o WHERE price > 0"""
_STOP_LIST = "(" + ", ".join(f"'{w}'" for w in STOPS) + ")"


def _is_relevant(query: str, title: str) -> str:
    words = f"list_filter(string_split(lower({query}), ' '), lambda w: length(w) > 2)"
    return (
        f"(len({words}) = 0 OR len(list_filter({words}, lambda w: contains(lower({title}), w)))"
        f" >= greatest(1, len({words}) - 1))"
    )


# Item names are two words; at most one of them is a stop word.
_EXPANDED = f"""
  i AS ({_ITEM}),
  s AS (SELECT *, array_to_string(list_filter(string_split(item_name, ' '), lambda w: w NOT IN {_STOP_LIST}), ' ') AS short FROM i),
  base AS (SELECT item_name, item_size, unnest([short || ' ' || item_size, short, item_name || ' ' || item_size, item_name]) AS q,
      unnest([1, 2, 3, 4]) AS base_no FROM s WHERE short <> ''
    UNION ALL SELECT item_name, item_size, unnest([item_name || ' ' || item_size, item_name]), unnest([3, 4]) FROM s WHERE short = ''),
  pre AS (SELECT item_name, item_size, base_no, unnest(range(1, len(string_split(q, ' ')) + 1)) AS n, q FROM base),
  var AS (SELECT item_name, item_size, base_no, n, array_to_string(string_split(q, ' ')[1:n], ' ') AS query FROM pre),
  firsts AS (SELECT item_name, item_size, query, min(base_no * 1000 - n) AS place FROM var GROUP BY ALL),
  exp AS (SELECT item_name, item_size, query,
      CAST(row_number() OVER (PARTITION BY item_name, item_size ORDER BY place) - 1 AS INTEGER) AS query_no FROM firsts)"""


def _searched(with_fallback: bool) -> str:
    fallback = f"UNION ALL SELECT 1, query, 0, seq, price, source, title FROM ({fx.for_oracle(fx.FALLBACK)}) AS f" if with_fallback else ""
    stages = "(VALUES (0), (1))" if with_fallback else "(VALUES (0))"
    return f"""WITH {_EXPANDED},
  found AS (SELECT * FROM (SELECT 0 AS stage, query, CASE source WHEN 'R' THEN 0 ELSE 1 END AS source_no, seq, price, source, title
      FROM ({fx.for_oracle(fx.PRIMARY)}) AS p WHERE source IN ('R', 'A') {fallback}) AS u WHERE {_is_relevant('query', 'title')}),
  cnt AS (SELECT stage, query, count(*) AS n FROM found GROUP BY ALL),
  asked AS (SELECT exp.*, st.stage, coalesce(cnt.n, 0) AS n FROM exp CROSS JOIN {stages} AS st(stage) LEFT JOIN cnt USING (stage, query)),
  run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY item_name, item_size ORDER BY stage, query_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM asked),
  kept AS (SELECT * FROM run WHERE before < {fx.MIN_OFFERS}),
  priced AS (SELECT kept.item_name, kept.item_size, kept.query, found.price, found.source, found.title,
      row_number() OVER (PARTITION BY item_name, item_size ORDER BY price, stage, query_no, source_no, seq, source, title) AS rank
    FROM kept JOIN found USING (stage, query) WHERE price > 0),
  totals AS (SELECT item_name, item_size, count(*) AS n_queries, CAST(sum(n) AS BIGINT) AS n_found, bool_or(stage = 1) AS used_fallback FROM kept GROUP BY ALL),
  kept_n AS (SELECT item_name, item_size, count(*) AS n FROM priced WHERE rank <= 3 GROUP BY ALL)"""


ORACLE = {
    "top3_offers": f"SELECT item_name, item_size, CAST(rank AS INTEGER) AS rank, source, price, supplier, title FROM ({_RANKED}) AS r WHERE rank <= 3",
    "best_offer": f"SELECT item_name, item_size, price AS min_price, source, supplier, title FROM ({_RANKED}) AS r WHERE rank = 1",
    "fresh_cache_gate": f"SELECT item_name, item_size, count(*) AS n_offers FROM ({_OFFER}) AS o WHERE {_FRESH} GROUP BY ALL HAVING count(*) >= 3",
    "cached_answers": f"SELECT item_name, item_size, count(*) AS n, max(scraped_at) AS newest, min(price) AS lowest FROM ({_OFFER}) AS o WHERE {_FRESH} GROUP BY ALL HAVING count(*) >= 3",
    "offer_history": f"SELECT item_name, item_size, source, price, scraped_at, supplier FROM ({_OFFER}) AS o",
    "offer_validity": """SELECT l_returnflag AS source, count(*) AS n, CAST(sum(CAST(l_extendedprice - 30000 AS DECIMAL(18,2))) AS DOUBLE) AS total,
        l_linenumber <> 3 AND CAST(l_extendedprice - 30000 AS DECIMAL(18,2)) >= 0 AS kept FROM lineitem GROUP BY 1, 4""",
    "query_expansion": f"WITH {_EXPANDED} SELECT item_name, item_size, query_no, query FROM exp",
    "offer_relevance": f"SELECT query, count(*) AS n, CAST(min(price) AS DOUBLE) AS lowest FROM ({_ANSWER}) AS a WHERE {_is_relevant('query', 'title')} GROUP BY query",
    "title_relevance": f"""WITH q AS (SELECT p_partkey AS query_id, concat(p_brand, ' ', p_name, ' ', p_size, ' ', p_type) AS query FROM part),
        t AS (SELECT s_suppkey AS offer_id, concat('Brand#', s_suppkey % 25 + 1, ' ', CASE s_suppkey % 3 WHEN 0 THEN 'small ring' WHEN 1 THEN 'red bolt' ELSE 'cold plate' END, ' ECONOMY ', s_name) AS title FROM supplier)
        SELECT query_id, offer_id FROM q, t WHERE {_is_relevant('query', 'title')}""",
    "title_top_offers": f"""WITH q AS ({fx.for_oracle(_TITLE_QUERIES)}), t AS (SELECT * FROM ({fx.for_oracle(_TITLE_OFFERS)}) AS x WHERE price > 0),
        r AS (SELECT query_id, offer_id, price, row_number() OVER (PARTITION BY query_id ORDER BY price, offer_id) AS rank FROM q, t WHERE {_is_relevant('query', 'title')})
        SELECT query_id, CAST(rank AS INTEGER) AS rank, offer_id, price FROM r WHERE rank <= 3""",
    "plugged_sources": """WITH q AS (SELECT DISTINCT p_name AS query FROM part), w AS (SELECT query, unnest(range(1, len(string_split(query, ' ')) + 1)) AS i FROM q WHERE NOT starts_with(query, 'h'))
        SELECT 'single' AS source, query, upper(query) AS title, CAST(5 * length(query) AS DOUBLE) AS price, 'S' AS supplier, 'http://single' AS url, CAST(0 AS BIGINT) AS seq FROM q
        UNION ALL SELECT 'listed', query, concat(query, ' ', i), CAST(100 * i + length(query) AS DOUBLE), NULL, concat('http://listed/', i), CAST(i - 1 AS BIGINT) FROM w""",
    "staged_stop": f"{_searched(False)} SELECT item_name, item_size, n_queries, n_found, CAST(coalesce(n, 0) AS INTEGER) AS n_kept FROM totals LEFT JOIN kept_n USING (item_name, item_size)",
    "fallback_stage": f"{_searched(True)} SELECT item_name, item_size, n_queries, n_found, used_fallback, CAST(coalesce(n, 0) AS INTEGER) AS n_kept FROM totals LEFT JOIN kept_n USING (item_name, item_size)",
    "search_offers": f"{_searched(True)} SELECT item_name, item_size, CAST(rank AS INTEGER) AS rank, query, price, source, title FROM priced WHERE rank <= 3",
    "price_report": f"""SELECT item_name AS name, item_size AS size, source, title, CAST(price AS DOUBLE) AS price, supplier, '' AS url,
        strftime(scraped_at, '%Y-%m-%dT%H:%M:%S') AS scraped_at FROM ({_RANKED}) AS r WHERE rank <= 3 AND CAST(item_size AS INTEGER) % 2 = 0""",
    "price_item_projection": f"""WITH u AS (
          SELECT name, size, unit, CAST(quantity AS DOUBLE) AS quantity FROM ({fx.for_oracle(fx.SPEC_LINE_ITEMS)}) AS a
          UNION SELECT name, size, 'шт', 1.0 FROM ({fx.for_oracle(fx.SPEC_LINE)}) AS b)
        SELECT DISTINCT name, size, unit, quantity, {o.ptype_case('lower(name)')} AS category FROM u
        WHERE {o.ptype_case('lower(name)')} IN {o.in_list(fv.RESOLD_TYPES)}""",
    "item_categories": f"""SELECT DISTINCT {o.ptype_case('lower(name)')} AS category FROM ({fx.for_oracle(fx.SPEC_LINE)}) AS b
        WHERE {o.ptype_case('lower(name)')} IN ('silencer', 'damper', 'filter', 'grille')""",
}
