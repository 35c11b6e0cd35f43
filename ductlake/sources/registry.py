"""Price sources by name (X1): a table of answers, a function that makes one, or a search per query.

A search is a class with `search(query) -> offers`.  It becomes a table function that asks for its table
argument by query: each query is searched once, wherever its partition lies, and a source that fails for a
query gives no offers for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from decimal import Decimal
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn

Provider = Callable[[DataFrame], DataFrame]
OFFERS = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("title", T.StringType()), T.StructField("price", T.DecimalType(18, 2)),
    T.StructField("currency", T.StringType()), T.StructField("supplier", T.StringType()), T.StructField("url", T.StringType()), T.StructField("seq", T.LongType()),
])
ATTEMPTS = 3


class PriceSource:
    """A plug-in: `name`, and offers (title, price, url; currency and supplier if known) for a query."""

    name = ""

    def search(self, query: str) -> Iterable[dict]:
        raise NotImplementedError


def searched(source: PriceSource, query: str, attempts: int = ATTEMPTS) -> list[tuple]:
    """Rows of `OFFERS` for a query, in the source's order; nothing if every attempt fails."""
    for _ in range(attempts):
        try:
            return [
                (query, o.get("title"), None if o.get("price") is None else Decimal(str(o["price"])), o.get("currency", "RUB"), o.get("supplier"), o.get("url"), i)
                for i, o in enumerate(source.search(query))
            ]
        except Exception:  # a plug-in may fail in any way, and the other sources go on
            continue
    return []


def table_function(source: PriceSource):
    """The source as a table function over TABLE(queries), partitioned by query."""

    @F.udtf
    class Search:
        @staticmethod
        def analyze(queries: AnalyzeArgument) -> AnalyzeResult:
            if not queries.isTable or "query" not in queries.dataType.fieldNames():
                raise ValueError("a source takes a table with a column query")
            return AnalyzeResult(schema=OFFERS, partitionBy=[PartitioningColumn("query")])

        def __init__(self):
            self.asked = None

        def eval(self, row):
            # Repeats of a query share its partition, so the first one is enough.
            if row["query"] is not None and row["query"] != self.asked:
                self.asked = row["query"]
                yield from searched(source, row["query"])

    return Search


class SourceRegistry:
    """Named sources in order of registration; registering a name again replaces it."""

    def __init__(self) -> None:
        self._providers: dict[str, Provider] = {}

    def register(self, name: str, source: DataFrame | Provider) -> None:
        self._providers[name] = source if callable(source) else (lambda _queries, df=source: df)

    def register_search(self, source: PriceSource) -> None:
        """A source that is asked query by query, under its own name."""
        function = table_function(source)
        self.register(source.name, lambda queries: function(queries.select("query").distinct().asTable()))

    def get(self, name: str) -> Provider | None:
        return self._providers.get(name)

    def names(self) -> list[str]:
        return list(self._providers)

    def all(self) -> list[Provider]:
        return list(self._providers.values())

    def answers(self, queries: DataFrame) -> DataFrame:
        """Answers of all sources to a table of queries, duplicates kept."""
        parts = [p(queries).withColumn("source", F.lit(n)) for n, p in self._providers.items()]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
