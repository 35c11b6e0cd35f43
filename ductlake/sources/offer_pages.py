"""Crawled pages to offers and search hits through a table of selectors (S9, S10, F-N3, F-N4, F-Q7)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions.text import price_digits
from ductlake.session import broadcast_checked
from ductlake.sources.dimensions import inline_table

SELECTOR_COLUMNS = [
    "source", "base_url", "search_path", "search_param",
    "item_selector", "title_selector", "price_selector", "supplier_selector",
]
HIT = "page_id bigint, source string, seq bigint, title string, price_text string, price_meta string, supplier string, url string, query string, title_html string"
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

_BLOCKS = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "footer"}


class _Node:
    def __init__(self, tag: str, attrs: dict, parent: "_Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.begin, self.end = 0, None  # places in the page between which its content stands

    def walk(self) -> Iterator["_Node"]:
        """Nodes below in the order of the page; with a stack, as pages nest deeply."""
        waiting = self.children[::-1]
        while waiting:
            child = waiting.pop()
            if isinstance(child, _Node):
                yield child
                waiting += child.children[::-1]

    def text(self) -> str:
        parts, waiting = [], self.children[::-1]
        while waiting:
            child = waiting.pop()
            if isinstance(child, _Node):
                waiting += child.children[::-1]
            else:
                parts.append(child.strip())
        return "".join(parts)


class _Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.html, self.lines = html, [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        self.close()

    def _place(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def inner(self, node: _Node) -> str:
        """The content of a node as the page has it: character references, blanks and tags are left as written."""
        return self.html[node.begin:node.end]

    def handle_starttag(self, tag, attrs):
        if tag == "li" and self.at.tag == "li":
            self._close("li")
        if tag in _BLOCKS:
            self._close("p")
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        node.begin = self._place() + len(self.get_starttag_text())
        if tag not in _VOID:
            self.at = node
        else:
            node.end = node.begin

    def handle_endtag(self, tag):
        self._close(tag)

    def _close(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            left, place = self.at, self._place()
            while left is not node.parent:
                left.end, left = place, left.parent
            self.at = node.parent

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.children.append(data)


def _fits(node: _Node, simple: str) -> bool:
    """Whether a node fits `tag.class[attr='value']`."""
    tag = re.match(r"[a-zA-Z0-9]*", simple).group(0)
    if tag and node.tag != tag.lower():
        return False
    classes = node.attrs.get("class", "").split()
    if any(c not in classes for c in re.findall(r"\.([\w-]+)", re.sub(r"\[.*?\]", "", simple))):
        return False
    for name, _, value in re.findall(r"\[([\w-]+)(=['\"]?([^'\"\]]*)['\"]?)?\]", simple):
        if name not in node.attrs or (_ and node.attrs[name] != value):
            return False
    return True


def _select(top: _Node, selector: str) -> Iterator[_Node]:
    """Descendants that fit a selector of simple parts separated by spaces."""
    *outer, last = selector.split()
    for node in top.walk():
        if not _fits(node, last):
            continue
        above, left = node.parent, list(outer)
        while left and above is not None:
            if _fits(above, left[-1]):
                left.pop()
            above = above.parent
        if not left:
            yield node


def _first(top: _Node, selector: str | None) -> "_Node | None":
    return next(_select(top, selector), None) if selector else None


def _offers_of(page) -> Iterator[tuple]:
    tree = _Tree(page.html or "")
    for seq, item in enumerate(_select(tree.root, page.item_selector)):
        title, price = _first(item, page.title_selector), _first(item, page.price_selector)
        if title is None or price is None:
            continue
        link = title if title.tag == "a" else _first(title, "a") or _first(item, "a[href]")
        meta = _first(price, "meta[itemprop='price']")
        supplier = _first(item, page.supplier_selector)
        yield (
            page.page_id, page.source, seq, title.text(), price.text(),
            meta.attrs.get("content", "").strip() if meta else None,
            supplier.text() if supplier else None,
            urljoin(page.base_url, link.attrs.get("href", "") if link else ""), page.query, tree.inner(title),
        )


def _hits_of(page) -> Iterator[tuple]:
    for seq, item in enumerate(_select(_Tree(page.html or "").root, page.item_selector)):
        if seq >= 5:  # a listing is read to its fifth hit
            break
        title = _first(item, "h3 a") or _first(item, "a")
        if title is not None:
            yield (
                page.page_id, page.source, seq, title.text(), None, None, None,
                urljoin(page.base_url, title.attrs.get("href", "")), None, None,
            )


def _extract(pages: DataFrame, rows_of) -> DataFrame:
    columns = [c.split()[0] for c in HIT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.astype(object).where(batch.notna(), None)
            rows = [r for page in batch.itertuples(index=False) for r in rows_of(page)]
            yield pd.DataFrame(rows, columns=columns)

    return pages.mapInPandas(run, HIT)


def site_selectors(spark: SparkSession) -> DataFrame:
    """The known sites; append rows to add one."""
    return inline_table(spark, SELECTOR_COLUMNS, fv.SITE_SELECTORS)


def page_offers(pages: DataFrame, selectors: DataFrame, keep_rejects: bool = False, keep_markup: bool = False) -> DataFrame:
    """Offers on crawled pages (page_id, source, query, html), one row per offer.

    The page text is taken apart in Python, one Arrow batch at a time; prices, the structured one
    first, are settled in columns.  Offers without a readable price, or with one that 36 digits do not hold, are left
    out; with `keep_rejects` they stay with a null price and their price_text.  Titles are plain text: references
    resolved, outer blanks cut; with `keep_markup` a column title_html has them as the page does.
    """
    with_query = "query" in pages.columns
    pages = pages if with_query else pages.withColumn("query", F.lit(None).cast("string"))
    configured = pages.join(broadcast_checked(selectors), "source")
    found = _extract(
        configured.select(
            "page_id", "source", "html", "base_url", "item_selector", "title_selector",
            "price_selector", "supplier_selector", F.col("query").cast("string").alias("query"),
        ),
        _offers_of,
    )
    number = F.when(F.col("price_meta").rlike(r"^[0-9]+(?:\.[0-9]*)?$"), F.col("price_meta").try_cast("decimal(38,2)"))
    priced = found.withColumn("price", F.coalesce(number, price_digits(F.col("price_text")).try_cast("decimal(38,2)")))
    wanted = priced if keep_rejects else priced.filter(F.col("price").isNotNull())
    return wanted.select(
        "page_id", "source", "seq", "title", "price", F.lit("RUB").alias("currency"), "supplier", "url",
        F.lit(False).alias("is_fallback"), *(["query"] if with_query else []), *(["price_text"] if keep_rejects else []),
        *(["title_html"] if keep_markup else []),
    )


def listing_hits(pages: DataFrame, hit_selector: str, engine: str, base_url: str) -> DataFrame:
    """The first five hits of search listings, priced zero and marked as fallback."""
    configured = pages.select(
        "page_id", F.lit(f"{engine}_search").alias("source"), "html", F.lit(base_url).alias("base_url"),
        F.lit(hit_selector).alias("item_selector"),
    )
    return _extract(configured, _hits_of).select(
        "page_id", "source", "seq", "title", F.lit(0).cast("decimal(38,2)").alias("price"),
        F.lit("RUB").alias("currency"), "supplier", "url", F.lit(True).alias("is_fallback"),
    )
