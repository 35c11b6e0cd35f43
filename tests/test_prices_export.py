"""Offers, search, history, XML and files."""

import time
import xml.etree.ElementTree as ET
from datetime import datetime
from decimal import Decimal

from pyspark.sql import functions as F

from ductlake.functions import formatting
from ductlake.operators import catalogue, export, prices
from ductlake.plans import pipelines
from ductlake.sinks import writers
from ductlake.sources import dimensions as dim
from ductlake.sources import offer_pages, spec_files
from ductlake.sources.registry import SourceRegistry

ANSWER = "source string, query string, title string, price decimal(18,2), seq long, supplier string, url string, scraped_at timestamp"
NOW = datetime(2026, 1, 10)


def answers(spark, rows):
    return spark.createDataFrame([(s, q, t, Decimal(p), i, "s", "u", NOW) for i, (s, q, t, p) in enumerate(rows)], ANSWER)


def test_staged_search(spark):
    items = spark.createDataFrame([("Клапан обратный RVN", "560"), ("Фильтр KFC", "")], "item_name string, item_size string")
    offers = answers(spark, [
        ("b", "RVN 560", "Клапан RVN 560", "100"), ("a", "RVN 560", "RVN 560 люкс", "100"), ("a", "RVN 560", "Другое", "1"),
        ("c", "RVN 560", "RVN 560", "1"), ("a", "RVN", "RVN прочий", "90"), ("a", "Клапан обратный RVN 560", "Клапан обратный RVN", "5"),
    ])
    fallback = answers(spark, [("y", "KFC", "KFC", "0"), ("y", "Фильтр KFC", "Фильтр KFC", "70")])
    found = {r.item_name: r for r in prices.search(items, offers, fallback, ["a", "b"], min_offers=3).collect()}
    valve, filt = found["Клапан обратный RVN"], found["Фильтр KFC"]
    assert (valve.n_queries, valve.n_found, valve.used_fallback) == (2, 3, False)
    assert [(o.price, o.offer.source) for o in valve.top] == [(90, "a"), (100, "a"), (100, "b")]
    assert (filt.used_fallback, filt.n_found, [o.price for o in filt.top]) == (True, 2, [70])


def test_min_and_best(spark):
    df = spark.createDataFrame([("i", "", "s1", Decimal(100), 0), ("i", "", "s2", Decimal(90), 1), ("i", "", "s3", Decimal(90), 2)], "item_name string, item_size string, source string, price decimal(18,2), seq long")
    row = prices.best_offers(df, prices.ITEM_KEYS, ["seq"], ["source"]).first()
    assert (row.min_price, row.source) == (90, "s2")


def test_history_and_cache(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = [("Клапан", "1", "a", "q", "t", Decimal(5), NOW.replace(day=d)) for d in (1, 8, 9, 10)]
    df = spark.createDataFrame(rows, "item_name string, item_size string, source string, query string, title string, price decimal(18,2), scraped_at timestamp")
    writers.append_history(df.limit(0), path)
    writers.append_history(df, path)
    history = spark.read.parquet(path)
    items = df.select(*prices.ITEM_KEYS)
    assert prices.cached_answers(items, history, NOW, 3, 7).count() == 3
    assert prices.cached_answers(items, history, NOW, 4, 7).count() == 0
    assert [r.scraped_at.day for r in prices.offer_history(history).collect()] == [10, 9, 8, 1]
    skipped = spark.createDataFrame([("Клапан", "1", "шт", "1"), ("Клапан", "1", "шт", "x"), ("Вентилятор", "2", "", "1"), ("Отвод", "3", "шт", "1")], "name string, size string, unit string, quantity string")
    cached, found = pipelines.search_prices(skipped, history, answers(spark, [("a", "Вентилятор 2", "Вентилятор 2", "7")]), NOW)
    assert cached.count() == 3 and [r.item_name for r in found.collect()] == ["Вентилятор"]


def test_title_matches_equal_brute_force(spark):
    words = ["клапан", "rvn", "обратный", "фильтр", "ab", "круглый", "rvn560"]
    queries = [(i, " ".join(words[(i * k) % 7] for k in range(1, 2 + i % 4))) for i in range(40)]
    titles = [(i, " ".join(words[(i + k * k) % 7] for k in range(i % 5))) for i in range(60)]
    q = spark.createDataFrame(queries, "query_id long, query string")
    o = spark.createDataFrame(titles, "offer_id long, title string")
    got = sorted(tuple(r) for r in prices.title_matches(q, o, "query_id", "offer_id", titles_per_task=2).collect())
    want = []
    for qi, text in queries:
        keys = [w for w in text.split() if len(w) > 2]
        want += [(qi, oi) for oi, t in titles if keys and sum(k in t for k in keys) >= max(1, len(keys) - 1)]
    assert got == sorted(want)
    assert {r.query_id for r in prices.accepts_everything(q, "query_id").collect()} == {i for i, t in queries if all(len(w) <= 2 for w in t.split())}


def test_title_matches_by_kinds(spark):
    """Queries and titles alike for the test of relevance meet once, and every row of both is still paired."""
    q = spark.range(3000).selectExpr("id as query_id", "concat('Клапан ', id % 10, ' обратный rvn') as query")
    o = spark.range(2500).selectExpr("id as offer_id", "case when id < 2000 then concat('клапан обратный № ', id) when id < 2400 then concat('rvn ', id) end as title")
    _, _, pairs = prices._title_kinds(q, o, "query_id", "offer_id", 100)
    assert [tuple(r) for r in pairs.collect()] == [("rvn клапан обратный", "клапан обратный")]
    found = prices.title_matches(q, o, "query_id", "offer_id", titles_per_task=100)
    assert found.agg(F.count("*"), F.countDistinct("query_id", "offer_id"), F.max("offer_id")).first()[:] == (6_000_000, 6_000_000, 1999)
    twice = spark.createDataFrame([(1, "фильтр фильтр"), (1, "фильтр фильтр"), (None, "фильтр abc")], "query_id long, query string")
    given = spark.createDataFrame([(7, "Фильтр"), (7, "Фильтр"), (None, "abc"), (8, None)], "offer_id long, title string")
    rows = sorted((tuple(r) for r in prices.title_matches(twice, given, "query_id", "offer_id").collect()), key=str)
    assert rows == [(1, 7)] * 4 + [(None, 7)] * 2 + [(None, None)]


def test_top_title_offers_makes_no_pairs(spark):
    """Three billion relevant pairs; the three cheapest of each query are found without them."""
    q = spark.range(60_000).selectExpr("id as query_id", "case when id % 4 = 3 then 'a 1' else concat('Клапан ', id % 10, ' обратный rvn') end as query")
    o = spark.range(60_000).selectExpr("id as offer_id", "concat('клапан обратный № ', id) as title", "cast(id div 2 as decimal(18,2)) as price")
    started = time.monotonic()
    found = prices.top_title_offers(q, o, "query_id", "offer_id").groupBy("rank", "offer_id", "price").count().orderBy("rank").collect()
    assert [(r["rank"], r.offer_id, int(r.price), r["count"]) for r in found] == [(1, 2, 1, 60_000), (2, 3, 1, 60_000), (3, 4, 2, 60_000)]
    assert time.monotonic() - started < 120


def test_catalogue_matches_equal_brute_force(spark):
    from difflib import SequenceMatcher

    texts = ["Отвод прямоугольный 300x200 косой", "Воздуховод круглый прямошовный D160 L1000", "шумоглушитель 160", "нечто"]
    df = spark.createDataFrame([(t,) for t in texts + texts], "description string")
    products = dim.builtin_products(spark)
    got = catalogue.match_descriptions(df, products, top_n=4).orderBy("description", "rank").collect()
    base = {
        (r.description, r.article): r.score
        for r in catalogue.match_descriptions(df, products, top_n=500, with_similarity=False).collect()
    }
    rows = dim.builtin_product_rows()
    names = {r["article"]: r["name"].lower().replace("(", " ").replace(")", " ") for r in rows}
    for t in texts:
        want = sorted(
            ((base[t, r["article"]] + 10 * SequenceMatcher(None, t.lower(), " ".join(names[r["article"]].replace("ё", "е").split())).ratio(), -i, r["article"]) for i, r in enumerate(rows)),
            reverse=True,
        )[:4]
        assert [r.article for r in got if r.description == t] == [w[2] for w in want]


def test_registry(spark):
    registry = SourceRegistry()
    registry.register("a", answers(spark, [("x", "q", "t", "1")]))
    registry.register("b", lambda queries: answers(spark, [("x", "q", "t", "2")]))
    registry.register("a", answers(spark, [("x", "q", "t", "3")]))
    assert registry.names() == ["a", "b"] and registry.get("z") is None
    assert sorted((r.source, int(r.price)) for r in registry.answers(None).collect()) == [("a", 3), ("b", 2)]


def test_pages(spark):
    html = """<html><body><div class="{i} big"><a class="{t}" href="/p/1">Клапан <b>обратный</b> &amp; Ко</a><span class="{p}">12 500 ₽</span><span class="{c}">ООО Вент</span></div>
    <div class="{i}"><a class="{t}" href="/p/2">Без цены</a></div><div class="{i}"><a class="{t}" href="http://x/3">Мета</a><span class="{p}"><meta itemprop="price" content="99.5">от 100</span></div></body></html>"""
    sites = {"pulscen": ("catalog-item", "catalog-item__name", "catalog-item__price", "catalog-item__company"), "blizko": ("product-item", "title", "price", "company")}
    pages = spark.createDataFrame([(i, s, "q", html.format(i=c[0], t=c[1], p=c[2], c=c[3])) for i, (s, c) in enumerate(sites.items())], "page_id long, source string, query string, html string")
    rows = offer_pages.page_offers(pages, offer_pages.site_selectors(spark)).orderBy("source", "seq").collect()
    assert [(r.source, r.title, r.price, r.supplier, r.url) for r in rows] == [
        ("blizko", "Клапанобратный& Ко", 12500, "ООО Вент", "https://blizko.ru/p/1"), ("blizko", "Мета", Decimal("99.5"), None, "http://x/3"),
        ("pulscen", "Клапанобратный& Ко", 12500, "ООО Вент", "https://pulscen.ru/p/1"), ("pulscen", "Мета", Decimal("99.5"), None, "http://x/3"),
    ]
    nested = '<div class="product-layout"><div class="caption"><h4><a href="?id=1">A</a></h4></div><p class="price">7</p></div>'
    page = spark.createDataFrame([(1, "airvek", nested)], "page_id long, source string, html string")
    assert offer_pages.page_offers(page, offer_pages.site_selectors(spark)).first().url == "https://www.airvek.ru?id=1"
    listing = "".join(f'<div class="serp-item"><h3><a href="/{i}">Hit {i}</a></h3></div>' for i in range(7))
    hits = offer_pages.listing_hits(spark.createDataFrame([(1, listing)], "page_id long, html string"), ".serp-item", "yandex", "https://yandex.ru/search/").collect()
    assert len(hits) == 5 and hits[0].source == "yandex_search" and hits[0].price == 0 and hits[0].is_fallback


def test_characteristics(spark):
    products = spark.createDataFrame(
        [
            ("8-2-1", "Врезка", "rectangular", ["A0", "B0", "L0"], {"L0": "100"}, {"L0": "100"}),
            ("2-1-1", "Отвод", "round", ["D0", "R0", "U0"], {"R0": "D0 * 1.5", "U0": "90"}, {}),
            ("9-9", "Х", "round", ["D0", "t"], {"t": "max(D0, R0) / 0"}, {}),
        ],
        "article string, name string, section string, xml_parameters array<string>, default_params map<string,string>, force_params map<string,string>",
    )
    lines = spark.createDataFrame(
        [("8-2-1", {"A0": 400.0, "B0": 200.0, "L0": 150.0}), ("2-1-1", {"D0": 161.0}), ("9-9", {"D0": 1.0, "R0": 2.0}), ("2-1-1", {"U0": 45.0}), ("7-7", {"D0": 1.0})],
        "article string, params map<string,double>",
    )
    got = {(r.article, r.characteristic): r.error for r in export.with_characteristic(lines, products).collect()}
    assert got == {
        ("8-2-1", "A00400A0_B00200B0_L00100L0_"): None, ("2-1-1", "D00161D0_R0242R0_U090U0_"): None,
        ("9-9", None): "Для артикула 9-9 не хватает параметра t", ("2-1-1", None): "Для артикула 2-1-1 не хватает параметра D0",
        ("7-7", None): "Артикул 7-7 не найден в сопоставлении",
    }


def test_csv_to_xml(spark, tmp_path):
    source = tmp_path / "spec.csv"
    source.write_text("Наименование;Размер;Ед;Количество;Материал;Толщина\nВоздуховод;160;м;10;оцинкованная;0.8\nВоздуховод <\"А\">;200;м;5;;\nНепонятная позиция;;;1;;\n", encoding="utf-8-sig")
    spec = spec_files.read_delimited_spec(spark, str(source)).drop("doc_id").withColumn("order_id", F.lit(7))
    headers = spark.createDataFrame([(7, "ООО & Ко")], "order_id int, customer string")
    result = pipelines.process_spec_lines(spec, headers)
    doc = result.documents.collect()
    assert len(doc) == 1
    root = ET.fromstring(doc[0].xml.encode())
    assert root.find("customer").text == "ООО & Ко" and root.find("INN").text is None
    first, second = root.find("Tabl")
    assert [c.tag for c in first] == ["article", "name", "characteristic", "quantity", "material", "thickness", "connection_0", "connection_1", "connection_2", "connection_3", "system", "comment"]
    assert first.find("characteristic").text == "D00160D0_L03000L0_" and first.find("quantity").text == "3"
    assert second.find("comment").text == 'Воздуховод <"А"> 200'
    assert [r.reason for r in result.skipped.collect()] == ["Отсутствует размер"]
    writers.write_order_xml(result.documents, str(tmp_path / "out"))
    written = next((tmp_path / "out" / "order_id=7").glob("*.txt")).read_text()
    assert written.strip() == doc[0].xml.strip()
    writers.write_skipped(result.skipped, str(tmp_path / "skipped"))
    assert spark.read.json(str(tmp_path / "skipped")).first().reason == "Отсутствует размер"


def test_xml_fragments_join_to_one_document(spark):
    lines = spark.createDataFrame([(1, i, "1-1-2", {"D0": float(100 + i), "L0": 10.0}, i, "1", 0.8, "2", "2", "0", "0", "", "c") for i in range(7)], "order_id int, line_no int, article string, params map<string,double>, quantity int, material_code string, thickness double, connection_0 string, connection_1 string, connection_2 string, connection_3 string, system string, comment string")
    ready = export.with_characteristic(lines, dim.builtin_products(spark))
    whole = export.order_xml(ready).first().xml
    parts = export.order_xml(ready, fragment_lines=3).orderBy("fragment_no").collect()
    assert len(parts) == 3 and "".join(p.xml for p in parts) == whole
    assert len(ET.fromstring(whole.encode()).find("Tabl")) == 7


def test_dimension_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("total 3\n--- 1 ---\n\n1-1-1 round X\n20-1 round Y\nabc\n1-1-1 again\n")
    assert sorted(r.article for r in dim.read_allowed_articles(spark, str(tmp_path / "a.txt")).collect()) == ["1-1-1", "20-1"]
    (tmp_path / "m.json").write_text('{"1-1-1": ["1", "2"], "2-2": [3]}')
    (tmp_path / "bad.json").write_text("oops")
    assert {r.article: r.codes for r in dim.read_article_materials(spark, str(tmp_path / "m.json")).collect()} == {"1-1-1": ["1", "2"], "2-2": ["3"]}
    assert dim.read_article_materials(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "p.json").write_text('[{"article": "1", "name": "a", "xml_parameters": ["D0"]}, {"article": "1", "name": "b", "section": "rectangular", "xml_parameters": ["A0"], "default_params": {"A0": 5, "R0": "D0"}}]')
    row = dim.read_products(spark, str(tmp_path / "p.json")).first()
    assert (row["name"], row["section"], row["default_params"]) == ("b", "rectangular", {"A0": "5", "R0": "D0"})
    (tmp_path / "r.json").write_text('{"defaults": {"material": "м", "thickness": 0.7, "unit": "шт"}, "categories": [{"id": "x", "name": "X", "keywords": ["k"], "aliases": [], "article_round": null, "article_rect": "1-1", "dimension_patterns": ["(?<A>\\\\d+)x(?<B>\\\\d+)"], "default_params": {"L0": 5}}], "skip_keywords": ["s"]}')
    from ductlake.operators import equipment

    rules = equipment.rules_from(dim.read_category_rules(spark, str(tmp_path / "r.json")))
    lines = spark.createDataFrame([("k 3x4", "", "", "2"), ("S", "", "", "1"), ("k", "", "", "1")], "raw_name string, model string, unit string, quantity string")
    got = {r.source_raw_name: (r.article, r.params, r.reason) for r in equipment.map_equipment(lines, rules, [r.keyword for r in dim.read_skip_keywords(spark, str(tmp_path / "r.json")).collect()]).collect()}
    assert got["k 3x4"] == ("1-1", {"A0": 3.0, "B0": 4.0, "L0": 5.0}, None)
    assert got["S"][2] == "Оборудование не производится (s)" and got["k"][2] == "Не удалось извлечь размеры для категории X"
    (tmp_path / "e.json").write_text('{"success": true, "data": [{"code": "1", "ref": {"Представление": "L0"}}]}')
    (tmp_path / "f.json").write_text('{"success": false, "error": "bad"}')
    export_rows = dim.read_erp_export(spark, str(tmp_path / "[ef].json"), "code string, ref struct<`Представление`:string>")
    assert [tuple(r) for r in export_rows.select("code", dim.object_ref(F.col("ref"))).collect()] == [("1", "L0")]
    assert dim.read_erp_errors(spark, str(tmp_path / "[ef].json")).first().error == "bad"


def test_xml_text(spark):
    assert spark.range(1).select(formatting.xml_element("a", F.lit('<&">'), 1).alias("v")).first().v == " <a>&lt;&amp;&quot;&gt;</a>\n"
