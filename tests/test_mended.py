"""Faults of earlier versions, each on literal rows."""

import zipfile

import pytest
from pyspark.sql import functions as F

from ductlake import fixed_values as fv
from ductlake.functions import formatting, text
from ductlake.operators import catalogue, equipment, export, grid, prices, reports, running, spec_lines
from ductlake.plans import pipelines
from ductlake.sources import dimensions as dim
from ductlake.sinks import order_files, writers
from ductlake.sources import offer_pages, spec_files


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_large_numbers_are_kept(spark):
    assert one(spark, text.number_or_null(F.lit("9500000000000000"))) == 9.5e15
    assert one(spark, text.number_or_null(F.lit("1e999"))) is None
    assert one(spark, text.half_even(F.lit(1e30))) is None
    assert one(spark, formatting.format_parameter(F.lit("D0"), F.lit(1e30))).startswith("1000000000000000")
    assert one(spark, formatting.format_parameter(F.lit("D0"), F.lit(160.0))) == "0160"


def test_null_keys_stay_in_running_values(spark):
    rows = spark.createDataFrame([(None, 1, 5), ("a", 1, 2), (None, 2, 7)], "k string, row_no long, v long")
    found = running.running(rows, ["k"], "row_no", sums={"total": F.col("v")})
    assert sorted(r.total for r in found.collect()) == [2, 5, 12]


def test_reconcile_keeps_a_null_article_apart_from_the_total(spark):
    rows = spark.createDataFrame([(None, 2), ("x", 3)], "article string, quantity long")
    found = reports.reconcile(rows, rows).collect()
    assert sorted((r.article or "-", r.manual, r.difference) for r in found) == [("-", 2, 0), ("x", 3, 0), ("Итого", 5, 0)]


def test_duplicate_cells_do_not_stop_a_job(spark):
    cells = spark.createDataFrame([(1, 0, 0, "a"), (1, 0, 0, "b"), (1, 0, 1, "c")], "table_no int, row_no long, col_no int, text string")
    assert grid.wide_rows(cells, ["table_no"]).first().cells == {0: "b", 1: "c"}


def test_pages(spark):
    deep = "<div>" * 4000 + "x" + "</div>" * 4000
    item = "<div class='i'><a class='t' href='/u'>T{0}</a><b class='p'>{0}</b></div>"
    html = deep + item.format("9" * 37) + item.format("1 250")
    pages = spark.createDataFrame([(1, "s", "q1", html), (1, "s", "q2", html)], "page_id long, source string, query string, html string")
    selectors = spark.createDataFrame([("s", "http://s", "", "", ".i", ".t", ".p", None)], ", ".join(f"{c} string" for c in offer_pages.SELECTOR_COLUMNS))
    found = offer_pages.page_offers(pages, selectors).collect()
    assert sorted((r.query, int(r.price)) for r in found) == [("q1", 1250), ("q2", 1250)]
    assert offer_pages.page_offers(pages, selectors, keep_rejects=True).where("price is null").count() == 2


def test_titles_as_written(spark, tmp_path):
    from checks import page_checks

    number = "1 " + "9" * 40
    html = f"<p>\n<article><h1>a &amp; b &quot;7&quot; </h1><p>1<p>2</article><article><h1> {number}</h1></article><article><h1>none</h1></article><article>\n<h1>2 &#39;<br>x"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    found = sorted((r.seq, r.title, r.price) for r in page_checks.page_offers(spark, str(tmp_path)).collect())
    assert found == [(0, "a & b &quot;7&quot; ", 7.0), (1, f" {number}", float(number.replace(" ", ""))), (3, "2 &#39;<br>x", 239.0)]
    pages = spark.createDataFrame([(1, "s", html)], "page_id long, source string, html string")
    selectors = spark.createDataFrame([("s", "http://s", "", "", "article", "h1", "h1", None)], ", ".join(f"{c} string" for c in offer_pages.SELECTOR_COLUMNS))
    plain = offer_pages.page_offers(pages, selectors, keep_rejects=True).orderBy("seq").collect()
    assert [r.title for r in plain] == ['a & b "7"', number, "none", "2 'x"]


def test_an_order_is_one_document_of_any_length(spark):
    lines = spark.range(25_000).select(
        F.lit(1).alias("order_id"), F.col("id").alias("line_no"), F.lit("1-1-2").alias("article"),
        F.expr("map('D0', 160D, 'L0', 10D)").alias("params"), F.lit(1).alias("quantity"), F.lit("1").alias("material_code"), F.lit(0.8).alias("thickness"),
        *[F.lit("0").alias(f"connection_{i}") for i in range(4)], F.lit("").alias("system"), F.lit("c").alias("comment"))
    found = export.order_xml(export.with_characteristic(lines, dim.builtin_products(spark))).collect()
    assert len(found) == 1 and found[0].n_lines == 25_000 and found[0].xml.count("<productRow>") == 25_000
    assert found[0].xml.startswith("<?xml") and found[0].xml.rstrip().endswith("</Order>")


def test_an_order_too_large_for_one_value_is_an_error(spark):
    fragments = spark.createDataFrame([(1, 0, 2, "ab"), (1, 1, 1, "я"), (2, 0, 1, "c")], "order_id int, fragment_no long, n_lines int, xml string")
    assert sorted((r.order_id, r.n_lines, r.xml) for r in export.whole_documents(fragments, 4).collect()) == [(1, 3, "abя"), (2, 1, "c")]
    with pytest.raises(ValueError, match="order 1 has 4 bytes"):
        export.whole_documents(fragments, 3)


def test_folder_of_specifications(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Наименование;Размер;Ед;Количество\n"Отвод\nкрутой";D160;шт;3\n', encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text("Ед;Изделие;Количество;Наименование;Размер\nшт;;2;Тройник;D200\n", encoding="utf-8")
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = "<worksheet {0}><sheetData>{1}</sheetData></worksheet>"
    row = lambda cells: "<row>" + "".join(f'<c t="inlineStr"><is><t>{t}</t></is></c>' for t in cells) + "</row>"
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="urn:r"><sheets><sheet name="x" r:id="second"/><sheet name="y" r:id="first"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<R><R1 Id="first" Target="worksheets/sheet1.xml"/><R1 Id="second" Target="worksheets/sheet2.xml"/></R>')
        book.writestr("xl/worksheets/sheet1.xml", sheet.format(ns, row(["Наименование", "Количество"]) + row(["falsch", "1"])))
        book.writestr("xl/worksheets/sheet2.xml", sheet.format(ns, row(["Наименование", "Количество"]) + row(["Воздуховод", "4"])))
    lines, bad = spec_files.read_spec_files(spark, str(tmp_path))
    assert sorted((r["name"], r["size"], r["quantity"]) for r in lines.collect()) == [("Воздуховод", "", 4.0), ("Отвод\nкрутой", "D160", 3.0), ("Тройник", "D200", 2.0)]
    assert [r.doc_id.rsplit("/", 1)[-1] for r in bad.collect()] == ["c.xlsx"]


def test_a_large_catalogue_is_joined_to_the_same_result(spark, monkeypatch):
    products = spark.range(300).selectExpr("id as catalogue_pos", "concat('a', id) as article", "'round' as section", "concat('Отвод круглый ', id % 40) as name")
    texts = spark.range(60).selectExpr("concat('Отвод ', id, ' круглый D160') as description")
    found = lambda: sorted(tuple(r) for r in catalogue.match_descriptions(texts, products, top_n=3).collect())
    whole = found()
    monkeypatch.setattr(catalogue, "PIECE", 20)
    monkeypatch.setattr(catalogue, "BROADCAST_PIECES", 1)
    assert found() == whole and len(whole) == 180


def test_equal_lines_count_as_many(spark):
    lines = spark.createDataFrame([("Воздуховод", "160", "шт", "2")] * 3 + [("Узел", "", "шт", "1")] * 2, "name string, size string, unit string, quantity string")
    apart, together = (spec_lines.parse_spec_lines(x, dim.builtin_allowed(spark), dim.builtin_materials(spark)) for x in (lines, reports.equal_lines(lines)))
    assert reports.article_distribution(apart).collect() == reports.article_distribution(together).collect()
    of = lambda parsed: reports.reason_distribution(parsed.where("status = 'skipped'")).collect()
    assert of(apart) == of(together) and of(together)[0].n_lines == 2


def many_rules(spark, n):
    letters = "translate(cast(id as string), '0123456789', 'абвгдежзик')"
    return spark.range(n).selectExpr(
        "id as priority", "concat('r', id) as id", "concat('Имя ', id) as name", f"array(concat({letters}, 'х'), concat('К', {letters}, ' ', {letters})) as keywords",
        "array(concat('Z', id), case when id % 3 = 0 then 'общий' end) as aliases", "case when id % 7 > 0 then concat('1-', id) end as article_round", "concat('2-', id) as article_rect",
        "array('(?<A>[0-9]+)x(?<B>[0-9]+)', concat('\\\\b[zZ]', id, '-(?<D>[0-9]+)'), '(bad') as dimension_patterns",
        "map('L0', cast(id as double)) as default_params", "map('A0', 'D0', 'B0', 'A0') as round_derived_params")


def test_many_rules_equal_brute_force(spark, monkeypatch):
    import random
    import re

    monkeypatch.setattr(equipment, "AUTOMATON_BYTES", 400_000)
    rules = many_rules(spark, 50_000)
    plain = rules.orderBy("priority").collect()
    rng = random.Random(2)
    texts = ["", "общий", "не общий-то", "необщий", "Вентилятор z7", "z12", "xz12", "z12_"]
    for _ in range(250):
        r = plain[rng.randrange(50_000)]
        texts.append(rng.choice([f"изделие {r.keywords[0]} 10x20", f"{r.keywords[1].upper()}!", f"Z{r.priority}-{rng.randrange(100, 900)}", f"aZ{r.priority}", f"насос z{r.priority}-5", f"слово {rng.randrange(99)}"]))
    lines = spark.createDataFrame([(i, t, None, "", None) for i, t in enumerate(texts)], "n int, raw_name string, model string, unit string, quantity string")
    lists = equipment.pattern_lists(equipment.rules_from(rules))
    assert len(lists) > 3
    got = {r.n: r for r in equipment.map_equipment(lines, rules, ["насос", "вентилятор"]).collect()}
    # One pattern of all keywords would hide which rule is first, so every rule is asked in turn.
    tests = [([k.lower() for k in r.keywords], [(a.lower(), re.compile(r"\b" + re.escape(a.lower()) + r"\b")) for a in r.aliases if a]) for r in plain]
    for i, text in enumerate(texts):
        low = text.lower()
        first = next((n for n, (keywords, aliases) in enumerate(tests) if any(k in low for k in keywords) or any(a in low and p.search(low) for a, p in aliases)), None)
        r = got[i]
        if first is None:
            word = next((w for w in ("насос", "вентилятор") if w in low), None)
            assert r.reason == (f"Оборудование не производится ({word})" if word else "Не удалось распознать категорию"), text
            continue
        pair, alone = re.search(r"([0-9]+)x([0-9]+)", text), re.search(rf"\b[zZ]{first}-([0-9]+)", text)
        if pair:
            assert (r.article, r.params) == (f"2-{first}", {"A0": float(pair[1]), "B0": float(pair[2]), "L0": float(first)}), text
        elif alone:
            d = float(alone[1])
            assert (r.article, r.params) == (f"1-{first}" if first % 7 else f"2-{first}", {"D0": d, "A0": d, "B0": d, "L0": float(first)}), text
        else:
            assert r.reason == f"Не удалось извлечь размеры для категории Имя {first}", text


def test_plan_size_does_not_depend_on_the_rules(spark):
    lines = spark.createDataFrame([("x", "", "", "")], "raw_name string, model string, unit string, quantity string")
    sizes = [len(equipment.map_equipment(lines, many_rules(spark, n))._jdf.queryExecution().optimizedPlan().toString()) for n in (5, 5_000)]
    assert abs(sizes[0] - sizes[1]) < 100


def test_order_documents_as_a_table(spark, tmp_path):
    documents = spark.range(9).selectExpr("id % 3 as order_id", "id as fragment_no", "1 as n_lines", "'x' as xml")
    writers.write_orders(documents, str(tmp_path / "orders"))
    assert spark.read.parquet(str(tmp_path / "orders")).count() == 9 and not list((tmp_path / "orders").glob("order_id=*"))


SHEET_NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def write_sheet(path, rows):
    cell = lambda t: f'<c t="inlineStr"><is><t>{t}</t></is></c>'
    body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {SHEET_NS}><sheetData>{body}</sheetData></worksheet>")


def test_no_column_is_lost_to_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Наименование;"Ед.\nизм.";Количество\n"Отвод";"ш\nт";5\n', encoding="utf-8")
    lines, bad = spec_files.read_spec_files(spark, str(tmp_path))
    assert [(r["name"], r["unit"], r["quantity"]) for r in lines.collect()] == [("Отвод", "ш\nт", 5.0)] and bad.count() == 0


def test_every_file_gives_lines_or_an_error(spark, tmp_path):
    text = "Наименование;Размер;Ед;Количество\nВоздуховод;{};м;{}\n"
    (tmp_path / "a.csv").write_text(text.format("D100", 1), encoding="utf-8-sig")
    (tmp_path / "b.tsv").write_text(text.format("D200", 2).replace(";", "\t"), encoding="utf-8")
    (tmp_path / "c.dat").write_text(text.format("D300", 3), encoding="utf-8")
    (tmp_path / "noname").write_text(text.format("D400", 4) + "Отвод;D100;шт;1;лишнее\n\n;;;\nОтвод;D125\n", encoding="utf-8")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.txt").write_text("Количество;Пусто;Наименование\n7;;Тройник\n", encoding="utf-8")
    write_sheet(tmp_path / "e.xlsx", [["Наименование", "Количество"], ["Заглушка", "5"]])
    write_sheet(tmp_path / "f.XLSM", [["", "Проект"], ["Поз.", "Наименование и техническая характеристика", "Ед. изм.", "Кол-во"], ["1", "Воздуховод D160", "м.", "4,5"], ["2", "воздуховод  d160", "м", "9"]])
    (tmp_path / "g.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    (tmp_path / "h.pdf").write_bytes(b"%PDF-1.4\n\xff\xfe\x00")
    (tmp_path / "i.csv").write_text("", encoding="utf-8")
    (tmp_path / "j.xlsx").write_bytes(b"no workbook")
    (tmp_path / "_SUCCESS").write_text("")
    (tmp_path / ".hidden.csv").write_text(text.format("D500", 5), encoding="utf-8")
    lines, bad = spec_files.read_spec_files(spark, str(tmp_path))
    got = sorted((r.doc_id.rsplit("/", 1)[-1], r["name"], r["size"], r["unit"], r["quantity"]) for r in lines.collect())
    assert got == [
        ("a.csv", "Воздуховод", "D100", "м", 1.0), ("b.tsv", "Воздуховод", "D200", "м", 2.0), ("c.dat", "Воздуховод", "D300", "м", 3.0),
        ("d.txt", "Тройник", "", "шт", 7.0), ("e.xlsx", "Заглушка", "", "шт", 5.0), ("f.XLSM", "Воздуховод D160", "", "м", 4.5),
        ("noname", "Воздуховод", "D400", "м", 4.0), ("noname", "Отвод", "D100", "шт", 1.0), ("noname", "Отвод", "D125", "м", 0.0),
    ]
    errors = {r.doc_id.rsplit("/", 1)[-1]: (r.row_no, r.error) for r in bad.collect()}
    assert errors.keys() == {"noname", "g.xls", "h.pdf", "i.csv", "j.xlsx"}
    assert errors["noname"] == (2, "row 2 has 5 fields, its header 4") and errors["i.csv"] == (None, "no header row") and "UnicodeDecodeError" in errors["h.pdf"][1]
    one_by_one = spec_files.read_spec_rows(spark, [f"file://{tmp_path}"], partition_bytes=1)
    assert one_by_one.rdd.getNumPartitions() == 11 and one_by_one.where("kind <> 'error'").count() == 12
    with pytest.raises(Exception, match="FileNotFound|nowhere"):
        spec_files.read_spec_rows(spark, str(tmp_path / "nowhere")).count()


def test_reading_files_needs_no_exchange_for_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Наименование;Количество\nОтвод;1\n", encoding="utf-8")
    plan = spec_files.read_spec_rows(spark, str(tmp_path)).where("kind = 'table'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_quote_that_never_ends_is_an_error(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('Наименование;Количество\nОтвод;1\n"Тройник;' + "x" * (17 << 20), encoding="utf-8")
    lines, bad = spec_files.read_spec_files(spark, str(tmp_path))
    assert [r["name"] for r in lines.collect()] == ["Отвод"] and "field larger than field limit" in bad.first().error


def order_fragments(spark, n_lines=25_000):
    lines = spark.range(n_lines).select(
        F.lit("1/а").alias("order_id"), F.col("id").alias("line_no"), F.lit("1-1-2").alias("article"),
        F.expr("map('D0', 160D, 'L0', 10D)").alias("params"), F.lit(1).alias("quantity"), F.lit("1").alias("material_code"), F.lit(0.8).alias("thickness"),
        *[F.lit("0").alias(f"connection_{i}") for i in range(4)], F.lit("").alias("system"), F.lit("c").alias("comment"))
    small = lines.limit(40).withColumn("order_id", F.concat(F.lit("s"), F.col("line_no") % 20))
    return export.order_xml(export.with_characteristic(lines.unionAll(small), dim.builtin_products(spark)), fragment_lines=1000)


def test_an_order_over_many_tasks_is_one_file(spark, tmp_path):
    from xml.etree import ElementTree

    fragments = order_fragments(spark)
    order_files.write_order_files(fragments, str(tmp_path / "out"))
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files == sorted(["order_1%2F%D0%B0.xml", *(f"order_s{i}.xml" for i in range(20))])
    assert len(ElementTree.parse(tmp_path / "out" / files[0]).find("Tabl")) == 25_000
    assert all(len(ElementTree.parse(tmp_path / "out" / f).find("Tabl")) == 2 for f in files[1:])
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="FileExists"):
        order_files.write_order_files(fragments, str(tmp_path / "out"))
    order_files.write_order_files(fragments.where("order_id = 's1'"), f"file://{tmp_path}/out", overwrite=True)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["order_s1.xml"] and [p.name for p in tmp_path.iterdir()] == ["out"]
    order_files.write_order_files(fragments.limit(0), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_the_pieces_of_an_order_come_from_several_tasks(spark, tmp_path):
    spark.dataSource.register(order_files.OrderPieces)
    fragments = order_fragments(spark).select("order_id", "fragment_no", "xml").repartitionByRange(4, "order_id", "fragment_no").sortWithinPartitions("order_id", "fragment_no")
    fragments.write.format(order_files.PIECES).option("path", str(tmp_path / "staging")).mode("append").save()
    pieces = {r.file: r.pieces for r in order_files.ordered_pieces(spark, str(tmp_path / "staging")).collect()}
    assert len(pieces) == 21 and len(pieces["order_1%2F%D0%B0.xml"]) > 1


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    fragments = order_fragments(spark, 5_000).withColumn("xml", F.when(F.col("fragment_no") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("xml")))
    with pytest.raises(Exception, match="lost"):
        order_files.write_order_files(fragments, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []


def test_an_article_without_a_known_parameter_list_is_an_error(spark):
    lines = spark.createDataFrame([("10-2-4", {"A0": 1.0}), ("1-1-2", {"D0": 160.0, "L0": 10.0})], "article string, params map<string,double>")
    found = {r.article: (r.characteristic, r.error) for r in export.with_characteristic(lines, dim.builtin_products(spark)).collect()}
    assert found == {"10-2-4": (None, "Для артикула 10-2-4 неизвестен список параметров"), "1-1-2": ("D00160D0_L00010L0_", None)}
    own = spark.createDataFrame([("10-2-4", "x", "round", [], {}, {}, "file")], "article string, name string, section string, xml_parameters array<string>, default_params map<string,string>, force_params map<string,string>, provenance string")
    assert export.with_characteristic(lines, own).where("article = '10-2-4' and characteristic = '' and error is null").count() == 1


def test_expressions_are_computed_a_column_at_a_time(spark):
    """The same values as the fold over a stack gives row by row, which no line goes through."""
    texts = ["A0 / B0", "A0 // B0", "A0 % B0", "-A0 ** 2", "round(A0 / 7, 2)", "max(A0, B0, 60) / 2", "min(A0, B0)", "C0 + 1", "open(A0)", "", "A0 - B0 * 2", "7"]
    numbers = [None, 0.0, -7.5, 3.0, 1e300, float("inf"), float("nan")]
    rows = [(f"{i}", {k: v for k, v in (("A0", a), ("B0", b)) if v is not None or i % 2}) for i in range(len(texts)) for a in numbers for b in numbers]
    lines = spark.createDataFrame([*rows, ("0", None)], "article string, params map<string,double>")
    products = spark.createDataFrame(
        [(f"{i}", "n", "round", ["x", "y"], {"x": t, "y": "x + 1"}, {"y": "y * 2"} if i % 3 else {}) for i, t in enumerate(texts)],
        "article string, name string, section string, xml_parameters array<string>, default_params map<string,string>, force_params map<string,string>")
    found = export.with_characteristic(lines, products)
    assert " aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()

    def tokens(text):
        try:
            return formatting.postfix(text)
        except ValueError:
            return None

    programs = spark.createDataFrame([(f"{i}", tokens(t), i % 3 > 0) for i, t in enumerate(texts)], f"article string, tokens array<{formatting.TOKEN}>, doubled boolean")
    x = formatting.evaluate_postfix(F.col("tokens"), F.coalesce("params", F.create_map().cast("map<string,double>")))
    y = (F.col("x") + 1) * F.when(F.col("doubled"), 2.0).otherwise(1.0)
    want = lines.join(programs, "article").withColumn("x", x).select("article", F.concat(F.lit("x"), F.col("x").cast("string"), F.lit("x_y"), y.cast("string"), F.lit("y_")), F.col("tokens").isNull())
    assert sorted((r.article, r.characteristic or "", "недопустимо" in (r.error or "")) for r in found.collect()) == sorted((a, c or "", bad) for a, c, bad in want.collect())


def test_many_products_with_expressions_are_data(spark):
    ddl = "array<string>", "map<string,string>"
    products = lambda n: spark.range(n).selectExpr(
        "concat('p', id) as article", "'n' as name", "'round' as section", f"cast(array('D0', 'R0', 'U0') as {ddl[0]}) as xml_parameters",
        "case id % 3 when 0 then map('R0', 'D0 * 1.5', 'U0', 'R0 + 1') when 1 then map('R0', concat('max(D0, ', id, ') / 2'), 'U0', '90') else map('R0', 'open(D0)', 'U0', '1') end as default_params",
        "case when id % 5 = 0 then map('U0', 'round(U0 / 7)') else map() end as force_params")
    lines = spark.range(20_000).selectExpr("concat('p', id) as article", "map('D0', cast(id % 900 as double)) as params")

    def plan_size(n):
        return len(export.with_characteristic(lines, products(n))._jdf.queryExecution().optimizedPlan().toString())

    assert abs(plan_size(20_000) - plan_size(50)) < 200
    wrong = 0
    for r in export.with_characteristic(lines, products(20_000)).collect():
        i, d = int(r.article[1:]), float(r.params["D0"])
        if i % 3 == 2:
            wrong += not (r.characteristic is None and "недопустимо выражение параметра R0" in r.error)
            continue
        radius = d * 1.5 if i % 3 == 0 else max(d, i) / 2
        angle = radius + 1 if i % 3 == 0 else 90
        angle = round(angle / 7) if i % 5 == 0 else angle
        wrong += (r.characteristic, r.error) != (f"D0{round(d):04d}D0_R0{round(radius)}R0_U0{round(angle)}U0_", None)
    assert wrong == 0


def test_fixed_values_are_what_was_published():
    assert len(fv.ARTICLES) == 136 and len(fv.ARTICLE_MATERIALS) == 148 and fv.ARTICLES[0][:3] == ("1-1-1", "round", "Воздуховод круглого сечения прямошовный")
    assert fv.ARTICLE_MATERIALS["17-1-1"] == ["1", "2"] and fv.ARTICLE_MATERIALS["20-1"] == ["1"] and fv.ARTICLE_MATERIALS["4-1-10"] == ["1", "2", "3"]
    assert fv.DUCT_WORDS + fv.FITTING_WORDS[:2] == ["прямошовн", "спираль", "навивн", "фланец", "отвод"] and fv.RECT_HINTS == ["прямоуг", "прям", "п"]
    assert (fv.DEFAULT_THICKNESS, fv.DEFAULT_ROUND_LENGTH_MM, fv.DEFAULT_RECT_LENGTH_MM, fv.DEFAULT_ADAPTER_L1_MM, fv.DEFAULT_MIN_OFFERS, fv.DEFAULT_MAX_AGE_DAYS) == (0.8, 3000.0, 1250.0, 50.0, 3, 7)
    assert fv.FORCED_PARAMS == {"8-2-1": {"L0": "100"}} and fv.INTEGER_PARAMS == ["U0", "R0", "Z"] and len(fv.PADDED_PARAMS) == 20


def test_offers_are_read_once_and_a_hot_query_is_spread(spark, tmp_path):
    import re

    names = "source string, query string, title string, price decimal(18,2), seq long"
    offers = spark.range(1_000_000).selectExpr(
        "case when id % 2 = 0 then 'A' else 'B' end as source", "case when id % 5 = 0 then concat('клапан ', id % 200) else 'клапан' end as query", "'Клапан x' as title",
        "cast(case when id % 3 = 0 then 0 else (id * 7919) % 1000003 + 1 end as decimal(18,2)) as price", "id as seq")
    offers.write.parquet(str(tmp_path / "offers"))
    stored = spark.read.schema(names).parquet(str(tmp_path / "offers"))
    fallback = spark.createDataFrame([("F", "клапан", "клапан", None, 1), ("F", None, "клапан", 1, 2)], "source string, query string, title string, price int, seq long").withColumn("price", F.col("price").cast("decimal(18,2)"))
    items = spark.createDataFrame([("клапан", ""), ("клапан", "7"), ("насос", "")], "item_name string, item_size string")
    found = prices.search(items, stored, fallback, sources=["B", "A"], min_offers=900_000, stop_words=[])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Relation \[", plan)) == 1
    rows = {(r.item_name, r.item_size): r for r in found.collect()}
    expected = sorted(((i * 7919) % 1000003 + 1, i) for i in range(1_000_000) if i % 3 and i % 5)[:3]
    hot = rows["клапан", ""]
    assert (hot.n_queries, hot.n_found, hot.used_fallback) == (2, 800_001, True)
    assert [(int(o.price), o.seq) for o in hot.top] == expected
    assert rows["насос", ""].n_found == 0 and rows["насос", ""].top in (None, [])


def test_classes_of_a_catalogue_equal_all_pairs(spark):
    words = "array('отвод', 'переход', 'тройник', 'заглушка', 'прямошовный', 'спирально-навивной', 'решетка', 'узел')"
    products = spark.range(10_000).selectExpr(
        "(id * 7919) % 10000 as catalogue_pos", "concat('a', id) as article", "case id % 3 when 0 then 'round' when 1 then 'rectangular' end as section",
        f"concat(element_at({words}, cast(id % 8 + 1 as int)), ' ', element_at({words}, cast(id div 8 % 8 + 1 as int)), ' ', id) as name")
    texts = spark.range(300).selectExpr(f"concat(element_at({words}, cast(id % 8 + 1 as int)), ' ', element_at({words}, cast(id div 8 % 8 + 1 as int)), case id % 4 when 0 then ' D160' when 1 then ' 100x200' else ' ю' end, ' ', id) as description")
    described, classes = catalogue.description_features(texts).persist(), catalogue.product_classes(products, 5)
    pairs = described.select(*catalogue.TEXT_CLASS).distinct().count() * classes.count()
    assert pairs < 300 * 10_000 / 10
    scores = catalogue.m.keyword_score(F.col("text_mask"), F.col("text_hints"), F.col("mask"), F.col("section")) + catalogue.m.section_bonus(F.col("inferred"), F.col("section"))
    plain = {}
    for r in described.join(catalogue._product_features(products), how="cross").select("description", "article", "catalogue_pos", scores.alias("score")).collect():
        plain.setdefault(r.description, []).append((-r.score, r.catalogue_pos, r.article))
    got = {}
    for r in catalogue.match_descriptions(texts, products, with_similarity=False).orderBy("description", "rank").collect():
        got.setdefault(r.description, []).append((r.article, r.score))
    assert got == {d: [(a, -s) for s, _, a in sorted(v)[:5]] for d, v in plain.items()}


def table_cells(spark, tables):
    data = [(doc, page, no, r, c, t) for (doc, page, no), rows in tables.items() for r, row in enumerate(rows) for c, t in enumerate(row)]
    return spark.createDataFrame(data, "doc_id string, page int, table_no int, row_no long, col_no int, text string")


def test_documents_by_tables_or_by_text(spark):
    cells = table_cells(spark, {
        ("a", 1, 0): [["Наименование", "Размер", "Кол-во"], ["Отвод", "D160", "2"], ["Тройник", "", "x"]],
        ("a", 2, 0): [["Кол-во", "Наименование"], ["3", "Заглушка"]],
        ("b", 1, 0): [["Примечание"], ["пусто"]],
    })
    text = spark.createDataFrame(
        [("a", 1, 0, "Воздуховод оцинкованный  100 м 400"), ("b", 1, 0, "Отвод круглый D160 шт 1"), ("c", 1, 0, "Отвод круглый D160 шт 10"), ("c", 2, 0, "Отвод круглый D200 шт 11"), ("c", 9, 0, "слова")],
        "doc_id string, page int, line_no long, text string")
    found = sorted((r.doc_id, r.page, r["name"], r.size, r.quantity) for r in pipelines.document_lines(cells, text).collect())
    assert found == [("a", 1, "Отвод", "D160", 2.0), ("a", 1, "Тройник", "", 0.0), ("a", 2, "Заглушка", "", 3.0), ("c", 1, "Отвод круглый", "D160", 10.0), ("c", 2, "Отвод круглый", "D200", 11.0)]
    # On page 2 only document a has a table; documents without one there are read from their text.
    assert sorted((r.doc_id, r["name"]) for r in pipelines.document_lines(cells, text, [2]).collect()) == [("a", "Заглушка"), ("c", "Отвод круглый")]


def test_equipment_documents_end_to_end(spark):
    grid_rows = [["Шумоглушитель NKD 500-250", "KORF", "шт", "2"], ["Заслонка CHR 160", "NED", "шт", "3"], ["Вентилятор канальный VC 250", "KORF", "шт", "1"], ["Фильтр кассетный без числа 1", "KORF", "шт", "x1"]]
    cells = table_cells(spark, {("d", 1, 0): grid_rows, ("d", 2, 1): grid_rows[:1] + grid_rows[2:3], ("e", 1, 0): grid_rows[2:3]})
    result = pipelines.process_equipment(cells)
    orders = sorted((r.order_id, r.article, r.quantity) for r in result.spec.orders.collect())
    assert orders == [("d", "15-2-1", 2), ("d", "15-2-1", 2), ("d", "16-1-1", 3)]
    assert result.spec.orders.select("line_no").distinct().count() == 3
    skipped = sorted((r.order_id, r.raw_name, r.reason) for r in result.skipped.collect())
    assert [s[:2] for s in skipped] == [("d", "Вентилятор канальный VC 250")] * 2 + [("d", "Фильтр кассетный без числа 1"), ("e", "Вентилятор канальный VC 250")]
    assert result.spec.documents.select("order_id").distinct().count() == 1


def test_price_job_writes_back(spark, tmp_path):
    from datetime import datetime
    from decimal import Decimal

    now = datetime(2024, 5, 10)
    ddl = "item_name string, item_size string, source string, query string, title string, price decimal(18,2), scraped_at timestamp"
    old = [("Клапан", "1", "a", "q", "t", Decimal(5), now.replace(day=d)) for d in (8, 9, 10)]
    path = str(tmp_path / "history")
    writers.append_history(spark.createDataFrame(old, ddl), path)
    skipped = spark.createDataFrame([("Клапан", "1", "шт", "1"), ("Вентилятор", "2", "", "1"), ("Фильтр", "3", "", "1")], "name string, size string, unit string, quantity string")
    answers = spark.createDataFrame(
        [("a", "Вентилятор 2", "Вентилятор 2", Decimal(7), 0), ("a", "Вентилятор 2", "Вентилятор 2", Decimal(-1), 1), ("a", "Вентилятор 2", None, Decimal(3), 2), ("b", "Вентилятор 2", "Вентилятор 2", Decimal(6), 0)],
        "source string, query string, title string, price decimal(18,2), seq long")
    cached, found = pipelines.run_price_job(skipped, path, answers, now, str(tmp_path / "run1"))
    assert cached.count() == 3 and sorted(int(r.price) for r in found.collect()) == [6, 7]
    assert spark.read.parquet(path).where("item_name = 'Вентилятор'").count() == 2
    again, more = pipelines.run_price_job(skipped, path, answers, now, str(tmp_path / "run2"), min_offers=2)
    assert again.where("item_name = 'Вентилятор'").count() == 2 and more.count() == 0
    assert spark.read.parquet(path).count() == 5


def test_sources_as_table_functions(spark):
    from ductlake.sources.registry import PriceSource, SourceRegistry

    class Fake(PriceSource):
        name = "fake"

        def __init__(self, price):
            self.price = price

        def search(self, query):
            if query == "bad":
                raise TimeoutError
            return [{"title": "Fake product", "price": self.price, "supplier": "Fake supplier", "url": "https://fake.example"}]

    registry = SourceRegistry()
    registry.register_search(Fake(1))
    registry.register_search(Fake("100.5"))
    assert registry.names() == ["fake"]
    asked = spark.createDataFrame([("test",), ("test",), ("bad",), (None,), ("other",)], "query string")
    found = sorted((r.source, r.query, r.title, str(r.price), r.currency, r.supplier, r.url, r.seq) for r in registry.answers(asked).collect())
    assert found == [("fake", q, "Fake product", "100.50", "RUB", "Fake supplier", "https://fake.example", 0) for q in ("other", "test")]
    with pytest.raises(Exception, match="query"):
        registry.get("fake")(spark.range(1).selectExpr("id as q")).collect()


def test_parameter_sets_hold_a_million_articles(spark):
    products = spark.range(1_000_000).selectExpr("id * 3 as catalogue_pos", "concat('a', id) as article", "case when id % 100000 = 0 then array('D0', 'L0') else array('D0') end as xml_parameters")
    sets = reports.parameter_sets(products)
    assert {r.parameter: r.n_articles for r in reports.set_sizes(sets).collect()} == {"D0": 1_000_000, "L0": 10}
    assert sets.agg(F.max(F.length("articles"))).first()[0] == reports.BITMAP_BITS // 8
    assert sets.where("parameter = 'D0'").count() == -(-3_000_000 // reports.BITMAP_BITS)
    both = reports.merged_sets(sets.unionAll(reports.parameter_sets(spark.range(1).selectExpr("1L as catalogue_pos", "'x' as article", "array('L0') as xml_parameters"))))
    assert sorted(r.number for r in reports.set_numbers(both.where("parameter = 'L0'")).collect()) == sorted([1, *(i * 300_000 for i in range(10))])
    assert reports.parameter_usage(products.where("catalogue_pos % 300000 = 0")).where("parameter = 'L0'").count() == 10


def test_sheets_of_both_kinds(spark):
    cells = table_cells(spark, {
        ("p", 1, 0): [["", "Проект"], ["Наименование и техническая характеристика", "Тип, марка", "Ед. изм.", "Кол-во"], ["Воздуховод", "D160", "м.", "4,5"], ["Воздуховод", "D160", "м", "9"]],
        ("t", 1, 0): [["Наименование", "Ед", "Количество"], ["Отвод", "", "2"], ["Отвод", "", "3"]],
        ("h", 1, 0): [["Наименование и техническая характеристика", "Количество"], ["Отвод", "1"]],
    }).drop("page", "table_no")
    found = sorted((r.doc_id, r["name"], r.unit, r.quantity) for r in pipelines.sheet_lines(cells).collect())
    assert found == [("h", "Отвод", "шт", 1.0), ("p", "Воздуховод D160", "м", 4.5), ("t", "Отвод", "шт", 2.0), ("t", "Отвод", "шт", 3.0)]
