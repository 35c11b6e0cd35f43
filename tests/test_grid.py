"""Grids, headers, workbooks, blocks and running values."""

import zipfile

from pyspark.sql import functions as F

from ductlake.operators import blocks, grid, schema
from ductlake.operators.running import running
from ductlake.plans import pipelines
from ductlake.sources import spec_files

GRID = [
    ["Позиция", "Наименование", "Завод", "Ед.", "Кол-во"],
    ["1", "Шумоглушитель NKD 500-250", "", "", ""],
    ["", "", "KORF", "шт", "2"],
    ["", "П1.1 (приточная)", "", "", ""],
    ["2", "Заслонка CHR 160", "NED", "", "3"],
    ["", "", "", "", ""],
    ["", "Вентилятор канальный VC 250", "KORF", "шт", "1"],
    ["4", "5", "6", "7", "8"],
]


def cells_of(spark, rows, **key):
    data = [(r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)]
    df = spark.createDataFrame(data, "row_no long, col_no int, text string")
    return df.select(*[F.lit(v).alias(k) for k, v in key.items()], "*")


def test_equipment_grid(spark):
    cells = cells_of(spark, GRID, doc_id="d", page=1, table_no=0)
    lines = [tuple(r) for r in grid.equipment_lines(cells, block_rows=2).orderBy("row_no").select("raw_name", "manufacturer", "unit", "quantity").collect()]
    assert lines == [
        ("Шумоглушитель NKD 500-250", "KORF", "шт", "2"), ("Заслонка CHR 160", "NED", "шт", "3"),
        ("Вентилятор канальный VC 250", "KORF", "шт", "1"),
    ]
    mapped = {r.source_raw_name: r for r in pipelines.equipment_to_spec(cells, pages=[1, 9]).collect()}
    assert mapped["Шумоглушитель NKD 500-250"].article == "15-2-1"
    assert mapped["Заслонка CHR 160"].params == {"D0": 160.0, "L0": 200.0}
    assert mapped["Вентилятор канальный VC 250"].reason == "Оборудование не производится (вентилятор)"
    assert pipelines.equipment_to_spec(cells, pages=[2]).count() == 0


def test_project_sheet(spark):
    rows = [
        ["", "Проект", "", ""],
        ["Поз.", "Наименование и техническая характеристика", "Ед. изм.", "Кол-во"],
        ["1", "Воздуховод D160", "м.", "4,5"],
        ["2", "воздуховод  d160", "м", "9"],
        ["3", "Отвод", "", "1"],
        ["", "Наименование", "Примечание", "Кол-во"],
        ["4", "Тройник", "шт", "1"],
    ]
    cells = cells_of(spark, rows, doc_id="x")
    found = [tuple(r) for r in grid.project_sheet_lines(cells, block_rows=2).select("name", "unit", "quantity").collect()]
    assert found == [("Воздуховод D160", "м", "4.5")]
    assert grid.project_sheets(grid.filled_cells(cells, ["doc_id"]), ["doc_id"]).count() == 1


def test_running_equals_window_for_every_block_size(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    expected = None
    for block in (1, 3, 50, 1000):
        out = running(df, ["k"], "n", sums={"s": (F.col("n") % 5 == 0).cast("int")}, lasts={"l": F.col("v")}, block_rows=block)
        rows = sorted(tuple(r) for r in out.select("k", "n", "s", "l").collect())
        expected = expected or rows
        assert rows == expected
    for k, n, s, l in expected:
        mine = [i for i in range(n + 1) if i % 3 == k]
        assert s == sum(i % 5 == 0 for i in mine)
        assert l == max((i for i in mine if i % 7 == 0), default=None)


def test_headers(spark):
    assert schema.map_headers(["№", "Наименование", "Размер", "Ед", "Кол", "Изделие", "Материал", "Толщ., мм"]) == {
        "Наименование": "name", "Размер": "size", "Ед": "unit", "Кол": "quantity", "Материал": "material", "Толщ., мм": "thickness",
    }
    df = spark.createDataFrame([("a", None, "1")], "`Наименование` string, x string, `Кол` string")
    assert schema.drop_empty(df).columns == ["Наименование", "Кол"]
    row = schema.spec_rows(schema.normalise_columns(df)).first()
    assert (row.name, row.unit, row.quantity, row.material, row.thickness) == ("a", "шт", 1.0, "оцинкованная", 0.8)


def test_editor_rows(spark):
    df = spark.createDataFrame([(" a ", '{"D0": 1}', "x", "0,7"), ("b", "{bad", "2", "")], "Name string, params string, quantity string, thickness string")
    rows = schema.editor_rows(df).collect()
    assert (rows[0]["name"], rows[0]["params"], rows[0]["quantity"], rows[0]["thickness"]) == ("a", {"D0": 1.0}, 0.0, 0.7)
    assert (rows[1]["params"], rows[1]["quantity"], rows[1]["thickness"]) == ({}, 2.0, 0.8)


def test_text_lines_and_fallback(spark):
    lines = spark.createDataFrame(
        [("a", "Воздуховод оцинкованный  100 м 400"), ("a", "3 Отвод круглый нерж. D160 шт 10,5 0,7 мм"), ("b", "Отвод D160 шт 1"), ("a", "x"), ("a", "слова " * 4000)],
        "doc_id string, text string",
    )
    parsed = grid.text_spec_lines(lines, ["doc_id"])
    tables = spark.createDataFrame([("b",)], "doc_id string")
    kept = grid.table_or_text(parsed.limit(0), tables, parsed, ["doc_id"]).orderBy("name").collect()
    assert [(r.name, r.size, r.unit, r.quantity, r.material, r.thickness) for r in kept] == [
        ("3 Отвод круглый нерж.", "D160", "шт", 10.5, "нержавеющая", 0.7), ("Воздуховод оцинкованный", "100", "м", 400.0, "оцинкованная", 0.8),
    ]


def test_blocks(spark):
    lines = """Если ПродуктШапка = Справочники.асПродукция.Отвод Тогда // круглый
Обозначение = "Ф" + D_ + "-" + u;
АртикулГруппы = "02";
АртикулПродукции = "2-1-1";
Обозначение = A_;
ИначеЕсли ПродуктШапка = Справочники.асПродукция.Пусто Тогда
Обозначение = B_;
КонецЕсли;
АртикулПродукции = "9-9-9";
ИначеЕсли ПродуктШапка = Справочники.асПродукция.БезОбозначения Тогда
АртикулПродукции = "8-8-8";""".split("\n")
    df = spark.createDataFrame([("m", i, t) for i, t in enumerate(lines)], "doc string, line_no long, text string")
    found = blocks.product_blocks(df, ["doc"], block_rows=2).collect()
    assert [(r.product_ref, r.comment, r.article, r.group_code, r.xml_parameters) for r in found] == [
        ("Отвод", "круглый", "2-1-1", "02", ["D0", "U0"])
    ]


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rows = [["Наименование", "Размер", "Ед", "Кол"], ["Воздуховод", "160", "м", "10"]]
    body = "".join(
        f'<row r="{i}">' + "".join(f'<c r="{"ABCD"[j]}{i}" t="inlineStr"><is><t>{t}</t></is></c>' for j, t in enumerate(r)) + "</row>"
        for i, r in enumerate(rows, 1)
    )
    with zipfile.ZipFile(tmp_path / "spec.xlsx", "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    spec = spec_files.workbook_spec_rows(spec_files.read_workbook_cells(spark, str(tmp_path))).first()
    assert (spec["name"], spec["size"], spec["unit"], spec["quantity"]) == ("Воздуховод", "160", "м", 10.0)
    assert spec_files.is_workbook("A.XLSX") and not spec_files.is_workbook("a.csv")
