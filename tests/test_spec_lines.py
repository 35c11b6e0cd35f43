"""Specification lines: the documented cases, row order, and both ways of reading texts."""

import pytest
from pyspark.sql import functions as F

from ductlake.operators import spec_lines
from ductlake.sources import dimensions as dim

SCHEMA = "line_no int, name string, size string, unit string, quantity string"
CASES = [
    ("Воздуховод", "160", "м", "400", "1-1-2", {"D0": 160, "L0": 3000}, 133),
    ("Воздуховод", "300x200", "м", "50", "1-2-1", {"A0": 300, "B0": 200, "L0": 1250}, 40),
    ("Непонятная деталь", "", "шт", "1", None, None, None),
    ("Шумоглушитель LITENED 100-50 NKD", "", "шт", "1", "15-2-1", {"A0": 1000, "B0": 500, "L0": 1100}, 1),
    ("Шумоглушитель LITENED 60-30 NKK", "", "шт", "1", "15-2-1", {"A0": 600, "B0": 300, "L0": 510}, 1),
    ("Шумоглушитель KNK 250/6", "", "шт", "1", "15-1-1", {"D0": 250, "L0": 600}, 1),
    ("Шумоглушитель круглый Ф160, L=900 мм KNK-160-900", "", "шт", "2", "15-1-1", {"D0": 160, "L0": 900}, 2),
    ("Пластина шумоглушителя 500x1100x200", "", "шт", "2", "15-2-4", {"B0": 500, "L0": 1100, "A2": 200}, 2),
    ("Обтекатель шумоглушителя 500x200", "", "шт", "2", "15-2-5", {"B0": 500, "A2": 200, "L0": 1000}, 2),
    ("Переход круглый с D200 на D160", "", "шт", "3", "3-1-1", {"D0": 200, "D1": 160, "L0": 200}, 3),
    ("Отвод круглый 90 градусов", "D160", "шт", "5", "2-1-1", {"D0": 160, "R0": 160, "U0": 90}, 5),
    ("Отвод", "160", "шт", "5", "1-1-2", {"D0": 160, "L0": 3000}, 5),
]


def parse(spark, df, **options):
    return spec_lines.parse_spec_lines(df, dim.builtin_allowed(spark), dim.builtin_materials(spark), **options)


@pytest.mark.parametrize("distinct_texts", [True, False])
def test_documented_cases(spark, distinct_texts):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], SCHEMA)
    rows = {r.line_no: r for r in parse(spark, df, distinct_texts=distinct_texts).collect()}
    for i, (*_, article, params, pieces) in enumerate(CASES):
        assert rows[i].article == article, CASES[i]
        assert rows[i].params == params, CASES[i]
        assert rows[i].quantity == pieces, CASES[i]
    assert rows[2].reason == "Отсутствует размер"


def test_comments_and_warnings(spark):
    df = spark.createDataFrame(
        [
            (0, "Заглушка прямоугольная", "60x400", "шт", "3"),
            (1, "Клапан воздушный нерж", "300x200", "шт", "1"),
            (2, "Решетка", "7 00 x 60", "шт", "нет"),
            (3, "", "", "шт", "1"),
            (4, "Фильтр", "", "шт", "1"),
        ],
        SCHEMA,
    )
    rows = {r.line_no: r for r in parse(spark, df).collect()}
    assert rows[0].comment == "Заглушка прямоугольная 600.0 [OCR: размер исправлен '60x400' -> '600x400']"
    assert rows[1].material_code == "1"
    assert "материал 2 не поддерживается артикулом 21-2-1, использован 1" in rows[1].comment
    assert rows[2].reason == "Не удалось распознать количество: нет"
    assert rows[2].ocr_warning == "OCR: размер исправлен '7 00 x 60' -> '700x600'"
    assert 3 not in rows
    assert rows[4].reason.startswith("filter: оборудование")


def test_not_allowed_article_keeps_raw_values(spark):
    df = spark.createDataFrame([(0, "Воздуховод ", "160", "М", "4")], SCHEMA)
    none_fit = dim.builtin_allowed(spark).filter("article = '2-1-1'")
    row = spec_lines.parse_spec_lines(df, none_fit).first()
    assert (row.status, row.name, row.unit, row.quantity_raw) == ("skipped", "Воздуховод ", "М", "4")
    assert row.reason == "Артикул 1-1-2 не входит в разрешённый список производимой номенклатуры"


def test_row_order_does_not_matter(spark):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], SCHEMA)
    a = parse(spark, df).orderBy("line_no").drop("params").collect()
    b = parse(spark, df.orderBy(F.desc("line_no")).repartition(3)).orderBy("line_no").drop("params").collect()
    assert a == b


def test_streaming_input_is_accepted(spark, tmp_path):
    df = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(CASES)], SCHEMA)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        parse(spark, stream, distinct_texts=False).drop("params").writeStream.format("memory")
        .queryName("parsed_lines").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("parsed_lines").count() == len(CASES)


def test_filter_on_outcome_does_not_copy_the_classifier(spark):
    df = spark.createDataFrame([(0, "Воздуховод", "160", "м", "1")], SCHEMA)
    whole = parse(spark, df, distinct_texts=False)
    plain = len(whole._jdf.queryExecution().optimizedPlan().toString())
    cut = len(whole.filter("status = 'order'")._jdf.queryExecution().optimizedPlan().toString())
    assert cut < plain * 1.5
