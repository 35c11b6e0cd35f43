"""Scalar columns on literal rows."""

import pytest
from pyspark.sql import functions as F

from ductlake.functions import classify, formatting, queries, size, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize("given,expected", [
    ("1 250,5", 1250.5), (" 7 ", 7.0), (" 5", 5.0), ("5d", None), ("nan", None), ("", None), ("1e2", 100.0), ("-,5", -0.5), (".", None),
])
def test_number(spark, given, expected):
    assert one(spark, text.number_or_null(lit(given))) == expected


@pytest.mark.parametrize("q,length,pieces", [(2.5, 1000.0, 2), (3.5, 1000.0, 4), (0.1, 1000.0, 1), (0.0, 1000.0, 0), (400.0, 3000.0, 133)])
def test_pieces(spark, q, length, pieces):
    assert one(spark, text.pieces_from_metres(F.lit(q), F.lit(length))) == pieces


@pytest.mark.parametrize("name,token", [
    ("Врезка 600 х 400 - 1250", "600x400-1250"), ("Канал 600x400x1250", "600x400x1250"), ("Отвод D 160", "ф160"),
    ("Отвод D160-3000", "D160-3000"), ("Отвод ⌀160", "Ф160"), ("жФ160", ""), ("Отвод 7 00x3 00", "700x300"), ("нет", ""),
])
def test_size_token(spark, name, token):
    assert one(spark, text.size_token(lit(name))) == token


@pytest.mark.parametrize("given,expected", [
    ("60x40", "600x400"), ("300x60-160", "300x600-160"), ("300x200", None), ("90x90x90", "900x900x90"), ("050x200", "500x200"),
    ("300x60;80x200", "300x600;800x200"), ("300x60 80x200", None),
])
def test_ocr_repair(spark, given, expected):
    assert one(spark, size.ocr_repair(F.lit("отвод"), lit(given))) == expected
    assert one(spark, size.ocr_repair(F.lit("отвод круглый"), lit(given))) is None


@pytest.mark.parametrize("name,value", [
    ("Лист толщина стенки 1,2 мм", 1.2), ("Лист t=0.7", 0.7), ("AISI 430 0.80", 0.8), ("сталь 0,9 мм", 0.9), ("класс 2", 2.0),
    ("Отвод 300x200", None), ("Отвод D160", None), ("(08пс)0.70", 0.7),
])
def test_thickness(spark, name, value):
    assert one(spark, classify.thickness_from_name(lit(name))) == value


@pytest.mark.parametrize("material,code", [("оцинкованная", "1"), ("нержавеющая", "2"), ("чёрная", "3"), ("2", "2"), ("дерево", "1"), (None, "1")])
def test_material_code(spark, material, code):
    assert one(spark, classify.material_code(lit(material))) == code


@pytest.mark.parametrize("conn,section,code", [
    ("1", "round", "1"), ("", "round", "0"), ("фланец", "round", "4"), ("фланец", "rectangular", "5"), ("рейка", "rectangular", "7"),
    ("Шина / уголок", "rectangular", "6"), ("б/с", "round", "2"), ("9", "round", "0"),
])
def test_connection_code(spark, conn, section, code):
    assert one(spark, classify.connection_code(lit(conn), lit(section))) == code


def test_units_and_models(spark):
    assert one(spark, text.canonical_unit(lit("Кв. м."))) == "м²"
    assert one(spark, text.canonical_unit(lit(" компл. "))) == "компл."
    assert one(spark, text.unit_from_size(lit("D160"))) == "м"
    assert one(spark, text.clean_model(lit("ГОСТ 14918"))) is None
    assert one(spark, text.clean_model(lit("0 x"))) is None
    assert one(spark, text.name_with_model(lit("Клапан rvn-1"), lit("RVN-1"))) == "Клапан rvn-1"
    assert one(spark, text.normalise_header(lit(" Ед._изм/шт-ё "))) == "ед изм шт е"


def test_expressions(spark):
    known = F.map_from_arrays(F.array(F.lit("A0"), F.lit("B0"), F.lit("D0")), F.array(F.lit(300.0), F.lit(200.0), F.lit(None).cast("double")))

    def value(expression):
        rows = spark.createDataFrame([(formatting.postfix(expression),)], f"tokens array<{formatting.TOKEN}>")
        return rows.select(formatting.evaluate_postfix(F.col("tokens"), known).alias("v")).first().v

    assert value("max(A0, B0) / 2") == 150
    assert value("A0 + B0 * 2") == 700
    assert value("max(A0, D0)") is None
    assert value("A0 / 0") is None and value("C9 + 1") is None
    assert value("A0 // 7 % 5 - round(2.5)") == 0
    assert value("-(A0 - 100) ** 2 + min(3, 2, 7) * +1.5") == -39997 and value("round(A0 / 7, 2)") == 42.86 and value("-7 // 2 - (-7 % 3)") == -6
    for bad in ("__import__('os')", "().__class__", "A0['x']", "open(A0)", "A0 if B0 else 1", "lambda: 1", "", "A0 +", "max(A0)", "'x'", "round(A0, digits=1)"):
        with pytest.raises(ValueError):
            formatting.postfix(bad)


def test_format_parameter(spark):
    assert one(spark, formatting.format_parameter(F.lit("A2"), F.lit(200.0))) == "0200"
    assert one(spark, formatting.format_parameter(F.lit("L0"), F.lit(12345.0))) == "12345"
    assert one(spark, formatting.format_parameter(F.lit("U0"), F.lit(90.5))) == "90"
    assert one(spark, formatting.format_parameter(F.lit("t"), F.lit(0.7))) == "0.7"


def test_queries(spark):
    found = one(spark, queries.item_queries(lit("Клапан обратный RVN  560"), lit("D1"), lit("Salda")))
    assert found == [
        "RVN 560 D1", "RVN 560", "RVN", "Клапан обратный RVN 560 D1", "Клапан обратный RVN 560", "Клапан обратный RVN",
        "Клапан обратный", "Клапан", "Salda D1", "Salda",
    ]
    assert one(spark, queries.is_relevant(lit("Клапан RVN"), queries.query_keywords(lit("клапан обратный rvn")))) is True
    assert one(spark, queries.is_relevant(lit("Фильтр"), queries.query_keywords(lit("клапан")))) is False
    assert one(spark, queries.is_relevant(lit("Фильтр"), queries.query_keywords(lit("a bc")))) is True


def test_trap_no_exception_on_missing_groups(spark):
    assert one(spark, text.find_number(lit("нет"), "([0-9]+)")) is None
    assert one(spark, text.price_digits(lit("12 500 ₽"))) == 12500
    assert one(spark, text.price_digits(lit("—"))) is None
