import pytest

from shelfspark.operators.units import parse_dimensions, parse_unit, product_sizes, resolve_sizes, stated_unit, to_mm


@pytest.mark.parametrize(("text", "mm"), [("мм", 1), ("миллиметров", 1), ("см", 10), ("сантиметра", 10), ("м", 1000), ("метрах", 1000), ("inches", 25.4), ('"', 25.4), ("Zoll", 25.4), ("дюймов", 25.4), ("(cm)", 10), ("kilometre", 1e6), ("dm", 100)])
def test_lengths(text, mm):
    assert to_mm(1, text) == pytest.approx(mm)


def test_readings_depend_on_the_field():
    assert parse_unit("m²").exponent == 2 and parse_unit("м3").exponent == 3
    assert parse_unit("г", "weight").dimension == "mass"
    assert parse_unit("min").dimension == "time" and parse_unit("min", "size").dimension == "length"
    assert parse_unit("шт") is None and parse_unit("") is None and to_mm(1, "кг") is None


@pytest.mark.parametrize(
    ("text", "field", "unit"),
    [
        ("MW", None, ("power", 1e6, 1)), ("mW", None, ("power", 1e-3, 1)), ("МВт", None, ("power", 1e6, 1)), ("KW", None, ("power", 1e3, 1)), ("Mm", None, ("length", 1e6, 1)), ("ММ", "size", ("length", 1e-3, 1)), ("MM", "size", ("length", 1e-3, 1)),
        ("Вт/м²", None, ("length^-2·power", 1.0, 1)), ("кг·м", None, ("length·mass", 1e3, 1)), ("kg·m/s²", None, ("length·mass·time^-2", 1e3, 1)), ("in³", None, ("length", 0.0254**3, 3)), ("mil", "size", ("length", 2.54e-5, 1)), ("cm⁻¹", None, ("length", 100.0, -1)),
        ("lm per W", None, ("flux·power^-1", 1.0, 1)), ("km/h", None, ("length·time^-1", 1000 / 3600, 1)), ("м^2", "size", ("length", 1.0, 2)), ("квт*ч", None, ("power·time", 3.6e6, 1)), ("mm/mm", None, None), ("/м", None, None), ("м/", None, None), ("x" * 500, None, None),
    ],
)
def test_compound_units(text, field, unit):
    got = parse_unit(text, field)
    assert got is None if unit is None else (got.dimension, pytest.approx(got.factor), got.exponent) == unit


@pytest.mark.parametrize(
    ("text", "sizes"),
    [
        ("20 cm W, height 145cm", {"width": 200, "height": 1450}), ("диаметр=0.14м; Выс.-0.98м", {"diameter": 140, "height": 980}), ("0,11 x 1,73 м (ØxВ)", {"diameter": 110, "height": 1730}),
        ("Ш: 9; высота: 12 (см)", {"width": 90, "height": 120}), ("D: 30, В: 1 340 (мм)", {"diameter": 30, "height": 1340}), ("dia.: 57 cm; box 71x76x63 cm", {"diameter": 570}), ("В 520мм", {"height": 520}), ("B 520mm", {"width": 520}),
        ('2,36 × 40,16" (ВxØ)', {"height": 59.944, "diameter": 1020.064}), ("упаковка 48x53x40 см", {}), ("по проекту", {}), ("", {}), (None, {}), ("x" * 50_000, {}),
    ],
)
def test_dimension_texts(text, sizes):
    assert parse_dimensions(text)[0] == pytest.approx(sizes)


def test_bare_numbers_count_only_for_filled_axes():
    assert parse_dimensions("5x42")[0] == {} and parse_dimensions("5x42")[1] == [5, 42]
    none = {"width": None, "height": None, "diameter": None}
    assert resolve_sizes("5x42", none, none, 10.0) == {}
    assert resolve_sizes("5x42", none, none | {"height": 420.0, "diameter": 50.0}, 10.0) == {"height": 420, "diameter": 50}
    assert resolve_sizes("5x42", none, none | {"height": 42.0}, 10.0) == {"height": 420}  # written in centimetres


def test_the_text_is_right_where_fields_disagree():
    none = {"width": None, "height": None, "diameter": None}
    assert resolve_sizes("ширина 12 см", none | {"width": 7.0}, none | {"height": 14.0, "width": 12.0}, 1.0) == {"width": 120, "height": 140}
    assert resolve_sizes(None, none | {"width": float("nan")}, none, 1.0) == {}


def test_remarks():
    assert stated_unit("Размеры без подписи — в см") == 10 and stated_unit("plain width are metres") == 1000
    assert stated_unit("Единица указана в каждой карточке") is None and stated_unit(None) is None


def test_table(spark):
    schema = "product_id long, supplier string, name string, dimensions string, width double, height double, diameter double, width_mm double, height_mm double, diameter_mm double, attributes map<string,string>, axis string, mm string"
    rows = [(1, "a", "x", None, 0.5, None, None, None, None, None, {"unit": "m"}, "", ""), (2, "b", None, None, 5.0, None, None, None, None, None, None, "", ""), (3, None, None, "D 3 cm", None, None, None, None, None, None, {}, "", ""), (4, "a", "x", None, None, None, None, None, None, None, {}, "", "")]
    shops = spark.createDataFrame([("a", "in cm"), ("b", "numbers are inches")], "host string, evidence string")
    got = product_sizes(spark.createDataFrame(rows, schema), shops)
    assert sorted(map(tuple, got.collect())) == [(1, "width", 500), (2, "width", 127), (3, "diameter", 30)]
    assert product_sizes(spark.createDataFrame([], schema), shops).count() == 0
