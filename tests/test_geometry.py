"""Units, grids and plans on hand-made cases."""

import pytest
from chromaloom.functions import geometry as geo
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("value", "unit", "want"),
    [("25.4", "mm", 72_000_000), ("2,54", "cm", 72_000_000), (" 72 ", "pt", 72_000_000), ("1.0000009", "px", 1_000_000), ("-1", "mm", None), ("x", "px", None), ("1", "in", None), (None, "mm", None), ("0.001", "mm", 2835)],
)
def test_units(spark, value, unit, want):
    df = spark.createDataFrame([(value, unit)], "v string, u string")
    assert df.select(geo.unit_to_pxu(F.col("v"), F.col("u"))).first()[0] == want


def test_round_trip_and_trim(spark):
    df = spark.createDataFrame([("10", "cm", "mm", "100"), ("0", "mm", "px", "0"), ("1.5", "px", "pt", "1.5")], "v string, a string, b string, want string")
    assert all(r.got == r.want for r in df.select("want", geo.convert_unit(F.col("v"), F.col("a"), F.col("b")).alias("got")).collect())
    got = spark.range(1).select(geo.pxu_to_unit(F.lit(-1_500_000), F.lit("px")), geo.pxu_to_px(F.lit(1)), geo.pxu_to_px(F.lit(1_500_000))).first()
    assert tuple(got) == ("-1.5", 1, 2)


def test_state_rules(spark):
    def problem(w, h, x, given, turn):
        return spark.range(1).select(geo.state_problem(F.lit(w), F.lit(h), F.lit(x).cast("string"), F.lit("0"), F.lit(given), F.lit(True), F.lit(turn))).first()[0]

    assert problem("1000000", "32768000000", "-5", True, "0") is None
    assert problem("999999", "1000000", None, False, "0") == "width"
    assert problem("1000000", "x", None, False, "0") == "height"
    assert problem("1000000", "1000000", None, True, "0") == "x"
    assert problem("1000000", "1000000", None, False, "NaN") == "rotation"


def test_plan_cover(spark):
    zero = F.lit(0.0)
    pad = dict.fromkeys(("left", "right", "top", "bottom"), zero)

    def plan(at, width, **more):
        image = {"left": F.lit(float(at)), "top": zero, "width": F.lit(float(width)), "height": F.lit(100.0)}
        return spark.range(1).select(geo.content_region(F.lit(100.0), F.lit(100.0), pad | more, image, F.lit(200.0), F.lit(100.0))).first()[0]

    assert plan(0, 100).coverage == "full"
    assert plan(50, 100).coverage == "partial"
    assert plan(500, 100).coverage == "none"
    assert plan(0, 0).reason == "display size"
    assert plan(0, 100, left=F.lit(100.0)).reason == "empty content area"


def test_dpi_and_upload(spark):
    got = spark.range(1).select(
        geo.image_dpi(F.lit(None).cast("int"), F.lit(None).cast("int")), geo.image_dpi(F.lit(100), F.lit(101)), geo.image_dpi(F.lit(0), F.lit(300)), geo.upload_problem(F.lit(1), F.lit("a/b"), F.lit(10**5), F.lit(10**5)), geo.work_edge(F.lit(2), F.lit(0), F.lit(5))
    ).first()
    assert tuple(got) == (72, 101, 300, "too many pixels", 720)
