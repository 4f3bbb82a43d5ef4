import pytest
from pyspark.sql import functions as F

from recordloom.functions import dates, geometry, text, units


def one(spark, column, value=None, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.person_name, "Late Rajesh Kumar /", "Rajesh Kumar"),
        (text.person_name, "  Shri   Anil   Sharma  ", "Anil Sharma"),
        (text.person_name, None, ""),
        (text.parcel_id, "१४२ / १", "142/1"),
        (text.parcel_id, "  142-2  ", "142/2"),
        (text.parcel_id, "No. 89/1/A", "89/1"),
        (text.parcel_id, "708/417/F-104", "708/417/F-104"),
        (text.parcel_id, "708 / 417 / A", "708/417/A"),
        (text.parcel_id, "W.NO. 84", "W.NO. 84"),
        (text.taluk, "Taluk: ಜಯನಗರಿಉಪಏಭಾಗ", "Jayanagar Sub-division"),
        (text.parcel_id, "none", "none"),
        (text.locality, "Village: ಜಯನಗರ", "Jayanagar"),
        (text.district, "District - ಬೆಂಗಳೂರು", "Bengaluru"),
        (text.indic_digits, "೧೨ಂ", "120"),
        (text.plain_digits, "१२೩", "123"),
        (text.clean_ocr, "a‍b \t c﻿ ", "ab c"),
        (text.inline_value, "Village: Shirur", "Shirur"),
        (text.inline_value, "Village", None),
        (text.file_name, "/tmp/a b?.pdf", "a_b_.pdf"),
        (text.language, "KN", "kannada"),
        (text.language, None, "kannada"),
        (units.to_hectares, "2 bigha", round(2 * 0.2529, 6)),
        (units.to_hectares, "1.5 acre", round(1.5 * 0.404686, 6)),
        (units.to_hectares, "०.८५००", 0.85),
        (units.to_hectares, "nothing", 0.0),
        (units.unit_in, "3 bigha", "bigha"),
        (dates.normalize, "15/08/2023", "2023-08-15"),
        (dates.normalize, "26-01-2024", "2024-01-26"),
        (dates.normalize, "1/2/2020", "2020-02-01"),
        (dates.normalize, "3 March 2021", "2021-03-03"),
        (dates.normalize, "soon", "soon"),
        (dates.normalize, "", None),
        (dates.fasli_start, "1428-1433", 2020),
        (dates.fasli_start, "none", None),
        (dates.is_calendar_date, "31/02/2020", False),
        (dates.is_calendar_date, "29/02/2020", True),
        (dates.repair_year, "23", "2023"),
        (dates.repair_year, "1999", "1999"),
        (text.has_content, " . ", False),
        (text.has_content, "ಅ", True),
        (text.is_repetitive, "a a a b", True),
        (text.is_repetitive, "a b c", False),
        (text.fingerprint, " é ", "4a99557e4033c3539de2eb65472017cad5f9557f7a0625a09f1c3f6e2ba69c4c"[:16]),
    ],
)
def test_scalars(spark, f, value, want):
    got = one(spark, f("x"), value)
    assert got == want or isinstance(want, float) and abs(got - want) < 1e-9


def test_date_verdicts(spark):
    rows = spark.createDataFrame([(v,) for v in ("15/08/2023", "2023-08-15", "30/02/2020", "1/13/2020", "1/1/1700", "x", " ", None)], "x string")
    got = [(r.v.status, r.v.reason) for r in rows.select(dates.verdict("x").alias("v")).collect()]
    assert [s for s, _ in got] == ["VALID", "VALID", "INVALID", "INVALID", "INVALID", "WARNING", "INVALID", "INVALID"]
    assert got[0][1] == "Valid calendar date (2023-08-15)"


@pytest.mark.parametrize(
    ("r", "h", "cer", "wer"),
    [("1234567890", "123456789X", 0.1, 1.0), ("a b c", "a x c", 0.2, 1 / 3), ("", "text", 1.0, 1.0), ("", "", 0.0, 0.0), ("ನಮ", "ನ", 0.5, 1.0), ("one two", "one two three four", 11 / 7, 1.0)],
)
def test_error_rates(spark, r, h, cer, wer):
    row = spark.createDataFrame([(r, h)], "r string, h string").select(text.cer("r", "h").alias("c"), text.wer("r", "h").alias("w"), text.capped_cer("r", "h").alias("k")).first()
    assert abs(row.c - cer) < 1e-9 and abs(row.w - wer) < 1e-9 and abs(row.k - min(1.0, cer)) < 1e-9


def test_matching_and_sets(spark):
    row = spark.createDataFrame([("142/1", "142-1", "Ramesh K", "ramesh")], "a string, b string, c string, d string").select(text.fuzzy_match("a", "b").alias("x"), text.fuzzy_match("c", "d").alias("y"), text.set_f1("c", "d").alias("f")).first()
    assert row.x and row.y and 0 < row.f < 1
    assert one(spark, text.after_anchor(F.lit("Owner: Anil Village: Shirur"), F.lit("owner"), ["village"])) == "Anil"
    assert one(spark, text.fold_replace(F.lit("abc ab"), {"ab": "1", "abc": "2"})) == "2 1"
    r = one(spark, text.semantic_normalize(F.lit("“a”  …१")))
    assert (r.normalized, r.changed) == ('"a" ...1', True)
    r = one(spark, text.kannada_normalize(F.lit("ಕ  ಖ")))
    assert (r.normalized, r.rules) == ("ಕ ಖ", ["whitespace"])


def test_boxes_and_rings(spark):
    a, b = geometry.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10)), geometry.box(F.lit(5), F.lit(0), F.lit(15), F.lit(10))
    assert abs(one(spark, geometry.iou(a, b)) - 1 / 3) < 1e-9
    assert one(spark, geometry.overlaps(a, b)) is True
    assert one(spark, geometry.inside_share(a, b)) == 0.5
    c = one(spark, geometry.clamped(geometry.box(F.lit(50), F.lit(5), F.lit(-5), F.lit(5)), F.lit(20), F.lit(20)))
    assert (c.x_min, c.y_min, c.x_max, c.y_max) == (0, 5, 20, 6)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))])
    assert one(spark, geometry.contains(ring, F.lit(2.0), F.lit(2.0))) is True
    assert one(spark, geometry.contains(ring, F.lit(5.0), F.lit(2.0))) is False
    assert one(spark, geometry.contains(ring, F.lit(0.0), F.lit(2.0))) is False
    assert tuple(one(spark, geometry.centroid(ring))) == (2.0, 2.0)
    assert one(spark, geometry.planar_metres(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == 111320.0
    p = one(spark, geometry.polygon_box(F.array(F.array(F.lit(1.0), F.lit(5.0)), F.array(F.lit(3.0), F.lit(2.0)))))
    assert (p.x_min, p.y_min, p.x_max, p.y_max) == (1, 2, 3, 5)
    assert one(spark, units.deviation_percent(F.lit(2.0), F.lit(0.0))) is None
