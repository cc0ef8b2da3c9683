"""Calendar corners: Q6-Q10, Q14, Q15, Q19, Q35, C21."""
import datetime as dt

from pyspark.sql import functions as F

from meterlytics.functions import calendar as cal


def _one(spark, expr, value, dtype="string"):
    return spark.createDataFrame([(value,)], f"v {dtype}").select(expr(F.col("v")).alias("r")).first()["r"]


def test_iso_week_with_calendar_year(spark):       # Q6
    rows = spark.createDataFrame([("2012-12-31",), ("2012-01-01",), ("1998-12-31",)], "day string")
    d = cal.parse_date("day")
    got = rows.select(F.year(d).alias("y"), cal.iso_week(d).alias("w")).collect()
    assert [(r.y, r.w) for r in got] == [(2012, 1), (2012, 52), (1998, 53)]


def test_weekday_monday_is_one(spark):             # Q7
    assert _one(spark, lambda c: cal.iso_weekday(cal.parse_date(c)), "2024-01-01") == 1   # Monday
    assert _one(spark, lambda c: cal.iso_weekday(cal.parse_date(c)), "2024-01-07") == 7   # Sunday
    assert _one(spark, cal.weekday_name, 5, "int") == "Friday"


def test_week_seasons_and_week_in_season(spark):   # Q8, Q9
    weeks = spark.createDataFrame([(w,) for w in (1, 9, 10, 22, 23, 35, 36, 48, 49, 53)], "w int")
    got = weeks.select(cal.week_season("w").alias("s"), cal.week_season_sequence("w").alias("q"),
                       cal.week_in_season("w").alias("k")).collect()
    assert [(r.s, r.q, r.k) for r in got] == [
        ("Winter", 1, 5), ("Winter", 1, 13), ("Spring", 2, 1), ("Spring", 2, 13),
        ("Summer", 3, 1), ("Summer", 3, 13), ("Fall", 4, 1), ("Fall", 4, 13),
        ("Winter", 5, 1), ("Winter", 5, 5)]


def test_weekend_thresholds(spark):                 # Q10
    friday = spark.createDataFrame([(5,)], "d int")
    assert friday.select(cal.weekend_flag("d", F.lit(False), 6)).first()[0] is False
    assert friday.select(cal.weekend_flag("d", F.lit(False), 5)).first()[0] is True
    assert friday.select(cal.weekend_flag("d", F.lit(None), 6)).first()[0] is False
    assert friday.select(cal.weekend_flag("d", F.lit(True), 6)).first()[0] is True


def test_temperature_bins_left_closed_null_last(spark):   # Q14
    vals = [(-0.1,), (0.0,), (4.9,), (24.99,), (25.0,), (None,), (float("nan"),)]
    got = [r.b for r in spark.createDataFrame(vals, "t double").select(cal.temp_bin("t").alias("b")).collect()]
    assert got == ["Below 0°C", "0-5°C", "0-5°C", "20-25°C", "Above 25°C", "Above 25°C", "Above 25°C"]


def test_bins_sort_as_text(spark):                  # Q15
    from meterlytics.schemas import TEMP_BINS
    got = [r.b for r in spark.createDataFrame([(b,) for b in TEMP_BINS], "b string").orderBy("b").collect()]
    assert got == ["0-5°C", "10-15°C", "15-20°C", "20-25°C", "5-10°C", "Above 25°C", "Below 0°C"]


def test_month_season_code(spark):                  # Q19
    dates = [(dt.date(2020, m, 1),) for m in range(1, 13)]
    got = [r.s for r in spark.createDataFrame(dates, "d date").select(cal.month_season_code("d").alias("s")).collect()]
    assert got == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 0]


def test_year_from_text_and_slot_labels(spark):     # Q35, C21
    assert _one(spark, cal.year_from_text, "2013-07-01") == 2013
    labels = [r.l for r in spark.range(48).select(cal.slot_label("id").alias("l")).collect()]
    assert labels[0] == "00:00" and labels[1] == "00:30" and labels[47] == "23:30"


def test_malformed_date_raises(spark):              # Q33
    import pytest
    with pytest.raises(Exception):
        spark.createDataFrame([("2013-13-45",)], "day string").select(cal.parse_date("day")).collect()
