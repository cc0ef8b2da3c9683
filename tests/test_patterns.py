"""Pattern-query semantics on literal rows: Q1-Q4, Q9, Q11, Q13, Q14."""
import pytest
from pyspark.sql import functions as F

from meterlytics.operators import patterns as P
from meterlytics.schemas import DAILY, HALF_HOURLY, HOLIDAYS, WEATHER_DAILY, WEATHER_HOURLY


def _hh(spark, rows):
    full = []
    for lclid, day, vals in rows:
        v = list(vals) + [None] * (48 - len(vals))
        full.append((lclid, day, *v))
    return spark.createDataFrame(full, HALF_HOURLY)


def _daily(spark, rows):
    return spark.createDataFrame(rows, DAILY)


def test_hourly_null_readings_are_zero(spark):       # Q1
    df = _hh(spark, [("A", "2013-01-01", [0.5, None, 0.25, 0.25]), ("B", "2013-01-01", [None, None])])
    got = {r.hour: r for r in P.hourly_patterns(df).collect()}
    assert got[0].energy_count == 2 and got[0].energy_sum == 0.5 and got[0].energy_min == 0.0
    assert got[0].energy_median == 0.25
    assert got[1].energy_mean == 0.25
    assert got[5].energy_sum == 0.0 and got[5].energy_count == 2


def test_hourly_matches_direct_aggregation(spark):
    rows = [(f"H{i}", f"201{i % 3}-03-0{1 + i % 5}", [((i * 7 + j) % 11) / 8 for j in range(48)])
            for i in range(40)]
    df = _hh(spark, rows)
    long = P.hourly_long(df)
    e = F.col("energy")
    direct = {(r.year, r.hour): r for r in long.groupBy("year", "hour").agg(
        F.median(e).alias("m"), F.stddev_samp(e).alias("s"), F.avg(e).alias("a")).collect()}
    for r in P.hourly_patterns(df).collect():
        d = direct[(r.year, r.hour)]
        assert r.energy_median == pytest.approx(d.m)
        assert r.energy_mean == pytest.approx(d.a)
        assert (r.energy_std is None and d.s is None) or r.energy_std == pytest.approx(d.s)


def test_single_row_std_is_null(spark):               # Q3
    df = _hh(spark, [("A", "2013-01-01", [0.5] * 48)])
    assert all(r.energy_std is None for r in P.hourly_patterns(df).collect())


def test_daily_rollup_all_null_sum_is_zero(spark):    # Q2, Q4
    df = _daily(spark, [("A", "2013-01-07", None, None, None, None, None, None, None),
                        ("B", "2013-01-07", 1.0, 2.0, 3.0, 4, None, None, 0.5)])
    r = P.daily_patterns(df).first()
    assert r.energy_sum == 0.0 and r.energy_count == 4 and r.days_count == 2
    assert r.energy_mean == 2.0 and r.energy_std is None and r.weekday == 1


def test_seasonal_two_winter_week5_rows(spark):       # Q9
    df = _daily(spark, [("A", "1998-12-30", 1.0, 1.0, 1.0, 1, 0.0, 1.0, 1.0),
                        ("A", "1998-01-01", 2.0, 2.0, 2.0, 1, 0.0, 2.0, 2.0)])
    got = [(r.year, r.season, r.week) for r in P.seasonal_patterns(df).collect()]
    assert got == [(1998, "Winter", 5), (1998, "Winter", 5)]


def test_weekend_holiday_membership_no_duplication(spark):   # Q11
    df = _daily(spark, [("A", "2013-12-25", 1.0, 1.0, 1.0, 1, 0.0, 1.0, 1.0),
                        ("A", "2013-12-24", 1.0, 1.0, 1.0, 1, 0.0, 1.0, 1.0)])
    hol = spark.createDataFrame([("2013-12-25",), ("2013-12-25",)], HOLIDAYS)
    got = {r.is_weekend: r.days_count for r in P.weekday_vs_weekend(df, hol).collect()}
    assert got == {True: 1, False: 1}


def test_temperature_join_fans_out_and_bins(spark):   # Q13, Q14, Q12
    df = _daily(spark, [("A", "2013-01-01", 1.0, 1.0, 1.0, 2, 0.0, 2.0, 1.0),
                        ("B", "2013-01-01", 3.0, 3.0, 3.0, 2, 0.0, 6.0, 3.0)])
    w = spark.createDataFrame([("2013-01-01 00:00:00", -2.0, 1.0, 0.5),
                               ("2013-01-01 12:00:00", None, 30.0, 0.5)], WEATHER_DAILY)
    got = {r.temp_bin: r for r in P.temperature_energy(df, w).collect()}
    assert got["Below 0°C"].days_count == 2 and got["Below 0°C"].avg_temperature == -0.5
    assert got["Above 25°C"].days_count == 2 and got["Above 25°C"].avg_temperature is None
    assert got["Below 0°C"].energy_sum == 8.0 and got["Below 0°C"].energy_mean == 2.0


def test_temperature_hourly_pre_aggregation_is_exact(spark):
    hh = _hh(spark, [("A", "2013-01-01", [0.5] * 48), ("B", "2013-01-01", [0.25] * 48),
                     ("C", "2013-01-02", [1.0] * 48)])
    w = spark.createDataFrame([("2013-01-01 00:00:00", None, 0.5), ("2013-01-01 01:00:00", 3.0, 0.25),
                               ("2013-01-02 00:00:00", 30.0, 1.0)], WEATHER_HOURLY)
    got = {(r.hour, r.temp_bin): r for r in P.temperature_hourly(hh, w).collect()}
    assert got[(0, "Above 25°C")]["count"] == 3
    assert got[(0, "Above 25°C")].energy == pytest.approx((1.0 + 0.5 + 2.0) / 3)
    assert got[(0, "Above 25°C")].avg_temperature == 30.0
    assert got[(0, "Above 25°C")].avg_humidity == pytest.approx((0.5 * 2 + 1.0) / 3)
    assert got[(1, "0-5°C")]["count"] == 2 and got[(1, "0-5°C")].energy == 0.75


def test_household_pre_aggregation_counts_households(spark):
    df = _daily(spark, [("A", "2013-01-01", 1.0, 1.0, 1.0, 1, None, 1.0, 1.0),
                        ("A", "2013-01-02", 3.0, 3.0, 3.0, 1, 1.0, 3.0, 3.0),
                        ("B", "2013-01-01", 2.0, 2.0, 2.0, 1, None, 2.0, 2.0),
                        ("Z", "2013-01-01", 9.0, 9.0, 9.0, 1, None, 9.0, 9.0)])
    h = spark.createDataFrame([("A", "Std", "ACORN-A", "Affluent", "block_0"),
                               ("B", "Std", "ACORN-A", "Affluent", "block_0")],
                              "LCLid string, stdorToU string, Acorn string, Acorn_grouped string, file string")
    r = P.household_patterns(df, h).first()
    assert r.household_count == 2 and r.days_count == 3 and r.energy_mean == 2.0
    assert r.energy_std == 1.0 and r.energy_max == 3.0


@pytest.mark.parametrize("fn", ["household_patterns", "temperature_energy"])
def test_join_strategies_agree(spark, sources, fn):
    if fn == "household_patterns":
        a, b = (P.household_patterns(sources.daily, sources.households, strategy=x).collect() for x in ("broadcast", "preaggregate"))
    else:
        a, b = (P.temperature_energy(sources.daily, sources.weather_daily, weather_rows=n).collect() for n in (1, None))
    assert len(a) == len(b) > 0
    key = lambda r: tuple(str(v) for v in r[:4])
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        for u, v in zip(x, y):
            assert (u == pytest.approx(v)) if isinstance(u, float) else (u == v)
