"""A key holding over a third of all rows: results stay exact and whole."""
import pytest
from pyspark.sql import functions as F

from meterlytics.operators import patterns as P
from meterlytics.schemas import DAILY


def _skewed_daily(sources):
    d = sources.daily.select(*DAILY.fieldNames())
    hot_id = d.select("LCLid").orderBy("LCLid").first().LCLid
    hot = d.where(F.col("LCLid") == hot_id)
    n = d.count()
    copies = max(2, (n // 2) // max(1, hot.count()))
    # the hot household's rows repeated: it now holds more than a third of the rows
    rep = hot.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("_k")
    return d.unionByName(rep), hot_id


def test_household_patterns_exact_under_skew(spark, sources):
    d, hot_id = _skewed_daily(sources)
    assert d.where(F.col("LCLid") == hot_id).count() * 3 > d.count()
    got = {(r.stdorToU, r.Acorn): r for r in
           P.household_patterns(d, sources.households, households_rows=sources.row_count("households")).collect()}
    h = sources.households.select("LCLid", "stdorToU", "Acorn_grouped", "Acorn")
    plain = (d.join(h, "LCLid").groupBy("stdorToU", "Acorn_grouped", "Acorn")
              .agg(*P.daily_rollup_aggs(), F.count_distinct("LCLid").alias("household_count"),
                   F.count(F.lit(1)).alias("days_count")).collect())
    assert len(plain) == len(got)
    for r in plain:
        g = got[(r.stdorToU, r.Acorn)]
        assert (g.days_count, g.household_count, g.energy_count) == (r.days_count, r.household_count, r.energy_count)
        assert g.energy_mean == pytest.approx(r.energy_mean) and g.energy_sum == pytest.approx(r.energy_sum)


def test_temperature_energy_exact_under_skew(spark, sources):
    d, _ = _skewed_daily(sources)
    got = P.temperature_energy(d, sources.weather_daily, weather_rows=sources.row_count("weather_daily"))
    assert got.agg(F.sum("days_count")).first()[0] == d.join(
        P.daily_weather(sources.weather_daily),
        F.to_date("day") == F.col("_d")).count()


def test_salted_semi_join_equals_broadcast_semi_join(spark, sources):
    from meterlytics.operators import profiles as PR
    from meterlytics.schemas import HALF_HOURLY
    hh = sources.half_hourly.select(*HALF_HOURLY.fieldNames())
    hot = hh.where(F.col("LCLid") == hh.select("LCLid").orderBy("LCLid").first().LCLid)
    skewed = hh.unionByName(hot.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(40)))).drop("_k"))
    args = (skewed, sources.households, sources.holidays, sources.weather_daily, "Comfortable", (1995, 2001))
    small = PR.daily_profiles(*args, households_rows=sources.row_count("households"))
    salted = PR.daily_profiles(*args, households_rows=None)
    plan = salted._jdf.queryExecution().executedPlan().toString()
    import re
    assert re.search(r"Join \[LCLid#\d+, _salt#\d+\], \[LCLid#\d+, _salt#\d+\], LeftSemi", plan)
    cols = ["LCLid", "day", "is_weekend", "season", F.size("hh_consumption").alias("n")]
    assert small.count() == salted.count() > 0
    assert small.select(*cols).exceptAll(salted.select(*cols)).count() == 0
