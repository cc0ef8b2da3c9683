"""Measure the aggregate-before-join rewrites against the plain join-first
plans (same results) at one scale. usage: python tools/ablation.py [sf_dir]"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from pyspark.sql import functions as F  # noqa: E402

from meterlytics.functions import calendar as cal  # noqa: E402
from meterlytics.operators import patterns as P  # noqa: E402
from meterlytics.session import build_session  # noqa: E402
from meterlytics.sources.catalog import load_sources  # noqa: E402


def plain_household(s):
    h = s.households.select("LCLid", "stdorToU", "Acorn", "Acorn_grouped")
    return (s.daily.join(h, "LCLid").groupBy("stdorToU", "Acorn_grouped", "Acorn")
            .agg(*P.daily_rollup_aggs(), F.count_distinct("LCLid").alias("household_count"),
                 F.count(F.lit(1)).alias("days_count")))


def plain_temperature(s):
    w = P.daily_weather(s.weather_daily)
    d = s.daily.withColumn("_d", cal.parse_date("day")).join(w, "_d")
    return (d.groupBy(F.year("_d").alias("year"), F.month("_d").alias("month"), cal.temp_bin("_tmean").alias("temp_bin"))
            .agg(F.avg("_tmean").alias("avg_temperature"), *P.daily_rollup_aggs(), F.count(F.lit(1)).alias("days_count")))


def plain_temperature_hourly(s):
    e = s.half_hourly.select(cal.parse_date("day").alias("_d"),
                             F.posexplode(F.array(*P.hourly_energy_columns())).alias("hour", "energy"))
    j = e.join(P.hourly_weather(s.weather_hourly), ["_d", "hour"])
    return (j.groupBy("hour", cal.temp_bin("temperature").alias("temp_bin"))
            .agg(F.avg("temperature"), F.avg("humidity"), F.avg("energy"), F.count(F.lit(1))))


def timed(df, reps=3):
    best = None
    for _ in range(reps):
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        dt = time.perf_counter() - t
        best = dt if best is None else min(best, dt)
    return round(best, 2)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16)
    s = load_sources(spark, sf)
    r = {k: s.row_count(k) for k in ("households", "weather_daily", "weather_hourly")}
    pairs = {
        "A6 household": (P.household_patterns(s.daily, s.households, households_rows=r["households"]), plain_household(s)),
        "A7 temperature_energy": (P.temperature_energy(s.daily, s.weather_daily, weather_rows=r["weather_daily"]),
                                  plain_temperature(s)),
        "A8 temperature_hourly": (P.temperature_hourly(s.half_hourly, s.weather_hourly, weather_rows=r["weather_hourly"]),
                                  plain_temperature_hourly(s)),
    }
    timed(pairs["A6 household"][0], 1)   # warm-up
    out = {k: {"rewrite_s": timed(a), "plain_s": timed(b)} for k, (a, b) in pairs.items()}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
