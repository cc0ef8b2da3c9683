"""Write docs/PLANS.md: the physical plan of each heavy query (before AQE
re-planning) at a given scale, with expression ids stripped.

usage: python tools/plans.py [sf_dir]
"""
import re
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from meterlytics.operators import features as FE  # noqa: E402
from meterlytics.operators import patterns as P  # noqa: E402
from meterlytics.operators import profiles as PR  # noqa: E402
from meterlytics.session import build_session  # noqa: E402
from meterlytics.sources.catalog import load_sources  # noqa: E402


def clean(text: str) -> str:
    text = re.sub(r"#\d+L?", "", text)
    text = re.sub(r"file:/\S+?/meterlytics/sources/[0-9a-f]+/", "<sources>/", text)
    text = re.sub(r"Location: InMemoryFileIndex\(\d+ paths\)\[[^\]]*\]", "Location: <sources>", text)
    lines = []
    for ln in text.splitlines():
        lines.append(ln if len(ln) <= 220 else ln[:217] + "...")
    return "\n".join(lines)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16)
    s = load_sources(spark, sf)
    rows = {k: s.row_count(k) for k in ("households", "holidays", "weather_daily", "weather_hourly")}
    prof = PR.daily_profiles(s.half_hourly, s.households, s.holidays, s.weather_daily, "Comfortable",
                             (1996, 1999), households_rows=rows["households"],
                             holiday_rows=rows["holidays"], weather_rows=rows["weather_daily"])
    plans = {
        "hourly_patterns (A1)": P.hourly_patterns(s.half_hourly),
        "hourly_patterns, years=[1996] (A1 + F1)": P.hourly_patterns(s.half_hourly, years=[1996]),
        "daily_patterns (A2)": P.daily_patterns(s.daily),
        "seasonal_patterns (A4)": P.seasonal_patterns(s.daily),
        "weekday_vs_weekend (A5, J6)": P.weekday_vs_weekend(s.daily, s.holidays, holiday_rows=rows["holidays"]),
        "household_patterns (A6, J1)": P.household_patterns(s.daily, s.households,
                                                             households_rows=rows["households"]),
        "household_patterns, households not provably small (A6 pre-aggregated, shuffle join)":
            P.household_patterns(s.daily, s.households, households_rows=None),
        "temperature_energy (A7, J2)": P.temperature_energy(s.daily, s.weather_daily,
                                                             weather_rows=rows["weather_daily"]),
        "temperature_hourly (A8, J3)": P.temperature_hourly(s.half_hourly, s.weather_hourly,
                                                             weather_rows=rows["weather_hourly"]),
        "daily_profiles (S10, J4-J7)": prof,
        "daily_profiles, members not provably small (salted semi-join)": PR.daily_profiles(
            s.half_hourly, s.households, s.holidays, s.weather_daily, "Comfortable", (1996, 1999),
            households_rows=None, holiday_rows=rows["holidays"], weather_rows=rows["weather_daily"]),
        "build_features (V3-V6)": FE.build_features(prof),
    }
    out = ["# Physical plans", "",
           f"Generated by `python tools/plans.py {sf}` (local[8], 16 shuffle partitions, AQE on; the",
           "plans are the initial adaptive plans, before runtime re-planning). Expression ids are stripped.", ""]
    for title, df in plans.items():
        out += [f"## {title}", "", "```", clean(df._jdf.queryExecution().executedPlan().toString()), "```", ""]
    target = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "docs", "PLANS.md")
    with open(target, "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
