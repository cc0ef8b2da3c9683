"""DuckDB oracle SQL for every query key with an SQL equivalent.

Each statement starts from the driver's tables (through the fixture CTEs) and
computes the result the plain way (join first, unpivot first), so it also
checks that the Spark plans' aggregate-before-join rewrites are exact.
Doubles are rounded to 9 places on both sides (summation order differs
between engines); integer widths are fixed by casts.
"""

from __future__ import annotations

from ..schemas import QUANTILE_SCHEMES, S7, TEMP_BINS
from .sqltext import (S7_ROLLUP, hourly_long_sql, month_name_sql, rounded, temp_bin_sql,
                      weekday_name_sql, with_ctes)

S7_KINDS = [("energy_median", "d"), ("energy_mean", "d"), ("energy_max", "d"),
            ("energy_count", "l"), ("energy_std", "d"), ("energy_sum", "d"),
            ("energy_min", "d")]

DATE = "CAST(day AS DATE)"
WTS = "CAST(strptime(time, '%Y-%m-%d %H:%M:%S') AS DATE)"
WHOUR = "hour(strptime(time, '%Y-%m-%d %H:%M:%S'))"


# ---------------------------------------------------------------- pattern CTEs

def _hourly_body() -> str:
    return f"""SELECT CAST(substr(k, 1, 4) AS INTEGER) AS year, hour,
       median(energy) AS energy_median, avg(energy) AS energy_mean, max(energy) AS energy_max,
       count(energy) AS energy_count, stddev_samp(energy) AS energy_std,
       coalesce(sum(energy), 0) AS energy_sum, min(energy) AS energy_min
FROM (
{hourly_long_sql()}
) AS u
GROUP BY 1, 2"""


def _daily_body() -> str:
    return f"""SELECT CAST(year({DATE}) AS INTEGER) AS year, CAST(isodow({DATE}) AS INTEGER) AS weekday,
       {weekday_name_sql(f'isodow({DATE})')} AS weekday_name,
       {S7_ROLLUP}, count(*) AS days_count
FROM daily GROUP BY 1, 2, 3"""


def _weekly_body() -> str:
    return f"""SELECT CAST(year({DATE}) AS INTEGER) AS year, CAST(weekofyear({DATE}) AS INTEGER) AS week,
       {S7_ROLLUP}, count(*) AS weeks_count
FROM daily GROUP BY 1, 2"""


def _seasonal_body() -> str:
    w = f"weekofyear({DATE})"
    season = (f"CASE WHEN {w} BETWEEN 1 AND 9 THEN 'Winter' WHEN {w} BETWEEN 10 AND 22 THEN 'Spring' "
              f"WHEN {w} BETWEEN 23 AND 35 THEN 'Summer' WHEN {w} BETWEEN 36 AND 48 THEN 'Fall' "
              f"WHEN {w} BETWEEN 49 AND 53 THEN 'Winter' ELSE 'Unknown' END")
    seq = (f"CASE WHEN {w} BETWEEN 1 AND 9 THEN 1 WHEN {w} BETWEEN 10 AND 22 THEN 2 "
           f"WHEN {w} BETWEEN 23 AND 35 THEN 3 WHEN {w} BETWEEN 36 AND 48 THEN 4 "
           f"WHEN {w} BETWEEN 49 AND 53 THEN 5 END")
    wk = (f"CASE WHEN {w} >= 49 THEN {w} - 48 WHEN {w} <= 9 THEN {w} + 4 WHEN {w} <= 22 THEN {w} - 9 "
          f"WHEN {w} <= 35 THEN {w} - 22 ELSE {w} - 35 END")
    return f"""SELECT year, season, week, {', '.join(S7)}, days_count FROM (
SELECT CAST(year({DATE}) AS INTEGER) AS year, {season} AS season, {seq} AS season_sequence,
       CAST({wk} AS INTEGER) AS week,
       {S7_ROLLUP}, count(*) AS days_count
FROM daily GROUP BY 1, 2, 3, 4) AS s"""


def _weekend_body() -> str:
    return f"""SELECT CAST(year({DATE}) AS INTEGER) AS year,
       (isodow({DATE}) >= 6 OR {DATE} IN (SELECT CAST(holiday AS DATE) FROM holidays)) AS is_weekend,
       {S7_ROLLUP}, count(*) AS days_count
FROM daily GROUP BY 1, 2"""


def _household_body() -> str:
    return f"""SELECT h.stdorToU, h.Acorn_grouped, h.Acorn,
       {S7_ROLLUP}, count(DISTINCT d.LCLid) AS household_count, count(*) AS days_count
FROM daily AS d JOIN households AS h ON d.LCLid = h.LCLid
GROUP BY 1, 2, 3"""


def _temperature_energy_body() -> str:
    return f"""SELECT CAST(year(e.dt) AS INTEGER) AS year, CAST(month(e.dt) AS INTEGER) AS month,
       {month_name_sql('month(e.dt)')} AS month_name, {temp_bin_sql('w.tmean')} AS temp_bin,
       avg(w.tmean) AS avg_temperature,
       {S7_ROLLUP}, count(*) AS days_count
FROM (SELECT *, {DATE} AS dt FROM daily) AS e
JOIN (SELECT {WTS} AS dt, (temperatureMax + temperatureMin) / 2 AS tmean FROM weather_daily) AS w
  ON e.dt = w.dt
GROUP BY 1, 2, 3, 4"""


def _temperature_hourly_body() -> str:
    return f"""SELECT e.hour, {temp_bin_sql('w.temperature')} AS temp_bin,
       avg(w.temperature) AS avg_temperature, avg(w.humidity) AS avg_humidity,
       avg(e.energy) AS energy, count(*) AS count
FROM (
{hourly_long_sql(key_sql=DATE)}
) AS e
JOIN (SELECT {WTS} AS dt, {WHOUR} AS hour, temperature, humidity FROM weather_hourly) AS w
  ON e.k = w.dt AND e.hour = w.hour
GROUP BY 1, 2"""


PATTERN_CTES = [
    ("p_hourly", _hourly_body()),
    ("p_daily", _daily_body()),
    ("p_weekly", _weekly_body()),
    ("p_seasonal", _seasonal_body()),
    ("p_weekend", _weekend_body()),
    ("p_household", _household_body()),
    ("p_temperature", _temperature_energy_body()),
    ("p_temp_hourly", _temperature_hourly_body()),
]

KINDS = {
    "hourly_patterns": [("year", "i"), ("hour", "i"), *S7_KINDS],
    "daily_patterns": [("year", "i"), ("weekday", "i"), ("weekday_name", "s"), *S7_KINDS,
                       ("days_count", "l")],
    "weekly_patterns": [("year", "i"), ("week", "i"), *S7_KINDS, ("weeks_count", "l")],
    "seasonal_patterns": [("year", "i"), ("season", "s"), ("week", "i"), *S7_KINDS,
                          ("days_count", "l")],
    "weekday_vs_weekend": [("year", "i"), ("is_weekend", "b"), *S7_KINDS, ("days_count", "l")],
    "household_patterns": [("stdorToU", "s"), ("Acorn_grouped", "s"), ("Acorn", "s"), *S7_KINDS,
                           ("household_count", "l"), ("days_count", "l")],
    "temperature_energy": [("year", "i"), ("month", "i"), ("month_name", "s"), ("temp_bin", "s"),
                           ("avg_temperature", "d"), *S7_KINDS, ("days_count", "l")],
    "temperature_hourly": [("hour", "i"), ("temp_bin", "s"), ("avg_temperature", "d"),
                           ("avg_humidity", "d"), ("energy", "d"), ("count", "l")],
}

_PATTERN_CTE = {
    "hourly_patterns": "p_hourly", "daily_patterns": "p_daily",
    "weekly_patterns": "p_weekly", "seasonal_patterns": "p_seasonal",
    "weekday_vs_weekend": "p_weekend", "household_patterns": "p_household",
    "temperature_energy": "p_temperature", "temperature_hourly": "p_temp_hourly",
}


def _q(final: str) -> str:
    return with_ctes(PATTERN_CTES, final)


# ---------------------------------------------------------------- second stage

FILTER_YEARS = [1996, 1998]
FILTER_MONTHS = [1, 2, 12]
FILTER_BINS = ["Below 0°C", "0-5°C", "5-10°C"]
FILTER_TARIFFS = ["Std", "ToU"]
ONE_TARIFF = "ToU"
FILTER_ACORNS = ["ACORN-A", "ACORN-C", "ACORN-F", "ACORN-K", "ACORN-Q"]


def _in(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def _labels_sql(n: int) -> str:
    _, labels = QUANTILE_SCHEMES[n]
    vals = ", ".join(f"({i}, '{lab}')" for i, lab in enumerate(labels))
    return f'SELECT * FROM (VALUES {vals}) AS v("order", quantile_group)'


def _quantile_ctes(n: int, metric: str = "energy_mean") -> list[tuple[str, str]]:
    qs, labels = QUANTILE_SCHEMES[n]
    qlist = ", ".join(f"CAST({q} AS DOUBLE)" for q in qs)
    whens = " ".join(f"WHEN {metric} <= e[{i + 2}] THEN '{lab}'" for i, lab in enumerate(labels))
    return [
        ("edges", f"SELECT quantile_cont({metric}, [{qlist}]) AS e FROM p_household"),
        ("lab", f"SELECT p.*, CASE WHEN {metric} IS NULL THEN NULL {whens} END AS quantile_group "
                f"FROM p_household AS p, edges"),
        ("labels", _labels_sql(n)),
    ]


def _consumer_groups_ctes(n: int) -> list[tuple[str, str]]:
    return _quantile_ctes(n) + [
        ("summ", """SELECT quantile_group, avg(energy_mean) AS energy_mean, avg(energy_median) AS energy_median,
       avg(energy_max) AS energy_max, avg(energy_sum) AS energy_sum,
       sum(household_count) AS household_count,
       avg(CASE WHEN stdorToU = 'ToU' THEN CAST(100 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS tou
FROM lab WHERE quantile_group IS NOT NULL GROUP BY 1"""),
        ("cg", """SELECT l.quantile_group, s.energy_mean, s.energy_median, s.energy_max, s.energy_sum,
       coalesce(s.household_count, 0) AS household_count,
       coalesce(CAST(round_even(s.tou, 1) AS VARCHAR), 'nan') || '% ToU' AS stdorToU, l."order"
FROM labels AS l LEFT JOIN summ AS s ON l.quantile_group = s.quantile_group"""),
    ]


CG_KINDS = [("quantile_group", "s"), ("energy_mean", "d"), ("energy_median", "d"),
            ("energy_max", "d"), ("energy_sum", "d"), ("household_count", "l"),
            ("stdorToU", "s"), ("order", "i")]


def q(extra: list[tuple[str, str]], final: str, kinds: list[tuple[str, str]]) -> str:
    """Fixture + pattern CTEs, extra CTEs, the final SELECT, typed/rounded."""
    return rounded(with_ctes(PATTERN_CTES + extra, final), kinds)


def _second_stage() -> dict[str, str]:
    out: dict[str, str] = {}
    out["filtered_projection"] = q([], f"""SELECT year, month, month_name, temp_bin, energy_mean, days_count
FROM p_temperature WHERE year IN ({_in(FILTER_YEARS)}) AND month IN ({_in(FILTER_MONTHS)})
  AND temp_bin IN ({_in(FILTER_BINS)})""",
        [("year", "i"), ("month", "i"), ("month_name", "s"), ("temp_bin", "s"),
         ("energy_mean", "d"), ("days_count", "l")])
    out["segment_points"] = q([], f"""SELECT Acorn_grouped, stdorToU, energy_mean, energy_max, energy_median,
       household_count, days_count
FROM p_household WHERE stdorToU IN ({_in(FILTER_TARIFFS)}) AND Acorn IN ({_in(FILTER_ACORNS)})""",
        [("Acorn_grouped", "s"), ("stdorToU", "s"), ("energy_mean", "d"), ("energy_max", "d"),
         ("energy_median", "d"), ("household_count", "l"), ("days_count", "l")])
    out["segment_points_one_tariff"] = q([], f"""SELECT Acorn_grouped, stdorToU, energy_mean, energy_max, energy_median,
       household_count, days_count
FROM p_household WHERE stdorToU = '{ONE_TARIFF}' AND Acorn IN ({_in(FILTER_ACORNS)})""",
        [("Acorn_grouped", "s"), ("stdorToU", "s"), ("energy_mean", "d"), ("energy_max", "d"),
         ("energy_median", "d"), ("household_count", "l"), ("days_count", "l")])
    # order is part of these rows: the place of each row in the sorted result
    place = "CAST(row_number() OVER (ORDER BY {}) AS BIGINT) AS place"
    out["ordered_hourly"] = q([], f"SELECT {place.format('year, hour')}, year, hour FROM p_hourly",
                              [("place", "l"), ("year", "i"), ("hour", "i")])
    out["ordered_ranking"] = q([("rk", "SELECT Acorn_grouped, avg(energy_mean) AS m FROM p_household GROUP BY Acorn_grouped")],
                               f"SELECT {place.format('m DESC NULLS FIRST')}, Acorn_grouped FROM rk",
                               [("place", "l"), ("Acorn_grouped", "s")])
    out["yearly_view"] = q([], "SELECT year, hour, energy_mean FROM p_hourly",
                           [("year", "i"), ("hour", "i"), ("energy_mean", "d")])
    out["aggregated_view_hourly"] = q([], "SELECT hour, avg(energy_mean) AS energy_mean FROM p_hourly GROUP BY 1",
                                      [("hour", "i"), ("energy_mean", "d")])
    out["aggregated_view_daily"] = q([], """SELECT weekday, weekday_name, avg(energy_mean) AS energy_mean
FROM p_daily GROUP BY 1, 2""", [("weekday", "i"), ("weekday_name", "s"), ("energy_mean", "d")])
    out["aggregated_view_weekly"] = q([], "SELECT week, avg(energy_mean) AS energy_mean FROM p_weekly GROUP BY 1",
                                      [("week", "i"), ("energy_mean", "d")])
    out["aggregated_view_seasonal"] = q([], """SELECT season, week, avg(energy_mean) AS energy_mean
FROM p_seasonal GROUP BY 1, 2""", [("season", "s"), ("week", "i"), ("energy_mean", "d")])
    out["bar_view_seasonal"] = q([], """SELECT year, season, avg(energy_mean) AS energy_mean_avg
FROM p_seasonal GROUP BY 1, 2""", [("year", "i"), ("season", "s"), ("energy_mean_avg", "d")])
    out["bar_view_weekend"] = q([], """SELECT year, is_weekend, avg(energy_mean) AS energy_mean_avg
FROM p_weekend GROUP BY 1, 2""", [("year", "i"), ("is_weekend", "b"), ("energy_mean_avg", "d")])
    out["tariff_overall"] = q([], """SELECT stdorToU, avg(energy_mean) AS energy_mean,
       sum(household_count) AS household_count, sum(days_count) AS days_count
FROM p_household GROUP BY 1""", [("stdorToU", "s"), ("energy_mean", "d"), ("household_count", "l"),
                                 ("days_count", "l")])
    out["acorn_ranking"] = q([], """SELECT Acorn_grouped, avg(energy_mean) AS energy_mean,
       sum(household_count) AS household_count
FROM p_household GROUP BY 1""", [("Acorn_grouped", "s"), ("energy_mean", "d"), ("household_count", "l")])
    out["segment_kpis"] = q([], """SELECT coalesce(sum(household_count), 0) AS total_households,
       count(DISTINCT stdorToU) + coalesce(max(CASE WHEN stdorToU IS NULL THEN 1 ELSE 0 END), 0) AS tariff_types,
       count(DISTINCT Acorn_grouped) + coalesce(max(CASE WHEN Acorn_grouped IS NULL THEN 1 ELSE 0 END), 0) AS acorn_groups,
       avg(energy_mean) AS avg_energy
FROM p_household""", [("total_households", "l"), ("tariff_types", "l"), ("acorn_groups", "l"),
                      ("avg_energy", "d")])
    for n in (2, 3, 4, 5):
        out[f"consumer_groups_{n}"] = q(_consumer_groups_ctes(n), "SELECT * FROM cg", CG_KINDS)
    out["metrics_long"] = q(_consumer_groups_ctes(3), """SELECT quantile_group, "order", 'energy_mean' AS variable,
       energy_mean AS value FROM cg
UNION ALL
SELECT quantile_group, "order", 'energy_median', energy_median FROM cg""",
        [("quantile_group", "s"), ("order", "i"), ("variable", "s"), ("value", "d")])
    out["consumer_group_mix"] = q(_quantile_ctes(3) + [
        ("grid", """SELECT g.Acorn_grouped, l."order", l.quantile_group
FROM (SELECT DISTINCT Acorn_grouped FROM p_household) AS g CROSS JOIN labels AS l"""),
        ("cnt", """SELECT quantile_group, Acorn_grouped, count(*) AS count FROM lab
WHERE quantile_group IS NOT NULL GROUP BY 1, 2"""),
        ("dense", """SELECT grid.quantile_group, grid.Acorn_grouped, coalesce(cnt.count, 0) AS count, grid."order"
FROM grid LEFT JOIN cnt ON grid.quantile_group = cnt.quantile_group AND grid.Acorn_grouped = cnt.Acorn_grouped"""),
    ], """SELECT quantile_group, Acorn_grouped, count,
       round_even(count / nullif(sum(count) OVER (PARTITION BY quantile_group), 0) * 100, 1) AS percentage,
       "order"
FROM dense""", [("quantile_group", "s"), ("Acorn_grouped", "s"), ("count", "l"), ("percentage", "d"),
                ("order", "i")])
    out["segment_hierarchy"] = q([], """SELECT Acorn_grouped, stdorToU,
       CASE WHEN grouping(stdorToU) = 0 THEN 'tariff' ELSE 'group' END AS level,
       sum(household_count) AS household_count,
       sum(energy_mean * household_count) / nullif(sum(household_count), 0) AS energy_mean
FROM p_household GROUP BY GROUPING SETS ((Acorn_grouped), (Acorn_grouped, stdorToU))""",
        [("Acorn_grouped", "s"), ("stdorToU", "s"), ("level", "s"), ("household_count", "l"),
         ("energy_mean", "d")])
    out["temp_bin_summary"] = q([], f"""SELECT temp_bin, count(*) AS count, min(avg_temperature) AS min_temp,
       max(avg_temperature) AS max_temp, avg(avg_temperature) AS avg_temp
FROM p_temperature WHERE temp_bin IN ({_in(TEMP_BINS)}) GROUP BY 1""",
        [("temp_bin", "s"), ("count", "l"), ("min_temp", "d"), ("max_temp", "d"), ("avg_temp", "d")])
    qn = ["q_min", "q1", "median", "q3", "q_max"]
    qsel = ", ".join(f"quantile_cont(energy_mean, {p}) AS {n}"
                     for p, n in zip(("0.0", "0.25", "0.5", "0.75", "1.0"), qn))
    out["temp_box"] = q([
        ("bq", f"SELECT temp_bin, month_name, count(energy_mean) AS n, {qsel} FROM p_temperature GROUP BY 1, 2"),
        ("bw", """SELECT t.temp_bin, t.month_name,
       min(CASE WHEN t.energy_mean >= bq.q1 - 1.5 * (bq.q3 - bq.q1) THEN t.energy_mean END) AS lower_whisker,
       max(CASE WHEN t.energy_mean <= bq.q3 + 1.5 * (bq.q3 - bq.q1) THEN t.energy_mean END) AS upper_whisker
FROM p_temperature AS t JOIN bq ON t.temp_bin = bq.temp_bin AND t.month_name = bq.month_name
GROUP BY 1, 2"""),
    ], """SELECT bq.temp_bin, bq.month_name, bq.n, bq.q_min, bq.q1, bq.median, bq.q3, bq.q_max,
       bw.lower_whisker, bw.upper_whisker
FROM bq JOIN bw ON bq.temp_bin = bw.temp_bin AND bq.month_name = bw.month_name""",
        [("temp_bin", "s"), ("month_name", "s"), ("n", "l")] + [(n, "d") for n in qn]
        + [("lower_whisker", "d"), ("upper_whisker", "d")])
    out["temp_histogram"] = q([
        ("st", "SELECT min(avg_temperature) AS lo, max(avg_temperature) AS hi FROM p_temperature"),
        ("hb", """SELECT CASE WHEN st.hi - st.lo = 0 THEN 1
            ELSE least(CAST(floor((t.avg_temperature - st.lo) * 20 / (st.hi - st.lo)) AS INTEGER) + 1, 20) END AS bucket
FROM p_temperature AS t, st WHERE t.avg_temperature IS NOT NULL"""),
        ("hc", "SELECT bucket, count(*) AS count FROM hb GROUP BY 1"),
        ("hg", "SELECT CAST(r.range AS INTEGER) AS bucket, st.lo, st.hi FROM st, range(1, 21) AS r WHERE st.lo IS NOT NULL"),
    ], """SELECT hg.bucket, hg.lo + ((hg.bucket - 1) * (hg.hi - hg.lo)) / 20 AS bin_start,
       hg.lo + (hg.bucket * (hg.hi - hg.lo)) / 20 AS bin_end, coalesce(hc.count, 0) AS count
FROM hg LEFT JOIN hc ON hg.bucket = hc.bucket""",
        [("bucket", "i"), ("bin_start", "d"), ("bin_end", "d"), ("count", "l")])
    piv = ", ".join(f"avg(energy) FILTER (WHERE temp_bin = '{b}') AS \"{b}\"" for b in TEMP_BINS)
    out["hour_temp_pivot"] = q([], f"SELECT hour, {piv} FROM p_temp_hourly GROUP BY 1",
                               [("hour", "i")] + [(b, "d") for b in TEMP_BINS])
    out["peak_hour"] = q([], """SELECT hour, avg(energy) AS energy FROM p_temp_hourly
GROUP BY 1 ORDER BY energy DESC, hour LIMIT 1""", [("hour", "i"), ("energy", "d")])
    out["humidity_corr"] = q([], "SELECT corr(energy, avg_humidity) AS humidity_corr FROM p_temp_hourly",
                             [("humidity_corr", "d")])
    out["weather_kpis"] = q([], """SELECT avg(avg_temperature) AS avg_temperature,
       count(DISTINCT temp_bin) AS temp_ranges FROM p_temp_hourly""",
        [("avg_temperature", "d"), ("temp_ranges", "l")])
    out["distinct_filters"] = q([], """SELECT DISTINCT 'acorn' AS filter, Acorn AS value FROM p_household
UNION
SELECT DISTINCT 'temp_bin', temp_bin FROM p_temperature""", [("filter", "s"), ("value", "s")])
    return out


# ---------------------------------------------------------------- profiles / features

PROFILE_GROUP = "Comfortable"
PROFILE_YEARS = (1995, 2001)   # every order date of the driver tables (whole table)


def _micro(list_expr: str) -> str:
    return (f"array_to_string(list_transform({list_expr}, "
            f"lambda x: CAST(CAST(round(x * 1000000.0) AS BIGINT) AS VARCHAR)), '|')")


GROUPS = ("Adversity", "Affluent", "Comfortable")
INNER_GROUP, INNER_YEARS = "Affluent", (1996, 1998)     # another group, an inner range


def _profile_ctes(group: str = PROFILE_GROUP, years: tuple[int, int] = PROFILE_YEARS, strict: bool = False,
                  align: bool = False) -> list[tuple[str, str]]:
    hh = "[" + ", ".join(f"coalesce(hh_{i}, 0)" if align else f"hh_{i}" for i in range(48)) + "]"
    lo, hi = years
    own = f"Acorn_grouped = '{group}'" if strict else f"file IN (SELECT file FROM households WHERE Acorn_grouped = '{group}')"
    return [
        ("members", f"SELECT DISTINCT LCLid FROM households WHERE {own}"),
        ("wd", f"""SELECT {WTS} AS dt, avg(temperatureMax) AS avg_temperature, avg(humidity) AS avg_humidity
FROM weather_daily GROUP BY 1"""),
        ("hol", "SELECT CAST(holiday AS DATE) AS hd, true AS is_holiday FROM holidays"),
        ("pbase", f"""SELECT hh.*, {DATE} AS dt FROM half_hourly AS hh
WHERE LCLid IN (SELECT LCLid FROM members) AND year({DATE}) BETWEEN {lo} AND {hi}"""),
        ("prof", f"""SELECT b.LCLid, b.day, CAST(isodow(b.dt) AS INTEGER) AS day_of_week,
       (isodow(b.dt) >= 5 OR coalesce(hol.is_holiday, false)) AS is_weekend,
       wd.avg_temperature, wd.avg_humidity, CAST((month(b.dt) % 12) // 3 AS INTEGER) AS season,
       list_filter({hh}, lambda x: x IS NOT NULL) AS hh
FROM pbase AS b LEFT JOIN hol ON b.dt = hol.hd LEFT JOIN wd ON b.dt = wd.dt"""),
    ]


def _feature_ctes(group: str = PROFILE_GROUP) -> list[tuple[str, str]]:
    def z(c: str) -> str:
        return (f"CASE WHEN zs.{c}_sd < 1e-7 THEN coalesce({c}, zs.{c}_m) - zs.{c}_mf "
                f"ELSE (coalesce({c}, zs.{c}_m) - zs.{c}_mf) / zs.{c}_sd END")

    def onehot(idx: str, n: int) -> str:
        return (f"list_transform(range({n}), lambda i: CASE WHEN i = least(greatest({idx}, 0), {n - 1}) "
                f"THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")
    return _profile_ctes(group) + [
        ("modal", """SELECT n FROM (SELECT len(hh) AS n, count(*) AS c FROM prof GROUP BY 1) AS t
ORDER BY c DESC, n ASC LIMIT 1"""),
        ("dw", "SELECT min(day_of_week) AS mn, max(day_of_week) AS mx FROM prof"),
        ("zm", """SELECT coalesce(avg(avg_temperature), 0) AS avg_temperature_m,
       coalesce(avg(avg_humidity), 0) AS avg_humidity_m FROM prof"""),
        ("zs", """SELECT zm.avg_temperature_m, zm.avg_humidity_m,
       avg(coalesce(p.avg_temperature, zm.avg_temperature_m)) AS avg_temperature_mf,
       avg(coalesce(p.avg_humidity, zm.avg_humidity_m)) AS avg_humidity_mf,
       stddev_pop(coalesce(p.avg_temperature, zm.avg_temperature_m)) AS avg_temperature_sd,
       stddev_pop(coalesce(p.avg_humidity, zm.avg_humidity_m)) AS avg_humidity_sd
FROM prof AS p, zm GROUP BY zm.avg_temperature_m, zm.avg_humidity_m"""),
        ("feat", f"""SELECT p.LCLid, p.day,
       list_resize(p.hh, modal.n, CAST(0 AS DOUBLE)) AS reading,
       list_concat({onehot("p.day_of_week - CASE WHEN dw.mn >= 1 AND dw.mx <= 7 THEN 1 ELSE 0 END", 7)},
                   {onehot("CAST(p.is_weekend AS INTEGER)", 2)}, {onehot("p.season", 4)},
                   [{z("p.avg_temperature").replace("zs.p.", "zs.")}, {z("p.avg_humidity").replace("zs.p.", "zs.")}]) AS cond
FROM prof AS p, modal, dw, zs"""),
    ]


def _features_stage() -> dict[str, str]:
    out: dict[str, str] = {}
    for key, ctes in (("acorn_profiles", _profile_ctes()),
                      ("acorn_profiles_strict", _profile_ctes(strict=True)),
                      ("acorn_profiles_aligned", _profile_ctes(align=True)),
                      ("acorn_profiles_inner", _profile_ctes(INNER_GROUP, INNER_YEARS))):
        out[key] = q(ctes, f"""SELECT LCLid, day, day_of_week, is_weekend, avg_temperature,
       avg_humidity, season, len(hh) AS n_readings, {_micro("hh")} AS hh_consumption FROM prof""",
            [("LCLid", "s"), ("day", "s"), ("day_of_week", "i"), ("is_weekend", "b"),
             ("avg_temperature", "d"), ("avg_humidity", "d"), ("season", "i"), ("n_readings", "i"),
             ("hh_consumption", "s")])
    out["group_files"] = q([], f"SELECT DISTINCT file FROM households WHERE Acorn_grouped = '{PROFILE_GROUP}'", [("file", "s")])
    out["features"] = q(_feature_ctes(), f"""SELECT LCLid, day, len(reading) AS reading_len,
       {_micro("reading")} AS reading, {_micro("cond")} AS cond FROM feat""",
        [("LCLid", "s"), ("day", "s"), ("reading_len", "i"), ("reading", "s"), ("cond", "s")])
    return out


# ---------------------------------------------------------------- fixed-weight scoring

SCORING_SEED = 7         # equals registry.FIXED_WEIGHT_SEED (model.rule_params)
SCORING_THRESHOLD = 0.1


def _w(layer: int, i: str, j: str) -> str:
    return f"(CAST(((({i}) * 7 + ({j}) * 13 + {layer * 5 + SCORING_SEED}) % 17) - 8 AS DOUBLE) / 64)"


def _b(layer: int, j: str) -> str:
    return f"(CAST(((({j}) * 11 + {layer * 3 + SCORING_SEED}) % 9) - 4 AS DOUBLE) / 64)"


def _scoring_ctes(group: str = PROFILE_GROUP) -> list[tuple[str, str]]:
    """The forward pass [x, c] -> 8 -> ReLU -> 2; [z, c] -> 8 -> ReLU -> x
    with rule weights, as list dot products."""
    return _feature_ctes(group) + [
        ("s1", f"""SELECT LCLid, day, reading, cond,
       list_transform(range(8), lambda j: greatest(list_dot_product(list_concat(reading, cond),
           list_transform(range(len(reading) + len(cond)), lambda i: {_w(1, 'i', 'j')})) + {_b(1, 'j')},
           CAST(0 AS DOUBLE))) AS h1
FROM feat"""),
        ("s2", f"""SELECT *, list_transform(range(2), lambda k: list_dot_product(h1,
           list_transform(range(8), lambda j: {_w(2, 'j', 'k')})) + {_b(2, 'k')}) AS z FROM s1"""),
        ("s3", f"""SELECT *, list_transform(range(8), lambda j: greatest(list_dot_product(list_concat(z, cond),
           list_transform(range(2 + len(cond)), lambda i: {_w(3, 'i', 'j')})) + {_b(3, 'j')},
           CAST(0 AS DOUBLE))) AS h3 FROM s2"""),
        ("scored", f"""SELECT LCLid, day, reading,
       list_transform(range(len(reading)), lambda m: list_dot_product(h3,
           list_transform(range(8), lambda j: {_w(4, 'j', 'm')})) + {_b(4, 'm')}) AS recon FROM s3"""),
        ("slots", """SELECT LCLid, day, unnest(range(len(reading))) AS slot, unnest(reading) AS actual,
       unnest(recon) AS recon FROM scored"""),
    ]


SPLIT_SEED, SPLIT_SHARE, STEP_RATE = 42, 0.1, 0.01      # equal model.AEConfig and registry.STEP_RATE
TRACE_LR_PATIENCE, TRACE_PATIENCE = 2, 14
QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)
MIX_ORDER = '"order", percentage DESC NULLS LAST, Acorn_grouped'


def _is_val() -> str:
    """First four hex digits of md5(household|day|seed) against the share."""
    digit = "(strpos('0123456789abcdef', substr(md5(LCLid || '|' || day || '|{}'), {}, 1)) - 1)"
    value = " + ".join(f"{digit.format(SPLIT_SEED, k + 1)} * {16 ** (3 - k)}" for k in range(4))
    return f"({value}) < {round(SPLIT_SHARE * 65536)}"


def _by_group(group: str) -> str:
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in _scoring_ctes(group))
    return (f"SELECT * FROM (WITH {ctes} SELECT '{group}' AS acorn_group, "
            "sum((actual - recon) * (actual - recon)) / count(*) AS mse FROM slots)")


ADAM = (0.9, 0.999, 1e-8)


def _round(k: int) -> str:
    """Which of ``k`` synchronous steps a row belongs to (model.round_of)."""
    digit = "(strpos('0123456789abcdef', substr(md5(LCLid || '|' || day || '|{}|round'), {}, 1)) - 1)"
    return "(" + " + ".join(f"{digit.format(SPLIT_SEED, i + 1)} * {16 ** (3 - i)}" for i in range(4)) + f") % {k}"


def _relational_step(p: str, rows: str, weights: str) -> list[tuple[str, str]]:
    """Gradient over ``rows`` for any weights, as CTE ``{p}grads(param,
    gradient)``: ``weights(layer, i, j, param, weight)`` are joined to the
    values (r, i, v) of a layer's inputs, the last of which is 1 for the bias."""
    def dense(layer: int, src: str) -> str:
        return (f"SELECT s.r, w.j, sum(s.v * w.weight) AS v FROM {p}{src} AS s JOIN {weights} AS w ON w.layer = {layer} AND w.i = s.i GROUP BY s.r, w.j")

    def back(layer: int, src: str) -> str:
        return (f"SELECT s.r, w.i AS j, sum(s.v * w.weight) AS v FROM {p}{src} AS s JOIN {weights} AS w ON w.layer = {layer} AND w.j = s.j GROUP BY s.r, w.i")

    def relu(src: str) -> str:
        return f"SELECT r, j AS i, greatest(v, 0) AS v FROM {p}{src} UNION ALL SELECT r, 8, CAST(1 AS DOUBLE) FROM {p}t0"
    inputs = {1: "x", 2: "h1", 3: "d", 4: "h3"}
    return [
        (f"{p}t0", f"SELECT row_number() OVER () AS r, reading, cond FROM ({rows})"),
        (f"{p}x", f"SELECT r, unnest(range(len(u))) AS i, unnest(u) AS v FROM (SELECT r, list_append(list_concat(reading, cond), CAST(1 AS DOUBLE)) AS u FROM {p}t0)"),
        (f"{p}a1", dense(1, "x")), (f"{p}h1", relu("a1")), (f"{p}z", dense(2, "h1")),
        (f"{p}d", f"SELECT r, j AS i, v FROM {p}z UNION ALL SELECT r, 2 + unnest(range(len(u))), unnest(u) FROM (SELECT r, list_append(cond, CAST(1 AS DOUBLE)) AS u FROM {p}t0)"),
        (f"{p}a3", dense(3, "d")), (f"{p}h3", relu("a3")), (f"{p}y", dense(4, "h3")),
        (f"{p}d4", f"SELECT y.r, y.j, 2 * (y.v - t.reading[y.j + 1]) AS v FROM {p}y AS y JOIN {p}t0 AS t USING (r)"),
        (f"{p}d3", f"SELECT b.r, b.j, b.v FROM ({back(4, 'd4')}) AS b JOIN {p}a3 AS a USING (r, j) WHERE a.v > 0"),
        (f"{p}d2", f"SELECT r, j, v FROM ({back(3, 'd3')}) WHERE j < 2"),
        (f"{p}d1", f"SELECT b.r, b.j, b.v FROM ({back(2, 'd2')}) AS b JOIN {p}a1 AS a USING (r, j) WHERE a.v > 0"),
        (f"{p}sums", " UNION ALL ".join(
            f"SELECT {k} AS layer, s.i, d.j, sum(s.v * d.v) AS g FROM {p}{u} AS s JOIN {p}d{k} AS d USING (r) GROUP BY s.i, d.j" for k, u in inputs.items())),
        (f"{p}size", f"SELECT count(*) * max(len(reading)) AS n FROM {p}t0"),
        (f"{p}grads", f"SELECT w.param, w.weight, coalesce(s.g, 0) / n AS gradient FROM {weights} AS w LEFT JOIN {p}sums AS s ON s.layer = w.layer AND s.i = w.i AND s.j = w.j, {p}size"),
    ]


def _rule_weights() -> str:
    """All weights of the rule with their place in the flat list (i = number of
    inputs: the bias)."""
    shape = "(SELECT max(len(reading)) AS m, max(len(cond)) AS c FROM feat)"
    layers = {1: ("m + c", "8", "0"), 2: ("8", "2", "(m + c + 1) * 8"), 3: ("2 + c", "8", "(m + c + 1) * 8 + 18"),
              4: ("8", "m", "(m + c + 1) * 8 + 18 + (3 + c) * 8")}
    return " UNION ALL ".join(
        f"SELECT {k} AS layer, i, j, {start} + i * ({n_out}) + j AS param, CASE WHEN i < {n_in} THEN {_w(k, 'i', 'j')} ELSE {_b(k, 'j')} END AS weight "
        f"FROM (SELECT m, c, i, unnest(range({n_out})) AS j FROM (SELECT m, c, unnest(range({n_in} + 1)) AS i FROM {shape}))"
        for k, (n_in, n_out, start) in layers.items())


def _backprop(p: str, rows: str, weight, bias) -> list[tuple[str, str]]:
    """Gradient of every parameter over ``rows(reading, cond, ..)`` as CTE
    ``{p}grads(param, gradient, w)``, ``w`` being the rule weight: forward
    values, the deltas of the four layers, then a sum per parameter."""
    def dense(layer: int, src: str, n_in: str, j: str = "j") -> str:
        return f"list_dot_product({src}, list_transform(range({n_in}), lambda i: {weight(layer, 'i', j)})) + {bias(layer, j)}"
    return [
        (f"{p}t0", f"SELECT *, list_concat(reading, cond) AS x FROM ({rows})"),
        (f"{p}t1", f"SELECT *, list_transform(range(8), lambda j: {dense(1, 'x', 'len(x)')}) AS a1 FROM {p}t0"),
        (f"{p}t2", f"SELECT *, list_transform(a1, lambda v: greatest(v, CAST(0 AS DOUBLE))) AS h1 FROM {p}t1"),
        (f"{p}t3", f"SELECT *, list_concat(list_transform(range(2), lambda j: {dense(2, 'h1', '8')}), cond) AS d FROM {p}t2"),
        (f"{p}t4", f"SELECT *, list_transform(range(8), lambda j: {dense(3, 'd', 'len(d)')}) AS a3 FROM {p}t3"),
        (f"{p}t5", f"SELECT *, list_transform(a3, lambda v: greatest(v, CAST(0 AS DOUBLE))) AS h3 FROM {p}t4"),
        (f"{p}t6", f"SELECT *, list_transform(range(len(reading)), lambda j: 2 * ({dense(4, 'h3', '8')} - reading[j + 1])) AS d4 FROM {p}t5"),
        (f"{p}t7", "SELECT *, list_transform(range(8), lambda i: CASE WHEN a3[i + 1] > 0 THEN list_dot_product(d4, "
                   f"list_transform(range(len(reading)), lambda j: {weight(4, 'i', 'j')})) ELSE CAST(0 AS DOUBLE) END) AS d3 FROM {p}t6"),
        (f"{p}t8", "SELECT *, list_transform(range(2), lambda i: list_dot_product(d3, "
                   f"list_transform(range(8), lambda j: {weight(3, 'i', 'j')}))) AS d2 FROM {p}t7"),
        (f"{p}t9", "SELECT *, list_transform(range(8), lambda i: CASE WHEN a1[i + 1] > 0 THEN list_dot_product(d2, "
                   f"list_transform(range(2), lambda j: {weight(2, 'i', 'j')})) ELSE CAST(0 AS DOUBLE) END) AS d1 FROM {p}t8"),
        # inputs of a layer with a 1 at the end for its bias
        (f"{p}pairs", " UNION ALL ".join(
            f"SELECT {layer} AS layer, unnest(range(len({u}) + 1)) AS i, list_append({u}, CAST(1 AS DOUBLE)) AS u, {d} AS d FROM {p}t9"
            for layer, u, d in ((1, "x", "d1"), (2, "h1", "d2"), (3, "d", "d3"), (4, "h3", "d4")))),
        (f"{p}cells", f"SELECT layer, i, len(u) - 1 AS n_in, len(d) AS n_out, unnest(range(len(d))) AS j, u[i + 1] AS v, d FROM {p}pairs"),
        (f"{p}sums", f"SELECT layer, i, j, max(n_in) AS n_in, max(n_out) AS n_out, sum(v * d[j + 1]) AS g FROM {p}cells GROUP BY layer, i, j"),
        (f"{p}size", f"SELECT count(*) * max(len(reading)) AS n FROM {p}t0"),
        (f"{p}offsets", "SELECT layer, coalesce(sum((n_in + 1) * n_out) OVER (ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start "
                        f"FROM (SELECT DISTINCT layer, n_in, n_out FROM {p}sums)"),
        (f"{p}grads", "SELECT CAST(start + CASE WHEN i < n_in THEN i * n_out + j ELSE n_in * n_out + j END AS BIGINT) AS param, g / n AS gradient, "
                      "CASE WHEN i < n_in THEN CAST((i * 7 + j * 13 + layer * 5 + %d) %% 17 - 8 AS DOUBLE) / 64 "
                      "ELSE CAST((j * 11 + layer * 3 + %d) %% 9 - 4 AS DOUBLE) / 64 END AS w FROM %ssums JOIN %soffsets USING (layer), %ssize"
                      % (SCORING_SEED, SCORING_SEED, p, p, p)),
    ]


def _training_stage() -> dict[str, str]:
    """Steps from the rule weights by backpropagation over lists."""
    train = f"FROM feat WHERE NOT ({_is_val()})"
    first = f"w - {STEP_RATE} * gradient / (sqrt(gradient * gradient) + {ADAM[2]})"
    step = [("param", "l"), ("gradient", "d"), ("weight", "d")]
    one = _feature_ctes() + _backprop("", f"SELECT * {train}", _w, _b)
    bare = _feature_ctes() + _backprop("", f"SELECT * REPLACE (CAST([] AS DOUBLE[]) AS cond) {train}", _w, _b)
    b1, b2, eps = ADAM
    m2, v2 = f"({b1} * {1 - b1} * a.gradient + {1 - b1} * b.gradient)", f"({b2} * {1 - b2} * a.gradient * a.gradient + {1 - b2} * b.gradient * b.gradient)"
    two = (_feature_ctes() + [("w0", _rule_weights())] + _relational_step("a_", f"SELECT * {train} AND {_round(2)} = 0", "w0")
           + [("w1", f"SELECT w0.layer, w0.i, w0.j, param, g.weight - {STEP_RATE} * g.gradient / (sqrt(g.gradient * g.gradient) + {eps}) AS weight "
                     "FROM w0 JOIN a_grads AS g USING (param)")]
           + _relational_step("b_", f"SELECT * {train} AND {_round(2)} = 1", "w1"))
    return {
        "train_step_fixed": q(one, f"SELECT param, gradient, {first} AS weight FROM grads", step),
        "train_step_unconditional": q(bare, f"SELECT param, gradient, {first} AS weight FROM grads", step),
        "train_rounds_fixed": q(two, f"""SELECT param, b.weight - {STEP_RATE} * ({m2} / {1 - b1 ** 2}) / (sqrt({v2} / {1 - b2 ** 2}) + {eps}) AS weight
FROM a_grads AS a JOIN b_grads AS b USING (param)""", [("param", "l"), ("weight", "d")]),
        "schedule_trace": rounded(with_ctes([], f"""SELECT epoch, loss, lr, next_lr, flat, bad, stop FROM (WITH RECURSIVE series AS (
  SELECT CAST(row_number() OVER (ORDER BY substr(time, 1, 7)) AS INTEGER) AS epoch, avg(temperatureMax + 50) AS loss
  FROM weather_daily GROUP BY substr(time, 1, 7)),
trace AS (
  SELECT 0 AS epoch, CAST(NULL AS DOUBLE) AS loss, CAST(0.001 AS DOUBLE) AS lr, CAST(0.001 AS DOUBLE) AS next_lr, 0 AS flat, 0 AS bad, false AS stop,
         CAST('inf' AS DOUBLE) AS floor_, CAST('inf' AS DOUBLE) AS best
  UNION ALL
  SELECT s.epoch, s.loss, t.next_lr,
         CASE WHEN s.loss < t.floor_ * (1 - 1e-4) THEN t.next_lr WHEN t.flat + 1 > {TRACE_LR_PATIENCE} THEN t.next_lr / 2 ELSE t.next_lr END,
         CASE WHEN s.loss < t.floor_ * (1 - 1e-4) OR t.flat + 1 > {TRACE_LR_PATIENCE} THEN 0 ELSE t.flat + 1 END,
         CASE WHEN s.loss < t.best THEN 0 ELSE t.bad + 1 END,
         CASE WHEN s.loss < t.best THEN false ELSE t.bad + 1 >= {TRACE_PATIENCE} END,
         CASE WHEN s.loss < t.floor_ * (1 - 1e-4) THEN s.loss ELSE t.floor_ END, least(s.loss, t.best)
  FROM trace t JOIN series s ON s.epoch = t.epoch + 1 WHERE NOT t.stop)
SELECT * FROM trace WHERE epoch > 0)"""), [("epoch", "i"), ("loss", "d"), ("lr", "d"), ("next_lr", "d"), ("flat", "i"), ("bad", "i"), ("stop", "b")]),
        "split_counts": q(_feature_ctes(), f"SELECT {_is_val()} AS is_val, count(*) AS rows, count(DISTINCT day) AS days FROM feat GROUP BY 1",
                          [("is_val", "b"), ("rows", "l"), ("days", "l")]),
        "reconstruction_by_group": q([], " UNION ALL ".join(map(_by_group, GROUPS)), [("acorn_group", "s"), ("mse", "d")]),
        "list_codec": q([("r", "SELECT LCLid, day, [" + ", ".join(f"hh_{i}" for i in range(48)) + "] AS l FROM half_hourly")],
                        "SELECT LCLid, day, array_to_string(list_transform(l, lambda x: coalesce(CAST(x AS VARCHAR), 'None')), '|') AS text, "
                        "list_count(l) AS n, coalesce(list_sum(l), 0) AS total FROM r",
                        [("LCLid", "s"), ("day", "s"), ("text", "s"), ("n", "l"), ("total", "d")]),
        "weekend_text": q(_profile_ctes(), "SELECT LCLid, day, CASE WHEN is_weekend THEN 'True' ELSE 'False' END AS is_weekend, "
                          "CAST(is_weekend AS INTEGER) AS weekend FROM prof",
                          [("LCLid", "s"), ("day", "s"), ("is_weekend", "s"), ("weekend", "i")]),
        "latent_codes": q(_scoring_ctes(), "SELECT LCLid, day, z[1] AS z0, z[2] AS z1 FROM s2",
                          [("LCLid", "s"), ("day", "s"), ("z0", "d"), ("z1", "d")]),
    }


def _scoring_stage() -> dict[str, str]:
    ctes = _scoring_ctes()
    return {
        "reconstruction_fixed": q(ctes, """SELECT LCLid, day, sum((actual - recon) * (actual - recon)) AS sse,
       count(*) AS slots FROM slots GROUP BY 1, 2""",
            [("LCLid", "s"), ("day", "s"), ("sse", "d"), ("slots", "i")]),
        "anomaly_slots": q(ctes, f"""SELECT LCLid, day, slot, printf('%02d:%02d', slot // 2, (slot % 2) * 30) AS label,
       actual, recon, abs(actual - recon) AS diff
FROM slots WHERE abs(actual - recon) > {SCORING_THRESHOLD}""",
            [("LCLid", "s"), ("day", "s"), ("slot", "i"), ("label", "s"), ("actual", "d"), ("recon", "d"),
             ("diff", "d")]),
        "reconstruction_error": q(ctes, """SELECT sum((actual - recon) * (actual - recon)) / count(*) AS mse
FROM slots""", [("mse", "d")]),
    }


def _kept_stage() -> dict[str, str]:
    """Exact quantiles, orders, and tables read back from files."""
    place = "CAST(row_number() OVER (ORDER BY {}) AS BIGINT) AS place"
    qs = ", ".join(f"quantile_cont(energy, {p}) AS q{round(p * 100):02d}" for p in QUANTILES)
    slots = "[" + ", ".join(f"hh_{i}" for i in range(48)) + "]"
    hours = ", ".join(f"coalesce(hh_{2 * h}, 0) + coalesce(hh_{2 * h + 1}, 0)" for h in range(24))
    bins = " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(TEMP_BINS))
    return {
        "hourly_quantiles": q([("qhours", f"SELECT CAST(substr(day, 1, 4) AS INTEGER) AS year, unnest(range(24)) AS hour, unnest([{hours}]) AS energy FROM half_hourly")],
                              f"SELECT year, hour, count(*) AS n, {qs} FROM qhours GROUP BY year, hour",
                              [("year", "i"), ("hour", "i"), ("n", "l")] + [(f"q{round(p * 100):02d}", "d") for p in QUANTILES]),
        "ordered_mix": q(_quantile_ctes(3) + [
            ("grid", """SELECT g.Acorn_grouped, l."order", l.quantile_group
FROM (SELECT DISTINCT Acorn_grouped FROM p_household) AS g CROSS JOIN labels AS l"""),
            ("dense", """SELECT grid.quantile_group, grid.Acorn_grouped, grid."order", count(lab.quantile_group) AS count
FROM grid LEFT JOIN lab ON grid.quantile_group = lab.quantile_group AND grid.Acorn_grouped = lab.Acorn_grouped GROUP BY ALL"""),
            ("shares", """SELECT *, round_even(count / nullif(sum(count) OVER (PARTITION BY quantile_group), 0) * 100, 1) AS percentage FROM dense""")],
            f"""SELECT {place.format(MIX_ORDER)}, quantile_group, Acorn_grouped FROM shares""",
            [("place", "l"), ("quantile_group", "s"), ("Acorn_grouped", "s")]),
        "ordered_bins": q([("bins", f"SELECT DISTINCT temp_bin FROM p_temperature WHERE temp_bin IN ({_in(TEMP_BINS)})")],
                          f"SELECT {place.format(f'CASE temp_bin {bins} END')}, temp_bin FROM bins", [("place", "l"), ("temp_bin", "s")]),
        "temp_bin_known": q([], f"""SELECT temp_bin, count(*) AS count, min(avg_temperature) AS min_temp,
       max(avg_temperature) AS max_temp, avg(avg_temperature) AS avg_temp
FROM p_temperature WHERE temp_bin IN ({_in(TEMP_BINS)}) AND month % 3 <> 0 GROUP BY 1""",
            [("temp_bin", "s"), ("count", "l"), ("min_temp", "d"), ("max_temp", "d"), ("avg_temp", "d")]),
        "households_by_year": q([], """SELECT CAST(substr(d.day, 1, 4) AS INTEGER) AS year, h.Acorn_grouped, count(DISTINCT d.LCLid) AS household_count
FROM daily AS d JOIN households AS h ON d.LCLid = h.LCLid GROUP BY 1, 2""",
            [("year", "i"), ("Acorn_grouped", "s"), ("household_count", "l")]),
        "ledger_rows": q([("r", f"SELECT LCLid, day, {slots} AS l FROM half_hourly")],
                         "SELECT LCLid, day, CAST(substr(day, 1, 4) AS INTEGER) AS year, list_count(l) AS n, coalesce(list_sum(l), 0) AS total FROM r",
                         [("LCLid", "s"), ("day", "s"), ("year", "i"), ("n", "i"), ("total", "d")]),
        "csv_households": q([], "SELECT LCLid, stdorToU, Acorn, Acorn_grouped, file FROM households",
                            [("LCLid", "s"), ("stdorToU", "s"), ("Acorn", "s"), ("Acorn_grouped", "s"), ("file", "s")]),
    }


def oracle_sql() -> dict[str, str]:
    out = {key: rounded(_q(f"SELECT * FROM {cte}"), KINDS[key]) for key, cte in _PATTERN_CTE.items()}
    out.update(_second_stage())
    out.update(_features_stage())
    out.update(_scoring_stage())
    out.update(_training_stage())
    out.update(_kept_stage())
    # other ways to the same rows
    out["hourly_patterns_continuous"] = out["hourly_patterns_refreshed"] = out["hourly_patterns"]
    out["consumer_groups_3_continuous"], out["temp_box_continuous"] = out["consumer_groups_3"], out["temp_box"]
    # the streaming key scores the same rows with the same (frozen) statistics
    out["stream_anomaly_slots"] = out["anomaly_slots"]
    return out
